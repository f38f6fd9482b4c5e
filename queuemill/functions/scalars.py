"""Small column functions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000

# Seconds a batch waits at least, and examples' worth of time it waits otherwise.
LEAST_WAIT = 0.003
WAIT_EXAMPLES = 0.51


def to_micros(column: Column) -> Column:
    """Epoch microseconds of a timestamp column."""
    return F.unix_micros(column.cast("timestamp"))


def l2_normalize(vector: Column) -> Column:
    """Scale an array of numbers to unit length; a zero vector stays as it is.

    The division sits in the fold's last step, so the sum of squares is formed once per vector.
    """
    return F.aggregate(
        vector,
        F.lit(0.0),
        lambda total, x: total + x.cast("double") * x.cast("double"),
        lambda total: F.transform(
            vector,
            lambda x: x.cast("double") / F.when(total == 0, F.lit(1.0)).otherwise(F.sqrt(total)),
        ),
    )


def format_duration(milliseconds: Column) -> Column:
    """Readable duration: microseconds below 1 ms, milliseconds below 1 s, else seconds."""
    return (
        F.when(milliseconds < 1, F.format_string("%.2fμs", milliseconds * 1000))
        .when(milliseconds < 1000, F.format_string("%.2fms", milliseconds))
        .otherwise(F.format_string("%.2fs", milliseconds / 1000))
    )


def max_wait_seconds(time_per_example: Column) -> Column:
    """How long a batch may wait for more requests: 0.51 examples' worth, 3 ms at least."""
    return F.greatest(F.lit(LEAST_WAIT), time_per_example * F.lit(WAIT_EXAMPLES))


def fill_batch(example: Column, batch_size: int) -> Column:
    """Repeat the example list cyclically to exactly ``batch_size`` items.

    Item i of the result is item ``i mod size`` of the example, so only ``batch_size`` cells are
    built however long the example is. An empty example gives an empty batch.
    """
    return F.when(F.size(example) == 0, F.slice(example, 1, 0)).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.lit(batch_size - 1)),
            lambda i: F.element_at(example, (i % F.size(example) + 1).cast("int")),
        )
    )


