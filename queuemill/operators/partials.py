"""Service metrics from partial sums per time slice: any window without a scan of the log.

``metric_partials`` counts every request in the slice of its arrival and in that of its delivery. ``window_from_partials``
adds up the slices that lie wholly in the window; only for the pieces at its two ends it reads the log, with predicates on
the two times that reach the scan. Partials are additive: those of several loads, or of a stream's epochs, may lie in one
table.

A request's row should not change any more when it is counted: a slice that still holds pending requests has to be made
again once they are answered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queuemill.functions.scalars import MICROS
from queuemill.operators.metrics import DEFAULT_SECONDS, METRICS

MINUTE_US = 60 * MICROS
NAMES = [name for name, _ in METRICS]
SUMS = ("total_seconds", "actual_seconds")


def _moments() -> Column:
    """What a request adds at its arrival and at its delivery."""
    failed = F.col("success").eqNullSafe(False)
    good = F.col("success").eqNullSafe(True) & ~F.col("timed_out").eqNullSafe(True)
    answered = F.col("delivered_us").isNotNull() & ~F.col("timed_out").eqNullSafe(True)
    pending = F.col("delivered_us").isNull() & ~failed
    flag = lambda c: c.cast("bigint")
    none = F.lit(None).cast("double")

    def seconds(end: str, start: str) -> Column:
        return F.when(answered, (F.col(end) - F.col(start)).cast("double") / MICROS)

    zero = F.lit(0).cast("bigint")
    arrival = [F.lit(1).cast("bigint"), zero, zero, flag(failed), zero, flag(pending), flag(answered & good), zero]
    delivery = [zero, F.lit(1).cast("bigint"), flag(F.col("timed_out").eqNullSafe(True)), zero, flag(failed), zero, zero, flag(good)]
    sums = [seconds("delivered_us", "received_us"), seconds("stage0_predicted_us", "stage0_received_us")]

    def moment(at: str, counts: list[Column], totals: list[Column]) -> Column:
        fields = [c.alias(name) for c, name in zip([*counts, *totals], [*NAMES[:8], *SUMS])]
        return F.struct(F.col(at).alias("at_us"), *fields)

    return F.inline(F.array(moment("received_us", arrival, sums), moment("delivered_us", delivery, [none, none])))


def _summed(moments: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
    return moments.groupBy(*keys).agg(*[F.sum(name).alias(name) for name in [*NAMES[:8], *SUMS]])


def metric_partials(log: DataFrame, slice_us: int = MINUTE_US, keys: Sequence[str] = ()) -> DataFrame:
    """One row per slice and group of ``keys``, combined before the shuffle."""
    moments = log.select(*keys, _moments()).filter("at_us is not null")
    begin = (F.floor(F.col("at_us") / slice_us) * slice_us).cast("bigint").alias("slice_us")
    return _summed(moments, [*keys, begin])


def border_rows(log: DataFrame, as_of_us: int, seconds: float, slice_us: int = MINUTE_US) -> tuple[DataFrame, Column]:
    """The rows of the log that the ends of the window touch, and which moments of theirs count."""
    begin, end = as_of_us - int(seconds * MICROS), as_of_us
    first, last = begin // slice_us * slice_us + slice_us, end // slice_us * slice_us
    pieces = [(begin, first, False), (last, end, True)] if first <= last else [(begin, end, False)]

    def inside(at: str) -> Column:
        found = F.lit(False)
        for lo, hi, closed in pieces:
            found = found | ((F.col(at) >= lo if closed else F.col(at) > lo) & (F.col(at) < hi))
        return found

    return log.filter(inside("received_us") | inside("delivered_us")), inside("at_us")


def window_from_partials(
    partials: DataFrame, log: DataFrame, as_of_us: int, seconds: float = DEFAULT_SECONDS, slice_us: int = MINUTE_US,
    keys: Sequence[str] = (),
) -> DataFrame:
    """:func:`~queuemill.operators.metrics.window_metrics` of the log that ``partials`` was made from; groups that the
    window does not touch have no row."""
    begin, end = as_of_us - int(seconds * MICROS), as_of_us
    whole = partials.filter((F.col("slice_us") > begin) & (F.col("slice_us") <= end - slice_us)).drop("slice_us")
    rows, counted = border_rows(log, as_of_us, seconds, slice_us)
    ends = rows.select(*keys, _moments()).filter(counted).drop("at_us")
    summed = _summed(whole.unionByName(ends), keys)
    successful = F.col(NAMES[6])
    averages = [
        F.when(F.col(total).isNull(), F.lit(0.0)).otherwise(F.try_divide(F.col(total), successful)).alias(name)
        for total, name in zip(SUMS, NAMES[8:])
    ]
    counts = [F.coalesce(F.col(name), F.lit(0)).cast("bigint").alias(name) for name in NAMES[:8]]
    return summed.select(*keys, *counts, *averages)
