"""Measuring runs: how long a chain's stages take per example, by batch size, on the executors that will run them.

Every example is one task's work: the first stage is warmed up with it ``WARM_UPS`` times, then called with batches of
1, 2, 4 … 1024 inputs, the example repeated to exactly that many, until a size takes no less time per example than the one
before. What the last warm-up answered is the next stage's example. ``runs`` repeats all that on other tasks, so that
the averages cover several executors. A task gives at most one row per stage and size.

A stage that raises while it warms up or runs ends the walk with a row that holds the error and no time; stages after it
are not measured. An example that is NULL or empty gives such a row, too.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence
from functools import partial
from itertools import cycle, islice
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuemill.operators.inference import ContractError, Stage, _call, _numbered
from queuemill.operators.recipes import stage_registry
from queuemill.operators.tuning import choose_batch_size

SIZES = tuple(2**i for i in range(11))
WARM_UPS = 3

MEASURED = (
    "run int, stage int, stage_name string, batch_size int, elapsed_us double, time_per_example double, "
    "example_output string, error string"
)
_FIELDS = [part.split()[0] for part in MEASURED.split(", ")]
_ARROW = {"int": pa.int32(), "string": pa.string(), "double": pa.float64()}
_ARROW_TYPES = [_ARROW[part.split()[1]] for part in MEASURED.split(", ")]

Clock = Callable[[Any], float]


def wall_clock(_: Any) -> float:
    """Microseconds of a clock that never goes back."""
    return time.perf_counter_ns() / 1000


def walk_sizes(
    stage: Stage, example: list, sizes: Sequence[int], clock: Clock
) -> tuple[list[tuple[int, float | None, str | None]], list | None]:
    """Size, elapsed microseconds and error of every call after the warm-ups, and the answer to the last warm-up."""
    walked: list[tuple[int, float | None, str | None]] = []
    answer = None
    try:
        predictor = stage.open()
        for _ in range(WARM_UPS):
            answer = _call(predictor, example, stage.batch_size, stage.name)
        best = None
        for size in sizes:
            inputs = list(islice(cycle(example), size))
            begun = clock(predictor)
            _call(predictor, inputs, size, stage.name)
            elapsed = clock(predictor) - begun
            walked.append((size, elapsed, None))
            if best is not None and elapsed / size >= best:
                break
            best = elapsed / size
    except ContractError:
        raise
    except Exception as error:
        walked.append((sizes[len(walked)] if len(walked) < len(sizes) else sizes[-1], None, str(error)))
        return walked, None
    return walked, answer


def _text(value: Any) -> str:
    return json.dumps(value, default=str, ensure_ascii=False)


def _measure(
    batches: Iterator[pa.RecordBatch], stages: list[tuple[int, Stage]], sizes: Sequence[int], clock: Clock, keys: list[str]
) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, row in enumerate(batch.to_pylist()):
            found = []
            example = row["_example"]
            for number, stage in stages:
                if not example:
                    found.append((row["_run"], number, stage.name, None, None, None, None, "the example is empty"))
                    break
                walked, answer = walk_sizes(stage, example, sizes, clock)
                output = None if answer is None else _text(answer)
                for size, elapsed, error in walked:
                    each = None if elapsed is None else elapsed / size
                    found.append((row["_run"], number, stage.name, size, elapsed, each, output, error))
                if answer is None:
                    break
                example = answer
            columns = [pa.array(c, t) for c, t in zip(zip(*found), _ARROW_TYPES)]
            own = batch.slice(at, 1).select(keys).take(pa.array([0] * len(found)))
            yield pa.RecordBatch.from_arrays([*own.columns, *columns], [*keys, *_FIELDS])


def calibrate(
    examples: DataFrame,
    stages: Sequence[Stage],
    keys: Sequence[str] = ("queue_key",),
    inputs: str = "inputs",
    sizes: Sequence[int] = SIZES,
    runs: int = 1,
    clock: Clock = wall_clock,
) -> DataFrame:
    """Measure ``stages`` on every row of ``examples`` (``keys`` tell them apart): a row per run, stage and batch size, with
    microseconds in all and per example, and the answer to the example as JSON.

    Stages are functions; expressions take no batches and are not measured. ``clock(predictor)`` gives microseconds.
    """
    if any(stage.expression is not None for stage in stages):
        raise ValueError("expression stages run in the JVM and have no batch size to measure")
    keys = list(keys)
    spread = examples.select(
        *keys, F.col(inputs).alias("_example"), F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("_run")
    )
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in examples.select(*keys).schema.fields)
    return spread.repartition(*keys, "_run").mapInArrow(
        partial(_measure, stages=_numbered(stages), sizes=tuple(sizes), clock=clock, keys=keys), f"{schema}, {MEASURED}"
    )


def tuned_stages(measured: DataFrame, keys: Sequence[str] = ("queue_key",)) -> DataFrame:
    """Batch size and time per example (milliseconds) of every stage, over all runs of it.

    Runs may have stopped at different sizes; a size counts with the average of those that tried it.
    """
    own = [*keys, "stage"]
    averages = measured.filter("elapsed_us is not null").groupBy(*own, "batch_size").agg(
        (F.avg("elapsed_us") / 1000 / F.col("batch_size")).alias("time_per_example")
    )
    return choose_batch_size(averages, key=own)


def measured_registry(measured: DataFrame, keys: Sequence[str] = ("queue_key",)) -> DataFrame:
    """One row per stage: name, sequence, batch size, time per example, wait, example output and status."""
    own = [*keys, "stage"]
    stages = measured.groupBy(*own).agg(
        F.min("stage_name").alias("predictor_name"),
        F.min_by("example_output", "run").alias("example_output"),
        F.bool_or(F.col("error").isNotNull()).alias("_failed"),
    )
    registry = stage_registry(stages, tuned_stages(measured, keys), key=own)
    return (
        registry.withColumn("status", F.when(F.col("_failed"), "failed").otherwise(F.col("status")))
        .withColumnRenamed("stage", "predictor_sequence")
        .drop("_failed")
    )
