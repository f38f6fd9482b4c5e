"""Service metrics over the last x seconds, all from one scan of the request table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queuemill.functions.match import match
from queuemill.functions.scalars import MICROS
from queuemill.operators.table import count_where

DEFAULT_SECONDS = 30

# Metric names and help texts, in the order of the exposition text.
METRICS = [
    ("requests_received_in_last_x_seconds",
     "The number of requests received in last {x} seconds."),
    ("requests_processed_in_last_x_seconds",
     "The number of requests processed in last {x} seconds."),
    ("number_of_requests_timedout_in_last_x_seconds",
     "The number of requests timedout at predictor(s) in last {x} seconds."),
    ("requests_received_in_last_x_seconds_that_failed",
     "The number of requests received in last {x} seconds that failed."),
    ("requests_processed_in_last_x_seconds_that_failed",
     "The number of requests processed in last {x} seconds that failed."),
    ("requests_received_in_last_x_seconds_that_are_pending",
     "The number of requests received in last {x} seconds that are pending."),
    ("requests_received_in_last_x_seconds_that_are_successful",
     "The number of requests received in last {x} seconds that are successful."),
    ("requests_processed_in_last_x_seconds_that_are_successful",
     "The number of requests processed in last {x} seconds that are successful."),
    ("avg_total_time_per_req_for_reqs_in_last_x_seconds",
     "The average total time per request for requests in last {x} seconds."),
    ("avg_actual_total_time_per_req_for_reqs_in_last_x_seconds",
     "The average actual total time per request for requests in last {x} seconds."),
]


def _sum_seconds(end: str, start: str, query: dict) -> Column:
    """Seconds between two stamps over matching rows; differences, so that no sum overflows."""
    return F.sum(F.when(match(query), (F.col(end) - F.col(start)).cast("double") / MICROS))


def metric_columns(as_of_us: int, seconds: float = DEFAULT_SECONDS) -> dict[str, Column]:
    """The aggregate columns; the window is open at both ends."""
    within = {"$gt": as_of_us - int(seconds * MICROS), "$lt": as_of_us}
    received, delivered = {"received_us": within}, {"delivered_us": within}
    not_timed_out = {"timed_out": {"$ne": True}}
    answered = {**received, **not_timed_out, "delivered_us": {"$ne": None}}
    successful = count_where({**answered, "success": True})

    def average(end: str, start: str) -> Column:
        total = _sum_seconds(end, start, answered)
        return F.when(total.isNull(), F.lit(0.0)).otherwise(F.try_divide(total, successful))

    values = [
        count_where(received),
        count_where(delivered),
        count_where({**delivered, "timed_out": True}),
        count_where({**received, "success": False}),
        count_where({**delivered, "success": False}),
        count_where({**received, "delivered_us": None, "success": {"$ne": False}}),
        successful,
        count_where({**delivered, **not_timed_out, "success": True}),
        average("delivered_us", "received_us"),
        average("stage0_predicted_us", "stage0_received_us"),
    ]
    return {name: value for (name, _), value in zip(METRICS, values)}


def window_metrics_by(
    df: DataFrame,
    keys: Sequence[str],
    as_of_us: int,
    seconds: float = DEFAULT_SECONDS,
    only: Sequence[str] | None = None,
) -> DataFrame:
    """The metrics per group of ``keys`` (none: one row), aggregated before any shuffle."""
    columns = metric_columns(as_of_us, seconds)
    wanted = [columns[name].alias(name) for name in (only or columns)]
    return df.groupBy(*keys).agg(*wanted)


def window_metrics(
    df: DataFrame, as_of_us: int, seconds: float = DEFAULT_SECONDS,
    only: Sequence[str] | None = None,
) -> DataFrame:
    """The metrics in one row. Requests that the window does not touch are skipped by the scan."""
    within = {"$gt": as_of_us - int(seconds * MICROS), "$lt": as_of_us}
    touched = match({"received_us": within}) | match({"delivered_us": within})
    return window_metrics_by(df.filter(touched), [], as_of_us, seconds, only)


def metric_rows(metrics: DataFrame, seconds: float = DEFAULT_SECONDS) -> DataFrame:
    """One wide row of metrics as rows (seq, name, help, type, value)."""
    rows = [
        F.struct(
            F.lit(seq).alias("seq"),
            F.lit(name).alias("name"),
            F.lit(text.format(x=f"{seconds:g}" if seconds < 1e6 else str(int(seconds)))).alias("help"),
            F.lit("gauge").alias("type"),
            F.col(name).cast("double").alias("value"),
        )
        for seq, (name, text) in enumerate(METRICS)
        if name in metrics.columns
    ]
    return metrics.select(F.inline(F.array(*rows)))


def register_metric(
    hook: Callable[[DataFrame], DataFrame],
) -> Callable[[DataFrame], DataFrame]:
    """A user hook ``df -> DataFrame(name, type, help, value)`` as a source of extra metric rows."""

    def rows(df: DataFrame) -> DataFrame:
        return hook(df).select(
            F.lit(len(METRICS)).alias("seq"),
            "name",
            "help",
            "type",
            F.col("value").cast("double").alias("value"),
        )

    return rows


def with_extra_metrics(metrics: DataFrame, extra: DataFrame) -> DataFrame:
    return metrics.unionByName(extra)


def utilisation(log: DataFrame, as_of_us: int, keys: Sequence[str] = ()) -> DataFrame:
    """Hours spent in batches, and hours since the first batch began."""
    hours = 3600.0 * MICROS
    return log.groupBy(*keys).agg(
        F.sum((F.col("ended_us") - F.col("started_us")).cast("double") / hours).alias(
            "total_predictor_run_for_hours"
        ),
        ((F.lit(as_of_us) - F.min("started_us")).cast("double") / hours).alias(
            "total_predictor_up_for_hours"
        ),
    )
