"""Sliding-window service metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def metrics_stream(
    log: DataFrame, window_seconds: int, slide_seconds: int, delay_seconds: int
) -> DataFrame:
    """Counters of the last ``window_seconds``, every ``slide_seconds``.

    ``log`` has a timestamp ``event_time`` with a row per thing that happened: ``kind`` is
    ``received`` or ``processed``, next to the request's ``success`` and ``timed_out``. With ``delivered``,
    ``waited_us`` and ``ran_us`` (see :func:`request_moments`) all ten metrics come out, else the first six. Windows
    are pre-aggregated before their shuffle and emitted once the watermark has passed them; those that it has
    not passed when a stream ends stay inside.
    """
    window = F.window(
        "event_time", f"{window_seconds} seconds", f"{slide_seconds} seconds"
    )
    received = F.col("kind") == "received"
    processed = F.col("kind") == "processed"
    failed = F.col("success").eqNullSafe(False)
    timed_out = F.col("timed_out").eqNullSafe(True)
    full = {"delivered", "waited_us", "ran_us"} <= set(log.columns)
    more = [column.alias(name) for name, column in _of_received().items()] if full else []
    return (
        log.withWatermark("event_time", f"{delay_seconds} seconds")
        .groupBy(window)
        .agg(
            F.count_if(received).alias("requests_received"),
            F.count_if(processed).alias("requests_processed"),
            F.count_if(received & failed).alias("received_that_failed"),
            F.count_if(processed & failed).alias("processed_that_failed"),
            F.count_if(processed & timed_out).alias("number_of_requests_timedout"),
            F.count_if(
                processed & F.col("success").eqNullSafe(True) & ~timed_out
            ).alias("processed_that_are_successful"),
            *more,
        )
        .select(
            F.unix_micros("window.start").alias("window_start_us"),
            F.unix_micros("window.end").alias("window_end_us"),
            "requests_received",
            "requests_processed",
            "received_that_failed",
            "processed_that_failed",
            "number_of_requests_timedout",
            "processed_that_are_successful",
            *(_of_received() if full else {}),
        )
    )


def _of_received() -> dict[str, Column]:
    """Metrics of the requests that came in during the window, by how they stand now."""
    received = F.col("kind") == "received"
    answered = received & F.col("delivered") & ~F.col("timed_out").eqNullSafe(True)
    successful = F.count_if(answered & F.col("success").eqNullSafe(True))

    def average(us: str) -> Column:
        seconds = F.sum(F.when(answered, F.col(us))).cast("double") / 1_000_000
        return F.when(seconds.isNull(), F.lit(0.0)).otherwise(F.try_divide(seconds, successful))

    return {
        "received_that_are_pending": F.count_if(
            received & ~F.col("delivered") & ~F.col("success").eqNullSafe(False)
        ),
        "received_that_are_successful": successful,
        "avg_total_time": average("waited_us"),
        "avg_actual_total_time": average("ran_us"),
    }


def request_moments(log: DataFrame) -> DataFrame:
    """The request log as moments: one row when a request came in, one when it was answered.

    Both say whether it is ``delivered`` and, if the log has the times, how long it ``waited_us`` and ``ran_us``.
    """
    moments = F.array(
        F.struct(F.lit("received").alias("kind"), F.col("received_us").alias("at_us")),
        F.struct(F.lit("processed").alias("kind"), F.col("delivered_us").alias("at_us")),
    )
    kept = [name for name in ("success", "timed_out") if name in log.columns]
    took = {"delivered": F.col("delivered_us").isNotNull(), "waited_us": F.col("delivered_us") - F.col("received_us")}
    if {"stage0_predicted_us", "stage0_received_us"} <= set(log.columns):
        took["ran_us"] = F.col("stage0_predicted_us") - F.col("stage0_received_us")
    kept = [*kept, *took]
    return (
        log.withColumns(took).select(*kept, F.inline(moments))
        .filter(F.col("at_us").isNotNull())
        .select(*kept, "kind", F.timestamp_micros("at_us").alias("event_time"))
    )
