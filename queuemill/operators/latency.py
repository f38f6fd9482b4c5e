"""Benchmark report: latencies, throughput and errors of recorded calls.

A call row is ``connection_id, seq, latency_ms, success, error, is_warmup``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from queuemill.operators.ordering import global_index

# The percentiles of the report and how many errors it lists.
PERCENTILES = (0.5, 0.9, 0.95, 0.99)
LISTED_ERRORS = 10


def exclude_warmup(calls: DataFrame) -> DataFrame:
    return calls.filter(~F.coalesce(F.col("is_warmup"), F.lit(False)))


def _ok_latency() -> Column:
    return F.when(F.col("success"), F.col("latency_ms"))


def _stat_columns() -> list[Column]:
    latency = _ok_latency()
    return [
        F.avg(latency).alias("average_latency_ms"),
        F.stddev_pop(latency).alias("std_latency_ms"),
        F.min(latency).alias("min_latency_ms"),
        F.max(latency).alias("max_latency_ms"),
    ]


def latency_stats(calls: DataFrame) -> DataFrame:
    """Mean, population deviation, least and greatest latency of the successful calls.

    No row at all if no call succeeded.
    """
    return calls.agg(*_stat_columns()).filter(F.col("average_latency_ms").isNotNull())


def _percentile_name(p: float) -> str:
    return f"p{p * 100:g}_latency_ms"


def latency_percentiles(
    calls: DataFrame,
    percentiles: Sequence[float] = PERCENTILES,
    segments: int | None = None,
) -> DataFrame:
    """Exact percentiles of the successful calls, linear between neighbours; no row without any.

    The latencies are sorted across the cluster, and only the neighbours of each rank are read.
    """
    ok = calls.filter("success and latency_ms is not null")
    order = ["latency_ms", "connection_id", "seq"]
    ranked = global_index(ok.select(*order), order, "rank", segments, total="calls")

    def at(rank: Column) -> Column:
        return F.max(F.when(F.col("rank") == rank, F.col("latency_ms")))

    def between(p: float) -> Column:
        rank = p * (F.col("calls") - 1)
        part = F.max(rank - F.floor(rank))
        return at(F.floor(rank)) + (at(F.ceil(rank)) - at(F.floor(rank))) * part

    wanted = [between(p).alias(_percentile_name(p)) for p in percentiles]
    return ranked.agg(*wanted).filter(F.col(_percentile_name(percentiles[0])).isNotNull())


def _throughput_columns(duration_seconds: float) -> list[Column]:
    total = F.count(F.lit(1))
    ok = F.count_if("success")
    return [
        total.alias("total_requests"),
        ok.alias("successes"),
        (total - ok).alias("failures"),
        F.coalesce(F.try_divide(ok * F.lit(100.0), total), F.lit(0.0)).alias("success_rate"),
        (total / F.lit(float(duration_seconds))).alias("actual_rps"),
    ]


def throughput(
    calls: DataFrame,
    duration_seconds: float,
    target_rps_per_connection: float | None = None,
    parallel_connections: int = 1,
) -> DataFrame:
    """Totals over the configured duration."""
    target = float((target_rps_per_connection or 0) * parallel_connections)
    return calls.agg(*_throughput_columns(duration_seconds), F.lit(target).alias("total_target_rps"))


def per_connection(calls: DataFrame, duration_seconds: float) -> DataFrame:
    """The same per connection; 0 as average latency where no call succeeded."""
    average = F.coalesce(F.avg(_ok_latency()), F.lit(0.0)).alias("average_latency_ms")
    return calls.groupBy("connection_id").agg(*_throughput_columns(duration_seconds), average)


def error_count(calls: DataFrame) -> DataFrame:
    return calls.agg(F.count_if(~F.col("success")).alias("error_count"))


def first_errors(calls: DataFrame, n: int = LISTED_ERRORS) -> DataFrame:
    """The first ``n`` errors by connection and call; only these ``n`` rows are ever ranked."""
    first = (
        calls.filter(~F.col("success"))
        .select("connection_id", "seq", "error")
        .orderBy("connection_id", "seq")
        .limit(n)
    )
    return first.withColumn("rank", F.row_number().over(W.orderBy("connection_id", "seq")))


def benchmark_report(
    calls: DataFrame,
    duration_seconds: float,
    target_rps_per_connection: float | None = None,
    parallel_connections: int = 1,
) -> DataFrame:
    """Totals, latency statistics, percentiles and error count in one row (none without success)."""
    counted = exclude_warmup(calls)
    marks = latency_percentiles(counted).first()
    report = counted.agg(
        *_throughput_columns(duration_seconds),
        *_stat_columns(),
        F.count_if(~F.col("success")).alias("error_count"),
    ).filter(F.col("successes") > 0)
    if marks is not None:
        report = report.withColumns({name: F.lit(v) for name, v in marks.asDict().items()})
    target = float((target_rps_per_connection or 0) * parallel_connections)
    return report.withColumns(
        {
            "total_target_rps": F.lit(target),
            "parallel_connections": F.lit(parallel_connections),
            "duration_seconds": F.lit(float(duration_seconds)),
        }
    )
