"""Writers: response tables, metric text, JSON reports and resource snapshots."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_responses(df: DataFrame, path: str, compressed: bool = False, mode: str = "error") -> None:
    """Response table as Parquet; ``compressed`` asks for zstd pages instead of plain ones."""
    codec = "zstd" if compressed else "none"
    df.write.mode(mode).option("compression", codec).parquet(path)


def prometheus_block(metrics: DataFrame) -> DataFrame:
    """Metric rows (name, help, type, value) with ``text``: the HELP, TYPE and value lines."""
    return metrics.withColumn(
        "text",
        F.concat_ws(
            "\n",
            F.concat(F.lit("# HELP "), "name", F.lit(" "), "help"),
            F.concat(F.lit("# TYPE "), "name", F.lit(" "), "type"),
            F.concat(F.col("name"), F.lit(" "), _metric_number(F.col("value"))),
        ),
    )


def _metric_number(value: Column) -> Column:
    """Whole numbers without a fraction, others as they are; an unknown value is NaN."""
    return (
        F.when(value.isNull(), F.lit("NaN"))
        .when(value == F.floor(value), value.cast("bigint").cast("string"))
        .otherwise(value.cast("string"))
    )


def to_prometheus_text(metrics: DataFrame) -> DataFrame:
    """The whole exposition text as one row; one block per metric, a blank line between two.

    The rows met here are metric *definitions* (ten built-in ones and the user's), not data.
    """
    ordered = F.array_sort(F.collect_list(F.struct("seq", "text")))
    return prometheus_block(metrics).agg(
        F.array_join(F.transform(ordered, lambda row: row["text"]), "\n\n").alias("text")
    )


def write_prometheus_text(metrics: DataFrame, path: str, mode: str = "error") -> None:
    to_prometheus_text(metrics).write.mode(mode).text(path)


def report_json(report: DataFrame, per_connection: DataFrame) -> DataFrame:
    """Benchmark report as JSON lines: one ``overall`` record, then one per connection.

    Connections stay separate records, so a report over very many of them never becomes one row.
    """
    overall = report.select(
        F.lit("overall").alias("kind"),
        F.lit(None).cast("string").alias("connection_id"),
        F.to_json(F.struct(*report.columns)).alias("json"),
    )
    fields = [name for name in per_connection.columns if name != "connection_id"]
    connections = per_connection.select(
        F.lit("connection").alias("kind"),
        F.col("connection_id").cast("string").alias("connection_id"),
        F.to_json(F.struct(*fields)).alias("json"),
    )
    return overall.unionByName(connections)


def write_report_json(
    report: DataFrame, per_connection: DataFrame, path: str, mode: str = "error"
) -> None:
    report_json(report, per_connection).select(
        F.to_json(
            F.struct("kind", "connection_id", F.expr("parse_json(json)").alias("stats"))
        ).alias("value")
    ).write.mode(mode).text(path)


def resource_snapshot_json(
    latest: DataFrame, groups: dict[str, str], timestamp: Column, single: Collection[str] = ()
) -> DataFrame:
    """One JSON document over the given process groups; an absent group is ``not_running``.

    ``latest`` has at most one row per role with ``n_pids``, ``pids`` and the structs ``current`` and
    ``stats`` (see :func:`queuemill.operators.resources.latest_by_role`); ``groups`` maps a role to
    its name in the document. A group lists its process ids in ``pids``; one of the roles in ``single`` is run as one
    process and has ``pid``, the smallest, instead. The document holds the ids of one tick, 2**22 a role at most.
    """
    fields = ("n_pids", "pids", "current", "stats")
    found = latest.agg(
        *[
            F.max_by(
                F.when(F.col("role") == role, F.struct(*fields)),
                F.when(F.col("role") == role, F.lit(1)),
            ).alias(name)
            for role, name in groups.items()
        ]
    )

    def ids(role: str, name: str) -> Column:
        pids = F.col(f"{name}.pids")
        return F.get(pids, 0).alias("pid") if role in single else pids.alias("pids")

    parts = [
        F.struct(
            F.col(f"{name}.n_pids").alias("n_pids"),
            ids(role, name),
            F.when(F.col(name).isNull(), "not_running").otherwise("running").alias("status"),
            F.col(f"{name}.current").alias("current"),
            F.col(f"{name}.stats").alias("stats"),
        ).alias(name)
        for role, name in groups.items()
    ]
    return found.select(
        F.to_json(F.struct(timestamp.alias("timestamp"), *parts)).alias("json")
    )
