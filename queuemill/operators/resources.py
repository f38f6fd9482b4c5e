"""CPU, memory and GPU statistics of process groups.

A sample row is ``role, ts, pid, cpu, ram_kb`` (``ts`` in seconds), a GPU row ``ts, pid, util, mem``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Samples kept for the rolling statistics, and how many seconds of ticks (of one second
# at least) go into one window task.
HISTORY = 5
BUCKET_SECONDS = 100_000


def sum_by_role(samples: DataFrame) -> DataFrame:
    """CPU and resident memory (MB) of a group's processes at each tick."""
    return samples.groupBy("role", "ts").agg(
        F.sum("cpu").alias("cpu"), (F.sum("ram_kb") / F.lit(1024.0)).alias("ram_mb")
    )


def with_gpu(samples: DataFrame, gpu: DataFrame) -> DataFrame:
    """GPU utilisation and memory by process and tick, 0 where none was seen.

    A process on several devices is reduced to its greatest reading first, so the join adds no rows.
    """
    reading = gpu.groupBy("ts", "pid").agg(
        F.max("util").alias("gpu_util"), F.max("mem").alias("gpu_mem")
    )
    zero = F.lit(0)
    return samples.join(reading, ["ts", "pid"], "left").withColumns(
        {
            "gpu_util": F.coalesce("gpu_util", zero),
            "gpu_mem": F.coalesce("gpu_mem", zero),
        }
    )


def rolling_stats(
    ticks: DataFrame,
    values: Sequence[str],
    n: int = HISTORY,
    role: str = "role",
    bucket_seconds: int = BUCKET_SECONDS,
) -> DataFrame:
    """Least, greatest and mean value over the last ``n`` samples of each series.

    There are few roles and endless ticks, so a window per role would be one ever-growing task. The
    series is cut into time buckets; each bucket also gets the last ``n - 1`` samples before it, found
    among the last ``n - 1`` samples of every bucket, and drops them once the window is done.
    """
    columns = ticks.columns
    series = ticks.withColumn("_bucket", F.floor(F.col("ts") / bucket_seconds))
    tail_order = W.partitionBy(role, "_bucket").orderBy(F.desc("ts"))
    tails = series.withColumn("_from_end", F.row_number().over(tail_order)).filter(
        F.col("_from_end") < n
    )
    along = W.partitionBy(role).orderBy("ts")  # n - 1 rows per bucket
    following = tails.withColumn(
        "_following", F.array(*[F.lead("_bucket", k).over(along) for k in range(1, n)])
    )
    later = F.array_distinct(F.filter("_following", lambda b: b > F.col("_bucket")))
    carried = following.withColumn("_later", later).select(
        *columns, F.explode("_later").alias("_bucket"), F.lit(True).alias("_carried")
    )
    rows = series.withColumn("_carried", F.lit(False)).unionByName(carried)
    last_n = W.partitionBy(role, "_bucket").orderBy("ts").rowsBetween(-(n - 1), 0)
    stats = {}
    for value in values:
        stats[f"{value}_min"] = F.min(value).over(last_n)
        stats[f"{value}_max"] = F.max(value).over(last_n)
        stats[f"{value}_avg"] = F.avg(value).over(last_n)
    return rows.withColumns(stats).filter(~F.col("_carried")).select(*columns, *stats)


def latest_by_role(samples: DataFrame, values: Sequence[str], rolled: DataFrame) -> DataFrame:
    """Per role the newest tick: ``n_pids``, the sorted ``pids``, ``current`` numbers and their rolling ``stats``.

    The ids in one row are those of one tick, so there are no more of them than a kernel gives out, 2**22.
    """
    parts = [
        F.struct(
            F.col(f"{v}_min").alias("min"), F.col(f"{v}_max").alias("max"),
            F.col(f"{v}_avg").alias("avg"),
        ).alias(v)
        for v in values
    ]
    newest = rolled.groupBy("role").agg(
        F.max_by(
            F.struct("ts", F.struct(*values).alias("current"), F.struct(*parts).alias("stats")),
            "ts",
        ).alias("_last")
    )
    counted = running_pids(samples).groupBy("role").agg(
        F.count(F.lit(1)).alias("n_pids"), F.sort_array(F.collect_list("pid")).alias("pids")
    )
    return newest.select(
        "role", "_last.ts", F.col("_last.current").alias("current"), F.col("_last.stats").alias("stats")
    ).join(counted, "role")


def running_pids(samples: DataFrame) -> DataFrame:
    """The processes seen at each role's newest tick, one row each.

    Samples shrink to one row per process before anything is joined.
    """
    last_seen = samples.groupBy("role", "pid").agg(F.max("ts").alias("ts"))
    newest = last_seen.groupBy("role").agg(F.max("ts").alias("ts"))
    return last_seen.join(newest, ["role", "ts"]).select("role", "ts", "pid")
