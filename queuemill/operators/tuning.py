"""Choosing a batch size from recorded batch durations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def time_per_example(
    log: DataFrame, key: str = "queue_key", size: str = "batch_size", elapsed: str = "ms"
) -> DataFrame:
    """Mean elapsed time of a batch divided by its size, per key and size."""
    return log.groupBy(key, size).agg((F.avg(elapsed) / F.col(size)).alias("time_per_example"))


def choose_batch_size(
    measured: DataFrame, key: str | list[str] = "queue_key", size: str = "batch_size"
) -> DataFrame:
    """Walk the sizes upward while each beats the one before; stop at the first that does not.

    One row per key (a column or several) and size comes in, so a window holds the sizes that were tried.
    """
    upward = W.partitionBy(key).orderBy(size)
    slower = F.coalesce(
        F.col("time_per_example") >= F.lag("time_per_example").over(upward), F.lit(False)
    )
    walked = measured.withColumn("_slower", slower.cast("int")).withColumn(
        "_stopped", F.sum("_slower").over(upward)
    )
    return (
        walked.filter(F.col("_stopped") == 0)
        .groupBy(key)
        .agg(
            F.max(size).alias("optimal_batch_size"),
            F.min("time_per_example").alias("time_per_example"),
        )
    )
