"""Feeds of requests whose triggers are bounded in *inputs*, and a sink that a repeated epoch does not double.

Spark's file source bounds a trigger by files or bytes, while a model's memory and time go by inputs. ``write_feed`` lays
requests down so that a file holds at most ``max_inputs`` inputs, in order of arrival; the file source then takes one file
per trigger, with Spark's own offsets and commits. ``write_epochs`` writes every epoch into a folder of its own and
replaces that folder when the epoch is run again, which is what Spark does after a failure.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from queuemill.operators.ordering import ordered_segments
from queuemill.session import scratch_path, shuffle_partitions


def chunked(
    df: DataFrame, max_inputs: int, order: Sequence[str] = ("received_us", "request_id"), size: str = "n_inputs"
) -> DataFrame:
    """Add ``chunk``: consecutive requests in ``order`` whose inputs are at most ``max_inputs`` together.

    Requests of more than half of ``max_inputs`` make chunks of their own, the others fill theirs at least half (but for
    the last one). A request of more than ``max_inputs`` cannot be kept within the bound and is alone in its chunk. A NULL
    size counts as none. Sums run over segments of the order, so no task holds more than its share.
    """
    inputs = F.coalesce(F.col(size), F.lit(0)).cast("bigint")
    large = inputs > max_inputs // 2
    step = max_inputs - max_inputs // 2 + 1  # a chunk begins within a step, and its last request is at most a half
    marked = df.withColumns({"_small": F.when(large, 0).otherwise(inputs), "_large": large.cast("bigint")})
    ordered = ordered_segments(marked, list(order), shuffle_partitions(df.sparkSession))
    sums = ordered.groupBy("segment").agg(F.sum("_small").alias("_s"), F.sum("_large").alias("_l"))
    before = W.orderBy("segment").rowsBetween(W.unboundedPreceding, -1)  # one row per segment
    bases = sums.select(
        "segment",
        F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0"),
        F.coalesce(F.sum("_l").over(before), F.lit(0)).alias("_l0"),
    )
    inside = W.partitionBy("segment").orderBy("segment_row").rowsBetween(W.unboundedPreceding, -1)
    small_before = F.coalesce(F.sum("_small").over(inside), F.lit(0)) + F.col("_s0")
    large_before = F.coalesce(F.sum("_large").over(inside), F.lit(0)) + F.col("_l0")
    number = F.when(F.col("_large") == 1, -1 - large_before).otherwise(F.floor(small_before / step))
    found = ordered.join(F.broadcast(bases), "segment").withColumn("chunk", number.cast("bigint"))
    return found.select(*df.columns, "chunk")


def write_feed(
    df: DataFrame, path: str, max_inputs: int, order: Sequence[str] = ("received_us", "request_id"), size: str = "n_inputs"
) -> None:
    """Append ``df`` to the feed at ``path``: one file per chunk."""
    chunks = chunked(df, max_inputs, order, size)
    writer = chunks.repartition("chunk").sortWithinPartitions("chunk", *order).write.mode("append")
    writer.partitionBy("chunk").parquet(path)


def read_feed(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The feed as a stream, one file (at most ``max_inputs`` inputs) per trigger; ``schema`` is that of the requests."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path).drop("chunk")


def write_epochs(stream: DataFrame, path: str, checkpoint: str | None = None) -> DataStreamWriter:
    """A writer of ``path/epoch=<id>``; a repeated epoch replaces what its first run wrote."""
    writer = stream.writeStream.outputMode("append").foreachBatch(epoch_sink(path))
    return writer.option("checkpointLocation", checkpoint or scratch_path(stream.sparkSession, "epochs-progress"))


def epoch_sink(path: str) -> Callable[[DataFrame, int], None]:
    def write(rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def read_epochs(spark: SparkSession, path: str) -> DataFrame:
    """All epochs that were written, with their number as ``epoch``."""
    return spark.read.parquet(path)
