"""Start streams with the settings the operators need, and run finite ones to their end."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from queuemill.session import SESSION_SETTINGS, scratch_path

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ARROW_RECORDS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def use_rocksdb(spark: SparkSession) -> None:
    """Keep state in RocksDB: outside the heap, and what timers and typed state need."""
    spark.conf.set(STATE_STORE, SESSION_SETTINGS[STATE_STORE])


def dropped_as_late(query: StreamingQuery) -> int:
    """Rows the state operators dropped because the watermark had passed them."""
    return sum(
        operator.numRowsDroppedByWatermark
        for progress in query.recentProgress
        for operator in progress.stateOperators
    )


def run_available(stream: DataFrame, label: str) -> DataFrame:
    """Process all input that is there now into a Parquet table and return that table.

    Output and progress go to the shared checkpoint folder, never through the driver.
    """
    spark = stream.sparkSession
    use_rocksdb(spark)
    out, progress = scratch_path(spark, label), scratch_path(spark, f"{label}-progress")
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def bounded_trigger(
    stream: DataFrame, max_wait_seconds: float, checkpoint: str | None = None
) -> DataStreamWriter:
    """A writer that waits ``max_wait_seconds`` at most for more input.

    How much one trigger takes in is set at the source (``maxFilesPerTrigger``); how many inputs a model gets at a time,
    by the stage's own batch size. A stream takes the session's settings when it starts: wrap
    ``start()`` in :func:`rows_per_batch` to set how many requests go to Python at a time, or use :func:`run_bounded`.
    """
    spark = stream.sparkSession
    writer = stream.writeStream.outputMode("append").trigger(
        processingTime=f"{max(1, round(max_wait_seconds * 1000))} milliseconds"
    )
    return writer.option(
        "checkpointLocation", checkpoint or scratch_path(spark, "bounded-progress")
    )


@contextmanager
def rows_per_batch(spark: SparkSession, rows: int) -> Iterator[None]:
    """Streams started inside hand ``rows`` rows at a time to Python; the session keeps its own setting."""
    before = spark.conf.get(ARROW_RECORDS)
    spark.conf.set(ARROW_RECORDS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(ARROW_RECORDS, before)


def run_bounded(
    stream: DataFrame, label: str, batch_size: int, max_wait_seconds: float
) -> DataFrame:
    """Run a stream under :func:`bounded_trigger` until it has caught up; return its table."""
    spark = stream.sparkSession
    out = scratch_path(spark, label)
    with rows_per_batch(spark, batch_size):
        writer = bounded_trigger(stream, max_wait_seconds)
        query = writer.format("parquet").option("path", out).start()
    query.processAllAvailable()
    query.stop()
    return spark.read.schema(stream.schema).parquet(out)
