"""Life of a request in the queue: claims, time-outs, results and retention.

Times are epoch microseconds; ``as_of_us`` stands for "now". NULL ``delivered_us`` means not delivered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from queuemill.functions.match import match, no_match
from queuemill.functions.scalars import MICROS
from queuemill.operators.table import search_update, upsert
from queuemill.operators.validation import status_of
from queuemill.session import shuffle_partitions

# Seconds.
CLIENT_TIMEOUT_SECONDS = 480
RETENTION_SECONDS = 40

PRUNED_RANK = 1_000  # up to here Spark prunes ranks before the shuffle


def _eligible_query(stage: int) -> dict:
    return {
        "delivered_us": None,
        "success": True,
        "last_stage": stage - 1,
        "timed_out": {"$ne": True},
    }


def eligible(df: DataFrame, stage: int) -> DataFrame:
    """Requests that ``stage`` may pick up."""
    return df.filter(match(_eligible_query(stage)))


def claim(
    df: DataFrame, stage: int, n: int, as_of_us: Column | int, key: str = "queue_key"
) -> DataFrame:
    """The first ``n`` eligible requests per queue, marked as taken by ``stage``.

    Only the claimed rows come back (write them with :func:`queuemill.operators.table.upsert`).
    Rank and limit sit next to each other, so for ``n`` up to 1,000 Spark keeps at most ``n`` rows per key and
    partition before the shuffle, however full one queue is. For more, queues are dealt over all tasks
    first and each share gives its first ``n``.
    """
    order = ("received_us", "request_id")
    fifo = W.partitionBy(key).orderBy(*order)
    waiting = eligible(df, stage)
    if n > PRUNED_RANK:
        shares = shuffle_partitions(df.sparkSession)
        share = W.partitionBy(key, F.pmod(F.xxhash64("request_id"), F.lit(shares))).orderBy(*order)
        ranked = waiting.withColumn("_share_rank", F.row_number().over(share))
        waiting = ranked.filter(F.col("_share_rank") <= n).drop("_share_rank")
    first = (
        waiting.withColumn("fifo_rank", F.row_number().over(fifo))
        .filter(F.col("fifo_rank") <= n)
    )
    return first.withColumns(
        {
            "last_stage": F.lit(stage),
            "success": F.lit(None).cast("boolean"),
            f"stage{stage}_received_us": F.lit(as_of_us) if isinstance(as_of_us, int) else as_of_us,
        }
    )


def flag_queue_timeouts(
    df: DataFrame, as_of_us: int, timeout_seconds: float, last_stage: int
) -> DataFrame:
    """Mark undelivered requests that have waited too long before the last stage took them."""
    waited_too_long = {
        "delivered_us": None,
        "received_us": {"$lt": as_of_us - int(timeout_seconds * MICROS)},
        "timed_out": {"$ne": True},
        "last_stage": {"$ne": last_stage},
    }
    return search_update(df, waited_too_long, {"timed_out": True})


def flag_client_timeouts(
    df: DataFrame,
    as_of_us: int,
    timeout: str = "timeout",
    default_seconds: float = CLIENT_TIMEOUT_SECONDS,
) -> DataFrame:
    """Clients stop waiting after their own time-out: the request counts as delivered and timed out."""
    allowed = (F.coalesce(F.col(timeout), F.lit(default_seconds)) * MICROS).cast("bigint")
    expired = F.coalesce(
        F.col("delivered_us").isNull() & (F.lit(as_of_us) - F.col("received_us") > allowed),
        F.lit(False),
    )
    return df.withColumns(
        {
            "client_timed_out": expired,
            "timed_out": F.when(expired, F.lit(True)).otherwise(F.col("timed_out")),
            "delivered_us": F.when(expired, F.lit(as_of_us)).otherwise(F.col("delivered_us")),
        }
    )


def purge_delivered(
    df: DataFrame, as_of_us: int, keep_seconds: float = RETENTION_SECONDS
) -> DataFrame:
    """Drop requests that were delivered more than ``keep_seconds`` ago."""
    gone = {"delivered_us": {"$gt": 0, "$lt": as_of_us - int(keep_seconds * MICROS)}}
    return df.filter(no_match(gone))


def apply_results(df: DataFrame, results: DataFrame, version: Column) -> DataFrame:
    """Write stage answers, times, batch size and success back to the request table.

    ``version`` says which of several results for one request counts, such as when it was predicted.
    """
    return upsert(df, results, version)


def mark_delivered(df: DataFrame, last_stage: int, as_of_us: int) -> DataFrame:
    """Requests that now have an answer (a result, a failure or a time-out) count as delivered."""
    answered = F.col("delivered_us").isNull() & (status_of(last_stage) != "processing")
    return df.withColumn(
        "delivered_us", F.when(answered, F.lit(as_of_us)).otherwise(F.col("delivered_us"))
    )


def queue_depth(df: DataFrame, last_stage: int, key: str = "queue_key") -> DataFrame:
    """Requests and inputs per queue and status, undelivered ones only."""
    return (
        df.filter(F.col("delivered_us").isNull())
        .withColumn("status", status_of(last_stage))
        .groupBy(key, "status")
        .agg(F.count(F.lit(1)).alias("n_requests"), F.sum("n_inputs").alias("n_inputs"))
    )


def queue_wait(long: DataFrame, request_id: str = "request_id") -> DataFrame:
    """Per request and stage (long form): start of this stage minus end of the one before.

    Stage -1 is the arrival itself. A window holds one request's stages.
    """
    by_stage = W.partitionBy(request_id).orderBy("stage")
    return long.withColumn(
        "wait_us", F.col("started_us") - F.lag("ended_us").over(by_stage)
    ).filter(F.col("stage") >= 0)
