"""Plans: streams with keyed state of their own, over files that arrive in several triggers and out of order (group K)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuemill.operators.inference import Stage
from queuemill.plans.registry import query
from queuemill.plans.stages import BATCH, DOUBLE, ISOLATED_SQL
from queuemill.plans.streams import LIFECYCLE_SQL, lifecycle_events, triple
from queuemill.plans.views import LOG_SQL, SIX_HOURS_US, Tables, pack_sql
from queuemill.session import scratch_path
from queuemill.sources import feeds
from queuemill.sources.requests import read_request_stream
from queuemill.streaming import lives, waiting
from queuemill.streaming.runner import run_available
from queuemill.streaming.scoring import score_stream

STEPS = 3
MAX_FILES = 200  # of one trigger
#: Rows arrive up to twelve hours late, and the watermark waits for thirteen.
LATENESS_SECONDS = 12 * 3600
LATE_STEPS = 4
DELAY_SECONDS = 13 * 3600
FIRST_US, SPAN_US = 1_704_067_200_000_000, 31 * 24 * 3600 * 1_000_000  # January 2024


def arriving(rows: DataFrame, at_us: str, label: str) -> DataFrame:
    """``rows`` as a stream of ``STEPS`` triggers: by time, but each row up to ``LATENESS_SECONDS`` late.

    Every trigger takes the same number of files, one per partition of ``rows``; where there are fewer, empty ones follow.
    """
    spark = rows.sparkSession
    late = F.pmod(F.xxhash64("request_id", at_us), F.lit(LATE_STEPS)) * (LATENESS_SECONDS * 1_000_000 // LATE_STEPS)
    number = F.least(F.greatest(F.expr("0"), (F.col(at_us) + late - FIRST_US) * STEPS / SPAN_US), F.lit(STEPS - 1))
    path = scratch_path(spark, label)
    files = min(rows.rdd.getNumPartitions(), MAX_FILES)
    for step in range(STEPS):
        rows.filter(number.cast("int") == step).coalesce(files).write.mode("append").parquet(path)
        written = len(spark.read.schema(rows.schema).parquet(path).inputFiles())
        for _ in range(written, files * (step + 1)):
            rows.filter("false").coalesce(1).write.mode("append").parquet(path)
    return read_request_stream(spark, path, rows.schema, max_files=files)


QUEUE_TIMEOUT_SECONDS = 3 * 24 * 3600
PATIENCE_SECONDS = 2 * 24 * 3600
KEEP_SECONDS = 24 * 3600


def changes(t: Tables) -> DataFrame:
    """All changes and timers. Some clients bring a time-out of their own, of a second or of five days."""
    patience = F.when(F.col("k") % 5 == 0, 1).when(F.col("k") % 5 == 1, 5 * 24 * 3600)
    events = lifecycle_events(t.queue_log.withColumn("patience", patience), "patience")
    moments = events.withColumn("at_us", F.unix_micros("event_time"))
    stream = arriving(moments, "at_us", "life-events").drop("at_us")
    return run_available(
        lives.request_changes(
            stream, 0, QUEUE_TIMEOUT_SECONDS, PATIENCE_SECONDS, KEEP_SECONDS, f"{DELAY_SECONDS} seconds", "patience"
        ),
        "changes",
    )


def _fires(at: str) -> str:
    return f"{at} <= (select mark_us from marks)"


#: A life is closed by the first of three moments; what lies behind the watermark has happened.
CLOSED_SQL = (
    LIFECYCLE_SQL
    + f""", marks as (select (max(at_us) // 1000 - {DELAY_SECONDS * 1000}) * 1000 as mark_us from moments),
  taken as (select request_id, min(at_us) as taken_us from moments where stage = 0 and kind <> 'delivered' group by request_id),
  limits as (select l.*, taken_us,
      received_us + {QUEUE_TIMEOUT_SECONDS * 1_000_000} as queue_us,
      received_us + case when k % 5 = 0 then 1000000 when k % 5 = 1 then {5 * 24 * 3600 * 1_000_000}
        else {PATIENCE_SECONDS * 1_000_000} end as client_us
    from lives l join (select request_id, k from queue_log) using (request_id) left join taken using (request_id)),
  unmet as (select *, case when coalesce(taken_us <= queue_us, false) or coalesce(delivered_us <= queue_us, false)
      then null else queue_us end as queue_end_us,
    case when coalesce(delivered_us <= client_us, false) then null else client_us end as client_end_us from limits),
  closed as (select *, least(delivered_us, queue_end_us, client_end_us) as closing_us from unmet),
  told as (select *, case when closing_us = delivered_us then null when closing_us = queue_end_us then 'timeout'
    when closing_us = client_end_us then 'client_timeout' end as why,
    closing_us + {KEEP_SECONDS * 1_000_000} as purge_us from closed)"""
)


@query(
    "k2_request_changes",
    f"""with {CLOSED_SQL} select request_id, last_stage, success, received_us, delivered_us,
      case when why is not null and {_fires('closing_us')} then true end as timed_out,
      case when why is not null and {_fires('closing_us')} then why end as reason,
      n_events, coalesce({_fires('purge_us')}, false) as purged from told""",
)
def request_changes(t: Tables) -> DataFrame:
    """The newest row of every request, after all files came in."""
    newest = lives.last_changes(changes(t))
    return newest.select(
        "request_id", "last_stage", "success", "received_us", "delivered_us", "timed_out", "reason", "n_events",
        (F.col("change") == "purged").alias("purged"),
    )


def _timer(t: Tables, change: str) -> DataFrame:
    return changes(t).filter(F.col("change") == change).select("request_id", "at_us", "reason")


@query(
    "k3_queue_timers",
    f"""with {CLOSED_SQL} select request_id, closing_us as at_us, why as reason from told
      where why = 'timeout' and {_fires('closing_us')}""",
)
def queue_timers(t: Tables) -> DataFrame:
    return _timer(t, "queue_timeout")


@query(
    "k3_client_timers",
    f"""with {CLOSED_SQL} select request_id, closing_us as at_us, why as reason from told
      where why = 'client_timeout' and {_fires('closing_us')}""",
)
def client_timers(t: Tables) -> DataFrame:
    return _timer(t, "client_timeout")


@query(
    "k3_retention_timers",
    f"""with {CLOSED_SQL} select request_id, purge_us as at_us, why as reason from told
      where {_fires('purge_us')}""",
)
def retention_timers(t: Tables) -> DataFrame:
    return _timer(t, "purged")


MARK_OF_LOG = f"(select (max(received_us) // 1000 - {DELAY_SECONDS * 1000}) * 1000 from request_log)"


def closed_batches(name: str, batch_size: int, wait_us: int) -> str:
    """Batches of ``name`` (see ``pack_sql``) that no request behind the watermark can still join."""
    return f"""{name}_closed as (select queue_key, batch_id from {name} join request_log using (queue_key, request_id)
      group by queue_key, batch_id, opened having opened + {wait_us} <= {MARK_OF_LOG} + 1
      or (sum({name}.n_inputs) > 0.8 * {batch_size} and max(received_us) <= {MARK_OF_LOG}))"""


@query(
    "k6_waiting_batches",
    f"""with recursive {LOG_SQL}, {pack_sql('p', 'request_log', BATCH, SIX_HOURS_US)},
      {closed_batches('p', BATCH, SIX_HOURS_US)}
      select queue_key, request_id, cast(batch_id as bigint) as batch_id, cast(batch_offset as bigint) as batch_offset
      from p join p_closed using (queue_key, batch_id)""",
)
def waiting_batches(t: Tables) -> DataFrame:
    """Requests come late and in three triggers; batches are those of the whole log."""
    log = t.request_log.select("queue_key", "request_id", "received_us", "n_inputs")
    packed = waiting.pack_stream(
        arriving(log, "received_us", "late-requests"), BATCH, SIX_HOURS_US, delay=f"{DELAY_SECONDS} seconds"
    )
    return run_available(packed.select("queue_key", "request_id", "batch_id", "batch_offset"), "waiting-batches")


@query(
    "k1_score_waiting",
    f"""with recursive {ISOLATED_SQL}, {closed_batches('p', BATCH, SIX_HOURS_US)}
      select request_id, cast(batch_id as bigint) as batch_id, cast(batch_inputs as bigint) as batch_inputs,
      not failed as success, case when failed then '99 cannot be doubled' end as error,
      cast(case when not failed then (k * 2 + 1) * n_inputs end as bigint) as output_sum
      from isolated join p_closed using (queue_key, batch_id)""",
)
def score_waiting(t: Tables) -> DataFrame:
    """A stage that fails for some inputs: the same requests fail as in batch, however they come in."""
    requests = t.numbered_requests.select("request_id", "queue_key", "received_us", "inputs")
    stages = [DOUBLE, Stage.from_expression(lambda x: x + 1, "int", "plus_one")]
    scored = waiting.score_waiting_stream(
        arriving(requests, "received_us", "late-inputs"), stages, SIX_HOURS_US, delay=f"{DELAY_SECONDS} seconds"
    )
    total = F.aggregate("outputs", F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    return run_available(
        scored.select(
            "request_id", F.col("stage0_batch_id").alias("batch_id"), F.col("stage0_batch_inputs").alias("batch_inputs"),
            "success", "error", F.when(F.col("success"), total).alias("output_sum"),
        ),
        "scored-waiting",
    )


FEED_INPUTS = 500


@query(
    "k6_bounded_inputs",
    f"""with {LOG_SQL} select request_id, cast(k * 3 * n_inputs as bigint) as output_sum, true as within_limit
      from request_log""",
)
def bounded_inputs(t: Tables) -> DataFrame:
    """A feed of at most ``FEED_INPUTS`` inputs a trigger, scored into one folder per epoch."""
    requests = t.numbered_requests.select("request_id", "queue_key", "received_us", "inputs")
    path, out = scratch_path(t.spark, "feed"), scratch_path(t.spark, "epochs")
    share = FEED_INPUTS * max(1, t.events.count() // 1000)  # some ten triggers at any size
    feeds.write_feed(requests.withColumn("n_inputs", F.size("inputs")), path, share)
    stream = feeds.read_feed(t.spark, path, requests.schema)
    scored = score_stream(stream, [Stage.from_function(triple, "int", 64)])
    total = F.aggregate("outputs", F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    answers = scored.select("request_id", F.size("inputs").alias("n"), total.alias("output_sum"))
    feeds.write_epochs(answers, out).trigger(availableNow=True).start().awaitTermination()
    written = feeds.read_epochs(t.spark, out)
    sums = written.groupBy("epoch").agg((F.sum("n") <= share).alias("within_limit"))
    return written.join(sums, "epoch").select("request_id", "output_sum", "within_limit")
