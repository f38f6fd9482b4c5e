"""Plans: streams run to the end of the input that is there (group K)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuemill.functions.scalars import to_micros
from queuemill.operators.inference import Stage
from queuemill.plans.registry import query
from queuemill.plans.views import LOG_SQL, QUEUE_SQL, Tables, log_of, rounded
from queuemill.sources.requests import read_request_stream
from queuemill.streaming import lifecycle, metrics, scoring
from queuemill.streaming.runner import run_available, run_bounded

TIMEOUT_SECONDS = 7 * 24 * 3600
DELAY_SECONDS = 600
WINDOW_SECONDS = 24 * 3600
SLIDE_SECONDS = 6 * 3600


def marked_stream(t: Tables) -> DataFrame:
    stream = read_request_stream(t.spark, t.stream_path("events"), t.events.schema)
    return stream.select(
        F.col("event_id").alias("request_id"),
        F.col("user_id").alias("queue_key"),
        to_micros(F.col("ts")).alias("received_us"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        "value",
        "event_type",
    )


def log_stream(t: Tables) -> DataFrame:
    return log_of(marked_stream(t))


def triple(inputs: list, batch_size: int = 1) -> list:
    return [x * 3 for x in inputs]


@query(
    "k1_score_stream",
    f"""with {LOG_SQL} select request_id, true as success, 1 as last_stage,
      cast((k * 3 + 1) * n_inputs as bigint) as output_sum from request_log""",
)
def score_stream(t: Tables) -> DataFrame:
    stages = [
        Stage.from_function(triple, "int", 64),
        Stage.from_expression(lambda x: x + 1, "int", "plus_one"),
    ]
    requests = log_stream(t).select(
        "request_id", "queue_key", "received_us", F.expr("array_repeat(k, n_inputs)").alias("inputs")
    )
    scored = scoring.score_stream(requests, stages)
    total = F.aggregate("outputs", F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    return run_available(
        scored.select("request_id", "success", "last_stage", total.alias("output_sum")), "scored"
    )


def lifecycle_events(log: DataFrame, *kept: str) -> DataFrame:
    """Received, claimed, finished and delivered events of every request."""
    claimed = F.col("last_stage") == 0

    def event(kind: str, at: str, stage: int, success, kept=None):
        at_us = F.col(at) if kept is None else F.when(kept, F.col(at))
        return F.struct(
            F.lit(kind).alias("kind"), at_us.alias("at_us"), F.lit(stage).alias("stage"),
            success.alias("success"),
        )

    none = F.lit(None).cast("boolean")
    moments = F.array(
        event("received", "received_us", -1, F.lit(True)),
        event("claimed", "stage0_received_us", 0, none, claimed & (F.col("k") > 0)),
        event("finished", "stage0_predicted_us", 0, F.col("success")),
        event("delivered", "delivered_us", 0, none),
    )
    return (
        log.select("request_id", *kept, F.inline(moments))
        .filter(F.col("at_us").isNotNull())
        .select(
            "request_id", *kept, F.timestamp_micros("at_us").alias("event_time"), "kind", "stage", "success"
        )
    )


def queue_stream(t: Tables) -> DataFrame:
    waiting = F.col("success").isNull() & (F.col("k") % 2 == 0)
    return log_stream(t).withColumn("last_stage", F.when(waiting, -1).otherwise(0))


MARK_SQL = f"(select max(at_us) // 1000 * 1000 - {DELAY_SECONDS * 1_000_000} from moments)"

LIFECYCLE_SQL = (
    QUEUE_SQL
    + """, moments as (
    select request_id, 'received' as kind, received_us as at_us, -1 as stage, true as success from queue_log
    union all select request_id, 'claimed', stage0_received_us, 0, null from queue_log
      where last_stage = 0 and k > 0
    union all select request_id, 'finished', stage0_predicted_us, 0, success from queue_log
      where stage0_predicted_us is not null
    union all select request_id, 'delivered', delivered_us, 0, null from queue_log
      where delivered_us is not null),
  folded as (select request_id, max(at_us) filter (where kind = 'received') as received_us,
    max(at_us) filter (where kind = 'delivered') as delivered_us,
    max(at_us) filter (where kind <> 'delivered') as version_us, count(*) as n_events
    from moments group by request_id),
  newest as (select request_id, stage as last_stage, success, row_number() over (partition by request_id
    order by at_us desc, stage desc, kind = 'finished' desc) as rn from moments where kind <> 'delivered'),
  lives as (select f.*, n.last_stage, n.success from folded f
    join newest n on n.request_id = f.request_id and n.rn = 1)"""
)


HOUR_US = 3_600_000_000
LONGEST_WAIT_SECONDS = 12 * 3600
SLOW_SQL = LIFECYCLE_SQL.replace(
    "'claimed', stage0_received_us,", f"'claimed', stage0_received_us + k % 9 * {HOUR_US},"
).replace(
    "'finished', stage0_predicted_us,", f"'finished', stage0_predicted_us + k % 9 * {HOUR_US},"
).replace(
    "'delivered', delivered_us,", f"'delivered', delivered_us + k % 9 * {HOUR_US},"
)


LIVES = "request_id, last_stage, success, received_us, delivered_us, version_us, n_events"
SILENCE_SECONDS = 3600


@query(
    "k2_lifecycle_stream",
    f"""with {SLOW_SQL}, ends as (select request_id, max(at_us + case when kind = 'delivered'
        then {SILENCE_SECONDS * 1_000_000} else {LONGEST_WAIT_SECONDS * 1_000_000} end) as end_us
      from moments group by request_id)
      select {LIVES} from lives join ends using (request_id) where end_us <= {MARK_SQL}""",
)
def lifecycle_stream(t: Tables) -> DataFrame:
    """Requests wait up to eight hours for their claim; lives that may still go on stay inside."""
    log = queue_stream(t)
    wait = F.col("k") % 9 * HOUR_US
    slow = log.withColumns(
        {name: F.col(name) + wait for name in ("stage0_received_us", "stage0_predicted_us", "delivered_us")}
    )
    closed = lifecycle.closed_lifecycles(
        lifecycle_events(slow), LONGEST_WAIT_SECONDS, SILENCE_SECONDS, f"{DELAY_SECONDS} seconds"
    )
    return run_available(closed, "lifecycle")


@query("k2_lifecycle_batch", f"with {LIFECYCLE_SQL} select {LIVES} from lives")
def lifecycle_batch(t: Tables) -> DataFrame:
    waiting = F.col("success").isNull() & (F.col("k") % 2 == 0)
    log = t.request_log.withColumn("last_stage", F.when(waiting, -1).otherwise(0))
    return lifecycle.fold_lifecycle(lifecycle_events(log))


@query(
    "k3_timeout_stream",
    f"""with {LIFECYCLE_SQL} select request_id, received_us, true as timed_out from lives
      where delivered_us is null and last_stage <> 0
      and received_us + {TIMEOUT_SECONDS * 1_000_000} <= {MARK_SQL}""",
)
def timeout_stream(t: Tables) -> DataFrame:
    flagged = lifecycle.timeout_stream(
        lifecycle_events(queue_stream(t)), TIMEOUT_SECONDS, delay=f"{DELAY_SECONDS} seconds"
    )
    return run_available(flagged.select("request_id", "received_us", "timed_out"), "timeouts")


@query(
    "k3_client_timeout_stream",
    f"""with {LIFECYCLE_SQL}, limits as (select request_id, cast(case when k % 4 > 0 then k % 4 * 86400
        else 480 end as bigint) as timeout_seconds from queue_log)
      select request_id, received_us, timeout_seconds from lives join limits using (request_id)
      where (delivered_us is null or delivered_us - received_us > timeout_seconds * 1000000)
      and received_us + timeout_seconds * 1000000 <= {MARK_SQL}""",
)
def client_timeout_stream(t: Tables) -> DataFrame:
    """Three of four requests bring a time-out of their own, of days."""
    limit = F.when(F.col("k") % 4 > 0, F.col("k") % 4 * 86_400)
    events = lifecycle_events(queue_stream(t).withColumn("timeout", limit), "timeout")
    gone = lifecycle.client_timeout_stream(events, "timeout", delay=f"{DELAY_SECONDS} seconds")
    return run_available(gone.select("request_id", "received_us", "timeout_seconds"), "client-timeouts")


@query(
    "k4_dedupe_stream",
    f"with {LOG_SQL} select distinct concat(queue_key, '-', k) as request_key from request_log",
)
def dedupe_stream(t: Tables) -> DataFrame:
    keyed = log_stream(t).select(
        F.concat_ws("-", "queue_key", "k").alias("request_key"),
        F.timestamp_micros("received_us").alias("event_time"),
    )
    unique = scoring.dedupe_stream(keyed, "request_key", "event_time", "60 days")
    return run_available(unique.select("request_key"), "deduped")


ANSWERED_SQL = "kind = 'received' and delivered and timed_out is distinct from true"


@query(
    "k5_metrics_stream",
    f"""with {LOG_SQL}, moments as (
      select 'received' as kind, received_us as at_us, success, timed_out, delivered_us is not null as delivered,
        delivered_us - received_us as waited_us, stage0_predicted_us - stage0_received_us as ran_us
        from request_log
      union all select 'processed', delivered_us, success, timed_out, true, null, null from request_log
        where delivered_us is not null),
    placed as (select m.*, (at_us // {SLIDE_SECONDS * 1_000_000} - i) * {SLIDE_SECONDS * 1_000_000}
      as window_start_us from moments m
      cross join (select unnest(range(0, {WINDOW_SECONDS // SLIDE_SECONDS})) as i))
    select window_start_us, window_start_us + {WINDOW_SECONDS * 1_000_000} as window_end_us,
      count(*) filter (where kind = 'received') as requests_received,
      count(*) filter (where kind = 'processed') as requests_processed,
      count(*) filter (where kind = 'received' and success is false) as received_that_failed,
      count(*) filter (where kind = 'processed' and success is false) as processed_that_failed,
      count(*) filter (where kind = 'processed' and timed_out is true) as number_of_requests_timedout,
      count(*) filter (where kind = 'processed' and success is true and timed_out is distinct from true)
        as processed_that_are_successful,
      count(*) filter (where kind = 'received' and not delivered and success is distinct from false)
        as received_that_are_pending,
      count(*) filter (where {ANSWERED_SQL} and success is true) as received_that_are_successful,
      round(case when sum(waited_us) filter (where {ANSWERED_SQL}) is null then 0.0 else
        cast(sum(waited_us) filter (where {ANSWERED_SQL}) as double) / 1000000
        / nullif(count(*) filter (where {ANSWERED_SQL} and success is true), 0) end + 1e-9, 6) as avg_total_time,
      round(case when sum(ran_us) filter (where {ANSWERED_SQL}) is null then 0.0 else
        cast(sum(ran_us) filter (where {ANSWERED_SQL}) as double) / 1000000
        / nullif(count(*) filter (where {ANSWERED_SQL} and success is true), 0) end + 1e-9, 6) as avg_actual_total_time
    from placed group by window_start_us
    having window_end_us <= (select max(at_us) from moments) - {DELAY_SECONDS * 1_000_000}""",
)
def metrics_stream(t: Tables) -> DataFrame:
    moments = metrics.request_moments(log_stream(t))
    counters = metrics.metrics_stream(moments, WINDOW_SECONDS, SLIDE_SECONDS, DELAY_SECONDS)
    return rounded(run_available(counters, "metrics"))


@query(
    "k6_bounded_trigger",
    f"""with {LOG_SQL} select request_id, cast(k * 3 * n_inputs as bigint) as output_sum
      from request_log""",
)
def bounded_trigger(t: Tables) -> DataFrame:
    requests = log_stream(t).select(
        "request_id", "queue_key", "received_us", F.expr("array_repeat(k, n_inputs)").alias("inputs")
    )
    scored = scoring.score_stream(requests, [Stage.from_function(triple, "int", 64)])
    total = F.aggregate("outputs", F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    return run_bounded(
        scored.select("request_id", total.alias("output_sum")), "bounded", 64, max_wait_seconds=0.1
    )
