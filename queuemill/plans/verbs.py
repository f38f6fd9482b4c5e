"""Plans: request-table verbs and the life cycle (groups C and F)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuemill.operators import lifecycle as L
from queuemill.operators import table as T
from queuemill.plans.registry import query
from queuemill.plans.views import AS_OF_US, LOG_SQL, MARKED_SQL, QUEUE_SQL, WEEK_SECONDS, Tables

WEEK_US = WEEK_SECONDS * 1_000_000


@query(
    "c1_search",
    f"""with {LOG_SQL} select request_id, queue_key, received_us from request_log
      where success is false and n_inputs > 4 order by received_us, request_id limit 100""",
)
def search(t: Tables) -> DataFrame:
    return T.search(
        t.request_log, {"success": False, "n_inputs": {"$gt": 4}}, 100, ["queue_key", "received_us"]
    )


@query(
    "c2_search_update",
    f"""with {LOG_SQL} select request_id, case when success is false and timed_out is distinct from true
      then true else timed_out end as timed_out, case when success is false
      and timed_out is distinct from true then 1 else last_stage end as last_stage from request_log""",
)
def search_update(t: Tables) -> DataFrame:
    failed = {"success": False, "timed_out": {"$ne": True}}
    updated = T.search_update(t.request_log, failed, {"timed_out": True, "last_stage": 1})
    return updated.select("request_id", "timed_out", "last_stage")


@query(
    "c3_count",
    f"""with {LOG_SQL} select count(*) as all_requests,
      count(*) filter (where delivered_us is null) as pending,
      count(*) filter (where success is false) as failed,
      count(*) filter (where timed_out is true) as timed_out,
      count(*) filter (where success is true and timed_out is distinct from true) as successful
      from request_log""",
)
def count(t: Tables) -> DataFrame:
    return T.count(
        t.request_log,
        {
            "all_requests": {},
            "pending": {"delivered_us": None},
            "failed": {"success": False},
            "timed_out": {"timed_out": True},
            "successful": {"success": True, "timed_out": {"$ne": True}},
        },
    )


@query(
    "c4_sum_where",
    f"""with {LOG_SQL} select queue_key,
      cast(sum(n_inputs) filter (where success is true) as bigint) as ok_inputs,
      cast(sum(n_inputs) filter (where timed_out is true) as bigint) as timed_out_inputs
      from request_log group by queue_key""",
)
def sum_where(t: Tables) -> DataFrame:
    return t.request_log.groupBy("queue_key").agg(
        T.sum_where("n_inputs", {"success": True}).alias("ok_inputs"),
        T.sum_where("n_inputs", {"timed_out": True}).alias("timed_out_inputs"),
    )


@query(
    "c5_get",
    f"""with {LOG_SQL} select request_id, success, last_stage, timed_out from request_log
      where request_id in (select doc_id from labels)""",
)
def get(t: Tables) -> DataFrame:
    ids = t.read("labels").select(F.col("doc_id").alias("request_id"))
    return T.get(t.request_log, ids, ["success", "last_stage", "timed_out"])


@query(
    "c6_upsert",
    f"""with {LOG_SQL}, updates as (
      select request_id, received_us + k as delivered_us, true as success, 1 as last_stage, 1 as version
        from request_log where k % 3 = 0
      union all select request_id, null, false, 2, 2 from request_log where k % 6 = 0
      union all select -request_id - 1, received_us, true, 3, 1 from request_log where k % 10 = 0),
    latest as (select * from (select *, row_number() over (partition by request_id order by version desc)
      as rn from updates) where rn = 1)
    select coalesce(l.request_id, u.request_id) as request_id, l.queue_key,
      case when u.request_id is not null then u.delivered_us else l.delivered_us end as delivered_us,
      case when u.request_id is not null then u.success else l.success end as success,
      case when u.request_id is not null then u.last_stage else l.last_stage end as last_stage
    from request_log l full outer join latest u on l.request_id = u.request_id""",
)
def upsert(t: Tables) -> DataFrame:
    base, updates = upsert_inputs(t)
    return T.upsert(base, updates, F.col("version"))


def upsert_inputs(t: Tables) -> tuple[DataFrame, DataFrame]:
    """A request table and updates of it: two versions of some rows, and new rows."""
    log = t.request_log
    first = log.filter("k % 3 = 0").selectExpr(
        "request_id", "received_us + k as delivered_us", "true as success", "1 as last_stage",
        "1 as version",
    )
    second = log.filter("k % 6 = 0").selectExpr(
        "request_id", "cast(null as bigint) as delivered_us", "false as success", "2 as last_stage",
        "2 as version",
    )
    new = log.filter("k % 10 = 0").selectExpr(
        "-request_id - 1 as request_id", "received_us as delivered_us", "true as success",
        "3 as last_stage", "1 as version",
    )
    updates = first.unionByName(second).unionByName(new)
    base = log.select("request_id", "queue_key", "delivered_us", "success", "last_stage")
    return base, updates


@query(
    "c7_delete",
    f"""with {LOG_SQL} select request_id, queue_key from request_log
      where not (delivered_us is not null and delivered_us > 0 and delivered_us < {AS_OF_US - WEEK_US})""",
)
def delete(t: Tables) -> DataFrame:
    old = {"$and": [{"delivered_us": {"$gt": 0}}, {"delivered_us": {"$lt": AS_OF_US - WEEK_US}}]}
    return T.delete(t.request_log, old).select("request_id", "queue_key")


@query(
    "c8_accumulate",
    f"""with {MARKED_SQL} select queue_key, round(sum(value), 6) as value from marked
      group by queue_key""",
)
def accumulate(t: Tables) -> DataFrame:
    return T.accumulate(t.marked_events, "queue_key", "value").select(
        "queue_key", F.round("value", 6).alias("value")
    )


ELIGIBLE_SQL = (
    QUEUE_SQL
    + """, eligible as (select * from queue_log where delivered_us is null and success is true
      and last_stage = -1 and timed_out is distinct from true)"""
)


@query("f1_eligible", f"with {ELIGIBLE_SQL} select request_id, queue_key from eligible")
def eligible(t: Tables) -> DataFrame:
    return L.eligible(t.queue_log, 0).select("request_id", "queue_key")


@query(
    "f2_claim",
    f"""with {ELIGIBLE_SQL} select request_id, queue_key, 0 as last_stage,
      cast(null as boolean) as success, cast({AS_OF_US} as bigint) as stage0_received_us, fifo_rank
      from (select *, cast(row_number() over (partition by queue_key order by received_us, request_id)
      as int) as fifo_rank from eligible) where fifo_rank <= 2""",
)
def claim(t: Tables) -> DataFrame:
    return L.claim(t.queue_log, 0, 2, AS_OF_US).select(
        "request_id", "queue_key", "last_stage", "success", "stage0_received_us", "fifo_rank"
    )


@query(
    "f3_flag_queue_timeouts",
    f"""with {QUEUE_SQL} select request_id, case when delivered_us is null
      and received_us < {AS_OF_US - WEEK_US} and timed_out is distinct from true and last_stage <> 0
      then true else timed_out end as timed_out from queue_log""",
)
def flag_queue_timeouts(t: Tables) -> DataFrame:
    flagged = L.flag_queue_timeouts(t.queue_log, AS_OF_US, WEEK_SECONDS, 0)
    return flagged.select("request_id", "timed_out")


@query(
    "f4_flag_client_timeouts",
    f"""with {QUEUE_SQL}, expiring as (select *, delivered_us is null and {AS_OF_US} - received_us >
      cast(case when k % 5 = 0 then 480 else k * 20000 end as bigint) * 1000000 as client_timed_out from queue_log)
      select request_id, client_timed_out,
      case when client_timed_out then true else timed_out end as timed_out,
      case when client_timed_out then {AS_OF_US} else delivered_us end as delivered_us from expiring""",
)
def flag_client_timeouts(t: Tables) -> DataFrame:
    log = t.queue_log.withColumn(
        "timeout", F.when(F.col("k") % 5 != 0, F.col("k") * 20000).cast("double")
    )
    flagged = L.flag_client_timeouts(log, AS_OF_US)
    return flagged.select("request_id", "client_timed_out", "timed_out", "delivered_us")


@query(
    "f5_purge_delivered",
    f"""with {LOG_SQL} select request_id, delivered_us from request_log
      where delivered_us is null or delivered_us >= {AS_OF_US - WEEK_US}""",
)
def purge_delivered(t: Tables) -> DataFrame:
    kept = L.purge_delivered(t.request_log, AS_OF_US, WEEK_SECONDS)
    return kept.select("request_id", "delivered_us")


@query(
    "f6_apply_results",
    f"""with {QUEUE_SQL} select request_id, case when last_stage = -1 then false else success end
      as success, case when last_stage = -1 then received_us + 5 else stage0_received_us end
      as stage0_received_us, case when last_stage = -1 then received_us + 5 + k
      else stage0_predicted_us end as stage0_predicted_us,
      case when last_stage = -1 then n_inputs * 2 end as stage0_batch_inputs,
      cast(case when last_stage = -1 then n_inputs * k end as bigint) as output_sum from queue_log""",
)
def apply_results(t: Tables) -> DataFrame:
    """Two results for each request; the later prediction counts."""
    log = t.queue_log.withColumns(
        {"stage0_batch_inputs": F.lit(None).cast("int"), "outputs": F.lit(None).cast("array<bigint>")}
    )
    results = log.filter("last_stage = -1").selectExpr(
        "request_id", "false as success", "received_us + 5 as stage0_received_us",
        "received_us + 5 + k as stage0_predicted_us", "n_inputs * 2 as stage0_batch_inputs",
        "array_repeat(cast(k as bigint), cast(n_inputs as int)) as outputs",
    )
    earlier = results.withColumns(
        {
            "success": F.lit(True),
            "stage0_predicted_us": F.col("stage0_predicted_us") - 1,
            "outputs": F.lit(None).cast("array<bigint>"),
        }
    )
    done = L.apply_results(log, results.unionByName(earlier), F.col("stage0_predicted_us"))
    total = F.aggregate("outputs", F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    return done.select(
        "request_id", "success", "stage0_received_us", "stage0_predicted_us", "stage0_batch_inputs",
        total.alias("output_sum"),
    )


@query(
    "f_mark_delivered",
    f"""with {QUEUE_SQL}, waiting as (select * replace (
        case when k % 3 = 0 then null else delivered_us end as delivered_us) from queue_log)
      select request_id, case when delivered_us is null and (timed_out is true or success is false
        or (success is true and last_stage = 0)) then {AS_OF_US} else delivered_us end as delivered_us
      from waiting""",
)
def mark_delivered(t: Tables) -> DataFrame:
    waiting = t.queue_log.withColumn(
        "delivered_us", F.when(F.col("k") % 3 != 0, F.col("delivered_us"))
    )
    return L.mark_delivered(waiting, 0, AS_OF_US).select("request_id", "delivered_us")


@query(
    "f7_queue_depth",
    f"""with {QUEUE_SQL}, open as (select *, case when timed_out is true then 'timed_out'
      when success is true and last_stage = 0 then 'done' when success is false then 'failed'
      else 'processing' end as status from queue_log where delivered_us is null)
      select queue_key, status, count(*) as n_requests, cast(sum(n_inputs) as bigint) as n_inputs
      from open group by all""",
)
def queue_depth(t: Tables) -> DataFrame:
    return L.queue_depth(t.queue_log, 0)


@query(
    "f8_queue_wait",
    f"""with {LOG_SQL} select request_id, 0 as stage, stage0_received_us - received_us as wait_us
      from request_log
      union all select request_id, 1, cast(k as bigint) from request_log
      where stage0_predicted_us is not null""",
)
def queue_wait(t: Tables) -> DataFrame:
    log = t.request_log
    arrival = log.selectExpr(
        "request_id", "-1 as stage", "received_us as started_us", "received_us as ended_us"
    )
    first = log.selectExpr(
        "request_id", "0 as stage", "stage0_received_us as started_us", "stage0_predicted_us as ended_us"
    )
    second = log.filter("stage0_predicted_us is not null").selectExpr(
        "request_id", "1 as stage", "stage0_predicted_us + k as started_us",
        "stage0_predicted_us + k as ended_us",
    )
    long = arrival.unionByName(first).unionByName(second)
    return L.queue_wait(long).select("request_id", "stage", "wait_us")
