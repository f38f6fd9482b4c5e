"""Plans: readers, admission and answers (groups A and B)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuemill.functions.match import match
from queuemill.operators import validation as V
from queuemill.plans.registry import query
from queuemill.plans.views import AS_OF_US, LOG_SQL, RAW_SQL, REQUESTS_SQL, TURNS_SQL, Tables
from queuemill.session import scratch_path
from queuemill.sources import requests as R
from queuemill.sources.sinks import write_responses
from queuemill.streaming.runner import run_available

DECODED_SQL = (
    RAW_SQL
    + """, decoded as (select *, case when json_valid(payload) then
    coalesce(json_extract(payload, '$.data'), cast(payload as json)) end as inputs
  from raw_requests)"""
)

VALIDATED_SQL = (
    DECODED_SQL
    + """, reasoned as (select *, case
    when input_type = 'pickle' then 'pickle input disallowed, use msgpack or json'
    when input_type not in ('msgpack', 'json') then concat('input_type ', input_type, ' not supported')
    when input_type <> 'json' or inputs is null then 'undecodable'
    when json_type(inputs) = 'NULL' then 'inputs have to be  msgpack or json'
    when json_type(inputs) <> 'ARRAY' then 'inputs have to be a list or tuple'
    when json_array_length(inputs) = 0 then 'empty inputs' end as reason from decoded),
validated as (select conv_id, request_id, payload, input_type, reason,
  (reason is null or reason = 'empty inputs') as success, reason is null as is_valid,
  cast(case when reason is null then json_array_length(inputs) else 0 end as int) as n_inputs
  from reasoned)"""
)


@query(
    "a1_read_requests_json",
    f"""with {DECODED_SQL} select request_id, case when inputs is null then 'undecodable'
      when json_type(inputs) = 'NULL' then 'null' when json_type(inputs) = 'ARRAY' then 'list'
      else 'other' end as kind,
      cast(case when json_type(inputs) = 'ARRAY' then json_array_length(inputs) end as bigint)
      as n_items from decoded""",
)
def read_requests_json(t: Tables) -> DataFrame:
    items = F.expr("try_variant_get(inputs, '$', 'array<variant>')")
    kind = (
        F.when(F.col("inputs").isNull(), "undecodable")
        .when(F.expr("is_variant_null(inputs)"), "null")
        .when(items.isNotNull(), "list")
        .otherwise("other")
    )
    decoded = R.read_requests_json(t.raw_requests)
    return decoded.select("request_id", kind.alias("kind"), F.size(items).cast("bigint").alias("n_items"))


@query(
    "a2_read_request_array_file",
    f"""with {TURNS_SQL}, files as (select conv_id // 16 as file, split_part(request_id, '-', 2) as part,
      conv_id, pos, input from turns)
      select cast(row_number() over (partition by file, part order by conv_id, pos) - 1 as bigint) as pos,
      input from files""",
)
def read_request_array_file(t: Tables) -> DataFrame:
    files = (
        t.turns.groupBy(F.expr("conv_id div 16"), F.split_part("request_id", F.lit("-"), F.lit(2)))
        .agg(F.array_sort(F.collect_list(F.struct("conv_id", "pos", "input"))).alias("items"))
        .select(F.to_json(F.transform("items", lambda x: x["input"])).alias("value"))
    )
    path = scratch_path(t.spark, "array-files")
    files.write.option("maxRecordsPerFile", 1).text(path)
    read = R.read_request_array_file(t.spark, path)
    return read.select(
        F.col("pos").cast("bigint").alias("pos"), F.expr("input::string").alias("input")
    )


@query(
    "a3_read_binary_requests",
    """select item_id, 'txt' as type, octet_length(encode(text)) + 1 as n_bytes, md5(text || chr(10)) as content_md5,
      'output_file_' || row_number() over (order by cast(item_id as varchar)) as output_name from benchmark""",
)
def read_binary_requests(t: Tables) -> DataFrame:
    """One text file per benchmark item, read back as binary requests."""
    path = scratch_path(t.spark, "binary-requests")
    items = t.spark.read.parquet(f"{t.sf_dir}/benchmark.parquet").select("item_id", "text")
    items.repartition("item_id").write.partitionBy("item_id").text(path)
    files = R.read_binary_requests(t.spark, path, "*.txt", recursive=True)
    return files.select(
        F.regexp_extract("path", r"item_id=(-?\d+)", 1).cast("bigint").alias("item_id"),
        "type", "n_bytes", F.md5("content").alias("content_md5"), "output_name",
    )


@query(
    "a4_read_request_stream",
    "select event_id, user_id, event_type, round(value, 6) as value from events",
)
def read_request_stream(t: Tables) -> DataFrame:
    stream = R.read_request_stream(t.spark, t.stream_path("events"), t.events.schema)
    return run_available(
        stream.select("event_id", "user_id", "event_type", F.round("value", 6).alias("value")),
        "intake",
    )


RESPONSES_SQL = (
    LOG_SQL
    + """, responses as (select request_id, case when timed_out is true then 'timed_out'
    when success is true then 'done' when success is false then 'failed' else 'processing' end as status,
    k, n_inputs from request_log),
  answers as (select request_id, status,
    case when status <> 'processing' then status = 'done' end as response_success,
    case status when 'timed_out' then 'timeout' when 'failed' then 'prediction failed predictor 0' end
      as response_reason,
    cast(case when status = 'done' then n_inputs end as bigint) as n_predictions,
    cast(case when status = 'done' then n_inputs * k * 2 end as bigint) as prediction_sum from responses)"""
)


def responses(t: Tables) -> DataFrame:
    log = t.request_log.withColumn("outputs", F.expr("array_repeat(k * 2, n_inputs)"))
    return V.build_response(V.resolve_status(log, 0), 0)


def flat_answers(answered: DataFrame) -> DataFrame:
    total = F.aggregate("prediction", F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    return answered.select(
        "request_id", "status", "response_success", "response_reason",
        F.size("prediction").cast("bigint").alias("n_predictions"), total.alias("prediction_sum"),
    )


@query("a5_write_responses", f"with {RESPONSES_SQL} select * from answers")
def write_and_read_responses(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "responses")
    write_responses(responses(t), path, compressed=True)
    return flat_answers(t.spark.read.parquet(path))


@query(
    "b1_validate_requests",
    f"with {VALIDATED_SQL} select request_id, reason, success, is_valid, n_inputs from validated",
)
def validate_requests(t: Tables) -> DataFrame:
    checked = V.validate_requests(t.raw_requests)
    return checked.select("request_id", "reason", "success", "is_valid", "n_inputs")


@query(
    "b2_split_requests",
    f"""with {VALIDATED_SQL} select case when is_valid then 'queue' else 'answer' end as route,
      coalesce(reason, '') as reason, count(*) as n_requests, cast(sum(n_inputs) as bigint) as n_inputs
      from validated group by all""",
)
def split_requests(t: Tables) -> DataFrame:
    accepted, answered = V.split_requests(V.validate_requests(t.raw_requests))
    both = accepted.withColumn("route", F.lit("queue")).unionByName(
        answered.withColumn("route", F.lit("answer"))
    )
    return both.groupBy("route", F.coalesce("reason", F.lit("")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n_requests"), F.sum("n_inputs").alias("n_inputs")
    )


@query(
    "b3_limit_request_size",
    f"""with {REQUESTS_SQL} select request_id,
      case when len(inputs) > 4 then 'more than 4 inputs in one request' end as size_reason,
      len(inputs) <= 4 as size_ok from requests""",
)
def limit_request_size(t: Tables) -> DataFrame:
    limited = V.limit_request_size(t.requests, 4)
    return limited.select("request_id", "size_reason", "size_ok")


@query(
    "b4_assign_request_id",
    f"""with {RAW_SQL} select conv_id, case when conv_id % 3 = 0
      then sha256(cast(to_json({{'conv_id': conv_id, 'payload': payload, 'input_type': input_type}}) as varchar))
      else request_id end as request_id
      from raw_requests""",
)
def assign_request_id(t: Tables) -> DataFrame:
    given = F.when(F.col("conv_id") % 3 == 0, F.when(F.col("conv_id") % 2 == 0, F.lit(""))).otherwise(
        F.col("request_id")
    )
    raw = t.raw_requests.withColumn("request_id", given)
    return V.assign_request_id(raw, ["conv_id", "payload", "input_type"]).select("conv_id", "request_id")


@query(
    "b5_admit_inputs_row",
    f"""with {REQUESTS_SQL} select request_id, cast(len(inputs) as int) as n_inputs, -1 as last_stage,
      true as success, cast(null as boolean) as timed_out, cast(null as bigint) as delivered_us
      from requests""",
)
def admit_inputs_row(t: Tables) -> DataFrame:
    return V.admit_inputs_row(t.requests).drop("inputs", "conv_id")


@query("b6_resolve_status", f"with {RESPONSES_SQL} select request_id, status from answers")
def resolve_status(t: Tables) -> DataFrame:
    return V.resolve_status(t.request_log, 0).select("request_id", "status")


@query("b7_build_response", f"with {RESPONSES_SQL} select * from answers")
def build_response(t: Tables) -> DataFrame:
    return flat_answers(responses(t))


@query(
    "b8_http_status",
    f"""with {VALIDATED_SQL} select request_id, case when not success then 400
      when n_inputs % 3 <> 0 then 200 else 500 end as status_code,
      case when n_inputs % 2 = 1 then 'application/octet-stream' when input_type = 'json'
      then 'application/json' when input_type = 'pickle' then 'application/pickle'
      when input_type = 'msgpack' then 'application/msgpack' end as content_type from validated""",
)
def http_status(t: Tables) -> DataFrame:
    answered = V.validate_requests(t.raw_requests).withColumns(
        {
            "refused": ~F.col("success"),
            "response_success": F.col("n_inputs") % 3 != 0,
            "compressed": F.col("n_inputs") % 2 == 1,
        }
    )
    return V.http_status(answered).select("request_id", "status_code", "content_type")


@query(
    "b9_match",
    f"""with {LOG_SQL} select request_id from request_log where success is distinct from false
      and received_us > {AS_OF_US} - 1000000000000 and received_us < {AS_OF_US}
      and n_inputs >= 3 and n_inputs <= 6 and timed_out is distinct from true""",
)
def match_query(t: Tables) -> DataFrame:
    wanted = {
        "success": {"$ne": False},
        "received_us": {"$gt": AS_OF_US - 1_000_000_000_000, "$lt": AS_OF_US},
        "$and": [{"n_inputs": {"$gte": 3}}, {"n_inputs": {"$lte": 6}}],
        "timed_out": {"$ne": True},
    }
    return t.request_log.filter(match(wanted)).select("request_id")
