"""Request-shaped views of the test tables, as DataFrames and as SQL text."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queuemill.functions.scalars import to_micros
from queuemill.session import ship_package

# The instant all plans count as "now", and the windows they look back on.
AS_OF_US = 1_706_659_200_000_000  # 2024-01-31 00:00:00 UTC
WEEK_SECONDS = 7 * 24 * 3600
SIX_HOURS_US = 6 * 3600 * 1_000_000
BENCH_SECONDS = 2_505_600.0
WARMUP_END_US = 1_704_153_600_000_000  # 2024-01-02 00:00:00 UTC
TURNS_PER_REQUEST = 1024  # a longer conversation makes several requests


class Tables:
    """The tables of one folder, and the views derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        ship_package(spark)
        self.spark = spark
        self.sf_dir = sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def stream_path(self, name: str) -> str:
        """A table as a stream source, be it one file or a folder of part files.

        A stream takes a single file only by way of a pattern.
        """
        return f"{self.sf_dir}/{name}.parque[t]"

    @cached_property
    def events(self) -> DataFrame:
        return self.read("events")

    @property
    def marked_events(self) -> DataFrame:
        return self.events.select(
            F.col("event_id").alias("request_id"),
            F.col("user_id").alias("queue_key"),
            to_micros(F.col("ts")).alias("received_us"),
            F.get_json_object("props", "$.k").cast("int").alias("k"),
            "value",
            "event_type",
        )

    @property
    def request_log(self) -> DataFrame:
        return log_of(self.marked_events)

    @property
    def queue_log(self) -> DataFrame:
        """The log before everything was claimed: every other pending request still waits."""
        waiting = F.col("success").isNull() & (F.col("k") % 2 == 0)
        return self.request_log.withColumns(
            {
                "last_stage": F.when(waiting, -1).otherwise(0),
                "success": F.when(waiting, F.lit(True)).otherwise(F.col("success")),
            }
        )

    @property
    def numbered_requests(self) -> DataFrame:
        """Events as requests with inputs: ``k`` repeated ``n_inputs`` times."""
        return self.request_log.select(
            "request_id", "queue_key", "received_us", "k",
            F.expr("array_repeat(k, n_inputs)").alias("inputs"),
        )

    @property
    def turns(self) -> DataFrame:
        """Conversation turns as flat inputs: (request_id, pos, input)."""
        return self.read("conversations").select(
            "conv_id",
            F.concat_ws("-", "conv_id", F.expr("turn div 1024")).alias("request_id"),
            (F.col("turn") % TURNS_PER_REQUEST).cast("int").alias("pos"),
            F.col("text").alias("input"),
        )

    @property
    def requests(self) -> DataFrame:
        """One request per conversation (and per 1024 turns of it): inputs are the texts in order."""
        items = F.array_sort(F.collect_list(F.struct("pos", "input")))
        return self.turns.groupBy("conv_id", "request_id").agg(
            F.transform(items, lambda x: x["input"]).alias("inputs")
        )

    @property
    def raw_requests(self) -> DataFrame:
        """Well-formed and broken payloads, by conversation number."""
        counted = self.turns.select("conv_id", "request_id", "pos", F.length("input").alias("n"))
        items = F.array_sort(F.collect_list(F.struct("pos", "n")))
        good = counted.groupBy("conv_id", "request_id").agg(
            F.to_json(F.transform(items, lambda x: x["n"])).alias("p")
        )
        return good.selectExpr(
            "conv_id",
            "request_id",
            """case conv_id % 8 when 0 then 'null' when 1 then '[]' when 2 then '"text"'
               when 3 then concat('{"data":', p, '}') when 4 then '{"x":1}'
               when 5 then 'not json' else p end as payload""",
            """case when conv_id % 16 = 6 then 'pickle' when conv_id % 16 = 14 then 'xml'
               when conv_id % 16 = 7 then 'msgpack' else 'json' end as input_type""",
        )

    @property
    def batch_times(self) -> DataFrame:
        """Measured batches: size and elapsed milliseconds per key."""
        return self.marked_events.select(
            "queue_key",
            F.pow(F.lit(2), F.col("k") % 11).cast("bigint").alias("batch_size"),
            F.col("value").alias("ms"),
        )

    @property
    def calls(self) -> DataFrame:
        """Benchmark calls; the first day is warm-up."""
        return self.marked_events.select(
            F.col("queue_key").alias("connection_id"),
            F.col("request_id").alias("seq"),
            F.col("value").alias("latency_ms"),
            (F.col("event_type") != "error").alias("success"),
            F.when(F.col("event_type") == "error", F.concat(F.lit("k"), "k")).alias("error"),
            (F.col("received_us") < WARMUP_END_US).alias("is_warmup"),
        )

    @property
    def samples(self) -> DataFrame:
        """Resource samples of two process groups, by hour."""
        return self.marked_events.select(
            F.when(F.col("queue_key") % 4 == 0, "loop").otherwise("rest").alias("role"),
            F.expr("received_us div 3600000000 * 3600").alias("ts"),
            F.col("queue_key").alias("pid"),
            F.col("value").alias("cpu"),
            (F.col("k") * 1024).alias("ram_kb"),
        )

    @property
    def gpu(self) -> DataFrame:
        return self.samples.filter("pid % 3 = 0").select(
            "ts", "pid", F.expr("ram_kb div 1024").alias("util"),
            F.expr("ram_kb div 1024 * 10").alias("mem"),
        )


def log_of(marked: DataFrame) -> DataFrame:
    """Request log rows from marked events (a table or a stream); one stage, number 0."""
    pending = (F.col("event_type") == "view") & (F.col("k") >= 90)
    claimed = F.col("received_us") + F.col("k") * 1000
    finished = claimed + F.round(F.col("value") * 1000).cast("bigint")
    return marked.select(
        "request_id", "queue_key", "received_us", "k",
        (F.col("k") % 8 + 1).alias("n_inputs"),
        F.when(~pending, finished).alias("delivered_us"),
        claimed.alias("stage0_received_us"),
        F.when(~pending, finished).alias("stage0_predicted_us"),
        F.when(F.col("event_type") == "error", F.lit(False))
        .when(~pending, F.lit(True))
        .alias("success"),
        F.when((F.col("event_type") == "signup") & (F.col("k") < 10), F.lit(True)).alias("timed_out"),
        F.lit(0).alias("last_stage"),
    )


def rounded(df: DataFrame) -> DataFrame:
    """Round every double to six digits, as the SQL does with ``round(x + 1e-9, 6)``.

    The small shift keeps values that lie exactly between two digits from going either way with the
    order in which a sum was formed.
    """
    return df.select(
        *[
            F.round(F.col(f.name) + F.lit(1e-9), 6).alias(f.name)
            if f.dataType.typeName() == "double"
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


# --- the same views as common table expressions ---------------------------------------------------

MARKED_SQL = """marked as (select event_id as request_id, user_id as queue_key,
  epoch_us(ts) as received_us, cast(json_extract_string(props, '$.k') as int) as k, value, event_type
  from events)"""

LOG_SQL = (
    MARKED_SQL
    + """, request_log as (select request_id, queue_key, received_us, k, k % 8 + 1 as n_inputs,
  case when event_type = 'view' and k >= 90 then null
       else received_us + k * 1000 + cast(round(value * 1000) as bigint) end as delivered_us,
  received_us + k * 1000 as stage0_received_us,
  case when event_type = 'view' and k >= 90 then null
       else received_us + k * 1000 + cast(round(value * 1000) as bigint) end as stage0_predicted_us,
  case when event_type = 'error' then false
       when event_type = 'view' and k >= 90 then null else true end as success,
  case when event_type = 'signup' and k < 10 then true end as timed_out,
  0 as last_stage from marked)"""
)

QUEUE_SQL = (
    LOG_SQL
    + """, queue_log as (select * replace (
  case when success is null and k % 2 = 0 then -1 else 0 end as last_stage,
  case when success is null and k % 2 = 0 then true else success end as success) from request_log)"""
)

TURNS_SQL = """turns as (select conv_id, concat(conv_id, '-', turn // 1024) as request_id,
  cast(turn % 1024 as int) as pos, text as input from conversations)"""

REQUESTS_SQL = (
    TURNS_SQL
    + """, requests as (select conv_id, request_id, list(input order by pos) as inputs from turns
  group by conv_id, request_id)"""
)

RAW_SQL = (
    TURNS_SQL
    + """, good as (select conv_id, request_id,
  cast(to_json(list(length(input) order by pos)) as varchar) as p from turns
  group by conv_id, request_id),
raw_requests as (select conv_id, request_id,
  case conv_id % 8 when 0 then 'null' when 1 then '[]' when 2 then '"text"'
    when 3 then concat('{"data":', p, '}') when 4 then '{"x":1}' when 5 then 'not json'
    else p end as payload,
  case when conv_id % 16 = 6 then 'pickle' when conv_id % 16 = 14 then 'xml'
    when conv_id % 16 = 7 then 'msgpack' else 'json' end as input_type from good)"""
)

TIMES_SQL = (
    MARKED_SQL
    + """, batch_times as (select queue_key, cast(pow(2, k % 11) as bigint) as batch_size,
  value as ms from marked)"""
)

CALLS_SQL = (
    MARKED_SQL
    + f""", calls as (select queue_key as connection_id, request_id as seq, value as latency_ms,
  event_type <> 'error' as success, case when event_type = 'error' then concat('k', k) end as error,
  received_us < {WARMUP_END_US} as is_warmup from marked)"""
)

SAMPLES_SQL = (
    MARKED_SQL
    + """, samples as (select case when queue_key % 4 = 0 then 'loop' else 'rest' end as role,
  received_us // 3600000000 * 3600 as ts, queue_key as pid, value as cpu, k * 1024 as ram_kb
  from marked),
gpu as (select ts, pid, ram_kb // 1024 as util, ram_kb // 1024 * 10 as mem from samples
  where pid % 3 = 0)"""
)


def pack_sql(name: str, source: str, batch_size: int, wait_us: int, key: str = "queue_key") -> str:
    """Recursive expressions that pack ``source`` row by row; needs WITH RECURSIVE."""
    closes = f"p.len > 0.8 * {batch_size} or q.received_us - p.opened >= {wait_us}"
    return f"""{name}_q as (select *, row_number() over (
    partition by {key} order by received_us, request_id) as rn from {source}),
{name} as (
  select {key}, request_id, rn, 0 as batch_id, 0 as batch_offset, n_inputs as len,
    received_us as opened, n_inputs from {name}_q where rn = 1
  union all
  select q.{key}, q.request_id, q.rn,
    case when {closes} then p.batch_id + 1 else p.batch_id end,
    case when {closes} then 0 else p.len end,
    case when {closes} then q.n_inputs else p.len + q.n_inputs end,
    case when {closes} then q.received_us else p.opened end, q.n_inputs
  from {name} p join {name}_q q on q.{key} = p.{key} and q.rn = p.rn + 1)"""
