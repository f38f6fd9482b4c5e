"""Plans: batched inference (group D), tuning (group E) and stage functions (group L)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuemill.functions.scalars import fill_batch, l2_normalize, max_wait_seconds
from queuemill.operators import inference as I
from queuemill.operators import packing as P
from queuemill.operators import recipes, tuning
from queuemill.plans.registry import query
from queuemill.plans.views import (
    LOG_SQL,
    MARKED_SQL,
    REQUESTS_SQL,
    SIX_HOURS_US,
    TIMES_SQL,
    TURNS_SQL,
    Tables,
    pack_sql,
    rounded,
)
from queuemill.session import shuffle_partitions

BATCH = 32
SECOND_BATCH = 16


def text_length(inputs: list, batch_size: int = 1) -> list:
    return [len(text) for text in inputs]


def double_unless_99(inputs: list, batch_size: int = 1) -> list:
    if 99 in inputs:
        raise ValueError("99 cannot be doubled")
    return [x * 2 for x in inputs]


def add_one_unless_14(inputs: list, batch_size: int = 1) -> list:
    if 14 in inputs:
        raise ValueError("14 has no successor here")
    return [x + 1 for x in inputs]


def word_length_profile(inputs: list, batch_size: int = 1) -> list:
    """A small stand-in for an embedding model: how many words there are of each length mod 8."""
    vectors = []
    for text in inputs:
        vector = [0.0] * 8
        for word in text.split(" "):
            vector[len(word) % 8] += 1.0
        vectors.append(vector)
    return vectors


LENGTH = I.Stage.from_function(text_length, "int", BATCH)
DOUBLE = I.Stage.from_function(double_unless_99, "int", BATCH)
SUCCESSOR = I.Stage.from_function(add_one_unless_14, "int", SECOND_BATCH)
PROFILE = I.Stage.from_function(word_length_profile, "array<double>", 16)


@query("d1_flatten_inputs", f"with {TURNS_SQL} select request_id, pos, input from turns")
def flatten_inputs(t: Tables) -> DataFrame:
    return I.flatten_inputs(t.requests.drop("conv_id"))


@query(
    "d2_pack_batches",
    f"""with recursive {LOG_SQL}, {pack_sql('p', 'request_log', BATCH, SIX_HOURS_US)}
      select queue_key, request_id, cast(batch_id as bigint) as batch_id,
      cast(batch_offset as bigint) as batch_offset from p""",
)
def pack_batches(t: Tables) -> DataFrame:
    log = t.request_log.select("queue_key", "request_id", "received_us", "n_inputs")
    packed = P.pack_batches(log, BATCH, SIX_HOURS_US)
    return packed.select("queue_key", "request_id", "batch_id", "batch_offset")


@query(
    "d2_pack_hot_queue",
    f"""with recursive {LOG_SQL}, lanes as (select *, case when queue_key % 3 = 0 then 0 else queue_key
      end as lane from request_log), {pack_sql('p', 'lanes', BATCH, SIX_HOURS_US, 'lane')}
      select lane, request_id, cast(batch_id as bigint) as batch_id,
      cast(batch_offset as bigint) as batch_offset from p""",
)
def pack_hot_queue(t: Tables) -> DataFrame:
    """One queue takes a third of all requests and is packed in segments."""
    lane = F.when(F.col("queue_key") % 3 == 0, 0).otherwise(F.col("queue_key")).cast("bigint")
    log = t.request_log.select(lane.alias("lane"), "request_id", "received_us", "n_inputs")
    packed = P.pack_batches(log, BATCH, SIX_HOURS_US, key="lane")
    return packed.select("lane", "request_id", "batch_id", "batch_offset")


@query(
    "d3_slice_batches",
    """with words as (select doc_id, string_split(text, ' ') as w from documents),
    slices as (select doc_id, i as chunk_id, w[i * 32 + 1 : i * 32 + 32] as item
      from words, unnest(range(0, cast(ceil(len(w) / 32.0) as bigint))) as u(i))
    select doc_id, cast(chunk_id as int) as chunk_id, cast(len(item) as int) as n_items,
      md5(array_to_string(item, ' ')) as digest from slices""",
)
def slice_batches(t: Tables) -> DataFrame:
    words = t.read("documents").select("doc_id", F.split("text", " ").alias("words"))
    slices = P.slice_batches(words, "words", BATCH)
    return slices.select(
        "doc_id", "chunk_id", F.size("item").alias("n_items"),
        F.md5(F.array_join("item", " ")).alias("digest"),
    )


@query(
    "d4_predict",
    f"with {TURNS_SQL} select request_id, pos, cast(length(input) as int) as output from turns",
)
def predict(t: Tables) -> DataFrame:
    return I.predict(t.turns, LENGTH).select("request_id", "pos", "output")


def isolated_sql(source: str) -> str:
    """Batches of ``source`` and whether 99 is among their inputs."""
    return (
        pack_sql("p", source, BATCH, SIX_HOURS_US)
        + f""", isolated as (select p.queue_key, p.request_id, p.batch_id, l.k, l.n_inputs,
    l.received_us, sum(p.n_inputs) over b as batch_inputs, bool_or(l.k = 99) over b as failed
    from p join {source} l using (request_id)
    window b as (partition by p.queue_key, p.batch_id))"""
    )


ISOLATED_SQL = LOG_SQL + ", " + isolated_sql("request_log")


@query(
    "d5_predict_isolated",
    f"""with recursive {ISOLATED_SQL} select request_id, cast(batch_id as bigint) as batch_id,
      cast(batch_inputs as bigint) as batch_inputs, not failed as success,
      case when failed then '99 cannot be doubled' end as error,
      cast(case when not failed then k * 2 * n_inputs end as bigint) as output_sum from isolated""",
)
def predict_isolated(t: Tables) -> DataFrame:
    scored = I.predict_isolated(t.numbered_requests, DOUBLE, SIX_HOURS_US)
    return _with_output_sum(scored).select(
        "request_id", F.col("stage0_batch_id").alias("batch_id"),
        F.col("stage0_batch_inputs").alias("batch_inputs"), "success", "error", "output_sum",
    )


def _with_output_sum(scored: DataFrame) -> DataFrame:
    total = F.aggregate("outputs", F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    return scored.withColumn("output_sum", total)


@query(
    "d6_scatter_results",
    f"""with {TURNS_SQL} select request_id, array_to_string(list(length(input) order by pos), ',')
      as outputs, cast(count(*) as int) as n_outputs from turns group by request_id""",
)
def scatter_results(t: Tables) -> DataFrame:
    scattered = I.scatter_results(I.predict(t.turns, LENGTH).select("request_id", "pos", "output"))
    return scattered.select(
        "request_id",
        F.array_join(F.transform("outputs", lambda x: x.cast("string")), ",").alias("outputs"),
        F.size("outputs").alias("n_outputs"),
    )


def chained_sql(source: str) -> str:
    """Both Python stages over ``source``; the second one packs what the first one left over."""
    return (
        isolated_sql(source)
        + """, second as (select queue_key, request_id, received_us, n_inputs, k from isolated
    where not failed), """
        + pack_sql("p2", "second", SECOND_BATCH, SIX_HOURS_US)
        + """, isolated2 as (select p2.request_id, p2.batch_id, bool_or(s.k = 7) over
    (partition by p2.queue_key, p2.batch_id) as failed from p2 join second s using (request_id)),
  chained as (select i.request_id, i.k, i.n_inputs, i.failed as failed0, j.failed as failed1,
    i.batch_id as batch0, j.batch_id as batch1 from isolated i left join isolated2 j using (request_id))
  select request_id, not failed0 and not coalesce(failed1, false) as success,
    cast(case when failed0 then 0 when failed1 then 1 else 2 end as int) as last_stage,
    cast(batch0 as bigint) as stage0_batch_id, cast(batch1 as bigint) as stage1_batch_id,
    cast(case when not failed0 and not failed1 then (k * 2 + 1) * 10 * n_inputs end as bigint)
      as output_sum from chained"""
    )


def chain_of_three(requests: DataFrame, spread: bool) -> DataFrame:
    tenfold = I.Stage.from_expression(lambda x: x * 10, "int", "tenfold")
    scored = I.chain(requests, [DOUBLE, SUCCESSOR, tenfold], SIX_HOURS_US, spread=spread)
    return _with_output_sum(scored).select(
        "request_id", "success", "last_stage", "stage0_batch_id", "stage1_batch_id", "output_sum"
    )


@query("d7_chain", f"with recursive {LOG_SQL}, {chained_sql('request_log')}")
def chain(t: Tables) -> DataFrame:
    return chain_of_three(t.numbered_requests, spread=False)


@query(
    "d7_chain_hot_queue",
    f"""with recursive {LOG_SQL}, lanes as (select * replace (
      case when queue_key % 3 = 0 then 0 else queue_key end as queue_key) from request_log),
      {chained_sql('lanes')}""",
)
def chain_hot_queue(t: Tables) -> DataFrame:
    """One queue takes a third of all requests; its batches are spread over all tasks."""
    lane = F.when(F.col("queue_key") % 3 == 0, 0).otherwise(F.col("queue_key"))
    return chain_of_three(t.numbered_requests.withColumn("queue_key", lane), spread=True)


@query(
    "d8_order_stages",
    f"""with {MARKED_SQL}, files as (select distinct queue_key as recipe, case
      when k % 20 = 3 and queue_key % 4 = 0 then 'predictor.py' when k % 10 = 4 then 'predictor_x.py'
      when k % 10 = 5 then 'helper.py' else concat('predictor_', k, '.py') end as name from marked),
    numbered as (select *, case when name = 'predictor.py' then 0
      else try_cast(nullif(regexp_extract(name, '^predictor_([0-9]+)\\.(.*\\.)?py$', 1), '') as bigint) end
      as n, bool_or(name = 'predictor.py') over (partition by recipe) as alone from files)
    select recipe, name, cast(row_number() over (partition by recipe order by n) - 1 as int) as sequence
      from numbered where n is not null and (not alone or name = 'predictor.py')""",
)
def order_stages(t: Tables) -> DataFrame:
    k = F.col("k")
    name = (
        F.when((k % 20 == 3) & (F.col("queue_key") % 4 == 0), "predictor.py")
        .when(k % 10 == 4, "predictor_x.py")
        .when(k % 10 == 5, "helper.py")
        .otherwise(F.concat(F.lit("predictor_"), k, F.lit(".py")))
    )
    files = t.marked_events.select(F.col("queue_key").alias("recipe"), name.alias("name"))
    return recipes.order_stages(files)


@query(
    "d9_tag_stages",
    f"with {TURNS_SQL} select request_id, pos, 2 as outer_stage, 1 as inner_stage, input as value from turns",
)
def tag_stages(t: Tables) -> DataFrame:
    first = I.tag_stage(1, "string")
    second = I.tag_stage(2, first.returns)
    tagged = I.chain(t.requests, [I.identity_stage(), first, second])
    return tagged.select("request_id", F.posexplode("outputs").alias("pos", "o")).select(
        "request_id", "pos", F.col("o.stage").alias("outer_stage"),
        F.col("o.value.stage").alias("inner_stage"), F.col("o.value.value").alias("value"),
    )


@query(
    "d10_infer_output_schema",
    f"""with {REQUESTS_SQL}, example as (select inputs from requests order by conv_id limit 1)
    select cast(0 as int) as stage, case when len(inputs) > 0 then 'bigint' end as type from example
    union all select 1, 'array<double>' from example""",
)
def infer_output_schema(t: Tables) -> DataFrame:
    """The first conversation is the example: text lengths, then a vector of each."""

    def vector(inputs: list, batch_size: int = 1) -> list:
        return [[float(x), 1.0] for x in inputs]

    return I.output_types(t.requests.orderBy("conv_id").limit(1), [text_length, vector])


@query(
    "d11_embed_text",
    """with words as (select doc_id, unnest(string_split(text, ' ')) as word from documents),
    counted as (select doc_id, length(word) % 8 as pos, count(*) as n from words group by all),
    norms as (select doc_id, sqrt(sum(n * n)) as norm from counted group by doc_id)
    select norms.doc_id, cast(u.d as int) as pos, round(coalesce(c.n, 0) / norms.norm, 6) as x
      from norms cross join (select unnest(range(0, 8)) as d) u
      left join counted c on c.doc_id = norms.doc_id and c.pos = u.d""",
)
def embed_text(t: Tables) -> DataFrame:
    documents = t.read("documents").select("doc_id", "text")
    embedded = I.embed_text(documents, PROFILE, tasks=shuffle_partitions(t.spark))
    return embedded.select("doc_id", F.posexplode("embedding").alias("pos", "x")).select(
        "doc_id", "pos", F.round("x", 6).alias("x")
    )


@query(
    "d12_l2_normalize",
    """with cells as (select vec_id, unnest(range(0, len(embedding))) as pos,
      unnest(embedding) as x from embeddings),
    norms as (select vec_id, sqrt(sum(cast(x as double) * cast(x as double))) as norm from cells
      group by vec_id)
    select vec_id, cast(pos as int) as pos, round(cast(x as double) / norm, 6) as x
      from cells join norms using (vec_id)""",
)
def normalize(t: Tables) -> DataFrame:
    unit = t.read("embeddings").select("vec_id", l2_normalize(F.col("embedding")).alias("unit"))
    return unit.select("vec_id", F.posexplode("unit").alias("pos", "x")).select(
        "vec_id", "pos", F.round("x", 6).alias("x")
    )


TUNED_SQL = (
    TIMES_SQL
    + """, measured as (select queue_key, batch_size, avg(ms) / batch_size as time_per_example
    from batch_times group by queue_key, batch_size),
  walked as (select *, coalesce(time_per_example >= lag(time_per_example) over w, false) as slower
    from measured window w as (partition by queue_key order by batch_size)),
  stopped as (select *, sum(cast(slower as int)) over (partition by queue_key order by batch_size)
    as n from walked),
  tuned as (select queue_key, max(batch_size) as optimal_batch_size,
    min(time_per_example) as time_per_example from stopped where n = 0 group by queue_key)"""
)


def tuned(t: Tables) -> DataFrame:
    return tuning.choose_batch_size(tuning.time_per_example(t.batch_times))


@query(
    "d13_stage_registry",
    f"""with {TUNED_SQL}, stages as (select distinct queue_key, 'predictor.py' as predictor_name,
      0 as predictor_sequence from marked)
    select queue_key, predictor_name, predictor_sequence, optimal_batch_size,
      round(time_per_example + 1e-9, 6) as time_per_example, 'running' as status,
      round(greatest(0.003, time_per_example / 1000 * 0.51) + 1e-9, 6) as max_wait_seconds
      from stages left join tuned using (queue_key)""",
)
def stage_registry(t: Tables) -> DataFrame:
    stages = (
        t.marked_events.select("queue_key").distinct().selectExpr(
            "queue_key", "'predictor.py' as predictor_name", "0 as predictor_sequence"
        )
    )
    return rounded(recipes.stage_registry(stages, tuned(t))).select(
        "queue_key", "predictor_name", "predictor_sequence", "optimal_batch_size",
        "time_per_example", "status", "max_wait_seconds",
    )


BATCH_LOG_SQL = (
    LOG_SQL
    + ", "
    + pack_sql("p", "request_log", BATCH, SIX_HOURS_US)
    + """, batch_log as (select p.queue_key, cast(p.batch_id as bigint) as batch_id,
    count(*) as n_requests, cast(sum(p.n_inputs) as bigint) as predicted_in_batch_of,
    min(l.stage0_received_us) as started_us, max(l.stage0_predicted_us) as ended_us,
    bool_and(coalesce(l.success, false)) as batch_success
    from p join request_log l using (request_id) group by p.queue_key, p.batch_id)"""
)


def batch_log_of(t: Tables) -> DataFrame:
    log = t.request_log.select(
        "queue_key", "request_id", "received_us", "n_inputs", "stage0_received_us",
        "stage0_predicted_us", "success",
    )
    packed = P.pack_batches(log, BATCH, SIX_HOURS_US)
    return P.batch_log(
        packed, P.PackRule(BATCH), "stage0_received_us", "stage0_predicted_us", "success"
    )


@query("d14_batch_log", f"with recursive {BATCH_LOG_SQL} select * from batch_log")
def batch_log(t: Tables) -> DataFrame:
    return batch_log_of(t)


@query(
    "e1_time_per_example",
    f"""with {TUNED_SQL} select queue_key, batch_size, round(time_per_example + 1e-9, 6) as time_per_example
      from measured""",
)
def time_per_example(t: Tables) -> DataFrame:
    return rounded(tuning.time_per_example(t.batch_times))


@query(
    "e2_choose_batch_size",
    f"""with {TUNED_SQL} select queue_key, optimal_batch_size,
      round(time_per_example + 1e-9, 6) as time_per_example from tuned""",
)
def choose_batch_size(t: Tables) -> DataFrame:
    return rounded(tuned(t))


@query(
    "e3_max_wait",
    f"""with {TUNED_SQL} select queue_key,
      round(greatest(0.003, time_per_example / 1000 * 0.51) + 1e-9, 6) as max_wait_seconds from tuned""",
)
def max_wait(t: Tables) -> DataFrame:
    wait = max_wait_seconds(F.col("time_per_example") / 1000)
    return rounded(tuned(t).select("queue_key", wait.alias("max_wait_seconds")))


@query(
    "e4_fill_batch",
    f"""with {REQUESTS_SQL} select request_id, cast(i as int) as pos, inputs[i % len(inputs) + 1] as input
      from requests cross join (select unnest(range(0, 20)) as i)""",
)
def fill(t: Tables) -> DataFrame:
    filled = t.requests.select("request_id", fill_batch(F.col("inputs"), 20).alias("inputs"))
    return I.flatten_inputs(filled)


@query(
    "l1_stage_from_function",
    f"""with {LOG_SQL} select request_id, cast(round(sqrt(k) * n_inputs, 6) as double) as output_sum
      from request_log""",
)
def stage_from_function(t: Tables) -> DataFrame:
    roots = I.Stage.from_loader(load_square_root, "double", BATCH)
    scored = I.chain_as_read(t.numbered_requests, [roots])
    total = F.aggregate("outputs", F.lit(0.0), lambda acc, x: acc + x)
    return scored.select("request_id", F.round(total, 6).alias("output_sum"))


def load_square_root():
    """Built once per worker, as a model would be."""

    def predictor(inputs: list, batch_size: int = 1) -> list:
        return [math.sqrt(x) for x in inputs]

    return predictor


@query(
    "l2_stage_from_expression",
    f"with {TURNS_SQL} select request_id, pos, concat('re: ', input) as output from turns",
)
def stage_from_expression(t: Tables) -> DataFrame:
    reply = I.Stage.from_expression(lambda x: F.concat(F.lit("re: "), x), "string", "reply")
    return I.predict(t.turns, reply).select("request_id", "pos", "output")
