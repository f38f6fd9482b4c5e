"""Stages, chains and failure per batch."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from queuemill.operators import inference as I
from queuemill.plans.stages import DOUBLE, SUCCESSOR
from queuemill.plans.views import SIX_HOURS_US


def too_few(inputs, batch_size=1):
    return inputs[1:]


def fail_always(inputs, batch_size=1):
    raise RuntimeError("no model")


def plus_one(inputs, batch_size=1):
    return [x + 1 for x in inputs]


def batch_length(inputs, batch_size=1):
    return [len(inputs)] * len(inputs)


@pytest.fixture
def requests(spark):
    return spark.createDataFrame(
        [(q, f"{q}-{i}", i, [q * 100 + i + j for j in range(i % 4 + 1)]) for q in range(3) for i in range(50)],
        "queue_key int, request_id string, received_us bigint, inputs array<int>",
    )


def test_identity_keeps_inputs_and_order(requests):
    stage = I.Stage.from_function(lambda inputs, batch_size=1: inputs, "int", 8)
    scored = I.chain(requests, [stage])
    assert scored.count() == 150
    assert scored.filter("outputs != inputs or not success").count() == 0


def test_tags_nest_with_the_last_stage_outermost(requests):
    first = I.tag_stage(1, "int")
    second = I.tag_stage(2, first.typed().returns)
    row = I.chain(requests, [first, second]).filter("request_id = '1-0'").first()
    assert row.outputs[0].asDict(True) == {"stage": 2, "value": {"stage": 1, "value": 100}}


def test_wrong_length_ends_the_job(requests):
    with pytest.raises(Exception, match="outputs for"):
        I.chain(requests, [I.Stage.from_function(too_few, "int", 8)]).collect()
    with pytest.raises(Exception, match="outputs for"):
        I.predict(I.flatten_inputs(requests), I.Stage.from_function(too_few, "int", 8)).collect()


def test_failed_requests_pass_later_stages_by(requests):
    stages = [
        I.Stage.from_function(plus_one, "int", 8),
        I.Stage.from_function(fail_always, "int", 8),
        I.Stage.from_function(plus_one, "int", 8),
    ]
    scored = I.chain(requests, stages)
    assert scored.filter("success or last_stage <> 1 or outputs is not null").count() == 0
    assert scored.filter("error <> 'no model' or stage2_batch_id is not null").count() == 0


def test_batches_seen_by_the_function_are_those_logged(requests):
    scored = I.chain(requests, [I.Stage.from_function(batch_length, "int", 8)])
    assert scored.filter("exists(outputs, x -> x <> stage0_batch_inputs)").count() == 0
    log = I.stage_batch_log(scored)
    assert log.agg(F.sum("predicted_in_batch_of")).first()[0] == requests.select(
        F.sum(F.size("inputs"))
    ).first()[0]


def test_hot_queues_give_the_same_answers(tables):
    hot_tables = tables.numbered_requests.withColumn(
        "queue_key", F.when(F.col("queue_key") % 3 == 0, 0).otherwise(F.col("queue_key"))
    )
    columns = ["request_id", "success", "last_stage", "stage0_batch_id", "stage1_batch_id", "outputs"]
    stages = [DOUBLE, SUCCESSOR, I.Stage.from_expression(lambda x: x * 10, "int")]
    one = I.chain(hot_tables, stages, SIX_HOURS_US, spread=False).select(columns)
    spread = I.chain(hot_tables, stages, SIX_HOURS_US, spread=True).select(columns)
    assert one.exceptAll(spread).count() == 0 and spread.exceptAll(one).count() == 0
    assert spread.count() == hot_tables.count()


def test_counted_hot_queues_are_spread_by_default(tables, monkeypatch):
    monkeypatch.setattr(I, "HOT_REQUESTS", 10)
    lane = F.when(F.col("queue_key") % 3 != 0, F.col("queue_key"))  # the hot queue has no name
    requests = tables.numbered_requests.withColumn("queue_key", lane)
    total = requests.count()
    shares = {r[0]: r[1] for r in requests.groupBy("queue_key").count().collect()}
    hot = [r[0] for r in I.hot_queues(requests, "queue_key", 8).collect()]
    assert set(hot) == {q for q, n in shares.items() if 8 * n > total and n > 10} and None in hot
    assert I.hot_queues(requests, "queue_key", 8, least=total).isEmpty()
    stages = [DOUBLE, SUCCESSOR, I.Stage.from_expression(lambda x: x * 10, "int")]
    columns = ["request_id", "success", "last_stage", "stage0_batch_id", "stage1_batch_id", "outputs"]
    one = I.chain(requests, stages, SIX_HOURS_US, spread=False).select(columns)
    default = I.chain(requests, stages, SIX_HOURS_US).select(columns)
    assert one.exceptAll(default).count() == 0 and default.exceptAll(one).count() == 0


def test_not_admitted_rows_pass_by(requests):
    scored = I.chain(
        requests, [I.Stage.from_function(plus_one, "int", 8)], admit=F.col("received_us") % 2 == 0
    )
    refused = scored.filter("received_us % 2 = 1")
    assert refused.count() == 75
    assert refused.filter("success or last_stage <> -1 or outputs is not null").count() == 0


def test_scatter_undoes_flatten(requests):
    flat = I.flatten_inputs(requests).select("request_id", "pos", F.col("input").alias("output"))
    back = I.scatter_results(flat.repartition(5)).join(requests, "request_id")
    assert back.filter("outputs = inputs").count() == 150


def test_output_types_follow_from_the_example():
    def length(inputs, batch_size=1):
        return [len(x) for x in inputs]

    def vector(inputs, batch_size=1):
        return [[float(x)] * 3 for x in inputs]

    assert I.infer_output_schema(["a", "bcd"], [length, vector]) == [
        T.LongType(), T.ArrayType(T.DoubleType(), True),
    ]


def test_model_is_loaded_by_the_task(requests):
    def load():
        table = {x: -x for x in range(1000)}
        return lambda inputs, batch_size=1: [table[x] for x in inputs]

    scored = I.chain_as_read(requests, [I.Stage.from_loader(load, "int", 16)])
    assert scored.filter("outputs != transform(inputs, x -> -x)").count() == 0


def test_packing_and_predicting_share_one_shuffle(requests):
    stages = [I.Stage.from_function(plus_one, "int", 8), I.Stage.from_function(plus_one, "int", 4)]
    plan = I.chain(requests, stages)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_tuple_answers_become_structs(requests):
    def tagged(inputs, batch_size=1):
        return [(1, x) for x in inputs]

    def tagged_again(inputs, batch_size=1):
        return [(2, x) for x in inputs]

    first, second = I.infer_output_schema([5], [tagged, tagged_again])
    assert second.simpleString() == "struct<_1:bigint,_2:struct<_1:bigint,_2:bigint>>"
    scored = I.chain(requests, [I.Stage.from_function(tagged, first, 8)])
    assert scored.filter("outputs._2 != inputs or exists(outputs, o -> o._1 != 1)").count() == 0


def test_numpy_answers(spark):
    def encode(inputs, batch_size=1):
        import numpy as np

        return np.asarray([[len(x), 1.0, 0.0] for x in inputs], dtype="float32")

    df = spark.createDataFrame([(i, "x" * i) for i in range(20)], "id int, text string")
    stage = I.Stage.from_function(encode, "array<float>", 4)
    rows = I.embed_text(df, stage).orderBy("id").collect()
    for row in rows:
        assert sum(x * x for x in row.embedding) == pytest.approx(1.0)
        assert row.embedding[0] == pytest.approx(row.id / (row.id**2 + 1) ** 0.5, rel=1e-6)


@pytest.mark.parametrize("spread", [False, True])
def test_repeated_and_missing_ids_keep_their_rows(spark, spread):
    rows = [(i % 20 if i % 5 else None, 0, i, [i, i + 100]) for i in range(40)]
    df = spark.createDataFrame(rows, "request_id int, queue_key int, received_us bigint, inputs array<int>")
    stages = [I.Stage.from_function(plus_one, "int", 8), I.Stage.from_function(plus_one, "int", 4)]
    scored = I.chain(df, stages, spread=spread)
    assert scored.count() == 40
    assert scored.filter("outputs != transform(inputs, x -> x + 2) or outputs is null").count() == 0


@pytest.mark.parametrize("run", ["one pass", "spread", "as read"])
def test_requests_without_inputs(spark, run):
    rows = [(1, [1]), (2, []), (3, None), (4, [2, 3])]
    df = spark.createDataFrame(rows, "request_id int, inputs array<int>").selectExpr(
        "*", "0 as queue_key", "cast(request_id as bigint) as received_us"
    )
    stages = [I.Stage.from_function(plus_one, "int", 8)]
    scored = I.chain_as_read(df, stages) if run == "as read" else I.chain(df, stages, spread=run == "spread")
    got = {r.request_id: (r.success, r.outputs, r.error) for r in scored.collect()}
    assert got == {1: (True, [2], None), 2: (True, [], None), 3: (False, None, "no inputs"), 4: (True, [3, 4], None)}


def test_answers_of_a_wrong_type_fail_their_batch(requests):
    def odd(inputs, batch_size=1):
        return ["text" if 5 in inputs else x for x in inputs]

    scored = I.chain(requests, [I.Stage.from_function(odd, "int", 8)])
    assert scored.filter("not success").count() > 0 and scored.filter("success").count() > 0
    assert scored.filter("not success and error is null").count() == 0


def test_building_a_plan_runs_nothing(requests):
    def never(inputs, batch_size=1):
        raise AssertionError("called")

    group = requests.sparkSession.sparkContext
    group.setJobGroup("plan-only", "no job may start")
    I.chain(requests, [I.Stage.from_function(never, "int", 8)])._jdf.queryExecution().executedPlan()
    assert not group.statusTracker().getJobIdsForGroup("plan-only")
    group.setJobGroup("", "")
