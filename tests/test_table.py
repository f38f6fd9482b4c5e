"""Predicates, verbs and life-cycle rules on small tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from queuemill.functions.match import match, no_match
from queuemill.operators import lifecycle as L
from queuemill.operators import metrics as M
from queuemill.operators import table as T
from queuemill.operators.ordering import global_index
from queuemill.session import scratch_path


@pytest.fixture(scope="module")
def stored_log(spark, tables):
    path = scratch_path(spark, "log")
    tables.request_log.write.parquet(path)
    return spark.read.parquet(path)


def pushed(df) -> str:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[plan.index("PushedFilters") :].split("\n")[0]


def test_not_equal_keeps_null_rows(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, success boolean")
    assert [r.id for r in df.filter(match({"success": {"$ne": True}})).collect()] == [2, 3]
    assert [r.id for r in df.filter(match({"success": None})).collect()] == [3]
    assert [r.id for r in df.filter(no_match({"id": {"$gt": 1}, "success": False})).collect()] == [1, 3]


def test_unknown_operator_is_an_error():
    with pytest.raises(ValueError, match="unknown operator"):
        match({"a": {"$regex": "x"}})


def test_search_is_pushed_into_the_scan(stored_log):
    found = T.search(stored_log, {"delivered_us": None, "n_inputs": {"$gte": 3}}, keys=["queue_key"])
    assert "IsNull(delivered_us)" in pushed(found)
    assert "GreaterThanOrEqual(n_inputs,3)" in pushed(found)


def test_metrics_read_only_the_window(stored_log):
    filters = pushed(M.window_metrics(stored_log, 1_706_659_200_000_000, 30))
    assert "Or(" in filters and "GreaterThan(received_us" in filters


def test_claim_limits_before_the_shuffle(stored_log):
    plan = L.claim(stored_log, 0, 3, 0)._jdf.queryExecution().executedPlan().toString()
    exchange = plan.index("Exchange")
    assert "WindowGroupLimit" in plan[:exchange] and "WindowGroupLimit" in plan[exchange:]


def test_claim_takes_the_oldest_and_upsert_stores_them(spark):
    log = spark.createDataFrame(
        [(i, i % 2, 100 - i, None, True, -1, None) for i in range(10)],
        "request_id int, queue_key int, received_us bigint, delivered_us bigint, success boolean, "
        "last_stage int, timed_out boolean",
    )
    claimed = L.claim(log, 0, 2, 500)
    assert sorted(r.request_id for r in claimed.collect()) == [6, 7, 8, 9]
    stored = T.upsert(log, claimed, F.lit(1))
    assert stored.count() == 10
    assert sorted(r.request_id for r in stored.filter("last_stage = 0").collect()) == [6, 7, 8, 9]
    assert L.claim(stored, 0, 2, 500).filter("request_id >= 6").count() == 0


def test_last_write_wins_also_for_a_much_written_key(spark):
    base = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "request_id int, v string, n int")
    writes = spark.range(5_000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") + 10).cast("int").alias("request_id"),
        F.col("id").cast("int").alias("n"), F.col("id").alias("version"),
    )
    merged = T.upsert(base, writes, F.col("version"))
    rows = {r.request_id: (r.v, r.n) for r in merged.filter("request_id < 10").collect()}
    assert rows == {1: ("a", 4998), 2: ("b", 0)}


def test_purge_keeps_what_is_not_delivered(spark):
    log = spark.createDataFrame(
        [(1, None), (2, 1_000_000), (3, 99_000_000)], "request_id int, delivered_us bigint"
    )
    assert [r.request_id for r in L.purge_delivered(log, 100_000_000).collect()] == [1, 3]


def test_averages_are_zero_without_requests_and_null_without_successes(spark):
    schema = (
        "received_us bigint, delivered_us bigint, success boolean, timed_out boolean, "
        "stage0_received_us bigint, stage0_predicted_us bigint"
    )
    name = "avg_total_time_per_req_for_reqs_in_last_x_seconds"
    nothing = spark.createDataFrame([], schema)
    assert M.window_metrics(nothing, 10**9, 30).first()[name] == 0.0
    failed = spark.createDataFrame([(10**9 - 10, 10**9 - 5, False, None, 1, 2)], schema)
    assert M.window_metrics(failed, 10**9, 30).first()[name] is None


def test_global_index_numbers_equal_values_across_segments(spark):
    df = spark.range(3_000).select((F.col("id") % 2).alias("v"), "id").repartition(5)
    rows = global_index(df, ["v", "id"], segments=15).orderBy("v", "id").collect()
    assert [r["index"] for r in rows] == list(range(3_000))


def test_upsert_versions(spark):
    base = spark.createDataFrame([(1, 5), (2, 6)], "request_id int, v int")
    writes = spark.createDataFrame(
        [(1, 7, None), (2, 1, None), (2, 8, 1), (2, 9, 1), (2, None, 0)], "request_id int, v int, version int"
    )
    merged = T.upsert(base, writes, F.col("version")).collect()
    assert sorted(tuple(r) for r in merged) == [(1, 7), (2, 9)]


@pytest.mark.parametrize("n", [3, 1_500])
def test_claims_of_any_number(spark, n):
    log = spark.range(4_000).selectExpr(
        "id as request_id", "cast(id % 2 as int) as queue_key", "id div 3 as received_us",
        "cast(null as bigint) as delivered_us", "true as success", "-1 as last_stage", "cast(null as boolean) as timed_out",
    )
    claimed = L.claim(log, 0, n, 10)
    wanted = {q: set(range(q, 4_000, 2)) for q in (0, 1)}
    for q, ids in wanted.items():
        got = {r.request_id for r in claimed.filter(F.col("queue_key") == q).collect()}
        assert got == set(sorted(ids)[:n])


def test_scratch_is_cleared(spark):
    from queuemill.session import clear_scratch, stored

    context = spark.sparkContext
    others, context._queuemill_scratch = getattr(context, "_queuemill_scratch", []), []
    table = stored(spark.range(5), "cleared")
    assert table.count() == 5 and clear_scratch(spark) == 1 and clear_scratch(spark) == 0
    with pytest.raises(Exception):
        table.collect()
    context._queuemill_scratch = others
