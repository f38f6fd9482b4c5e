"""The stored table against the verbs on plain tables, and what its plans read and move."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from queuemill.operators import stored, table
from queuemill.session import scratch_path

BUCKETS = 8


def rows_of(df):
    return sorted(tuple(r) for r in df.select("request_id", "queue_key", "success", "last_stage").collect())


def make(spark, n=400, buckets=BUCKETS):
    df = spark.range(n).select(
        F.col("id").alias("request_id"), (F.col("id") % 7).alias("queue_key"),
        F.when(F.col("id") % 3 > 0, F.col("id") % 2 == 0).alias("success"), (F.col("id") % 4 - 1).cast("int").alias("last_stage"),
    )
    path = scratch_path(spark, "stored")
    return df, stored.create(df, f"requests_{uuid.uuid4().hex}", buckets, path=path), path


@pytest.fixture()
def no_broadcast(spark):
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {name: spark.conf.get(name, None) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def above_scan(text: str, table_name: str) -> list[str]:
    """Operators between the stored table's scan and the join above it, from the plan's tree."""
    lines = text.split("\n")
    (at,) = [i for i, line in enumerate(lines) if "FileScan" in line and table_name in line]
    depth = len(lines[at]) - len(lines[at].lstrip(" :+-*()0123456789"))
    found = []
    for line in reversed(lines[:at]):
        here = len(line) - len(line.lstrip(" :+-*()0123456789"))
        if here < depth:
            depth = here
            found.append(line.lstrip(" :+-*()0123456789"))
            if "Join" in line:
                return found
    return found


def test_few_ids_read_few_files(spark):
    df, t, _ = make(spark)
    found = t.get([3, 17, 10_000], ["queue_key"])
    assert sorted(map(tuple, found.collect())) == [(3, 3), (17, 3)]
    text = plan(t.get([3]))
    assert "PartitionFilters: [isnotnull(slot" in text and "EqualTo(request_id,3)" in text and "Exchange" not in text
    assert len(t.get([3]).inputFiles()) == 1 and len(t.read().inputFiles()) == BUCKETS
    assert t.get([]).count() == 0


def test_lookup_by_table_moves_only_the_ids(spark, no_broadcast):
    df, t, _ = make(spark)
    ids = spark.range(0, 800, 5).select(F.col("id").alias("request_id"))
    found = t.get_all(ids)
    assert rows_of(found) == rows_of(table.get(df, ids))
    text = plan(t.get_all(ids))
    assert text.count("Exchange") == 1 and not any("Exchange" in line for line in above_scan(text, t.name))


def test_merge_moves_only_the_updates(spark, no_broadcast):
    df, t, _ = make(spark)
    updates = spark.createDataFrame([(3, True, 1), (3, False, 2), (5, True, 1), (1000, True, 1)], "request_id bigint, success boolean, v int")
    moved = updates.repartition(BUCKETS, "request_id")
    text = plan(table.upsert(t._slots(range(BUCKETS)), moved, F.col("v")))
    assert text.count("Exchange") == 1 and not any("Exchange" in line for line in above_scan(text, t.name))


def test_merge_equals_upsert_and_may_be_repeated(spark):
    df, t, path = make(spark)
    updates = spark.createDataFrame(
        [(3, True, 1), (3, False, 2), (5, True, 1), (1000, True, None)], "request_id bigint, success boolean, v int"
    )
    files = set(t.read().inputFiles())
    touched = set(t._distinct(updates))
    t.merge(updates, F.col("v"))
    wanted = rows_of(table.upsert(df, updates, F.col("v")))
    assert rows_of(t.read()) == wanted
    kept = files & set(t.read().inputFiles())
    assert {int(f.split("slot=")[1].split("/")[0]) for f in kept} == set(range(BUCKETS)) - touched
    t.merge(updates, F.col("v"))
    assert rows_of(t.read()) == wanted and len(t.read().inputFiles()) == BUCKETS
    t.merge(updates.limit(0), F.col("v"))
    again = stored.open_stored(spark, f"again_{uuid.uuid4().hex}", path, BUCKETS)
    assert rows_of(again.read()) == wanted and [r.success for r in again.get([1000]).collect()] == [True]
    assert len(again.get([3]).inputFiles()) == 1


def test_keys_must_be_known(spark):
    _, t, _ = make(spark, 10)
    with pytest.raises(ValueError):
        t.merge(spark.createDataFrame([(None, True, 1)], "request_id bigint, success boolean, v int"), F.col("v"))


def test_delete(spark):
    df, t, _ = make(spark, 40)
    query = {"queue_key": 3}
    t.delete(query)
    assert rows_of(t.read()) == rows_of(table.delete(df, query))
    t.delete({"request_id": {"$gte": 0}})
    assert t.read().count() == 0
    t.merge(df.limit(3).withColumn("v", F.lit(1)), F.col("v"))
    assert t.read().count() == 3
    t.delete({"request_id": -1})
    assert t.read().count() == 3


def test_epochs(spark):
    """A stream's epochs are merged; one that runs twice changes nothing."""
    df, t, _ = make(spark, 50)
    merge = t.merge_epochs(lambda: F.col("v"))
    epochs = [
        spark.createDataFrame([(i, bool(e % 2), 10 * e + i) for i in range(e * 10, e * 10 + 20)], "request_id bigint, success boolean, v int")
        for e in range(4)
    ]
    wanted = df
    for number, rows in enumerate(epochs):
        merge(rows, number)
        if number == 2:
            merge(rows, number)
        wanted = table.upsert(wanted, rows, F.col("v"))
    assert rows_of(t.read()) == rows_of(wanted)
