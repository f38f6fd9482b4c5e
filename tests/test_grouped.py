"""Keys that share a group: the rows of every key are those of the processor run for it alone, in fewer calls."""

from __future__ import annotations

from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import Row
from test_lives import KINDS, RULES, At, Held

from queuemill.operators.packing import PackRule
from queuemill.plans import states
from queuemill.session import scratch_path
from queuemill.streaming import grouped, lives, waiting

KEY = T.StructType([T.StructField("request_id", T.LongType())])


class Store:
    """The store of one group; every call is counted."""

    def __init__(self):
        self.calls, self.timers, self.held = Counter(), set(), {}

    def getListState(self, name, schema):
        return _Kept(self, name)

    getValueState = getListState

    def registerTimer(self, at):
        self.calls["timer"] += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls["timer"] += 1
        self.timers.remove(at)


class _Kept:
    def __init__(self, store, name):
        self.store, self.name = store, name

    def get(self):
        self.store.calls[self.name] += 1
        held = self.store.held.get(self.name)
        return iter(held or []) if self.name != "group_wake" else held

    def put(self, rows):
        assert rows
        self.store.calls[self.name] += 1
        self.store.held[self.name] = rows

    update = put

    def appendList(self, rows):
        self.store.calls[self.name] += 1
        self.store.held[self.name] = [*self.store.held.get(self.name, []), *rows]

    def clear(self):
        self.store.calls[self.name] += 1
        self.store.held.pop(self.name, None)


@pytest.fixture(autouse=True, scope="module")
def session(spark):
    """The driver reads the schemas of states with it."""


def run_group(triggers, delay_ms, store):
    """As ``test_lives.processed``, for rows of several requests."""
    processor, found, newest, mark = grouped.Grouped(lives.RequestLife(RULES), KEY, "EventTime"), [], 0, 0
    for rows in [*triggers, None, []]:
        processor.init(store)  # every trigger has a processor of its own
        if rows:
            found += processor.handleInputRows((3,), iter(rows), At(mark))
        for at in sorted(store.timers):
            if at < mark and at in store.timers:
                found += processor.handleExpiredTimer((3,), At(mark), At(at))
                store.timers.discard(at)
        newest = max([newest, *(r.at_us // 1000 for r in rows or [])])
        mark = max(mark, newest + 1000 if rows is None else newest - delay_ms)
    return found


def event(key, at_ms, kind, own=None):
    return Row(request_id=key, at_us=at_ms * 1000, stage=kind[1], kind=kind[0], success=kind[2], timeout_us=own)


@settings(max_examples=300, deadline=None)
@given(
    st.lists(st.tuples(st.integers(1, 5), st.integers(0, 260), st.sampled_from(KINDS), st.integers(0, 40)), min_size=1, max_size=25),
    st.integers(0, 120),
)
def test_each_key_as_if_alone(drawn, width):
    triggers: dict[int, list] = {}
    for key, at, kind, late in drawn:
        triggers.setdefault((at + late) // (width + 1), []).append(event(key, at, kind))
    ordered = [triggers[i] for i in sorted(triggers)]
    # one row far behind the others, of a request of its own, moves the watermark alike for all
    last = [event(9, 2000, KINDS[0])]
    store = Store()
    found = run_group([*ordered, last], 40 + width, store)
    for key in {d[0] for d in drawn}:
        alone = one_of(ordered, last, key, 40 + width)
        assert [tuple(r)[1:] for r in found if r.request_id == key] == alone
    assert store.held.get("group_timers") or not store.timers


def one_of(ordered, last, key, delay_ms):
    """The rows of ``key``, run in a group where the others have groups of their own."""
    held, processor, found, newest, mark = Held(), lives.RequestLife(RULES), [], 0, 0
    processor.init(held)
    for rows in [*ordered, last, None, []]:
        mine = [r for r in rows or [] if r.request_id == key]
        if mine:
            found += processor.handleInputRows((key,), iter(mine), At(mark))
        for at in sorted(held.timers):
            if at < mark and at in held.timers:
                found += processor.handleExpiredTimer((key,), At(mark), At(at))
                held.timers.discard(at)
        newest = max([newest, *(r.at_us // 1000 for r in rows or [])])
        mark = max(mark, newest + 1000 if rows is None else newest - delay_ms)
    return [tuple(r)[1:] for r in found]


def calls(requests):
    store = Store()
    triggers = [[event(i, 1, KINDS[0]) for i in range(requests)], [event(i, 9, KINDS[5]) for i in range(requests)]]
    found = run_group(triggers, 10, store)
    assert Counter(r.change for r in found) == {"updated": 2 * requests, "purged": requests}
    return sum(store.calls.values())


def test_calls_go_by_groups():
    assert calls(500) == calls(2) < 60


def test_odd_keys_are_grouped_as_in_spark():
    nan = float("nan")
    assert grouped.frozen((nan, None)) == grouped.frozen((float("nan"), None))
    assert grouped.frozen(({"a": [1, 2]},)) == grouped.frozen((Row(a=[1, 2]),))


def test_steps_have_equal_numbers_of_files(spark):
    """Every partition writes its own file, and a trigger still takes one step as a whole."""
    day = 24 * 3600 * 1_000_000
    rows = spark.range(4000, numPartitions=4).select(
        F.col("id").alias("request_id"), (states.FIRST_US + F.col("id") * 30 * day / 4000).cast("bigint").alias("received_us")
    )
    stream = states.arriving(rows, "received_us", "steps")
    out = scratch_path(spark, "steps-out")
    sink = stream.writeStream.foreachBatch(lambda part, epoch: part.write.parquet(f"{out}/epoch={epoch}"))
    sink = sink.option("checkpointLocation", scratch_path(spark, "steps-progress"))
    query = sink.trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.read.parquet(out)
    assert found.select("request_id").distinct().count() == found.count() == 4000
    late = states.LATENESS_SECONDS * 1_000_000
    spans = sorted(map(tuple, found.groupBy("epoch").agg(F.min("received_us"), F.max("received_us")).collect()))
    assert [s[0] for s in spans] == [0, 1, 2]
    assert all(b[1] > a[2] - late for a, b in zip(spans, spans[1:]))
    first = spark.read.parquet(f"{out}/epoch=0")
    assert first.rdd.getNumPartitions() > 1 or len(first.inputFiles()) > 1


def queue_rows(queues, at_us):
    return [Row(queue_key=q, received_us=at_us + q, request_id=i, n_inputs=2, _lane=0) for i in range(3) for q in queues]


def packed_queues(queues):
    """Batches by queue, and how often the store was called: two triggers, then a watermark behind them all."""
    names = ["queue_key", "received_us", "request_id", "n_inputs"]
    schema = T.StructType([T.StructField(name, T.LongType()) for name in names])
    layout = waiting.Layout(schema, 1, 2, 3)
    packer = waiting.QueuePacker(PackRule(5, 10_000), layout, [*names, "batch_id", "batch_offset"], "event")
    keys = T.StructType([T.StructField("queue_key", T.LongType()), T.StructField("_lane", T.IntegerType())])
    processor, store, found = grouped.Grouped(waiting._Cut(packer, len(names)), keys, "EventTime"), Store(), []
    for rows, mark in ((queue_rows(queues, 1_000_000), 0), (queue_rows(queues, 9_000_000), 900), ([], 2_000), ([], 99_000)):
        processor.init(store)
        if rows:
            found += processor.handleInputRows((0,), iter(rows), At(mark))
        for at in sorted(store.timers):
            if at < mark and at in store.timers:
                found += processor.handleExpiredTimer((0,), At(mark), At(at))
                store.timers.discard(at)
    return [tuple(r) for r in found], sum(store.calls.values())


def test_queues_of_a_group():
    together, calls = packed_queues(list(range(300)))
    for queue in (0, 7, 299):
        assert [r for r in together if r[0] == queue] == packed_queues([queue])[0]
    assert len(together) == 300 * 6 and calls < 100
