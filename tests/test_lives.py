"""Lives on keyed state: any split of the events into triggers against a simulation in event time."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import Row

from queuemill.session import scratch_path
from queuemill.sources.requests import read_request_stream
from queuemill.streaming import lives
from queuemill.streaming.lifecycle import fold_lifecycle

RULES = lives.Rules(last_stage=1, queue_timeout_us=30_000, client_timeout_us=60_000, keep_us=20_000)


class Held:
    """State of one key in memory, with the methods that the processor uses."""

    def __init__(self):
        self.value, self.items, self.map, self.timers = None, [], {}, set()

    getValueState = lambda self, *_: _Value(self)
    getListState = lambda self, *_: _List(self)
    getMapState = lambda self, *_: _Map(self)

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class _Value:
    def __init__(self, held):
        self.held = held

    def get(self):
        return self.held.value

    def update(self, value):
        self.held.value = value

    def clear(self):
        self.held.value = None


class _List(_Value):
    def get(self):
        return iter(list(self.held.items))

    def put(self, items):
        self.held.items = list(items)

    def appendList(self, items):
        self.held.items += items

    def clear(self):
        self.held.items = []


class _Map(_Value):
    def iterator(self):
        return iter(list(self.held.map.items()))

    def updateValue(self, key, value):
        self.held.map[key] = value

    def removeKey(self, key):
        self.held.map.pop(key)


class At:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms


def processed(triggers, delay_ms):
    """Run the processor as Spark does: rows first, then the timers below the watermark of the trigger before."""
    held, processor, found, newest = Held(), lives.RequestLife(RULES), [], 0
    processor.init(held)
    mark = 0
    for rows in [*triggers, None, []]:  # in the end other requests move the watermark on
        if rows:
            found += processor.handleInputRows((7,), iter(rows), At(mark))
        for at in sorted(held.timers):
            if at < mark and at in held.timers:
                found += processor.handleExpiredTimer((7,), At(mark), At(at))
                held.timers.discard(at)
        newest = max([newest, *(r.at_us // 1000 for r in rows or [])])
        mark = max(mark, newest + 1000 if rows is None else newest - delay_ms)
    assert all(lives.timer_ms(at) >= mark for (at,) in held.map.values()) and (held.items or not held.map)
    return found, mark


def simulated(events, mark_us):
    """The same life told in order of time: every event, after the timers that lie before it."""
    fired, life = [], None

    def fold():
        steps = [e for e in life["events"] if e.kind != "delivered"]
        newest = max(steps, key=lambda e: (e.at_us, e.stage, e.kind == "finished"), default=None)
        return (newest and newest.stage, newest and newest.success, len(life["events"]), life["reason"])

    def advance(to, inclusive):
        nonlocal life
        while life:
            at, _, name = min(life["timers"], default=(None, 0, None))
            if at is None or at > to or (at == to and not inclusive):
                return
            fired.append((name, at))
            if name == "purged":
                done.append(fold())
                life = None
                return
            life["reason"] = {"queue_timeout": "timeout", "client_timeout": "client_timeout"}[name]
            life["timers"] = [(at + RULES.keep_us, 9, "purged")]
            life["closed"] = True

    done = []
    for event in sorted(events, key=lambda e: e.at_us):
        advance(event.at_us, False)
        life = life or {"events": [], "timers": [], "reason": None, "closed": False, "begun": False, "taken": False}
        life["events"].append(event)
        if event.kind == "received" and not life["begun"] and not life["closed"]:
            life["begun"] = True
            own = [e.timeout_us for e in events if e.kind == "received" and e.at_us == event.at_us and e.timeout_us]
            life["timers"].append((event.at_us + max(own, default=RULES.client_timeout_us), 2, "client_timeout"))
            if not life["taken"]:
                life["timers"].append((event.at_us + RULES.queue_timeout_us, 1, "queue_timeout"))
        if event.stage == RULES.last_stage and event.kind != "delivered":
            life["taken"] = True
            life["timers"] = [t for t in life["timers"] if t[2] != "queue_timeout"]
        if event.kind == "delivered" and not life["closed"]:
            life["closed"] = True
            life["timers"] = [(event.at_us + RULES.keep_us, 9, "purged")]
    advance(mark_us, True)
    return fired, [*done, *([fold()] if life else [])]


KINDS = [("received", -1, True), ("claimed", 0, None), ("finished", 0, True), ("claimed", 1, None), ("finished", 1, False), ("delivered", 1, None)]


@settings(max_examples=600, deadline=None)
@given(
    st.lists(
        st.tuples(st.integers(0, 260), st.sampled_from(KINDS), st.integers(0, 40), st.sampled_from([None, 45_000])),
        min_size=1, max_size=12,
    ),
    st.integers(0, 120),
)
def test_any_split_gives_the_life_in_event_time(drawn, width):
    """Events arrive late by up to 40 ms, in triggers of ``width`` ms of arrival; the watermark waits that long."""
    rows = [
        (late, Row(at_us=at * 1000, stage=k[1], kind=k[0], success=k[2], timeout_us=own if k[0] == "received" else None))
        for at, k, late, own in drawn
    ]
    triggers: dict[int, list] = {}
    for late, row in rows:
        triggers.setdefault((row.at_us // 1000 + late) // (width + 1), []).append(row)
    found, mark = processed([triggers[i] for i in sorted(triggers)], delay_ms=40 + width)
    fired, final = simulated([r for _, r in rows], mark * 1000)
    assert [(r.change, r.at_us) for r in found if r.change != "updated"] == fired
    newest = [r for r in found if r.change == "purged"]
    if found[-1].change != "purged":
        newest.append(found[-1])
    assert [(r.last_stage, r.success, r.n_events, r.reason) for r in newest] == final
    assert [r.seq for r in found if r.change == "updated"][0] == 0


def events_of(spark, rows):
    schema = "request_id string, s int, kind string, stage int, success boolean, patience double"
    return spark.createDataFrame(rows, schema).select(
        "request_id", F.timestamp_micros((F.col("s") * 1_000_000).cast("long") + 10**12).alias("event_time"),
        "kind", "stage", "success", "patience",
    )


PARTS = [
    [("a", 0, "received", -1, True, None), ("b", 1, "received", -1, True, 20.0), ("late", 2, "received", -1, True, None)],
    [("a", 5, "claimed", 0, None, None), ("c", 60, "received", -1, True, None), ("b", 3, "claimed", 0, None, None)],
    [("a", 8, "finished", 0, True, None), ("a", 9, "delivered", 0, None, None), ("late", 30, "claimed", 0, None, None), ("d", 300, "received", -1, True, None)],
    [("c", 90, "claimed", 0, None, None), ("c", 91, "finished", 0, False, None), ("e", 900, "received", -1, True, None)],
]


@pytest.fixture(autouse=True, scope="module")
def few_partitions(spark):
    """Every trigger starts a Python worker per partition."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def run(spark, path, schema, out, progress):
    stream = read_request_stream(spark, path, schema, max_files=1)
    changes = lives.request_changes(
        stream, 0, 50, 400, 100, "350 seconds", "patience"
    )
    query = (
        changes.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


@pytest.fixture(scope="module")
def both_runs(spark):
    """All files in one run, and the same files in two runs of one checkpoint, with the state read between."""
    parts = [events_of(spark, part) for part in PARTS]
    whole, cut = scratch_path(spark, "lives"), scratch_path(spark, "lives-cut")
    outs = [scratch_path(spark, "changes") for _ in range(2)]
    progress = scratch_path(spark, "changes-progress")
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(whole)
    run(spark, whole, parts[0].schema, outs[0], scratch_path(spark, "changes-progress"))
    between = None
    for number, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(cut)
        if number == 1:
            run(spark, cut, parts[0].schema, outs[1], progress)
            between = lives.open_lives(spark, progress).collect()
    run(spark, cut, parts[0].schema, outs[1], progress)
    return [spark.read.parquet(out) for out in outs], between, parts


def test_timers_and_restart(spark, both_runs):
    outs, between, parts = both_runs
    wanted = {
        "a": ("purged", None, 4), "b": ("purged", "client_timeout", 2), "late": ("purged", "client_timeout", 2),
        "c": ("client_timeout", "client_timeout", 3), "d": ("purged", "timeout", 1), "e": ("updated", None, 1),
    }
    for out in outs:
        newest = {r.request_id: (r.change, r.reason, r.n_events) for r in lives.last_changes(out).collect()}
        assert newest == wanted
    assert sorted((r.request_id, r.kind) for r in between) == sorted((r[0], r[2]) for part in PARTS[:2] for r in part)


def test_equal_to_the_fold(spark, both_runs):
    outs, _, parts = both_runs
    events = parts[0]
    for part in parts[1:]:
        events = events.unionByName(part)
    shared = ["request_id", "last_stage", "success", "received_us", "delivered_us", "n_events"]
    folded = fold_lifecycle(events).select(shared)
    for out in outs:
        assert folded.exceptAll(lives.last_changes(out).select(shared)).isEmpty()


def test_rows_without_id_or_time_are_ignored(spark):
    rows = [(None, 1, "received", -1, True, None), ("x", None, "received", -1, True, None), ("y", 3, "received", -1, True, None)]
    path, out = scratch_path(spark, "odd-events"), scratch_path(spark, "odd-changes")
    events = events_of(spark, rows)
    events.write.parquet(path)
    run(spark, path, events.schema, out, scratch_path(spark, "odd-progress"))
    assert [r.request_id for r in spark.read.parquet(out).collect()] == ["y"]
