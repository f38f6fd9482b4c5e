"""Batches that wait across triggers against the plain packing loop."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T
from test_lives import Held

from queuemill.operators.inference import Stage, chain
from queuemill.operators.packing import PackRule, pack_batches
from queuemill.session import scratch_path
from queuemill.sources.requests import read_request_stream
from queuemill.streaming import waiting

LAYOUT = waiting.Layout(T.StructType(), 0, 1, 2)
NAMES = ["received_us", "request_id", "n_inputs", "batch_id", "batch_offset"]


class Clock:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = self.getCurrentProcessingTimeInMs = self.getExpiryTimeInMs = lambda: ms


def fire(held, packer, ms, limit):
    found = []
    for at in sorted(held.timers):
        if at < limit and at in held.timers:
            found += packer.handleExpiredTimer((1, 0), Clock(ms), Clock(at))
            held.timers.discard(at)
    return found


def streamed(triggers, rule, delay_ms):
    """Rows first, then the timers below the watermark, which comes from the triggers before."""
    held, packer, found, newest, mark = Stored(), waiting.QueuePacker(rule, LAYOUT, NAMES, "event"), [], 0, 0
    packer.init(held)
    for rows in [*triggers, []]:
        if rows:
            found += packer.handleInputRows((1, 0), iter(rows), Clock(mark))
        found += fire(held, packer, mark, mark)
        newest = max([newest, *(r[0] // 1000 for r in rows)])
        mark = max(mark, newest - delay_ms)
    found += fire(held, packer, mark, mark)
    return [tuple(r) for r in found], mark * 1000


class Stored(Held):
    """Lists by their names."""

    def getListState(self, name, *_):
        self.lists = {**getattr(self, "lists", {}), name: Held()}
        return Held.getListState(self.lists[name])


def packed(rows, rule):
    """One by one: ``(row, batch, offset)``, and per batch its inputs, first and last time."""
    found, number, length, opened = [], 0, 0, None
    for row in sorted(rows):
        if opened is not None and (length > rule.full_above or row[0] - opened >= rule.wait):
            number, length, opened = number + 1, 0, None
        opened = row[0] if opened is None else opened
        found.append((*row, number, length))
        length += row[2]
    return found


def closed(found, rule, mark_us):
    kept = []
    for number in {r[3] for r in found}:
        batch = [r for r in found if r[3] == number]
        full = sum(r[2] for r in batch) > rule.full_above and batch[-1][0] <= mark_us
        if full or batch[0][0] + rule.wait <= mark_us + 1:
            kept += batch
    return sorted(kept)


@settings(max_examples=500, deadline=None)
@given(
    st.lists(st.tuples(st.integers(0, 90_000), st.integers(1, 9), st.integers(0, 30)), min_size=1, max_size=40),
    st.integers(0, 40), st.integers(2, 12), st.sampled_from([None, 1, 5_000, 20_500]),
)
def test_batches_do_not_depend_on_the_split(drawn, width, batch_size, wait):
    rule = PackRule(batch_size, wait)
    rows = [(at, i, n) for i, (at, n, _) in enumerate(drawn)]
    triggers: dict[int, list] = {}
    for row, (at, _, late) in zip(rows, drawn):
        triggers.setdefault((at // 1000 + late) // (width + 1), []).append(row)
    found, mark_us = streamed([triggers[i] for i in sorted(triggers)], rule, 30 + width + 1)
    assert sorted(found) == closed(packed(rows, rule), rule, mark_us)
    assert [r[3] for r in found] == sorted(r[3] for r in found)


def test_wall_clock():
    rule = PackRule(10, 2_000_000)
    held, packer = Stored(), waiting.QueuePacker(rule, LAYOUT, NAMES, "processing")
    packer.init(held)
    batch = lambda found: [(r["request_id"], r["batch_id"]) for r in found]
    assert batch(packer.handleInputRows((1, 0), iter([(5, 1, 2), (3, 2, 2)]), Clock(1_000))) == []
    assert held.timers == {3_000}
    assert batch(packer.handleInputRows((1, 0), iter([(7, 3, 2)]), Clock(2_500))) == []
    assert batch(fire(held, packer, 3_100, 3_100)) == [(2, 0), (1, 0), (3, 0)]
    assert batch(packer.handleInputRows((1, 0), iter([(8, 4, 9), (9, 5, 1)]), Clock(4_000))) == [(4, 1)]
    assert batch(packer.handleInputRows((1, 0), iter([(9, 6, 0), (None, 7, 1)]), Clock(4_100))) == [(6, None), (7, None)]
    assert batch(packer.handleInputRows((1, 0), iter([(10, 8, 1)]), Clock(6_000))) == [(5, 2)]
    assert batch(fire(held, packer, 8_000, 8_001)) == [(8, 3)]


def fail_on_13(inputs, batch_size=1):
    if 13 in inputs:
        raise ValueError("no 13")
    return [x + 1 for x in inputs]


def requests(spark, n=60):
    rows = [(i, i % 2 if i % 10 else None, i * 700_000 + 10**12, [i % 20] * (i % 4)) for i in range(n)]
    return spark.createDataFrame(rows, "request_id bigint, queue_key bigint, received_us bigint, inputs array<int>")


@pytest.fixture(autouse=True, scope="module")
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def run(spark, scored, out, progress):
    query = scored.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress)
    query.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(scored.schema).parquet(out)


STAGES = [
    Stage.from_function(fail_on_13, "int", 8),
    Stage.from_expression(lambda x: x * 2, "int", "twice"),
    Stage.from_function(lambda inputs, batch_size=1: [str(x) for x in inputs], "string", 8, "text"),
]


def test_failures_and_restart(spark):
    """Two runs of one checkpoint; the open batch lives on in between. The same requests fail as in batch."""
    rows = requests(spark)
    path, out, progress = (scratch_path(spark, label) for label in ("waiting", "waiting-out", "waiting-progress"))
    last = spark.createDataFrame([(1000, 9, 2 * 10**12, [1])], rows.schema)
    parts = [rows.filter("request_id % 3 = 1 and request_id < 30"), rows.filter("request_id % 3 <> 1 and request_id < 30"), rows.filter("request_id >= 30"), last]
    for number, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(path)
        if number in (1, 3):
            stream = read_request_stream(spark, path, rows.schema, max_files=1)
            scored = waiting.score_waiting_stream(stream, STAGES, 5_000_000, delay="60 seconds")
            found = run(spark, scored, out, progress)
    columns = ["request_id", "queue_key", "success", "error", "stage0_batch_id", "stage0_batch_inputs", "outputs", "last_stage"]
    wanted = chain(rows, STAGES, 5_000_000).select(columns)
    found = found.filter("request_id < 1000").select(columns)
    assert found.count() == wanted.count() and found.exceptAll(wanted).isEmpty()
    assert found.filter("error is not null").count() > 2


def test_lanes(spark):
    """Every lane is packed by itself, and numbers stay unique in a queue."""
    rows = requests(spark, 40).withColumn("n_inputs", F.size("inputs")).filter("n_inputs > 0")
    path = scratch_path(spark, "lanes")
    last = rows.limit(1).selectExpr("request_id + 1000 as request_id", "queue_key", "received_us * 2 as received_us", "inputs", "n_inputs")
    for part in (rows, last):
        part.coalesce(1).write.mode("append").parquet(path)
    stream = read_request_stream(spark, path, rows.schema, max_files=1)
    found = run(
        spark, waiting.pack_stream(stream, 8, 5_000_000, delay="1 second", lanes=3),
        scratch_path(spark, "lanes-out"), scratch_path(spark, "lanes-progress"),
    )
    laned = rows.withColumn("lane", F.pmod(F.xxhash64("request_id"), F.lit(3)).cast("int"))
    laned = laned.withColumn("q", F.struct("queue_key", "lane").cast("string"))
    wanted = pack_batches(laned, 8, 5_000_000, key="q")
    number = (F.col("batch_id") * 3 + F.col("lane")).alias("batch_id")
    wanted = wanted.select("request_id", "queue_key", number, "batch_offset")
    found = found.filter("request_id < 1000").select(wanted.columns)
    assert found.count() == rows.count() and found.exceptAll(wanted).isEmpty()
