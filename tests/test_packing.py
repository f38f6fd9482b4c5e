"""Packing: the scan and the segmented way against a row-by-row loop."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from queuemill.operators import packing as P


def row_by_row(keys, sizes, times, batch_size, wait):
    answer, key = [], object()
    for k, n, t in zip(keys, sizes, times):
        if k != key:
            key, number, length, opened = k, 0, 0, t
        elif length > 0.8 * batch_size or t - opened >= wait:
            number, length, opened = number + 1, 0, t
        answer.append((number, length))
        length += n
    return answer


def batches_of(keys, sizes, times, cuts):
    edges = sorted({0, len(keys), *(c % (len(keys) + 1) for c in cuts)})
    return [
        pa.RecordBatch.from_pydict(
            {"queue_key": keys[a:b], "received_us": times[a:b], "n_inputs": sizes[a:b],
             "request_id": list(range(a, b))}
        )
        for a, b in zip(edges, edges[1:])
    ]


def split(batch):
    """The batch in two, as Arrow may hand it over."""
    half = batch.num_rows // 2
    return iter([batch.slice(0, half), batch.slice(half)])


@settings(max_examples=300, deadline=None)
@given(
    rows=st.lists(
        st.tuples(st.integers(0, 4), st.integers(1, 9), st.integers(0, 3)), min_size=1, max_size=80
    ),
    batch_size=st.sampled_from([1, 2, 5, 8, 32]),
    wait=st.sampled_from([0, 1, 5, 40, P.NO_WAIT_LIMIT]),
    cuts=st.lists(st.integers(0, 200), max_size=5),
)
def test_scan_equals_loop(rows, batch_size, wait, cuts):
    keys = sorted(r[0] for r in rows)
    sizes = [r[1] for r in rows]
    times = np.cumsum([r[2] for r in rows]).tolist()
    rule = P.PackRule(batch_size, wait)
    segments = batches_of(keys, sizes, times, cuts)
    summary_schema = P._arrow_schema(P._summary_schema(T.IntegerType()))
    entry_schema = pa.schema(
        [("_key", pa.int64()), ("_segment", pa.int32()), ("_number", pa.int64()), ("_length", pa.int64()),
         ("_opened", pa.int64())]
    )
    named = [
        batch.append_column("segment", pa.array([i] * batch.num_rows, pa.int32())) for i, batch in enumerate(segments)
    ]
    summaries = [row for batch in named for row in P._summarise_segments(split(batch), rule, summary_schema)]
    assert len(summaries) <= 2 * len(segments)
    entries = {
        row["_segment"]: row
        for out in P._chain_summaries(iter(summaries), rule, entry_schema)
        for row in out.to_pylist()
    }
    got = []
    for i, batch in enumerate(named):
        entry = entries.get(i)
        first_key = batch["queue_key"][0].as_py() if batch.num_rows else None
        begun = [entry is not None and k == first_key for k in batch["queue_key"].to_pylist()]
        assert entry is None or entry["_key"] == first_key
        for name in ("_number", "_length", "_opened"):
            values = [entry[name] if known else None for known in begun]
            batch = batch.append_column(name, pa.array(values, pa.int64()))
        batch = batch.append_column("segment_row", pa.array(range(batch.num_rows), pa.int64()))
        for out in P._pack_segments(split(batch), rule):
            got += [(row["batch_id"], row["batch_offset"]) for row in out.to_pylist()]
    assert got == row_by_row(keys, sizes, times, batch_size, wait)


@settings(max_examples=200, deadline=None)
@given(
    rows=st.lists(st.tuples(st.integers(1, 9), st.integers(0, 3)), min_size=1, max_size=80),
    batch_size=st.sampled_from([1, 5, 8, 32]),
    wait=st.sampled_from([1, 5, 40, P.NO_WAIT_LIMIT]),
)
def test_summary_gives_every_exit(rows, batch_size, wait):
    sizes = np.asarray([r[0] for r in rows])
    times = np.cumsum([r[1] for r in rows])
    rule = P.PackRule(batch_size, wait)
    summary = P.summarise_run(sizes, times, rule)
    for entry, (length, opened, batches) in enumerate(
        zip(summary["exit_length"], summary["exit_opened"], summary["opened_batches"])
    ):
        rest = slice(entry, None)
        _, _, closing = P.number_batches(
            sizes[rest], times[rest], np.asarray([0, len(sizes) - entry]), None, rule
        )
        assert (closing.length, closing.opened, closing.number + 1) == (length, opened, batches)


def skewed_requests(spark, rows=6_000, hot_share=3):
    rng = random.Random(7)
    data = []
    for i in range(rows):
        key = None if i % 17 == 0 else 0 if i % hot_share == 0 else rng.randint(1, 40)
        data.append((key, f"r{i:05d}", 1_000 * (i // 3), rng.randint(1, 12)))
    return spark.createDataFrame(
        data, "queue_key int, request_id string, received_us bigint, n_inputs int"
    ).repartition(7)


@pytest.mark.parametrize("wait, tasks", [(None, 40), (60_000, 40), (60_000, 3), (None, 1)])
def test_segments_equal_loop(spark, wait, tasks):
    df = skewed_requests(spark)
    packed = P.pack_batches(df, 32, wait, tasks=tasks).collect()
    assert len(packed) == 6_000
    rows = sorted(packed, key=lambda r: (str(r.queue_key), r.received_us, r.request_id))
    expected = row_by_row(
        [str(r.queue_key) for r in rows], [r.n_inputs for r in rows], [r.received_us for r in rows],
        32, P.NO_WAIT_LIMIT if wait is None else wait,
    )
    assert [(r.batch_id, r.batch_offset) for r in rows] == expected


def test_hot_queue_is_spread_over_partitions(spark):
    hot = skewed_requests(spark).filter("queue_key = 0")
    packed = P.pack_batches(hot, 32, tasks=12)
    sizes = [r["count"] for r in packed.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 10 and max(sizes) < hot.count() / 4


def test_many_keys_and_repeated_ids(spark):
    """More keys than any list of hot keys would have, each on a segment border somewhere; ids occur twice."""
    rows = spark.range(30_000).selectExpr(
        "id % 5000 as queue_key", "cast(id div 2 as string) as request_id", "id as received_us", "1 + id % 7 as n_inputs"
    )
    packed = P.pack_batches(rows, 16, tasks=64)
    assert packed.count() == 30_000
    one = P.pack_batches(rows, 16, tasks=1)
    assert packed.exceptAll(one).count() == 0


def test_arrival_is_needed(spark):
    rows = spark.createDataFrame(
        [(1, "a", None, 1)], "queue_key int, request_id string, received_us bigint, n_inputs int"
    )
    with pytest.raises(Exception, match="received_us"):
        P.pack_batches(rows, 8).collect()


def test_batches_hold_whole_requests_and_stay_below_the_limit(spark):
    packed = P.pack_batches(skewed_requests(spark), 32)
    last = packed.groupBy("queue_key", "batch_id").agg(F.max("batch_offset").alias("before_last"))
    assert last.filter("before_last > 0.8 * 32").count() == 0


def test_other_partitioning_gives_the_same_batches(spark):
    df = skewed_requests(spark)
    one = P.pack_batches(df.repartition(1), 32, 60_000)
    many = P.pack_batches(df.repartition(31), 32, 60_000)
    assert one.exceptAll(many).count() == 0


def test_empty_requests_are_refused(spark):
    df = spark.createDataFrame(
        [(1, "a", 0, 0)], "queue_key int, request_id string, received_us bigint, n_inputs int"
    )
    with pytest.raises(Exception, match="at least one input"):
        P.pack_batches(df, 8).collect()


def test_slices_cover_the_list(spark):
    df = spark.createDataFrame([(1, list(range(10))), (2, []), (3, [5])], "id int, xs array<int>")
    rows = P.slice_batches(df, "xs", 4).orderBy("id", "chunk_id").collect()
    assert [(r.id, r.chunk_id, r["item"]) for r in rows] == [
        (1, 0, [0, 1, 2, 3]), (1, 1, [4, 5, 6, 7]), (1, 2, [8, 9]), (3, 0, [5]),
    ]
