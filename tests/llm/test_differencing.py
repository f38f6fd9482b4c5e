from __future__ import annotations

import heapq
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from queuemill.llm import differencing as D
from queuemill.llm.queries import QUERIES


def by_lists(sizes: list[int], parts: int) -> list[list[int]]:
    """Differencing with plain lists: the items of every part, largest part first."""
    heap = []
    for i, size in enumerate(sizes):
        heap.append((-(size if parts > 1 else 0), i, [(size, [i])] + [(0, [])] * (parts - 1)))
    heapq.heapify(heap)
    born = len(sizes)
    while len(heap) > 1:
        (_, _, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        met = [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b))]
        met.sort(key=lambda part: -part[0])
        heapq.heappush(heap, (met[-1][0] - met[0][0], born, met))
        born += 1
    return [part[1] for part in heap[0][2]] if heap else [[] for _ in range(parts)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 1000), max_size=60), st.integers(1, 9))
def test_equals_differencing_by_lists(sizes, parts):
    found = D.differencing(np.array(sizes, np.int64), parts)
    wanted = by_lists(sizes, parts)
    assert [sorted(np.flatnonzero(found == p)) for p in range(parts)] == [sorted(items) for items in wanted]


def test_known_example():
    """Two parts of 4 to 8: differencing leaves 16 against 14, where greedy leaves 17 against 13."""
    sums = np.bincount(D.differencing(np.array([8, 7, 6, 5, 4]), 2), [8, 7, 6, 5, 4])
    assert sorted(sums) == [14, 16]


def test_tighter_than_greedy():
    sizes = np.random.default_rng(3).lognormal(7, 1.2, 3000).astype(int) + 1
    parts = np.bincount(D.differencing(sizes, 16), sizes)
    heap = [0] * 16
    for size in sorted(sizes.tolist(), reverse=True):
        heapq.heapreplace(heap, heap[0] + size)
    assert np.ptp(parts) < max(heap) - min(heap) and np.ptp(parts) <= 2


def check(rows: list[dict], texts: Counter, shards: int = D.SHARDS) -> dict[int, int]:
    """Whole, unsplit groups and gapless slots; returns bytes per shard."""
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == texts
    of_text = defaultdict(set)
    for r in rows:
        of_text[r["size"], r["text_crc32"]].add(r["shard"])
    assert all(len(found) == 1 for found in of_text.values())
    slots, held = defaultdict(list), Counter(dict.fromkeys(range(shards), 0))
    for r in rows:
        assert r["law"] == "bytes" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
        held[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return held


def plain(rows) -> Counter:
    return Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)


def test_odd_rows(spark, odd_rows, odd_documents, clashing):
    wanted = plain([(r[0], r[1]) for r in odd_rows])
    results = [[r.asDict() for r in D.shard_report(docs).collect()] for docs in (odd_documents, clashing, odd_documents)]
    for rows in results:
        check(rows, wanted)
    as_set = [Counter((r["doc_id"], r["shard"], r["slot"], r["size"]) for r in rows) for rows in results]
    assert as_set[0] == as_set[1] == as_set[2]


def test_large_groups(spark, monkeypatch):
    """A third of all rows is one text; many groups share packets."""
    monkeypatch.setattr(D, "PACKETS", 128)
    rng = random.Random(2)
    rows = [(i, "x" * rng.randint(0, 300) + str(i % 700)) for i in range(2000)] + [(i, "the same") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    keyed = docs.select(D.text_size(F.col("text")).alias("_size"), D.text_group(F.col("text")).alias("_group"))
    plan = D.plan_shards(keyed)
    assert plan.large.count() < D.PACKETS and plan.packets.count() <= D.PACKETS
    held = check([r.asDict() for r in D.shard_report(docs).collect()], plain(rows))
    assert sorted(held.values()) == sorted(plan.bytes_per_shard)
    assert max(held.values()) - min(held.values()) <= sum(held.values()) // D.PACKETS  # less than one packet


def test_a_group_beyond_its_share(spark):
    rows = [(i, "long text " * 20) for i in range(300)] + [(i, "y" * (i % 90) + str(i)) for i in range(1000)]
    held = check([r.asDict() for r in D.shard_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()], plain(rows))
    first, *others = sorted(held.values(), reverse=True)
    assert first == 300 * 201 and max(others) - min(others) <= 0.005 * min(others)


def test_fewer_groups_than_shards_and_none(spark, no_documents):
    rows = [(1, "a"), (2, "bb"), (3, None)]
    held = check([r.asDict() for r in D.shard_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()], plain(rows))
    assert sorted(held.values())[-3:] == [1, 2, 3]
    assert D.shard_report(no_documents).count() == 0
    with_shards = D.shard_report(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert {r["shard"] for r in with_shards} == {0, 1}


def test_written_shards(spark, odd_documents, clashing, tmp_path):
    for name, docs in (("a", odd_documents), ("b", clashing.withColumn("shard", F.lit("mine")).withColumn("_size", F.lit(1)))):
        found = D.write_shards(docs, str(tmp_path / name), 4)
        same = found.select(docs.drop("shard").columns)
        assert same.exceptAll(docs.drop("shard")).count() == 0 and same.count() == docs.count()
        report = D.shard_report(docs, 4).groupBy("doc_id", "shard").count()
        assert report.exceptAll(found.groupBy("doc_id", "shard").count()).count() == 0


def test_query(spark):
    rows = [r.asDict() for r in QUERIES["op13_differencing_shards"](spark, "/root/testdata/sf0.01").collect()]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    held = check(rows, plain([tuple(r) for r in docs]))
    assert max(held.values()) - min(held.values()) <= 2


@pytest.mark.parametrize("shards", [1, 3])
def test_other_numbers_of_shards(spark, odd_rows, odd_documents, shards):
    check([r.asDict() for r in D.shard_report(odd_documents, shards).collect()], plain([(r[0], r[1]) for r in odd_rows]), shards)
