from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest

from queuemill.llm import line_runs
from queuemill.session import scratch_path

BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    held = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            held[line.strip(BLANK).translate(LOWER)].add(doc_id)
    gone = {
        k: max((d for d in v if d is not None), default=None) for k, v in held.items() if len(k) >= 20 and len(v) >= 3
    }
    found = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if gone.get(k := x.strip(BLANK).translate(LOWER), doc_id) == doc_id or k not in gone]
        sha = hashlib.sha256("\n".join(kept).encode()).hexdigest()
        found.append((doc_id, len(lines), len(lines) - len(kept), sha))
    return sorted(found, key=str)


def described(frame):
    rows = frame.select("doc_id", "n_lines", "n_dropped", "text").collect()
    return sorted(((*r[:3], hashlib.sha256(r["text"].encode()).hexdigest()) for r in rows), key=str)


@pytest.mark.parametrize("batches, fanout", [(1, 2), (5, 2), (4, 3)])
def test_odd_rows(odd_documents, odd_rows, batches, fanout):
    got = line_runs.dedup_lines(odd_documents, batches=batches, fanout=fanout)
    assert described(got) == brute([r[:2] for r in odd_rows])


def test_random_lines(spark):
    draw = random.Random(3)
    pool = [f"line number {i} of the pool, long enough" for i in range(30)] + ["short"]
    rows = [(i % 190, "\n".join(draw.choices(pool, k=draw.randint(1, 9)))) for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert described(line_runs.dedup_lines(frame)) == brute(rows)


def test_clashing_and_empty(clashing, no_documents):
    assert set(line_runs.dedup_lines(clashing).columns) == {*clashing.columns, "n_lines", "n_dropped"}
    assert line_runs.dedup_lines(no_documents).count() == 0


def test_runs_are_compacted(spark):
    runs = line_runs.LineRuns(spark, scratch_path(spark, "test-runs"), fanout=2)
    make = lambda ids: spark.createDataFrame([(i, i, 1, 10 * i) for i in ids], "line_hash long, line_hash_2 long, docs long, last_doc long")
    runs.add(make([1, 2]))
    assert [r[0] for r in runs.fresh(make([2, 3])).collect()] == [3]
    for ids in ([2, 3], [3, 4], [5], [1]):
        runs.add(make(ids))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert sorted(tuple(r) for r in runs.counts().collect()) == [
        (1, 1, 2, 10), (2, 2, 2, 20), (3, 3, 2, 30), (4, 4, 1, 40), (5, 5, 1, 50),
    ]
    with pytest.raises(ValueError):
        line_runs.LineRuns(spark, "x", fanout=1)
