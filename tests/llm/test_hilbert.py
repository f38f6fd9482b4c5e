from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from compare import difference, duck
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from queuemill.llm import hilbert_blocks as H
from queuemill.llm.queries import ORACLES, QUERIES

VECTORS = "vec_id long, label long, vector array<double>"


def brute(rows, is_anchor):
    found = []
    last = lambda r: (r[0] is None, r[0] or 0)
    for anchor in rows:
        if anchor[0] is None or not is_anchor(anchor[0]):
            continue
        scored = [(sum(int(a) * int(b) for a, b in zip(anchor[2], r[2])), r) for r in rows]
        order = sorted(scored, key=lambda s: (-s[0], last(s[1])))
        same = [(s, r) for s, r in order if r[1] == anchor[1] and r[0] != anchor[0]][:5]
        for positive, p in same:
            fits = [(s, r) for s, r in order if r[1] != anchor[1] and 30 * positive <= 100 * s <= 90 * positive][:10]
            found += [(anchor[0], p[0], k, r[0], positive, s) for k, (s, r) in enumerate(fits, 1)]
    return sorted(found, key=str)


def mined(spark, rows, every=3, block=H.BLOCK):
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    found = H.hard_negatives(df, F.col("vec_id") % every == 0, block)
    return sorted((tuple(r) for r in found.collect()), key=str)


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (5, 2), (1, 3)])
def test_curve_visits_every_cell_by_single_steps(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    index = H.hilbert_index(cells, bits)
    assert sorted(index) == list(range(len(cells)))
    path = cells[np.argsort(index)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10_000))
def test_bounds_hold(seed):
    rng = np.random.default_rng(seed)
    anchors, rows = rng.integers(-9, 9, (4, 6)).astype(float), rng.integers(-9, 9, (12, 6)).astype(float)
    blocks = rows.reshape(3, 4, 6)
    least, most = H.bounds(anchors, blocks.min(1), blocks.max(1))
    found = np.einsum("ad,brd->abr", anchors, blocks)
    assert (least <= found.min(2)).all() and (found.max(2) <= most).all()
    exact = H.bounds(anchors, rows, rows)
    assert np.array_equal(exact[0], anchors @ rows.T) and np.array_equal(exact[1], anchors @ rows.T)


@pytest.mark.parametrize("seed,span", [(1, 4), (2, 40), (3, 400)])
def test_equals_brute_force(spark, seed, span):
    """Small spans have many equal scores."""
    rng = random.Random(seed)
    rows = [(i, rng.randint(0, 3), [float(rng.randint(-span, span)) for _ in range(6)]) for i in range(260)]
    assert mined(spark, rows, block=4) == brute(rows, lambda i: i % 3 == 0)


def test_chunks_and_blocks_do_not_matter(spark):
    rng = np.random.default_rng(4)
    rows = [(i, int(i % 3), rng.integers(-99, 99, 8).astype(float).tolist()) for i in range(500)]
    blocks, zones, dims = H.write_blocks(spark.createDataFrame([(*r, r[0]) for r in rows], VECTORS + ", _row long"))
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"vec_id": i, "label": l, "vector": v} for i, l, v in rows if i % 5 == 0])
    whole = [r for b in H._miner(blocks, zones, dims)(iter([batch])) for r in b.to_pylist()]
    parts = [r for b in H._miner(blocks, zones, dims)(batch.slice(i, 7) for i in range(0, len(batch), 7)) for r in b.to_pylist()]
    assert sorted(map(str, whole)) == sorted(map(str, parts)) and len(whole) > 1000


def test_blocks_that_cannot_hold_an_answer_are_not_read(spark):
    """Tight clusters: an anchor's windows need few of the blocks, and the answers stay those of brute force."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-300, 300, (40, 8))
    rows = [(i, int(i % 2), (centres[i % 40] + rng.integers(-3, 3, 8)).astype(float).tolist()) for i in range(1600)]
    blocks, zones, dims = H.write_blocks(
        spark.createDataFrame([(*r, r[0]) for r in rows], VECTORS + ", _row long").coalesce(1), 16
    )
    held = H.Blocks(blocks, zones, dims)
    n_blocks = sum(len(names) for names, _, _ in held.zones())
    ids, labels = np.array([0]), np.array([0])
    best, read = H._positives(held, ids, labels, np.array([rows[0][2]]))
    assert n_blocks >= 100 and read <= n_blocks / 5
    wanted = sorted(((int(np.dot(rows[0][2], r[2])), r[0]) for r in rows if r[1] == 0 and r[0]), key=lambda s: (-s[0], s[1]))
    assert best.found(0) == wanted[:5]


def test_scores_beyond_doubles(spark):
    big = float(2**27)
    rows = [(i, i % 2, [big * (i + 1), float(i), 1.0]) for i in range(12)] + [(99, 0, [-big, 5.0, 0.0]), (12, 1, [0.0, 0.0, 0.0])]
    assert mined(spark, rows) == brute(rows, lambda i: i % 3 == 0)
    huge = [(0, 0, [2.0**80]), (1, 0, [2.0**80]), (2, 1, [2.0**79])]
    assert mined(spark, huge) == [(0, 1, 1, 2, 2**63 - 1, 2**63 - 1)]


def test_odd_rows(spark):
    rows = [
        (0, 1, [3.0, 4.0]), (0, 1, [3.0, 4.0]), (0, 2, [1.0, 0.0]), (3, 1, [3.0, 4.0]), (4, 1, [3.0]), (5, 1, []),
        (6, 2, [2.0, 2.0]), (7, 2, [2.0, 2.0]), (None, 1, [3.0, 4.0]), (None, 2, [2.0, 2.0]), (9, 3, [1.0, 1.0, 9.0]),
        (12, 4, [0.0, 0.0]), (13, 4, [0.0, 0.0]), (15, 5, [-1.0, 0.0]), (16, 5, [1.0, 0.0]),
    ]
    padded = [(i, l, v + [0.0] * (3 - len(v))) for i, l, v in rows]
    assert mined(spark, rows) == brute(padded, lambda i: i % 3 == 0)
    assert mined(spark, []) == []


def test_whole_vectors(spark):
    rows = [
        (1, 3, [0.5, -0.001]), (7, 9, [1.0, 0.0]), (2, None, [1.0, 1.0]), (3, 1, None), (4, 1, [1.0, None]),
        (5, 1, [float("nan"), 1.0]), (6, 1, [math.inf, 1.0]), (None, 1, []), (14, 4, [0.25, 0.25]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    df = df.withColumns({"vector": F.lit("mine"), "curve": F.lit(1), "_row": F.lit("x")})
    found = sorted((tuple(r) for r in H.whole_vectors(df).collect()), key=str)
    assert found == sorted([(1, 3, [128.0, -1.0]), (7, 0, [256.0, 0.0]), (None, 1, []), (14, 5, [64.0, 64.0])], key=str)


def test_query_on_odd_rows(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, rng.choice([None, *range(10)]), [rng.gauss(0, 0.2) for _ in range(8)]) for i in range(0, 900, 2)]
    rows += [(901, 2, None), (903, 2, [None] * 8), (905, 2, [math.nan] * 8), (907, 2, [math.inf] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    connection = duck(str(tmp_path / "none"))
    connection.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    found = QUERIES["op12_hilbert_negatives"](spark, str(tmp_path))
    assert found.count() > 100
    assert difference(found, connection, ORACLES["op12_hilbert_negatives"]) is None
