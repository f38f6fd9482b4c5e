from __future__ import annotations

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from queuemill.llm import jaccard_join as J
from queuemill.llm.components import components
from queuemill.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """(doc_id, set size, component id) of each row, by comparing all pairs."""
    sets = [shingles(text) for _, text in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                up[top(i)] = top(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[top(i)] = min(least.get(top(i), doc_id), doc_id)
    return sorted(((d, len(s), least.get(top(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def found(frame, **options):
    rows = J.near_duplicates(frame, **options).select("doc_id", "n_shingles", "component_id").collect()
    return sorted((tuple(r) for r in rows), key=str)


def test_odd_rows(odd_documents, odd_rows, clashing, no_documents):
    wanted = brute([r[:2] for r in odd_rows])
    assert found(odd_documents) == wanted
    assert found(clashing) == wanted
    assert found(no_documents) == []


def varied(draw, words, changes):
    words = list(words)
    for _ in range(changes):
        words[draw.randrange(len(words))] = f"new{draw.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def families():
    """Groups around the limit, chains, a passage that many documents share, and exact copies."""
    draw = random.Random(11)
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for family in range(25):
        first = [f"f{family}w{draw.randrange(60)}" for _ in range(draw.randint(5, 120))]
        if family % 3 == 0:
            first = first[:10] + passage
        text = first
        for _ in range(draw.randint(1, 16)):
            rows.append(varied(draw, text, draw.choice([0, 0, 1, 1, 2, 3])))
            if family % 4 == 0:
                text = rows[-1].split(" ")  # a chain: ends do not link with each other
    rows += [" ".join(passage)] * 9 + [" ".join(passage).upper()]
    draw.shuffle(rows)
    return [(i, text) for i, text in enumerate(rows)]


def test_families(spark, families):
    frame = spark.createDataFrame(families, "doc_id long, text string").repartition(5)
    assert found(frame) == brute(families)


def test_hot_shingles_and_small_blocks_change_nothing(spark, families, monkeypatch):
    frame = spark.createDataFrame(families, "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(J, "HOT_IN_BATCH", 3)
    blocks = J.open_blocks
    monkeypatch.setattr(J, "open_blocks", lambda members, percent: blocks(members, percent, block_sets=2))
    assert found(frame) == brute(families)


def test_query_is_the_definition(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op10_jaccard_join"](spark, sf_dir).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_one_of_each_stays(odd_documents, clashing):
    kept = J.first_of_each(clashing)
    assert kept.columns == clashing.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=str)
    assert ids == sorted([1, 4, 5, 6, 7, 8, 10, 11, 12, None], key=str)


@settings(max_examples=200, deadline=None)
@given(
    sets=st.lists(st.sets(st.integers(0, 14), min_size=1, max_size=12), min_size=2, max_size=14),
    asks=st.lists(st.booleans(), min_size=14, max_size=14),
)
def test_block_links(sets, asks):
    """All entries of a block, each set its own component: what askers link with is connected."""
    sets = [np.sort(np.array(sorted(s), np.int64)) for s in sets]
    asks = np.array(asks[: len(sets)])
    offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    values = np.concatenate(sets)
    pos = np.concatenate([np.arange(len(s)) for s in sets])
    n = np.array([len(s) for s in sets])
    held = np.ones(len(sets), bool)
    links = J.block_links(n, np.arange(len(sets)), asks, held, (offsets, values, pos), (offsets, values), 80)
    up = list(range(len(sets)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    similar = lambda x, y: 100 * len(np.intersect1d(sets[x], sets[y])) >= 80 * len(np.union1d(sets[x], sets[y]))
    for x, y in links:
        assert similar(x, y)
        up[top(x)] = top(y)
    for x in np.flatnonzero(asks):
        assert all(top(x) == top(y) for y in range(len(sets)) if similar(x, y))


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(0, 90)] + [(200, 100), (300, 200), (7, 7), (5, 4)]
    rows = components(spark.createDataFrame(links, "a long, b long")).collect()
    got = {r["node"]: r["component"] for r in rows}
    assert got == {**{i: 0 for i in range(91)}, 100: 100, 200: 100, 300: 100} and len(rows) == len(got)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
