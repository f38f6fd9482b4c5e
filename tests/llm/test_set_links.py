from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from test_jaccard_join import brute, shingles, varied

from queuemill.llm import set_links as L
from queuemill.llm.queries import QUERIES


def links(rows):
    """(doc_id, number of other rows that it links with) of each row, and the number of links of different sets."""
    sets = [shingles(text) for _, text in rows]
    n = [0] * len(rows)
    pairs = set()
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                n[i] += 1
                n[j] += 1
                if a != sets[j]:
                    pairs.add(frozenset((a, sets[j])))
    return Counter((d, k) for (d, _), k in zip(rows, n)), len(pairs)


def check(frame, rows, **options):
    steps = L.J.joined(frame, "text", "doc_id", 5, 80)
    got = L.with_links(steps, **options).collect()
    pairs = L.class_pairs(steps, **options).cache()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(rows)
    wanted, n_pairs = links(rows)
    assert Counter((r["doc_id"], r["n_links"]) for r in got) == wanted
    assert pairs.count() == n_pairs and pairs.filter("a >= b").count() == 0
    assert pairs.distinct().count() == n_pairs


def test_odd_rows(odd_documents, odd_rows, clashing, no_documents):
    rows = [r[:2] for r in odd_rows]
    check(odd_documents, rows)
    check(clashing, rows)
    check(no_documents, [])


@pytest.mark.parametrize("block_sets", [None, 2, 7])
def test_near_copies_of_one_text_keep_all_links(spark, block_sets):
    """A star of near copies, a chain whose ends do not link, and a passage between different ends."""
    draw = random.Random(5)
    star = [f"s{i}" for i in range(120)]
    texts = [varied(draw, star, draw.choice([0, 1, 1, 2, 3])) for _ in range(40)]
    chain = [f"c{i}" for i in range(70)]
    for _ in range(25):
        texts.append(varied(draw, chain, 2))
        chain = texts[-1].split(" ")
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [f"{passage} end{i % 9} of{i} {draw.random()}" for i in range(30)] + [passage] * 4
    rows = list(enumerate(texts))
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows, block_sets=block_sets)


def test_query_keeps_all_links(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op10_jaccard_join"](spark, sf_dir).select("doc_id", "n_links").collect()
    assert Counter(map(tuple, got)) == links(rows)[0]


@settings(max_examples=300, deadline=None)
@given(
    sets=st.lists(st.sets(st.integers(0, 16), min_size=1, max_size=14), min_size=2, max_size=16),
    two=st.lists(st.booleans(), min_size=16, max_size=16),
    diagonal=st.booleans(),
    percent=st.sampled_from([40, 60, 80, 100]),
    before=st.integers(0, 6),
)
def test_block_links(sets, two, diagonal, percent, before):
    """One block with itself, or two blocks of which one asks the other; every shingle is in a list."""
    two = np.array(two[: len(sets)])
    asks, held = (np.ones(len(sets), bool),) * 2 if diagonal else (~two, two)
    values = [np.sort(np.array(sorted(s), np.int64)) for s in sets]
    offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    pos = np.concatenate([np.arange(len(s)) for s in sets])
    n = np.array([len(s) for s in sets])
    flat = np.concatenate(values)
    names = np.random.default_rng(len(flat)).permutation(len(sets))
    early = [v[v < before] for v in values]  # shingles below ``before`` are in lists of lesser leaders
    earlier = (np.concatenate(([0], np.cumsum([len(e) for e in early]))), np.concatenate(early))
    one, other = L.block_links(
        names, n, names % 3, asks, held, (offsets, flat, pos), (offsets, flat), earlier, percent
    )
    got = Counter(frozenset(p) for p in zip(one.tolist(), other.tolist()))
    similar = lambda x, y: 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y])
    wanted = {
        frozenset((x, y)) for x in range(len(sets)) for y in range(len(sets))
        if x != y and asks[x] and held[y] and similar(x, y) and min(sets[x] & sets[y]) >= before
    }
    assert got == Counter(wanted)
