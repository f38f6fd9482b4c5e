from __future__ import annotations

import hashlib
import re

import pytest

from queuemill.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(rows, items):
    grams = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[i : i + n]), set()).add(item)
    found = []
    for doc_id, text in rows:
        w = words(text)
        hit, named = set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i : i + n])) in grams:
                    hit |= set(range(i, i + n))
                    named |= grams[g]
        ids = sorted(str(x) for x in named if x is not None)
        sha = hashlib.sha256(",".join(ids).encode()).hexdigest()
        found.append((doc_id, len(w), len(hit), len(ids), sha, bool(hit)))
    return sorted(found, key=str)


@pytest.fixture(scope="module")
def benchmark(spark, odd_rows):
    whole = odd_rows[0][1].split(" ")
    items = [
        (1, " ".join(whole[5:25]).upper()), (2, "Same, line"), (2, "same LINE"), (3, ""), (4, None), (5, "one"),
        (10, " ".join(whole[40:50])), (None, "twenty"), (11, "日本語"),
    ]
    return items, spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block", [1_000, 4])
def test_report(odd_documents, odd_rows, benchmark, block):
    items, frame = benchmark
    got = decontaminate.contamination(odd_documents, frame, max_block=block).drop("items")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute([r[:2] for r in odd_rows], items)


def test_empty_tables(odd_documents, no_documents, benchmark):
    _, frame = benchmark
    assert decontaminate.contamination(no_documents, frame).count() == 0
    nothing = decontaminate.contamination(odd_documents, frame.limit(0))
    assert nothing.count() == odd_documents.count() and nothing.filter("contaminated").count() == 0


def test_removal(clashing, odd_rows, benchmark):
    items, frame = benchmark
    dirty = {r[:1] for r in brute([r[:2] for r in odd_rows], items) if r[-1]}
    clean = decontaminate.remove(clashing, frame)
    assert clean.columns == clashing.columns
    assert clean.count() == sum(not b[-1] for b in brute([r[:2] for r in odd_rows], items)) and dirty
    cut = decontaminate.remove(clashing, frame, mode="spans")
    assert cut.columns == clashing.columns and cut.count() == clashing.count()
    spans = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert spans[7] == "" and spans[5] == "" and spans[4] is None
    assert spans[12] == "\tThe end"
    first = odd_rows[0][1].split(" ")
    assert spans[1] == " ".join(first[:5] + first[25:40] + first[50:])
    with pytest.raises(ValueError):
        decontaminate.remove(clashing, frame, mode="lines")


@pytest.mark.parametrize("piece", [1, 7, 10, 512])
def test_windows_across_the_borders_of_pieces(spark, monkeypatch, piece):
    """A long text is scanned in pieces; windows that begin in one and end in another are found once."""
    monkeypatch.setattr(decontaminate, "PIECE", piece)
    items = [(1, " ".join(f"q{i}" for i in range(13))), (2, "two words"), (3, "alone"), (None, "q5 q6 q7 q8 q9 q10 q11 q12 q13 q14")]
    filler = [f"f{i % 83}" for i in range(1_300)]
    for at in (0, 3, 505, 511, 512, 521, 1_020, 1_285):
        filler[at : at + 15] = [f"q{i}" for i in range(15)]
    for at in (40, 600):
        filler[at : at + 3] = ["two", "words", "alone"]
    texts = [" ".join(filler), " ".join(filler[:9]), "alone", None, "", " ".join(filler[500:530])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontaminate.contamination(docs, benchmark).collect()}
    for doc_id, text in enumerate(texts):
        words, hit, named = (text or "").split(), set(), set()
        for item_id, item in items:
            own = item.split()
            width = min(10, len(own))
            for k in range(len(own) - width + 1):
                for i in range(len(words) - width + 1):
                    if words[i : i + width] == own[k : k + width]:
                        hit |= set(range(i, i + width))
                        named |= {item_id} - {None}
        assert found[doc_id] == (len(words), len(hit), len(named))
