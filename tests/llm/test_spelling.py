from __future__ import annotations

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from compare import difference, duck
from hypothesis import given, settings
from hypothesis import strategies as st

from queuemill.llm import spelling_variants as S
from queuemill.llm.queries import ORACLES, QUERIES


def one_edit(a: str, b: str) -> bool:
    """By its definition, with none of the operator's means."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts: dict[str, int], ratio: int = 2) -> dict[str, tuple]:
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    rows = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        rows[w] = (form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None)
    return rows


def mined(spark, counts: dict[str, int]) -> dict[str, tuple]:
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    found = S.spelling_variants(words).collect()
    assert len(found) == len({r["word"] for r in found})
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in found}


def words_of(rows) -> dict[str, int]:
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            check = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            at = check % len(run)
            total[run[:at] + run[at + 1 :] if check % 97 == 0 else run] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abé", min_size=1, max_size=7), unique=True, max_size=60), st.booleans())
def test_every_near_pair_is_found_in_one_group(words, crossed):
    """Words of one base as one group: pairs come out once, in the piece where their common prefix ends."""
    import pyarrow as pa

    rows = []
    for word in words:
        for base in (len(word), len(word) - 1):
            cut = S.cuts(base)
            for piece in range(S.PIECES if base > 0 else 0):
                key = hash((word[: cut[piece]], word[len(word) - (base - cut[piece + 1]) :])) & 0xFFFF_FFFF
                blocks = 2 if crossed else 1
                own = len(word.encode()) % blocks
                for other in range(blocks):
                    rows.append((base, piece, key, min(own, other), max(own, other), own > other, word, 7))
    rows.sort()
    names = [*S.GROUP, "second", "word", "n"]
    batches = [
        pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows[i : i + 9]]) for i in range(0, len(rows), 9)
    ]
    near = Counter()
    for found in S._near_in_batches(iter(batches)):
        for row in found.to_pylist():
            near[row["word"]] += row["n_near"]
    pairs = [(a, b) for a, b in itertools.combinations(words, 2) if one_edit(a, b) and min(len(a), len(b)) > 0]
    assert near == Counter(itertools.chain.from_iterable(pairs))


def test_forms_and_roots(spark):
    rng = random.Random(5)
    counts = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 6))): rng.choice([3, 4, 8, 9, 20, 50, 110]) for _ in range(500)}
    counts |= {"x" * 400: 3, "x" * 399: 6, "x" * 200 + "y" + "x" * 199: 12}
    assert mined(spark, counts) == brute(counts)


def test_groups_beyond_a_tile(spark):
    """Blocks meet in pairs: the group of the words without their first third has more than two tiles."""
    letters = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîï"
    counts = {a + b + "zzzz": 3 + (i * 7 + j) % 40 for i, a in enumerate(letters) for j, b in enumerate(letters)}
    assert len(counts) > 3 * S.TILE
    assert mined(spark, counts) == brute(counts)


def test_long_paths_of_forms(spark):
    """Forms that lead to forms, twelve times."""
    counts = {"q" * (5 + i): 3 * 2**i for i in range(13)}
    found = mined(spark, counts)
    assert {r[1] for r in found.values()} == {"q" * 17} and found == brute(counts)


def test_texts(spark, odd_rows, odd_documents, clashing):
    wanted = words_of([(r[0], r[1]) for r in odd_rows])
    for docs in (odd_documents, clashing):
        assert {r["word"]: r["n"] for r in S.counted_words(docs).collect()} == wanted


def test_runs_cross_no_border(spark, monkeypatch):
    """Texts are scanned in parts that end between words."""
    text = " ".join(["longrun" * 40, "short", "Ünder×word", "ab"] * 30)
    parts = []
    monkeypatch.setattr(S, "SCAN", 50)
    for part in S._pieces(text, re.compile(f"[^{S.LETTERS}]")):
        parts.append(part)
    assert "".join(parts) == text and len(parts) > 20
    assert [w for p in parts for w in re.findall(f"[{S.LETTERS}]+", p)] == re.findall(f"[{S.LETTERS}]+", text)


def test_empty(spark, no_documents):
    words = S.counted_words(no_documents)
    assert words.count() == 0 and S.spelling_variants(words).count() == 0


def test_groups(spark):
    counts = {"hello": 20, "hallo": 5, "hell": 3, "other": 3}
    variants = S.spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long"))
    rows = {r["word"]: (r["root"], r["n_words"], r["n_group"]) for r in S.variant_groups(variants).collect()}
    assert rows == {w: ("hello", 3, 28) for w in ("hello", "hallo", "hell")}


def test_query_on_odd_rows(spark, odd_documents, tmp_path):
    odd_documents.write.parquet(f"{tmp_path}/documents.parquet")
    connection = duck(str(tmp_path / "none"))
    connection.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    found = QUERIES["op11_spelling_variants"](spark, str(tmp_path))
    assert difference(found, connection, ORACLES["op11_spelling_variants"]) is None


@pytest.mark.parametrize("words", [["abc", "abd", "xbc"], ["日本語", "日本"]])
def test_matrix_is_padded(words):
    matrix = S._matrix(words, 5)
    assert matrix.shape == (len(words), 5) and not matrix[:, 4].any()
    assert matrix.dtype == (np.uint8 if max(map(ord, "".join(words))) < 256 else np.uint32)
