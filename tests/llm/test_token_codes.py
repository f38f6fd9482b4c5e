from __future__ import annotations

import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from queuemill.llm import token_codes as C
from queuemill.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2**31) | st.integers(0, 300), max_size=700), st.data())
def test_round_trip_and_random_access(ids, data):
    ids = np.array(ids, np.uint32)
    half = len(ids) // 2
    file = C.TokenFile(C.encode(ids, [7, None, -3], np.array([0, half, len(ids)])))
    assert (file.tokens(0, len(ids)) == ids).all() and file.n_tokens == len(ids)
    assert file.doc_ids.tolist() == [7, 0, -3] and file.missing.tolist() == [False, True, False]
    assert [len(file.document(k)) for k in range(3)] == [0, half, len(ids) - half]
    for _ in range(5):
        a, b = sorted((data.draw(st.integers(0, len(ids))), data.draw(st.integers(0, len(ids)))))
        assert (file.tokens(a, b) == ids[a:b]).all()
        if a < len(ids):
            assert file.token(a) == ids[a]
    with pytest.raises(IndexError):
        file.token(len(ids))


def test_not_a_token_file():
    with pytest.raises(ValueError):
        C.TokenFile(b"something else altogether, long enough")


def test_long_levels_use_the_rank_directory():
    ids = np.random.default_rng(1).zipf(1.3, 50_000).clip(max=49_407).astype(np.uint32)
    content = C.encode(ids, [1], np.array([len(ids)]))
    file = C.TokenFile(content)
    assert len(file.widths) > 1 and len(content) < 2 * len(ids)
    for i in (0, 1, 511, 512, 513, 20_000, 49_999):
        assert file.token(i) == ids[i]
    assert (file.tokens(12_345, 34_567) == ids[12_345:34_567]).all()


@settings(max_examples=200, deadline=None)
@given(
    st.lists(
        st.text(st.sampled_from("abAB Éé\n\t.,'!0²ßİΣςs日<|>-_") | st.characters(codec="utf-8"), max_size=30)
        | st.sampled_from(["a<|endoftext|>b", "<|STARTOFTEXT|>", "it's, don't'll.", "H̱. É́,", "x²! Ⅷ."]),
        min_size=1, max_size=8,
    )
)
def test_encoder_is_the_library(texts):
    encoder = C.encoder(PATH)
    ids, ends = encoder(pa.array(texts, pa.large_string()), 1)
    begin = 0
    for text, end in zip(texts, ends.tolist()):
        assert ids[begin:end].tolist() == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 1]
        begin = end


def expected(rows):
    tokenizer = Tokenizer.from_file(PATH)
    start, found = 0, []
    for doc_id, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        found.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return found


def test_query_is_the_definition(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op9_token_codes"](spark, sf_dir).orderBy("start").collect()
    assert [tuple(r) for r in got] == expected(sorted(rows))


def test_odd_rows_in_small_files(odd_documents, odd_rows, clashing, no_documents):
    for frame in (odd_documents, clashing):
        got = [tuple(r) for r in C.token_index(frame, PATH, file_tokens=50).orderBy("start").collect()]
        assert [r[0] for r in got] == sorted((r[0] for r in odd_rows), key=lambda i: (i is not None, i or 0))
        assert [r[1] for r in got] == [sum(x[2] for x in got[:k]) for k in range(len(got))]
        sums = sorted(((r[0], *r[2:]) for r in got), key=str)
        assert sums == sorted(((r[0], *r[2:]) for r in expected([r[:2] for r in odd_rows])), key=str)
    assert C.token_index(no_documents, PATH).count() == 0


def test_every_letter_and_digit_before_a_mark():
    """Letters whose lower case or normal form ends with a combining mark stay joined with what follows."""
    import sys
    import unicodedata

    tokenizer = Tokenizer.from_file(PATH)
    encoder = C.Encoder(PATH)
    characters = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and not chr(c).isspace()]
    solid = [c for c in characters if c.isalnum() or unicodedata.category(c)[0] == "M"]
    changing = [c for c in solid if unicodedata.normalize("NFC", c).lower() != c]
    words = [f"{c}{C.MARKS[i % len(C.MARKS)]}" for i, c in enumerate(solid)]
    words += [f"a{c}{mark}" for c in changing for mark in C.MARKS[::4]]
    words += ["TARİHİ.", "হয়য়,", "साफ़.", "שׁ!", "é.", "İ)", "≠=", "x≠", "́.", "...", "a..b.."]
    for begin in range(0, len(words), 20_000):
        part = words[begin : begin + 20_000]
        ids, ends = encoder(pa.array(part, pa.large_string()), 1)
        wanted = [w.ids for w in tokenizer.encode_batch(part, add_special_tokens=False)]
        begins = np.concatenate(([0], ends[:-1]))
        wrong = [w for w, b, e, right in zip(part, begins, ends, wanted) if ids[b : e - 1].tolist() != right]
        assert wrong == []


def held_by(action):
    """What ``action`` returns and the bytes it held at most."""
    tracemalloc.start()
    try:
        return action(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_memory_to_write_and_read_a_file():
    ids = np.random.default_rng(2).zipf(1.3, 2_000_000).clip(max=49_407).astype(np.uint32)
    ends = np.array([3, 3, 1_500_000, 1_500_007, *range(1_500_010, len(ids) + 1, 70)])
    ends[-1] = len(ids)
    content, written = held_by(lambda: C.encode(ids, list(range(len(ends))), ends))
    batch = pa.RecordBatch.from_pydict({"path": ["a/part-0.dac"], "content": pa.array([content], pa.binary())})
    rows, read = held_by(lambda: [r for b in C._documents(iter([batch])) for r in b.to_pylist()])
    assert [r["ids_crc32"] for r in rows] == [zlib.crc32(ids[a:b].tobytes()) for a, b in zip([0, *ends[:-1]], ends)]
    assert [r["offset"] + r["n_tokens"] for r in rows] == ends.tolist()
    assert written < 4 * ids.nbytes and read < 4 * ids.nbytes


def test_texts_are_encoded_by_bytes(monkeypatch, tmp_path):
    """However long the rows are, a call gets few bytes of them, and words that were forgotten come back the same."""
    texts = [None, "", *(" ".join(f"w{i}x{j}," for j in range(i * 40)) for i in range(60)), "one two"]
    calls, whole, path = [], C.Encoder(PATH), str(tmp_path)

    def counted(part, end_id):
        calls.append((len(part), sum(len(t) for t in part.to_pylist())))
        return small(part, end_id)

    small = C.Encoder(PATH)
    monkeypatch.setattr(C, "encoder", lambda _: counted)
    monkeypatch.setattr(C, "ENCODE_BYTES", 10_000, raising=False)
    monkeypatch.setattr(C.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    wanted, ends = whole(pa.array([t or "" for t in texts], pa.large_string()), 1)
    monkeypatch.setattr(C, "REMEMBERED", 1_000)
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts)})
    list(C._writer(path, PATH, 1, len(wanted) // 2)(iter([batch])))
    files = [C.TokenFile(f.read_bytes()) for f in sorted(tmp_path.glob("part-*.dac"))]
    assert len(files) > 1 and np.concatenate([f.doc_ids for f in files]).tolist() == list(range(len(texts)))
    assert (np.concatenate([f.tokens(0, f.n_tokens) for f in files]) == wanted).all() and ends[-1] == len(wanted)
    assert len(calls) > 10 and all(rows == 1 or size <= 10_000 for rows, size in calls)
