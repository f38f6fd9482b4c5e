from __future__ import annotations

import math
import re
from collections import Counter

import pytest
import xxhash

from queuemill.llm import quality
from queuemill.llm.queries import QUERIES

FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKEN = re.compile(r"[^\W_]+|(?:[^\w\s]|_)+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    covered = {p for i, w in enumerate(windows) if w in twice for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def bucket(*words):
    seed = 42
    for word in words:
        if word is not None:
            seed = xxhash.xxh64_intdigest(word.encode(), seed)
    signed = seed - (1 << 64) if seed >> 63 else seed
    return signed % quality.BUCKETS


def features(text):
    tokens = TOKEN.findall(text or "")
    for a, b in zip(tokens, [*tokens[1:], None]):
        yield bucket(a)
        yield bucket(a, b) + quality.BUCKETS


def verdicts(rows, good):
    """By definition: (base fields, score, kept) of each (id, text)."""
    raw, trusted = Counter(), Counter()
    for doc_id, text in rows:
        raw.update(features(text))
        if doc_id in good:
            trusted.update(features(text))
    share = lambda counts, f: (counts[f] + 1) / (counts.total() + 2 * quality.BUCKETS)
    found = []
    for doc_id, text in rows:
        scores = [math.log(share(trusted, f)) - math.log(share(raw, f)) for f in features(text)]
        llr = sum(scores) / len(scores) if scores else None
        fields = base(text)
        found.append((doc_id, *fields, llr, not fields[-1] and llr is not None and llr >= quality.THRESHOLD))
    return found


def key(row):
    return tuple((x is None, str(x)) for x in row)


def compared(got, wanted):
    rounded = lambda rows: sorted((tuple(round(x, 6) + 0.0 if isinstance(x, float) else x for x in r) for r in rows), key=key)
    assert rounded(got) == rounded(wanted)


def test_query_is_the_definition(spark, tables):
    sf_dir = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").collect()
    got = QUERIES["op7_quality_rules"](spark, sf_dir).select("doc_id", *FIELDS, "llr", "kept").collect()
    compared([tuple(r) for r in got], verdicts(docs, {r["doc_id"] for r in labels}))


def test_odd_rows(spark, odd_documents, odd_rows, clashing, no_documents):
    trusted = spark.createDataFrame([(8,), (1,)], "doc_id bigint")
    model = quality.fit(odd_documents, trusted)
    got = quality.judge(odd_documents, model).select("doc_id", *FIELDS, "llr", "kept").collect()
    compared([tuple(r) for r in got], verdicts([r[:2] for r in odd_rows], {1, 8}))
    other = quality.judge(clashing, model)
    assert other.count() == len(odd_rows) and other.columns.count("kept") == 1
    assert quality.judge(no_documents, quality.fit(no_documents, trusted)).count() == 0


def test_held_out_labels(spark):
    """The model is fitted without the labels of every fifth document, and judges those."""
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, quality.trusted_ids(labels.filter("doc_id % 5 > 0")))
    rows = quality.judge(docs.join(labels.filter("doc_id % 5 = 0"), "doc_id"), model).filter("not base_failed").collect()
    right = [r["kept"] == (r["quality"] == 1) for r in rows]
    assert len(right) > 40 and sum(right) / len(right) > 0.97


def test_trusted_ids_are_bounded(spark):
    labels = spark.createDataFrame([(i, 1) for i in range(100)] + [(None, 1), (5, 1), (200, 0)], "doc_id long, quality int")
    assert quality.trusted_ids(labels, 10).count() == 10
    assert quality.trusted_ids(labels).count() == 100
    assert sorted(quality.trusted_ids(labels, 10).collect()) == sorted(quality.trusted_ids(labels.repartition(7), 10).collect())


@pytest.mark.parametrize("text", ["a b c a b c", "a a a a", "a b c", "a b", "", None])
def test_repeated_words(spark, text):
    row = quality.base_counts(spark.createDataFrame([(text,)], "text string")).select(*FIELDS).first()
    assert tuple(row) == base(text)


def test_without_trusted_texts_only_the_base_rules_count(spark, odd_documents):
    nobody = spark.createDataFrame([], "doc_id bigint")
    judged = quality.judge(odd_documents, quality.fit(odd_documents, nobody)).filter("llr is not null")
    assert judged.filter("llr <> 0 or kept = base_failed").count() == 0 and judged.filter("kept").count() > 0
