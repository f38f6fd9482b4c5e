"""Secret scan: candidates by pattern, false positives removed by a random forest trained on labelled findings.

A candidate is a run of at least ``MIN_LENGTH`` key characters with a letter and a digit, ``=`` only as padding at its end;
after the name of a credential also one without a digit or with other characters. Its features are its length,
its transitions between character classes and between characters, how much of it the corpus' common words cover,
its path and the words beside it. The forest is trained on ``MAX_LABELLED`` labelled findings at most (of each label
those with the smallest hashes, weighted by what they stand for); counting words, finding candidates and scoring cover every text.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuemill.llm.text import white_words

MIN_LENGTH = 16
MAX_LABELLED = 20_000
#: Common words of the corpus that make the dictionary.
DICTIONARY = 2_000
#: Characters before a candidate that are its line.
LINE = 60
#: Words before and after a candidate that are looked at.
BESIDE = 3
BESIDE_BUCKETS = 16
TREES, DEPTH, SEED = 30, 6, 7
CUT = 0.5

KEY_CHARS = "A-Za-z0-9+/_.~-"
CANDIDATE = re.compile(
    rf"(?<![{KEY_CHARS}])(?=[{KEY_CHARS}]*[A-Za-z])(?=[{KEY_CHARS}]*\d)[{KEY_CHARS}]{{{MIN_LENGTH},}}(?:={{1,2}}(?![={KEY_CHARS}]))?"
)
#: What stands before a value that a credential's name is given; for Python and Java.
GIVEN = r"(?i)((token|key|secret|passw(or)?d|pwd|credential)[A-Za-z0-9_]*[\"']?\s*[=:]\s*|bearer\s+)[\"']?$"
NAME_BEFORE = re.compile(GIVEN)
#: Values of any characters, in quotes or up to a separator.
VALUE = re.compile(
    rf"(?:[=:]\s*|[Bb]earer\s+|BEARER\s+)(?:[\"'](?P<quoted>[^\s\"'=]{{{MIN_LENGTH},}}={{0,2}})(?=[\"'])"
    rf"|(?P<bare>[^\s\"'=<>&,;#(){{}}\[\]]{{{MIN_LENGTH},}}(?:={{1,2}}(?![^\s\"'<>&,;#(){{}}\[\]]))?))"
)
WORD = re.compile(r"[^\W\d_]+")

#: Names that credentials are given, and words of placeholders.
NAMES = frozenset("token key secret password passwd pwd credential credentials auth bearer apikey access private".split())
PLACEHOLDERS = frozenset("example sample dummy test fake placeholder changeme redacted todo your xxx".split())

FEATURES = (
    "length", "digits", "upper", "lower", "marks", "class_changes", "entropy", "pair_entropy", "hex", "longest_run",
    "covered", "quoted", "assigned", "named", "placeholder", "at_sign", "path_length", "path_depth", "path_test",
)


def dictionary(docs: DataFrame, text_col: str = "text", size: int = DICTIONARY) -> frozenset[str]:
    """The corpus' most common words of three letters or more; ``size`` of them at most reach the driver."""
    words = docs.select(F.explode(white_words(F.col(text_col))).alias("word"))
    counts = words.groupBy("word").count().filter(F.col("word").rlike(r"^\p{L}{3,}$"))
    top = counts.groupBy(F.lower("word").alias("word")).agg(F.sum("count").alias("n"))
    return frozenset(row["word"] for row in top.orderBy(F.desc("n"), "word").limit(size).collect())


def _entropy(counts: Counter) -> float:
    total = sum(counts.values())
    return -sum(n / total * math.log2(n / total) for n in counts.values()) if total else 0.0


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3


def covered(text: str, words: frozenset[str]) -> float:
    """Share of the letters of ``text`` that common words cover, longest word first from the left."""
    letters = hits = 0
    for run in WORD.findall(text.lower()):
        letters += len(run)
        at = 0
        while at < len(run):
            size = next((k for k in range(min(12, len(run) - at), 2, -1) if run[at : at + k] in words), 0)
            hits += size
            at += size or 1
    return hits / letters if letters else 0.0


def features(text: str, begin: int, end: int, path: str, words: frozenset[str]) -> list[float]:
    found = text[begin:end]
    kinds = [_kind(c) for c in found]
    n = len(found)
    left, right = text[max(0, begin - LINE) : begin], text[end : end + 40]
    before = [w.lower() for w in WORD.findall(left)][-BESIDE:]
    after = [w.lower() for w in WORD.findall(right)][:BESIDE]
    runs = re.findall(r"[A-Za-z]+|\d+|[^A-Za-z\d]+", found)
    near = [0.0] * BESIDE_BUCKETS
    for word in (*before, *after):
        near[sum(word.encode()) * 31 % BESIDE_BUCKETS] = 1.0
    parts = WORD.findall(path.lower())
    return [
        float(n),
        *(kinds.count(k) / n for k in range(4)),
        sum(a != b for a, b in zip(kinds, kinds[1:])) / n,
        _entropy(Counter(found)),
        _entropy(Counter(zip(found, found[1:]))),
        float(all(c in "0123456789abcdefABCDEF" for c in found)),
        max(map(len, runs)) / n,
        covered(found, words),
        float(left[-1:] in "\"'" and left != "" and right[:1] == left[-1:]),
        float(bool(re.search(r"[=:]\s*[\"']?$", left))),
        float(not NAMES.isdisjoint(before)),
        float(not PLACEHOLDERS.isdisjoint([*before, *after, *WORD.findall(found.lower())])),
        float("@" in (left[-1:], right[:1])),
        float(len(path)),
        float(path.count("/")),
        float(not {"test", "tests", "example", "examples", "docs"}.isdisjoint(parts)),
        *near,
    ]


def candidates(text: str) -> list[tuple[int, int]]:
    """Begin and end of every candidate, in order; a credential's value is one whole."""
    spans = [m.span() for m in CANDIDATE.finditer(text)]
    values = [m.span(m.lastgroup) for m in VALUE.finditer(text)]
    values = [v for v in values if NAME_BEFORE.search(text[max(0, v[0] - LINE) : v[0]])]
    if values:
        begins = [begin for begin, _ in values]

        def inside(span: tuple[int, int]) -> bool:
            at = bisect_left(begins, span[1]) - 1
            return at >= 0 and values[at][1] > span[0]

        spans = sorted([s for s in spans if not inside(s)] + values)
    return spans


_FINDINGS = "doc_id bigint, begin bigint, finding string, line string, features array<double>"


def findings(
    docs: DataFrame, words: frozenset[str], text_col: str = "text", id_col: str = "doc_id", path_col: str = "source"
) -> DataFrame:
    """All candidates: doc_id, begin (code point), finding, line (the 60 characters before it), features.

    NULL and empty texts have none, a NULL path is an empty one; rows of one id are scanned by themselves.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, path in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for begin, end in candidates(text or ""):
                    row = (doc_id, begin, text[begin:end], text[max(0, begin - LINE) : begin])
                    rows.append((*row, features(text, begin, end, path or "", words)))
            names = ["doc_id", "begin", "finding", "line", "features"]
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.float64())]
            columns = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)

    chosen = docs.select(F.col(id_col).cast("bigint"), F.col(text_col), F.col(path_col).cast("string"))
    return chosen.mapInArrow(scan, _FINDINGS)


def reviewed(found: DataFrame) -> DataFrame:
    """Findings with ``label``, as a reviewer with the whole line would give it: 1 for a random value that a name of a
    credential is given or that has the form of an access key, else 0. Values made of common words, dotted names, URLs
    and placeholders are not random. Stands in for a table of reviewed findings, which has the same columns."""
    value = F.col("finding")
    form = value.rlike(r"^(AKIA|ASIA)[A-Z0-9]{16}$")
    token = value.rlike(r"^eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*$")
    dotted = value.rlike(r"^[A-Za-z0-9+/_.~-]*[.~][A-Za-z0-9+/_.~-]*=*$") & ~token
    spelled = F.col("features")[FEATURES.index("covered")] >= 0.5
    random = value.rlike(r"^[!-~]+$") & ~dotted & ~spelled & ~value.rlike("^[A-Za-z]+://")
    placeholder = value.rlike("(?i)example|sample|dummy|placeholder|changeme|redacted|your|x{4}")
    return found.withColumn("label", ((form | (F.col("line").rlike(GIVEN) & random)) & ~placeholder).cast("double"))


def train(labelled: DataFrame, limit: int = MAX_LABELLED) -> RandomForestClassificationModel | None:
    """The forest, from findings with ``features`` and ``label``; None unless both labels occur.

    Each label has half of the ``limit``, and what the other one leaves."""
    rows = labelled.filter("label in (0, 1)").select("features", "label", F.xxhash64("doc_id", "begin", "finding").alias("k"))
    counts = {row["label"]: row["count"] for row in rows.groupBy("label").count().collect()}
    if len(counts) < 2:
        return None
    parts = []
    for label, n in sorted(counts.items()):
        part = max(1, limit // 2, limit - counts[1 - label])
        chosen = rows.filter(F.col("label") == label).orderBy("k").limit(part)
        parts.append(chosen.withColumn("weight", F.lit(max(1.0, n / part))))
    rows = parts[0].unionAll(parts[1]).coalesce(1).sortWithinPartitions("label", "k")
    rows = rows.select(array_to_vector("features").alias("vector"), "label", "weight")
    rows = rows.cache()  # bounded; one order, so that reruns agree
    try:
        forest = RandomForestClassifier(
            featuresCol="vector", labelCol="label", weightCol="weight", numTrees=TREES, maxDepth=DEPTH, seed=SEED, cacheNodeIds=False
        )
        return forest.fit(rows)
    finally:
        rows.unpersist()


def judge(found: DataFrame, model: RandomForestClassificationModel | None, cut: float = CUT) -> DataFrame:
    """Findings with ``score`` and ``is_secret``. Without a model nothing is removed: score is NULL, all stay."""
    if model is None:
        return found.select("*", F.lit(None).cast("double").alias("score"), F.lit(True).alias("is_secret"))
    scored = model.transform(found.withColumn("vector", array_to_vector("features")))
    score = F.round(vector_to_array("probability")[1], 6)
    return scored.select(*found.columns, score.alias("score"), (score >= cut).alias("is_secret"))
