from __future__ import annotations

import random
import re
import subprocess
import sys
from collections import Counter
from pathlib import Path

import corpus_pipeline as pipeline
import pytest

import __spark_entry__ as entry
from test_decontaminate import brute as contaminated
from test_jaccard_join import brute as linked
from test_quality import verdicts
from test_token_codes import expected

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder of tables with good, junk, copied and contaminated documents."""
    draw = random.Random(5)
    words = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(120):
        text = "\n".join(" ".join(draw.choices(words, k=30)) for _ in range(draw.randint(3, 9)))
        if i % 9 == 4:
            text = " ".join(f"junk{draw.randrange(10**6)}{draw.choice(['***', '###'])}" for _ in range(90))
        if i % 10 == 7 and rows:
            text = rows[-1][1] + " added"
        rows.append((i, text, "en", ["a", "b", "c", None][i % 4], len(text)))
    rows[50] = (50, rows[50][1] + "\n" + " ".join(words[:14]).upper(), "en", "b", 0)
    rows += [(200, None, None, None, None), (201, "", "en", "a", 0), rows[3], rows[3]]
    folder = tmp_path_factory.mktemp("corpus")
    tables = {
        "documents": (rows, "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": ([(i, int(i % 9 != 4), 0) for i in range(0, 120, 2)], "doc_id long, quality int, toxic int"),
        "benchmark": ([(0, " ".join(words[:12])), (1, None)], "item_id long, text string"),
    }
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return str(folder), rows


def stage(number):
    return pipeline.STAGES[number][1]


def pairs(frame):
    return [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]


def test_every_stage_is_its_definition(spark, corpus):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    good = {i for i in range(0, 120, 2) if i % 9 != 4}
    wanted = Counter(r[:2] for r, v in zip(rows, verdicts([r[:2] for r in rows], good)) if v[-1])
    kept = stage(0)(spark, docs, folder)
    assert kept.columns == pipeline.COLUMNS and Counter(pairs(kept)) == wanted and 40 < len(pairs(kept)) < 100

    before = pairs(kept)
    one = stage(1)(spark, kept, folder)
    groups = linked(before)
    assert one.columns == pipeline.COLUMNS
    assert sorted(d for d, _ in pairs(one)) == sorted({component for _, _, component in groups})

    before = pairs(one)
    clean = stage(2)(spark, one, folder)
    dirty = {r[0] for r in contaminated(before, [(0, " ".join(f"word{i}" for i in range(12)))]) if r[-1]}
    assert dirty == {50} and sorted(pairs(clean)) == sorted(p for p in before if p[0] not in dirty)

    before = dict(pairs(clean))
    mix = stage(3)(spark, clean, folder)
    assert mix.columns == pipeline.COLUMNS and mix.filter("n_chars <> length(text)").count() == 0
    taken = Counter()
    for doc_id, text in pairs(mix):
        taken[doc_id] += len(WORD.findall(text))
        assert all(part in before[doc_id] for part in text.split("\n"))
    assert all(n <= 3 * len(WORD.findall(before[d])) for d, n in taken.items())

    got = stage(4)(spark, mix, folder).orderBy("start").collect()
    mixed = pairs(mix)
    assert [r["doc_id"] for r in got] == sorted(d for d, _ in mixed)
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((d, n, c) for d, _, n, c in expected(mixed))
    assert [r["start"] for r in got] == [sum(r["n_tokens"] for r in got[:k]) for k in range(len(got))]


def test_run_agrees_with_the_stages(spark, corpus):
    folder, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, function in pipeline.STAGES:
        docs = function(spark, docs, folder)
    assert sorted(map(tuple, docs.collect())) == sorted(map(tuple, pipeline.run(spark, folder).collect()))


def test_no_documents(spark, corpus, tmp_path):
    folder, _ = corpus
    for name in ("documents", "labels", "benchmark"):
        frame = spark.read.parquet(f"{folder}/{name}.parquet")
        (frame.limit(0) if name == "documents" else frame).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    names = [f"op{n}_" for n in range(1, 11)]
    known = entry.queries()
    assert all(any(k.startswith(n) for k in known) for n in names) and "pipeline" in known
    assert set(entry.oracle_sql()) <= set(known)


def test_the_rest_does_without_these_folders():
    """With the subpackage and the pipeline out of reach, the entry still has all other queries."""
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.split('.')[0] == 'corpus_pipeline' or name.startswith('queuemill.llm'):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert len(e.queries()) > 90 and not any(k.startswith('op') or k == 'pipeline' for k in e.queries())
"""
    root = Path(pipeline.__file__).parent
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
