from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from queuemill.llm import secret_forest as S
from queuemill.llm.queries import QUERIES


def test_query_on_held_out_documents(spark):
    """Judged by where tokens were planted, in documents that the forest was not trained on."""
    sf_dir = "/root/testdata/sf0.1"
    got = QUERIES["op2_secret_forest"](spark, sf_dir).join(
        spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id"), "doc_id", "left_anti"
    )
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").join(got.select("doc_id").distinct(), "doc_id")
    planted = {
        (r["doc_id"], m.start(1))
        for r in texts.collect() for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', r["text"])
    }
    rows = got.collect()
    right = [r["is_secret"] == ((r["doc_id"], r["begin"]) in planted) for r in rows]
    assert len(rows) > 100 and sum(right) / len(right) > 0.98


@pytest.fixture(scope="module")
def scanned(spark):
    draw = random.Random(2)
    rows = []
    for i in range(300):
        value = "".join(draw.choices("0123456789abcdef", k=40))
        rows.append((i, f'we set token = "{value}" here', "src/app"))
        rows.append((i, f"see commit {value} of the example", "docs/test"))
        rows.append((i, f"mail to some.body{i % 90 + 10}@mail1.example.com today", None))
    rows += [(None, None, None), (1000, "", ""), (1001, "x1" * 20_000, "a"), (1001, "x1" * 20_000, "a")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)


def test_findings(scanned):
    found = S.findings(scanned.selectExpr("*", "1 as finding", "2 as features"), frozenset())
    rows = found.collect()
    assert len(rows) == 900 + 2
    assert {len(r["features"]) for r in rows} == {len(S.FEATURES) + S.BESIDE_BUCKETS}
    assert max(len(r["finding"]) for r in rows) == 40_000
    assert S.findings(scanned.limit(0), frozenset()).count() == 0


def test_forest_and_reruns(scanned):
    words = S.dictionary(scanned, size=10)
    assert len(words) == 9 and "token" in words and len(S.dictionary(scanned, size=4)) == 4
    found = S.reviewed(S.findings(scanned, words))
    model = S.train(found.filter("doc_id % 2 = 0"))
    judged = S.judge(found.filter("doc_id % 2 = 1"), model)
    assert judged.filter(F.col("is_secret") != (F.col("label") == 1)).count() <= 3
    again = S.judge(found.repartition(7).filter("doc_id % 2 = 1"), S.train(found.repartition(3).filter("doc_id % 2 = 0")))
    columns = ["doc_id", "begin", "finding", "score"]
    assert judged.select(columns).exceptAll(again.select(columns)).count() == 0


def test_without_both_labels_nothing_is_removed(scanned):
    found = S.reviewed(S.findings(scanned, frozenset()))
    for labelled in (found.filter("label = 0"), found.limit(0), found.withColumn("label", F.lit(None).cast("double"))):
        model = S.train(labelled)
        assert model is None
        judged = S.judge(found, model)
        assert judged.count() == 902 and judged.filter("not is_secret or score is not null").count() == 0


@pytest.mark.parametrize(
    "text, share", [("thetoken", 1.0), ("xxtheyy", 3 / 7), ("123", 0.0), ("", 0.0), ("TOKENthe", 1.0)]
)
def test_dictionary_coverage(text, share):
    assert S.covered(text, frozenset(["the", "token"])) == pytest.approx(share)


VALUE = "q7Zk2Xw9Lr4Tn8Vb"


@pytest.mark.parametrize(
    "text, finding, label",
    [
        (f"API_KEY={VALUE}", VALUE, 1),
        (f"see https://a.io/x?token={VALUE}&page=2 now", VALUE, 1),
        (f'{{"secret": "{VALUE}{VALUE}=="}}', f"{VALUE}{VALUE}==", 1),
        (f"Authorization: Bearer {VALUE}{VALUE}", VALUE + VALUE, 1),
        ("id AKIA" + "Q3ZX" * 4, "AKIA" + "Q3ZX" * 4, 1),
        ("password = 'qZkXw$Lr!TnVb#mPs'", "qZkXw$Lr!TnVb#mPs", 1),
        ("PASSWORD=qZkXwLrTnVbmPsGd", "qZkXwLrTnVbmPsGd", 1),
        (f"commit {VALUE}", VALUE, 0),
        ("api_key = settings.module2.value", "settings.module2.value", 0),
        ("key: https://site.org/page/17", "https://site.org/page/17", 0),
        ("token=your_token_goes_here_1", "your_token_goes_here_1", 0),
    ],
)
def test_assigned_values_are_findings_of_their_own(spark, text, finding, label):
    frame = spark.createDataFrame([(1, text, "a")], "doc_id long, text string, source string")
    rows = S.reviewed(S.findings(frame, frozenset())).collect()
    assert [(r["finding"], r["label"]) for r in rows] == [(finding, label)]
    assert text[rows[0]["begin"] :].startswith(finding)


def test_rare_labels_are_in_the_sample(scanned):
    found = S.reviewed(S.findings(scanned, frozenset()))
    rare = found.filter("label = 0").unionAll(found.filter("label = 1").orderBy("doc_id").limit(3))
    assert S.train(rare, limit=20) is not None
