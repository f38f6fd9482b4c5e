from __future__ import annotations

from collections import defaultdict

import pytest

from queuemill.llm import sentence_spans as S
from queuemill.llm.queries import QUERIES


def brute(rows):
    """(doc_id, text without repeats, sentences, removed); equal rows are one document."""
    places, pieces = defaultdict(set), {}
    for doc_id, text in set(rows):
        found = pieces[doc_id, text] = S.sentences(text or "")
        words = [tuple(p.lower().split()) for p in found]
        for a in range(len(found) - 1):
            places[tuple(words[a : a + 2])].add(((doc_id is not None, doc_id or 0), text or "", a, (doc_id, text)))
    gone = defaultdict(set)
    for spots in places.values():
        first = min(spots, key=lambda s: s[0])
        ties = [s for s in spots if s[0] == first[0]]
        assert len({s[1] for s in ties}) == 1, "one id with several texts: see test_one_id_with_two_texts"
        first = min(ties, key=lambda s: s[2])
        for spot in spots - {first}:  # by place; short stretches stay
            gone[spot[3]] |= {spot[2], spot[2] + 1}
    for key, marked in gone.items():
        for first in [i for i in marked if i - 1 not in marked]:
            last = next(i for i in range(first, len(pieces[key]) + 1) if i not in marked)
            if sum(len(p.split()) for p in pieces[key][first:last]) < 20:
                gone[key] = gone[key] - set(range(first, last))
    return sorted(
        ((d, "".join(p for i, p in enumerate(pieces[d, t]) if i not in gone[d, t]), len(pieces[d, t]), len(gone[d, t])) for d, t in rows),
        key=str,
    )


def found(frame, **options):
    rows = S.dedup_spans(frame, **options).select("doc_id", "text", "n_sentences", "n_removed").collect()
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize("text", ["One. Two! Three? x\n\n  y\n z", "", "\n \n a.b c", "no end", '"Said." (So.) e.g. x', "a. b"])
def test_cutting_loses_nothing(text):
    assert "".join(S.sentences(text)) == text
    assert all(p.strip() for p in S.sentences(text)[1:])


def test_odd_rows(odd_documents, odd_rows, clashing, no_documents):
    wanted = brute([r[:2] for r in odd_rows])
    assert found(odd_documents) == wanted and found(clashing) == wanted
    assert found(no_documents) == []


PASSAGE = "It was told of old that rivers rise in the high hills. They run down to the sea through many lands and towns. Nobody has ever seen one run up again."


def test_a_passage_stays_once(spark):
    own = "Here is a sentence of document {0} alone. And another one, number {0}, quite as long as that."
    rows = [(i, f"{own.format(i)} {PASSAGE} {own.format(i + 100)}") for i in range(5)]
    rows += [(9, PASSAGE.upper().replace(" ", "  ")), (10, own.format(10)), (11, f"{PASSAGE} {PASSAGE}")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(frame) == brute(rows)
    kept = {r[0]: r for r in found(frame)}
    assert kept[0][1] == rows[0][1] and kept[10][1] == rows[6][1]
    assert [kept[i][3] for i in (1, 2, 3, 4, 9, 11)] == [3, 3, 3, 3, 3, 6]


def test_short_runs_may_repeat(spark):
    rows = [(i, f"Yes. No. Well. Number {i} says so.") for i in range(4)]
    assert all(r[3] == 0 for r in found(spark.createDataFrame(rows, "doc_id long, text string")))


def test_one_id_with_two_texts(spark):
    rows = [(1, PASSAGE), (1, PASSAGE + " More."), (2, PASSAGE)]
    got = found(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sum(r[3] for r in got if r[0] == 1) == 3 and [r[3] for r in got if r[0] == 2] == [3]


def test_query_is_the_definition(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op4_sentence_spans"](spark, sf_dir).select("doc_id", "text", "n_sentences", "n_removed").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


RUN = "a long sentence of more than forty words which has no full stop before its very end and which other texts quote between their own words as if it had been theirs from the start so that nobody can tell any more who wrote it first"


def test_sentences_without_repeated_neighbours(spark):
    """Exact copies of one sentence, a long sentence between others, a run inside a text without end marks."""
    own = "Words of number {0} come {0} here."
    rows = [(1, RUN + "."), (2, RUN + "."), (3, f"{own.format(3)} {RUN}. {own.format(33)}")]
    before, after = (" ".join(f"{c}{i}" for i in range(60)) for c in "pq")
    rows.append((4, f"{before} {RUN} {after}"))
    got = {r[0]: r[1] for r in found(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert got[1] == rows[0][1] and got[2] == "" and got[3] == f"{own.format(3)} {own.format(33)}"
    assert "forty words" in RUN and len(got[4].split()) < len(rows[3][1].split()) - 20
    assert got[4].startswith(before) and got[4].endswith(after)


def test_a_short_text_is_one_span(spark):
    rows = [(1, "Only a few words."), (2, "only a  few words."), (3, "Only a few words. And more.")]
    got = found(spark.createDataFrame(rows, "doc_id long, text string"), min_words=3)
    assert [r[3] for r in got] == [0, 1, 0]


def test_full_width_marks_and_scripts_without_spaces(spark):
    assert S.sentences("\u6cb3\u6d41\u3002\u5c71\u9ad8\uff01\u300c\u597d\u3002\u300d\u6d77") == ["\u6cb3\u6d41\u3002", "\u5c71\u9ad8\uff01", "\u300c\u597d\u3002\u300d", "\u6d77"]
    text = "".join(chr(0x4E00 + i * 37 % 4001) for i in range(200))
    other = "".join(chr(0x7000 + i * 53 % 4001) for i in range(60))
    assert "".join(S.sentences(text)) == text and max(map(len, S.sentences(text))) <= S.MOST_WORDS + S.LEAST_WORDS
    rows = [(1, text), (2, other + text)]
    got = {r[0]: r[1] for r in found(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert got[1] == text and got[2].startswith(other) and len(got[2]) < 60 + 40
