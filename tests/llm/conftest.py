"""Small tables with the cases that data brings: NULLs, empty and long texts, ties, repeats, clashing names."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"

WORDS = [f"w{i % 97}x{i % 31}" for i in range(4_000)]


def text_of(first: int, count: int) -> str:
    return " ".join(WORDS[first : first + count])


@pytest.fixture(scope="session")
def odd_rows():
    long = "\n".join(text_of(i * 40, 40) + "." for i in range(90))
    same = text_of(100, 80)
    return [
        (1, same, "en", "a"),
        (2, same, "en", "a"),
        (2, same, "en", "a"),
        (3, same + " tail", None, "b"),
        (None, same, "en", "a"),
        (None, None, None, None),
        (4, None, "en", "b"),
        (5, "", "en", "b"),
        (6, " \t\n\x0b ", "en", "b"),
        (7, "one", "en", None),
        (8, long, "de", "c"),
        (9, long + "\nA last line that is not in the others.", "de", "c"),
        (10, "É́ ÀB Àb ẞ 日本語\nTHE SAME LINE, TWENTY\nthe same line, twenty  ", "fr", "é"),
        (11, "x\n  The Same Line, Twenty\n\n", "fr", "é"),
        (12, "\tThe same line, twenty\r\nend", "fr", "é"),
    ]


@pytest.fixture(scope="session")
def odd_documents(spark, odd_rows):
    rows = [(i, t, lang, source, len(t or "")) for i, t, lang, source in odd_rows]
    return spark.createDataFrame(rows, DOCUMENTS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def clashing(odd_documents):
    """Further columns with the names that operators use themselves."""
    names = ["kept", "n_words", "text_key", "sig", "component", "size", "taken", "bucket", "at", "_text", "words"]
    return odd_documents.withColumns({name: F.lit("mine") for name in names})
