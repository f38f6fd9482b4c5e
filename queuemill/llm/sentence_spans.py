"""Substring de-duplication by sliding sentence spans.

A span is a run of ``SENTENCES`` consecutive sentences, one from every sentence on. Equal spans of all documents are
found by 128-bit hashes. The first one, by document id and place, stays; sentences that any other repeated span covers
go, where such spans together cover ``MIN_WORDS`` words or more on end. So a short phrase may recur, and a passage goes
whole, up to its last sentence.

A sentence of ``LONG_WORDS`` words or more counts as several: it is cut where the hash of two neighbouring words is a local
minimum, so that a run of words is cut alike in every sentence that holds it. So a long sentence is found by itself,
whatever stands beside it, and so is a passage of a text without end marks. A text with fewer sentences than a span is
one span.

Span counts are combined before the shuffle, and rows are joined to the repeated spans only, so a passage that
a third of all documents share is no long task.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from operator import xor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuemill.llm.text import text_key
from queuemill.session import stored

SENTENCES = 2
MIN_WORDS = 20

#: Sentences of so many words are cut, into pieces of ``LEAST_WORDS`` to ``MOST_WORDS`` (fewer at forced cuts).
LONG_WORDS = 20
LEAST_WORDS, MOST_WORDS = 5, 15

#: A sentence ends with a full stop, mark or ellipsis before white space, or with its line.
BORDER = re.compile(r"[.!?…。\n](?:(?<=\n)\s*|\s+|(?<=[.!?…])[\"')\]]\s+)")
#: Full-width marks need no white space; texts without them take the short way.
FULL_WIDTH = re.compile("[。！？｡]")
FULL_WIDTH_BORDER = re.compile(
    BORDER.pattern + r"|(?<=[。！？｡])(?![。！？｡」』”’）】])\s*|(?<=[。！？｡][」』”’）】])(?![。！？｡」』”’）】])\s*"
)
#: Scripts without spaces: Thai, Lao, Myanmar, Khmer, kana, Han. Each of their characters counts as a word.
SPACELESS = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
HAS_SPACELESS = re.compile(f"[{SPACELESS}]")
WORD = re.compile(rf"[{SPACELESS}]\s*|[^\s{SPACELESS}]+\s*")
KEY = ["span_hash", "span_hash_2"]


def has_spaceless(text: str) -> bool:
    return not text.isascii() and HAS_SPACELESS.search(text) is not None


def count_words(text: str) -> int:
    return sum(1 for _ in WORD.finditer(text)) if has_spaceless(text) else len(text.split())


def cuts(words: list[bytes]) -> list[int]:
    """Numbers of words after which a long sentence is cut; they depend on the words nearby only."""
    hashes = list(map(zlib.crc32, words))
    sums = list(map(xor, hashes, hashes[1:]))
    found, last, reach = [], 0, LEAST_WORDS
    for i in range(reach, len(words) - reach):
        x = sums[i]
        if i + 1 - last == MOST_WORDS or (
            sums[i - 1] > x <= sums[i + 1] and min(sums[i - reach : i]) > x <= min(sums[i : i + reach + 1])
        ):
            found.append(i + 1)
            last = i + 1
    return found


def bounded(sentence: str, spaceless: bool) -> list[str]:
    """The sentence, cut into pieces if it is long; white space stays with the word before it."""
    if len(sentence) < (LONG_WORDS if spaceless else 2 * LONG_WORDS - 1):
        return [sentence]
    if spaceless:
        found = list(WORD.finditer(sentence))
        words = [m[0].strip().lower().encode("utf-8", "replace") for m in found]
    else:
        words = " ".join(sentence.lower().split()).encode("utf-8", "replace").split(b" ")
    if len(words) < LONG_WORDS:
        return [sentence]
    if spaceless:
        borders = [found[n].start() for n in cuts(words)]
        return [sentence[a:b] for a, b in zip([0, *borders], [*borders, len(sentence)])]
    pieces, last = [], 0
    for n in cuts(words):
        rest = sentence.split(None, n - last)[-1]
        pieces.append(sentence[: len(sentence) - len(rest)])
        sentence, last = rest, n
    return [*pieces, sentence]


def sentences(text: str) -> list[str]:
    """The text cut after its sentences and inside long ones; white space stays with the sentence before it."""
    found, begin = [], 0
    wide = not text.isascii() and FULL_WIDTH.search(text)
    for border in (FULL_WIDTH_BORDER if wide else BORDER).finditer(text):
        piece = text[begin : border.end()]
        begin = border.end()
        if found and not piece.strip():
            found[-1] += piece
        elif piece:
            found.append(piece)
    if begin < len(text):
        found.append(text[begin:])
    spaceless = has_spaceless(text)
    return [piece for sentence in found for piece in bounded(sentence, spaceless)]


def spans(pieces: list[str], count: int) -> Iterator[bytes]:
    """Hash of the span from each sentence on; one of all, if they are fewer. Case and white space make no difference."""
    import xxhash

    digests = [xxhash.xxh3_128_digest(" ".join(p.lower().split()).encode("utf-8", "replace")) for p in pieces]
    for begin in range(max(len(pieces) - count + 1, min(len(pieces), 1))):
        yield xxhash.xxh3_128_digest(b"".join(digests[begin : begin + count]))


_SPANS = "doc_id bigint, text_key bigint, at int, span_hash bigint, span_hash_2 bigint"


def document_spans(docs: DataFrame, count: int = SENTENCES) -> DataFrame:
    """Spans of ``docs`` (doc_id, text_key, text)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(5)]
            for doc_id, key, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_key", "text"))):
                for at, digest in enumerate(spans(sentences(text or ""), count)):
                    one, two = (int.from_bytes(d, "little", signed=True) for d in (digest[:8], digest[8:]))
                    for column, value in zip(columns, (doc_id, key, at, one, two)):
                        column.append(value)
                if len(columns[0]) > 100_000:
                    yield _rows(columns)
                    columns = [[] for _ in range(5)]
            yield _rows(columns)

    def _rows(columns: list[list]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        names = ["doc_id", "text_key", "at", *KEY]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return docs.select("doc_id", "text_key", "text").mapInArrow(find, _SPANS)


def repeated_spans(found: DataFrame) -> DataFrame:
    """Per document with repeats: doc_id, text_key, ``repeats`` (first sentences of spans that others came before)."""
    place = F.struct("doc_id", "text_key", "at")
    repeated = found.groupBy(*KEY).agg(F.min(place).alias("first"), F.count("*").alias("times"))
    # stored, so that both sides of the join are dealt anew and a hot span's rows can be split
    repeated = stored(repeated.filter("times > 1").select(*KEY, "first"), "repeated-spans")
    later = found.join(repeated, KEY).filter(~place.eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "text_key").agg(F.collect_set("at").alias("repeats"))


def covered(pieces: list[str], repeats: list[int], count: int, min_words: int) -> set[int]:
    """Sentences that go: those of repeated spans, in stretches of ``min_words`` or more."""
    gone: set[int] = set()
    stretch: list[int] = []
    marked = sorted({i for at in repeats for i in range(at, min(at + count, len(pieces)))})
    for place, i in enumerate(marked):
        stretch.append(i)
        if place + 1 == len(marked) or marked[place + 1] > i + 1:
            if sum(count_words(pieces[k]) for k in stretch) >= min_words:
                gone.update(stretch)
            stretch = []
    return gone


def dedup_spans(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    count: int = SENTENCES,
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """Every row with its text shortened: doc_id, text, n_sentences, n_removed, removed_words.

    Each piece of a long sentence counts as a sentence.
    Ids are whole numbers, NULL ones come before all others. Equal rows (one id, one text) are one document with one
    result, and no repeats of each other; texts of one id that differ are in an order of their own. NULL texts become
    empty; texts without a repeat are not touched.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("text_key", text_key(F.col("text")))
    found = stored(document_spans(rows, count), "sentence-spans")
    later = repeated_spans(found).select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "repeats"
    )
    marked = rows.join(later, rows["doc_id"].eqNullSafe(F.col("_id")) & (rows["text_key"] == F.col("_key")), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, numbers, removed, words = [], [], [], []
            for text, drops in zip(batch.column("text").to_pylist(), batch.column("repeats").to_pylist()):
                pieces = sentences(text or "")
                out = covered(pieces, drops, count, min_words) if drops else set()
                kept = [p for i, p in enumerate(pieces) if i not in out] if out else pieces
                texts.append("".join(kept))
                numbers.append(len(pieces))
                removed.append(len(out))
                words.append(sum(count_words(pieces[i]) for i in out))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.string())] + [pa.array(x, pa.int64()) for x in (numbers, removed, words)],
                names=["doc_id", "text", "n_sentences", "n_removed", "removed_words"],
            )

    return marked.select("doc_id", "text", "repeats").mapInArrow(
        cut, "doc_id bigint, text string, n_sentences bigint, n_removed bigint, removed_words bigint"
    )
