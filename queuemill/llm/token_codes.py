"""Token ids in directly addressable codes: any token can be read without decoding its neighbours.

An id is cut into chunks of a few bits, lowest first, one level per chunk. A level holds the chunks of all
ids that reach it, packed at fixed width, and one continuation bit each that says whether the id goes on;
a rank directory counts the set bits before every 512th. Token ``i`` is then chunk ``i`` of the first level,
and, while its bit is set, chunk ``rank(i)`` of the next one. Widths are chosen per file, from the counts of
its ids, so that the file is smallest.

File layout, little-endian: ``DACS1``, the number of levels and their widths (one byte each), padding to
16 bytes, n_tokens and n_docs (u64); per document its id (i64), a NULL mark (u8) and the token after its last
(u64); per level its length (u64), the packed chunks, the bits and the ranks (u64), each padded to 8 bytes.
"""

from __future__ import annotations

import functools
import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from queuemill.llm.storage import write_file
from queuemill.llm.text import text_key
from queuemill.session import scratch_path

MAGIC = b"DACS1"
RANK_BITS = 512
#: Tokens after which a task begins the next file.
FILE_TOKENS = 1 << 23
END_ID = 1
#: Bytes of text encoded at a time (a longer text is taken whole), and distinct words after which a worker
#: forgets what it remembers.
ENCODE_BYTES = 1 << 21
REMEMBERED = 500_000
#: Ids packed, unpacked or summed up at a time.
SLICE = 1 << 16


def best_widths(ids: np.ndarray) -> tuple[int, ...]:
    """Widths of one to three chunks that give the fewest bits for these ids."""
    lengths = np.zeros(33, np.int64)  # ids of so many bits
    for a in range(0, len(ids), SLICE):
        lengths += np.bincount(np.frexp(ids[a : a + SLICE].astype(np.float64))[1], minlength=33)
    bits = max(1, int(np.flatnonzero(lengths).max(initial=1)))
    longer = lambda k: int(lengths[k + 1 :].sum())  # ids of more than k bits

    def cost(widths: tuple[int, ...]) -> int:
        total, begun = 0, 0
        for level, width in enumerate(widths):
            total += (longer(begun) if begun else len(ids)) * (width + (level < len(widths) - 1))
            begun += width
        return total

    options = [(bits,)]
    options += [(a, bits - a) for a in range(1, bits)]
    options += [(a, b, bits - a - b) for a in range(1, bits) for b in range(1, bits - a)]
    return min(options, key=cost)


def _pack(values: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bits of all values."""
    shifts = np.arange(width, dtype=np.uint32)
    parts = [
        np.packbits(((values[a : a + SLICE, None] >> shifts) & 1).astype(np.uint8).ravel(), bitorder="little").tobytes()
        for a in range(0, len(values), SLICE)
    ]
    return b"".join(parts)


def _unpack(packed: np.ndarray, width: int, first: int, count: int) -> np.ndarray:
    """``count`` values from number ``first`` on."""
    powers = (1 << np.arange(width, dtype=np.uint32)).astype(np.uint32)
    out = np.empty(count, np.uint32)
    for a in range(0, count, SLICE):
        n = min(SLICE, count - a)
        begin = (first + a) * width
        span = packed[begin // 8 : (begin + n * width + 7) // 8]
        bits = np.unpackbits(span, bitorder="little")[begin % 8 : begin % 8 + n * width]
        out[a : a + n] = bits.reshape(n, width) @ powers
    return out


def _padded(content: bytes) -> bytes:
    return content + b"\0" * (-len(content) % 8)


def encode(ids: np.ndarray, doc_ids: list[int | None], ends: np.ndarray) -> bytes:
    """The file of these ids; document ``k`` ends before token ``ends[k]``."""
    ids = np.asarray(ids, np.uint32)
    widths = best_widths(ids)
    parts = [
        (MAGIC + bytes([len(widths), *widths])).ljust(16, b"\0"),
        np.array([len(ids), len(doc_ids)], "<u8").tobytes(),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        _padded(np.array([d is None for d in doc_ids], np.uint8).tobytes()),
        np.asarray(ends, "<u8").tobytes(),
    ]
    rest = ids
    for level, width in enumerate(widths):
        more = np.zeros(len(rest), bool) if level == len(widths) - 1 else (rest >> np.uint32(width)) > 0
        bits = np.packbits(more, bitorder="little").tobytes()
        whole = np.frombuffer(bits + b"\0" * (-len(bits) % (RANK_BITS // 8)), np.uint64)
        counts = np.bitwise_count(whole.reshape(-1, RANK_BITS // 64)).sum(axis=1, dtype=np.uint64)
        ranks = np.concatenate((np.zeros(1, np.uint64), np.cumsum(counts, dtype=np.uint64)))
        parts += [
            np.array([len(rest)], "<u8").tobytes(),
            _padded(_pack(rest, width)),
            _padded(bits),
            ranks.astype("<u8").tobytes(),
        ]
        rest = rest[more] >> np.uint32(width)
    return b"".join(parts)


class TokenFile:
    """Reads a file's tokens one by one, by range or by document; nothing is decoded beforehand."""

    def __init__(self, content: bytes):
        if content[:5] != MAGIC:
            raise ValueError("not a token file")
        levels = content[5]
        self.widths = tuple(content[6 : 6 + levels])
        raw = np.frombuffer(content, np.uint8)
        at = 16

        def take(size: int, kind: str) -> np.ndarray:
            nonlocal at
            found = raw[at : at + size].view(kind)
            at += size + -size % 8
            return found

        self.n_tokens, self.n_docs = (int(x) for x in take(16, "<u8"))
        doc_ids = take(8 * self.n_docs, "<i8")
        self.missing = take(self.n_docs, "u1").astype(bool)
        self.doc_ids = doc_ids
        self.ends = take(8 * self.n_docs, "<u8").astype(np.int64)
        self.levels = []
        for width in self.widths:
            n = int(take(8, "<u8")[0])
            chunks = take((n * width + 7) // 8, "u1")
            bits = take((n + 7) // 8, "u1")
            ranks = take(8 * (-(-n // RANK_BITS) + 1), "<u8")
            self.levels.append((width, n, chunks, bits, ranks))

    @staticmethod
    def _rank(level: tuple, i: int) -> int:
        """Continuation bits set before bit ``i``."""
        bits, ranks = level[3], level[4]
        block = i // RANK_BITS
        inside = np.unpackbits(bits[block * RANK_BITS // 8 : (i + 7) // 8], bitorder="little")
        return int(ranks[block]) + int(inside[: i - block * RANK_BITS].sum())

    def token(self, i: int) -> int:
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value, shift = 0, 0
        for level in self.levels:
            width, _, chunks, bits, _ = level
            value |= int(_unpack(chunks, width, i, 1)[0]) << shift
            if not (bits[i // 8] >> (i % 8)) & 1:
                return value
            shift += width
            i = self._rank(level, i)
        return value

    def tokens(self, begin: int, end: int) -> np.ndarray:
        """Tokens of a range: per level one rank and one run of chunks."""
        values = np.zeros(max(0, end - begin), np.uint32)
        where, first, shift = np.arange(len(values)), begin, 0
        for level in self.levels:
            width, _, chunks, bits, _ = level
            if not len(where):
                break
            values[where] |= _unpack(chunks, width, first, len(where)) << np.uint32(shift)
            goes_on = np.unpackbits(bits[first // 8 : (first + len(where) + 7) // 8], bitorder="little")
            goes_on = goes_on[first % 8 : first % 8 + len(where)].astype(bool)
            where, first, shift = where[goes_on], self._rank(level, first), shift + width
        return values

    def document(self, k: int) -> np.ndarray:
        return self.tokens(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


#: Marks that never join a letter or digit before them into one piece, nor make a special token or contraction.
MARKS = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
TOGETHER = 200


_AT_END = "".join("\\" + c for c in MARKS)
#: Letters and digits that no normal form changes.
STEADY = r"[0-9A-Za-zÀ-ÖØ-öø-ÿ]$"


def split_marks(words: pa.Array) -> tuple[pa.Array, pa.Array]:
    """The words without the marks at their ends, and those marks, where their ids are those of the two in turn: where the
    tokenizer's normal form of the word ends with a letter or digit (a combining mark joins the marks).

    Pure ASCII parts are lower-cased as the tokenizer does, unless they may hold a special token.
    """
    base = pc.utf8_rtrim(words, characters=MARKS)
    cut = pc.less(pc.binary_length(base), pc.binary_length(words)).to_numpy(zero_copy_only=False)
    cut &= pc.greater(pc.binary_length(base), 0).to_numpy(zero_copy_only=False)
    steady = pc.match_substring_regex(base, STEADY).to_numpy(zero_copy_only=False)
    for i in np.flatnonzero(cut & ~steady).tolist():
        cut[i] = unicodedata.normalize("NFC", base[i].as_py()).lower()[-1].isalnum()
    marks = pc.replace_substring_regex(words, f"(?s)^.*[^{_AT_END}]", "")
    base = pc.if_else(pa.array(cut), base, words)
    lower = pc.and_(pc.string_is_ascii(base), pc.invert(pc.match_substring(base, "<|")))
    base = pc.if_else(lower, pc.ascii_lower(base), base)
    return base, pc.if_else(pa.array(cut), marks, pa.scalar("", marks.type))


def _gathered(pool: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``pool[b : b + n]`` of all begins and sizes, one behind the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    number = np.int32 if max(total, len(pool)) < 1 << 31 else np.int64
    shift = (begins - (ends - sizes)).astype(number)
    return pool[np.repeat(shift, sizes) + np.arange(total, dtype=number)]


class Encoder:
    """Ids of whole texts. White space separates words and is dropped by the tokenizer, so the ids of a text
    are those of its words in order; a worker encodes each distinct word once while it remembers it."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._forget()
        names = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(names.values()) + 1, bool)
        self.ends_word[[i for name, i in names.items() if name.endswith("</w>")]] = True

    def _forget(self) -> None:
        """Word ``k`` of ``words`` has the ids ``pool[borders[k] : borders[k + 1]]``; the empty one has none."""
        self.words = pa.array([""], pa.large_string())
        self.pool = np.zeros(0, np.uint32)
        self.borders = np.zeros(2, np.int64)

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(code.ids, np.uint32) for code in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these words and how many each has. Words of letters are one piece each, so they are encoded as one
        text and cut after their last ids; should the cuts not fit the words, they are encoded one by one."""
        if words[0].isalpha():
            ids = self._encoded([" ".join(words)])[0]
            cuts = np.flatnonzero(self.ends_word[ids]) + 1
            if len(cuts) == len(words):
                return ids[: cuts[-1]], np.diff(cuts, prepend=0)
        found = self._encoded(words)
        return np.concatenate(found), np.fromiter(map(len, found), np.int64, len(found))

    def _places(self, words: pa.Array) -> np.ndarray:
        """Where distinct words are in ``words``; new ones are encoded first, those of letters before the others."""
        found = pc.index_in(words, value_set=self.words)
        places = pc.fill_null(found, -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(places < 0)
        if len(new):
            texts = words.take(pa.array(new)).to_pylist()
            letters = np.fromiter((w.isalpha() for w in texts), bool, len(texts))
            order = np.argsort(~letters, kind="stable")
            texts = [texts[i] for i in order.tolist()]
            cuts = sorted({*range(0, len(texts), TOGETHER), int(letters.sum()), len(texts)})
            coded = [self._ids_of(texts[a:b]) for a, b in zip(cuts, cuts[1:])]
            places[new[order]] = len(self.words) + np.arange(len(new))
            self.words = pa.concat_arrays([self.words, words.take(pa.array(new[order]))])
            self.pool = np.concatenate([self.pool, *(ids for ids, _ in coded)])
            ends = np.cumsum(np.concatenate([sizes for _, sizes in coded]))
            self.borders = np.concatenate((self.borders, self.borders[-1] + ends))
        return places

    def __call__(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by ``end_id``, and where each text ends."""
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        if len(self.words) > REMEMBERED:
            self._forget()
        parts = pa.concat_arrays(split_marks(coded.dictionary)).dictionary_encode()
        both = self._places(parts.dictionary)[parts.indices.to_numpy()].reshape(2, -1)  # a word is its base and its marks
        begins, sizes = self.borders[both], np.diff(self.borders)[both]
        pool = _gathered(self.pool, begins.T.ravel(), sizes.T.ravel())
        sizes = sizes.sum(axis=0)
        begins = np.cumsum(sizes) - sizes
        which = coded.indices.to_numpy(zero_copy_only=False)
        counts = sizes[which]
        after = np.concatenate(([0], np.cumsum(counts)))
        total = int(after[-1])
        offsets = words.offsets.to_numpy().astype(np.int64)
        ends = after[offsets[1:] - offsets[0]] + np.arange(1, len(texts) + 1)
        ids = np.full(total + len(texts), end_id, np.uint32)
        place = np.ones(len(ids), bool)
        place[ends - 1] = False
        ids[place] = _gathered(pool, begins[which], counts)
        return ids, ends


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _text_slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ENCODE_BYTES, and of as many rows at most."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64) + 1)
    begin = 0
    while begin < len(upto):
        end = int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + ENCODE_BYTES, "right"))
        yield begin, (end := max(end, begin + 1))
        begin = end


def _writer(folder: str, tokenizer: str, end_id: int, file_tokens: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        ids = np.empty(file_tokens, np.uint32)  # the open file's, of which ``held`` are there
        docs: list[int | None] = []
        ends: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal docs, ends, held, number
            name = f"part-{task:08d}-{number:06d}.dac"
            write_file(folder, name, encode(ids[:held], docs, np.concatenate(ends)))
            row = pa.RecordBatch.from_pydict({"file": [name], "tokens": pa.array([held], pa.int64())})
            docs, ends, held, number = [], [], 0, number + 1
            pa.default_memory_pool().release_unused()  # the worker lives on
            return row

        for batch in batches:
            for a, b in _text_slices(batch.column("text")):
                part = batch.slice(a, b - a)
                texts = pc.fill_null(part.column("text").cast(pa.large_string()), "")
                found, stops = encoder(tokenizer)(texts, end_id)
                if held + len(found) > len(ids):
                    ids = np.concatenate((ids[:held], found))
                else:
                    ids[held : held + len(found)] = found
                ends.append(stops + held)
                docs += part.column("doc_id").to_pylist()
                held += len(found)
                if held >= file_tokens:
                    yield flush()
        if docs:
            yield flush()

    return write


def write_tokens(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    text_col: str = "text",
    id_col: str = "doc_id",
    end_id: int = END_ID,
    file_tokens: int = FILE_TOKENS,
) -> DataFrame:
    """Encode every text and write token files in ascending order of ids; returns one row per file.

    File names ascend with the documents. NULL ids come first, rows of one id in an order of their own;
    a NULL or empty text is the end id alone. ``tokenizer`` is a file that every executor has. An empty
    table writes no file.
    """
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), text_key(F.col(text_col)).alias("_k")
    )
    ordered = rows.repartitionByRange("doc_id", "_k").sortWithinPartitions("doc_id", "_k")
    files = ordered.select("doc_id", "text").mapInArrow(
        _writer(folder, tokenizer, end_id, file_tokens), "file string, tokens bigint"
    )
    manifest = f"{folder}-files"
    files.write.parquet(manifest)
    files = docs.sparkSession.read.schema("file string, tokens bigint").parquet(manifest)
    before = W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)  # a row per file of many megabytes
    return files.withColumn("first", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def _crc32(file: TokenFile, begin: int, end: int) -> int:
    """Of a document's ids, decoded by slices."""
    found = 0
    for a in range(begin, end, SLICE):
        found = zlib.crc32(file.tokens(a, min(a + SLICE, end)).astype("<u4"), found)
    return found


def _sums(file: TokenFile, starts: np.ndarray) -> Iterator[int]:
    """CRC of every document; short ones are decoded together."""
    begin = 0
    while begin < file.n_docs:
        first = int(starts[begin])
        end = max(begin + 1, int(np.searchsorted(file.ends, first + SLICE, "right")))
        if end == begin + 1:
            yield _crc32(file, first, int(file.ends[begin]))
        else:
            raw = memoryview(file.tokens(first, int(file.ends[end - 1])).astype("<u4").tobytes())
            for a, b in zip((starts[begin:end] - first).tolist(), (file.ends[begin:end] - first).tolist()):
                yield zlib.crc32(raw[4 * a : 4 * b])
        begin = end


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content")):
            file = TokenFile(content.as_py())
            starts = np.concatenate(([0], file.ends[:-1])) if file.n_docs else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_pydict(
                {
                    "file": pa.array([path.as_py().rsplit("/", 1)[-1]] * file.n_docs, pa.string()),
                    "doc_id": pa.array(file.doc_ids.astype(np.int64), pa.int64(), mask=file.missing),
                    "offset": pa.array(starts, pa.int64()),
                    "n_tokens": pa.array(file.ends - starts, pa.int64()),
                    "ids_crc32": pa.array(list(_sums(file, starts)), pa.int64()),
                }
            )


def read_documents(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (tokens of all documents before it), n_tokens, ids_crc32."""
    names = files.select("file", "first")
    if names.isEmpty():
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    content = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.dac").load(folder)
    found = content.select("path", "content").mapInArrow(
        _documents, "file string, doc_id bigint, offset bigint, n_tokens bigint, ids_crc32 bigint"
    )
    start = (F.col("first") + F.col("offset")).alias("start")
    return found.join(names, "file").select("doc_id", start, "n_tokens", "ids_crc32")


def token_index(docs: DataFrame, tokenizer: str, folder: str | None = None, **options) -> DataFrame:
    """Write ``docs`` as token files (below the shared folder unless ``folder`` is given) and read them back."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "token-files")
    return read_documents(spark, folder, write_tokens(docs, folder, tokenizer, **options))
