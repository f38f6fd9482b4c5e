"""Spelling variants: words that differ from a much more frequent word by a single edit.

1. Every text is scanned once; words are counted per task and then over all tasks (``counted_words``).
2. Two words are near if one inserted, deleted or replaced code point makes them equal, which is the case if and only
   if the lengths of their common prefix and of their common suffix add up to the longer length minus one. The place of
   that edit lies in one of ``PIECES`` pieces of the shorter word, and outside that piece both words agree. So each word
   goes into one tile group per piece, for its own length and for partners of one code point less; a pair is looked for
   in just the group of the piece where its common prefix ends (``tile_rows``).
3. In a group, padded matrices of code points are compared block by block (``near_words``). Groups of more than
   ``TILE`` words are cut into blocks, and every pair of blocks is a group of its own, so no task holds a whole one.
4. The near word of largest count is a word's form if it is frequent enough; roots follow forms by pointer doubling.
   Counts at least double at each step, so a path has at most as many steps as a count has bits.

NULL and empty texts have no words; a NULL id counts as an empty one. Rows with one id are counted each. Words of any
length are compared: only words that share a group meet, and matrices are cut to ``CELLS`` cells. An empty table gives
no rows, and columns other than id and text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuemill.session import stored

LETTERS = "A-Za-zÀ-ÿ"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = str.maketrans(UPPER, UPPER.lower())
MIN_LENGTH = 5
MIN_COUNT = 3
RATIO = 2
PIECES = 3
TILE = 512
SMALL = 48
CELLS = 1 << 25
DISTINCT = 400_000
SCAN = 1 << 20
SLIP = 97


def slipped(doc_id: str, run: str) -> str:
    """The run, without one of its code points where the checksum of id and run says so."""
    check = zlib.crc32(f"{doc_id}:{run}".encode())
    if check % SLIP:
        return run
    at = check % len(run)
    return run[:at] + run[at + 1 :]


def _pieces(text: str, outside: re.Pattern) -> Iterator[str]:
    """The text in parts of bounded length that no run of letters crosses (a longer run is a part of its own)."""
    at = 0
    while at < len(text):
        end = outside.search(text, min(at + SCAN, len(text)))
        stop = end.end() if end else len(text)
        yield text[at:stop]
        at = stop


def _counter(letters: str, min_length: int, edit):
    run, outside = re.compile(f"[{letters}]{{{min_length},}}"), re.compile(f"[^{letters}]")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found: Counter = Counter()
                for part in _pieces(text, outside):
                    found.update(run.findall(part))
                lowered: Counter = Counter()
                for word, n in found.items():
                    lowered[word.lower() if word.isascii() else word.translate(LOWER)] += n
                for word, n in lowered.items():
                    word = edit(doc_id, word)
                    if len(word) >= min_length:
                        total[word] += n
                if len(total) >= DISTINCT:
                    yield _counts(total)
                    total = Counter()
        yield _counts(total)

    return count


def _counts(total: Counter) -> pa.RecordBatch:
    return pa.record_batch([pa.array(list(total), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])


def counted_words(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    letters: str = LETTERS,
    min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT,
    edit=slipped,
) -> DataFrame:
    """``word, n``: maximal runs of ``letters`` with A-Z lower-cased, changed by ``edit(id, run)``, and how often each
    occurs in all texts; shorter and rarer ones are left out."""
    texts = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    partial = texts.filter("text is not null").mapInArrow(_counter(letters, min_length, edit), "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def cuts(length: int) -> list[int]:
    return [length * i // PIECES for i in range(PIECES + 1)]


def tile_rows(words: DataFrame, min_length: int = 1) -> DataFrame:
    """One row per word and group: the ``base`` length of the shorter word, the ``piece`` that may differ, a hash of
    what may not, and the blocks ``a <= b`` that meet; ``second`` tells rows of ``b`` where these are two blocks."""
    word = F.col("word")
    rows = []
    for less in (0, 1):
        base = F.char_length(word) - less
        for piece in range(PIECES):
            begin = F.floor(base * piece / PIECES).cast("int")
            rest = (base - F.floor(base * (piece + 1) / PIECES)).cast("int")
            outside = F.xxhash64(word.substr(F.lit(1), begin), F.when(rest > 0, F.right(word, rest)).otherwise(""))
            rows.append(F.struct(base.alias("base"), F.lit(piece).alias("piece"), outside.alias("outside")))
    group = ["base", "piece", "outside"]
    every = words.select("word", "n", F.inline(F.array(*rows))).filter(F.col("base") >= max(min_length, 1))
    large = every.groupBy(*group).count().filter(F.col("count") > TILE)
    blocks = F.coalesce(F.ceil(F.col("count") / TILE), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    cut = every.join(large, group, "left").withColumn("blocks", blocks).withColumn("own", own)
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return met.select(
        *group,
        F.least("own", "other").alias("a"),
        F.greatest("own", "other").alias("b"),
        (F.col("own") > F.col("other")).alias("second"),
        "word",
        "n",
    )


GROUP = ["base", "piece", "outside", "a", "b"]
NEAR = "word string, n_near long, best_n long, best_word string"
_NEAR_ARROW = pa.schema(
    [("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best_word", pa.string())]
)


def _matrix(words: list[str], width: int) -> np.ndarray:
    """Code points, one word a row, padded with zeros; a byte each where that is enough."""
    codes = np.array(words, dtype=f"U{width}").view(np.uint32).reshape(len(words), width)
    return codes.astype(np.uint8) if codes.max(initial=0) < 256 else codes


def _agreeing(rows: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the common beginning of rows ``x`` and ``y``, which differ somewhere."""
    found = np.empty(len(x), np.int64)
    step = max(1, CELLS // rows.shape[1])
    for at in range(0, len(x), step):
        found[at : at + step] = (rows[x[at : at + step]] != rows[y[at : at + step]]).argmax(axis=1)
    return found


def _block_pairs(
    group: np.ndarray, two: np.ndarray, second: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs to compare: small groups by diagonals of all at once, others block against block; where ``two``
    blocks meet, only pairs of one row of each."""
    edges = np.flatnonzero(np.diff(group, prepend=-1, append=-1))
    sizes = np.diff(edges)
    small = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= SMALL), sizes))
    for off in range(1, SMALL):
        x, y = small[:-off], small[off:]
        same = group[x] == group[y]
        if not same.any():
            break
        keep = same & (~two[x] | (second[x] != second[y]))
        yield x[keep], y[keep]
    for begin, size in zip(edges[:-1][sizes > SMALL], sizes[sizes > SMALL]):
        rows = np.arange(begin, begin + size)
        if two[begin]:
            first, other = rows[~second[rows]], rows[second[rows]]
            yield np.repeat(first, len(other)), np.tile(other, len(first))
        else:
            x, y = np.triu_indices(size, 1)
            yield rows[x], rows[y]


def _best_of(x: np.ndarray, y: np.ndarray, words: list[str], n: np.ndarray) -> pa.RecordBatch:
    """Per word its number of near words here, and the most frequent of them (ties: the smallest)."""
    rank = np.empty(len(words), np.int64)
    rank[np.argsort(np.array(words, dtype=object), kind="stable")] = np.arange(len(words))
    order = np.lexsort((rank[y], -n[y], x))
    x, y = x[order], y[order]
    head = np.flatnonzero(np.diff(x, prepend=-1))
    counts = np.diff(np.append(head, len(x)))
    columns = [[words[i] for i in x[head]], counts, n[y[head]], [words[i] for i in y[head]]]
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _NEAR_ARROW)], schema=_NEAR_ARROW)


def _compare(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Near words within whole groups, which lie together."""
    bases = rows.column("base").to_numpy()
    for base in np.unique(bases):
        part = rows.filter(pa.array(bases == base))
        keys = np.stack([part.column(c).to_numpy().astype(np.int64) for c in GROUP[1:]])
        group = np.cumsum(np.append(0, (np.diff(keys) != 0).any(axis=0)))
        alone = np.bincount(group)[group] == 1
        if alone.all():
            continue
        part, group, keys = part.filter(pa.array(~alone)), group[~alone], keys[:, ~alone]
        piece, two = keys[0], keys[2] != keys[3]
        second = part.column("second").to_numpy(zero_copy_only=False)
        words, n = part.column("word").to_pylist(), part.column("n").to_numpy()
        ahead, back = _matrix(words, int(base) + 1), _matrix([w[::-1] for w in words], int(base) + 1)
        length = np.array([len(w) for w in words])
        edge = np.array(cuts(int(base)))
        found = []
        for x, y in _block_pairs(group, two, second):
            longer = np.maximum(length[x], length[y])
            # of the group's two lengths at least one is the base; words may repeat only across groups
            able = np.minimum(length[x], length[y]) == base
            x, y, longer = x[able], y[able], longer[able]
            prefix = _agreeing(ahead, x, y)
            here = (edge[piece[x]] <= prefix) & (
                (prefix < edge[piece[x] + 1]) | ((piece[x] == PIECES - 1) & (prefix == base))
            )
            x, y, longer, prefix = x[here], y[here], longer[here], prefix[here]
            near = prefix + _agreeing(back, x, y) >= longer - 1
            found.append((x[near], y[near]))
        x, y = (np.concatenate([p[i] for p in found]) for i in (0, 1))
        if len(x):
            yield _best_of(np.append(x, y), np.append(y, x), words, n)


def _near_in_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups follow one another; the last one of a batch waits for the next batch."""
    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, rows]) if held is not None else rows
        last = np.ones(len(rows), bool)
        for column in GROUP:
            values = rows.column(column).to_numpy()
            last &= values == values[-1]
        begin = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        yield from _compare(rows.slice(0, begin).combine_chunks())
        held = rows.slice(begin)
    if held is not None:
        yield from _compare(held.combine_chunks())


def near_words(words: DataFrame, min_length: int = 1) -> DataFrame:
    """``word, n_near, best_n, best_word`` for each of the different ``words`` (with their counts ``n``) that has a near
    one: how many, and the most frequent of them (ties: the smallest in code-point order)."""
    rows = tile_rows(words, min_length).repartition(*GROUP).sortWithinPartitions(*GROUP)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best_word"))
    found = rows.mapInArrow(_near_in_batches, NEAR).groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return found.select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best_word").alias("best_word"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for every row ``word, form``: where following the forms ends. Paths halve with every round."""
    found = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = found.join(further, "root", "left")
        after = stored(joined.select("word", F.coalesce("next", "root").alias("root"), "next"), "spelling-roots")
        if after.filter("next is not null").isEmpty():
            return after.select("word", "root")
        found = after.select("word", "root")


def spelling_variants(words: DataFrame, ratio: int = RATIO, min_length: int = 1) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for ``words`` (``word, n``, each once)."""
    words = stored(words.select("word", F.col("n").cast("long").alias("n")), "spelling-words")
    near = words.join(near_words(words, min_length), "word", "left")
    is_form = F.col("best_n") >= ratio * F.col("n")
    judged = stored(
        near.select(
            "word",
            F.when(is_form, F.col("best_word")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(is_form, F.col("best_n")).alias("form_n"),
        ),
        "spelling-forms",
    )
    found = judged.join(roots(judged.filter("form is not null")), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variant_groups(variants: DataFrame) -> DataFrame:
    """One row per word that belongs to a group: its ``root``, the group's size and all occurrences of its words."""
    sizes = variants.groupBy("root").agg(F.count("*").alias("n_words"), F.sum("n").alias("n_group"))
    return variants.join(sizes.filter("n_words > 1"), "root").select("root", "word", "n", "n_words", "n_group")


#: The digest of the query in SQL. The checksum goes over the bytes of ``<doc_id>:<run>`` by a table of 256 entries; near
#: words meet by the texts that one deletion leaves, with the place of it for words of one length.
SQL = r"""
WITH RECURSIVE halves AS (
  SELECT i::BIGINT AS i, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM halves WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS entries FROM halves WHERE k = 8),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run
  FROM documents WHERE text IS NOT NULL
), per_doc AS (
  SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS named, run, count(*) AS n FROM runs
  WHERE length(run) >= 5 GROUP BY ALL
), bytes AS (
  SELECT run, n, list_transform(range(0, octet_length(encode(named))), lambda j:
    ('0x' || substr(hex(encode(named)), 2 * j::BIGINT + 1, 2))::BIGINT) AS b FROM per_doc
), summed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x:
    xor(c >> 8, entries[(xor(c, x) & 255) + 1])), 4294967295) AS h
  FROM bytes, crc
), words AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2)
    ELSE run END AS word, sum(n)::BIGINT AS n
  FROM summed GROUP BY 1 HAVING sum(n) >= 3 AND length(word) >= 5
), cut AS (
  SELECT word, n, p, left(word, p::INT) || substr(word, p::INT + 2) AS rest
  FROM (SELECT word, n, unnest(range(length(word))) AS p FROM words)
), pairs AS (
  SELECT x.word, y.word AS near, y.n AS near_n FROM cut x JOIN cut y ON x.rest = y.rest AND x.p = y.p AND x.word <> y.word
  UNION
  SELECT x.word, y.word, y.n FROM words x JOIN cut y ON x.word = y.rest
  UNION
  SELECT y.word, x.word, x.n FROM words x JOIN cut y ON x.word = y.rest
), best AS (
  SELECT word, count(*) AS n_near, min({'less': -near_n, 'near': near}) AS b FROM pairs GROUP BY word
), formed AS (
  SELECT w.word, CASE WHEN -b.less >= 2 * w.n THEN b.near END AS form, w.n, coalesce(n_near, 0)::BIGINT AS n_near,
    CASE WHEN -b.less >= 2 * w.n THEN -b.less END AS form_n
  FROM words w LEFT JOIN best USING (word)
), paths AS (
  SELECT word, coalesce(form, word) AS root, form IS NULL AS ended FROM formed
  UNION ALL
  SELECT p.word, coalesce(f.form, p.root), f.form IS NULL FROM paths p JOIN formed f ON f.word = p.root WHERE NOT ended
)
SELECT f.word, f.form, p.root, f.n, f.n_near, f.form_n FROM formed f JOIN paths p ON p.word = f.word AND p.ended
"""
