"""Benchmark decontamination: find windows of benchmark items in documents, and take them out.

The windows of all items (ten words, or the whole of a shorter item) form a hash table that is broadcast
in blocks of ``MAX_BLOCK`` windows at most; a larger benchmark takes more passes over the documents, never
a larger broadcast. Each document window is looked up by hash and every hit is verified word by word. A text is scanned
in pieces of ``PIECE`` windows, which overlap by the words that a window may reach over, so the work grows with its length
and no more. Texts are never shuffled for the scan: only hits and one short row per document are.

Rows of one id with different texts are different documents; equal rows share one result. NULL texts have
no words, items without words no windows. An item whose id is NULL counts for hits, but not as an item.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queuemill.llm.text import ascii_lower, text_key

WINDOW = 10
#: Windows in one broadcast table: at about 300 bytes each, some 60 MB.
MAX_BLOCK = 200_000
#: Windows that begin in one piece of a text. Every window's row holds its piece until it has been looked up.
PIECE = 512

#: What separates words: ASCII other than letters and digits (in a lower-cased text, and in any text).
GAP_LOWER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def item_words(text: Column) -> Column:
    lowered = ascii_lower(F.coalesce(text, F.lit("")))
    return F.array_remove(F.split(lowered, GAP_LOWER + "+"), "")


def _window_hash(words: Column) -> Column:
    return F.xxhash64(F.transform(words, lambda w: F.xxhash64(w)))


def item_windows(benchmark: DataFrame, text_col: str = "text", id_col: str = "item_id") -> DataFrame:
    """One row per distinct window: ``gram array<string>``, ``gram_hash``, ``items`` that have it."""
    items = benchmark.select(F.col(id_col).alias("_item"), item_words(F.col(text_col)).alias("_words"))
    width = F.least(F.lit(WINDOW), F.size("_words"))
    starts = F.sequence(F.lit(0), F.size("_words") - width)
    grams = items.filter(F.size("_words") > 0).select(
        "_item", F.explode(F.transform(starts, lambda i: F.slice("_words", i + 1, width))).alias("gram")
    )
    found = grams.groupBy("gram").agg(F.collect_set("_item").alias("items"))
    return found.withColumn("gram_hash", _window_hash(F.col("gram")))


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    max_block: int = MAX_BLOCK,
) -> DataFrame:
    """Per document: ``doc_id``, ``text_key``, ``copies`` (equal rows), ``n_words``, ``hit_words`` (indexes
    of words inside any benchmark window) and ``items``, both sorted."""
    grams = item_windows(benchmark)
    sizes = grams.groupBy(F.size("gram").alias("width")).count().collect()  # ten rows at most
    widths = sorted(row["width"] for row in sizes)
    blocks = max(1, -(-sum(row["count"] for row in sizes) // max_block))
    words = docs.select(
        F.col(id_col).alias("doc_id"),
        text_key(F.col(text_col)).alias("text_key"),
        item_words(F.col(text_col)).alias("_all"),
    )
    begins = F.sequence(F.lit(0), F.greatest(F.size("_all") - 1, F.lit(0)), F.lit(PIECE))
    piece = lambda i: F.struct(i.alias("base"), F.slice("_all", i + 1, F.lit(PIECE + WINDOW - 1)).alias("words"))
    pieces = words.select(
        "doc_id", "text_key", F.size("_all").alias("_n"), F.explode(F.transform(begins, piece)).alias("_p")
    ).select("doc_id", "text_key", "_n", F.col("_p.base").alias("_base"), F.col("_p.words").alias("_words"))
    pieces = pieces.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))

    def at(i: Column, width: int | Column, hashed: Column) -> Column:
        return F.struct(i.cast("int").alias("at"), F.lit(width).alias("width"), hashed.alias("hash"))

    def windows(width: int) -> Column:
        starts = F.sequence(F.lit(0), F.least(F.size("_hashes") - width, F.lit(PIECE - 1)))
        one = lambda i: at(i, width, F.xxhash64(F.slice("_hashes", i + 1, F.lit(width))))
        return F.when(F.size("_hashes") >= width, F.transform(starts, one)).otherwise(F.array())

    #: Stands for the document itself, so that documents without hits stay; its width is the word count.
    one_row = F.array(at(F.lit(-1), F.col("_n"), F.lit(None).cast("bigint")))
    whole = F.when(F.col("_base") == 0, one_row).otherwise(F.array())

    def block(number: int) -> DataFrame:
        table = F.broadcast(grams.filter(F.pmod("gram_hash", F.lit(blocks)) == number))
        every = F.concat(whole, *(windows(width) for width in widths))
        rows = pieces.select("doc_id", "text_key", "_base", "_words", F.explode(every).alias("_w"))
        same = (F.col("_w.hash") == F.col("gram_hash")) & (
            F.slice("_words", F.greatest("_w.at", F.lit(0)) + 1, F.col("_w.width")) == F.col("gram")
        )
        keep = F.col("gram").isNotNull() | (F.col("_w.at") < 0)
        return rows.join(table, same, "left").filter(keep).select("doc_id", "text_key", "_base", "_w", "items")

    found = reduce(DataFrame.unionAll, (block(number) for number in range(blocks)))
    hit = F.col("_w.at") >= 0
    first = F.col("_base") + F.col("_w.at")
    covered = F.sequence(first, first + F.col("_w.width") - 1)
    return (
        found.groupBy("doc_id", "text_key")
        .agg(
            (F.sum(F.when(hit, 0).otherwise(1)) / blocks).cast("long").alias("copies"),
            F.max(F.when(~hit, F.col("_w.width"))).cast("long").alias("n_words"),
            F.collect_set(F.when(hit, covered)).alias("_hits"),
            F.collect_set("items").alias("_items"),
        )
        .select(
            "doc_id",
            "text_key",
            "copies",
            "n_words",
            F.array_sort(F.array_distinct(F.flatten("_hits"))).alias("hit_words"),
            F.array_sort(F.array_distinct(F.flatten("_items"))).alias("items"),
        )
    )


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items."""
    found = scan(docs, benchmark, **options)
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
        "items",
        F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("_copy"),
    ).drop("_copy")


def remove(
    docs: DataFrame,
    benchmark: DataFrame,
    mode: str = "documents",
    text_col: str = "text",
    id_col: str = "doc_id",
    **options,
) -> DataFrame:
    """``docs`` without contaminated documents, or (mode ``spans``) without the words that were hit.

    A removed word takes the characters up to the next word with it; what stays is not changed. Other
    columns pass through as they are.
    """
    if mode not in ("documents", "spans"):
        raise ValueError("mode must be 'documents' or 'spans'")
    found = scan(docs, benchmark, text_col, id_col, **options).filter(F.size("hit_words") > 0)
    hits = found.select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("hit_words").alias("_hits")
    )
    same = docs[id_col].eqNullSafe(F.col("_id")) & (text_key(docs[text_col]) == F.col("_key"))
    if mode == "documents":
        return docs.join(hits, same, "left_anti")
    text = F.col(text_col)
    parts = F.regexp_extract_all(text, F.lit(f"{WORD}+{GAP}*"), F.lit(0))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_parts") - 1), F.col("_hits"))
    kept = F.array_join(F.transform(stay, lambda i: F.get("_parts", i)), "")
    marked = docs.join(hits, same, "left").withColumn("_parts", F.when(F.col("_hits").isNotNull(), parts))
    cleaned = F.when(
        F.col("_hits").isNotNull(), F.concat(F.regexp_extract(text, f"^{GAP}*", 0), kept)
    ).otherwise(text)
    return marked.withColumn(text_col, cleaned).drop("_id", "_key", "_hits", "_parts")


_SQL_WORDS = r"""regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

SQL = f"""
with d as (select row_number() over () as r, doc_id, {_SQL_WORDS} as w from documents),
b as (select item_id, {_SQL_WORDS} as w from benchmark),
grams as (
    select distinct item_id, w[i : i + least({WINDOW}, len(w)) - 1] as g
    from (select item_id, w, unnest(range(1, greatest(len(w) - {WINDOW}, 0) + 2)) as i from b where len(w) > 0)),
widths as (select distinct len(g) as n from grams),
seen as (
    select r, i, n, w[i : i + n - 1] as g
    from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from d, widths where len(w) >= n)),
hits as (select r, i, n, item_id from seen join grams using (g)),
spots as (select r, count(*) as n_hit from (
    select distinct r, unnest(range(i, i + n)) as at from hits) group by r),
named as (
    select r, count(*) as n_items, string_agg(cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids
    from (select distinct r, item_id from hits where item_id is not null) group by r)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join spots using (r) left join named using (r)
"""
