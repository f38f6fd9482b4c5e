"""Quality rules: base counts of a text, and a log-likelihood ratio over hashed word n-grams.

Two multinomials over ``2 * buckets`` hashed features (tokens and neighbouring pairs of tokens) are
counted: one from every document, one from trusted documents. A document's score is the mean, over
its features, of ``log p_trusted(feature) - log p_raw(feature)``; documents below a fixed threshold go.
Nothing is drawn at random, so reruns agree.

Everything is DataFrame code: features are counted with a map-side combine into at most
``2 * buckets`` rows, the model is one row, and scoring neither shuffles nor repeats a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queuemill.llm.text import WHITE, let, white_words

#: Features of one kind; the model has twice as many weights, whatever the corpus.
BUCKETS = 1 << 16
#: Trusted documents used at most (those with the smallest hashes of their ids), so that the list can be broadcast.
MAX_TRUSTED = 20_000
#: Added to every count.
SMOOTHING = 1.0
#: Nats per feature below which a document is refused.
THRESHOLD = -0.5
MIN_WORDS = 50
#: Room for a word's position beside its window's hash: texts have fewer than 2**27 words.
POSITION_BITS = 27
#: Percent of words inside repeated three-word windows above which a document is refused.
MAX_REPEATED = 50

TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"


def _pairs(text: Column) -> Column:
    """Each token with the next one (NULL for the last)."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))
    return let(tokens, lambda t: F.arrays_zip(t.alias("a"), F.slice(t, F.lit(2), F.size(t)).alias("b")))


def _buckets(a: Column, b: Column, buckets: int) -> tuple[Column, Column]:
    return (
        F.pmod(F.xxhash64(a), F.lit(buckets)).cast("int"),
        F.pmod(F.xxhash64(a, b), F.lit(buckets)).cast("int") + F.lit(buckets),
    )


def trusted_ids(labels: DataFrame, limit: int = MAX_TRUSTED) -> DataFrame:
    """Ids of documents labelled good; at most ``limit`` of them, the same ones on every run."""
    good = labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def fit(
    docs: DataFrame,
    trusted: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    buckets: int = BUCKETS,
    smoothing: float = SMOOTHING,
) -> DataFrame:
    """One row with ``weights array<double>``: the log ratio of each of the ``2 * buckets`` features.

    ``trusted`` has ids in ``doc_id``, ``MAX_TRUSTED`` at most (it is broadcast). Without any trusted text all
    weights are 0, so that nothing is refused for its score. NULL and empty texts have no features.
    """
    marks = F.broadcast(trusted.select(F.col("doc_id").alias("_id"), F.lit(1).alias("_good")))
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))
    features = texts.join(marks, F.col("_doc") == F.col("_id"), "left").select(
        F.coalesce("_good", F.lit(0)).alias("_good"), F.explode(_pairs(F.col("_text"))).alias("_p")
    )
    one, two = _buckets(F.col("_p")["a"], F.col("_p")["b"], buckets)
    counts = (
        features.select("_good", F.explode(F.array(one, two)).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count("*").alias("raw"), F.sum("_good").alias("good"))
    )
    every = docs.sparkSession.range(2 * buckets).select(F.col("id").cast("int").alias("bucket"))
    dense = every.join(counts, "bucket", "left").select(
        "bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("good", F.lit(0)).alias("good")
    )
    table = dense.agg(
        F.sum("raw").alias("raws"),
        F.sum("good").alias("goods"),
        F.array_sort(F.collect_list(F.struct("bucket", "raw", "good"))).alias("rows"),
    )
    share = lambda n, total: (n + F.lit(smoothing)) / (total + F.lit(2 * buckets * smoothing))
    ratio = lambda r: F.log(share(r["good"], F.col("goods"))) - F.log(share(r["raw"], F.col("raws")))
    known = F.coalesce(F.col("goods") > 0, F.lit(False))
    return table.select(
        F.transform("rows", lambda r: F.when(known, ratio(r)).otherwise(0.0)).alias("weights")
    )


def llr(text: Column, weights: Column, buckets: int = BUCKETS) -> Column:
    """Mean log ratio of a text's features; NULL for a text without any."""

    def mean(pairs: Column, w: Column) -> Column:
        def add(total: Column, pair: Column) -> Column:
            one, two = _buckets(pair["a"], pair["b"], buckets)
            return total + F.get(w, one) + F.get(w, two)

        return F.aggregate(pairs, F.lit(0.0), add) / F.nullif(2 * F.size(pairs), F.lit(0))

    return let(weights, lambda w: let(_pairs(text), lambda pairs: mean(pairs, w)))


def _repeated(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the text.

    Most texts repeat no window or few: windows are first compared by 37 bits of their hashes, packed with
    the position into one number and sorted as such; only the hits are compared by whole hashes.
    """

    def neighbours(items: Column, same, position) -> Column:
        """Positions of items that are the same as one beside them in the sorted array."""
        near = lambda x, y: F.coalesce(same(x, y), F.lit(False))
        marked = F.transform(
            items,
            lambda x, i: F.when(near(x, F.get(items, i - 1)) | near(x, F.get(items, i + 1)), position(x)),
        )
        return F.array_compact(marked)

    def covered(hashes: Column, hits: Column) -> Column:
        exact = F.array_sort(F.transform(hits, lambda i: F.struct(F.get(hashes, i).alias("h"), i.alias("i"))))
        sure = let(exact, lambda e: neighbours(e, lambda x, y: x["h"] == y["h"], lambda x: x["i"]))
        return F.size(F.array_distinct(F.flatten(F.transform(sure, lambda p: F.array(p, p + 1, p + 2)))))

    def compared(hashes: Column) -> Column:
        packed = F.sort_array(
            F.transform(hashes, lambda h, i: F.shiftleft(h, POSITION_BITS).bitwiseOR(i.cast("long")))
        )
        hits = let(
            packed,
            lambda p: neighbours(
                p,
                lambda x, y: F.shiftright(x, POSITION_BITS) == F.shiftright(y, POSITION_BITS),
                lambda x: x.bitwiseAND(F.lit((1 << POSITION_BITS) - 1)).cast("int"),
            ),
        )
        return let(hits, lambda found: covered(hashes, found))

    def hashed(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - 3)
        windows = F.transform(at, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return let(
            windows,
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(compared(h)),
        )

    return let(words, lambda w: F.when(F.size(w) < 3, F.lit(0)).otherwise(hashed(w)))


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _base(text: Column) -> Column:
    """The base counts of a text, and whether it fails for them, as a struct."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def counts(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _repeated(words).cast("long").alias("n_repeat_words"),
        )

    def judged(c: Column) -> Column:
        failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEATED * c["n_words"])
        return F.struct(*[c[name].alias(name) for name in BASE], failed.alias("base_failed"))

    return let(let(white_words(text), counts), judged)


def base_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed added.

    Words are runs of anything but ASCII white space; a NULL text has none and counts 0 everywhere, so it
    fails. Windows are compared by 64-bit hashes inside one text.
    """
    counted = docs.withColumn("_base", _base(F.coalesce(F.col(text_col), F.lit(""))))
    return counted.withColumns({name: F.col("_base")[name] for name in (*BASE, "base_failed")}).drop("_base")


def judge(
    docs: DataFrame,
    model: DataFrame,
    text_col: str = "text",
    buckets: int = BUCKETS,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Every document with its base counts, ``llr double`` and ``kept boolean``.

    Kept are documents that pass the base rules and score ``threshold`` or more. Columns of ``docs`` with
    the names of the added ones are replaced; other columns stay. Repeated rows get equal verdicts. All fields come
    from one expression, so that a filter on ``kept`` computes it once.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))

    def verdict(base: Column, score: Column) -> Column:
        passed = F.coalesce(score >= threshold, F.lit(False))
        fields = [base[name].alias(name) for name in (*BASE, "base_failed")]
        return F.struct(*fields, score.alias("llr"), (~base["base_failed"] & passed).alias("kept"))

    scored = docs.withColumn("_w", model.select("weights").scalar())
    whole = let(_base(text), lambda base: let(llr(text, F.col("_w"), buckets), lambda score: verdict(base, score)))
    found = scored.withColumn("_verdict", whole).withColumns(
        {name: F.col("_verdict")[name] for name in (*BASE, "base_failed", "llr", "kept")}
    )
    return found.drop("_w", "_verdict")


__all__ = ["WHITE", "base_counts", "fit", "judge", "llr", "trusted_ids"]
