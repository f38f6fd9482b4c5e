"""Line de-duplication over levelled sorted runs of line hashes.

A line's key is the line stripped of ASCII white space with A-Z lower-cased; it is known by two 64-bit
hashes. The index is a folder of *runs*: Parquet tables sorted by hash, one row per key with the number
of documents that hold it and the largest of their ids. Every batch of documents is merge-anti-joined
with the runs, which tells the lines never seen before, and then adds its own run. When ``fanout`` runs of
one level have gathered, they are merged into one run of the next level, so a batch meets
``fanout * log(batches)`` runs at most and every row is rewritten ``log(batches)`` times.

DataFrame operations only. Hot lines are counted before they are shuffled.
"""

from __future__ import annotations

import os
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from queuemill.llm.text import ascii_lower, text_key
from queuemill.session import scratch_path, stored

MIN_CHARS = 20
MIN_DOCS = 3
BATCHES = 4
FANOUT = 2
KEY = ["line_hash", "line_hash_2"]
BLANK = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANK)))


def keyed_lines(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_chars: int = MIN_CHARS
) -> DataFrame:
    """Long enough lines of all documents: doc_id, text_key, at (line number from 0), the two hashes."""
    text = F.col(text_col)
    lines = docs.select(
        F.col(id_col).alias("doc_id"),
        text_key(text).alias("text_key"),
        F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("at", "_line"),
    )
    keys = lines.select("doc_id", "text_key", "at", line_key(F.col("_line")).alias("_key"))
    return keys.filter(F.char_length("_key") >= min_chars).select(
        "doc_id",
        "text_key",
        "at",
        F.xxhash64("_key").alias("line_hash"),
        F.xxhash64(F.lit("second"), "_key").alias("line_hash_2"),
    )


def line_counts(lines: DataFrame) -> DataFrame:
    """Per key: ``docs``, the documents (ids) that hold it, and ``last_doc``, the largest; NULL is one id."""
    held = lines.select(*KEY, "doc_id").distinct()
    return held.groupBy(*KEY).agg(F.count("*").alias("docs"), F.max("doc_id").alias("last_doc"))


class LineRuns:
    """The runs of one index. Documents of one id must come in one batch."""

    def __init__(self, spark: SparkSession, folder: str, fanout: int = FANOUT):
        if fanout < 2:
            raise ValueError("fanout must be 2 at least")
        self.spark, self.folder, self.fanout = spark, folder, fanout
        self.levels: list[list[str]] = []

    def _write(self, rows: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        path = os.path.join(self.folder, f"level{level}-{uuid.uuid4().hex}")
        rows.repartitionByRange(*KEY).sortWithinPartitions(*KEY).write.parquet(path)
        self.levels[level].append(path)

    def rows(self) -> DataFrame | None:
        """All rows of all runs; a key may have a row in several."""
        paths = [path for level in self.levels for path in level]
        return self.spark.read.parquet(*paths) if paths else None

    def fresh(self, counts: DataFrame) -> DataFrame:
        """Of a batch's keys, those that no run has."""
        known = self.rows()
        return counts if known is None else counts.join(known.hint("merge"), KEY, "left_anti")

    def add(self, counts: DataFrame) -> None:
        """Add a batch's ``line_counts`` as a run: new keys once for all, known ones with what they gain."""
        known = self.rows()
        if known is not None:
            new = self.fresh(counts)
            gains = counts.join(known.select(*KEY).hint("merge"), KEY, "left_semi")
            counts = new.unionAll(gains)
        self._write(counts, 0)
        for level in range(len(self.levels)):
            if len(self.levels[level]) >= self.fanout:
                merged = merge(self.spark.read.parquet(*self.levels[level]))
                self.levels[level] = []
                self._write(merged, level + 1)

    def counts(self) -> DataFrame | None:
        known = self.rows()
        return None if known is None else merge(known)


def merge(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.max("last_doc").alias("last_doc"))


def dropped_lines(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    min_docs: int = MIN_DOCS,
    min_chars: int = MIN_CHARS,
    batches: int = BATCHES,
    fanout: int = FANOUT,
) -> DataFrame:
    """Per document that loses lines: doc_id, text_key, ``drops`` (line numbers)."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "line-runs")
    path = os.path.join(folder, "lines")
    lines = keyed_lines(docs, text_col, id_col, min_chars)
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch")
    lines.select("*", batch).write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(lines.withColumn("batch", F.lit(0)).schema).parquet(path)
    runs = LineRuns(spark, folder, fanout)
    for number in range(batches):
        runs.add(line_counts(lines.filter(F.col("batch") == number)))
    # stored, so that both sides of the join are dealt anew and a hot line's rows can be split
    repeated = stored(runs.counts().filter(F.col("docs") >= min_docs).select(*KEY, "last_doc"), "repeated-lines")
    lost = lines.join(repeated, KEY).filter(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
    return lost.groupBy("doc_id", "text_key").agg(F.collect_set("at").alias("drops"))


def without_lines(docs: DataFrame, drops: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with those line numbers gone from the texts, and n_lines and n_dropped added."""
    marks = drops.select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("drops").alias("_drops")
    )
    same = docs[id_col].eqNullSafe(F.col("_id")) & (text_key(docs[text_col]) == F.col("_key"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.split(text, "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_drops"))
    kept = F.array_join(F.transform(stay, lambda i: F.get("_lines", i)), "\n")
    n_lines = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return (
        docs.join(marks, same, "left")
        .withColumn("n_lines", n_lines.cast("long"))
        .withColumn("n_dropped", F.coalesce(F.array_size("_drops"), F.lit(0)).cast("long"))
        .withColumn("_lines", F.when(F.col("_drops").isNotNull(), lines))
        .withColumn(text_col, F.when(F.col("_drops").isNotNull(), kept).otherwise(text))
        .drop("_id", "_key", "_drops", "_lines")
    )


def dedup_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without repeated lines: a line found in ``min_docs`` documents stays in the one with the
    largest id only.

    Adds n_lines (before) and n_dropped, replacing columns of those names. A NULL or empty text is one
    empty line; a text that loses all lines becomes empty. Documents with a NULL id count as one that is
    smaller than all others. Equal rows lose the same lines.
    """
    return without_lines(docs, dropped_lines(docs, text_col, id_col, **options), text_col, id_col)


_STRIP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
SQL = f"""
with lines as (
    select r, doc_id, pos, ls[pos] as line,
           translate(trim(ls[pos], {_STRIP}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
    from (select *, unnest(range(1, len(ls) + 1)) as pos
          from (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as ls
                from documents))),
repeated as (
    select key, max(doc_id) as last_doc from lines where length(key) >= {MIN_CHARS}
    group by key having count(distinct doc_id) >= {MIN_DOCS}),
marked as (
    select r, doc_id, line, pos, last_doc is not null and doc_id is distinct from last_doc as gone
    from lines left join repeated using (key))
select any_value(doc_id) as doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from marked group by r
"""
