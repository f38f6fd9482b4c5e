"""A request table that is stored by key: lookups and merges of few ids touch few of its files.

The table is an ordinary Spark table of Parquet files, in ``buckets`` buckets by the hash of its key (Spark's bucketing)
and, by the same number, in as many folders (``slot``), each sorted by key. So

* the scan already has the distribution that a join or aggregation by key asks for: only the other side is shuffled;
* ids prune folders (so buckets, too) and, by the Parquet statistics, row groups;
* a merge rewrites the folders of the keys that it changes, and no others.

``merge`` may be repeated, as a stream's epoch is after a failure: it sets columns to the values of the newest update, and
folders that were rewritten already get the same rows again. Rows are staged before a folder is replaced, since Spark
cannot overwrite what it is reading. One writer at a time. Keys that are NULL are refused.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from queuemill.operators.table import delete, upsert
from queuemill.session import scratch_path

SLOT = "slot"


def slot_of(key: Column, buckets: int) -> Column:
    """The number that Spark's bucketing gives a key."""
    return F.pmod(F.hash(key), F.lit(buckets))


@dataclass(frozen=True)
class StoredTable:
    spark: SparkSession
    name: str
    buckets: int
    key: str = "request_id"

    def read(self) -> DataFrame:
        return self.spark.table(self.name).drop(SLOT)

    def get(self, ids: Iterable[Any], keys: Sequence[str] | None = None) -> DataFrame:
        """Rows of a list of ids: the query names them, so that files without them are not opened."""
        ids = list(ids)
        key_type = self.read().schema[self.key].dataType  # numbers of other widths have other hashes
        named = F.explode(F.array(*[F.lit(i).cast(key_type) for i in ids])).alias(self.key)
        slots = self._distinct(self.spark.range(1).select(named)) if ids else []
        found = self._slots(slots).filter(F.col(self.key).isin(ids))
        return found.select(self.key, *[k for k in keys if k != self.key]) if keys else found

    def get_all(self, ids: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
        """Rows of the ids in a table of any size; the ids travel to the buckets, the stored rows stay where they are."""
        wanted = self._typed(ids).select(self.key).repartition(self.buckets, self.key)
        found = self._slots(self._distinct(ids)).join(wanted, self.key, "left_semi")
        return found.select(self.key, *[k for k in keys if k != self.key]) if keys else found

    def merge(self, updates: DataFrame, version: Column) -> None:
        """:func:`~queuemill.operators.table.upsert` in the folders of the keys in ``updates``."""
        touched = self._distinct(updates)
        if touched:
            moved = self._typed(updates).repartition(self.buckets, self.key)
            self._replace(upsert(self._slots(touched), moved, version, self.key), touched)

    def merge_epochs(self, version: Callable[[], Column]) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``: merge every epoch's rows. ``version()`` orders updates of one key."""

        def write(rows: DataFrame, epoch: int) -> None:
            rows.persist()
            try:
                self.merge(rows, version())
            finally:
                rows.unpersist()

        return write

    def delete(self, query: Mapping[str, Any]) -> None:
        """Remove matching rows; folders without any are left alone."""
        kept = delete(self.read(), query)
        before = self._counts(self.read())
        after = self._counts(kept)
        touched = sorted(s for s, n in before.items() if after.get(s, 0) != n)
        if touched:
            self._replace(delete(self._slots(touched), query), touched)

    def _counts(self, rows: DataFrame) -> dict[int, int]:
        """Rows per slot: as many numbers as there are buckets."""
        slot = slot_of(F.col(self.key), self.buckets).alias("s")
        return {r["s"]: r["n"] for r in rows.groupBy(slot).agg(F.count("*").alias("n")).collect()}

    def _typed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(self.key, F.col(self.key).cast(self.read().schema[self.key].dataType))

    def _distinct(self, ids: DataFrame) -> list[int]:
        """Slots of some keys, as many as there are buckets at most."""
        key = F.col(self.key)
        found = self._typed(ids).select(key.isNull().alias("none"), slot_of(key, self.buckets).alias("s"))
        rows = found.distinct().collect()
        if any(row["none"] for row in rows):
            raise ValueError(f"a {self.key!r} is NULL")
        return sorted(row["s"] for row in rows)

    def _slots(self, slots: Sequence[int]) -> DataFrame:
        whole = self.spark.table(self.name)
        if len(slots) < self.buckets:
            whole = whole.filter(F.col(SLOT).isin(list(slots)))
        return whole.drop(SLOT)

    def _replace(self, rows: DataFrame, slots: Sequence[int]) -> None:
        """Put ``rows`` in the place of what lies in ``slots``; a slot may become empty."""
        staged = create(rows, f"{self.name}_staged", self.buckets, self.key, scratch_path(self.spark, "staged-table"))
        try:
            left = set(staged._distinct(staged.read()))
            for slot in set(slots) - left:
                self.spark.sql(f"alter table {self.name} drop if exists partition ({SLOT} = {slot}) purge")
            columns = self.spark.table(self.name).columns
            writer = self.spark.table(staged.name).select(columns).write.mode("overwrite")
            mode = "spark.sql.sources.partitionOverwriteMode"
            before = self.spark.conf.get(mode)
            self.spark.conf.set(mode, "dynamic")
            try:
                writer.insertInto(self.name)
            finally:
                self.spark.conf.set(mode, before)
        finally:
            self.spark.sql(f"drop table if exists {staged.name}")


def create(
    df: DataFrame, name: str, buckets: int, key: str = "request_id", path: str | None = None
) -> StoredTable:
    """Store ``df`` as the table ``name`` at ``path`` (the warehouse by default). One file per bucket."""
    spark = df.sparkSession
    placed = df.repartition(buckets, key).withColumn(SLOT, slot_of(F.col(key), buckets))
    writer = placed.write.partitionBy(SLOT).bucketBy(buckets, key).sortBy(key).format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return StoredTable(spark, name, buckets, key)


def open_stored(
    spark: SparkSession, name: str, path: str, buckets: int, key: str = "request_id"
) -> StoredTable:
    """Name the files that :func:`create` left at ``path`` again, in a session whose catalog does not know them."""
    columns = spark.read.parquet(path).drop(SLOT).schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns)
    spark.sql(
        f"create table {name} ({ddl}, {SLOT} int) using parquet partitioned by ({SLOT}) "
        f"clustered by (`{key}`) sorted by (`{key}`) into {buckets} buckets location '{path}'"
    )
    spark.catalog.recoverPartitions(name)
    return StoredTable(spark, name, buckets, key)
