"""Total orders over more rows than one task can take.

``ORDER BY``-style windows without a partition key, or with a key that holds most of the rows, run in
one task. Here the rows are range-partitioned on the whole sort key (with the unique id as its last
part, so equal values still split), sorted inside each partition and checkpointed. Every later step
then works per *segment* of that order, and only one small row per segment ever meets in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from queuemill.session import cut_lineage, shuffle_partitions

ROW_BITS = 33  # layout of monotonically_increasing_id: partition number above 33 bits of row number


def ordered_segments(df: DataFrame, order: Sequence[str], segments: int) -> DataFrame:
    """Sort ``df`` globally into ``segments`` partitions; adds ``segment`` and ``segment_row``.

    ``segments`` is the number of tasks, and bounds everything that is kept or broadcast per segment; rows
    that are equal in ``order`` share a segment. The result is checkpointed: range bounds are sampled, so a
    second evaluation could cut elsewhere, and both columns must mean the same to every reader.
    """
    numbered = (
        df.repartitionByRange(segments, *order)
        .sortWithinPartitions(*order)
        .withColumn("_row_id", F.monotonically_increasing_id())
    )
    return cut_lineage(
        numbered.select(
            *df.columns,
            F.shiftright("_row_id", ROW_BITS).cast("int").alias("segment"),
            F.col("_row_id").bitwiseAND(F.lit((1 << ROW_BITS) - 1)).alias("segment_row"),
        )
    )


def global_index(
    df: DataFrame,
    order: Sequence[str],
    name: str = "index",
    segments: int | None = None,
    total: str | None = None,
) -> DataFrame:
    """0-based position of every row in the total order, without a single-task window.

    ``segments`` is the session's number of shuffle partitions by default; ``total`` names a column for the number
    of all rows.
    """
    ordered = ordered_segments(df, order, segments or shuffle_partitions(df.sparkSession))
    before = W.orderBy("segment").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        ordered.groupBy("segment")
        .agg(F.count(F.lit(1)).alias("_size"))
        .select(
            "segment",
            F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_base"),
            *([F.sum("_size").over(W.partitionBy()).alias(total)] if total else []),
        )
    )
    return (
        ordered.join(F.broadcast(offsets), "segment")  # one row per segment
        .withColumn(name, F.col("_base") + F.col("segment_row"))
        .drop("segment", "segment_row", "_base")
    )
