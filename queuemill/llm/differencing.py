"""Shards of nearly equal bytes by Karmarkar-Karp differencing; documents of equal text stay together.

1. Bytes are summed per group of equal texts (``keyed_documents``: 128 bits of SHA-256 name a group).
2. A group of more than ``1 / PACKETS`` of all bytes is an item by itself, so there are fewer than ``PACKETS`` of these;
   all other groups are dealt by hash into ``PACKETS`` packets, and a packet is an item. So there are less than twice
   ``PACKETS`` items, however large the table is, and only these reach the driver.
3. Differencing: each item begins as a partition with one filled part. The two partitions of largest spread are combined
   time and again, the largest part of one with the smallest of the other, until one is left (``differencing``).
4. Documents look up their group or packet in the plan (two broadcasts of fewer than ``PACKETS`` + 1 rows each) and are
   numbered within their shard over all tasks, so neither a shard nor a large group is ever in one task.

NULL text counts as empty. Order within a shard is by id (NULL first), then text; equal rows may swap places, so reruns
agree. An empty table gives no rows. Columns other than id and text are carried by ``assign`` and ``write_shards`` only.
A group larger than an equal share makes its shard larger than the others, which then share the rest equally.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from queuemill.operators.ordering import global_index
from queuemill.session import stored

SHARDS = 16
PACKETS = 8192
LAW = "bytes"


def differencing(sizes: np.ndarray, parts: int) -> np.ndarray:
    """The part of every item: repeatedly the two partitions with the largest spread become one.

    Sums are kept in falling order; the other partition's rising order is added to it. Ties go to the older partition.
    """
    sizes = np.asarray(sizes, np.int64)
    if len(sizes) == 0:
        return np.empty(0, np.int64)
    joined = np.arange(len(sizes))  # the item that stands for the same bag, or the item itself
    heap = []
    for item, size in enumerate(sizes.tolist()):
        sums, bags = np.zeros(parts, np.int64), np.full(parts, -1)
        sums[0], bags[0] = size, item
        heap.append((-size if parts > 1 else 0, item, sums, bags))
    heapq.heapify(heap)
    for born in range(len(sizes), 2 * len(sizes) - 1):
        _, _, sums, bags = heapq.heappop(heap)
        _, _, sums_b, bags_b = heapq.heappop(heap)
        sums, bags_b = sums + sums_b[::-1], bags_b[::-1]
        both = (bags >= 0) & (bags_b >= 0)
        joined[bags_b[both]] = bags[both]
        bags = np.where(bags >= 0, bags, bags_b)
        order = np.argsort(-sums, kind="stable")
        sums, bags = sums[order], bags[order]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), born, sums, bags))
    while (joined != joined[joined]).any():
        joined = joined[joined]
    part_of = np.empty(len(sizes), np.int64)
    bags = heap[0][3]
    part_of[bags[bags >= 0]] = np.flatnonzero(bags >= 0)
    return part_of[joined]


def text_group(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, 16)


def text_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def packet(group: Column) -> Column:
    return F.pmod(F.xxhash64(group), F.lit(PACKETS)).cast("int")


@dataclass(frozen=True)
class ShardPlan:
    """Shards of the large groups (``_group, _shard``) and of the packets (``_packet, _shard``)."""

    large: DataFrame
    packets: DataFrame
    bytes_per_shard: list[int]


def plan_shards(keyed: DataFrame, shards: int = SHARDS) -> ShardPlan:
    """Differencing over ``keyed`` (``_group, _size``, a row per document)."""
    total = keyed.agg(F.sum("_size")).first()[0] or 0
    groups = keyed.groupBy("_group").agg(F.sum("_size").alias("bytes"))
    is_large = F.col("bytes") > total // PACKETS
    items = groups.select(
        F.when(is_large, F.col("_group")).alias("group"), F.when(~is_large, packet(F.col("_group"))).alias("p"), "bytes"
    )
    found = items.groupBy("group", "p").agg(F.sum("bytes").alias("bytes")).collect()  # less than 2 * PACKETS rows
    found.sort(key=lambda row: (-row["bytes"], row["p"] if row["p"] is not None else -1, bytes(row["group"] or b"")))
    sizes = np.array([row["bytes"] for row in found], np.int64)
    part = differencing(sizes, shards)
    spark = keyed.sparkSession
    large = [(bytes(r["group"]), int(s)) for r, s in zip(found, part) if r["p"] is None]
    packets = [(r["p"], int(s)) for r, s in zip(found, part) if r["p"] is not None]
    return ShardPlan(
        spark.createDataFrame(large, "_group binary, _shard int"),
        spark.createDataFrame(packets, "_packet int, _shard int"),
        np.bincount(part, sizes, shards).astype(np.int64).tolist() if len(part) else [0] * shards,
    )


def assign(keyed: DataFrame, plan: ShardPlan, name: str = "shard") -> DataFrame:
    """``keyed`` (with ``_group``) and the shard of every row as ``name``."""
    large = plan.large.withColumnRenamed("_shard", "_of_large")
    packets = plan.packets.withColumnRenamed("_shard", "_of_packet")
    found = keyed.withColumn("_packet", packet(F.col("_group")))
    found = found.join(F.broadcast(large), "_group", "left").join(F.broadcast(packets), "_packet", "left")
    return found.withColumn(name, F.coalesce("_of_large", "_of_packet")).drop("_packet", "_of_large", "_of_packet")


def shard_report(
    docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per document: id, ``size``, ``text_crc32``, ``law``, ``shard``, its ``slot`` there, and ``grown_shard`` (NULL: the
    law of bytes says nothing about further shards)."""
    text = F.col(text_col)
    keyed = stored(
        docs.select(
            F.col(id_col),
            text_size(text).alias("_size"),
            F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
            text_group(text).alias("_group"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "shard-sizes",
    )
    placed = assign(keyed, plan_shards(keyed, shards))
    numbered = global_index(placed, ["shard", id_col, "_group", "_row"], "_at")
    first = numbered.groupBy("shard").agg(F.min("_at").alias("_first"))
    return numbered.join(F.broadcast(first), "shard").select(  # one row per shard
        id_col,
        F.col("_size").alias("size"),
        "text_crc32",
        F.lit(LAW).alias("law"),
        "shard",
        (F.col("_at") - F.col("_first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(
    docs: DataFrame, folder: str, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Write ``docs`` with all columns below ``folder/shard=k``, in order of ids within a file; returns what was written.

    A column of the name ``shard`` is replaced.
    """
    own = [c for c in docs.columns if c.lower() != "shard"]
    text = F.col(text_col)
    keyed = docs.select(
        F.struct(*own).alias("_doc"),
        F.col(id_col).alias("_id"),
        text_size(text).alias("_size"),
        text_group(text).alias("_group"),
    )
    placed = assign(keyed, plan_shards(keyed.select("_group", "_size"), shards), "_shard")
    order = ["_shard", "_id", "_group"]
    ranged = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.select("_doc.*", F.col("_shard").alias("shard")).write.partitionBy("shard").parquet(folder)
    return read_shards(docs.sparkSession, folder)


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)
