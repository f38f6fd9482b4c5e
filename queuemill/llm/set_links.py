"""All links of the Jaccard join between different sets, and how many each document has.

:mod:`queuemill.llm.jaccard_join` needs only enough links to tell components. Here every list of the prefix index
is compared as a whole, so that no link between two classes is lost:

1. The lists of one *leader* (smallest signature) are taken together. Sets of up to ``block_sets`` entries are one
   block; more are cut by size class and hash, and blocks of sizes that may link meet two by two, each pair of blocks
   once. A task holds two blocks at most, whatever the length of a list.
2. In a pair of blocks, entries of one size and position are skipped together by the positional bound
   (``jaccard_join.Lists``). Sets ask in the order of component and size, and each follows from the one before it:
   moving from set z to set x, an overlap with y falls by at most ``|z - x|`` and grows by at most ``|x - z|``. Overlaps
   are kept as intervals; an answer that the interval decides is taken as it is, the others are compared.

3. Two sets may meet in the lists of several leaders. They count in those of the least leader only: sets that share
   a prefix shingle whose list has a lesser leader are left out before anything is compared, so no pair has to be
   told apart later and a task sends on one number per set.

Classes are documents of equal sets, so copies are never expanded; a document's links are the copies of all classes
that its own links with, and the other copies of its own. Links are counted where they are found; ``class_pairs`` lists them
for those who want them, as many rows as there are links between different sets.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from queuemill.llm import jaccard_join as J
from queuemill.session import stored

#: Above any overlap.
UNKNOWN = 1 << 40


def list_members(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """Sets of lists of two or more by the lists' leader: lead, sig, n, component, ``spots`` (entries in those lists)."""
    leads = lists.groupBy("shingle").agg(F.min("sig").alias("lead"), F.count("*").alias("k"))
    entries = lists.join(leads.filter("k > 1").select("shingle", "lead"), "shingle")
    members = entries.groupBy("lead", "sig").agg(
        F.first("n").alias("n"), F.collect_list(F.struct("shingle", "pos")).alias("spots")
    )
    node = labels.select(F.col("node").alias("sig"), "component")
    return members.join(node, "sig", "left").withColumn("component", F.coalesce("component", "sig"))


def block_pairs(members: DataFrame, percent: int = J.PERCENT, block_sets: int = J.BLOCK_SETS) -> DataFrame:
    """The members in pairs of blocks (lead, one, two): sets of ``one`` ask those of ``two``; ``asks`` and ``held``."""
    step = math.log(J.SIZE_STEP)
    length = members.groupBy("lead").agg(F.count("*").alias("_length"))
    size_class = F.floor(F.log("n") / step).cast("int")
    rows = members.join(length, "lead").withColumn(
        "size_class", F.when(F.col("_length") > block_sets, size_class).otherwise(0)
    )
    chunks = F.ceil(F.count("*") / block_sets).cast("int").alias("chunks")
    classes = rows.groupBy("lead", "size_class").agg(chunks)
    own = rows.join(classes, ["lead", "size_class"]).withColumn("chunk", F.pmod(F.xxhash64("sig"), "chunks").cast("int"))
    own = own.select("lead", F.struct("size_class", "chunk").alias("block"), "sig", "n", "component", "spots")
    blocks = classes.select("lead", "size_class", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    two = F.struct("size_class", "chunk")
    reach = int(math.log(100 / percent) / step) + 1
    pairs = (
        blocks.select("lead", two.alias("one"))
        .join(blocks.select("lead", two.alias("two")), "lead")
        .filter((F.col("one") <= F.col("two")) & (F.col("two.size_class") - F.col("one.size_class") <= reach))
    )
    same = F.col("one") == F.col("two")
    columns = ("lead", "one", "two", "sig", "n", "component", "spots")
    holding = own.withColumnRenamed("block", "two").join(pairs, ["lead", "two"])
    asking = own.withColumnRenamed("block", "one").join(pairs.filter(~same), ["lead", "one"])
    return holding.select(*columns, same.alias("asks"), F.lit(True).alias("held")).unionAll(
        asking.select(*columns, F.lit(True).alias("asks"), F.lit(False).alias("held"))
    )


def block_links(
    names: np.ndarray, n: np.ndarray, component: np.ndarray, asks: np.ndarray, held: np.ndarray,
    spots: tuple, sets: tuple, earlier: tuple, percent: int,
) -> tuple[np.ndarray, np.ndarray]:
    """All links of those that ask with those held (places of sets); two that both do both meet once.

    ``spots``, ``sets`` and ``earlier`` are flat: offsets, then values (shingles and positions; shingles; prefix
    shingles of lesser leaders). Sets that share one of ``earlier`` meet elsewhere.
    """
    n = n.astype(np.int64)
    spot_offsets, spot_shingles, spot_pos = spots
    offsets, values = sets
    owner = np.repeat(np.arange(len(n)), np.diff(spot_offsets))
    inside = held[owner]
    lists = J.Lists(spot_shingles[inside], spot_pos[inside], owner[inside], n[owner[inside]])
    distinct, codes = np.unique(values, return_inverse=True)
    mine = np.zeros(len(distinct), bool)
    early_offsets, early = earlier[0], np.unique(earlier[1], return_inverse=True)[1]
    elsewhere = np.zeros(len(early), bool)
    low, high = np.zeros(len(n), np.int64), np.full(len(n), UNKNOWN, np.int64)  # overlap with ``last``
    last = None
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for x in np.flatnonzero(asks)[np.lexsort((n[asks], component[asks]))].tolist():
        entries = slice(spot_offsets[x], spot_offsets[x + 1])
        there = lists.candidates(spot_shingles[entries], spot_pos[entries], int(n[x]), percent)
        there = there[~(asks[there] & held[x]) | (names[there] < names[x])]
        ours = early[early_offsets[x] : early_offsets[x + 1]]
        if len(ours) and len(there):
            elsewhere[ours] = True
            lengths = early_offsets[there + 1] - early_offsets[there]
            hits = elsewhere[early[J._expand(early_offsets[there], lengths)]]
            met = np.bincount(np.repeat(np.arange(len(there)), lengths)[hits], minlength=len(there))
            elsewhere[ours] = False
            there = there[met == 0]
        if not len(there):
            continue
        own = codes[offsets[x] : offsets[x + 1]]
        mine[own] = True
        if last is not None:
            before = codes[offsets[last] : offsets[last + 1]]
            common = int(mine[before].sum())
            low -= len(before) - common
            high += len(own) - common
        last = x
        enough = percent * (n[x] + n[there])
        linked = (100 + percent) * low[there] >= enough
        undecided = ~linked & ((100 + percent) * high[there] >= enough)
        compared = there[undecided]
        if len(compared):
            lengths = offsets[compared + 1] - offsets[compared]
            shared = np.add.reduceat(
                mine[codes[J._expand(offsets[compared], lengths)]],
                np.concatenate(([0], np.cumsum(lengths)[:-1])), dtype=np.int64,
            )
            low[compared] = high[compared] = shared
            linked[undecided] = (100 + percent) * shared >= enough[undecided]
        mine[own] = False
        partners = there[linked]
        found.append((np.full(len(partners), x), partners))
    return tuple(np.concatenate(side) for side in zip(*found))


def _found_in(table: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of a pair of blocks, and the places of those that link."""
    offsets, values = J._flat(table["shingles"])
    spot_offsets, spots = J._flat(table["spots"])
    spots = (spot_offsets, spots.field(0).to_numpy(), spots.field(1).to_numpy().astype(np.int64))
    first_offsets, firsts = J._flat(table["firsts"])
    less = firsts.field(1).to_numpy() < table["lead"][0].as_py()
    earlier = (np.concatenate(([0], np.cumsum(less)))[first_offsets], firsts.field(0).to_numpy()[less])
    sig, n, component, asks, held = (table[name].to_numpy() for name in ("sig", "n", "component", "asks", "held"))
    sets = (offsets, values.to_numpy())
    return sig, *block_links(sig, n, component, asks, held, spots, sets, earlier, percent)


def _pairs(percent: int) -> Callable:
    def link(table: pa.Table) -> pa.Table:
        sig, one, two = _found_in(table, percent)
        a, b = np.minimum(sig[one], sig[two]), np.maximum(sig[one], sig[two])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return link


def _counts(percent: int) -> Callable:
    def link(table: pa.Table) -> pa.Table:
        sig, one, two = _found_in(table, percent)
        copies = table["copies"].to_numpy()
        links = np.zeros(len(sig), np.int64)
        np.add.at(links, one, copies[two])
        np.add.at(links, two, copies[one])
        some = links > 0
        return pa.table({"sig": pa.array(sig[some], pa.int64()), "links": pa.array(links[some], pa.int64())})

    return link


class Meetings(NamedTuple):
    """Stored members of the lists, and the sets that they name."""

    members: DataFrame
    sets: DataFrame

    def blocks(self, percent: int, block_sets: int | None) -> GroupedData:
        """Pairs of blocks with all that is compared: one group each."""
        members = self.members
        each = F.transform("spots", lambda spot: F.struct(spot["shingle"].alias("shingle"), F.col("lead").alias("lead")))
        firsts = members.groupBy("sig").agg(F.flatten(F.collect_list(each)).alias("firsts"))
        rows = block_pairs(members, percent, block_sets or J.BLOCK_SETS)
        return rows.join(self.sets.join(firsts, "sig"), "sig").groupBy("lead", "one", "two")


def meetings(steps: J.Joined) -> Meetings:
    copies = steps.found.filter("n > 0").groupBy("sig").agg(F.count("*").alias("copies"))
    members = stored(list_members(steps.lists, steps.labels), "jaccard-members")
    return Meetings(members, steps.sets.select("sig", "shingles").join(copies, "sig"))


def class_pairs(steps: J.Joined, percent: int = J.PERCENT, block_sets: int | None = None) -> DataFrame:
    """Every link (a, b), a < b, between two different classes, once."""
    return meetings(steps).blocks(percent, block_sets).applyInArrow(_pairs(percent), "a bigint, b bigint")


def jaccard_join(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = J.WIDTH, percent: int = J.PERCENT,
    block_sets: int | None = None,
) -> DataFrame:
    """One row per document as :func:`jaccard_join.near_duplicates` gives it, with ``n_links``: the documents that it
    links with, copies included. :func:`class_pairs` has the links themselves.

    Empty and NULL texts link with nothing, so they have 0 links; rows of one id, also repeated rows, are documents of their
    own; NULL ids stay. Other columns of ``docs`` are not read.
    """
    return with_links(J.joined(docs, text_col, id_col, width, percent), percent, block_sets)


def with_links(steps: J.Joined, percent: int = J.PERCENT, block_sets: int | None = None) -> DataFrame:
    found = meetings(steps).blocks(percent, block_sets).applyInArrow(_counts(percent), "sig bigint, links bigint")
    others = found.groupBy(F.col("sig").alias("_own")).agg(F.sum("links").alias("_others"))
    copies = steps.found.filter("n > 0").groupBy(F.col("sig").alias("class")).agg(F.count("*").alias("_copies"))
    totals = copies.join(others, F.col("class") == F.col("_own"), "left").select(
        "class", (F.col("_copies") - 1 + F.coalesce("_others", F.lit(0))).alias("_links")
    )
    named = J._named(steps.found, steps.labels).join(totals, "class", "left")
    return named.withColumn("n_links", F.coalesce("_links", F.lit(0)).cast("long")).drop("_links")
