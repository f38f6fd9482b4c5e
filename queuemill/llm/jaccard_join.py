"""Exact n-gram Jaccard join of all documents, with set-relation skipping.

A document's set is its distinct word shingles; two documents link when their sets' Jaccard similarity is
``percent`` or more. Documents with equal sets are one *class*, and everything below works on classes.

1. ``documents_and_hot`` hashes each text once: set size and a signature per document, and shingles that are hot
   within a batch of documents. The hottest ``MAX_HOT`` of all are known to every task from then on.
2. ``records`` finds how many classes hold each shingle. Shingles travel packed, by hash range, one entry per
   class; hot ones stay behind, so no shingle's list meets in one task. Shingles of one class alone cannot
   be shared and are dropped; the others are put in one global order, rarest first.
3. Two sets that link share a shingle among the first ``n - ceil(t * n) + 1`` of both. Lists of these shingles
   are the index. Every set is first joined to one *leader* per list; links found there make components.
4. Lists that lie in one component are skipped whole: a set's answers follow from those of a set it links
   with. In other lists only sets outside the list's largest component ask, against blocks of the list of
   fitting sizes. Within a block, entries of one size and position are skipped together by the positional
   bound; and a set is compared only with those that the answers of a similar set leave possible, since
   ``|x & y| <= |z & y| + |x - z|``. What is left is compared shingle by shingle.

No step lists all pairs of a group. Similarity is decided in whole numbers on 48-bit shingle hashes, within two
sets at a time; classes are told apart by 64-bit signatures together with their sizes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queuemill.llm.components import components
from queuemill.llm.shingles import mix, shingle_sets
from queuemill.llm.text import text_key
from queuemill.session import shuffle_partitions, stored

WIDTH = 5
PERCENT = 80
#: Shingles that tasks keep out of the packed lists: those of more than about 0.4 % of all sets at least.
MAX_HOT = 200_000
#: Sets of one batch that hold a shingle before it counts as hot there.
HOT_IN_BATCH = 8
#: Shingles that a task packs at a time.
PACK = 1 << 20
#: Signatures of the classes that a task has already sent.
REMEMBERED = 1 << 20
#: Sets of one list that one task compares.
BLOCK_SETS = 512
#: Growth of set sizes from one block class to the next.
SIZE_STEP = 1.1
#: Hot shingles come after all others in the global order.
HOT_ORDER = 1 << 40

U = np.uint64
CLASS = ["sig", "n"]


def _signature(found: np.ndarray) -> np.ndarray:
    return mix(mix(found ^ U(0xA0761D6478BD642F)).sum(dtype=U) + np.array([len(found)], U))


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    for batch in batches:
        for row, found in shingle_sets(batch.column("text"), width):
            yield batch, row, found


def _per_batch(batches: Iterator[pa.RecordBatch], width: int, size: int) -> Iterator[list[tuple]]:
    """Lists of (batch, row, set) with about ``size`` shingles each."""
    held, total = [], 0
    for item in _sets(batches, width):
        held.append(item)
        total += len(item[2])
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


_FOUND = "doc_id bigint, text_key bigint, sig bigint, n int, shingle bigint, sets bigint"


def documents_and_hot(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Rows of two kinds: documents (doc_id, sig, n) and shingles that are hot in a batch (shingle, sets)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _per_batch(batches, width, PACK):
            sigs = np.array([_signature(s)[0] if len(s) else 0 for _, _, s in held], U).view(np.int64)
            sizes = np.array([len(s) for _, _, s in held], np.int32)
            classes = {}
            for sig, (_, _, found) in zip(sigs.tolist(), held):
                classes[sig, len(found)] = found
            shingles, sets = np.unique(np.concatenate(list(classes.values())) >> U(16), return_counts=True)
            hot = sets >= HOT_IN_BATCH
            n = int(hot.sum())
            nothing = len(held)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array([b.column("doc_id")[r].as_py() for b, r, _ in held] + [None] * n, pa.int64()),
                    "text_key": pa.array([b.column("text_key")[r].as_py() for b, r, _ in held] + [None] * n, pa.int64()),
                    "sig": pa.array(np.concatenate((sigs, np.zeros(n, np.int64)))),
                    "n": pa.array(np.concatenate((sizes, np.full(n, -1, np.int32)))),
                    "shingle": pa.array(np.concatenate((np.zeros(nothing, np.int64), shingles[hot].view(np.int64)))),
                    "sets": pa.array(np.concatenate((np.zeros(nothing, np.int64), sets[hot].astype(np.int64)))),
                }
            )

    return docs.select("doc_id", "text_key", "text").mapInArrow(find, _FOUND)


def _six(shingles: np.ndarray) -> bytes:
    return shingles.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(raw: np.ndarray) -> np.ndarray:
    whole = np.zeros((len(raw) // 6, 8), np.uint8)
    whole[:, :6] = raw.reshape(-1, 6)
    return whole.view("<u8").ravel()


def _pack(sigs: np.ndarray, counts: np.ndarray, shingles: np.ndarray, extra: np.ndarray | None = None) -> bytes:
    """Runs of shingles by class: numbers of both, signatures, run lengths, shingles, and a number for each."""
    head = np.array([len(sigs), len(shingles)], "<u4").tobytes()
    tail = extra.astype("<u8").tobytes() if extra is not None else b""
    return head + sigs.astype("<u8").tobytes() + counts.astype("<u4").tobytes() + _six(shingles) + tail


def _unpack(raw: bytes, extra: bool = False) -> tuple[np.ndarray, ...]:
    data = np.frombuffer(raw, np.uint8)
    classes, n = data[:8].view("<u4").tolist()
    at = 8
    sigs = data[at : at + 8 * classes].view("<u8")
    at += 8 * classes
    counts = data[at : at + 4 * classes].view("<u4")
    at += 4 * classes
    shingles = _from_six(data[at : at + 6 * n])
    at += 6 * n
    found = (np.repeat(sigs, counts), shingles)
    return (*found, data[at : at + 8 * n].copy().view("<u8")) if extra else found


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of runs of equal values."""
    if not len(sorted_values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))
    return first, np.diff(np.concatenate((first, [len(sorted_values)])))


def _parted(part: np.ndarray, sigs: np.ndarray, shingles: np.ndarray, extra: np.ndarray | None) -> Iterator[tuple[int, bytes]]:
    """Packed runs per part; the rows of a class must come together."""
    order = np.argsort(part.astype(np.uint16) if part.max(initial=0) < 1 << 16 else part, kind="stable")
    part, sigs, shingles = part[order], sigs[order], shingles[order]
    extra = None if extra is None else extra[order]
    for begin, length in zip(*(x.tolist() for x in _runs(part))):
        span = slice(begin, begin + length)
        first, counts = _runs(sigs[span])
        yield int(part[begin]), _pack(
            sigs[span][first], counts, shingles[span], None if extra is None else extra[span]
        )


_PACKED = "part int, kind int, payload binary"


def _packed_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    part, kind, payload = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_pydict(
        {"part": pa.array(part, pa.int32()), "kind": pa.array(kind, pa.int32()), "payload": pa.array(payload, pa.binary())}
    )


#: Kinds of packed rows: shingles to be counted; sizes of classes; shingles whose order is known.
COUNT, SIZES, ORDERED = 0, 1, 2


def _packer(width: int, parts: int, hot: np.ndarray, hot_sets: np.ndarray) -> Callable:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[int, int]] = set()
        for held in _per_batch(batches, width, PACK):
            new = {}
            for _, _, found in held:
                if len(found):
                    key = (int(_signature(found)[0]), len(found))
                    if key not in sent:
                        new[key] = found
                        sent.add(key)
            if len(sent) > REMEMBERED:
                sent.clear()
            if not new:
                continue
            sizes = np.array([n for _, n in new], np.int64)
            names = np.array([sig for sig, _ in new], U)
            shingles = np.concatenate(list(new.values())) >> U(16)
            sigs = np.repeat(names, sizes)
            rows = [(p, SIZES, raw) for p, raw in _parted(names % U(parts), names, sizes.astype(U), None)]
            if len(hot):
                place = np.minimum(np.searchsorted(hot, shingles), len(hot) - 1)
                known = hot[place] == shingles
                if known.any():
                    order = hot_sets[place[known]] + U(HOT_ORDER)
                    ordered = _parted(sigs[known] % U(parts), sigs[known], shingles[known], order)
                    rows += [(p, ORDERED, raw) for p, raw in ordered]
                sigs, shingles = sigs[~known], shingles[~known]
            counted = _parted(mix(shingles) % U(parts), sigs, shingles, None)
            rows += [(p, COUNT, raw) for p, raw in counted]
            yield _packed_batch(rows)

    return pack


def _counter(parts: int) -> Callable:
    def count(table: pa.Table) -> pa.Table:
        """How many classes hold each shingle; single ones go, the others are sent on to their classes."""
        kinds, payloads = table["kind"].to_numpy(), table["payload"]
        rows, sigs, shingles = [], [], []
        for kind, payload in zip(kinds.tolist(), payloads):
            if kind != COUNT:
                rows.append((int(table["part"][0].as_py()), kind, payload.as_py()))
                continue
            s, x = _unpack(payload.as_py())
            sigs.append(s)
            shingles.append(x)
        if sigs:
            s, x = np.concatenate(sigs), np.concatenate(shingles)
            order = np.argsort(x)
            s, x = s[order], x[order]
            first, counts = _runs(x)
            shared = np.repeat(counts > 1, counts)
            s, x = s[shared], x[shared]
            order = np.lexsort((s, x))  # a class that several tasks sent is counted once
            s, x = s[order], x[order]
            keep = np.ones(len(x), bool)
            keep[1:] = (x[1:] != x[:-1]) | (s[1:] != s[:-1])
            s, x = s[keep], x[keep]
            first, counts = _runs(x)
            each = np.repeat(counts, counts)
            shared = each > 1
            s, x, each = s[shared], x[shared], each[shared].astype(U)
            if len(s):
                order = np.argsort(s, kind="stable")
                s, x, each = s[order], x[order], each[order]
                rows += [(p, ORDERED, raw) for p, raw in _parted(s % U(parts), s, x, each)]
        return pa.Table.from_batches([_packed_batch(rows)])

    return count


def _recorder(percent: int) -> Callable:
    def record(table: pa.Table) -> pa.Table:
        """Sets that have a shared shingle in their prefix: size, rank of the first shared one, shingles in order."""
        sizes, names, sigs, shingles, orders = [], [], [], [], []
        for kind, payload in zip(table["kind"].to_numpy().tolist(), table["payload"]):
            if kind == SIZES:
                s, n = _unpack(payload.as_py())
                names.append(s)
                sizes.append(n)
            else:
                s, x, o = _unpack(payload.as_py(), extra=True)
                sigs.append(s)
                shingles.append(x)
                orders.append(o)
        empty = np.zeros(0, U)
        name, size = (np.concatenate(x) if x else empty for x in (names, sizes))
        s, x, o = (np.concatenate(y) if y else empty for y in (sigs, shingles, orders))
        order = np.argsort(name, kind="stable")
        name, size = name[order], size[order]
        order = np.lexsort((x, o, s))
        s, x = s[order], x[order]
        keep = np.ones(len(s), bool)  # hot shingles of a class come from every task that sent it
        keep[1:] = (s[1:] != s[:-1]) | (x[1:] != x[:-1])
        s, x = s[keep], x[keep]
        first, counts = _runs(s)
        n = size[np.searchsorted(name, s[first])].astype(np.int64) if len(first) else np.zeros(0, np.int64)
        single = n - counts
        prefix = np.clip(n - (percent * n + 99) // 100 + 1 - single, 0, counts)
        active = prefix > 0
        values = x[np.repeat(active, counts)]
        offsets = np.concatenate(([0], np.cumsum(counts[active]))).astype(np.int32)
        return pa.table(
            {
                "sig": pa.array(s[first][active].view(np.int64)),
                "n": pa.array(n[active].astype(np.int32)),
                "single": pa.array(single[active].astype(np.int32)),
                "prefix": pa.array(prefix[active].astype(np.int32)),
                "shingles": pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64))),
            }
        )

    return record


def hottest(found: DataFrame, limit: int = MAX_HOT) -> tuple[np.ndarray, np.ndarray]:
    """The hottest shingles and their counts, ``limit`` rows at most, for the closure of every task."""
    counts = found.filter("n < 0").groupBy("shingle").agg(F.sum("sets").alias("sets"))
    rows = counts.orderBy(F.desc("sets"), "shingle").limit(limit).toPandas().sort_values("shingle")
    return rows["shingle"].to_numpy(np.int64).view(U), rows["sets"].to_numpy(np.int64).astype(U)


def records(docs: DataFrame, found: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Per class that may link: sig, n, single, prefix, shingles (shared ones in the global order)."""
    parts = shuffle_partitions(docs.sparkSession)
    hot, hot_sets = hottest(found)
    packed = docs.select("text").mapInArrow(_packer(width, parts, hot, hot_sets), _PACKED)
    counted = packed.groupBy("part").applyInArrow(_counter(parts), _PACKED)
    return counted.groupBy("part").applyInArrow(
        _recorder(percent), "sig bigint, n int, single int, prefix int, shingles array<bigint>"
    )


def _links(overlap: Column, a: Column, b: Column, percent: int) -> Column:
    return 100 * overlap >= percent * (a + b - overlap)


def index_lists(sets: DataFrame) -> DataFrame:
    """The prefix index: shingle, sig, n, pos (rank in the set's global order)."""
    entries = F.posexplode(F.slice("shingles", F.lit(1), F.col("prefix")))
    return sets.select("sig", "n", "single", entries.alias("i", "shingle")).select(
        "shingle", "sig", "n", (F.col("single") + F.col("i")).alias("pos")
    )


def leader_links(sets: DataFrame, lists: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between sets and the leaders of their lists (the smallest signature)."""
    lead = lists.groupBy("shingle").agg(F.min(F.struct("sig", "n", "pos")).alias("lead"), F.count("*").alias("k"))
    lead = lead.filter("k > 1").select("shingle", "lead")
    pairs = lists.join(lead, "shingle").filter(F.col("sig") != F.col("lead.sig"))
    n, m = F.col("n"), F.col("lead.n")
    rest = F.least(n - F.col("pos"), m - F.col("lead.pos"))
    fits = (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (
        (100 + percent) * (F.least(F.col("pos"), F.col("lead.pos")) + rest) >= percent * (n + m)
    )
    pairs = pairs.filter(fits).select("sig", F.col("lead.sig").alias("lead")).distinct()
    own = sets.select("sig", "n", "shingles")
    other = sets.select(F.col("sig").alias("lead"), F.col("n").alias("m"), F.col("shingles").alias("others"))
    both = pairs.join(own, "sig").join(other, "lead")
    overlap = F.size(F.array_intersect("shingles", "others"))
    return both.filter(_links(overlap, F.col("n"), F.col("m"), percent)).select(
        F.col("sig").alias("a"), F.col("lead").alias("b")
    )


def open_members(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """Sets of lists with several components, by the lists' leader (smallest signature): lead, sig, n, component,
    ``spots`` (the set's entries in lists of this leader). Lists of one component are skipped whole."""
    node = labels.select(F.col("node").alias("sig"), "component")
    entries = lists.join(node, "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    several = entries.groupBy("shingle").agg(
        F.min("sig").alias("lead"), F.min("component").alias("low"), F.max("component").alias("high")
    )
    left = entries.join(several.filter("low < high").select("shingle", "lead"), "shingle")
    return left.groupBy("lead", "sig").agg(
        F.first("n").alias("n"),
        F.first("component").alias("component"),
        F.collect_list(F.struct("shingle", "pos")).alias("spots"),
    )


def open_blocks(members: DataFrame, percent: int = PERCENT, block_sets: int = BLOCK_SETS) -> DataFrame:
    """The same sets in blocks, with ``block``, ``asks`` and ``held``.

    Sets outside their leader's largest component ask. Up to ``block_sets`` sets of a leader are one block. More
    are cut by size class and hash; those that ask go to all blocks of sizes that may link with theirs.
    """
    per = members.groupBy("lead", "component").agg(F.count("*").alias("k"))
    leads = per.groupBy("lead").agg(
        F.max_by("component", F.struct("k", "component")).alias("largest"), F.sum("k").alias("length")
    )
    step = math.log(SIZE_STEP)
    rows = members.join(leads, "lead").withColumns(
        {"asks": F.col("component") != F.col("largest"), "size_class": F.floor(F.log("n") / step).cast("int")}
    )
    kept = ("sig", "n", "component", "spots")
    small = rows.filter(F.col("length") <= block_sets).select(
        "lead", F.lit("all").alias("block"), *kept, "asks", F.lit(True).alias("held")
    )
    large = rows.filter(F.col("length") > block_sets)
    chunks = F.ceil(F.count("*") / block_sets).cast("int").alias("chunks")
    classes = large.groupBy("lead", "size_class").agg(chunks)
    name = lambda chunk: F.concat_ws("-", F.col("size_class"), chunk).alias("block")
    own = large.join(classes, ["lead", "size_class"]).select(
        "lead", name(F.pmod(F.xxhash64("sig"), F.col("chunks"))), *kept,
        F.lit(False).alias("asks"), F.lit(True).alias("held"),
    )
    low = F.floor(F.log(F.col("n") * percent / 100) / step).cast("int") - 1
    high = F.floor(F.log(F.col("n") * 100 / percent) / step).cast("int") + 1
    reach = large.filter("asks").withColumn("size_class", F.explode(F.sequence(low, high)))
    asking = reach.join(classes, ["lead", "size_class"]).select(
        "lead", "size_class", *kept, F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")
    )
    asking = asking.select(
        "lead", name(F.col("chunk")), *kept, F.lit(True).alias("asks"), F.lit(False).alias("held")
    )
    return small.unionAll(own).unionAll(asking)


def _expand(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of the ranges that begin at ``first``."""
    total = int(lengths.sum())
    return np.repeat(first - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(total)


class Lists:
    """Index lists of one block of sets, each cut into skip blocks of entries of one size and position."""

    def __init__(self, shingle: np.ndarray, pos: np.ndarray, owner: np.ndarray, n: np.ndarray):
        order = np.lexsort((pos, n, shingle))
        shingle, pos, self.owner, n = shingle[order], pos[order], owner[order], n[order]
        new = np.ones(len(order), bool)
        new[1:] = (shingle[1:] != shingle[:-1]) | (n[1:] != n[:-1]) | (pos[1:] != pos[:-1])
        self.first = np.flatnonzero(new)
        self.length = np.diff(np.concatenate((self.first, [len(order)])))
        self.shingle, self.pos, self.n = (x[self.first] for x in (shingle, pos, n))

    def candidates(self, shingles: np.ndarray, at: np.ndarray, n: int, percent: int) -> np.ndarray:
        """Owners of entries in these lists that sizes and positions allow to link with a set of ``n``."""
        low, high = (np.searchsorted(self.shingle, shingles, side) for side in ("left", "right"))
        blocks = _expand(low, high - low)
        here = np.repeat(at, high - low)
        other, pos = self.n[blocks], self.pos[blocks]
        bound = np.minimum(here, pos) + np.minimum(n - here, other - pos)
        alive = ((100 + percent) * bound >= percent * (n + other)) & (
            100 * np.minimum(n, other) >= percent * np.maximum(n, other)
        )
        blocks = blocks[alive]
        return np.unique(self.owner[_expand(self.first[blocks], self.length[blocks])])


def block_links(
    n: np.ndarray, component: np.ndarray, asks: np.ndarray, held: np.ndarray, spots: tuple, sets: tuple, percent: int
) -> list[tuple[int, int]]:
    """Links between different components of one block, enough to connect all that link (places of sets).

    ``spots`` and ``sets`` are flat: offsets, then values (shingles and positions; shingles). Sets ask in order
    of component and size, so that each follows one that is most likely similar to it.
    """
    n = n.astype(np.int64)
    spot_offsets, spot_shingles, spot_pos = spots
    offsets, values = sets
    owner = np.repeat(np.arange(len(n)), np.diff(spot_offsets))
    inside = held[owner]
    lists = Lists(spot_shingles[inside], spot_pos[inside], owner[inside], n[owner[inside]])
    distinct, codes = np.unique(values, return_inverse=True)
    mine = np.zeros(len(distinct), bool)
    top = np.unique(component, return_inverse=True)[1]
    links: list[tuple[int, int]] = []
    similar: tuple[int, np.ndarray, np.ndarray] | None = None
    for x in np.flatnonzero(asks)[np.lexsort((n[asks], component[asks]))].tolist():
        entries = slice(spot_offsets[x], spot_offsets[x + 1])
        there = lists.candidates(spot_shingles[entries], spot_pos[entries], int(n[x]), percent)
        there = there[top[there] != top[x]]
        if not len(there):
            continue
        own = codes[offsets[x] : offsets[x + 1]]
        mine[own] = True
        if similar is not None:
            # |x & y| <= |z & y| + |x - z|: the answers of z leave out what cannot link with x
            z, overlaps, known = similar
            apart = len(own) - int(mine[codes[offsets[z] : offsets[z + 1]]].sum())
            enough = (100 + percent) * (overlaps[there] + apart) >= percent * (n[x] + n[there])
            there = there[~known[there] | enough]
        if len(there):
            lengths = offsets[there + 1] - offsets[there]
            shared = np.add.reduceat(
                mine[codes[_expand(offsets[there], lengths)]], np.concatenate(([0], np.cumsum(lengths)[:-1])), dtype=np.int64
            )
            overlaps, known = np.zeros(len(n), np.int64), np.zeros(len(n), bool)
            overlaps[there], known[there] = shared, True
            similar = (x, overlaps, known)
            linked = there[100 * shared >= percent * (n[x] + n[there] - shared)]
            for y in linked[np.unique(top[linked], return_index=True)[1]].tolist():
                links.append((x, y))
                top[top == top[y]] = top[x]
        mine[own] = False
    return links


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    column = column.combine_chunks()
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], column.flatten()


def _block_linker(percent: int) -> Callable:
    def link(table: pa.Table) -> pa.Table:
        offsets, values = _flat(table["shingles"])
        spot_offsets, spots = _flat(table["spots"])
        spots = (spot_offsets, spots.field(0).to_numpy(), spots.field(1).to_numpy().astype(np.int64))
        n, component, asks, held = (
            table[name].to_numpy() for name in ("n", "component", "asks", "held")
        )
        found = block_links(n, component, asks, held, spots, (offsets, values.to_numpy()), percent)
        sig = table["sig"].to_numpy()
        a, b = ([int(sig[pair[side]]) for pair in found] for side in (0, 1))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return link


def rest_links(sets: DataFrame, blocks: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between different components, from blocks of lists."""
    rows = blocks.join(sets.select("sig", "shingles"), "sig")
    return rows.groupBy("lead", "block").applyInArrow(_block_linker(percent), "a bigint, b bigint").distinct()


def near_duplicates(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = WIDTH, percent: int = PERCENT
) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id of all that it reaches by links), and
    ``class`` and ``component`` (signatures; NULL for an empty set).

    Ids are whole numbers; rows of one id are rows of their own, and a component whose ids are all NULL
    has a NULL id. Empty and NULL texts have an empty set and link with nothing.
    """
    steps = joined(docs, text_col, id_col, width, percent)
    return _named(steps.found, steps.labels)


class Joined(NamedTuple):
    """Stored steps of the join: documents, sets that may link, their index lists, components of linked sets."""

    found: DataFrame
    sets: DataFrame
    lists: DataFrame
    labels: DataFrame


def joined(docs: DataFrame, text_col: str, id_col: str, width: int, percent: int) -> Joined:
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("text_key", text_key(F.col("text")))
    found = stored(documents_and_hot(rows, width), "jaccard-documents")
    sets = stored(records(rows, found, width, percent), "jaccard-sets")
    lists = stored(index_lists(sets), "jaccard-lists")
    first = stored(leader_links(sets, lists, percent), "jaccard-links")
    labels = components(first)
    members = stored(open_members(lists, labels), "jaccard-members")
    rest = stored(rest_links(sets, open_blocks(members, percent), percent), "jaccard-links")
    if not rest.isEmpty():
        labels = components(first.unionAll(rest))
    return Joined(found, sets, lists, labels)


def _named(found: DataFrame, labels: DataFrame) -> DataFrame:
    members = found.filter("n >= 0").select("doc_id", "text_key", "sig", "n")
    classes = members.filter("n > 0").groupBy("sig", "n").agg(F.min("doc_id").alias("least"))
    node = labels.select(F.col("node").alias("sig"), "component")
    classes = classes.join(node, "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = classes.join(least, "component").select("sig", "n", "component", "component_id")
    named = members.join(classes, ["sig", "n"], "left")
    filled = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return named.select(
        "doc_id",
        "text_key",
        F.col("n").cast("long").alias("n_shingles"),
        filled.alias("component_id"),
        F.when(F.col("n") > 0, F.col("sig")).alias("class"),
        "component",
    )


def first_of_each(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest id (of several texts under it, one).

    Empty sets link with nothing, so each row of an empty text stays, but for repeated rows.
    """
    named = near_duplicates(docs, text_col, id_col, **options)
    ours = named.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    full = ours.filter("component is not null").groupBy("component", "doc_id").agg(F.min("text_key").alias("text_key"))
    keep = full.select("doc_id", "text_key").unionAll(
        ours.filter("component is null").select("doc_id", "text_key").distinct()
    )
    keep = keep.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_kept"))
    keyed = docs.withColumn("_key", text_key(F.col(text_col)))
    same = keyed[id_col].eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_kept"))
    return keyed.join(keep, same, "left_semi").dropDuplicates([id_col, "_key"]).drop("_key")
