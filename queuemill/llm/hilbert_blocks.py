"""Hard negatives by maximum inner product in score windows, over Hilbert-ordered blocks with zone maps.

1. Vectors of whole numbers (``whole_vectors``) get a place on a Hilbert curve over the ``CURVE_DIMS`` components that vary
   most, are sorted by it over all tasks and written in blocks of ``BLOCK`` rows: one Parquet row group each. Beside the
   blocks lies their zone map: least and greatest value of every component (``write_blocks``).
2. Anchors are read in chunks, one at a time in a task. Interval arithmetic bounds the inner product of an anchor with
   any row of a block: each factor takes the end of its component's range that its sign asks for (``bounds``).
3. A chunk visits blocks by falling upper bound. For its positives an anchor needs a block only if the upper bound reaches
   its worst positive so far; for the negatives of a positive only if the block's interval meets the window and reaches
   the worst negative so far (``_positives``, ``_negatives``). Blocks that no anchor of the chunk needs are not read.

Answers are exact: bounds only leave out blocks that cannot hold an answer. How many these are depends on the data; in
high dimensions without structure the boxes overlap and nearly all blocks are read, a chunk at a time, in bounded memory
(one block, ``CHUNK`` anchors and their best rows). Zone maps are read in slices, so they may be of any size.

Rows with a NULL label or vector, or with a NULL or non-finite component, take no part. Shorter vectors count as filled
up with zeros; an empty vector scores 0 with all. A NULL id is no anchor and comes last among equal scores. Rows with the
anchor's own id are not its positives; several rows of one id are anchors and candidates each. Scores are exact also
beyond 53 bits (then by Python's integers); what does not fit 64 bits is returned as the nearest number that does. Empty tables
give no rows. Columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queuemill.llm.storage import place, write_file
from queuemill.session import scratch_path, stored

SCALE = 256
BLOCK = 2048
BLOCKS_PER_FILE = 64
CHUNK = 2048
CURVE_DIMS = 12
CURVE_BITS = 5
POSITIVES = 5
NEGATIVES = 10
#: A negative's score lies between these hundredths of the positive's, both ends included.
WINDOW = (30, 90)
EXACT = 2.0**53
NO_ID = np.iinfo(np.int64).max
ZONES_AT_ONCE = 16_384


def whole_vectors(
    embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """``vec_id, label, vector``: the rows that take part, labels disturbed where 7 divides the id, components scaled."""
    label, vector = F.col(label_col), F.col(vector_col).cast("array<double>")
    whole = embeddings.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.when(F.col(id_col) % 7 == 0, (label + 1) % 10).otherwise(label).cast("long").alias("label"),
        vector.alias("vector"),
    )
    sound = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    scaled = F.transform("vector", lambda x: F.floor(x * float(SCALE)).cast("double"))
    return whole.filter(F.col("label").isNotNull() & F.col("vector").isNotNull() & F.coalesce(sound, F.lit(False))).select(
        "vec_id", "label", scaled.alias("vector")
    )


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of rows of ``cells`` (each below ``2 ** bits``): Skilling's transposed Gray code."""
    x = cells.T.astype(np.int64).copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        below = q - 1
        for i in range(dims):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & below)
            x[0] ^= np.where(flip, below, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros(cells.shape[0], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    index = np.zeros(cells.shape[0], np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            index = (index << 1) | ((x[i] >> bit) & 1)
    return index


def _dense(vectors: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column as a matrix, short ones filled up with zeros."""
    lengths = vectors.value_lengths().to_numpy()
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    if (lengths == dims).all():
        return flat.reshape(len(lengths), dims)
    full = np.zeros((len(lengths), dims))
    rows = np.repeat(np.arange(len(lengths)), lengths)
    full[rows, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return full


def _component_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["at", "n", "total", "squares", "low", "high"]
    for batch in batches:
        vectors = batch.column(0)
        dims = int(np.max(vectors.value_lengths().to_numpy(), initial=0))
        rows = _dense(vectors, dims)
        if rows.size:
            columns = [np.arange(dims), np.full(dims, len(rows)), rows.sum(0), (rows**2).sum(0), rows.min(0), rows.max(0)]
            yield pa.record_batch([pa.array(c) for c in columns], names)


def curve_axes(vectors: DataFrame) -> tuple[int, list[tuple[int, float, float]]]:
    """Number of components, and ``place, least, greatest`` of those that vary most. One row per component is collected."""
    partial = vectors.select("vector").mapInArrow(
        _component_sums, "at long, n long, total double, squares double, low double, high double"
    )
    sums = {name: F.sum(name).alias(name) for name in ("n", "total", "squares")}
    found = partial.groupBy("at").agg(*sums.values(), F.min("low").alias("low"), F.max("high").alias("high")).collect()
    spread = {r["at"]: r["squares"] / r["n"] - (r["total"] / r["n"]) ** 2 for r in found}
    widest = sorted(found, key=lambda r: (-spread[r["at"]], r["at"]))[:CURVE_DIMS]
    return max(spread, default=-1) + 1, [(r["at"], r["low"], r["high"]) for r in widest]


def _placer(dims: int, axes: list[tuple[int, float, float]]):
    at = np.array([a[0] for a in axes], np.int64)
    low, high = np.array([a[1] for a in axes]), np.array([a[2] for a in axes])
    width = np.where(high > low, high - low, 1.0)
    top = (1 << CURVE_BITS) - 1

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _dense(batch.column("vector"), dims)[:, at]
            cells = np.clip((rows - low) / width * (top + 1), 0, top).astype(np.int64)
            index = hilbert_index(cells, CURVE_BITS) if len(axes) else np.zeros(len(rows), np.int64)
            yield batch.append_column("curve", pa.array(index))

    return put


def _blocks_writer(folder: str, dims: int, block: int):
    """Each task writes its rows, in the curve's order, as files of row groups, and returns their zone maps."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= block * BLOCKS_PER_FILE:
                rows = pa.Table.from_batches(held)
                yield _write(folder, dims, block, rows.slice(0, block * BLOCKS_PER_FILE))
                held = rows.slice(block * BLOCKS_PER_FILE).to_batches()
        if sum(map(len, held)):
            yield _write(folder, dims, block, pa.Table.from_batches(held))

    return write


def _write(folder: str, dims: int, block: int, rows: pa.Table) -> pa.RecordBatch:
    rows = rows.combine_chunks()
    matrix = _dense(rows.column("vector").chunk(0), dims)
    sink = pa.BufferOutputStream()
    flat = pa.table({"vec_id": rows.column("vec_id"), "label": rows.column("label"), "vector": rows.column("vector")})
    pq.write_table(flat, sink, row_group_size=block, compression="zstd", use_dictionary=["label", "vector"])
    content = sink.getvalue().to_pybytes()
    ids = np.sort(rows.column("_row").to_numpy())
    name = f"{ids[0]:020d}-{ids[-1]:020d}.parquet"  # the same rows give the same name when a task runs again
    write_file(folder, name, content)
    begins = range(0, len(matrix), block)
    lows = [matrix[b : b + block].min(0) for b in begins]
    highs = [matrix[b : b + block].max(0) for b in begins]
    columns = {"file": [name] * len(lows), "block": list(range(len(lows))), "low": lows, "high": highs}
    return pa.RecordBatch.from_pydict(columns, schema=_ZONES_ARROW)


ZONES = "file string, block int, low array<double>, high array<double>"
_ZONES_ARROW = pa.schema(
    [("file", pa.string()), ("block", pa.int32()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))]
)


def write_blocks(vectors: DataFrame, block: int = BLOCK) -> tuple[str, str, int]:
    """Store ``vec_id, label, vector`` in Hilbert order (``_row`` tells equal rows apart); returns the folder of blocks,
    that of zone maps, and the number of components."""
    spark = vectors.sparkSession
    dims, axes = curve_axes(vectors)
    schema = "vec_id long, label long, vector array<double>, _row long, curve long"
    placed = vectors.select("vec_id", "label", "vector", "_row").mapInArrow(_placer(dims, axes), schema)
    ordered = placed.repartitionByRange("curve", "vec_id", "_row").sortWithinPartitions("curve", "vec_id", "_row")
    blocks, zones = scratch_path(spark, "mining-blocks"), scratch_path(spark, "mining-zones")
    ordered.mapInArrow(_blocks_writer(blocks, dims, block), ZONES).write.option("maxRecordsPerFile", ZONES_AT_ONCE).parquet(zones)
    return blocks, zones, dims


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each anchor with any vector between ``low`` and ``high`` of each block."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return up @ low.T + down @ high.T, up @ high.T + down @ low.T


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: as doubles where no sum can leave their exact range, else as integers."""
    if (np.abs(anchors).max(0, initial=0) * np.abs(rows).max(0, initial=0)).sum() < EXACT:
        return anchors @ rows.T
    whole = lambda m: np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape)
    return whole(anchors) @ whole(rows).T


class Blocks:
    """Zone maps and blocks as a task sees them; of the blocks only one at a time."""

    def __init__(self, blocks: str, zones: str, dims: int):
        self.fs, self.root = place(blocks)
        self.zone_fs, self.zone_root = place(zones)
        self.dims = dims
        self.file: tuple[str, pq.ParquetFile] | None = None

    def zones(self) -> Iterator[tuple[list[tuple[str, int]], np.ndarray, np.ndarray]]:
        """Names, least and greatest components of blocks, in slices."""
        import pyarrow.fs as pafs

        found = self.zone_fs.get_file_info(pafs.FileSelector(self.zone_root, recursive=False))
        for info in sorted(found, key=lambda i: i.path):
            if not info.path.endswith(".parquet"):
                continue
            for batch in pq.ParquetFile(self.zone_fs.open_input_file(info.path)).iter_batches(ZONES_AT_ONCE):
                names = list(zip(batch.column("file").to_pylist(), batch.column("block").to_pylist()))
                if names:
                    yield names, _dense(batch.column("low"), self.dims), _dense(batch.column("high"), self.dims)

    def read(self, file: str, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.file is None or self.file[0] != file:
            self.file = file, pq.ParquetFile(self.fs.open_input_file(f"{self.root}/{file}"))
        rows = self.file[1].read_row_group(block).combine_chunks()
        ids = rows.column("vec_id").fill_null(NO_ID).to_numpy()
        return ids, rows.column("label").to_numpy(), _dense(rows.column("vector").chunk(0), self.dims)


class Best:
    """The first ``k`` candidates of each slot: higher scores first, ties by smaller id."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.score = np.full((slots, k), -np.inf, dtype=object)
        self.id = np.full((slots, k), NO_ID, np.int64)
        self.bar = np.full(slots, -np.inf)  # the k-th score, as a double that is not above it

    def offer(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        for s in np.unique(slot):
            mine = slot == s
            new = list(zip(score[mine].tolist(), ids[mine].tolist()))
            old = [(a, b) for a, b in zip(self.score[s], self.id[s]) if a != -np.inf]
            first = sorted(old + new, key=lambda c: (-c[0], c[1]))[: self.k]
            for i, (a, b) in enumerate(first):
                self.score[s, i], self.id[s, i] = int(a), b
            if len(first) == self.k:
                self.bar[s] = np.nextafter(float(first[-1][0]), -np.inf) if abs(first[-1][0]) >= EXACT else first[-1][0]

    def found(self, slot: int) -> list[tuple[int, int]]:
        return [(int(a), int(b)) for a, b in zip(self.score[slot], self.id[slot]) if a != -np.inf]


def _visit(blocks: Blocks, anchors: np.ndarray, needs, take) -> int:
    """Read the blocks that ``needs(low, high)`` (anchor x block) still asks for, by falling upper bound, and hand their
    rows to ``take``; returns how many were read."""
    n_read = 0
    slack = 1 + 2.0**-40  # bounds are sums in doubles
    for names, low, high in blocks.zones():
        least, most = bounds(anchors, low, high)
        room = (np.abs(least) + np.abs(most)) * (slack - 1) + 1e-6
        least, most = least - room, most + room
        for b in np.argsort(-most.max(0), kind="stable"):
            asks = needs(least[:, b], most[:, b])
            if asks.any():
                n_read += 1
                take(np.flatnonzero(asks), *blocks.read(*names[b]))
    return n_read


def _positives(blocks: Blocks, ids: np.ndarray, labels: np.ndarray, anchors: np.ndarray) -> tuple[Best, int]:
    best = Best(len(ids), POSITIVES)

    def take(asks, row_ids, row_labels, rows):
        found = scores(anchors[asks], rows)
        able = (labels[asks, None] == row_labels) & (ids[asks, None] != row_ids) & (found >= best.bar[asks, None])
        able = _leading(found, able, POSITIVES)
        x, y = np.nonzero(able)
        best.offer(asks[x], found[x, y], row_ids[y])

    return best, _visit(blocks, anchors, lambda least, most: most >= best.bar, take)


def _leading(found: np.ndarray, able: np.ndarray, k: int) -> np.ndarray:
    """Of what is ``able``, per row all that reach the k-th largest score (so that ties are settled later)."""
    if found.dtype == object or found.shape[1] <= k:
        return able
    ranked = np.where(able, found, -np.inf)
    return able & (found >= np.partition(ranked, -k, axis=1)[:, [-k]])


def _negatives(
    blocks: Blocks, owner: np.ndarray, labels: np.ndarray, anchors: np.ndarray, positive: list[int]
) -> tuple[Best, int]:
    """Slot ``i``: anchor ``owner[i]`` with the positive's score ``positive[i]``."""
    begin = np.array([-(-WINDOW[0] * p // 100) for p in positive], dtype=object)
    end = np.array([WINDOW[1] * p // 100 for p in positive], dtype=object)
    best = Best(len(owner), NEGATIVES)
    floor, ceiling = begin.astype(float), end.astype(float)  # for bounds only; these have slack
    open_ = np.array([b <= e for b, e in zip(begin, end)], bool)

    def slots(least, most):
        return open_ & (most[owner] >= np.maximum(floor, best.bar)) & (least[owner] <= ceiling)

    def needs(least, most):
        nonlocal wanted
        wanted = np.flatnonzero(slots(least, most))
        return np.bincount(owner[wanted], minlength=len(anchors)) > 0

    def take(asks, row_ids, row_labels, rows):
        found = scores(anchors[asks], rows)
        line = np.full(len(anchors), -1)
        line[asks] = np.arange(len(asks))
        other = labels[asks, None] != row_labels
        low, high = (begin, end) if found.dtype == object else (floor, ceiling)
        for place_ in np.unique(order[wanted]):  # one slot an anchor at a time
            now = wanted[order[wanted] == place_]
            at = line[owner[now]]
            own, least = found[at], np.maximum(low[now], best.bar[now])
            able = other[at] & (own >= least[:, None]) & (own <= high[now, None])
            x, y = np.nonzero(_leading(own, able, NEGATIVES))
            best.offer(now[x], own[x, y], row_ids[y])

    wanted = np.empty(0, np.int64)
    order = np.arange(len(owner)) - np.searchsorted(owner, owner)  # which positive of its anchor
    return best, _visit(blocks, anchors, needs, take)


MINED = (
    "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
)
_MINED_ARROW = pa.schema([(c.split()[0], pa.int32() if c.endswith(" int") else pa.int64()) for c in MINED.split(", ")])


def _miner(folder: str, zones: str, dims: int):
    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(folder, zones, dims)
        for batch in batches:
            for at in range(0, len(batch), CHUNK):
                chunk = batch.slice(at, CHUNK)
                ids, labels = chunk.column("vec_id").to_numpy(), chunk.column("label").to_numpy()
                anchors = _dense(chunk.column("vector"), dims)
                near, _ = _positives(blocks, ids, labels, anchors)
                pairs = [(i, *p) for i in range(len(ids)) for p in near.found(i)]
                if not pairs:
                    continue
                owner = np.array([p[0] for p in pairs])
                best, _ = _negatives(blocks, owner, labels, anchors, [p[1] for p in pairs])
                rows = [
                    (int(ids[i]), _id(positive), rank, _id(negative), _long(score), _long(negative_score))
                    for slot, (i, score, positive) in enumerate(pairs)
                    for rank, (negative_score, negative) in enumerate(best.found(slot), 1)
                ]
                columns = list(zip(*rows)) or [()] * len(_MINED_ARROW)
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _MINED_ARROW)], schema=_MINED_ARROW)

    return mine


def _id(found: int) -> int | None:
    return None if found == NO_ID else found


def _long(score: int) -> int:
    return max(-(1 << 63), min(score, (1 << 63) - 1))


def hard_negatives(vectors: DataFrame, is_anchor: Column, block: int = BLOCK) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for ``vec_id, label, vector``.

    The positives of an anchor are the first ``POSITIVES`` other rows of its label by inner product; the negatives of a
    positive the first ``NEGATIVES`` rows of another label whose score lies in the ``WINDOW`` of the positive's.
    """
    rows = vectors.select("vec_id", "label", "vector", F.monotonically_increasing_id().alias("_row"))
    vectors = stored(rows, "mining-input")
    folder, zones, dims = write_blocks(vectors, block)
    anchors = vectors.filter(is_anchor & F.col("vec_id").isNotNull())
    cores, n = vectors.sparkSession.sparkContext.defaultParallelism, anchors.count()
    dealt = anchors.repartition(max(min(cores, n), -(-n // CHUNK), 1), F.xxhash64("vec_id", "_row"))
    return dealt.mapInArrow(_miner(folder, zones, dims), MINED)


SQL = """
WITH sound AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vector
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, r.vec_id, r.label, list_inner_product(a.vector, r.vector)::BIGINT AS score
  FROM sound a JOIN sound r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, own, vec_id AS positive_id, score AS positive_score FROM scored WHERE label = own
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
  (row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id))::INT AS rank,
  s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND s.label <> p.own
  AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) <= 10
"""
