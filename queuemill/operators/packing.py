"""Greedy packing of whole requests into batches.

Per queue key and in arrival order, requests join the open batch until it holds more than 0.8 of the
batch size, or until a request arrives ``max_wait_us`` after the batch's first one; the next request
then opens a new batch. A batch may overshoot, and a large request makes a batch of its own.

Where a batch ends depends only on where it began, so any number of tasks can pack one key. Rows are cut
into segments of the order (key, time, id). Keys inside a segment are packed there. A run of rows that touches a
segment's border is summarised for every request at its head that could open a batch (at most 0.8 of the
batch size + 1 of them); these summaries, two per segment at most whatever the keys look like, are folded in
order, and each segment is then packed from its now known starting state. The result is the same, row by row,
as that of one scan per key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from queuemill.operators.ordering import ordered_segments
from queuemill.session import cut_lineage, shuffle_partitions

# Fixed value: a batch takes no more requests once it holds more than 4/5 of its size.
FULL_SHARE = (4, 5)

NO_WAIT_LIMIT = 1 << 60


@dataclass(frozen=True)
class PackRule:
    """When a batch closes, and which columns say so."""

    batch_size: int
    max_wait_us: int | None = None
    key: str = "queue_key"
    time: str = "received_us"
    request_id: str = "request_id"
    size: str = "n_inputs"

    @property
    def full_above(self) -> int:
        parts, whole = FULL_SHARE
        return self.batch_size * parts // whole

    @property
    def wait(self) -> int:
        return NO_WAIT_LIMIT if self.max_wait_us is None else self.max_wait_us

    @property
    def order(self) -> list[str]:
        return [self.key, self.time, self.request_id]


def key_runs(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Row numbers at which a new key value begins, with the row count at the end."""
    if len(column) == 0:
        return np.zeros(1, dtype=np.int64)
    ends = pc.run_end_encode(_one_chunk(column), run_end_type=pa.int64()).run_ends
    return np.concatenate([[0], ends.to_numpy(zero_copy_only=False)])


def _one_chunk(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _ints(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return _one_chunk(column).to_numpy(zero_copy_only=False).astype(np.int64)


def next_starts(
    sizes: np.ndarray, times: np.ndarray, rule: PackRule, bounds: np.ndarray | None = None
) -> np.ndarray:
    """For every row: the row that opens the next batch if this row opens one.

    ``bounds`` are the row numbers at which a new key begins, with the row count at the end.
    """
    rows = len(sizes)
    bounds = np.asarray([0, rows]) if bounds is None else bounds
    run_ends = np.repeat(bounds[1:], np.diff(bounds))
    filled = np.cumsum(sizes)
    before = filled - sizes
    by_size = np.searchsorted(filled, before + rule.full_above, side="right") + 1
    by_time = np.maximum(_first_late(times, bounds, rule.wait), np.arange(1, rows + 1))
    return np.minimum(np.minimum(by_size, by_time), run_ends)


def _first_late(times: np.ndarray, bounds: np.ndarray, wait: int) -> np.ndarray:
    """Per row: the first row of its key that arrived ``wait`` or more after it."""
    runs = len(bounds) - 1
    since = times - np.repeat(times[bounds[:-1]], np.diff(bounds))
    span = int(since.max()) + 1
    if runs * span < 1 << 62:  # one search over all keys: each key gets its own range of numbers
        shelf = np.repeat(np.arange(runs, dtype=np.int64) * span, np.diff(bounds))
        return np.searchsorted(shelf + since, shelf + np.minimum(since + wait, span), side="left")
    parts = [
        lo + np.searchsorted(times[lo:hi], times[lo:hi] + wait, side="left")
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist())
    ]
    return np.concatenate(parts)


def first_break(
    sizes: np.ndarray, times: np.ndarray, length: int, opened: int, rule: PackRule
) -> int:
    """Row that closes a batch which came in with ``length`` inputs and opened at ``opened``."""
    if length > rule.full_above:
        return 0
    by_size = int(np.searchsorted(np.cumsum(sizes), rule.full_above - length, side="right")) + 1
    by_time = int(np.searchsorted(times, opened + rule.wait, side="left"))
    return min(by_size, by_time, len(sizes))


@dataclass
class OpenBatch:
    """The batch that is still taking requests at some point of one key's order."""

    number: int
    length: int
    opened: int


def number_batches(
    sizes: np.ndarray,
    times: np.ndarray,
    bounds: np.ndarray,
    state: OpenBatch | None,
    rule: PackRule,
) -> tuple[np.ndarray, np.ndarray, OpenBatch]:
    """Batch numbers and offsets of consecutive rows; ``state`` is the first key's open batch.

    The search for batch ends is vectorised over all keys; only the walk from one batch to the next
    is a loop.
    """
    rows = len(sizes)
    numbers = np.zeros(rows, dtype=np.int64)
    before = np.cumsum(sizes) - sizes
    base = np.zeros(rows, dtype=np.int64)
    begin = 0
    if state is not None:
        first_end = int(bounds[1])
        begin = first_break(
            sizes[:first_end], times[:first_end], state.length, state.opened, rule
        )
        numbers[:begin] = state.number
        base[:begin] = -state.length
    if begin == rows:
        closing = OpenBatch(state.number, state.length + int(sizes.sum()), state.opened)
        return numbers, before - base, closing
    rest = np.concatenate([[begin], bounds[bounds > begin]])
    following = next_starts(sizes[begin:], times[begin:], rule, rest - begin).tolist()
    starts = []
    at = 0
    while at < rows - begin:
        starts.append(begin + at)
        at = following[at]
    opens = np.zeros(rows - begin, dtype=np.int64)
    opens[np.asarray(starts) - begin] = 1
    counted = np.cumsum(opens) - 1
    at_run = np.repeat(counted[rest[:-1] - begin], np.diff(rest))
    numbers[begin:] = counted - at_run
    if state is not None and begin < int(bounds[1]):
        numbers[begin : int(bounds[1])] += state.number + 1
    base[begin:] = np.repeat(before[starts], np.diff(np.asarray([*starts, rows])))
    last = starts[-1]
    closing = OpenBatch(int(numbers[-1]), int(sizes[last:].sum()), int(times[last]))
    return numbers, before - base, closing


def _append_batches(table: pa.Table, numbers: np.ndarray, offsets: np.ndarray) -> pa.Table:
    return table.append_column("batch_id", pa.array(numbers, pa.int64())).append_column(
        "batch_offset", pa.array(offsets, pa.int64())
    )


def check_rows(table: pa.Table, rule: PackRule) -> None:
    if table[rule.time].null_count:
        raise ValueError(f"packing needs a value in {rule.time!r} of every request")
    check_sizes(_ints(table[rule.size]))


def check_sizes(sizes: np.ndarray) -> None:
    if len(sizes) and sizes.min() < 1:
        raise ValueError("packing needs at least one input per request; answer empty ones first")


def _packed_schema(df: DataFrame) -> T.StructType:
    return T.StructType(
        [*df.schema.fields, T.StructField("batch_id", T.LongType()),
         T.StructField("batch_offset", T.LongType())]
    )


def sorted_by_queue(df: DataFrame, rule: PackRule, tasks: int | None = None) -> DataFrame:
    """Queues in order; with ``tasks`` given, adaptive execution leaves the partitions alone."""
    spread = df.repartition(tasks, rule.key) if tasks else df.repartition(rule.key)
    return spread.sortWithinPartitions(*rule.order)


# --- segments -------------------------------------------------------------------------------------


def _summary_schema(key_type: T.DataType) -> T.StructType:
    longs = T.ArrayType(T.LongType())
    return T.StructType(
        [
            T.StructField("_key", key_type),
            T.StructField("_segment", T.IntegerType()),
            T.StructField("_run", T.IntegerType()),
            T.StructField("head_sizes", longs),
            T.StructField("head_times", longs),
            T.StructField("exit_length", longs),
            T.StructField("exit_opened", longs),
            T.StructField("opened_batches", longs),
            T.StructField("total", T.LongType()),
        ]
    )


def summarise_run(sizes: np.ndarray, times: np.ndarray, rule: PackRule) -> dict:
    """How a stretch of one key's order leaves the open batch, for every way of entering it.

    The batch that is open on entry must close within ``head``: the rows until the sizes exceed the
    limit. For each row there as the first start, follow the chain of starts to the end; chains
    that meet share their rest.
    """
    rows = len(sizes)
    filled = np.cumsum(sizes)
    head = min(int(np.searchsorted(filled, rule.full_above, side="right")) + 1, rows)
    following = next_starts(sizes, times, rule).tolist()
    exits: dict[int, tuple[int, int]] = {}  # start -> (last start, batches opened from here on)
    for entry in range(min(head, rows - 1) + 1):
        path = []
        at = entry
        while at < rows and at not in exits:
            path.append(at)
            at = following[at]
        last, opened = exits[at] if at < rows else (path[-1], 0)
        for start in reversed(path):
            opened += 1
            exits[start] = (last, opened)
    entries = [exits[entry] for entry in range(min(head, rows - 1) + 1)]
    total = int(filled[-1])
    return {
        "head_sizes": sizes[:head].tolist(),
        "head_times": times[: min(head + 1, rows)].tolist(),
        "exit_length": [total - int(filled[last] - sizes[last]) for last, _ in entries],
        "exit_opened": [int(times[last]) for last, _ in entries],
        "opened_batches": [opened for _, opened in entries],
        "total": total,
    }


def _summarise_segments(
    batches: Iterator[pa.RecordBatch], rule: PackRule, schema: pa.Schema
) -> Iterator[pa.RecordBatch]:
    """The first and the last run of a segment, which may be one; what lies between needs no summary."""
    first: list[pa.Table] = []
    last: list[pa.Table] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([batch])
        check_rows(table, rule)
        runs = key_runs(table[rule.key]).tolist()
        for lo, hi in [(runs[0], runs[1]), *([(runs[-2], runs[-1])] if len(runs) > 2 else [])]:
            part = table.slice(lo, hi - lo)
            if not last and (not first or _same_key(first, part, rule)):
                first.append(part)
            elif last and _same_key(last, part, rule):
                last.append(part)
            else:
                last = [part]
    for number, parts in enumerate((first, last)):
        if parts:
            table = pa.concat_tables(parts)
            summary = summarise_run(_ints(table[rule.size]), _ints(table[rule.time]), rule)
            place = {"_segment": table["segment"][0].as_py(), "_run": number}
            row = {"_key": table[rule.key][0].as_py(), **place, **summary}
            yield pa.RecordBatch.from_pylist([row], schema=schema)


def _same_key(parts: list[pa.Table], part: pa.Table, rule: PackRule) -> bool:
    return parts[-1][rule.key][-1].as_py() == part[rule.key][0].as_py()


def _chain_summaries(
    batches: Iterator[pa.RecordBatch], rule: PackRule, schema: pa.Schema
) -> Iterator[pa.RecordBatch]:
    """Walk the summaries in segment order; emit the open batch that each segment's first run begins with."""
    key, state, fresh = None, None, True
    for batch in batches:
        entries = []
        for at in range(batch.num_rows):  # one by one: a summary holds lists
            row = batch.slice(at, 1).to_pylist()[0]
            if fresh or row["_key"] != key:
                key, state, fresh = row["_key"], None, False
            if state is not None and row["_run"] == 0:
                entries.append(
                    {
                        "_key": key,
                        "_segment": row["_segment"],
                        "_number": state.number,
                        "_length": state.length,
                        "_opened": state.opened,
                    }
                )
            entry = 0
            if state is not None:
                entry = _entry_row(row, state, rule)
            if entry < len(row["exit_length"]):
                number = (-1 if state is None else state.number) + row["opened_batches"][entry]
                state = OpenBatch(number, row["exit_length"][entry], row["exit_opened"][entry])
            else:
                state = OpenBatch(state.number, state.length + row["total"], state.opened)
        yield pa.RecordBatch.from_pylist(entries, schema=schema)


def _entry_row(row: dict, state: OpenBatch, rule: PackRule) -> int:
    times = np.asarray(row["head_times"], dtype=np.int64)
    sizes = np.asarray(row["head_sizes"], dtype=np.int64)
    if state.length > rule.full_above:
        return 0
    by_size = int(np.searchsorted(np.cumsum(sizes), rule.full_above - state.length, "right")) + 1
    by_time = int(np.searchsorted(times, state.opened + rule.wait, "left"))
    return min(by_size, by_time)


def _pack_segments(batches: Iterator[pa.RecordBatch], rule: PackRule) -> Iterator[pa.RecordBatch]:
    extra = ["segment", "segment_row", "_number", "_length", "_opened"]
    key, state = None, None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([batch])
        sizes, times = _ints(table[rule.size]), _ints(table[rule.time])
        first = table.slice(0, 1).to_pylist()[0]
        if state is None or first[rule.key] != key:
            state = None if first["_number"] is None else OpenBatch(
                first["_number"], first["_length"], first["_opened"]
            )
        # only the first key of a segment can enter with an open batch
        numbers, offsets, state = number_batches(
            sizes, times, key_runs(table[rule.key]), state, rule
        )
        key = table[rule.key][-1].as_py()
        yield from _append_batches(table.drop_columns(extra), numbers, offsets).to_batches()


def pack_ordered(ordered: DataFrame, rule: PackRule) -> DataFrame:
    """Pack rows that :func:`ordered_segments` put in order; rows may have been filtered out since."""
    columns = [name for name in ordered.columns if name not in ("segment", "segment_row")]
    key_type = ordered.schema[rule.key].dataType
    summary_schema = _summary_schema(key_type)
    entry_schema = T.StructType(
        [
            T.StructField("_key", key_type),
            T.StructField("_segment", T.IntegerType()),
            T.StructField("_number", T.LongType()),
            T.StructField("_length", T.LongType()),
            T.StructField("_opened", T.LongType()),
        ]
    )
    summaries = ordered.select(rule.key, "segment", rule.size, rule.time).mapInArrow(
        partial(_summarise_segments, rule=rule, schema=_arrow_schema(summary_schema)),
        summary_schema,
    )
    entries = cut_lineage(
        summaries.repartition(1)  # two rows per segment at most
        .sortWithinPartitions("_segment", "_run")
        .mapInArrow(
            partial(_chain_summaries, rule=rule, schema=_arrow_schema(entry_schema)), entry_schema
        )
    )
    begun = ordered.join(
        F.broadcast(entries),  # one row per segment at most
        ordered[rule.key].eqNullSafe(entries["_key"])
        & (ordered["segment"] == entries["_segment"]),
        "left",
    ).drop("_key", "_segment")
    return begun.mapInArrow(
        partial(_pack_segments, rule=rule), _packed_schema(ordered.select(*columns))
    )


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    return to_arrow_schema(schema)


def pack_batches(
    df: DataFrame,
    batch_size: int,
    max_wait_us: int | None = None,
    key: str = "queue_key",
    tasks: int | None = None,
    **columns: str,
) -> DataFrame:
    """Add ``batch_id`` (0-based per key) and ``batch_offset`` (inputs before this request).

    Rows are sorted once into ``tasks`` segments (the session's shuffle partitions by default) and stored in that order.
    Select only the columns you need: all of them travel. Equal ids are fine, an arrival time is needed.
    """
    rule = PackRule(batch_size, max_wait_us, key, **columns)
    segments = tasks or shuffle_partitions(df.sparkSession)
    return pack_ordered(ordered_segments(df, rule.order, segments), rule)


def slice_batches(df: DataFrame, items: str, batch_size: int, name: str = "item") -> DataFrame:
    """Cut each row's list into slices of ``batch_size`` (the last one short): one row per slice."""
    last = F.greatest(F.ceil(F.size(items) / batch_size).cast("int") - 1, F.lit(-1))
    slices = F.when(
        last >= 0,
        F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
            lambda i: F.slice(F.col(items), i * batch_size + 1, F.lit(batch_size)),
        ),
    )
    others = [c for c in df.columns if c != items]
    return df.select(*others, F.posexplode(slices).alias("chunk_id", name))


def batch_log(packed: DataFrame, rule: PackRule, started: str, ended: str, success: str) -> DataFrame:
    """One row per batch: requests, inputs, when it ran and whether all of it went well."""
    return packed.groupBy(rule.key, "batch_id").agg(
        F.count(F.lit(1)).alias("n_requests"),
        F.sum(rule.size).alias("predicted_in_batch_of"),
        F.min(started).alias("started_us"),
        F.max(ended).alias("ended_us"),
        F.bool_and(F.coalesce(F.col(success), F.lit(False))).alias("batch_success"),
    )
