"""Files that hold one JSON array each, read by as many tasks as their size asks for.

Spark's own text source cuts the files, on any store: with the comma as line separator, records are what lies between
commas, and a split may begin anywhere. Three steps, all in one lazy plan:

1. Every split is scanned once (``_summaries``). Whether it begins inside a string, and how deep, is not known there, so
   it says for both cases what the split does: whether it changes between inside and outside, how much deeper it ends,
   and how many commas lie at which depth.
2. Per file the summaries, one row a split, are folded from left to right: now the state at the start of each split is
   known, and the number of elements before it (``_fold``).
3. Every split is read with that state (``_elements``): commas at depth one, outside strings, are the borders. Elements
   between two borders of a split come out where they are read; the ends of a split, two at most, are put together with
   those of its neighbours.

The states travel by broadcast: one row of some hundred bytes per split, about a millionth of the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUOTE, BACKSLASH, COMMA = b'"'[0], b"\\"[0], b","[0]
BLANKS = np.frombuffer(b" \t\r\n", np.uint8)

SUMMARY = (
    "split bigint, path string, begin bigint, flips boolean, first int, "
    "deeper_outside bigint, deeper_inside bigint, commas_outside map<bigint,bigint>, commas_inside map<bigint,bigint>"
)
STATE = "split bigint, path string, begin bigint, inside boolean, depth bigint, pos bigint, last_pos bigint"
ELEMENT = "split bigint, begin bigint, pos bigint, last_pos bigint, text string"

_MAP = pa.map_(pa.int64(), pa.int64())
_SUMMARY_ARROW = pa.schema(
    [
        ("split", pa.int64()), ("path", pa.string()), ("begin", pa.int64()), ("flips", pa.bool_()), ("first", pa.int32()),
        ("deeper_outside", pa.int64()), ("deeper_inside", pa.int64()), ("commas_outside", _MAP), ("commas_inside", _MAP),
    ]
)
_STATE_ARROW = pa.schema(
    [
        ("split", pa.int64()), ("path", pa.string()), ("begin", pa.int64()), ("inside", pa.bool_()), ("depth", pa.int64()),
        ("pos", pa.int64()), ("last_pos", pa.int64()),
    ]
)
_ELEMENT_ARROW = pa.schema(
    [("split", pa.int64()), ("begin", pa.int64()), ("pos", pa.int64()), ("last_pos", pa.int64()), ("text", pa.string())]
)


def structure(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per byte: whether an odd number of quotes came so far, and the step in depth it would be outside a string.

    ``data`` begins behind a comma, so no escape reaches into it.
    """
    quotes = data == QUOTE
    escapes = data == BACKSLASH
    if escapes.any():
        at = np.arange(len(data))
        plain = np.maximum.accumulate(np.where(escapes, -1, at))  # the last byte that is no backslash
        run = np.zeros(len(data), np.int64)
        run[1:] = at[1:] - 1 - plain[:-1]
        quotes &= run % 2 == 0
    odd = (np.cumsum(quotes) & 1).astype(bool)
    step = (np.isin(data, (91, 123))).astype(np.int8) - np.isin(data, (93, 125)).astype(np.int8)
    return odd, step


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, bytes]]:
    """Consecutive rows of one split, and their bytes with the commas between and behind them."""
    split = batch.column("split").to_numpy()
    edges = [0, *(np.flatnonzero(np.diff(split)) + 1).tolist(), len(split)]
    for lo, hi in zip(edges, edges[1:]):
        if hi > lo:
            rows = batch.slice(lo, hi - lo)
            content = (",".join(rows.column("value").to_pylist()) + ",").encode()
            yield rows, np.frombuffer(content, np.uint8), content


class _Summary:
    def __init__(self, row: dict):
        self.row = row
        self.flips = False
        self.first: int | None = None
        self.deeper = [0, 0]
        self.commas: list[dict[int, int]] = [{}, {}]

    def add(self, data: np.ndarray) -> None:
        odd, step = structure(data)
        if self.first is None:
            solid = np.flatnonzero(~np.isin(data, BLANKS))
            self.first = int(data[solid[0]]) if len(solid) else None
        comma = data == COMMA
        for case, outside in enumerate((odd == self.flips, odd != self.flips)):
            depth = self.deeper[case] + np.cumsum(np.where(outside, step, 0))
            at, counts = np.unique(depth[comma & outside], return_counts=True)
            for d, n in zip(at.tolist(), counts.tolist()):
                self.commas[case][d] = self.commas[case].get(d, 0) + n
            self.deeper[case] = int(depth[-1])
        self.flips ^= bool(odd[-1])

    def batch(self) -> pa.RecordBatch:
        values = [
            self.row["split"], self.row["path"], self.row["begin"], self.flips, self.first, *self.deeper,
            *(list(c.items()) for c in self.commas),
        ]
        arrays = [pa.array([v], f.type) for v, f in zip(values, _SUMMARY_ARROW)]
        return pa.RecordBatch.from_arrays(arrays, schema=_SUMMARY_ARROW)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    summary: _Summary | None = None
    for batch in batches:
        for rows, data, _ in _runs(batch):
            if summary is None or summary.row["split"] != rows.column("split")[0].as_py():
                if summary is not None:
                    yield summary.batch()
                summary = _Summary(rows.slice(0, 1).drop_columns(["value"]).to_pylist()[0])
            summary.add(data)
    if summary is not None:
        yield summary.batch()


def _fold(splits: pa.Table) -> pa.Table:
    """States of one file's splits. Files that do not begin like an array have none; a broken array is an error."""
    rows = sorted(splits.to_pylist(), key=lambda row: row["begin"])
    first = next((row["first"] for row in rows if row["first"] is not None), None)
    if first != b"["[0]:
        return _STATE_ARROW.empty_table()
    inside, depth, pos, states = False, 0, 0, []
    for row in rows:
        states.append({**{k: row[k] for k in ("split", "path", "begin")}, "inside": inside, "depth": depth, "pos": pos})
        case = "inside" if inside else "outside"
        pos += dict(row[f"commas_{case}"]).get(1 - depth, 0)
        depth += row[f"deeper_{case}"]
        inside ^= row["flips"]
    if inside or depth:
        raise ValueError(f"{rows[0]['path']} does not hold a whole JSON array")
    return pa.Table.from_pylist([{**state, "last_pos": pos} for state in states], schema=_STATE_ARROW)


class _Reader:
    """Reads one split from its known state on."""

    def __init__(self, row: dict, ends: bool):
        self.row, self.ends = row, ends
        self.inside, self.depth, self.pos = row["inside"], row["depth"], row["pos"]
        self.pending: list[bytes] = []
        self.begun = False
        self.found: list[tuple[int, str]] = []

    def add(self, data: np.ndarray, content: bytes) -> None:
        odd, step = structure(data)
        outside = odd == self.inside
        depth = self.depth + np.cumsum(np.where(outside, step, 0))
        at = 0
        for border in np.flatnonzero((data == COMMA) & outside & (depth == 1)).tolist():
            if self.ends != self.begun:  # the first piece of a split is an end, all others are whole
                text = b"".join([*self.pending, content[at:border]])
                self.found.append((self.pos, text.decode()))
            self.begun, self.pending = True, []
            self.pos += 1
            at = border + 1
        self.pending.append(content[at:])
        self.inside ^= bool(odd[-1])
        self.depth = int(depth[-1])

    def batch(self, last: bool) -> pa.RecordBatch:
        if last and self.ends:
            self.found.append((self.pos, b"".join(self.pending).decode()))
        n = len(self.found)
        columns = [
            *([self.row[c]] * n for c in ("split", "begin")), [p for p, _ in self.found], [self.row["last_pos"]] * n,
            [t for _, t in self.found],
        ]
        self.found = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ELEMENT_ARROW)], schema=_ELEMENT_ARROW)


def _elements(batches: Iterator[pa.RecordBatch], ends: bool) -> Iterator[pa.RecordBatch]:
    """Whole elements of the splits, or instead what lies before their first and behind their last border."""
    reader: _Reader | None = None
    for batch in batches:
        for rows, data, content in _runs(batch):
            if reader is None or reader.row["split"] != rows.column("split")[0].as_py():
                if reader is not None:
                    yield reader.batch(last=True)
                reader = _Reader(rows.slice(0, 1).drop_columns(["value"]).to_pylist()[0], ends)
            reader.add(data, content)
        if reader is not None and reader.found:
            yield reader.batch(last=False)
    if reader is not None:
        yield reader.batch(last=True)


def read_array_elements(spark: SparkSession, path: str) -> DataFrame:
    """``path, pos, text``: the JSON text of every element of the arrays in the files at ``path``."""
    start = F.col("_metadata.file_block_start")
    pieces = spark.read.text(path, lineSep=",").select(
        F.xxhash64("_metadata.file_path", start).alias("split"),
        F.col("_metadata.file_path").alias("path"),
        start.alias("begin"),
        "value",
    )
    states = pieces.mapInArrow(_summaries, SUMMARY).groupBy("path").applyInArrow(_fold, STATE)
    own = F.broadcast(states.drop("path"))
    known = pieces.select("split", "value").join(own, "split")
    whole = known.mapInArrow(partial(_elements, ends=False), ELEMENT).select("split", "pos", "text")
    named = whole.join(F.broadcast(states.select("split", "path")), "split").select("path", "pos", "text")
    ends = known.mapInArrow(partial(_elements, ends=True), ELEMENT).join(
        F.broadcast(states.select("split", "path")), "split"
    )
    parts = F.array_sort(F.collect_list(F.struct("begin", "part", "text")))
    met = (
        ends.withColumn("part", F.monotonically_increasing_id())  # an end of a split comes before its other end
        .groupBy("path", "pos", "last_pos")
        .agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"))
    )
    opened = F.when(F.col("pos") == 0, F.regexp_replace("text", r"^\s*\[", "")).otherwise(F.col("text"))
    closed = F.when(F.col("pos") == F.col("last_pos"), F.regexp_replace(opened, r"\]\s*,$", "")).otherwise(opened)
    empty = (F.col("last_pos") == 0) & F.col("text").rlike(r"^\s*$")
    return named.unionByName(met.withColumn("text", closed).filter(~empty).select("path", "pos", "text"))
