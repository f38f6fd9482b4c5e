"""Batches that wait for more input across triggers.

The unfinished batch of every queue is state. It takes further requests in the order (arrival time, id) until it is full
(more than 0.8 of the batch size) or ``max_wait_us`` have gone by since its first request, whichever trigger that happens
in. Two clocks:

* ``event`` (the default): requests are put in order once the watermark has passed them, and a batch that waits is closed
  by an event-time timer as soon as no request can come any more that would still join it. Batches and their numbers are
  those of :func:`queuemill.operators.packing.pack_batches`, however the requests are split into files and triggers.
  Only requests move the watermark: a batch that is not full stays open until later ones (of any queue) come.
* ``processing``: requests join in the order of their triggers, and a batch is closed by the wall clock. Use it for live
  traffic that may pause; which requests share a batch then depends on when they come in.

A queue's batches are formed one after another, in one task per trigger; its state is its open batch and what the
watermark has not passed yet, read and written with that of other queues (:mod:`queuemill.streaming.grouped`). Queues that are too much for that are dealt over ``lanes``, each packed by itself.
Requests without inputs never wait: they come out at once, without a batch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial
from itertools import groupby
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import Row

from queuemill.operators.inference import Stage, _answered, _begun, _chain_schema, _expression_stage, _numbered, _run_chain
from queuemill.operators.packing import PackRule
from queuemill.streaming.grouped import GROUPS, transform_groups
from queuemill.streaming.lives import timer_ms
from queuemill.streaming.runner import use_rocksdb

OPEN = "number bigint, length bigint, opened_us bigint, timer_ms bigint"
FIRST = (0, 0, None, None)
CLOCKS = {"event": "EventTime", "processing": "ProcessingTime"}


@dataclass(frozen=True)
class Layout:
    """Where a packer finds what in a row."""

    schema: T.StructType
    time: int
    request_id: int
    size: int

    def order(self, row: tuple) -> tuple:
        """NULL ids come first, as in Spark's order."""
        return row[self.time], row[self.request_id] is not None, row[self.request_id]


class QueuePacker(StatefulProcessor):
    """Packs one queue (or lane of it); gives out whole batches."""

    def __init__(self, rule: PackRule, layout: Layout, names: list[str], clock: str, lanes: int = 1):
        self.rule, self.layout, self.names, self.clock, self.lanes = rule, layout, names, clock, lanes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.arrived = handle.getListState("arrived", self.layout.schema)  # not yet in order
        self.joined = handle.getListState("joined", self.layout.schema)  # the open batch
        self.open = handle.getValueState("open", OPEN)

    def close(self) -> None:
        pass

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        new = []
        for row in rows:
            if (row[self.layout.size] or 0) > 0 and row[self.layout.time] is not None:
                new.append(tuple(row))
            else:
                yield self._out(tuple(row), None, None)
        if not new:
            return
        if self.clock == "processing":
            now_us = timerValues.getCurrentProcessingTimeInMs() * 1000
            yield from self._join(key, sorted(new, key=self.layout.order), now_us, None)
            return
        self.arrived.appendList(new)
        self._wake(min(timer_ms(row[self.layout.time]) for row in new))

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        number, length, opened, _ = self.open.get() or FIRST
        self.open.update((number, length, opened, None))
        if self.clock == "processing":
            yield from self._join(key, [], timerValues.getCurrentProcessingTimeInMs() * 1000, None)
            return
        mark_us = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = list(self.arrived.get())
        ready = sorted((row for row in waiting if row[self.layout.time] <= mark_us), key=self.layout.order)
        rest = [row for row in waiting if row[self.layout.time] > mark_us]
        if ready and rest:
            self.arrived.put(rest)
        elif ready:
            self.arrived.clear()
        yield from self._join(key, ready, None, mark_us)
        if rest:
            self._wake(min(timer_ms(row[self.layout.time]) for row in rest))

    def _join(
        self, key: tuple, rows: Sequence[tuple], now_us: int | None, mark_us: int | None
    ) -> Iterator[Row]:
        """Let ``rows`` join in their order, and close what is full or has waited long enough."""
        number, length, opened, timer = self.open.get() or FIRST
        held = list(self.joined.get()) if opened is not None else []
        had = len(held)
        closed = False
        for row in rows:
            at = row[self.layout.time] if now_us is None else now_us
            if held and at - opened >= self.rule.wait:
                yield from self._batch(held, number * self.lanes + key[1])
                held, number, length, closed = [], number + 1, 0, True
            if not held:
                opened = at
            held.append(row)
            length += row[self.layout.size]
            if length > self.rule.full_above:
                yield from self._batch(held, number * self.lanes + key[1])
                held, number, length, opened, closed = [], number + 1, 0, None, True
        # nobody who comes after the mark can join a batch whose time is up by then
        end_us = mark_us + 1 if now_us is None else now_us
        if held and end_us - opened >= self.rule.wait:
            yield from self._batch(held, number * self.lanes + key[1])
            held, number, length, opened, closed = [], number + 1, 0, None, True
        if closed:
            self.joined.put(held) if held else self.joined.clear()
        elif len(held) > had:
            self.joined.appendList(held[had:])
        self.open.update((number, length, opened if held else None, timer))
        if held and self.rule.max_wait_us is not None:
            end = opened + self.rule.wait
            self._wake(timer_ms(end - 1) if now_us is None else -(-end // 1000))

    def _batch(self, rows: list[tuple], number: int) -> Iterator[Row]:
        before = 0
        for row in rows:
            yield self._out(row, number, before)
            before += row[self.layout.size]

    def _out(self, row: tuple, number: int | None, offset: int | None) -> Row:
        return Row(**dict(zip(self.names, (*row, number, offset))))

    def _wake(self, at_ms: int) -> None:
        """One timer, the earliest that is needed; when it fires the next one is found."""
        number, length, opened, timer = self.open.get() or FIRST
        if timer is not None and timer <= at_ms:
            return
        if timer is not None:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at_ms)
        self.open.update((number, length, opened, at_ms))


def pack_stream(
    stream: DataFrame,
    batch_size: int,
    max_wait_us: int | None = None,
    key: str = "queue_key",
    delay: str = "10 minutes",
    clock: str = "event",
    lanes: int = 1,
    groups: int = GROUPS,
    **columns: str,
) -> DataFrame:
    """The requests of every batch that is closed, together and in order, with ``batch_id`` (0-based per queue) and
    ``batch_offset``; ``columns`` name time, request_id and size as in :func:`~queuemill.operators.packing.pack_batches`.
    With several ``lanes`` the n-th batch of a lane has the number ``n * lanes + lane``.

    Times are epoch microseconds. Requests without a time, without inputs or with a size of NULL get no batch. A NULL queue
    is a queue. ``delay`` is how late a request may come (clock ``event``). The state of all queues is kept in ``groups`` groups.
    """
    use_rocksdb(stream.sparkSession)
    rule = PackRule(batch_size, max_wait_us, key, **columns)
    names, schema = stream.columns, stream.schema
    stream = stream.withColumn("_lane", F.pmod(F.xxhash64(rule.request_id), F.lit(lanes)).cast("int"))
    layout = Layout(schema, *(names.index(name) for name in (rule.time, rule.request_id, rule.size)))
    out = T.StructType(
        [*schema.fields, T.StructField("batch_id", T.LongType()), T.StructField("batch_offset", T.LongType())]
    )
    if clock == "event":
        stream = stream.withColumn("_at", F.timestamp_micros(rule.time)).withWatermark("_at", delay)
    processor = QueuePacker(rule, layout, [*names, "batch_id", "batch_offset"], clock, lanes)
    return transform_groups(stream, [key, "_lane"], _Cut(processor, len(names)), out, CLOCKS[clock], groups)


class _Cut(StatefulProcessor):
    """Hands a packer the columns it knows, without the watermark's."""

    def __init__(self, packer: QueuePacker, columns: int):
        self.packer, self.columns = packer, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.packer.init(handle)

    def close(self) -> None:
        self.packer.close()

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        return self.packer.handleInputRows(key, (tuple(row)[: self.columns] for row in rows), timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        return self.packer.handleExpiredTimer(key, timerValues, expiredTimerInfo)


def score_waiting_stream(
    stream: DataFrame,
    stages: Sequence[Stage],
    max_wait_us: int | None = None,
    key: str = "queue_key",
    time_column: str = "received_us",
    request_id: str = "request_id",
    delay: str = "10 minutes",
    clock: str = "event",
    lanes: int = 1,
    groups: int = GROUPS,
) -> DataFrame:
    """:func:`~queuemill.operators.inference.chain` on a stream whose first stage's batches wait across triggers.

    The batches of the first Python stage are formed by :func:`pack_stream`, so with the clock ``event`` a stage that raises
    fails the same requests as in batch. Python stages after it see each of these batches again, without the requests
    that failed; they are called once per batch and take no further requests in. Expression stages may stand anywhere.
    """
    work = _begun(stream, F.col(time_column).isNotNull())
    rule = PackRule(1, max_wait_us, key, time_column, request_id)
    packed_by: int | None = None
    for python, group in groupby(_numbered(stages), lambda item: item[1].expression is None):
        members = list(group)
        if not python:
            for number, stage in members:
                work = _expression_stage(work, number, stage)
            continue
        if packed_by is None:
            packed_by, stage = members[0]
            sized = work.withColumn("_size", F.when(F.col("success"), F.size("_work")))
            work = pack_stream(
                sized, stage.batch_size, max_wait_us, key, delay, clock, lanes, groups,
                time=time_column, request_id=request_id, size="_size",
            ).drop("_size", "batch_offset")
        else:
            work = work.withColumn("batch_id", F.col(f"stage{packed_by}_batch_id"))
        schema = _chain_schema(work, members)
        work = work.mapInArrow(
            partial(_run_chain, stages=members, rule=rule, schema=to_arrow_schema(schema), packed=True), schema
        )
    return _answered(work)
