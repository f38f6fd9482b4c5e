"""Lives of requests on keyed state: every change, and three event-time timers per request.

Events are those of :mod:`queuemill.streaming.lifecycle` and may come in any order and in any number of triggers, as long
as the watermark has not passed them. A request is *closed* by whichever comes first in event time:

* its answer is delivered;
* the queue time-out: it has waited for ``queue_timeout_seconds`` and the last stage has not taken it;
* the client time-out: no answer within its own ``timeout`` (seconds on its ``received`` event) or the default.

A moment on the deadline is in time; of several ``received`` events the first one counts. ``keep_seconds`` after it was closed its state is dropped; what happened later than
that begins a life of its own. All rules look at event times alone, never at the order of arrival: a claim that comes
before the timer but happened after the deadline does not save the request, one that happened in time does, even if it
comes in late. So the last row of every request does not depend on how events are split into files and triggers.

State is a typed value per request, its events as a list and its open deadlines as a map, in RocksDB, where requests share
groups (:mod:`queuemill.streaming.grouped`). Time to live is not used: Spark offers it for processing time only, and here the
retention timer does its work by event time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import Row

from queuemill.operators.lifecycle import CLIENT_TIMEOUT_SECONDS, RETENTION_SECONDS
from queuemill.streaming.grouped import GROUPS, transform_groups
from queuemill.streaming.runner import use_rocksdb

LIFE = "seq bigint, timed_out boolean, reason string, closed_us bigint"
MOVES = "at_us bigint, stage int, kind string, success boolean, timeout_us bigint"
CHANGE = (
    "change string, at_us bigint, last_stage int, success boolean, received_us bigint, delivered_us bigint, "
    "timed_out boolean, reason string, n_events bigint, seq bigint"
)
NEW = (0, None, None, None)
# The reasons that clients are given.
REASONS = {"queue": "timeout", "client": "client_timeout"}


class Move(NamedTuple):
    """One event of a request."""

    at_us: int
    stage: int | None
    kind: str
    success: bool | None
    timeout_us: int | None


class Rules(NamedTuple):
    last_stage: int
    queue_timeout_us: int | None
    client_timeout_us: int
    keep_us: int


def timer_ms(at_us: int) -> int:
    """The timer that fires as soon as the watermark has reached ``at_us``: Spark fires those below the watermark."""
    return -(-at_us // 1000) - 1


class Standing(NamedTuple):
    """What the events known so far say about a request."""

    received_us: int | None
    delivered_us: int | None
    last_stage: int | None
    success: bool | None
    deadlines: dict[str, int]
    closing: tuple[int, str] | None
    n_events: int


def standing(moves: Iterable[Move], rules: Rules) -> Standing:
    """Fold events, and find the deadlines that are not met and the moment that closes the request."""
    moves = list(moves)
    received = [m for m in moves if m.kind == "received"]
    delivered_us = min((m.at_us for m in moves if m.kind == "delivered"), default=None)
    begun_us = min((m.at_us for m in received), default=None)
    taken_us = min((m.at_us for m in moves if m.stage == rules.last_stage and m.kind != "delivered"), default=None)
    steps = [m for m in moves if m.kind != "delivered"]
    newest = max(steps, key=lambda m: (m.at_us, -1 if m.stage is None else m.stage, m.kind == "finished"), default=None)
    deadlines = {}
    if begun_us is not None:
        own = [m.timeout_us for m in received if m.timeout_us is not None and m.at_us == begun_us]
        limits = {"queue": rules.queue_timeout_us, "client": max(own, default=rules.client_timeout_us)}
        met = {"queue": (taken_us, delivered_us), "client": (delivered_us,)}
        for name, limit in limits.items():
            if limit is not None and not any(m is not None and m <= begun_us + limit for m in met[name]):
                deadlines[name] = begun_us + limit
    ends = [(at, order, name) for order, name in enumerate(("queue", "client"), 1) if (at := deadlines.get(name)) is not None]
    if delivered_us is not None:
        ends.append((delivered_us, 0, "delivered"))
    first = min(ends, default=None)
    return Standing(
        max((m.at_us for m in received), default=None),
        max((m.at_us for m in moves if m.kind == "delivered"), default=None),
        newest and newest.stage,
        newest and newest.success,
        deadlines,
        first and (first[0], first[2]),
        len(moves),
    )


class RequestLife(StatefulProcessor):
    """Keeps one request's events until its retention is over; every batch of events and every timer gives a row."""

    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", LIFE)
        self.moves = handle.getListState("moves", MOVES)
        self.timers = handle.getMapState("timers", "timer string", "at_us bigint")

    def close(self) -> None:
        pass

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        new = [Move(r.at_us, r.stage, r.kind, r.success, r.timeout_us) for r in rows]
        known = [Move(*m) for m in self.moves.get()]
        self.moves.appendList([tuple(m) for m in new])
        yield self._row(key, "updated", max(m.at_us for m in new), known + new)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        """Everything that is due by the watermark, in order of its time; timers that fire later then find nothing."""
        limit = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        while True:
            held = [(at, name) for (name,), (at,) in self.timers.iterator() if timer_ms(at) <= limit]
            if not held:
                return
            at, name = min(held)
            self.timers.removeKey((name,))
            moves = [Move(*m) for m in self.moves.get()]
            if name == "retention":
                yield from self._purge(key, at, moves)
                continue
            seq, timed_out, _, _ = self.life.get() or NEW
            if standing(moves, self.rules).closing == (at, name) and not timed_out:
                self.life.update((seq, True, REASONS[name], at))
                yield self._row(key, f"{name}_timeout", at, moves)

    def _standing(self, moves: list[Move]) -> Standing:
        """Of the events of this life: those up to the end of its retention."""
        found = standing(moves, self.rules)
        if found.closing is None:
            return found
        within = [m for m in moves if m.at_us <= found.closing[0] + self.rules.keep_us]
        return found if len(within) == len(moves) else standing(within, self.rules)

    def _row(self, key: tuple, change: str, at: int, moves: list[Move]) -> Row:
        found = self._standing(moves)
        seq, timed_out, reason, closed = self.life.get() or NEW
        self.life.update((seq + 1, timed_out, reason, closed))
        wanted = dict(found.deadlines)
        if found.closing is not None:
            wanted = {name: at_us for name, at_us in wanted.items() if not timed_out and at_us <= found.closing[0]}
            wanted["retention"] = found.closing[0] + self.rules.keep_us
        self._set(wanted)
        return _change(key, change, at, found, timed_out, reason, seq)

    def _purge(self, key: tuple, at: int, moves: list[Move]) -> Iterator[Row]:
        """Drop the life; events after its retention are the first ones of another."""
        found = self._standing(moves)
        seq, timed_out, reason, _ = self.life.get() or NEW
        self._set({})
        yield _change(key, "purged", at, found, timed_out, reason, seq)
        rest = [m for m in moves if m.at_us > at]
        if not rest:
            self.life.clear()
            self.moves.clear()
            return
        self.life.update((seq + 1, None, None, None))
        self.moves.put([tuple(m) for m in rest])
        yield self._row(key, "updated", max(m.at_us for m in rest), rest)

    def _set(self, wanted: dict[str, int]) -> None:
        """Register and delete timers until the open deadlines are the wanted ones. Deadlines may share a timer."""
        held = {name: at for (name,), (at,) in self.timers.iterator()}
        if held == wanted:
            return
        for at in {timer_ms(at) for at in held.values()} - {timer_ms(at) for at in wanted.values()}:
            self.handle.deleteTimer(at)
        for at in {timer_ms(at) for at in wanted.values()} - {timer_ms(at) for at in held.values()}:
            self.handle.registerTimer(at)
        for name in held.keys() - wanted.keys():
            self.timers.removeKey((name,))
        for name, at in wanted.items():
            if held.get(name) != at:
                self.timers.updateValue((name,), (at,))


def _change(key: tuple, change: str, at: int, found: Standing, timed_out, reason, seq: int) -> Row:
    return Row(
        request_id=key[0], change=change, at_us=at, last_stage=found.last_stage, success=found.success,
        received_us=found.received_us, delivered_us=found.delivered_us, timed_out=timed_out, reason=reason,
        n_events=found.n_events, seq=seq,
    )


def _micros(seconds: float | None) -> int | None:
    return None if seconds is None else round(seconds * 1_000_000)


def request_changes(
    events: DataFrame,
    last_stage: int = 0,
    queue_timeout_seconds: float | None = None,
    client_timeout_seconds: float = CLIENT_TIMEOUT_SECONDS,
    keep_seconds: float = RETENTION_SECONDS,
    delay: str = "10 minutes",
    timeout: str | None = None,
    groups: int = GROUPS,
) -> DataFrame:
    """A row per request and trigger that brings events of it (``change`` is ``updated``) and per timer that fires
    (``queue_timeout``, ``client_timeout``, ``purged``), numbered by ``seq`` within a request.

    ``timeout`` names a column of seconds on ``received`` events. Rows with a NULL id or time are ignored. The state of all
    requests is kept in ``groups`` groups.
    """
    use_rocksdb(events.sparkSession)
    rules = Rules(
        last_stage, _micros(queue_timeout_seconds), _micros(client_timeout_seconds), _micros(keep_seconds)
    )
    own = F.lit(None) if timeout is None else F.col(timeout)
    moves = events.withWatermark("event_time", delay).select(
        "request_id",
        "event_time",
        F.unix_micros("event_time").alias("at_us"),
        F.col("stage").cast("int").alias("stage"),
        "kind",
        "success",
        (own.cast("double") * 1_000_000).cast("bigint").alias("timeout_us"),
    )
    id_type = events.schema["request_id"].dataType.simpleString()
    out = T.StructType.fromDDL(f"request_id {id_type}, {CHANGE}")
    known = moves.filter("request_id is not null and event_time is not null")
    return transform_groups(known, ["request_id"], RequestLife(rules), out, "EventTime", groups)


def last_changes(changes: DataFrame) -> DataFrame:
    """The newest row of every request, from a table of changes."""
    columns = [name for name in changes.columns if name != "request_id"]
    newest = F.max_by(F.struct(*columns), "seq").alias("_row")
    return changes.groupBy("request_id").agg(newest).select("request_id", "_row.*")


def open_lives(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What a stream of changes keeps at its last checkpoint: ``request_id, at_us, stage, kind, success`` of every event of
    a request whose retention is not over. Read from the state store, without running the stream."""
    pages = spark.read.format("statestore").option("stateVarName", "moves").load(checkpoint)
    names = [field.name for field in pages.schema["list_element"].dataType]
    moves = pages.select(F.inline(F.arrays_zip(*(F.col(f"list_element.{name}") for name in names))))
    return moves.withColumnRenamed("key_request_id", "request_id")
