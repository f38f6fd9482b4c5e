"""Life of a request from its events, as a stream and in batch.

An event row is ``request_id, event_time, kind, stage, success``; ``kind`` is ``received``, ``claimed``,
``finished`` or ``delivered``. Events of one request may come in any order: the newest one wins, and at the
same instant the one that is further along.

``closed_lifecycles`` and ``timeout_stream`` are session windows: the fold runs in the JVM, and the
watermark plays the part of the timers. ``lifecycle_stream`` instead reports every change as it comes,
which takes state of its own and a Python call per request; use it where the volume allows that.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from queuemill.operators.lifecycle import CLIENT_TIMEOUT_SECONDS, RETENTION_SECONDS

STATE_SCHEMA = (
    "last_stage int, success boolean, received_us bigint, delivered_us bigint, "
    "timed_out boolean, version_us bigint, n_events bigint"
)
COLUMNS = ["request_id", *(part.split()[0] for part in STATE_SCHEMA.split(","))]
EMPTY_STATE = (None, None, None, None, None, None, 0)


def step(
    key: tuple,
    frames: Iterator[pd.DataFrame],
    state: GroupState,
    timeout_ms: int | None,
    last_stage: int,
    keep_ms: int,
) -> Iterator[pd.DataFrame]:
    """Advance one request: by its new events, or because its timer expired.

    One timer is enough. Until the answer is delivered it stands for the waiting time, afterwards
    (and after a time-out) for the retention, at whose end the state goes away.
    """
    if state.hasTimedOut:
        row = list(state.get)
        stage, delivered, timed_out = row[0], row[3], row[4]
        if delivered is not None or timed_out or stage == last_stage:
            state.remove()
            return
        row[4] = True
        state.update(tuple(row))
        _set_timer(state, state.getCurrentWatermarkMs() + keep_ms)
        yield pd.DataFrame([[key[0], *row]], columns=COLUMNS, dtype=object)
        return
    row = list(state.get) if state.exists else list(EMPTY_STATE)
    for frame in frames:
        row = _fold(row, frame)
    state.update(tuple(row))
    received, delivered = row[2], row[3]
    if delivered is not None:
        _set_timer(state, delivered // 1000 + keep_ms)
    elif timeout_ms is not None and received is not None and row[0] != last_stage:
        _set_timer(state, received // 1000 + timeout_ms)
    yield pd.DataFrame([[key[0], *row]], columns=COLUMNS, dtype=object)


def _set_timer(state: GroupState, at_ms: int) -> None:
    state.setTimeoutTimestamp(max(at_ms, state.getCurrentWatermarkMs() + 1))


def _fold(state: list, frame: pd.DataFrame) -> list:
    """Apply the events of one Arrow batch to a request's state, newest last."""
    last_stage, success, received, delivered, timed_out, version, n_events = state
    for kind, at, stage, good in zip(
        *(frame[name].tolist() for name in ("kind", "at_us", "stage", "success"))
    ):
        at = int(at)
        n_events += 1
        if kind == "received":
            received = at
        elif kind == "delivered":
            delivered = at
        further = at == version and (
            stage > last_stage or stage == last_stage and kind == "finished"
        )
        if kind != "delivered" and (version is None or at > version or further):
            version, last_stage = at, int(stage)
            success = None if good is None or pd.isna(good) else bool(good)
    return [last_stage, success, received, delivered, timed_out, version, n_events]


def _events(stream: DataFrame, delay: str) -> DataFrame:
    return stream.withWatermark("event_time", delay).select(
        "request_id", "event_time", "kind", F.unix_micros("event_time").alias("at_us"),
        F.col("stage").cast("int").alias("stage"), "success",
    )


def lifecycle_stream(
    stream: DataFrame,
    last_stage: int = 0,
    timeout_seconds: float | None = None,
    keep_seconds: float = RETENTION_SECONDS,
    delay: str = "10 minutes",
) -> DataFrame:
    """The current row of every request that changed, as events come in and timers expire."""
    id_type = stream.schema["request_id"].dataType.simpleString()
    advance = partial(
        step,
        timeout_ms=None if timeout_seconds is None else int(timeout_seconds * 1000),
        last_stage=last_stage,
        keep_ms=int(keep_seconds * 1000),
    )
    return (
        _events(stream, delay)
        .groupBy("request_id")
        .applyInPandasWithState(
            advance, f"request_id {id_type}, {STATE_SCHEMA}", STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout
        )
    )


def closed_lifecycles(
    stream: DataFrame, longest_wait_seconds: int, silence_seconds: int = RETENTION_SECONDS,
    delay: str = "10 minutes",
) -> DataFrame:
    """One row per request once its life is over.

    An event of an open request keeps it open for ``longest_wait_seconds``, the longest time that may pass between
    two of its events; a delivery, for ``silence_seconds``. So a life that waits for hours comes out in one row.
    """
    gap = F.when(F.col("kind") == "delivered", f"{silence_seconds} seconds").otherwise(
        f"{longest_wait_seconds} seconds"
    )
    sessions = F.session_window("event_time", gap)
    return (
        stream.withWatermark("event_time", delay)
        .groupBy("request_id", sessions.alias("_session"))
        .agg(*_fold_columns())
        .drop("_session")
    )


def timeout_stream(
    stream: DataFrame, timeout_seconds: int, last_stage: int = 0, delay: str = "10 minutes"
) -> DataFrame:
    """The requests whose waiting time ran out before the last stage took them, when it did.

    A ``received`` event keeps its request's session open for the waiting time, other events only
    extend it by themselves: so the session of a waiting request ends exactly when its time is up.
    """
    gap = F.when(F.col("kind") == "received", f"{timeout_seconds} seconds").otherwise(
        "1 millisecond"
    )
    waited = (
        F.col("received_us").isNotNull()
        & F.col("delivered_us").isNull()
        & (F.col("last_stage") != last_stage)
    )
    return (
        stream.withWatermark("event_time", delay)
        .groupBy("request_id", F.session_window("event_time", gap).alias("_session"))
        .agg(*_fold_columns())
        .filter(waited)
        .drop("_session")
        .withColumn("timed_out", F.lit(True))
    )


def client_timeout_stream(
    stream: DataFrame, timeout: str | None = None,
    default_seconds: int = CLIENT_TIMEOUT_SECONDS, delay: str = "10 minutes",
) -> DataFrame:
    """The requests whose client has gone: no answer was delivered within the request's own ``timeout``
    (a column of seconds on ``received`` events), or the default where it has none."""
    own = F.lit(None) if timeout is None else F.col(timeout)
    seconds = F.coalesce(own.cast("bigint"), F.lit(default_seconds))
    gap = F.when(
        F.col("kind") == "received", F.concat(seconds.cast("string"), F.lit(" seconds"))
    ).otherwise("1 millisecond")
    given = F.max(F.when(F.col("kind") == "received", seconds)).alias("timeout_seconds")
    late = F.col("delivered_us") - F.col("received_us") > F.col("timeout_seconds") * 1_000_000
    return (
        stream.withWatermark("event_time", delay)
        .groupBy("request_id", F.session_window("event_time", gap).alias("_session"))
        .agg(*_fold_columns(), given)
        .filter(F.col("received_us").isNotNull() & (F.col("delivered_us").isNull() | late))
        .drop("_session")
    )


def newest_rows(changes: DataFrame) -> DataFrame:
    """The last emitted row per request from a table of changes."""
    columns = [name for name in changes.columns if name != "request_id"]
    newest = F.max_by(
        F.struct(*columns), F.struct("n_events", F.coalesce("timed_out", F.lit(False)))
    )
    return changes.groupBy("request_id").agg(newest.alias("_row")).select("request_id", "_row.*")


def _fold_columns() -> list[Column]:
    at = F.unix_micros("event_time")
    moves = F.when(
        F.col("kind") != "delivered", F.struct(at, "stage", F.col("kind") == "finished")
    )
    return [
        F.max_by(F.col("stage").cast("int"), moves).alias("last_stage"),
        F.max_by("success", moves).alias("success"),
        F.max(F.when(F.col("kind") == "received", at)).alias("received_us"),
        F.max(F.when(F.col("kind") == "delivered", at)).alias("delivered_us"),
        F.max(F.when(F.col("kind") != "delivered", at)).alias("version_us"),
        F.count(F.lit(1)).alias("n_events"),
    ]


def fold_lifecycle(events: DataFrame) -> DataFrame:
    """The same fold over a finished table of events, combined before the shuffle."""
    return events.groupBy("request_id").agg(*_fold_columns())
