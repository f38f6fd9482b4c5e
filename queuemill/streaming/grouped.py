"""Keyed state of many keys under one group: the processor of a key stays as it is, its state is read and written by pages.

Every call from Python to the state store is a message to the JVM and back, and a processor makes some ten of them for each
key and trigger: with few rows per key they are nearly all of its time. :class:`Grouped` runs the same processor for all keys
that hash into a group. While the group is worked on, their values, lists, maps and timers are in memory; in the store each
state variable is a list of pages, typed columns of at most ``PAGE`` rows with their keys in front, and the group has one
timer, its earliest. So messages go by groups and pages, not by keys.

A group is read as a whole when rows of it come in or its timer fires. More ``groups`` make smaller ones: a task holds one at a
time, and a trigger that brings a few rows reads only theirs. Their number is part of a checkpoint, as the number of shuffle
partitions is.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo
from pyspark.sql.types import Row

GROUPS = 512
PAGE = 1000
GROUP = "_group"
NAN = float("nan")


def frozen(value: Any) -> Any:
    """A key for dicts that is equal where Spark's grouping is: NaN is NaN, and arrays and structs go by their values."""
    if isinstance(value, dict):
        return tuple(frozen(x) for x in value.values())
    if isinstance(value, (list, tuple)):
        return tuple(frozen(x) for x in value)
    return NAN if value != value else value


#: Keys of these types are equal in Python where they are in Spark.
PLAIN = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.StringType, T.BooleanType, T.DateType)


class Pages:
    """A list of rows for every key of the group at hand."""

    def __init__(self, group: GroupHandle, name: str, schema: T.StructType):
        self.group, self.width = group, len(group.keys)
        columns = [T.StructField(f"key_{f.name}", T.ArrayType(f.dataType)) for f in group.keys]
        columns += [T.StructField(f.name, T.ArrayType(f.dataType)) for f in schema]
        self.stored = group.handle.getListState(name, T.StructType(columns))
        self.forget()

    def forget(self) -> None:
        self.rows: dict[tuple, list[tuple]] | None = None
        self.new: list[tuple] = []  # key and rows that were appended
        self.changed = False

    def all(self) -> dict[tuple, list[tuple]]:
        if self.rows is None:
            self.rows = {}
            for page in self.stored.get():
                for row in zip(*page):
                    self.rows.setdefault(self.group.name(row[: self.width]), []).append(row[self.width :])
            for name, rows in self.new:
                self.rows.setdefault(name, []).extend(rows)
        return self.rows

    def get(self) -> list[tuple]:
        return self.all().get(self.group.key, [])

    def put(self, rows: list[tuple]) -> None:
        held, self.changed = self.all(), True
        if rows:
            held[self.group.key] = rows
        else:
            held.pop(self.group.key, None)

    def append(self, rows: list[tuple]) -> None:
        self.new.append((self.group.key, rows))
        if self.rows is not None:
            self.rows.setdefault(self.group.key, []).extend(rows)

    def store(self) -> None:
        """Write what has changed: all rows again, or those that were appended alone."""
        if self.changed:
            pages = self._pages(self.all().items())
            self.stored.put(pages) if pages else self.stored.clear()
        elif self.new:
            self.stored.appendList(self._pages(self.new))
        self.forget()

    def _pages(self, items: Iterable[tuple[tuple, list[tuple]]]) -> list[tuple]:
        names = self.group.names
        flat = [(*names[name], *row) for name, rows in items for row in rows]
        return [tuple(list(c) for c in zip(*flat[i : i + PAGE])) for i in range(0, len(flat), PAGE)]


class _List:
    def __init__(self, pages: Pages):
        self.pages = pages

    def exists(self) -> bool:
        return bool(self.pages.get())

    def get(self) -> Any:
        return iter(list(self.pages.get()))

    def put(self, rows: list) -> None:
        self.pages.put([tuple(row) for row in rows])

    def appendValue(self, row: Any) -> None:
        self.pages.append([tuple(row)])

    def appendList(self, rows: list) -> None:
        self.pages.append([tuple(row) for row in rows])

    def clear(self) -> None:
        self.pages.put([])


class _Value(_List):
    def get(self) -> tuple | None:
        rows = self.pages.get()
        return rows[0] if rows else None

    def update(self, value: Any) -> None:
        self.pages.put([tuple(value)])


class _Map(_List):
    """A map of few entries: they are looked through."""

    def __init__(self, pages: Pages, width: int):
        super().__init__(pages)
        self.width = width

    def iterator(self) -> Iterator[tuple[tuple, tuple]]:
        return iter([(row[: self.width], row[self.width :]) for row in self.pages.get()])

    def getValue(self, key: tuple) -> tuple | None:
        return next((value for known, value in self.iterator() if known == tuple(key)), None)

    def containsKey(self, key: tuple) -> bool:
        return self.getValue(key) is not None

    def updateValue(self, key: tuple, value: tuple) -> None:
        others = [row for row in self.pages.get() if row[: self.width] != tuple(key)]
        self.pages.put([*others, (*key, *value)])

    def removeKey(self, key: tuple) -> None:
        self.pages.put([row for row in self.pages.get() if row[: self.width] != tuple(key)])


class GroupHandle:
    """The handle that a processor of one key is given: its calls concern the key at hand."""

    def __init__(self, handle: StatefulProcessorHandle, keys: T.StructType, schemas: dict[str, tuple]):
        self.handle, self.keys, self.schemas = handle, keys, schemas
        self.plain = all(isinstance(f.dataType, PLAIN) for f in keys)
        self.names: dict[tuple, tuple] = {}
        self.key: tuple | None = None
        self.variables: list[Pages] = []
        self.timers = self._pages("group_timers", T.StructType([T.StructField("timer_ms", T.LongType())]))
        self.wake = handle.getValueState("group_wake", "timer_ms bigint")

    def _pages(self, name: str, *schemas: T.StructType) -> Pages:
        self.variables.append(Pages(self, name, T.StructType([f for schema in schemas for f in schema])))
        return self.variables[-1]

    def getValueState(self, name: str, *_: Any) -> _Value:
        return _Value(self._pages(name, *self.schemas[name]))

    def getListState(self, name: str, *_: Any) -> _List:
        return _List(self._pages(name, *self.schemas[name]))

    def getMapState(self, name: str, *_: Any) -> _Map:
        return _Map(self._pages(name, *self.schemas[name]), len(self.schemas[name][0]))

    def registerTimer(self, at_ms: int) -> None:
        if (at_ms,) not in self.timers.get():
            self.timers.put([*self.timers.get(), (at_ms,)])

    def deleteTimer(self, at_ms: int) -> None:
        self.timers.put([row for row in self.timers.get() if row != (at_ms,)])

    def name(self, key: tuple) -> tuple:
        name = key if self.plain else frozen(key)
        self.names.setdefault(name, key)
        return name

    def store(self, fired: bool) -> None:
        """Write the group back, and have it woken for its earliest timer."""
        if self.timers.rows is not None:
            first = min((at for rows in self.timers.rows.values() for (at,) in rows), default=None)
            (held,) = self.wake.get() or (None,)
            if held is not None and held != first and not fired:  # Spark deletes those that have fired
                self.handle.deleteTimer(held)
            if first is not None and (held != first or fired):
                self.handle.registerTimer(first)
            if held != first:
                self.wake.update((first,))
        for variable in self.variables:
            variable.store()
        self.names, self.key = {}, None


class _Declared:
    """Takes down which state a processor asks for."""

    def __init__(self):
        self.schemas: dict[str, tuple] = {}

    def _take(self, name: str, *schemas: T.StructType | str) -> None:
        parsed = [T.StructType.fromDDL(s) if isinstance(s, str) else s for s in schemas]
        self.schemas[name] = tuple(parsed)

    def getValueState(self, name: str, schema: T.StructType | str) -> None:
        self._take(name, schema)

    def getListState(self, name: str, schema: T.StructType | str) -> None:
        self._take(name, schema)

    def getMapState(self, name: str, key: T.StructType | str, value: T.StructType | str) -> None:
        self._take(name, key, value)


class Grouped(StatefulProcessor):
    """Runs ``processor`` for every key of a group; ``keys`` are the fields of a key, as they are named in the rows.

    Output rows and their number per key are those of the processor under ``groupBy(*keys)``: in a trigger each key gets its
    rows first and its timers afterwards, in order of their times. State variables have no time to live.
    """

    def __init__(self, processor: StatefulProcessor, keys: T.StructType, clock: str):
        declared = _Declared()
        processor.init(declared)
        self.processor, self.keys, self.clock, self.schemas = processor, keys, clock, declared.schemas

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.group = GroupHandle(handle, self.keys, self.schemas)
        self.processor.init(self.group)

    def close(self) -> None:
        self.processor.close()

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        group, shares, places = self.group, {}, None
        for row in rows:
            if places is None:
                places = [row.__fields__.index(f.name) for f in self.keys]
            shares.setdefault(group.name(tuple(row[i] for i in places)), []).append(row)
        for name, share in shares.items():
            group.key = name
            yield from self.processor.handleInputRows(group.names[name], iter(share), timerValues)
        group.store(fired=False)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        event = self.clock == "EventTime"
        now = timerValues.getCurrentWatermarkInMs() if event else timerValues.getCurrentProcessingTimeInMs()
        limit = max(now - 1, expiredTimerInfo.getExpiryTimeInMs())
        group = self.group
        while due := self._due(limit):
            for at, name in due:
                group.key = name
                if (at,) in group.timers.get():  # an earlier one may have deleted it
                    yield from self.processor.handleExpiredTimer(group.names[name], timerValues, ExpiredTimerInfo(at))
                    group.deleteTimer(at)
        group.store(fired=True)

    def _due(self, limit: int) -> list[tuple[int, tuple]]:
        found = [(at, name) for name, rows in self.group.timers.all().items() for (at,) in rows if at <= limit]
        return sorted(found, key=lambda item: item[0])


def group_of(groups: int, *columns: str | Column) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(groups)).cast("int")


def transform_groups(
    rows: DataFrame,
    keys: Sequence[str],
    processor: StatefulProcessor,
    out: T.StructType,
    clock: str,
    groups: int = GROUPS,
) -> DataFrame:
    """``rows.groupBy(*keys).transformWithState(processor, out, "Append", clock)``, with the keys' state in ``groups`` groups."""
    fields = T.StructType([rows.schema[name] for name in keys])
    grouped = rows.withColumn(GROUP, group_of(groups, *keys)).groupBy(GROUP)
    return grouped.transformWithState(Grouped(processor, fields, clock), out, "Append", clock)
