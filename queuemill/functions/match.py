"""Query-by-dict predicates, the filter language of the request table."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def _all_of(conditions: list[Column]) -> Column:
    return reduce(lambda left, right: left & right, conditions, F.lit(True))


def _compare(column: Column, operator: str, value: Any) -> Column:
    value = value if isinstance(value, Column) else F.lit(value)
    if operator == "$eq":
        return column.eqNullSafe(value)
    if operator == "$ne":
        return ~column.eqNullSafe(value)
    if operator == "$lt":
        return column < value
    if operator == "$lte":
        return column <= value
    if operator == "$gt":
        return column > value
    if operator == "$gte":
        return column >= value
    raise ValueError(f"unknown operator {operator!r}")


def match(query: Mapping[str, Any] | None) -> Column:
    """Turn ``{"success": True, "received_us": {"$gt": a, "$lt": b}}`` into one boolean Column.

    Several columns, or several operators on one column, must all hold. Equality and ``$ne`` are
    null-safe (``$ne`` keeps NULL rows). A comparison with NULL stays NULL, which filters, ``when`` and
    ``count_if`` take as "no"; left bare like this, the parts can be pushed into the scan.
    """
    conditions: list[Column] = []
    for name, wanted in (query or {}).items():
        if name == "$and":
            conditions.extend(match(part) for part in wanted)
        elif isinstance(wanted, Mapping):
            conditions.extend(_compare(F.col(name), op, value) for op, value in wanted.items())
        else:
            conditions.append(_compare(F.col(name), "$eq", wanted))
    return _all_of(conditions)


def no_match(query: Mapping[str, Any] | None) -> Column:
    """The rows that :func:`match` does not select, those it cannot decide included."""
    return ~F.coalesce(match(query), F.lit(False))
