"""Verbs of the request table, on immutable DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queuemill.functions.match import match, no_match

Query = Mapping[str, Any]


def search(
    df: DataFrame,
    query: Query,
    n: int | None = None,
    keys: Sequence[str] | None = None,
    order: Sequence[str] = ("received_us", "request_id"),
) -> DataFrame:
    """Matching rows, first in first out, at most ``n`` of them (0 or None: all, unordered)."""
    found = df.filter(match(query))
    if n:
        found = found.orderBy(*order).limit(n)
    return found.select("request_id", *[k for k in keys if k != "request_id"]) if keys else found


def search_update(df: DataFrame, query: Query, changes: Mapping[str, Any]) -> DataFrame:
    """Set columns on matching rows, keep the other rows."""
    hit = match(query)
    updated = {
        name: F.when(hit, value if isinstance(value, Column) else F.lit(value)).otherwise(
            F.col(name)
        )
        for name, value in changes.items()
    }
    return df.withColumns(updated)


def count_where(query: Query) -> Column:
    """Aggregate column: rows matching. Many of them share one scan."""
    return F.count_if(match(query))


def count(df: DataFrame, queries: Mapping[str, Query]) -> DataFrame:
    return df.agg(*[count_where(query).alias(name) for name, query in queries.items()])


def sum_where(column: str, query: Query) -> Column:
    """Aggregate column: sum over matching rows, NULL if there are none."""
    return F.sum(F.when(match(query), F.col(column)))


def get(
    df: DataFrame, ids: DataFrame, keys: Sequence[str] | None = None, key: str = "request_id"
) -> DataFrame:
    """Rows of the given ids. The join strategy is left to the planner's size estimates."""
    found = df.join(ids.select(key), key, "left_semi")
    return found.select(key, *[k for k in keys if k != key]) if keys else found


def upsert(df: DataFrame, updates: DataFrame, version: Column, key: str = "request_id") -> DataFrame:
    """Merge ``updates`` by key: the write with the highest ``version`` wins, new keys are added.

    A NULL version is lower than any other; of writes of one version the one whose values, as JSON text, sort
    last wins, so that reruns agree.

    Columns that ``updates`` lacks keep their value. Repeated writes to one key shrink in the
    map-side half of the aggregation, so a much-written key costs no more than any other.
    """
    columns = [name for name in updates.columns if name != key and name in df.columns]
    ties = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    latest = (
        updates.groupBy(key)
        .agg(F.max_by(F.struct(*columns), F.struct(version.alias("v"), ties.alias("t"))).alias("_new"))
        .withColumnRenamed(key, "_key")
    )
    joined = df.join(latest, df[key] == latest["_key"], "full_outer")
    written = F.col("_key").isNotNull()
    merged = [
        F.coalesce(F.col(name), F.col("_key")).alias(name)
        if name == key
        else F.when(written, F.col(f"_new.{name}")).otherwise(F.col(name)).alias(name)
        if name in columns
        else F.col(name)
        for name in df.columns
    ]
    return joined.select(*merged)


def delete(df: DataFrame, query: Query) -> DataFrame:
    return df.filter(no_match(query))


def accumulate(df: DataFrame, key: str, value: str) -> DataFrame:
    """Running counters: the sum of the increments per key."""
    return df.groupBy(key).agg(F.sum(value).alias(value))
