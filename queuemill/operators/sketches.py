"""Latency percentiles from mergeable sketches: small, in one pass, for any range of time slices. Opt-in: exact
percentiles are those of :func:`queuemill.operators.latency.latency_percentiles`.

A KLL sketch answers with a latency whose rank differs from the asked one by at most :func:`rank_error` of the calls, with
99 % probability for each answer, whatever the latencies are; up to about ``k`` calls it is exact. Merging keeps the bound, so sketches
of time slices may be stored, added to by streams, and merged over any range and any grouping. A sketch has some
kilobytes at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuemill.operators.latency import PERCENTILES, _percentile_name

SKETCH_K = 400


def rank_error(k: int = SKETCH_K) -> float:
    """The share of all calls by which a rank may be off, of one answer at 99 % confidence (a KLL sketch's known bound)."""
    return 2.296 / k**0.9723


def latency_sketches(
    calls: DataFrame, slice_us: int, time: str = "received_us", keys: Sequence[str] = ("connection_id",), k: int = SKETCH_K
) -> DataFrame:
    """``keys, slice_us, calls, sketch``: one row per group and time slice with successful calls.

    Works on a stream, too (with a watermark on a time column and :func:`window`, or in update mode).
    """
    ok = calls.filter("success and latency_ms is not null")
    begin = (F.floor(F.col(time) / slice_us) * slice_us).cast("bigint").alias("slice_us")
    sketch = F.kll_sketch_agg_double(F.col("latency_ms").cast("double"), F.lit(k))
    return ok.groupBy(*keys, begin).agg(F.count("*").alias("calls"), sketch.alias("sketch"))


def merge_sketches(sketches: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sketches of coarser groups; select the slices of a range before."""
    merged = F.kll_merge_agg_double("sketch").alias("sketch")
    return sketches.groupBy(*keys).agg(F.sum("calls").alias("calls"), merged).filter("calls > 0")


def sketched_percentiles(merged: DataFrame, percentiles: Sequence[float] = PERCENTILES) -> DataFrame:
    """A column per percentile in the place of ``sketch``."""
    found = [
        F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(_percentile_name(p)) for p in percentiles
    ]
    others = [c for c in merged.columns if c != "sketch"]
    return merged.select(*others, *found)
