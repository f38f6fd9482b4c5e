"""Health rules: each is one aggregate column, the verdict reads them in a fixed order."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queuemill.functions.scalars import MICROS
from queuemill.operators.table import count_where

# What a client reads when a rule is broken.
FAILED_TEXT = "More than {y}% requests failed in last {x} seconds"
PENDING_TEXT = "Requests older than {x} seconds are pending"
UPTIME_TEXT = "Up time more than {x} seconds"
TIMEDOUT_TEXT = "More than {y}% requests timedout in last {x} seconds"


@dataclass(frozen=True)
class HealthRules:
    """Limits to check; a rule that is None is not checked."""

    failed_pct: tuple[int, int] | None = None  # (last x seconds, y percent)
    pending_seconds: int | None = None
    uptime_seconds: int | None = None
    timedout_pct: tuple[int, int] | None = None


def _share(as_of_us: int, seconds: int, percent: int, query: dict) -> Column:
    """True if matching rows are ``percent`` or more of those delivered lately; False if none were."""
    lately = {"delivered_us": {"$gte": as_of_us - seconds * MICROS}}
    share = F.try_divide(count_where({**lately, **query}) * F.lit(100.0), count_where(lately))
    return F.coalesce(share >= percent, F.lit(False))


def failed_pct(as_of_us: int, seconds: int, percent: int) -> Column:
    return _share(as_of_us, seconds, percent, {"success": False})


def timedout_pct(as_of_us: int, seconds: int, percent: int) -> Column:
    return _share(as_of_us, seconds, percent, {"timed_out": True})


def pending_older(as_of_us: int, seconds: int) -> Column:
    pending = {
        "received_us": {"$lte": as_of_us - seconds * MICROS},
        "delivered_us": None,
        "success": {"$ne": False},
    }
    return count_where(pending) > 0


def uptime_over(as_of_us: int, seconds: int, started: str = "started_us") -> Column:
    """Over a batch log: the first batch began more than ``seconds`` ago."""
    return F.coalesce(F.lit(as_of_us) - F.min(started) > seconds * MICROS, F.lit(False))


def rule_columns(rules: HealthRules, as_of_us: int, started: str) -> list[tuple[Column, str]]:
    """(broken?, reason) in the order in which they are checked."""
    checks = []
    if rules.failed_pct:
        x, y = rules.failed_pct
        checks.append((failed_pct(as_of_us, x, y), FAILED_TEXT.format(x=x, y=y)))
    if rules.pending_seconds is not None:
        x = rules.pending_seconds
        checks.append((pending_older(as_of_us, x), PENDING_TEXT.format(x=x)))
    if rules.uptime_seconds is not None:
        x = rules.uptime_seconds
        checks.append((uptime_over(as_of_us, x, started), UPTIME_TEXT.format(x=x)))
    if rules.timedout_pct:
        x, y = rules.timedout_pct
        checks.append((timedout_pct(as_of_us, x, y), TIMEDOUT_TEXT.format(x=x, y=y)))
    return checks


def health_verdict(
    df: DataFrame,
    rules: HealthRules,
    as_of_us: int,
    keys: Sequence[str] = (),
    started: str = "stage0_received_us",
) -> DataFrame:
    """503 with the reason of the first broken rule, else 200 ``ok``; one row, or one per key.

    Up time counts from the first batch start in column ``started``.
    """
    checks = rule_columns(rules, as_of_us, started)
    reasons = [F.when(broken, F.lit(text)) for broken, text in checks]
    reason = F.coalesce(*reasons, F.lit(None).cast("string"))
    return df.groupBy(*keys).agg(reason.alias("reason")).select(
        *keys,
        F.when(F.col("reason").isNull(), 200).otherwise(503).alias("status_code"),
        F.when(F.col("reason").isNull(), F.lit("ok")).alias("status"),
        "reason",
    )
