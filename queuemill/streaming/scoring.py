"""Stateless streams: scoring and de-duplication of incoming requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from queuemill.operators.inference import Stage, chain_as_read


def score_stream(stream: DataFrame, stages: Sequence[Stage]) -> DataFrame:
    """Every micro-batch through the chain, packed in the order it is read; no state, no shuffle."""
    return chain_as_read(stream, stages)


def dedupe_stream(
    stream: DataFrame, request_id: str = "request_id", time: str = "ts", delay: str = "10 minutes"
) -> DataFrame:
    """A request id sent again within ``delay`` is the same request: the first one stays."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([request_id])
