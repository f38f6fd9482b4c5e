"""Feeds bounded in inputs, and epochs that may run twice."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from queuemill.session import scratch_path
from queuemill.sources import feeds

SCHEMA = "request_id bigint, received_us bigint, n_inputs int"


def requests(spark, sizes):
    rows = [(i, 1000 + i // 3, n) for i, n in enumerate(sizes)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.mark.parametrize("limit", [1, 2, 7, 10, 100])
def test_no_chunk_is_above_the_limit(spark, limit):
    rng = random.Random(limit)
    sizes = [rng.choice([None, 0, 1, 1, 2, 3, 5, 9]) for _ in range(400)]
    found = feeds.chunked(requests(spark, sizes), limit).collect()
    assert sorted((r.request_id, r.n_inputs) for r in found) == list(enumerate(sizes))
    chunks: dict[int, list] = {}
    for r in sorted(found, key=lambda r: r.request_id):
        chunks.setdefault(r.chunk, []).append(r)
    small = sorted(c for c in chunks if c >= 0)
    for number, rows in chunks.items():
        total = sum(r.n_inputs or 0 for r in rows)
        assert total <= limit or len(rows) == 1
    ids = [r.request_id for c in small for r in chunks[c]]
    assert ids == sorted(ids)  # in order of arrival
    fills = [sum(r.n_inputs or 0 for r in chunks[c]) for c in small[:-1]]
    assert sum(fills) >= len(fills) * (limit // 2) // 2


def test_triggers_and_repeated_epoch(spark):
    """No trigger takes more inputs than the limit; an epoch that runs again writes nothing twice."""
    df = requests(spark, [1 + i % 5 for i in range(300)])
    path, out, progress = (scratch_path(spark, label) for label in ("feed", "epochs", "epochs-progress"))
    feeds.write_feed(df.filter("request_id < 200"), path, 100)
    runs = []

    def run():
        stream = feeds.read_feed(spark, path, df.schema)
        query = feeds.write_epochs(stream, out, progress).trigger(availableNow=True).start()
        query.awaitTermination()
        runs.append(len([p for p in query.recentProgress if p.numInputRows]))

    run()
    feeds.write_feed(df.filter("request_id >= 200"), path, 100)
    run()
    assert runs[0] >= 6 and runs[1] >= 3
    written = feeds.read_epochs(spark, out)
    sums = written.groupBy("epoch").agg(F.sum("n_inputs").alias("n")).collect()
    assert len(sums) == sum(runs) and max(r.n for r in sums) <= 100
    sink = feeds.epoch_sink(out)
    one = written.filter("epoch = 2").drop("epoch").collect()
    sink(spark.createDataFrame(one, df.schema), 2)  # Spark runs an epoch again with the same rows
    again = feeds.read_epochs(spark, out)
    assert again.drop("epoch").exceptAll(df).isEmpty() and again.count() == 300


def test_empty_feed(spark):
    assert feeds.chunked(requests(spark, []), 5).count() == 0
