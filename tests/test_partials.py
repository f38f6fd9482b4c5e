"""Windows from partial sums, merged sketches, and expressions that fail by request."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from queuemill.operators import partials, sketches
from queuemill.operators.inference import Stage, chain, predict
from queuemill.operators.metrics import window_metrics
from queuemill.session import scratch_path


def values(df):
    return [tuple(round(v, 6) if isinstance(v, float) else v for v in row) for row in df.collect()]


def test_any_window_equals_the_scan(spark, tables):
    log = tables.request_log.cache()
    low, high = log.agg(F.min("received_us"), F.max("received_us")).first()
    width = 3_600_000_000
    slices = partials.metric_partials(log, width).cache()
    rng = random.Random(1)
    windows = [(rng.randint(low, high + width), rng.randint(1, 900_000)) for _ in range(8)]
    windows += [(low // width * width + 30 * width, 10 * 3600), (low // width * width + 3 * width, 1800), (high + 10 * width, 60)]
    at = log.orderBy("received_us").select("received_us").limit(40).collect()[-1][0]
    windows += [(at, 7200), (at + 7200 * 1_000_000, 7200)]  # both ends are open
    for end, seconds in windows:
        found = values(partials.window_from_partials(slices, log, end, seconds, width))
        wanted = values(window_metrics(log, end, seconds))
        assert (found or [(0,) * 8 + (0.0, 0.0)]) == wanted, (end, seconds)
    log.unpersist()
    slices.unpersist()


def test_partials_of_several_loads_add_up(spark, tables):
    log = tables.request_log
    parts = [partials.metric_partials(log.filter(F.col("request_id") % 3 == i), 10**9) for i in range(3)]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    end = log.agg(F.max("received_us")).first()[0] - 123_456
    found = partials.window_from_partials(both, log, end, 500_000.5, 10**9)
    assert values(found) == values(window_metrics(log, end, 500_000.5))


def test_only_the_ends_of_the_window_read_the_log(spark, tables):
    path = scratch_path(spark, "log")
    tables.request_log.write.parquet(path)
    log = spark.read.parquet(path)
    end, seconds, width = 1_705_000_000_123_456, 864_000, 3_600_000_000
    rows, _ = partials.border_rows(log, end, seconds, width)
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    text = rows._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = text.split("PushedFilters: ")[1].split("ReadSchema")[0]
    begin = end - seconds * 1_000_000
    first, last = begin // width * width + width, end // width * width
    for bound in (begin, first, last, end):
        assert f"received_us,{bound}" in pushed and f"delivered_us,{bound}" in pushed
    touched = F.greatest(F.col("received_us"), F.coalesce("delivered_us", "received_us"))
    assert rows.count() < log.filter(F.col("received_us").between(begin, end)).count() / 5
    assert rows.filter((F.col("received_us") >= first) & (touched < last)).count() == 0


def test_sketches_merge_within_their_bound(spark):
    rows = spark.range(60_000).select(
        (F.col("id") % 3).alias("connection_id"), F.col("id").alias("received_us"),
        F.pmod(F.xxhash64("id"), F.lit(1_000_003)).cast("double").alias("latency_ms"), (F.col("id") % 10 > 0).alias("success"),
    )
    slices = sketches.latency_sketches(rows, 1000)
    assert slices.count() == 3 * 60 and slices.select(F.max(F.length("sketch"))).first()[0] < 20_000
    for keys, where in (([], "true"), (["connection_id"], "slice_us between 10000 and 29000")):
        merged = sketches.merge_sketches(slices.filter(where), keys)
        ok = rows.filter("success").withColumn("slice_us", F.floor(F.col("received_us") / 1000) * 1000).filter(where)
        for row in sketches.sketched_percentiles(merged, [0.0, 0.25, 0.5, 0.99, 1.0]).collect():
            mine = ok if not keys else ok.filter(F.col("connection_id") == row.connection_id)
            assert row.calls == mine.count()
            for p, name in ((0.25, "p25_latency_ms"), (0.5, "p50_latency_ms"), (0.99, "p99_latency_ms")):
                rank = mine.filter(F.col("latency_ms") <= row[name]).count() / row.calls
                assert abs(rank - p) <= 2 * sketches.rank_error() + 1 / row.calls
    none = sketches.merge_sketches(slices.filter("false"))
    assert sketches.sketched_percentiles(none).count() == 0


def test_small_groups_are_exact(spark):
    rows = spark.createDataFrame([(1, 0, float(i), True) for i in range(1, 101)], "connection_id int, received_us bigint, latency_ms double, success boolean")
    found = sketches.sketched_percentiles(sketches.merge_sketches(sketches.latency_sketches(rows, 10)), [0.5, 1.0]).first()
    assert (found.calls, found.p50_latency_ms, found.p100_latency_ms) == (100, 50.0, 100.0)


def test_sketches_of_a_stream_merge_with_those_of_a_batch(spark):
    schema = "connection_id bigint, received_us bigint, latency_ms double, success boolean"
    rows = spark.range(3000).selectExpr("id % 2 as connection_id", "id as received_us", "cast(id % 1000 as double) as latency_ms", "true as success")
    path, out = scratch_path(spark, "calls"), scratch_path(spark, "call-sketches")
    rows.repartition(3).write.parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)

    def add(part, epoch):
        sketches.latency_sketches(part, 500).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    stream.writeStream.foreachBatch(add).option("checkpointLocation", scratch_path(spark, "p")).trigger(availableNow=True).start().awaitTermination()
    merged = sketches.merge_sketches(spark.read.parquet(out).unionByName(sketches.latency_sketches(rows, 500), True))
    (row,) = sketches.sketched_percentiles(merged, [0.5]).collect()
    assert row.calls == 6000 and abs(row.p50_latency_ms - 500) <= 1000 * 2 * sketches.rank_error()


def halves(x):
    return F.lit(100) / x


def tried_halves(x):
    return F.try_divide(F.lit(100), x)


def test_one_input_fails_its_request_only(spark):
    rows = [(1, [1, 2]), (2, [5, 0, 1]), (3, []), (4, None), (5, [None, 4]), (6, [0])]
    df = spark.createDataFrame([(i, 0, i, x) for i, x in rows], "request_id int, queue_key int, received_us bigint, inputs array<int>")
    stage = Stage.from_expression(halves, "double", "halves", attempt=tried_halves)
    seen = Stage.from_function(lambda inputs, batch_size=1: [None if x is None else x + 1 for x in inputs], "double", 8, "more")
    found = {r.request_id: (r.success, r.outputs, r.last_stage, r.error) for r in chain(df, [stage, seen]).collect()}
    assert found[1] == (True, [101.0, 51.0], 1, None) and found[5] == (True, [None, 26.0], 1, None)
    assert found[3] == (True, [], -1, None) and found[4][0] is False
    for broken in (2, 6):
        assert found[broken] == (False, None, 0, "an input has no answer in stage 'halves'")
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        chain(df, [Stage.from_expression(halves, "double")]).collect()
    flat = spark.createDataFrame([(0,), (4,)], "input int")
    assert [r.output for r in predict(flat, stage).collect()] == [None, 25.0]
