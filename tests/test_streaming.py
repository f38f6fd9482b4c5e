"""Streams against their batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from queuemill.operators.inference import Stage, chain
from queuemill.plans.streams import lifecycle_events, queue_stream, triple
from queuemill.session import scratch_path
from queuemill.sources.requests import read_request_stream
from queuemill.streaming import lifecycle, metrics, scoring
from queuemill.streaming.runner import bounded_trigger, dropped_as_late, rows_per_batch, run_available


def test_scored_stream_equals_batch_over_many_triggers(spark, tables):
    path = scratch_path(spark, "requests")
    tables.numbered_requests.repartition(4).write.parquet(path)
    stored = spark.read.parquet(path)
    stages = [Stage.from_function(triple, "int", 16)]
    stream = read_request_stream(spark, path, stored.schema, max_files=1)
    scored = scoring.score_stream(stream, stages).select("request_id", "outputs")
    streamed = run_available(scored, "scored")
    batch = chain(stored, stages).select("request_id", "outputs")
    assert streamed.count() == stored.count()
    assert streamed.exceptAll(batch).count() == 0


def small_events(spark):
    rows = [
        (1, 0, "received", -1, True), (1, 5, "claimed", 0, None), (1, 9, "finished", 0, True),
        (1, 10, "delivered", 0, None),
        (2, 1, "received", -1, True),
        (3, 2, "received", -1, True), (3, 3, "claimed", 0, None), (3, 6, "finished", 0, False),
        (4, 5_000, "received", -1, True),
    ]
    return spark.createDataFrame(rows, "request_id bigint, s int, kind string, stage int, success boolean").select(
        "request_id", F.timestamp_seconds(F.col("s") + 1_000_000).alias("event_time"), "kind", "stage", "success"
    )


def test_changes_and_timeouts_from_keyed_state(spark):
    events = small_events(spark)
    path = scratch_path(spark, "events")
    events.coalesce(1).write.parquet(path)
    stream = read_request_stream(spark, path, events.schema)
    changes = run_available(
        lifecycle.lifecycle_stream(stream, timeout_seconds=100, delay="1 second"), "changes"
    )
    newest = lifecycle.newest_rows(changes)
    assert [(r.request_id, r.timed_out) for r in newest.orderBy("request_id").collect()] == [
        (1, None), (2, True), (3, None), (4, None),
    ]
    shared = ["request_id", "last_stage", "success", "received_us", "delivered_us", "n_events"]
    folded = lifecycle.fold_lifecycle(events)
    assert newest.select(shared).exceptAll(folded.select(shared)).count() == 0


def test_waiting_request_times_out_once_its_time_is_up(spark):
    events = small_events(spark)
    path = scratch_path(spark, "events")
    events.coalesce(1).write.parquet(path)
    stream = read_request_stream(spark, path, events.schema)
    flagged = run_available(lifecycle.timeout_stream(stream, 100, delay="1 second"), "flagged")
    assert [r.request_id for r in flagged.collect()] == [2]


def test_silent_requests_are_closed(spark):
    events = small_events(spark)
    path = scratch_path(spark, "events")
    events.coalesce(1).write.parquet(path)
    stream = read_request_stream(spark, path, events.schema)
    closed = run_available(lifecycle.closed_lifecycles(stream, 60, 60, "1 second"), "closed")
    assert sorted(r.request_id for r in closed.collect()) == [1, 2, 3]


def test_stream_and_batch_events_agree(spark, tables):
    waiting = F.col("success").isNull() & (F.col("k") % 2 == 0)
    log = tables.request_log.withColumn("last_stage", F.when(waiting, -1).otherwise(0))
    streamed = run_available(lifecycle_events(queue_stream(tables)), "moments")
    assert streamed.exceptAll(lifecycle_events(log)).count() == 0
    assert streamed.count() == lifecycle_events(log).count()


def test_bounded_trigger_settings_and_run(spark, tables):
    path = scratch_path(spark, "bounded-in")
    tables.request_log.repartition(3).write.parquet(path)
    stream = read_request_stream(spark, path, tables.request_log.schema, max_files=1)
    out = scratch_path(spark, "bounded-out")
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)

    def counted(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": pa.array([batch.num_rows], pa.int64())})

    with rows_per_batch(spark, 64):
        sizes = stream.mapInArrow(counted, "rows bigint")
        query = bounded_trigger(sizes, 0.05).format("parquet").option("path", out).start()
    assert spark.conf.get(setting) == before
    query.processAllAvailable()
    query.stop()
    assert len([p for p in query.recentProgress if p.numInputRows]) == 3
    rows = [r.rows for r in spark.read.parquet(out).collect()]
    assert sum(rows) == tables.request_log.count() and max(rows) <= 64


def test_repeated_request_ids_are_dropped(spark, tables):
    path = scratch_path(spark, "twice")
    log = tables.request_log.select(
        "request_id", F.timestamp_micros("received_us").alias("ts")
    )
    log.unionByName(log).repartition(3).write.parquet(path)
    stream = read_request_stream(spark, path, log.schema)
    unique = run_available(scoring.dedupe_stream(stream, delay="60 days"), "unique")
    assert unique.count() == log.count()


def test_late_rows_are_dropped_and_counted(spark):
    path = scratch_path(spark, "late")
    schema = "kind string, s bigint, success boolean, timed_out boolean"
    for seconds in ([100_000], [200_000], [5]):  # the last one comes far too late
        rows = [("received", s, True, None) for s in seconds]
        part = spark.createDataFrame(rows, schema).withColumn("event_time", F.timestamp_seconds("s"))
        part.coalesce(1).write.mode("append").parquet(path)
    stream = read_request_stream(spark, path, part.schema, max_files=1)
    query = (
        metrics.metrics_stream(stream, 60, 60, 10)
        .writeStream.format("parquet")
        .option("path", scratch_path(spark, "late-out"))
        .option("checkpointLocation", scratch_path(spark, "late-progress"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    assert dropped_as_late(query) == 1


def test_long_waits_are_one_life(spark):
    """Claimed after two hours; ids are texts; events come in several files, not in order."""
    rows = [
        ("a", 0, "received", -1, True), ("a", 7_200, "claimed", 0, None), ("a", 7_260, "finished", 0, True),
        ("a", 7_300, "delivered", 0, None), ("b", 10, "received", -1, True), ("c", 90_000, "received", -1, True),
    ]
    events = spark.createDataFrame(
        rows, "request_id string, s int, kind string, stage int, success boolean"
    ).select(
        "request_id", F.timestamp_seconds(F.col("s") + 1_000_000).alias("event_time"), "kind", "stage", "success"
    )
    path = scratch_path(spark, "slow-events")
    for part in (events.filter("kind = 'claimed'"), events.filter("kind <> 'claimed' and request_id < 'c'"), events.filter("request_id = 'c'")):
        part.coalesce(1).write.mode("append").parquet(path)
    stream = read_request_stream(spark, path, events.schema, max_files=1)
    closed = run_available(lifecycle.closed_lifecycles(stream, 20_000, 3_600, "3 hours"), "closed")
    wanted = lifecycle.fold_lifecycle(events.filter("request_id < 'c'"))
    assert closed.count() == 2 and closed.exceptAll(wanted.select(closed.columns)).count() == 0
    changes = run_available(lifecycle.lifecycle_stream(stream, delay="3 hours"), "changes")
    assert {r.request_id for r in lifecycle.newest_rows(changes).collect()} == {"a", "b", "c"}


def test_ties_do_not_depend_on_the_order():
    import pandas as pd

    events = [("claimed", 5, 1, None), ("finished", 5, 0, True), ("received", 5, -1, True)]
    for order in ([0, 1, 2], [2, 1, 0], [1, 0, 2], [1, 2, 0]):
        frame = pd.DataFrame([events[i] for i in order], columns=["kind", "at_us", "stage", "success"])
        assert lifecycle._fold(list(lifecycle.EMPTY_STATE), frame)[0] == 1
