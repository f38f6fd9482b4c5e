"""Percentiles, durations, rolling statistics and report texts."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from queuemill.functions.scalars import fill_batch, format_duration, l2_normalize
from queuemill.operators import health as H
from queuemill.operators import latency as B
from queuemill.operators import metrics as M
from queuemill.operators import recipes
from queuemill.operators import resources as J
from queuemill.operators import tuning
from queuemill.session import scratch_path
from queuemill.sources import requests as R
from queuemill.sources import sinks


@pytest.fixture(scope="module")
def calls(spark):
    rng = random.Random(3)
    rows = [
        (c, s, 7.5 if s % 3 == 0 else rng.expovariate(0.05), s % 11 != 0, f"e{s}", s < 5)
        for c in range(4) for s in range(500)
    ]
    return spark.createDataFrame(
        rows, "connection_id int, seq int, latency_ms double, success boolean, error string, is_warmup boolean"
    )


@pytest.mark.parametrize("segments", [1, 20])
def test_percentiles_equal_numpy(calls, segments):
    ok = [r.latency_ms for r in calls.filter("success").collect()]
    row = B.latency_percentiles(calls, segments=segments).first()
    wanted = np.percentile(ok, [50, 90, 95, 99])
    assert np.allclose(list(row), wanted, rtol=1e-12)


def test_no_report_without_a_success(calls):
    failed = calls.withColumn("success", F.lit(False))
    assert B.latency_stats(failed).count() == 0
    assert B.latency_percentiles(failed).count() == 0
    assert B.benchmark_report(failed, 10.0).count() == 0


def test_report_counts_without_warmup(calls):
    report = B.benchmark_report(calls, 10.0, 5.0, 4).first()
    assert report.total_requests == 4 * 495
    assert report.total_target_rps == 20.0
    assert report.actual_rps == pytest.approx(198.0)


def test_report_file_has_one_record_per_connection(spark, calls):
    path = scratch_path(spark, "report")
    sinks.write_report_json(B.benchmark_report(calls, 10.0), B.per_connection(calls, 10.0), path)
    records = [json.loads(r.value) for r in spark.read.text(path).collect()]
    assert sorted(r["kind"] for r in records) == ["connection"] * 4 + ["overall"]
    overall = next(r for r in records if r["kind"] == "overall")
    assert overall["stats"]["total_requests"] == 4 * 495


def test_durations_choose_their_unit(spark):
    df = spark.createDataFrame([(0.5,), (1.0,), (999.0,), (1000.0,)], "ms double")
    texts = [r[0] for r in df.select(format_duration(F.col("ms"))).collect()]
    assert texts == ["500.00μs", "1.00ms", "999.00ms", "1.00s"]


@pytest.mark.parametrize("bucket_seconds", [1, 3, 7, 50, 10**6])
def test_rolling_statistics_cross_buckets(spark, bucket_seconds):
    rng = random.Random(5)
    series = {role: sorted(rng.sample(range(200), 60)) for role in ("loop", "rest")}
    rows = [(role, ts, rng.random()) for role, stamps in series.items() for ts in stamps]
    ticks = spark.createDataFrame(rows, "role string, ts bigint, cpu double")
    got = {
        (r.role, r.ts): (r.cpu_min, r.cpu_max, r.cpu_avg)
        for r in J.rolling_stats(ticks, ["cpu"], bucket_seconds=bucket_seconds).collect()
    }
    assert len(got) == 120
    for role in series:
        values = [(ts, cpu) for r, ts, cpu in rows if r == role]
        for i, (ts, _) in enumerate(values):
            last = [cpu for _, cpu in values[max(0, i - 4) : i + 1]]
            assert got[role, ts] == pytest.approx((min(last), max(last), sum(last) / len(last)))


def test_first_slower_size_ends_the_search(spark):
    rows = [(1, 1, 4.0), (1, 2, 3.0), (1, 4, 3.5), (1, 8, 1.0), (2, 1, 5.0)]
    measured = spark.createDataFrame(rows, "queue_key int, batch_size int, time_per_example double")
    chosen = {r.queue_key: (r.optimal_batch_size, r.time_per_example)
              for r in tuning.choose_batch_size(measured).collect()}
    assert chosen == {1: (2, 3.0), 2: (1, 5.0)}


def test_stage_files_are_numbered_densely(spark):
    rows = [("a", n) for n in ("predictor_10.py", "predictor_2.py", "predictor_x.py", "util.py")]
    rows += [("b", n) for n in ("predictor.py", "predictor_0.py", "predictor_1.py")]
    names = spark.createDataFrame(rows, "recipe string, name string")
    got = {(r.recipe, r.name, r.sequence) for r in recipes.order_stages(names).collect()}
    assert got == {("a", "predictor_2.py", 0), ("a", "predictor_10.py", 1), ("b", "predictor.py", 0)}


def test_fill_repeats_cyclically(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([9],), ([],)], "xs array<int>")
    rows = [r[0] for r in df.select(fill_batch(F.col("xs"), 7)).collect()]
    assert rows == [[1, 2, 3, 1, 2, 3, 1], [9] * 7, []]


def test_zero_vector_stays_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<float>")
    assert [r[0] for r in df.select(l2_normalize(F.col("v"))).collect()] == [[0.0, 0.0], [0.6, 0.8]]


def test_metric_text_has_a_blank_line_between_blocks(spark, tables):
    rows = M.metric_rows(M.window_metrics(tables.request_log, 1_706_659_200_000_000, 30), 30)
    text = sinks.to_prometheus_text(rows).first().text
    blocks = text.split("\n\n")
    assert len(blocks) == 10
    name = "requests_received_in_last_x_seconds"
    assert blocks[0].split("\n")[:2] == [
        f"# HELP {name} The number of requests received in last 30 seconds.", f"# TYPE {name} gauge",
    ]


def test_health_is_ok_without_rows_and_names_the_first_broken_rule(spark, tables):
    now = 1_706_659_200_000_000
    rules = H.HealthRules(failed_pct=(30, 10), pending_seconds=10, timedout_pct=(30, 1))
    empty = tables.request_log.filter("false")
    assert H.health_verdict(empty, rules, now).first().status_code == 200
    verdict = H.health_verdict(tables.request_log, rules, now).first()
    assert verdict.status_code == 503 and verdict.reason == "Requests older than 10 seconds are pending"
    assert H.health_verdict(tables.request_log, H.HealthRules(), now).first().status == "ok"


def test_absent_group_is_not_running(spark, tables):
    samples = tables.samples
    rolled = J.rolling_stats(J.sum_by_role(samples), ["cpu"])
    latest = J.latest_by_role(samples, ["cpu"], rolled)
    document = sinks.resource_snapshot_json(latest, {"loop": "l", "gone": "g"}, F.lit("now"))
    parsed = json.loads(document.first().json)
    assert parsed["g"] == {"status": "not_running"} and parsed["l"]["status"] == "running"


def test_snapshot_names_the_processes_of_the_newest_tick(spark):
    rows = [("rest", 1, 9), ("rest", 2, 12), ("rest", 2, 4), ("rest", 2, 7), ("loop", 2, 5), ("loop", 1, 6)]
    samples = spark.createDataFrame([(*r, 1.5, 1024) for r in rows], "role string, ts long, pid long, cpu double, ram_kb long")
    rolled = J.rolling_stats(J.sum_by_role(samples), ["cpu"])
    latest = J.latest_by_role(samples, ["cpu"], rolled)
    groups = {"loop": "loop_process", "rest": "rest_processes", "gone": "other"}
    parsed = json.loads(sinks.resource_snapshot_json(latest, groups, F.lit("now"), single=["loop", "gone"]).first().json)
    assert parsed["rest_processes"]["pids"] == [4, 7, 12] and parsed["rest_processes"]["n_pids"] == 3
    assert parsed["loop_process"]["pid"] == 5 and "pids" not in parsed["loop_process"]
    assert parsed["other"] == {"status": "not_running"}


def test_binary_files_are_numbered_in_path_order(spark, tmp_path):
    for name in ("b.png", "a.txt", "noext"):
        (tmp_path / name).write_bytes(name.encode())
    rows = R.read_binary_requests(spark, str(tmp_path)).orderBy("name").collect()
    assert [(r.name, r.type, r.n_bytes, r.output_name) for r in rows] == [
        ("a.txt", "txt", 5, "output_file_1"), ("b.png", "png", 5, "output_file_2"),
        ("noext", "unknown", 5, "output_file_3"),
    ]
    assert bytes(rows[0].content) == b"a.txt"


@pytest.mark.parametrize("threshold", ["10MB", "-1"])
def test_files_are_numbered_whatever_join_the_planner_takes(spark, tmp_path, threshold):
    for number in range(30):
        (tmp_path / f"{number:02}.bin").write_bytes(bytes([number]))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        files = R.read_binary_requests(spark, str(tmp_path))
        plan = files._jdf.queryExecution().executedPlan().toString()
        rows = files.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert ("BroadcastHashJoin" in plan) == (threshold == "10MB")
    assert sorted((r.output_name, bytes(r.content)) for r in rows) == sorted(
        (f"output_file_{n + 1}", bytes([n])) for n in range(30)
    )


def test_array_file_gives_inputs_of_any_kind(spark, tmp_path):
    (tmp_path / "inputs.json").write_text('[1, "two", {"three": [3]}, null]')
    rows = R.read_request_array_file(spark, str(tmp_path / "inputs.json")).orderBy("pos")
    assert [r[0] for r in rows.select(F.to_json("input")).collect()] == [
        "1", '"two"', '{"three":[3]}', "null",
    ]


def test_responses_are_stored_with_the_asked_codec(spark, tables, tmp_path):
    import pyarrow.parquet as pq

    sinks.write_responses(tables.request_log.limit(5), str(tmp_path / "z"), compressed=True)
    part = next((tmp_path / "z").glob("*.parquet"))
    assert pq.ParquetFile(part).metadata.row_group(0).column(0).compression == "ZSTD"
