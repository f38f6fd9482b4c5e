"""Plans: metrics, health, benchmark and resource reports (groups A, G, H, I, J and L)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuemill.functions.scalars import format_duration
from queuemill.operators import health as H
from queuemill.operators import latency as B
from queuemill.operators import metrics as M
from queuemill.operators import resources as J
from queuemill.plans.registry import query
from queuemill.plans.stages import BATCH_LOG_SQL, batch_log_of
from queuemill.plans.views import (
    AS_OF_US,
    BENCH_SECONDS,
    CALLS_SQL,
    LOG_SQL,
    SAMPLES_SQL,
    WEEK_SECONDS,
    Tables,
    rounded,
)
from queuemill.sources.sinks import report_json, resource_snapshot_json, to_prometheus_text

FROM_US = AS_OF_US - WEEK_SECONDS * 1_000_000
RECEIVED = f"received_us > {FROM_US} and received_us < {AS_OF_US}"
DELIVERED = f"delivered_us > {FROM_US} and delivered_us < {AS_OF_US}"
ANSWERED = f"{RECEIVED} and delivered_us is not null and timed_out is distinct from true"

METRIC_SQL = {
    "requests_received_in_last_x_seconds": f"count(*) filter (where {RECEIVED})",
    "requests_processed_in_last_x_seconds": f"count(*) filter (where {DELIVERED})",
    "number_of_requests_timedout_in_last_x_seconds":
        f"count(*) filter (where {DELIVERED} and timed_out is true)",
    "requests_received_in_last_x_seconds_that_failed":
        f"count(*) filter (where {RECEIVED} and success is false)",
    "requests_processed_in_last_x_seconds_that_failed":
        f"count(*) filter (where {DELIVERED} and success is false)",
    "requests_received_in_last_x_seconds_that_are_pending":
        f"count(*) filter (where {RECEIVED} and delivered_us is null and success is distinct from false)",
    "requests_received_in_last_x_seconds_that_are_successful":
        f"count(*) filter (where {ANSWERED} and success is true)",
    "requests_processed_in_last_x_seconds_that_are_successful":
        f"count(*) filter (where {DELIVERED} and success is true and timed_out is distinct from true)",
    "avg_total_time_per_req_for_reqs_in_last_x_seconds":
        f"""round(sum((delivered_us - received_us) / 1000000.0) filter (where {ANSWERED})
          / count(*) filter (where {ANSWERED} and success is true) + 1e-9, 6)""",
    "avg_actual_total_time_per_req_for_reqs_in_last_x_seconds":
        f"""round(sum((stage0_predicted_us - stage0_received_us) / 1000000.0) filter (where {ANSWERED})
          / count(*) filter (where {ANSWERED} and success is true) + 1e-9, 6)""",
}


def _register_metric(number: int, name: str) -> None:
    short = name.replace("_in_last_x_seconds", "").replace("_for_reqs", "")

    @query(f"g{number}_{short}", f"with {LOG_SQL} select {METRIC_SQL[name]} as {name} from request_log")
    def metric(t: Tables) -> DataFrame:
        return rounded(M.window_metrics(t.request_log, AS_OF_US, WEEK_SECONDS, [name]))


for _number, (_name, _) in enumerate(M.METRICS, start=1):
    _register_metric(_number, _name)

ALL_METRICS_SQL = ", ".join(f"{sql} as {name}" for name, sql in METRIC_SQL.items())


@query("g_window_metrics", f"with {LOG_SQL} select {ALL_METRICS_SQL} from request_log")
def window_metrics(t: Tables) -> DataFrame:
    return rounded(M.window_metrics(t.request_log, AS_OF_US, WEEK_SECONDS))


@query(
    "g_window_metrics_by_queue",
    f"""with {LOG_SQL}, by_queue as (select queue_key, {ALL_METRICS_SQL} from request_log
      group by queue_key) select * replace (
      case when avg_total_time_per_req_for_reqs_in_last_x_seconds is null and
        (select count(*) from request_log l where l.queue_key = by_queue.queue_key and {ANSWERED}) = 0
        then 0 else avg_total_time_per_req_for_reqs_in_last_x_seconds end
        as avg_total_time_per_req_for_reqs_in_last_x_seconds,
      case when avg_actual_total_time_per_req_for_reqs_in_last_x_seconds is null and
        (select count(*) from request_log l where l.queue_key = by_queue.queue_key and {ANSWERED}) = 0
        then 0 else avg_actual_total_time_per_req_for_reqs_in_last_x_seconds end
        as avg_actual_total_time_per_req_for_reqs_in_last_x_seconds) from by_queue""",
)
def window_metrics_by_queue(t: Tables) -> DataFrame:
    return rounded(M.window_metrics_by(t.request_log, ["queue_key"], AS_OF_US, WEEK_SECONDS))


def busiest_inputs(df: DataFrame) -> DataFrame:
    """A user metric: the number of inputs of all requests."""
    return df.agg(F.sum("n_inputs").alias("value")).select(
        F.lit("inputs_total").alias("name"), F.lit("counter").alias("type"),
        F.lit("Inputs of all requests.").alias("help"), "value",
    )


def all_metric_rows(t: Tables) -> DataFrame:
    log = t.request_log
    rows = M.metric_rows(M.window_metrics(log, AS_OF_US, WEEK_SECONDS), WEEK_SECONDS)
    extra = M.register_metric(busiest_inputs)(log)
    return M.with_extra_metrics(rows, extra)


def _rows_sql() -> str:
    parts = [
        f"""select {seq} as seq, '{name}' as name, '{text.format(x=WEEK_SECONDS)}' as help,
          'gauge' as type, cast({METRIC_SQL[name]} as double) as value from request_log"""
        for seq, (name, text) in enumerate(M.METRICS)
    ]
    parts.append(
        """select 10, 'inputs_total', 'Inputs of all requests.', 'counter',
          cast(sum(n_inputs) as double) from request_log"""
    )
    return " union all ".join(parts)


@query("g11_with_extra_metrics", f"with {LOG_SQL} {_rows_sql()}")
def with_extra_metrics(t: Tables) -> DataFrame:
    return rounded(all_metric_rows(t))


@query(
    "l3_register_metric",
    f"""with {LOG_SQL} select 'inputs_total' as name, 'counter' as type,
      'Inputs of all requests.' as help, cast(sum(n_inputs) as double) as value from request_log""",
)
def register_metric(t: Tables) -> DataFrame:
    return M.register_metric(busiest_inputs)(t.request_log).drop("seq")


@query(
    "a6_prometheus_text",
    f"""with {LOG_SQL}, metric_rows as ({_rows_sql()})
      select string_agg(concat('# HELP ', name, ' ', help, chr(10), '# TYPE ', name, ' ', type, chr(10),
        name, ' ', case when value = floor(value) then cast(cast(value as bigint) as varchar)
        else cast(value as varchar) end), concat(chr(10), chr(10)) order by seq) as text from metric_rows""",
)
def prometheus_text(t: Tables) -> DataFrame:
    return to_prometheus_text(rounded(all_metric_rows(t)))


@query(
    "g12_utilisation",
    f"""with recursive {BATCH_LOG_SQL} select queue_key,
      round(sum((ended_us - started_us) / 3600000000.0) + 1e-9, 6) as total_predictor_run_for_hours,
      round(({AS_OF_US} - min(started_us)) / 3600000000.0 + 1e-9, 6) as total_predictor_up_for_hours
      from batch_log group by queue_key""",
)
def utilisation(t: Tables) -> DataFrame:
    return rounded(M.utilisation(batch_log_of(t), AS_OF_US, ["queue_key"]))


SHARE_SQL = (
    "coalesce(count(*) filter (where {lately} and {test}) * 100.0"
    " / nullif(count(*) filter (where {lately}), 0) >= {y}, false)"
)
LATELY = f"delivered_us >= {FROM_US}"
FAILED_SQL = SHARE_SQL.format(lately=LATELY, test="success is false", y=20)
TIMEDOUT_SQL = SHARE_SQL.format(lately=LATELY, test="timed_out is true", y=3)
PENDING_SQL = f"""count(*) filter (where received_us <= {FROM_US} and delivered_us is null
  and success is distinct from false) > 0"""
UPTIME_SQL = f"{AS_OF_US} - min(stage0_received_us) > 2500000000000"


@query(
    "h1_failed_pct",
    f"with {LOG_SQL} select queue_key, {FAILED_SQL} as unhealthy from request_log group by queue_key",
)
def failed_pct(t: Tables) -> DataFrame:
    rule = H.failed_pct(AS_OF_US, WEEK_SECONDS, 20).alias("unhealthy")
    return t.request_log.groupBy("queue_key").agg(rule)


@query(
    "h2_pending_older",
    f"with {LOG_SQL} select queue_key, {PENDING_SQL} as unhealthy from request_log group by queue_key",
)
def pending_older(t: Tables) -> DataFrame:
    rule = H.pending_older(AS_OF_US, WEEK_SECONDS).alias("unhealthy")
    return t.request_log.groupBy("queue_key").agg(rule)


@query(
    "h3_uptime_over",
    f"""with recursive {BATCH_LOG_SQL} select queue_key,
      {AS_OF_US} - min(started_us) > 2500000000000 as unhealthy from batch_log group by queue_key""",
)
def uptime_over(t: Tables) -> DataFrame:
    rule = H.uptime_over(AS_OF_US, 2_500_000).alias("unhealthy")
    return batch_log_of(t).groupBy("queue_key").agg(rule)


@query(
    "h4_timedout_pct",
    f"with {LOG_SQL} select queue_key, {TIMEDOUT_SQL} as unhealthy from request_log group by queue_key",
)
def timedout_pct(t: Tables) -> DataFrame:
    rule = H.timedout_pct(AS_OF_US, WEEK_SECONDS, 3).alias("unhealthy")
    return t.request_log.groupBy("queue_key").agg(rule)


@query(
    "h5_health_verdict",
    f"""with {LOG_SQL}, rules as (select queue_key, case
        when {FAILED_SQL} then 'More than 20% requests failed in last {WEEK_SECONDS} seconds'
        when {PENDING_SQL} then 'Requests older than {WEEK_SECONDS} seconds are pending'
        when {UPTIME_SQL} then 'Up time more than 2500000 seconds'
        when {TIMEDOUT_SQL} then 'More than 3% requests timedout in last {WEEK_SECONDS} seconds'
        end as reason from request_log group by queue_key)
      select queue_key, case when reason is null then 200 else 503 end as status_code,
        case when reason is null then 'ok' end as status, reason from rules""",
)
def health_verdict(t: Tables) -> DataFrame:
    rules = H.HealthRules((WEEK_SECONDS, 20), WEEK_SECONDS, 2_500_000, (WEEK_SECONDS, 3))
    return H.health_verdict(t.request_log, rules, AS_OF_US, ["queue_key"])


COUNTED_SQL = CALLS_SQL + ", counted as (select * from calls where not is_warmup)"
THROUGHPUT_SQL = f"""count(*) as total_requests, count(*) filter (where success) as successes,
  count(*) filter (where not success) as failures,
  round(count(*) filter (where success) * 100.0 / count(*) + 1e-9, 6) as success_rate,
  round(count(*) / {BENCH_SECONDS} + 1e-9, 6) as actual_rps"""
STATS_SQL = """round(avg(latency_ms) filter (where success) + 1e-9, 6) as average_latency_ms,
  round(stddev_pop(latency_ms) filter (where success) + 1e-9, 6) as std_latency_ms,
  round(min(latency_ms) filter (where success) + 1e-9, 6) as min_latency_ms,
  round(max(latency_ms) filter (where success) + 1e-9, 6) as max_latency_ms"""
MARKS_SQL = ", ".join(
    f"round(quantile_cont(latency_ms, {p}) + 1e-9, 6) as p{p * 100:g}_latency_ms" for p in B.PERCENTILES
)


def counted(t: Tables) -> DataFrame:
    return B.exclude_warmup(t.calls)


@query("i1_exclude_warmup", f"with {COUNTED_SQL} select connection_id, seq from counted")
def exclude_warmup(t: Tables) -> DataFrame:
    return counted(t).select("connection_id", "seq")


@query("i2_latency_stats", f"with {COUNTED_SQL} select {STATS_SQL} from counted")
def latency_stats(t: Tables) -> DataFrame:
    return rounded(B.latency_stats(counted(t)))


@query("i3_latency_percentiles", f"with {COUNTED_SQL} select {MARKS_SQL} from counted where success")
def latency_percentiles(t: Tables) -> DataFrame:
    return rounded(B.latency_percentiles(counted(t)))


@query("i3_percentiles_by_rank", f"with {COUNTED_SQL} select {MARKS_SQL} from counted where success")
def percentiles_by_rank(t: Tables) -> DataFrame:
    """The same answer by the distributed sort that larger data takes."""
    return rounded(B.latency_percentiles(counted(t), segments=16))


@query(
    "i4_throughput",
    f"with {COUNTED_SQL} select {THROUGHPUT_SQL}, cast(1000.0 as double) as total_target_rps from counted",
)
def throughput(t: Tables) -> DataFrame:
    return rounded(B.throughput(counted(t), BENCH_SECONDS, 100.0, 10))


PER_CONNECTION_SQL = f"""select connection_id, {THROUGHPUT_SQL},
  round(coalesce(avg(latency_ms) filter (where success), 0) + 1e-9, 6) as average_latency_ms
  from counted group by connection_id"""


@query("i5_per_connection", f"with {COUNTED_SQL} {PER_CONNECTION_SQL}")
def per_connection(t: Tables) -> DataFrame:
    return rounded(B.per_connection(counted(t), BENCH_SECONDS))


@query(
    "i6_first_errors",
    f"""with {COUNTED_SQL} select connection_id, seq, error, cast(row_number() over
      (order by connection_id, seq) as int) as rank from counted where not success
      order by connection_id, seq limit 10""",
)
def first_errors(t: Tables) -> DataFrame:
    return B.first_errors(counted(t))


@query("i6_error_count", f"with {COUNTED_SQL} select count(*) as error_count from counted where not success")
def error_count(t: Tables) -> DataFrame:
    return B.error_count(counted(t))


@query(
    "i7_format_duration",
    f"""with {CALLS_SQL}, spread as (select seq, case seq % 3 when 0 then round(latency_ms) / 1000
        when 1 then latency_ms else round(latency_ms) * 10 end as ms from calls)
      select seq, case when ms < 1 then printf('%.2fμs', ms * 1000) when ms < 1000 then printf('%.2fms', ms)
        else printf('%.2fs', ms / 1000) end as duration from spread""",
)
def format_durations(t: Tables) -> DataFrame:
    whole = F.round("latency_ms")
    ms = (
        F.when(F.col("seq") % 3 == 0, whole / 1000)
        .when(F.col("seq") % 3 == 1, F.col("latency_ms"))
        .otherwise(whole * 10)
    )
    return t.calls.select("seq", format_duration(ms).alias("duration"))


@query(
    "a7_report_json",
    f"""with {COUNTED_SQL} select 'overall' as kind, cast(null as varchar) as connection_id,
        count(*) as total_requests, round(count(*) filter (where success) * 100.0 / count(*), 4)
        as success_rate, round(quantile_cont(latency_ms, 0.99) filter (where success), 4) as p99 from counted
      union all select 'connection', cast(connection_id as varchar), count(*),
        round(count(*) filter (where success) * 100.0 / count(*), 4), null from counted
        group by connection_id""",
)
def report_lines(t: Tables) -> DataFrame:
    report = B.benchmark_report(t.calls, BENCH_SECONDS, 100.0, 10)
    lines = report_json(report, B.per_connection(counted(t), BENCH_SECONDS))

    def number(path: str, kind: str):
        return F.get_json_object("json", path).cast(kind)

    return lines.select(
        "kind", "connection_id", number("$.total_requests", "bigint").alias("total_requests"),
        F.round(number("$.success_rate", "double"), 4).alias("success_rate"),
        F.round(number("$.p99_latency_ms", "double"), 4).alias("p99"),
    )


TICKS_SQL = (
    SAMPLES_SQL
    + """, ticks as (select role, ts, sum(cpu) as cpu, sum(ram_kb) / 1024.0 as ram_mb from samples
    group by role, ts)"""
)
ROLLED_SQL = (
    TICKS_SQL
    + """, rolled as (select role, ts, cpu, ram_mb, min(cpu) over w as cpu_min, max(cpu) over w as cpu_max,
    avg(cpu) over w as cpu_avg, min(ram_mb) over w as ram_mb_min, max(ram_mb) over w as ram_mb_max,
    avg(ram_mb) over w as ram_mb_avg from ticks
    window w as (partition by role order by ts rows between 4 preceding and current row))"""
)


@query(
    "j1_sum_by_role",
    f"with {TICKS_SQL} select role, ts, round(cpu + 1e-9, 6) as cpu, round(ram_mb + 1e-9, 6) as ram_mb from ticks",
)
def sum_by_role(t: Tables) -> DataFrame:
    return rounded(J.sum_by_role(t.samples))


@query(
    "j2_with_gpu",
    f"""with {SAMPLES_SQL}, reading as (select ts, pid, cast(max(util) as bigint) as gpu_util,
      cast(max(mem) as bigint) as gpu_mem
      from gpu group by ts, pid)
      select role, ts, pid, round(cpu + 1e-9, 6) as cpu, coalesce(gpu_util, 0) as gpu_util,
      coalesce(gpu_mem, 0) as gpu_mem from samples left join reading using (ts, pid)""",
)
def with_gpu(t: Tables) -> DataFrame:
    return rounded(J.with_gpu(t.samples, t.gpu)).select(
        "role", "ts", "pid", "cpu", "gpu_util", "gpu_mem"
    )


@query(
    "j3_rolling_stats",
    f"""with {ROLLED_SQL} select role, ts, {', '.join(f'round({c} + 1e-9, 6) as {c}' for c in
      ('cpu', 'ram_mb', 'cpu_min', 'cpu_max', 'cpu_avg', 'ram_mb_min', 'ram_mb_max', 'ram_mb_avg'))}
      from rolled""",
)
def rolling_stats(t: Tables) -> DataFrame:
    return rounded(J.rolling_stats(J.sum_by_role(t.samples), ["cpu", "ram_mb"]))


@query(
    "a8_resource_snapshot_json",
    f"""with {ROLLED_SQL}, newest as (select * from rolled where (role, ts) in
        (select (role, max(ts)) from samples group by role)),
      pids as (select role, count(distinct pid) as n, min(pid) as first, string_agg(distinct pid, ',' order by pid)
        as ids from samples where (role, ts) in (select (role, max(ts)) from samples group by role) group by role)
      select g.name, case when n.role is null then 'not_running' else 'running' end as status,
        p.n as n_pids, case when g.role = 'loop' then p.first end as pid,
        case when g.role <> 'loop' then '[' || p.ids || ']' end as pids, round(n.cpu, 4) as cpu, round(n.ram_mb_max, 4) as ram_mb_max
      from (values ('loop', 'loop_process'), ('rest', 'rest_processes'), ('none', 'other_processes'))
        as g(role, name) left join newest n on n.role = g.role left join pids p on p.role = g.role""",
)
def resource_snapshot(t: Tables) -> DataFrame:
    samples = t.samples
    values = ["cpu", "ram_mb"]
    rolled = J.rolling_stats(J.sum_by_role(samples), values)
    latest = J.latest_by_role(samples, values, rolled)
    groups = {"loop": "loop_process", "rest": "rest_processes", "none": "other_processes"}
    stamp = F.date_format(F.timestamp_micros(F.lit(AS_OF_US)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    document = resource_snapshot_json(latest, groups, stamp, single=["loop"])
    names = F.explode(F.array(*[F.lit(name) for name in groups.values()]))

    def part(path: str, kind: str):
        return F.expr(f"get_json_object(json, concat('$.', name, '{path}'))").cast(kind)

    return document.select("json", names.alias("name")).select(
        "name", part(".status", "string").alias("status"), part(".n_pids", "bigint").alias("n_pids"),
        part(".pid", "bigint").alias("pid"), part(".pids", "string").alias("pids"),
        F.round(part(".current.cpu", "double"), 4).alias("cpu"),
        F.round(part(".stats.ram_mb.max", "double"), 4).alias("ram_mb_max"),
    )
