"""Plans: measuring runs of a chain on executors (groups D and E)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuemill.operators import calibration
from queuemill.operators.inference import Stage
from queuemill.plans.registry import query
from queuemill.plans.views import LOG_SQL, Tables, rounded


class Counted:
    """A model with a clock of its own: a call takes ``call + each * sum(inputs) + pair * n * n`` microseconds."""

    def __init__(self, call: int, each: int, pair: int, answer):
        self.call, self.each, self.pair, self.answer, self.now_us = call, each, pair, answer, 0

    def __call__(self, inputs: list, batch_size: int = 1) -> list:
        self.now_us += self.call + self.each * sum(inputs) + self.pair * len(inputs) ** 2
        return [self.answer(x) for x in inputs]


def own_clock(model: Counted) -> float:
    return float(model.now_us)


def load_first() -> Counted:
    return Counted(2000, 30, 1, lambda x: x + 1)


def load_second() -> Counted:
    return Counted(500, 7, 0, lambda x: x * 2)


STAGES = [
    Stage.from_loader(load_first, "bigint", name="first"),
    Stage.from_loader(load_second, "bigint", name="second"),
]


def measured(t: Tables) -> DataFrame:
    """The example of a queue is made from its first request."""
    first = t.request_log.groupBy("queue_key").agg(
        F.min_by(F.struct("k", "n_inputs"), F.struct("received_us", "request_id")).alias("r")
    )
    values = F.transform(F.sequence(F.lit(1), F.col("r.n_inputs")), lambda i: (i * F.col("r.k") % 50).cast("bigint"))
    examples = first.select("queue_key", values.alias("inputs"))
    return calibration.calibrate(examples, STAGES, runs=2, clock=own_clock)


MEASURED_SQL = (
    LOG_SQL
    + """, firsts as (select queue_key, k, n_inputs from request_log
    qualify row_number() over (partition by queue_key order by received_us, request_id) = 1),
  examples as (select queue_key, list_transform(range(1, n_inputs + 1), lambda i: cast(i * k % 50 as bigint)) as inputs
    from firsts),
  staged as (select queue_key, 0 as stage, 'first' as name, inputs, list_transform(inputs, lambda x: x + 1) as answer,
      2000 as per_call, 30 as each, 1 as pair from examples
    union all select queue_key, 1, 'second', list_transform(inputs, lambda x: x + 1),
      list_transform(inputs, lambda x: (x + 1) * 2), 500, 7, 0 from examples),
  tried as (select queue_key, stage, name, answer, size, cast(per_call + pair * size * size + each * list_sum(
      list_transform(range(0, size), lambda i: inputs[i % len(inputs) + 1])) as double) as elapsed_us
    from staged cross join (select cast(unnest(range(0, 11)) as int) as e, cast(pow(2, e) as bigint) as size) sizes),
  compared as (select *, elapsed_us / size >= lag(elapsed_us / size) over (
      partition by queue_key, stage order by size) as slower from tried),
  stopped as (select *, coalesce(sum(coalesce(slower, false)::int) over (partition by queue_key, stage order by size
      rows between unbounded preceding and 1 preceding), 0) as stops from compared),
  walked as (select * from stopped where stops = 0),
  chosen as (select queue_key, stage, max(size) as optimal_batch_size, min(elapsed_us / 1000 / size) as time_per_example
    from walked where slower is distinct from true group by queue_key, stage)"""
)


@query(
    "e1_measure",
    f"""with {MEASURED_SQL} select queue_key, cast(run as int) as run, stage, name as stage_name, cast(size as int) as batch_size,
      elapsed_us, round(elapsed_us / size + 1e-9, 6) as time_per_example,
      replace(cast(to_json(answer) as varchar), ',', ', ') as example_output
      from walked cross join (select unnest([0, 1]) as run) r""",
)
def measure(t: Tables) -> DataFrame:
    return rounded(measured(t)).drop("error")


@query(
    "d13_measured_registry",
    f"""with {MEASURED_SQL} select queue_key, name as predictor_name, stage as predictor_sequence,
      cast(optimal_batch_size as int) as optimal_batch_size, round(time_per_example + 1e-9, 6) as time_per_example,
      round(0.01 + 1e-9, 6)::double as request_poll_time,
      round(greatest(0.003, time_per_example / 1000 * 0.51) + 1e-9, 6) as max_wait_seconds,
      replace(cast(to_json(answer) as varchar), ',', ', ') as example_output, 'running' as status
      from staged join chosen using (queue_key, stage)""",
)
def registry(t: Tables) -> DataFrame:
    return rounded(calibration.measured_registry(measured(t)))
