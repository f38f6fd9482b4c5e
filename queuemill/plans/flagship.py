"""The flagship plan: raw payloads in, an answer for every request out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuemill.operators import validation as V
from queuemill.operators.inference import Stage, chain
from queuemill.plans.registry import query
from queuemill.plans.requests import VALIDATED_SQL
from queuemill.plans.views import Tables

REQUESTS_PER_QUEUE = 16


def square(inputs: list, batch_size: int = 1) -> list:
    return [x * x for x in inputs]


def answer_requests(raw: DataFrame, stages: list[Stage]) -> DataFrame:
    """Validate, predict what is valid in batches, and build every request's answer in one pass.

    ``raw`` has request_id, payload, input_type, queue_key and received_us; inputs are whole numbers.
    Refused and empty requests travel along, past the stages.
    """
    last = len(stages) - 1
    checked = V.validate_requests(raw)
    numbers = F.transform("inputs", lambda v: F.try_variant_get(v, "$", "bigint"))
    queued = checked.select(
        "request_id", "input_type", "queue_key", "received_us", "reason", "is_valid",
        F.col("success").alias("admitted"), numbers.alias("inputs"),
    )
    scored = chain(queued, stages, admit=F.col("is_valid")).withColumn(
        "timed_out", F.lit(None).cast("boolean")
    )
    done = V.build_response(V.resolve_status(scored, last), last)
    valid, admitted = F.col("is_valid"), F.col("admitted")
    empty = F.array().cast(done.schema["prediction"].dataType)
    answered = done.select(
        "request_id",
        "input_type",
        (~admitted).alias("refused"),
        F.when(valid, F.col("response_success")).otherwise(admitted).alias("response_success"),
        F.when(valid, F.col("response_reason")).otherwise(F.col("reason")).alias("response_reason"),
        F.when(valid, F.col("prediction")).when(admitted, empty).alias("prediction"),
    )
    return V.http_status(answered)


@query(
    "flagship_answer_requests",
    f"""with {VALIDATED_SQL}, squares as (select request_id, sum(length(input) * length(input)) as s
      from turns group by request_id)
      select v.request_id, v.success as response_success, v.reason as response_reason,
      case when v.success then 200 else 400 end as status_code,
      case when v.success then cast(v.n_inputs as bigint) end as n_predictions,
      cast(case when v.is_valid then s.s + v.n_inputs when v.success then 0 end as bigint)
        as prediction_sum from validated v join squares s using (request_id)""",
)
def flagship(t: Tables) -> DataFrame:
    raw = t.raw_requests.withColumns(
        {"queue_key": F.floor(F.col("conv_id") / REQUESTS_PER_QUEUE), "received_us": F.col("conv_id") * 1000}
    )
    stages = [
        Stage.from_function(square, "bigint", 32),
        Stage.from_expression(lambda x: x + 1, "bigint", "plus_one"),
    ]
    total = F.aggregate("prediction", F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    return answer_requests(raw, stages).select(
        "request_id", "response_success", "response_reason", "status_code",
        F.size("prediction").cast("bigint").alias("n_predictions"), total.alias("prediction_sum"),
    )
