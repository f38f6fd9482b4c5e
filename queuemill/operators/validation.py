"""Admission of requests and the answer envelope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queuemill.sources.requests import read_requests_json

# Texts and codes a client sees.
PICKLE_REFUSED = "pickle input disallowed, use msgpack or json"
UNSUPPORTED = "input_type %s not supported"
UNDECODABLE = "undecodable"
NO_INPUTS = "inputs have to be  msgpack or json"
NO_INPUTS_WITH_PICKLE = "inputs have to be pickle, msgpack or json"
NOT_A_LIST = "inputs have to be a list or tuple"
EMPTY = "empty inputs"
TOO_LARGE = "more than %d inputs in one request"
FAILED = "prediction failed predictor %s"
TIMEOUT = "timeout"
CLIENT_TIMEOUT = "client_timeout"
INPUT_TYPES = ["pickle", "msgpack", "json"]
CONTENT_TYPES = {
    "json": "application/json",
    "pickle": "application/pickle",
    "msgpack": "application/msgpack",
}
COMPRESSED_CONTENT_TYPE = "application/octet-stream"


def validate_requests(
    df: DataFrame,
    allow_pickle: bool = False,
    payload: str = "payload",
    max_request_batch_size: int = 0,
) -> DataFrame:
    """Decode the payload and apply the admission rules in order.

    Payloads are JSON text. Other input types are known but not read here, so theirs are undecodable. Requests
    of more than ``max_request_batch_size`` inputs are refused (0: no limit).

    Adds ``inputs`` (``array<variant>``, NULL if refused), ``n_inputs``, ``reason``, ``success`` and
    ``is_valid``. An empty list is a success that needs no prediction, so it is not valid to queue.
    """
    decoded = read_requests_json(df, payload, "_inputs")
    items = F.expr("try_variant_get(_inputs, '$', 'array<variant>')")
    kind = F.col("input_type")
    refused_type = F.format_string(UNSUPPORTED, F.coalesce(kind, F.lit("None")))
    reason = F.when(
        (kind == "pickle") & F.lit(not allow_pickle), F.lit(PICKLE_REFUSED)
    ).when(
        ~F.coalesce(kind.isin(INPUT_TYPES), F.lit(False)), refused_type
    ).when(
        (kind != "json") | F.col("_inputs").isNull(), F.lit(UNDECODABLE)
    ).when(
        F.expr("is_variant_null(_inputs)"), F.lit(NO_INPUTS_WITH_PICKLE if allow_pickle else NO_INPUTS)
    ).when(
        F.col("_items").isNull(), F.lit(NOT_A_LIST)
    ).when(F.size("_items") == 0, F.lit(EMPTY)).when(
        _too_large(F.size("_items"), max_request_batch_size), F.lit(TOO_LARGE % max_request_batch_size)
    )
    checked = decoded.withColumn("_items", items).withColumn("reason", reason)
    answered_well = F.col("reason").isNull() | (F.col("reason") == EMPTY)
    return checked.select(
        *df.columns,
        F.when(answered_well, F.col("_items")).alias("inputs"),
        F.when(answered_well, F.size("_items")).otherwise(F.lit(0)).alias("n_inputs"),
        "reason",
        answered_well.alias("success"),
        F.col("reason").isNull().alias("is_valid"),
    )


def split_requests(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted for the queue, answered at once)."""
    return validated.filter("is_valid"), validated.filter("not is_valid")


def _too_large(n_inputs: Column, limit: int) -> Column:
    return n_inputs > limit if limit > 0 else F.lit(False)


def limit_request_size(df: DataFrame, max_request_batch_size: int = 0) -> DataFrame:
    """Refuse requests with more inputs than allowed (0 = no limit); needs ``inputs``."""
    too_large = _too_large(F.coalesce(F.size("inputs"), F.lit(0)), max_request_batch_size)
    text = F.lit(TOO_LARGE % max_request_batch_size)
    return df.withColumn("size_reason", F.when(too_large, text)).withColumn(
        "size_ok", F.col("size_reason").isNull()
    )


def assign_request_id(df: DataFrame, content: list[str], request_id: str = "request_id") -> DataFrame:
    """Keep a given id as text; else derive one from the content, so that a retried task agrees.

    ``content`` must name what tells two arrivals apart, such as the source's key or offset beside the payload;
    two rows that agree in all of it are taken for one request and get one id.
    """
    given = F.nullif(F.col(request_id).cast("string"), F.lit(""))
    digest = F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256)
    return df.withColumn(request_id, F.coalesce(given, digest))


def admit_inputs_row(df: DataFrame) -> DataFrame:
    """Initial state of an accepted request."""
    return df.withColumns(
        {
            "n_inputs": F.size("inputs"),
            "last_stage": F.lit(-1),
            "success": F.lit(True),
            "timed_out": F.lit(None).cast("boolean"),
            "delivered_us": F.lit(None).cast("bigint"),
        }
    )


def status_of(last_stage: int) -> Column:
    done = F.col("success").eqNullSafe(True) & (F.col("last_stage") == last_stage)
    return (
        F.when(F.col("timed_out").eqNullSafe(True), F.lit("timed_out"))
        .when(done, F.lit("done"))
        .when(F.col("success").eqNullSafe(False), F.lit("failed"))
        .otherwise(F.lit("processing"))
    )


def resolve_status(df: DataFrame, last_stage: int) -> DataFrame:
    """A time-out outranks a result, a result outranks a failure; the rest is in progress."""
    return df.withColumn("status", status_of(last_stage))


def build_response(df: DataFrame, last_stage: int, prediction: str = "outputs") -> DataFrame:
    """Envelope ``response_success, response_reason, prediction``; all NULL while in progress."""
    client = (
        F.col("client_timed_out").eqNullSafe(True)
        if "client_timed_out" in df.columns
        else F.lit(False)
    )
    status = F.col("status")
    reason = (
        F.when((status == "timed_out") & client, F.lit(CLIENT_TIMEOUT))
        .when(status == "timed_out", F.lit(TIMEOUT))
        .when(
            status == "failed",
            F.format_string(FAILED, F.col("last_stage").cast("string")),
        )
    )
    answered = resolve_status(df, last_stage).withColumns(
        {
            "response_success": F.when(status != "processing", status == "done"),
            "response_reason": reason,
            "_prediction": F.when(status == "done", F.col(prediction)),
        }
    )
    return answered.drop(prediction).withColumnRenamed("_prediction", "prediction")


def http_status(df: DataFrame) -> DataFrame:
    """``status_code`` and ``content_type`` from ``refused``, ``response_success``, ``input_type``.

    A missing input type counts as JSON; a compressed answer is an octet stream whatever its type.
    """
    kind = F.coalesce(F.col("input_type"), F.lit("json"))
    by_type = F.lit(None).cast("string")
    for name, content_type in CONTENT_TYPES.items():
        by_type = F.when(kind == name, F.lit(content_type)).otherwise(by_type)
    compressed = (
        F.coalesce(F.col("compressed"), F.lit(False)) if "compressed" in df.columns else F.lit(False)
    )
    return df.withColumns(
        {
            "status_code": F.when(F.col("refused"), F.lit(400))
            .when(F.col("response_success"), F.lit(200))
            .when(~F.col("response_success"), F.lit(500)),
            "content_type": F.when(compressed, F.lit(COMPRESSED_CONTENT_TYPE)).otherwise(by_type),
        }
    )
