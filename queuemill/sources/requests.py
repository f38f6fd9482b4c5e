"""Request readers: JSON payloads, array files, binary files and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from queuemill.operators.ordering import global_index
from queuemill.session import stored
from queuemill.sources.arrays import read_array_elements


def read_requests_json(df: DataFrame, payload: str = "payload", name: str = "inputs") -> DataFrame:
    """Parse the JSON text of each request into a ``variant``; ``{"data": X}`` is unwrapped to X.

    NULL means undecodable text; JSON ``null`` stays a variant null.
    """
    parsed = df.withColumn("_parsed", F.try_parse_json(payload))
    wrapped = F.try_variant_get("_parsed", "$.data", "variant")
    return parsed.withColumn(name, F.coalesce(wrapped, "_parsed")).drop("_parsed")


def read_request_array_file(spark: SparkSession, path: str) -> DataFrame:
    """JSON files that each hold one array of inputs: one row per input, with its position.

    Large files are read by several tasks (see :mod:`queuemill.sources.arrays`). A file that holds something else than
    an array gives no rows; an array that is broken off, or an element that is no JSON, ends the job.
    """
    # wrapped, since the parser does not look behind the end of a value
    wrapped = F.parse_json(F.concat(F.lit('[{"x":'), "text", F.lit("}]")))
    return read_array_elements(spark, path).select(
        "path", "pos", F.variant_get(wrapped, "$[0].x", "variant").alias("input")
    )


def read_binary_requests(
    spark: SparkSession, path: str, glob: str | None = None, recursive: bool = False
) -> DataFrame:
    """Files as inputs, in path order; answer i goes to ``output_file_{i+1}``.

    Names are numbered from the file listing alone, so the contents never take part in the sort. The numbers are
    stored as a table, whose size the planner knows: up to its broadcast threshold the contents stay where they are
    read, beyond it they travel once, to be joined.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path)
    numbered = stored(global_index(files.select("path"), ["path"], name="index"), "file-numbers")
    return files.join(numbered, "path").select(
        "path",
        F.element_at(F.split("path", "/"), -1).alias("name"),
        F.coalesce(
            F.nullif(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1), F.lit("")), F.lit("unknown")
        ).alias("type"),
        F.col("length").alias("n_bytes"),
        "content",
        F.concat(F.lit("output_file_"), F.col("index") + 1).alias("output_name"),
    )


def read_request_stream(
    spark: SparkSession,
    path: str,
    schema: StructType | str,
    max_files: int | None = None,
    glob: str | None = None,
) -> DataFrame:
    """Parquet folder as a stream: files that arrive are picked up once, ``max_files`` per trigger."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)
