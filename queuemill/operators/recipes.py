"""Which stages there are, in which order, and how each one is tuned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from queuemill.functions.scalars import max_wait_seconds

# File names that make a stage.
SINGLE_STAGE = "predictor.py"
NUMBERED_STAGE = r"^predictor_([0-9]+)\.(.*\.)?py$"


def order_stages(names: DataFrame, name: str = "name", recipe: str = "recipe") -> DataFrame:
    """Stage number per recipe: files sorted by their number, renumbered densely from 0.

    A plain single-stage file makes the others void. Names are made distinct first, so the window
    of a recipe holds its stage files and not its rows.
    """
    files = names.select(recipe, name).distinct()
    numbered = files.select(
        recipe,
        name,
        F.when(F.col(name) == SINGLE_STAGE, F.lit(0)).otherwise(
            F.nullif(F.regexp_extract(name, NUMBERED_STAGE, 1), F.lit("")).cast("decimal(38,0)")
        ).alias("_number"),
    ).filter(F.col("_number").isNotNull())
    per_recipe = W.partitionBy(recipe)
    is_single = F.col(name) == SINGLE_STAGE
    return (
        numbered.withColumn("_alone", F.max(is_single).over(per_recipe))
        .filter(~F.col("_alone") | is_single)
        .withColumn(
            "sequence",
            F.row_number().over(per_recipe.orderBy("_number", name)) - 1,
        )
        .select(recipe, name, "sequence")
    )


def stage_registry(stages: DataFrame, tuning: DataFrame, key: str | list[str] = "queue_key") -> DataFrame:
    """One row per stage with its batch size, time per example (ms) and the wait that follows from it (s)."""
    return stages.join(tuning, key, "left").withColumns(
        {
            "request_poll_time": F.lit(0.01),
            "max_wait_seconds": max_wait_seconds(F.col("time_per_example") / 1000),
            "status": F.when(F.col("optimal_batch_size").isNull(), "starting").otherwise("running"),
        }
    )
