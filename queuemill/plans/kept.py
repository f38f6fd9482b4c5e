"""Plans: the verbs on a request table that is stored by key (group C)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuemill.operators import stored
from queuemill.plans.registry import ORACLES, query
from queuemill.plans.verbs import AS_OF_US, WEEK_US, upsert_inputs
from queuemill.plans.views import LOG_SQL, Tables
from queuemill.session import scratch_path

BUCKETS = 16


def keep(t: Tables, df: DataFrame) -> stored.StoredTable:
    return stored.create(df, f"requests_{uuid.uuid4().hex}", BUCKETS, path=scratch_path(t.spark, "kept"))


@query("c5_get_stored", ORACLES["c5_get"])
def get(t: Tables) -> DataFrame:
    """Only the ids are shuffled."""
    table = keep(t, t.request_log)
    ids = t.read("labels").select(F.col("doc_id").alias("request_id"))
    return table.get_all(ids, ["success", "last_stage", "timed_out"])


@query("c6_upsert_stored", ORACLES["c6_upsert"])
def upsert(t: Tables) -> DataFrame:
    """Updates come in two epochs, and both run a second time, as after a failure."""
    base, updates = upsert_inputs(t)
    table = keep(t, base)
    merge = table.merge_epochs(lambda: F.col("version"))
    for epoch in range(2):
        part = updates.filter(F.pmod("request_id", F.lit(2)) == epoch)
        merge(part, epoch)
        merge(part, epoch)
    return table.read()


@query("c7_delete_stored", ORACLES["c7_delete"])
def delete(t: Tables) -> DataFrame:
    table = keep(t, t.request_log.select("request_id", "queue_key", "delivered_us"))
    table.delete({"$and": [{"delivered_us": {"$gt": 0}}, {"delivered_us": {"$lt": AS_OF_US - WEEK_US}}]})
    return table.read().select("request_id", "queue_key")


@query(
    "c5_get_few",
    f"""with {LOG_SQL} select request_id, k, n_inputs from request_log
      where request_id in (select item_id from (select row_number() over (order by event_id) - 1 as item_id from events)
        where item_id % 500 = 7)""",
)
def get_few(t: Tables) -> DataFrame:
    """Ids that the caller names: other files are not opened."""
    table = keep(t, t.request_log)
    n = t.events.count()
    return table.get(range(7, n, 500), ["k", "n_inputs"])
