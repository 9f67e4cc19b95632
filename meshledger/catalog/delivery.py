"""Queries on what delivery and the inventory do to a job: repeats, refusals, values that move between fields, ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshledger.catalog.observe import arrival, as_requests, entity, over_tasks, query, table
from meshledger.functions.scalars import arrival_order, log_id
from meshledger.operators.salts import dealt
from meshledger.plans.reconcile import reconcile
from meshledger.schemas import ERROR
from meshledger.sources.state import empty_state


@query("steady_moved_field", """
SELECT s_suppkey, i AS place, CASE WHEN i = 1 THEN 'create' ELSE 'update' END AS change_type,
  'v' || s_suppkey AS facility, CASE WHEN i > 1 THEN 'v' || s_suppkey END AS comments,
  CASE WHEN i > 2 THEN 'v' || s_suppkey END AS description FROM supplier, range(1, 4) AS t(i)""")
def steady_moved_field(spark, folder):
    """A value that wanders from field to field is an observation of its own each time."""
    k = F.col("s_suppkey")
    value = F.concat(F.lit("v"), k.cast("string"))
    seen = [entity(site={"name": F.col("s_name"), field: value}) for field in ("facility", "comments", "description")]
    rows = table(spark, folder, "supplier").select("s_suppkey", "s_name", F.posexplode(F.array(*seen)).alias("i", "seen"))
    changes = reconcile(as_requests(rows, k * 10 + F.col("i"), F.array("seen")), empty_state(spark)).changes
    data = F.from_json("data", "facility STRING, comments STRING, description STRING")
    return changes.select(F.floor(arrival() / 10).alias("s_suppkey"), (arrival() % 10 + 1).alias("place"), "change_type",
                          data.alias("d")).select("s_suppkey", "place", "change_type", "d.*")


@query("repeated_requests", """
SELECT event_id, state, 1 AS n FROM events, (VALUES ('RECONCILED'), ('NO_CHANGES')) AS s(state)""")
def repeated_requests(spark, folder):
    """Every request comes twice, with one id and arrival time: the second finds nothing to change."""
    k = F.col("event_id")
    once = as_requests(over_tasks(table(spark, folder, "events").select("event_id", "event_type"), "event_id"), k, F.array(entity(site={
        "name": F.concat(F.lit("e"), k.cast("string")), "description": F.col("event_type")})))
    twice = once.unionAll(once)
    log = dealt(reconcile(twice, empty_state(spark)).log, twice.count(), "ingestion_ts")
    return log.groupBy(F.col("ingestion_ts").alias("event_id"), "state").agg(F.countDistinct("id").alias("n"))


@query("reconcile_refused", """
SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'FAILED' ELSE 'RECONCILED' END AS first_state,
  CASE WHEN s_suppkey % 5 = 0 THEN 'create' ELSE 'update' END AS second_change,
  CASE WHEN s_suppkey % 5 != 0 THEN 'bad' END AS facility, 'c' AS comments FROM supplier""")
def reconcile_refused(spark, folder):
    """The inventory refuses every fifth first change set: what it asked for is not in the state, and the
    next request creates the object."""
    k = F.col("s_suppkey")
    rows = table(spark, folder, "supplier")
    first = as_requests(rows, k * 2, F.array(entity(site={"name": F.col("s_name"), "facility": F.lit("bad")})))
    second = as_requests(rows, k * 2 + 1, F.array(entity(site={"name": F.col("s_name"), "comments": F.lit("c")})))
    refusal = F.struct(F.lit("refused").alias("message"), F.lit(400).alias("code"),
                       F.lit(None).cast(ERROR["details"].dataType).alias("details"))
    at = arrival_order(F.col("ingestion_ts"), F.col("id"), F.lit(0))
    answers = first.where(F.col("ingestion_ts") % 10 == 0).select(F.md5(at).alias("change_set_id"), refusal.alias("apply_error"))
    result = reconcile(first.unionAll(second), empty_state(spark), answers)
    of = lambda time: F.floor(time / 2).alias("s_suppkey")
    states = result.log.where("ingestion_ts % 2 = 0").select(of(F.col("ingestion_ts")), F.col("state").alias("first_state"))
    changes = result.changes.where(arrival() % 2 == 1).select(
        of(arrival()), F.col("change_type").alias("second_change"), "object_key")
    held = result.state.select("object_key", "facility", "comments")
    return changes.join(held, "object_key").join(states, "s_suppkey").drop("object_key")


@query("log_id_unique", """
SELECT o_orderkey, 6 AS ids, true AS in_order FROM orders""")
def log_id_unique(spark, folder):
    """Positions of any size, and repeated deliveries, have ids of their own, which sort as they came."""
    k = F.col("o_orderkey")
    places = F.array(*[F.struct(F.lit(c).alias("copy"), F.lit(p).alias("position"))
                       for c in (0, 1) for p in (99, 100_000, 1_000_001)])
    ids = F.transform(places, lambda x: log_id(k, F.concat(F.lit("r"), k.cast("string")), x["position"], x["copy"]))
    return table(spark, folder, "orders").select(
        "o_orderkey", F.size(F.array_distinct(ids)).cast("bigint").alias("ids"), (F.array_sort(ids) == ids).alias("in_order"))
