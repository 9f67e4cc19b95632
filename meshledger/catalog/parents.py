"""Queries on parents that come late: seen without being attached, attached by another change, given blank."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshledger.catalog.jobs import device_state, union_states
from meshledger.catalog.observe import arrival, as_requests, entity, only_if, over_tasks, query, table
from meshledger.catalog.state import stored_rows, text
from meshledger.functions.scalars import natural_key
from meshledger.plans.reconcile import reconcile
from meshledger.sources.state import empty_state


def late_platforms(spark, folder):
    """Every customer's new device is seen four times: bare, with ios, then with a serial (no customer divisible by 3)
    and eos (none that leaves 2), then with ios again."""
    k, step = F.col("c_custkey"), F.col("step")
    rest = k % 3
    # A platform with a blank name would be a placeholder: the third one is left out where it is not meant.
    platform = only_if((step % 2 == 1) | ((step == 2) & (rest != 2)), "platform", {"name": F.when(step == 2, "eos").otherwise("ios")})
    seen = entity(device={"name": F.col("c_name"), "site": {"name": F.col("n_name")}, "platform": platform,
                          "serial": F.when((step == 2) & (rest != 0), text("c_custkey", "S"))})
    rows = table(spark, folder, "customer").join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = over_tasks(rows.select("c_custkey", "c_name", "n_name"), "c_custkey")
    steps = rows.select("*", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("step"))
    return as_requests(steps, k * 4 + step, F.array(seen))


def platform_state(spark, folder):
    """Sites and a device type, two platforms, and the placeholder role."""
    names = F.explode(F.array(F.struct(F.lit("ios").alias("name"), F.lit(1).alias("id")), F.struct(F.lit("eos").alias("name"), F.lit(2).alias("id"))))
    platforms = spark.range(1).select(names.alias("p")).select("p.*")
    undefined = F.lit("undefined")
    return union_states(
        device_state(spark, folder, "false"),
        stored_rows(platforms, "dcim.platform", natural_key(F.col("name"), F.lit("")), F.col("id"), slug=F.col("name")),
        stored_rows(spark.range(1), "dcim.devicerole", undefined, F.lit(1), slug=undefined, color=F.lit("000000")))


@query("late_parent", """
WITH c AS (SELECT c_custkey, c_custkey % 3 AS rest FROM customer)
SELECT c_custkey, 0 AS step, 'create' AS change_type, NULL::BIGINT AS platform_id, CASE WHEN rest = 1 THEN 'ios' END AS held FROM c
UNION ALL SELECT c_custkey, 2, 'update', CASE WHEN rest = 1 THEN 2 END, CASE WHEN rest = 1 THEN 'ios' END FROM c WHERE rest != 0
UNION ALL SELECT c_custkey, 3, 'update', 1, 'ios' FROM c WHERE rest = 1""")
def late_parent(spark, folder):
    """A platform that is seen late is attached only with another change, and only then compared with later ones.
    ``held``: the platform of the device in the end."""
    result = reconcile(late_platforms(spark, folder), platform_state(spark, folder))
    changes = result.changes.where("object_type = 'dcim.device'").select(
        F.floor(arrival() / 4).alias("c_custkey"), (arrival() % 4).alias("step"), "change_type",
        F.get_json_object("data", "$.platform.id").cast("bigint").alias("platform_id"), "object_key")
    held = result.state.where("object_type = 'dcim.device'").select(
        "object_key", F.split_part("ref_platform", F.lit("\x1f"), F.lit(1)).alias("held"))
    return changes.join(held, "object_key").drop("object_key")


@query("blank_parent_kept", """
WITH s AS (SELECT s_suppkey, s_suppkey % 3 AS rest, s_suppkey = min(s_suppkey) OVER () AS first FROM supplier)
SELECT s_suppkey, 0 AS step, 'create' AS change_type, CASE WHEN first THEN 'new' ELSE 'undefined' END AS cluster FROM s
UNION ALL SELECT s_suppkey, 1, 'update', 'undefined' FROM s
UNION ALL SELECT s_suppkey, 2, 'update', 'new' FROM s WHERE rest = 1
UNION ALL SELECT s_suppkey, 3, 'update', CASE WHEN rest = 1 THEN 'real' ELSE 'undefined' END FROM s""")
def blank_parent_kept(spark, folder):
    """A machine is created in a cluster with a blank name, keeps that placeholder when it is seen without any, and moves to
    a real cluster (every third). ``cluster``: which one a change names; ``new`` if it is changed below the same root."""
    k = F.col("s_suppkey")
    name, site = F.col("s_name"), {"name": F.lit("hall")}
    seen = [
        {"name": name, "site": site, "cluster": {"name": F.lit("")}},
        {"name": name, "site": site, "memory": k + 1},
        {"name": name, "site": site, "cluster": {"name": F.when(k % 3 == 1, text("s_suppkey", "real")).otherwise("")}},
        {"name": name, "site": site, "memory": k + 2},
    ]
    rows = table(spark, folder, "supplier").select("s_suppkey", F.posexplode(F.array(*[entity(virtual_machine=m) for m in seen])).alias("step", "seen"))
    result = reconcile(as_requests(rows, k * 4 + F.col("step"), F.array("seen")), empty_state(spark))
    clusters = result.state.where("object_type = 'virtualization.cluster'").select(
        F.col("object_id").alias("id"), F.when(F.col("object_key").startswith("undefined"), "undefined").otherwise("real").alias("cluster"))
    changes = result.changes.where("object_type = 'virtualization.virtualmachine'").select(
        F.floor(arrival() / 4).alias("s_suppkey"), (arrival() % 4).alias("step"), "change_type",
        F.get_json_object("data", "$.cluster.id").cast("bigint").alias("id"))
    return changes.join(clusters, "id", "left").select(
        "s_suppkey", "step", "change_type", F.coalesce("cluster", F.lit("new")).alias("cluster"))
