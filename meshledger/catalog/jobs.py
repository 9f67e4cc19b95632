"""Queries that run the whole job: change sets, propagation, order, state and log."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshledger.catalog.observe import arrival, as_requests, entity, only_if, over_tasks, query, table
from meshledger.catalog.state import stored_rows, text
from meshledger.functions.scalars import assigned_id, natural_key
from meshledger.operators.changes import assemble_change_sets, count_changes, roots_without_changes
from meshledger.operators.flatten import classify_roots, explode_entities
from meshledger.plans.reconcile import find_changes, reconcile
from meshledger.sources.state import empty_state


def observed_sites(spark, folder):
    """Every supplier observes the site of its nation; every eleventh has no name."""
    k = F.col("s_suppkey")
    rows = table(spark, folder, "supplier").join(
        table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    seen = entity(site={
        "name": F.when(k % 11 == 0, "").otherwise(F.col("n_name")),
        "status": F.when(k % 5 == 0, "planned").otherwise(""),
        "description": F.when(k % 3 == 0, F.concat(F.lit("d"), (k % 6).cast("string")))})
    return as_requests(rows, k, F.array(seen))


def stored_sites(spark, folder):
    return stored_rows(table(spark, folder, "nation").where("n_nationkey % 7 != 0"), "dcim.site", F.col("n_name"),
                       F.col("n_nationkey") + 1, slug=F.lower("n_name"), status=F.lit("active"))


SITES_SQL = """
WITH o AS (SELECT s_suppkey AS k, n_name AS name, n_nationkey AS nk, n_nationkey % 7 != 0 AS stored,
    CASE WHEN s_suppkey % 5 = 0 THEN 'planned' END AS status,
    CASE WHEN s_suppkey % 3 = 0 THEN 'd' || (s_suppkey % 6) END AS descr
  FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 11 != 0),
r AS (SELECT *, row_number() OVER (PARTITION BY nk ORDER BY k) AS nth,
    last_value(status IGNORE NULLS) OVER w AS old_status, last_value(descr IGNORE NULLS) OVER w AS old_descr,
    last_value(status IGNORE NULLS) OVER c AS new_status, last_value(descr IGNORE NULLS) OVER c AS new_descr FROM o
  WINDOW w AS (PARTITION BY nk ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    c AS (PARTITION BY nk ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
f AS (SELECT *, CASE WHEN nth = 1 AND NOT stored THEN 'create'
    WHEN coalesce(old_status, 'active') != coalesce(new_status, 'active') OR
         coalesce(old_descr, '') != coalesce(new_descr, '') THEN 'update' END AS change_type FROM r)"""


@query("reconcile_sites", SITES_SQL + """
SELECT k AS s_suppkey, change_type, 'dcim.site' AS object_type,
  CASE WHEN change_type = 'update' AND stored THEN nk + 1 END AS stored_id, name, lower(replace(name, ' ', '-')) AS slug,
  coalesce(new_status, 'active') AS status, new_descr AS description FROM f WHERE change_type IS NOT NULL""")
def reconcile_sites(spark, folder):
    result = reconcile(observed_sites(spark, folder), stored_sites(spark, folder))
    data = F.from_json("data", "name STRING, slug STRING, status STRING, description STRING")
    return result.changes.select(
        arrival().alias("s_suppkey"), "change_type", "object_type",
        F.when(F.col("object_id") != assigned_id(F.col("object_type"), F.col("object_key")), F.col("object_id")).alias("stored_id"), data.alias("d")).select(
        "s_suppkey", "change_type", "object_type", "stored_id", "d.*")


@query("apply_upsert", SITES_SQL + """
, fin AS (SELECT nk, arg_max(coalesce(new_status, 'active'), k) AS status, arg_max(new_descr, k) AS d FROM r GROUP BY 1)
SELECT n_name AS name, coalesce(fin.status, 'active') AS status, coalesce(fin.d, '-') AS description
FROM nation LEFT JOIN fin ON nk = n_nationkey WHERE n_nationkey % 7 != 0 OR nk IS NOT NULL""")
def apply_upsert(spark, folder):
    """The state after the batch."""
    state = reconcile(observed_sites(spark, folder), stored_sites(spark, folder)).state
    return state.select(F.col("object_key").alias("name"), "status",
                        F.coalesce("description", F.lit("-")).alias("description"))


@query("reconcile_log", SITES_SQL + """
SELECT s_suppkey, CASE WHEN s_suppkey % 11 = 0 THEN 'FAILED' WHEN change_type IS NULL THEN 'NO_CHANGES'
  ELSE 'RECONCILED' END AS state FROM supplier JOIN nation ON n_nationkey = s_nationkey
  LEFT JOIN f ON k = s_suppkey""")
def reconcile_log(spark, folder):
    log = reconcile(observed_sites(spark, folder), stored_sites(spark, folder)).log
    return log.select(F.col("ingestion_ts").alias("s_suppkey"), "state")


@query("no_change_roots", SITES_SQL + """
SELECT k AS s_suppkey FROM f WHERE change_type IS NULL""")
def no_change_roots(spark, folder):
    roots = classify_roots(explode_entities(observed_sites(spark, folder))).where("root_error IS NULL")
    changes = find_changes(roots, stored_sites(spark, folder))
    return roots_without_changes(roots.select("seq"), changes).select(arrival().alias("s_suppkey"))


def union_states(*states):
    out = states[0]
    for more in states[1:]:
        out = out.unionByName(more)
    return out


def device_state(spark, folder, every="true", roles="true"):
    """Sites of all nations, a role per market segment, one device type, and the customers' devices."""
    nation, customer = table(spark, folder, "nation"), table(spark, folder, "customer")
    segments = customer.groupBy("c_mktsegment").agg(
        F.min("c_custkey").alias("k")).where(roles)
    one = spark.range(1)
    devices = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).where(every)
    undefined = F.lit("undefined")
    return union_states(
        stored_rows(nation, "dcim.site", F.col("n_name"), F.col("n_nationkey") + 1, slug=F.lower("n_name"),
                    status=F.lit("active")),
        stored_rows(segments, "dcim.devicerole", F.col("c_mktsegment"), F.col("k") + 1,
                    slug=F.lower("c_mktsegment"), color=F.lit("000000")),
        stored_rows(one, "dcim.manufacturer", undefined, F.lit(1), slug=undefined),
        stored_rows(one, "dcim.devicetype", natural_key(undefined, undefined), F.lit(1), slug=undefined,
                    ref_manufacturer=undefined),
        stored_rows(devices, "dcim.device", natural_key(F.col("c_name"), F.col("n_name")), F.col("c_custkey") + 1,
                    status=F.lit("active"), ref_site=F.col("n_name"), ref_role=F.col("c_mktsegment"),
                    ref_device_type=natural_key(undefined, undefined)))


@query("reconcile_devices", """
WITH c AS (SELECT c_custkey AS k, c_name AS name, c_mktsegment AS seg, c_custkey % 2 = 0 AND c_mktsegment != 'BUILDING' AS stored
  FROM customer),
b AS (SELECT min(k) AS k FROM c WHERE seg = 'BUILDING' AND k % 5 != 0),
u AS (SELECT min(k) AS k FROM c WHERE k % 5 = 0 AND NOT stored)
SELECT k AS c_custkey, 'create' AS change_type, 'dcim.devicerole' AS object_type, 'BUILDING' AS name FROM b WHERE k IS NOT NULL
UNION ALL SELECT k, 'create', 'dcim.devicerole', 'undefined' FROM u WHERE k IS NOT NULL
UNION ALL SELECT k, 'create', 'dcim.device', name FROM c WHERE NOT stored
UNION ALL SELECT k, 'update', 'dcim.device', name FROM c WHERE stored AND k % 3 = 0""")
def reconcile_devices(spark, folder):
    """Every fifth device comes without a role: a stored device keeps its own, a new one gets a placeholder."""
    k = F.col("c_custkey")
    rows = table(spark, folder, "customer").join(
        table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    seen = entity(device={
        "name": F.col("c_name"), "site": {"name": F.col("n_name")},
        "role": only_if(k % 5 != 0, "device_role", {"name": F.col("c_mktsegment")}),
        "serial": F.when(k % 3 == 0, text("c_custkey", "S"))})
    state = device_state(spark, folder, "c_custkey % 2 = 0 AND c_mktsegment != 'BUILDING'",
                         "c_mktsegment != 'BUILDING'")
    changes = reconcile(as_requests(rows, k, F.array(seen)), state).changes
    return changes.select(arrival().alias("c_custkey"), "change_type", "object_type",
                          F.get_json_object("data", "$.name").alias("name"))


def observed_ports(spark, folder):
    k = F.col("o_orderkey")
    customer = table(spark, folder, "customer").join(
        table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = table(spark, folder, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    rows = over_tasks(rows.select("o_orderkey", "o_orderpriority", "o_orderstatus", "c_name", "n_name"), "o_orderkey")
    seen = entity(interface={
        "name": F.concat(F.lit("if"), (k % 4).cast("string")),
        "device": {"name": F.col("c_name"), "site": {"name": F.col("n_name")}},
        "label": F.when(k % 3 != 0, F.col("o_orderpriority")),
        "enabled": F.when(k % 2 == 0, F.col("o_orderstatus") == "F"), "mtu": F.when(k % 7 == 0, 1500 + k % 5)})
    return as_requests(rows, k, F.array(seen))


@query("reconcile_interfaces", """
WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderkey % 4 AS i,
    CASE WHEN o_orderkey % 3 != 0 THEN o_orderpriority END AS label,
    CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus = 'F' END AS enabled,
    CASE WHEN o_orderkey % 7 = 0 THEN 1500 + o_orderkey % 5 END AS mtu
  FROM orders JOIN customer ON c_custkey = o_custkey),
r AS (SELECT *, row_number() OVER (PARTITION BY c, i ORDER BY k) AS nth,
    last_value(label IGNORE NULLS) OVER w AS l0, last_value(enabled IGNORE NULLS) OVER w AS e0,
    last_value(mtu IGNORE NULLS) OVER w AS m0 FROM o
  WINDOW w AS (PARTITION BY c, i ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT k AS o_orderkey, CASE WHEN nth = 1 THEN 'create' ELSE 'update' END AS change_type, 'dcim.interface' AS object_type,
  coalesce(label, l0) AS label, coalesce(enabled, e0) AS enabled, coalesce(mtu, m0) AS mtu, c + 1 AS device_id
FROM r WHERE nth = 1 OR (label IS NOT NULL AND label IS DISTINCT FROM l0)
  OR (enabled IS NOT NULL AND enabled IS DISTINCT FROM e0) OR (mtu IS NOT NULL AND mtu IS DISTINCT FROM m0)""")
def reconcile_interfaces(spark, folder):
    """Repeated observations of interfaces on stored devices whose other parents are not observed."""
    changes = reconcile(observed_ports(spark, folder), device_state(spark, folder)).changes
    data = F.from_json("data", "label STRING, enabled BOOLEAN, mtu BIGINT, device STRUCT<id: BIGINT>")
    return changes.select(arrival().alias("o_orderkey"), "change_type", "object_type", data.alias("d")).select(
        "o_orderkey", "change_type", "object_type", "d.label", "d.enabled", "d.mtu",
        F.col("d.device.id").alias("device_id"))


def observed_facilities(spark, folder):
    k = F.col("c_custkey")
    rows = table(spark, folder, "customer").join(
        table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    seen = entity(device={
        "name": F.col("c_name"),
        "site": {"name": F.col("n_name"),
                 "facility": F.when(k % 10 == 0, F.concat(F.lit("F"), (k % 3).cast("string")))},
        "serial": F.when(k % 4 == 0, text("c_custkey", "S"))})
    return as_requests(rows, k, F.array(seen))


FACILITY_SQL = """
WITH c AS (SELECT c_custkey AS k, n_nationkey AS nk, n_name AS site,
    CASE WHEN c_custkey % 10 = 0 THEN 'F' || (c_custkey % 3) END AS fac, c_custkey % 4 = 0 AS serial
  FROM customer JOIN nation ON n_nationkey = c_nationkey),
r AS (SELECT *, last_value(fac IGNORE NULLS) OVER (PARTITION BY nk ORDER BY k
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS old FROM c),
f AS (SELECT *, fac IS NOT NULL AND fac IS DISTINCT FROM old AS moved FROM r)"""


@query("change_propagation", FACILITY_SQL + """
SELECT k AS c_custkey, 'dcim.site' AS object_type, NULL AS site_id, NULL AS site_facility FROM f WHERE moved
UNION ALL SELECT k, 'dcim.device', nk + 1, CASE WHEN moved THEN fac END FROM f WHERE moved OR serial""")
def change_propagation(spark, folder):
    """A changed site is embedded in full in its device and changes it; an unchanged one is its id."""
    roots = classify_roots(explode_entities(observed_facilities(spark, folder)))
    changes = find_changes(roots, device_state(spark, folder))
    site = F.from_json("data", "site STRUCT<id: BIGINT, facility: STRING>")["site"]
    return changes.where("object_type IN ('dcim.site', 'dcim.device')").select(
        arrival().alias("c_custkey"), "object_type", site["id"].alias("site_id"), site["facility"].alias("site_facility"))


@query("reference_collapse", FACILITY_SQL + """
SELECT k AS c_custkey, '{"id":' || (nk + 1) || '}' AS site FROM f WHERE serial AND NOT moved""")
def reference_collapse(spark, folder):
    roots = classify_roots(explode_entities(observed_facilities(spark, folder)))
    changes = find_changes(roots, device_state(spark, folder))
    site = F.get_json_object("data", "$.site")
    return changes.where(F.col("object_type") == "dcim.device").select(
        arrival().alias("c_custkey"), site.alias("site")).where(F.json_object_keys("site") == F.array(F.lit("id")))


def observed_machines(spark, folder):
    """Machines whose cluster repeats their new site, so that it appears twice below one root."""
    own = {n: text("s_suppkey", n) for n in ("site", "group", "type", "role", "cluster", "vm")}
    site = {"name": own["site"]}
    seen = entity(virtual_machine={
        "name": own["vm"], "site": site, "role": {"name": own["role"]},
        "cluster": {"name": own["cluster"], "site": site, "group": {"name": own["group"]},
                    "type": {"name": own["type"]}, "tags": None}})
    return as_requests(table(spark, folder, "supplier"), F.col("s_suppkey"), F.array(seen))


MACHINE_TYPES = ("dcim.site", "virtualization.clustertype", "virtualization.clustergroup", "virtualization.cluster",
                 "dcim.devicerole", "virtualization.virtualmachine")
_LIST = ", ".join(f"'{t}'" for t in MACHINE_TYPES)


def machine_changes(spark, folder):
    return find_changes(classify_roots(explode_entities(observed_machines(spark, folder))), empty_state(spark))


@query("change_order", f"""
SELECT s_suppkey, i AS ord, [{_LIST}][i] AS object_type FROM supplier, range(1, 7) AS t(i)""")
def change_order(spark, folder):
    return machine_changes(spark, folder).select(
        arrival().alias("s_suppkey"), F.col("ord").cast("bigint"), "object_type")


@query("content_dedup", """
SELECT s_suppkey, 1 AS sites FROM supplier""")
def content_dedup(spark, folder):
    """The site the machine and its cluster share is created once per change set."""
    sites = machine_changes(spark, folder).where("object_type = 'dcim.site'")
    return sites.groupBy(arrival().alias("s_suppkey")).agg(F.count("*").alias("sites"))


@query("change_sets", f"""
SELECT s_suppkey, md5(lpad(CAST(s_suppkey AS VARCHAR), 20, '0') || chr(1) || 'r' || s_suppkey || chr(1) || '0000000000') AS change_set_id,
  '{",".join(MACHINE_TYPES)}' AS types FROM supplier""")
def change_sets(spark, folder):
    sets = assemble_change_sets(machine_changes(spark, folder))
    return sets.select(arrival().alias("s_suppkey"), "change_set_id",
                       F.array_join("change_set.object_type", ",").alias("types"))


@query("change_counts", FACILITY_SQL + """
SELECT 'dcim.site' AS object_type, 'update' AS change_type, count(*) AS n FROM f WHERE moved HAVING count(*) > 0
UNION ALL SELECT 'dcim.device', 'update', count(*) FROM f WHERE moved OR serial""")
def change_counts(spark, folder):
    roots = classify_roots(explode_entities(observed_facilities(spark, folder)))
    state = device_state(spark, folder)
    return count_changes(find_changes(roots, state))
