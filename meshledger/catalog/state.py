"""Queries over observations and state: look-ups, parents, tags, the fold and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meshledger.catalog.ingest import nodes_of, staged_nodes
from meshledger.catalog.observe import arrival, as_requests, entity, only_if, query, shown, table, tag
from meshledger.functions.scalars import key_part, natural_key, scoped_identity
from meshledger.operators.carry import HOT_ROWS, add_chunks, carry_forward
from meshledger.operators.flatten import (
    add_keys, classify_roots, explode_entities, flatten, lay_out, vm_lookup_key,
)
from meshledger.operators.fold import fold_observations, guard_identity
from meshledger.operators.lookup import known_tags, lookup_state, new_tags
from meshledger.operators.resolve import apply_resolution, resolve_parents
from meshledger.operators.tags import attached_tags, tag_links, with_tags
from meshledger.plans.reconcile import limit_for
from meshledger.registry import shape_of
from meshledger.session import stage
from meshledger.sources.state import conform_state, empty_state, wrap_state


def text(column: str, before: str = "") -> Column:
    return F.concat(F.lit(before), F.col(column).cast("string"))


def stored_rows(rows, object_type, key, object_id, **columns):
    return conform_state(rows.select(
        F.lit(object_type).alias("object_type"), key.alias("object_key"),
        object_id.cast("bigint").alias("object_id"), *[c.alias(n) for n, c in columns.items()]))


def part_types(spark, folder):
    seen = entity(device_type={"model": F.col("p_name"), "manufacturer": {"name": F.col("p_brand")}})
    return as_requests(table(spark, folder, "part"), F.col("p_partkey"), F.array(seen))


@query("state_lookup", """
WITH s AS (SELECT p_name, p_brand, min(p_partkey) + 1 AS id FROM part WHERE p_partkey % 3 != 0 GROUP BY 1, 2)
SELECT p_partkey, id AS matched_id FROM part LEFT JOIN s USING (p_name, p_brand)""")
def state_lookup(spark, folder):
    known = table(spark, folder, "part").where("p_partkey % 3 != 0").groupBy("p_name", "p_brand").agg(
        (F.min("p_partkey") + 1).alias("id"))
    state = stored_rows(known, "dcim.devicetype", natural_key(F.col("p_name"), F.col("p_brand")), F.col("id"))
    nodes = nodes_of(part_types(spark, folder)).where("slot = 'device_type'")
    return lookup_state(nodes, state).select(arrival().alias("p_partkey"), "matched_id")


def fold(nodes, state, root_type, attached=None):
    """The fold as the job runs it: columns of the types that a root has, and a key with very many observations is cut into
    chunks. ``nodes`` is staged."""
    return fold_observations(nodes, state, limit_for(nodes, HOT_ROWS), shape=shape_of([root_type]), attached=attached)


def resolved(requests, state):
    roots = classify_roots(explode_entities(requests)).where("root_error IS NULL").select("seq", "entity")
    keyed = stage(add_keys(lay_out(roots)))
    return flatten(apply_resolution(keyed, resolve_parents(keyed, state)))


@query("scoped_lookup", """
WITH e AS (SELECT event_id, 'u' || (user_id % 9) AS name,
                  CASE WHEN event_id % 2 = 0 THEN event_type ELSE '' END AS maker FROM events),
f AS (SELECT name, arg_min(maker, event_id) AS maker FROM e GROUP BY 1),
s AS (SELECT 'u' || r_regionkey AS name, r_name AS maker FROM region)
SELECT event_id, e.name || '|' || CASE WHEN e.maker != '' THEN e.maker ELSE coalesce(s.maker, f.maker) END AS object_key
FROM e JOIN f USING (name) LEFT JOIN s ON s.name = e.name""")
def scoped_lookup(spark, folder):
    """A platform given without its manufacturer is found by name alone."""
    maker = only_if(F.col("event_id") % 2 == 0, "manufacturer", {"name": F.col("event_type")})
    seen = entity(platform={"name": F.concat(F.lit("u"), (F.col("user_id") % 9).cast("string")), "manufacturer": maker})
    region = table(spark, folder, "region")
    state = stored_rows(region, "dcim.platform", natural_key(text("r_regionkey", "u"), F.col("r_name")),
                        F.col("r_regionkey") + 1)
    nodes = resolved(as_requests(table(spark, folder, "events"), F.col("event_id"), F.array(seen)), state)
    return nodes.where("slot = 'platform'").select(arrival().alias("event_id"), shown().alias("object_key"))


@query("machine_lookup_key", """
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name || '|N' || c_nationkey
  ELSE c_name || '||' || c_mktsegment || '|N' || c_nationkey END AS object_key FROM customer""")
def machine_lookup_key(spark, folder):
    site = text("c_nationkey", "N")
    key = vm_lookup_key(F.col("c_name"), F.when(F.col("c_custkey") % 2 == 0, site), F.col("c_mktsegment"), site)
    return table(spark, folder, "customer").select("c_custkey", key.alias("object_key")).withColumn(
        "object_key", shown())


@query("identity_guard", "SELECT c_custkey AS object_id FROM customer WHERE c_custkey % 2 = 0")
def identity_guard(spark, folder):
    """Stored interfaces answering a look-up under another identity do not count as found."""
    k = F.col("c_custkey")
    real = F.when(k % 2 == 0, F.col("c_name")).otherwise("other")
    key = natural_key(F.lit("eth0"), F.col("c_name"), text("c_nationkey", "N"))
    state = stored_rows(table(spark, folder, "customer"), "dcim.interface", key, k,
                        identity=scoped_identity(F.lit("eth0"), real, text("c_nationkey", "N")))
    return guard_identity(state).select("object_id")


def tagged_documents(spark, folder):
    band = F.concat(F.lit("len"), (F.col("n_chars") % 5).cast("string"))
    seen = entity(site={"name": F.concat("source", (F.col("doc_id") % 4).cast("string")),
                        "tags": F.array(tag(F.col("lang")), tag(band))})
    return as_requests(table(spark, folder, "documents"), F.col("doc_id"), F.array(seen))


@query("tag_known_new", """
WITH l AS (SELECT doc_id, lang AS name FROM documents UNION ALL SELECT doc_id, 'len' || (n_chars % 5) FROM documents)
SELECT doc_id, name, name IN (SELECT DISTINCT lang FROM documents) AS known FROM l""")
def tag_known_new(spark, folder):
    links = tag_links(nodes_of(tagged_documents(spark, folder)))
    inventory = table(spark, folder, "documents").select(F.col("lang").alias("name")).distinct()
    shown_links = [known_tags(links, inventory).withColumn("known", F.lit(True)),
                   new_tags(links, inventory).withColumn("known", F.lit(False))]
    return shown_links[0].unionByName(shown_links[1]).select(arrival().alias("doc_id"), "name", "known")


RUNNING_SQL = """
WITH d AS (SELECT doc_id, source || (doc_id % 4) AS site, lang, 'len' || (n_chars % 5) AS band FROM documents),
l AS (SELECT doc_id, site, lang AS tag, 0 AS pos FROM d UNION ALL SELECT doc_id, site, band, 1 FROM d),
seen AS (SELECT tag, min(doc_id) AS first FROM l GROUP BY 1),
att AS (SELECT site, tag, min(doc_id) AS doc, arg_min(pos, doc_id) AS pos FROM l GROUP BY 1, 2),
a AS (SELECT site, att.tag, doc, pos, doc = first AS is_new FROM att JOIN seen USING (tag))"""


def folded_tags(spark, folder):
    nodes, state = staged_nodes(tagged_documents(spark, folder)), empty_state(spark)
    attached = attached_tags(nodes, state, state, None)
    return fold(nodes, state, "dcim.site", attached), attached


@query("running_tags", RUNNING_SQL + """
SELECT doc_id, string_agg(tag, ',' ORDER BY doc, is_new, pos) AS tags
FROM d JOIN a ON a.site = d.site AND a.doc <= d.doc_id GROUP BY 1""")
def running_tags(spark, folder):
    """Tags of a site after each observation: earlier ones, then the known, then the new."""
    folded, attached = folded_tags(spark, folder)
    return with_tags(folded, attached).select(
        arrival().alias("doc_id"), F.array_join(F.transform("tags_after", lambda t: t["name"]), ",").alias("tags"))


@query("new_tags", RUNNING_SQL + """
SELECT doc AS doc_id, tag FROM a WHERE is_new""")
def new_tags_query(spark, folder):
    return folded_tags(spark, folder)[0].select(arrival().alias("doc_id"), F.explode("tags_new.name").alias("tag"))


def partial_devices(spark, folder):
    k, kind = F.col("event_id"), F.col("event_type")
    seen = entity(device={
        "name": text("user_id", "d"), "site": {"name": F.lit("hall")},
        "role": only_if(k % 3 == 0, "device_role", {"name": kind}),
        "platform": only_if(k % 4 == 0, "platform", {"name": F.concat(F.lit("p-"), kind)})})
    return as_requests(table(spark, folder, "events"), k, F.array(seen))


def region_devices(spark, folder):
    """Devices d0 to d4 are stored with a role and a platform of their own."""
    region = table(spark, folder, "region")
    return stored_rows(region, "dcim.device", natural_key(text("r_regionkey", "d"), F.lit("hall")),
                       F.col("r_regionkey") + 1, ref_role=text("r_regionkey", "role"),
                       ref_platform=natural_key(text("r_regionkey", "plat"), F.lit("")))


@query("placeholder_override", """
SELECT event_id, coalesce(last_value(CASE WHEN event_id % 3 = 0 THEN event_type END IGNORE NULLS) OVER (
    PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  CASE WHEN user_id < 5 THEN 'role' || user_id END, 'undefined') AS role FROM events""")
def placeholder_override(spark, folder):
    nodes = resolved(partial_devices(spark, folder), region_devices(spark, folder))
    return nodes.where("slot = 'role'").select(arrival().alias("event_id"), key_part(F.col("object_key"), 1).alias("role"))


@query("parent_keep", """
SELECT event_id, platform, event_id % 4 != 0 AS kept FROM (
SELECT event_id, coalesce(last_value(CASE WHEN event_id % 4 = 0 THEN 'p-' || event_type END IGNORE NULLS) OVER (
    PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  CASE WHEN user_id < 5 THEN 'plat' || user_id END) AS platform FROM events) WHERE platform IS NOT NULL""")
def parent_keep(spark, folder):
    nodes = resolved(partial_devices(spark, folder), region_devices(spark, folder))
    return nodes.where("slot = 'platform'").select(
        arrival().alias("event_id"), key_part(F.col("object_key"), 1).alias("platform"), "kept")


LINE_KEYS = ["l_orderkey", "l_linenumber"]
LINE_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
              "l_returnflag", "l_linestatus"]


@query("carry_forward_fold", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
  last_value(CASE WHEN l_partkey % 3 != 0 THEN l_returnflag END IGNORE NULLS) OVER w AS flag,
  last_value(CASE WHEN l_suppkey % 2 = 0 THEN l_quantity END IGNORE NULLS) OVER w AS quantity
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(LINE_ORDER)}
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def carry_forward_fold(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        *LINE_KEYS, *LINE_ORDER, F.when(F.col("l_partkey") % 3 != 0, F.col("l_returnflag")).alias("flag"),
        F.when(F.col("l_suppkey") % 2 == 0, F.col("l_quantity")).alias("quantity"))
    rows, chunked = add_chunks(rows, LINE_KEYS, "l_shipdate", None)
    done = carry_forward(rows, LINE_KEYS, LINE_ORDER, ["flag", "quantity"], chunked=chunked)
    return done.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
                       F.coalesce("flag", "before_flag").alias("flag"),
                       F.coalesce("quantity", "before_quantity").alias("quantity"))


def observed_disks(spark, folder):
    k = F.col("o_orderkey")
    seen = entity(virtual_disk={
        "name": F.concat(F.lit("k"), (k % 3).cast("string")), "virtual_machine": {"name": text("o_custkey", "vm")},
        "size": F.when(k % 4 != 0, k % 50).otherwise(0),
        "description": F.when(k % 2 == 0, F.col("o_orderstatus"))})
    return as_requests(table(spark, folder, "orders"), k, F.array(seen))


@query("change_detect", """
WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderkey % 3 AS d,
    CASE WHEN o_orderkey % 4 != 0 THEN nullif(o_orderkey % 50, 0) END AS size,
    CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS descr FROM orders),
p AS (SELECT *, row_number() OVER (PARTITION BY c, d ORDER BY k) AS nth,
    last_value(size IGNORE NULLS) OVER w AS old_size, last_value(descr IGNORE NULLS) OVER w AS old_descr FROM o
  WINDOW w AS (PARTITION BY c, d ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT k AS o_orderkey, CASE WHEN nth = 1 THEN 'create'
  WHEN size IS DISTINCT FROM old_size OR (descr IS NOT NULL AND descr IS DISTINCT FROM old_descr) THEN 'update'
  ELSE 'none' END AS change FROM p""")
def change_detect(spark, folder):
    """A carried description, and a size that is compared as observed."""
    folded = fold(staged_nodes(observed_disks(spark, folder)), empty_state(spark), "virtualization.virtualdisk")
    change = F.when(F.col("created"), "create").when(F.col("fields_differ"), "update").otherwise("none")
    return folded.where("slot = 'virtual_disk'").select(arrival().alias("o_orderkey"), change.alias("change"))


@query("default_fill", """
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'planned' ELSE 'active' END AS status FROM customer""")
def default_fill(spark, folder):
    status = F.when(F.col("c_custkey") % 4 == 0, "planned").otherwise("")
    seen = entity(site={"name": F.col("c_name"), "status": status})
    nodes = staged_nodes(as_requests(table(spark, folder, "customer"), F.col("c_custkey"), F.array(seen)))
    return fold(nodes, empty_state(spark), "dcim.site").select(
        arrival().alias("c_custkey"), F.col("record.status").alias("status"))


@query("first_creator", "SELECT o_orderpriority AS name, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def first_creator(spark, folder):
    """An object new in several roots is created by the earliest."""
    seen = entity(device_role={"name": F.col("o_orderpriority")})
    nodes = staged_nodes(as_requests(table(spark, folder, "orders"), F.col("o_orderkey"), F.array(seen)))
    return fold(nodes, empty_state(spark), "dcim.devicerole").where("created").select(
        F.col("object_key").alias("name"), arrival().alias("o_orderkey"))


@query("snapshot_union", """
SELECT s_suppkey, n_nationkey + 1 AS object_id, coalesce(last_value(CASE WHEN s_suppkey % 3 = 0 THEN 'd' || s_suppkey END
  IGNORE NULLS) OVER (PARTITION BY n_nationkey ORDER BY s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  'region ' || n_regionkey) AS description
FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def snapshot_union(spark, folder):
    """Stored state before all observations, in one ordered feed."""
    nation = table(spark, folder, "nation")
    state = stored_rows(nation, "dcim.site", F.col("n_name"), F.col("n_nationkey") + 1,
                        status=F.lit("active"), description=text("n_regionkey", "region "))
    rows = table(spark, folder, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    seen = entity(site={"name": F.col("n_name"), "description": F.when(F.col("s_suppkey") % 3 == 0, text("s_suppkey", "d"))})
    nodes = staged_nodes(as_requests(rows, F.col("s_suppkey"), F.array(seen)))
    return fold(nodes, state, "dcim.site").select(arrival().alias("s_suppkey"), "object_id",
                                                  F.col("record.description").alias("description"))


@query("wrap_state", """
SELECT 'virtualization.cluster' AS object_type, s_name || '|N' || s_nationkey AS object_key, s_suppkey + 1 AS object_id,
  CASE WHEN s_suppkey % 2 = 0 THEN 'staged' ELSE 'active' END AS status, 'N' || s_nationkey AS site FROM supplier
UNION ALL SELECT DISTINCT 'dcim.site', 'N' || s_nationkey, s_nationkey + 100, 'active', NULL FROM supplier""")
def wrap_state_query(spark, folder):
    """Raw nested objects to typed rows; a choice field comes as text or as value and label."""
    s = table(spark, folder, "supplier")
    site = F.struct((F.col("s_nationkey") + 100).alias("id"), text("s_nationkey", "N").alias("name"),
                    F.struct(F.lit("active").alias("value"), F.lit("Active").alias("label")).alias("status"))
    plain = F.to_json(F.struct((F.col("s_suppkey") + 1).alias("id"), F.col("s_name").alias("name"),
                               F.lit("active").alias("status"), site.alias("site")))
    choice = F.to_json(F.struct((F.col("s_suppkey") + 1).alias("id"), F.col("s_name").alias("name"),
                                F.struct(F.lit("staged").alias("value")).alias("status"), site.alias("site")))
    raw = s.select(F.lit("virtualization.cluster").alias("object_type"), (F.col("s_suppkey") + 1).alias("object_id"),
                   F.when(F.col("s_suppkey") % 2 == 0, choice).otherwise(plain).alias("object"))
    return wrap_state(raw, ("virtualization.cluster",)).select("object_type", shown().alias("object_key"), "object_id", "status",
                                  F.col("ref_site").alias("site"))
