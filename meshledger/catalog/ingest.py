"""Queries over requests: explode, checks, scalar functions, flattening."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from meshledger.catalog.observe import (
    arrival, as_requests, entity, micros, only_if, query, shown, table, tag,
)
from meshledger.functions import scalars as S
from meshledger.operators.flatten import (
    add_keys, classify_roots, explode_entities, flatten, lay_out, without_kept,
)
from meshledger.operators.validate import (
    allowed_requests, enumeration_error, envelope_error, null_entity_errors, object_type_of,
    root_error, source_request_error, virtualization_status_error,
)
from meshledger.plans.constraints import check_constraints
from meshledger.session import stage

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
              "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
LINE_SQL = ("l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, "
            "l_returnflag, l_linestatus, l_shipdate")


def order_requests(spark, folder):
    """One request per order; its lines observe device types, every seventh line number nothing."""
    lines = table(spark, folder, "lineitem")
    grouped = lines.groupBy("l_orderkey").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(*LINE_ORDER, F.col("l_partkey").alias("p")))),
                    lambda x: F.when(x["l_linenumber"] % 7 != 0, x["p"])).alias("parts"))
    entities = F.transform("parts", lambda p: F.when(p.isNotNull(), entity(
        device_type={"model": F.concat(F.lit("P"), p.cast("string"))})))
    return as_requests(grouped, F.col("l_orderkey"), entities)


@query("ingest_explode", f"""
SELECT l_orderkey AS orderkey,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_SQL}) - 1 AS position,
       CASE WHEN l_linenumber % 7 != 0 THEN 'dcim.devicetype' END AS object_type,
       CASE WHEN l_linenumber % 7 != 0 THEN 'P' || l_partkey END AS model
FROM lineitem""")
def ingest_explode(spark, folder):
    rows = explode_entities(order_requests(spark, folder))
    return rows.select(F.col("ingestion_ts").alias("orderkey"), F.col("position").cast("bigint"),
                       object_type_of(F.col("entity")).alias("object_type"),
                       F.col("entity.device_type.model").alias("model"))


@query("null_entities", f"""
WITH e AS (SELECT l_orderkey, l_linenumber,
                  row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_SQL}) - 1 AS position
           FROM lineitem)
SELECT l_orderkey AS orderkey,
       string_agg('entity at index ' || position || ' is nil', '; ' ORDER BY position) AS errors
FROM e WHERE l_linenumber % 7 = 0 GROUP BY 1""")
def null_entities(spark, folder):
    rows = order_requests(spark, folder).select(
        F.col("ingestion_ts").alias("orderkey"), null_entity_errors(F.col("entities")).alias("e"))
    return rows.where(F.size("e") > 0).select("orderkey", F.array_join("e", "; ").alias("errors"))


@query("type_discriminator", """
SELECT event_id, CASE event_type WHEN 'click' THEN 'dcim.site' WHEN 'purchase' THEN 'dcim.manufacturer'
       WHEN 'view' THEN 'dcim.platform' WHEN 'signup' THEN 'dcim.devicerole' END AS object_type
FROM events""")
def type_discriminator(spark, folder):
    name = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    named = {"name": name}
    kind = F.col("event_type")
    seen = F.when(kind == "click", entity(site=named)).when(kind == "purchase", entity(manufacturer=named)) \
        .when(kind == "view", entity(platform=named)).when(kind == "signup", entity(device_role=named))
    rows = table(spark, folder, "events").select("event_id", seen.alias("e"))
    return rows.select("event_id", object_type_of(F.col("e")).alias("object_type"))


@query("envelope_rejects", """
SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'id is empty'
  WHEN event_id % 5 = 0 THEN 'producer app name is empty'
  WHEN event_id % 9 = 4 THEN 'producer app version is empty'
  WHEN event_id % 8 = 3 THEN 'sdk name is empty'
  WHEN event_id % 3 = 0 THEN 'sdk version is empty'
  WHEN event_id % 11 = 0 THEN 'entities is empty' END AS error
FROM events
WHERE event_id % 7 = 0 OR event_id % 5 = 0 OR event_id % 9 = 4 OR event_id % 8 = 3
   OR event_id % 3 = 0 OR event_id % 11 = 0""")
def envelope_rejects(spark, folder):
    k = F.col("event_id")

    def text(full, blank):
        return F.when(blank, "").otherwise(full)

    rows = table(spark, folder, "events").select(
        k, text(k.cast("string"), k % 7 == 0).alias("id"), text("a", k % 5 == 0).alias("producer_app_name"),
        text("1", k % 9 == 4).alias("producer_app_version"), text("s", k % 8 == 3).alias("sdk_name"),
        text("1.0.0", k % 3 == 0).alias("sdk_version"),
        F.when(k % 11 != 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")).alias("entities"))
    return rows.select(k, envelope_error().alias("error")).where("error IS NOT NULL")


@query("source_request_check", """
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'sdk name is empty' WHEN event_id % 6 = 1
  THEN 'sdk version is empty' END AS error FROM events""")
def source_request_check(spark, folder):
    k = F.col("event_id")
    rows = table(spark, folder, "events").select(k, F.when(k % 4 == 0, "").otherwise("s").alias("sdk_name"),
                                                 F.when(k % 6 == 1, "").otherwise("1").alias("sdk_version"))
    return rows.select(k, source_request_error().alias("error"))


@query("root_validity", """
SELECT p_partkey, CASE WHEN p_partkey % 11 = 0
  THEN 'failed to prepare change set: invalid ingest entity' END AS error FROM part""")
def root_validity(spark, folder):
    model = F.when(F.col("p_partkey") % 11 == 0, "").otherwise(F.col("p_name"))
    return table(spark, folder, "part").select(
        "p_partkey", root_error(entity(device_type={"model": model})).alias("error"))


@query("enum_check", """
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN
    CASE WHEN o_orderkey % 4 = 2 THEN 'invalid interface type'
         WHEN o_orderkey % 3 = 1 THEN 'invalid interface mode' END
  ELSE CASE WHEN o_orderkey % 5 = 0 THEN 'invalid IP address status'
            WHEN o_orderkey % 7 = 0 THEN 'invalid IP address role' END END AS error
FROM orders""")
def enum_check(spark, folder):
    k = F.col("o_orderkey")
    port = entity(interface={"name": F.lit("x"), "type": F.when(k % 4 == 2, "laser").otherwise("1000base-t"),
                             "mode": F.when(k % 3 == 1, "odd").when(k % 3 == 2, "").otherwise("tagged")})
    address = entity(ip_address={"address": F.lit("10.0.0.1"), "status": F.when(k % 5 == 0, "lost").otherwise("dhcp"),
                                 "role": F.when(k % 7 == 0, "king").otherwise("")})
    return table(spark, folder, "orders").select(
        k, enumeration_error(F.when(k % 2 == 0, port).otherwise(address)).alias("error"))


@query("virtualization_status_check", """
SELECT s_suppkey, CASE WHEN s_suppkey % 6 = 0 THEN 'invalid virtualization status' END AS error FROM supplier""")
def virtualization_status_check(spark, folder):
    k = F.col("s_suppkey")
    seen = entity(cluster={"name": F.col("s_name"), "status": F.when(k % 6 == 0, "melted").otherwise("staged")})
    return table(spark, folder, "supplier").select(k, virtualization_status_error(seen).alias("error"))


@query("constraint_violations", """
WITH v AS (
  SELECT p_partkey, unnest([
    CASE WHEN p_partkey % 5 = 0 THEN 'device_type.model: max_len' END,
    CASE WHEN NOT regexp_matches(p_name, '^[-a-zA-Z0-9_]+$') THEN 'device_type.slug: pattern' END,
    CASE WHEN p_partkey % 4 = 0 THEN 'device_type.part_number: max_len' END,
    'device_type.manufacturer.slug: min_len', 'device_type.manufacturer.slug: pattern',
    'timestamp: required', 'id: uuid']) AS violation FROM part)
SELECT p_partkey, string_agg(violation, '; ' ORDER BY violation) AS violations
FROM v WHERE violation IS NOT NULL GROUP BY 1""")
def constraint_violations(spark, folder):
    k = F.col("p_partkey")
    seen = entity(device_type={
        "model": F.when(k % 5 == 0, F.repeat(F.lit("m"), 101)).otherwise("m"), "slug": F.col("p_name"),
        "part_number": F.when(k % 4 == 0, F.repeat(F.lit("n"), 51)).otherwise("n"),
        "manufacturer": {"name": F.col("p_brand")}})
    found = check_constraints(as_requests(table(spark, folder, "part"), k, F.array(seen)))
    return found.groupBy(F.substring("id", 2, 20).cast("bigint").alias("p_partkey")).agg(
        F.array_join(F.array_sort(F.collect_list("violation")), "; ").alias("violations"))


@query("constraint_violations_machines", """
WITH v AS (
  SELECT s_suppkey, unnest(CASE WHEN s_suppkey % 2 = 0 THEN [
    CASE WHEN s_suppkey % 3 = 0 THEN 'device.primary_ip4.address: ip' END,
    CASE WHEN s_suppkey % 5 = 0 THEN 'device.primary_ip6.address: ip' END]
  ELSE list_transform([
    CASE WHEN s_suppkey % 3 = 0 THEN 'virtual_machine.device.primary_ip4.address: ip' END,
    CASE WHEN s_suppkey % 5 = 0 THEN 'virtual_machine.device.status: in' END,
    CASE WHEN s_suppkey % 7 = 0 THEN 'virtual_machine.primary_ip4.address: ip' END,
    CASE WHEN s_suppkey % 5 = 0 THEN 'virtual_machine.primary_ip6.address: ip' END],
    lambda x: CASE WHEN s_suppkey % 4 = 3 THEN 'virtual_disk.' || x ELSE x END) END
  || ['timestamp: required', 'id: uuid']) AS violation FROM supplier)
SELECT s_suppkey, string_agg(violation, '; ' ORDER BY violation) AS violations
FROM v WHERE violation IS NOT NULL GROUP BY 1""")
def constraint_violations_machines(spark, folder):
    k = F.col("s_suppkey")

    def address(every, bad, good):
        return {"address": F.when(k % every == 0, bad).otherwise(good), "status": F.lit("active"), "role": F.lit("vip")}

    device = {"name": F.lit("d"), "status": F.lit("active"), "primary_ip4": address(3, "10.0.0.256", "10.0.0.1"),
              "primary_ip6": address(5, "::x", "::1")}
    machine = {"name": F.lit("m"), "status": F.lit("active"), "primary_ip4": address(7, "", "10.0.0.2"),
               "primary_ip6": address(5, "nowhere", "fe80::1"),
               "device": device | {"status": F.when(k % 5 == 0, "lost").otherwise("active"), "primary_ip6": address(1, "::1", "")}}
    seen = (F.when(k % 2 == 0, entity(device=device))
            .when(k % 4 == 3, entity(virtual_disk={"name": F.lit("v"), "virtual_machine": machine}))
            .otherwise(entity(virtual_machine=machine)))
    found = check_constraints(as_requests(table(spark, folder, "supplier"), k, F.array(seen)))
    return found.groupBy(F.substring("id", 2, 20).cast("bigint").alias("s_suppkey")).agg(
        F.array_join(F.array_sort(F.collect_list("violation")), "; ").alias("violations"))


def _repeated(letter, n):
    return letter * n


#: kind -> (an entity that breaks rules, what it breaks, what makes it whole).
BROKEN = {
    "site": ({"name": "", "slug": "a b", "status": "lost", "facility": _repeated("f", 51), "tags": True},
             ("name: min_len", "slug: pattern", "status: in", "facility: max_len", "tags.slug: min_len", "tags.slug: pattern", "tags.color: pattern"),
             {"name": "s", "slug": "s", "status": "active"}),
    "platform": ({"name": _repeated("n", 101), "slug": "ok", "manufacturer": {"name": "", "slug": "ok"}},
                 ("name: max_len", "manufacturer.name: min_len"), {"name": "p", "slug": "p"}),
    "manufacturer": ({"name": "m", "slug": "ok", "description": _repeated("d", 201)}, ("description: max_len",), {"name": "m", "slug": "m"}),
    "device": ({"name": _repeated("n", 65), "serial": _repeated("s", 51), "status": "lost", "device_fqdn": "",
                "primary_ip4": {"address": "10.0.0.1", "status": "odd", "role": "x", "dns_name": "bad name"}},
               ("name: max_len", "serial: max_len", "status: in", "device_fqdn: min_len", "primary_ip4.status: in", "primary_ip4.role: in",
                "primary_ip4.dns_name: pattern"), {"name": "d", "status": "active"}),
    "device_role": ({"name": "r", "slug": "ok", "color": "XYZ"}, ("color: min_len", "color: pattern"),
                    {"name": "r", "slug": "r", "color": "00ff00"}),
    "device_type": ({"model": "", "slug": "ok", "part_number": _repeated("p", 51)}, ("model: min_len", "part_number: max_len"),
                    {"model": "t", "slug": "t"}),
    "interface": ({"name": "", "mtu": 0, "speed": -1, "type": "tin-can", "mode": "access"},
                  ("device: required", "name: min_len", "mtu: gte", "speed: gte", "type: in"),
                  {"name": "e", "type": "virtual", "mode": "access", "mtu": 1500, "device": {"name": "d", "status": "active"}}),
    "ip_address": ({"address": "300.1.1.1", "status": "active", "role": "odd", "dns_name": "a b"},
                   ("address: ip", "role: in", "dns_name: pattern"), {"address": "::1", "status": "active", "role": "vip"}),
    "prefix": ({"prefix": "x", "status": "odd"}, ("prefix: ip", "status: in"), {"prefix": "10.0.0.0", "status": "active"}),
    "cluster_group": ({"name": "g", "slug": ""}, ("slug: min_len", "slug: pattern"), {"name": "g", "slug": "g"}),
    "cluster_type": ({"name": "", "slug": "ok"}, ("name: min_len",), {"name": "t", "slug": "t"}),
    "cluster": ({"name": "c", "status": "odd", "type": {"name": "t", "slug": "&"}}, ("status: in", "type.slug: pattern"),
                {"name": "c", "status": "active"}),
    "virtual_machine": ({"name": "v", "status": "active", "vcpus": -1, "memory": -5, "primary_ip6": {"address": "x", "status": "active", "role": "vip"}},
                        ("vcpus: gte", "memory: gte", "primary_ip6.address: ip"), {"name": "v", "status": "active", "memory": 0}),
    "vminterface": ({"name": _repeated("n", 65), "mtu": 70000}, ("virtual_machine: required", "name: max_len", "mtu: lte"),
                    {"name": "e", "virtual_machine": {"name": "v", "status": "active"}}),
    "virtual_disk": ({"name": "", "size": -1, "virtual_machine": {"name": "v", "status": "odd"}},
                     ("name: min_len", "size: gte", "virtual_machine.status: in"),
                     {"name": "d", "size": 1, "virtual_machine": {"name": "v", "status": "active"}}),
}


def _columns(value):
    if isinstance(value, dict):
        return {k: F.array(tag(F.lit("t"))) if v is True else _columns(v) for k, v in value.items()}
    return value if not isinstance(value, (str, int)) else F.lit(value)


def constraints_of(name: str, kinds: tuple[str, ...]) -> None:
    """A query over all customers: every kind of the group in turn, whole and broken by turns."""
    listed = ", ".join(f"({i}, '{k}.{v}')" for i, k in enumerate(kinds) for v in BROKEN[k][1])

    def run(spark, folder):
        k, seen = F.col("c_custkey"), F.lit(None)
        for i, kind in enumerate(kinds):
            broken, whole = (entity(**{kind: _columns(BROKEN[kind][at])}) for at in (0, 2))
            seen = F.when(k % len(kinds) == i, F.when(F.floor(k / len(kinds)) % 2 == 1, broken).otherwise(whole)).otherwise(seen)
        found = check_constraints(as_requests(table(spark, folder, "customer"), k, F.array(seen)))
        return found.groupBy(F.substring("id", 2, 20).cast("bigint").alias("c_custkey")).agg(
            F.array_join(F.array_sort(F.collect_list("violation")), "; ").alias("violations"))

    query(name, f"""
WITH rules(i, violation) AS (VALUES {listed}),
v AS (SELECT c_custkey, violation FROM customer JOIN rules ON i = c_custkey % {len(kinds)} WHERE c_custkey // {len(kinds)} % 2 = 1
  UNION ALL SELECT c_custkey, unnest(['timestamp: required', 'id: uuid']) FROM customer)
SELECT c_custkey, string_agg(violation, '; ' ORDER BY violation) AS violations FROM v GROUP BY 1""")(run)


constraints_of("constraints_places", ("site", "platform", "manufacturer", "device_role", "device_type"))
constraints_of("constraints_network", ("device", "interface", "ip_address", "prefix"))
constraints_of("constraints_clusters", ("cluster_group", "cluster_type", "cluster", "virtual_machine", "vminterface", "virtual_disk"))


@query("source_allow_list", """
SELECT event_id, event_type AS producer_app_name FROM events
WHERE event_type IN (SELECT event_type FROM events GROUP BY 1 HAVING min(event_id) % 2 = 0)""")
def source_allow_list(spark, folder):
    events = table(spark, folder, "events")
    sources = events.groupBy("event_type").agg(F.min("event_id").alias("m")).where("m % 2 = 0").select(
        F.col("event_type").alias("name"))
    rows = events.select("event_id", F.col("event_type").alias("producer_app_name"))
    return allowed_requests(rows, sources).select("event_id", "producer_app_name")


SLUG_SQL = """trim(regexp_replace(regexp_replace(trim(translate(strip_accents(replace(replace(replace(replace(
  replace(replace(lower({x}), '&', 'and'), '@', 'at'), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), 'þ', 'th')),
  '‒–—―"''’', '----'), ' '), '[^a-z0-9_-]', '-', 'g'), '-+', '-', 'g'), '-_')"""


@query("slug_fill", f"""
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'given' ELSE {SLUG_SQL.format(x='url')} END AS slug
FROM pages""")
def slug_fill(spark, folder):
    given = F.when(F.col("page_id") % 3 == 0, "given").otherwise("")
    return table(spark, folder, "pages").select("page_id", S.fill_slug(given, F.col("url")).alias("slug"))


@query("slug_text", f"SELECT doc_id, md5({SLUG_SQL.format(x='text')}) AS slug_md5 FROM documents")
def slug_text(spark, folder):
    """The slug rule on whole texts in four languages."""
    return table(spark, folder, "documents").select("doc_id", F.md5(S.slugify(F.col("text"))).alias("slug_md5"))


def seen_interfaces(spark, folder):
    """Orders as interfaces: the device is given for every third, its site for every sixth."""
    k = F.col("o_orderkey")
    place = only_if(k % 6 == 0, "site", {"name": F.concat(F.lit("S"), F.col("o_custkey").cast("string"))})
    device = only_if(k % 3 == 0, "device", {
        "name": F.when(k % 9 == 0, "").otherwise(F.concat(F.lit("D"), F.col("o_custkey").cast("string"))), "site": place})
    seen = entity(interface={
        "name": F.concat(F.lit("if"), (k % 4).cast("string")), "device": device,
        "type": F.when(k % 2 == 0, "").otherwise("lag"), "mode": F.when(k % 5 == 0, "").otherwise("access")})
    return as_requests(table(spark, folder, "orders"), k, F.array(seen))


def nodes_of(requests):
    roots = classify_roots(explode_entities(requests)).where("root_error IS NULL").select("seq", "entity")
    return flatten(without_kept(add_keys(lay_out(roots))))


def staged_nodes(requests):
    """Nodes written once, for the steps that read them several times."""
    return stage(nodes_of(requests))


INTERFACE_SQL = """
WITH o AS (SELECT o_orderkey AS k, 'if' || (o_orderkey % 4) AS ifname,
    (o_orderkey % 3 = 0 AND o_orderkey % 9 != 0) AS has_device,
    (o_orderkey % 6 = 0 AND o_orderkey % 9 != 0) AS has_site, o_custkey AS c FROM orders),
n AS (SELECT k, ifname, has_device, has_site, CASE WHEN has_device THEN 'D' || c ELSE 'undefined' END AS device,
    CASE WHEN has_site THEN 'S' || c ELSE 'undefined' END AS site FROM o)"""


@query("placeholder_fill", INTERFACE_SQL + """
SELECT k AS o_orderkey, 'device' AS slot, device AS name, NOT has_device AS placeholder FROM n
UNION ALL SELECT k, 'site', site, NOT has_site FROM n
UNION ALL SELECT k, 'role', 'undefined', true FROM n
UNION ALL SELECT k, 'device_type', 'undefined', true FROM n
UNION ALL SELECT k, 'manufacturer', 'undefined', true FROM n
UNION ALL SELECT k, 'platform', 'undefined', true FROM n WHERE NOT has_device
UNION ALL SELECT k, 'interface', ifname, false FROM n""")
def placeholder_fill(spark, folder):
    return nodes_of(seen_interfaces(spark, folder)).select(
        arrival().alias("o_orderkey"), "slot", S.key_part(F.col("object_key"), 1).alias("name"), "placeholder")


@query("tree_flatten", INTERFACE_SQL + """
, t AS (SELECT k, unnest(CASE WHEN has_device
   THEN ['dcim.manufacturer','dcim.site','dcim.devicerole','dcim.devicetype','dcim.device','dcim.interface']
   ELSE ['dcim.manufacturer','dcim.site','dcim.devicerole','dcim.platform','dcim.devicetype','dcim.device',
         'dcim.interface'] END) AS object_type FROM n)
SELECT k AS o_orderkey, object_type, row_number() OVER (PARTITION BY k ORDER BY CASE object_type
  WHEN 'dcim.manufacturer' THEN 1 WHEN 'dcim.site' THEN 2 WHEN 'dcim.devicerole' THEN 3
  WHEN 'dcim.platform' THEN 4 WHEN 'dcim.devicetype' THEN 5 WHEN 'dcim.device' THEN 6 ELSE 7 END) AS place FROM t""")
def tree_flatten(spark, folder):
    """Every object once, parents before what they hold."""
    order = Window.partitionBy("seq").orderBy("ord")
    return nodes_of(seen_interfaces(spark, folder)).select(
        arrival().alias("o_orderkey"), "object_type", F.row_number().over(order).cast("bigint").alias("place"))


@query("natural_key", INTERFACE_SQL + """
SELECT k AS o_orderkey, 'dcim.interface' AS object_type, ifname || '|' || device || '|' || site AS object_key FROM n
UNION ALL SELECT k, 'dcim.device', device || '|' || site FROM n""")
def natural_key(spark, folder):
    nodes = nodes_of(seen_interfaces(spark, folder)).where("slot IN ('interface', 'device')")
    return nodes.select(arrival().alias("o_orderkey"), "object_type", shown().alias("object_key"))


@query("scoped_identity", INTERFACE_SQL + f"""
SELECT k AS o_orderkey, {SLUG_SQL.format(x="ifname || '-' || device || '-' || site")} AS identity FROM n""")
def scoped_identity(spark, folder):
    nodes = nodes_of(seen_interfaces(spark, folder)).where("slot = 'interface'")
    return nodes.select(arrival().alias("o_orderkey"), S.identity_of_key(F.col("object_key")).alias("identity"))


@query("empty_to_null", """
SELECT o_orderkey, CASE WHEN o_orderkey % 2 != 0 THEN 'lag' END AS interface_type,
       CASE WHEN o_orderkey % 5 != 0 THEN 'access' END AS mode FROM orders""")
def empty_to_null(spark, folder):
    nodes = nodes_of(seen_interfaces(spark, folder)).where("slot = 'interface'")
    return nodes.select(arrival().alias("o_orderkey"), "interface_type", "mode")


@query("tag_projection", """
SELECT doc_id, lang || ':' || lang || ',' || source || ':' || CASE WHEN doc_id % 2 = 0 THEN 'own' ELSE
  trim(regexp_replace(regexp_replace(lower(source), '[^a-z0-9_-]', '-', 'g'), '-+', '-', 'g'), '-_') END AS tags
FROM documents""")
def tag_projection(spark, folder):
    own = F.when(F.col("doc_id") % 2 == 0, F.lit("own")).cast("string")
    second = F.struct(F.col("source").alias("name"), own.alias("slug"), F.lit("").alias("color"))
    seen = entity(site={"name": F.lit("x"), "tags": F.array(tag(F.col("lang")), second)})
    nodes = nodes_of(as_requests(table(spark, folder, "documents"), F.col("doc_id"), F.array(seen)))
    joined = F.array_join(F.transform("tags", lambda t: F.concat(t["name"], F.lit(":"), t["slug"])), ",")
    return nodes.select(arrival().alias("doc_id"), joined.alias("tags"))


@query("ignored_fields", """
SELECT c_custkey, c_name AS name FROM customer""")
def ignored_fields(spark, folder):
    """A machine's device never becomes a node."""
    seen = entity(virtual_machine={"name": F.col("c_name"), "device": {"name": F.lit("host")}})
    nodes = nodes_of(as_requests(table(spark, folder, "customer"), F.col("c_custkey"), F.array(seen)))
    return nodes.where("object_type IN ('virtualization.virtualmachine', 'dcim.device')").select(
        arrival().alias("c_custkey"), S.key_part(F.col("object_key"), 1).alias("name"))


@query("choice_unwrap", "SELECT event_id, event_type AS status FROM events")
def choice_unwrap(spark, folder):
    k, kind = F.col("event_id"), F.col("event_type")
    text = F.when(k % 2 == 0, F.to_json(F.struct(kind.alias("value"), F.upper(kind).alias("label")))).otherwise(kind)
    return table(spark, folder, "events").select(k, S.unwrap_choice(text).alias("status"))


@query("integer_widening", """
SELECT p_partkey, CASE WHEN p_partkey % 3 != 0 THEN CAST(p_size AS BIGINT) END AS memory FROM part""")
def integer_widening(spark, folder):
    k = F.col("p_partkey")
    seen = entity(virtual_machine={"name": F.col("p_name"), "memory": F.when(k % 3 != 0, F.col("p_size"))})
    nodes = nodes_of(as_requests(table(spark, folder, "part"), k, F.array(seen)))
    return nodes.where("slot = 'vm'").select(arrival().alias("p_partkey"), "memory")


@query("timestamp_parse", """
SELECT event_id, CASE WHEN event_id % 4 != 1 THEN event_id * 1000 END AS value,
  CASE WHEN event_id % 4 = 1 THEN 'failed to convert ingestion timestamp: t' || event_id END AS error FROM events""")
def timestamp_parse(spark, folder):
    k = F.col("event_id")
    text = F.when(k % 4 == 1, F.concat(F.lit("t"), k.cast("string"))).otherwise((k * 1000).cast("string"))
    return table(spark, folder, "events").select(k, S.parse_timestamp(text).alias("p")).select(k, "p.value", "p.error")


@query("page_token", """
SELECT event_id, to_base64(unhex(lpad(upper(to_hex(event_id)), 8, '0'))) AS token, event_id AS back FROM events""")
def page_token(spark, folder):
    token = S.page_token(F.col("event_id"))
    return table(spark, folder, "events").select("event_id", token.alias("token"),
                                                 S.page_offset(token).cast("bigint").alias("back"))


@query("state_numbers", """
SELECT event_id, event_id % 5 AS number, CASE event_id % 5 WHEN 0 THEN 'UNSPECIFIED' WHEN 1 THEN 'QUEUED'
  WHEN 2 THEN 'RECONCILED' WHEN 3 THEN 'FAILED' ELSE 'NO_CHANGES' END AS state FROM events""")
def state_numbers(spark, folder):
    name = S.state_name((F.col("event_id") % 5).cast("int"))
    return table(spark, folder, "events").select(
        "event_id", S.state_number(name).cast("bigint").alias("number"), name.alias("state"))


@query("log_keys", """
SELECT event_id, 'ingest-entity:dcim.site-' || epoch_us(ts) || '-' ||
  lpad(upper(to_hex(epoch_us(ts))), 16, '0') || '-' || md5('r' || user_id) || '-0000000003' AS log_key
FROM events""")
def log_keys(spark, folder):
    at = micros("ts")
    record = S.log_id(at, F.concat(F.lit("r"), F.col("user_id").cast("string")), F.lit(3))
    return table(spark, folder, "events").select("event_id", S.log_key(F.lit("dcim.site"), at, record).alias("log_key"))


@query("log_json_fix", """
SELECT event_id, '{"id":"' || event_id || '","ingestionTs":' || event_id || '}' AS record FROM events""")
def log_json_fix(spark, folder):
    k = F.col("event_id").cast("string")
    return table(spark, folder, "events").select(
        "event_id", S.unquote_ingestion_ts(F.to_json(F.struct(k.alias("id"), k.alias("ingestionTs")))).alias("record"))

