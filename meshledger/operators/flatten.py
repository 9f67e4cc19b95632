"""From request to nodes: explode, typed projection, placeholder completion, keys, one row per object.

Every root entity is laid out over the same slots (see the registry), so all types share one
projection and one generate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshledger import registry as R
from meshledger.functions.scalars import (
    absent_if_empty, arrival_order, fill_slug, key_part, natural_key,
)
from meshledger.operators.salts import dealt, few_or_shuffled, shuffled
from meshledger.operators.validate import (
    INVALID_ROOT, object_type_of, root_error, variant_set,
)
from meshledger.registry import ALL, SLOTS, UNDEFINED, Shape
from meshledger.schemas import ENTITY
from meshledger.session import dropped_shuffles, release, stage


DELIVERY = ("ingestion_ts", "id")


def number_copies(requests: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """Add ``copy``: 0 for the first request of an id and arrival time, then 1, 2, ... Delivery is at least
    once and arrival times are coarse, so both may come again; content decides the order of unlike ones.

    ``earlier`` (id, arrival time, n) tells how many came in earlier batches. Only ids and times are grouped, which combines
    before it shuffles; requests that came once move nowhere. Those that came again are put in ranges of (time, id,
    content), counted by range, and start from what earlier ranges of their key hold: no key is one task's."""
    count = requests.groupBy(*DELIVERY).agg(F.count("*").alias("_n"))
    if earlier is not None:
        count = count.join(earlier.withColumnRenamed("n", "_earlier"), list(DELIVERY), "left")
    else:
        count = count.withColumn("_earlier", F.lit(None).cast("bigint"))
    again = stage(count.where("_n > 1 OR _earlier > 0").select(*DELIVERY, F.coalesce("_earlier", F.lit(0)).alias("_earlier")))
    number = again.count()
    if not number:
        return requests.withColumn("copy", F.lit(0))
    side = few_or_shuffled(again, number)
    whole_content = whole_entities(F.col("entities"), requests.schema["entities"].dataType)
    once = requests.join(side, list(DELIVERY), "left_anti").withColumn("copy", F.lit(0))
    repeated = stage(requests.join(side, list(DELIVERY)).withColumn("_content", F.xxhash64(F.to_json(whole_content)))
                     .withColumn("_row", F.monotonically_increasing_id()))
    placed = stage(repeated.repartitionByRange(*DELIVERY, "_content", "_row").withColumn("_part", F.spark_partition_id()))
    release(requests.sparkSession, repeated)
    before = Window.partitionBy(*DELIVERY).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    start = placed.groupBy("_part", *DELIVERY).count().select(
        "_part", *DELIVERY, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_part", *DELIVERY).orderBy("_content", "_row"))
    many = placed.count()
    numbered = dealt(placed, many, "_part", *DELIVERY).withColumn("_place", inside).join(
        shuffled(start, many), ["_part", *DELIVERY])
    copy = (F.col("_earlier") + F.col("_start") + F.col("_place") - 1).cast("int").alias("copy")
    return once.unionByName(numbered.select(*requests.columns, copy))


def explode_entities(requests: DataFrame) -> DataFrame:
    """One row per entity, with its position and its place in arrival order."""
    if "copy" not in requests.columns:
        requests = requests.withColumn("copy", F.lit(0))
    exploded = requests.select("*", F.posexplode_outer("entities").alias("position", "entity"))
    return exploded.drop("entities").withColumn("seq", arrival_order(
        F.col("ingestion_ts"), F.col("id"), F.coalesce("position", F.lit(0)), F.col("copy")))


def spread(entities: DataFrame) -> DataFrame:
    """Deal entities over the tasks by their place. A small file, or one request with very many entities, is a single task's, and
    each entity costs far more than its bytes; what is staged from few tasks is read by few tasks again."""
    return entities.repartition("seq")


def classify_roots(entities: DataFrame) -> DataFrame:
    """Add the object type and the error that keeps an entity from being reconciled."""
    entities = spread(entities)
    entity = whole(F.col("entity"), entities.schema["entity"].dataType)
    missing = entity.isNull() | ~variant_set(entity)
    nil = F.when(missing, F.concat(F.lit("entity at index "), F.col("position").cast("string"),
                                   F.lit(" is nil")))
    return entities.withColumn("object_type", object_type_of(entity)).withColumn(
        "root_error", F.coalesce(nil, root_error(entity)))


def _given(value: str, name_field: str = "name") -> str:
    """A nested object with a blank name counts as missing."""
    return f"CASE WHEN {value}.{name_field} != '' THEN {value} END"


def _rows(frame: DataFrame, **columns: str) -> DataFrame:
    return frame.selectExpr("*", *[f"{text} AS {name}" for name, text in columns.items()])


# Fields that are used. Primary addresses and a machine's device are accepted and dropped here.
DEVICE_FIELDS = ("name", "device_type", "role", "platform", "serial", "site", "asset_tag", "status",
                 "description", "comments", "tags")
MACHINE_FIELDS = ("name", "status", "site", "cluster", "role", "platform", "vcpus", "memory", "disk",
                  "description", "comments", "tags")


def _only(value: str, fields: tuple[str, ...]) -> str:
    members = ", ".join(f"'{f}', {value}.{f}" for f in fields)
    return f"CASE WHEN {value}.name != '' THEN named_struct({members}) END"


def narrowed(entity: Column, kinds: tuple[str, ...]) -> Column:
    """An entity without the kinds that do not occur: they have hundreds of columns, all null, to write and read again."""
    return F.when(entity.isNotNull(), F.struct(*[entity[k].alias(k) for k in ENTITY.fieldNames() if k in kinds or k not in R.BY_ENTITY]))


def whole(entity: Column, kind: T.StructType) -> Column:
    """All kinds of an entity of type ``kind``, which may lack some (see ``narrowed``). A missing entity has none."""
    have = kind.fieldNames()
    if set(ENTITY.fieldNames()) <= set(have):
        return entity
    return F.struct(*[(entity[f.name] if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in ENTITY.fields])


def whole_entities(entities: Column, kind: T.ArrayType) -> Column:
    if set(ENTITY.fieldNames()) <= set(kind.elementType.fieldNames()):
        return entities
    return F.transform(entities, lambda e: F.when(e.isNotNull(), whole(e, kind.elementType)))


def present_kinds(requests: DataFrame) -> tuple[str, ...]:
    """The kinds that occur; their flags come to the driver in one row."""
    occurs = {k: F.exists(F.col("entities")[k], lambda e: e.isNotNull()) for k in R.BY_ENTITY}
    with dropped_shuffles(requests.sparkSession):
        row = requests.agg(*[F.bool_or(flag).alias(k) for k, flag in occurs.items()]).first()
    return tuple(k for k in R.BY_ENTITY if row[k])


def by_kind(roots: DataFrame) -> DataFrame:
    """A column ``e_<kind>`` for every kind instead of the entity. One that does not occur is a constant, so that all that is made of it
    falls away in planning."""
    kinds = {f.name: f.dataType for f in ENTITY.fields if f.name in R.BY_ENTITY}
    have = roots.schema["entity"].dataType.fieldNames()
    return roots.select(*[c for c in roots.columns if c != "entity"], *[
        (F.col("entity." + k) if k in have else F.lit(None).cast(t)).alias("e_" + k) for k, t in kinds.items()])


def lay_out(roots: DataFrame) -> DataFrame:
    """Columns ``on_<slot>`` and ``given_<slot>``: is the slot taken, and by which observed object.

    A taken slot without an observed object holds a placeholder; what hangs below a placeholder
    has nothing given either, so placeholders are inherited.
    """
    out = _rows(
        by_kind(roots),
        on_ip_address="e_ip_address IS NOT NULL", given_ip_address="e_ip_address",
        on_prefix="e_prefix IS NOT NULL", given_prefix="e_prefix",
        on_vm_interface="e_vminterface IS NOT NULL", given_vm_interface="e_vminterface",
        on_virtual_disk="e_virtual_disk IS NOT NULL", given_virtual_disk="e_virtual_disk",
        on_interface="e_interface IS NOT NULL OR e_ip_address.interface IS NOT NULL",
        _interface="coalesce(e_interface, e_ip_address.interface)",
        on_vm="e_virtual_machine IS NOT NULL OR e_vminterface IS NOT NULL "
              "OR e_virtual_disk IS NOT NULL",
        _vm="coalesce(e_virtual_machine, e_vminterface.virtual_machine, "
            "e_virtual_disk.virtual_machine)",
    )
    out = _rows(out, given_interface=_given("_interface"), given_vm=_only("_vm", MACHINE_FIELDS),
                on_device="e_device IS NOT NULL OR on_interface")
    out = _rows(out, _device="coalesce(e_device, given_interface.device)",
                _cluster="coalesce(e_cluster, given_vm.cluster)").drop("_interface", "_vm")
    out = _rows(out, given_device=_only("_device", DEVICE_FIELDS), given_cluster=_given("_cluster"),
                on_cluster="_cluster IS NOT NULL")
    out = _rows(
        out,
        _platform="coalesce(e_platform, given_device.platform, given_vm.platform)",
        _device_type="coalesce(e_device_type, given_device.device_type)",
        on_device_type="e_device_type IS NOT NULL OR on_device",
        _role="coalesce(e_device_role, given_device.role, given_vm.role)",
        on_role="e_device_role IS NOT NULL OR on_device OR on_vm",
        _site="coalesce(e_site, given_device.site, given_vm.site, given_prefix.site)",
        on_site="e_site IS NOT NULL OR on_device OR on_vm OR on_prefix",
        _cluster_group="coalesce(e_cluster_group, given_cluster.group)",
        on_cluster_group="e_cluster_group IS NOT NULL OR on_cluster",
        _cluster_type="coalesce(e_cluster_type, given_cluster.type)",
        on_cluster_type="e_cluster_type IS NOT NULL OR on_cluster",
        on_cluster_site="on_cluster",
    ).drop("_device", "_cluster")
    # A placeholder device has a placeholder platform; an observed one has a platform only if given.
    out = _rows(
        out,
        on_platform="_platform IS NOT NULL OR (on_device AND given_device IS NULL)",
        given_platform=_given("_platform"), given_device_type=_given("_device_type", "model"),
        given_role=_given("_role"), given_site=_given("_site"),
        given_cluster_group=_given("_cluster_group"), given_cluster_type=_given("_cluster_type"),
        given_cluster_site=_given("given_cluster.site"),
    ).drop("_platform", "_device_type", "_role", "_site", "_cluster_group", "_cluster_type")
    out = _rows(out, on_manufacturer="e_manufacturer IS NOT NULL OR on_device_type",
                _manufacturer="coalesce(e_manufacturer, given_device_type.manufacturer)",
                on_platform_manufacturer="given_platform.manufacturer IS NOT NULL",
                given_platform_manufacturer=_given("given_platform.manufacturer"))
    return _rows(out, given_manufacturer=_given("_manufacturer")).drop("_manufacturer", *["e_" + k for k in R.BY_ENTITY])


def is_placeholder(slot: str) -> Column:
    return F.col("on_" + slot) & F.col("given_" + slot).isNull()


def observed_name(slot: str) -> str:
    """Name of the object in a slot, ``undefined`` for a placeholder, null for a free slot."""
    field = SLOTS[slot].type.name_field
    return f"CASE WHEN on_{slot} THEN coalesce(given_{slot}.{field}, '{UNDEFINED}') END"


# Names that make the key, from the object itself outwards. A slot's keys name the same columns
# an inventory lookup filters on.
KEY_SCOPE: dict[str, tuple[str, ...]] = {
    "platform": ("platform_manufacturer",),
    "device_type": ("manufacturer",),
    "device": ("site",),
    "vm": ("site",),
    "cluster": ("cluster_site",),
    "interface": ("device", "site"),
    "ip_address": ("interface", "device", "site"),
    "vm_interface": ("vm", "site"),
    "virtual_disk": ("vm", "site"),
}


def add_keys(laid: DataFrame, shape: Shape = ALL) -> DataFrame:
    """``key_<slot>``: natural key of every taken slot, from observed names only."""
    named = _rows(laid, **{"name_" + s: observed_name(s) for s in shape.slots})
    mark = "'\\u001f'"
    keys = {"key_" + s: f"CASE WHEN on_{s} THEN concat_ws({mark}, " + ", ".join(
        [f"name_{s}"] + [f"coalesce(name_{p}, '')" for p in KEY_SCOPE.get(s, ())]) + ") END" for s in shape.slots}
    own = [f"{_own_values(s)} AS given_{s}" for s in shape.slots]
    free = {prefix + s for s in SLOTS for prefix in ("given_", "on_")} - {"on_" + s for s in shape.slots}
    keep = [c for c in laid.columns if c not in free]
    return _rows(named, **keys).selectExpr(*keep, *keys, *own)


def _own_values(slot_name: str) -> str:
    """The observed object without the objects nested in it; those have slots of their own."""
    kind, given = SLOTS[slot_name].type, "given_" + slot_name
    fields = [kind.name_field, *(["slug"] if kind.slug else []),
              *[R.SOURCE_FIELD.get(c, c) for c in kind.scalars], "tags"]
    members = ", ".join(f"'{f}', {given}.{f}" for f in fields)
    return f"CASE WHEN {given} IS NOT NULL THEN named_struct({members}) END"


def vm_lookup_key(name: Column, site: Column, cluster: Column, cluster_site: Column) -> Column:
    """Key of a machine that was not flattened: by site, else by cluster and the cluster's site."""
    return F.when(site.isNotNull(), natural_key(name, site)).otherwise(
        natural_key(name, F.lit(""), cluster, cluster_site))


def tag_records(tags: Column) -> Column:
    """Typed tags with their slug filled; an empty list is no list."""
    records = F.transform(tags, lambda t: F.struct(
        t["name"].alias("name"), fill_slug(t["slug"], t["name"]).alias("slug"),
        absent_if_empty(t["color"]).alias("color")))
    return F.when(F.size(tags) > 0, records)


NO_TAGS = "CAST(NULL AS ARRAY<STRUCT<name: STRING, slug: STRING, color: STRING>>)"


def node_struct(slot_name: str, shape: Shape = ALL) -> str:
    """The observed values of one slot; every slot gives the same struct type."""
    slot, given = SLOTS[slot_name], "given_" + slot_name
    members = {
        "slot": f"'{slot_name}'", "object_type": f"'{slot.type.name}'", "object_key": "key_" + slot_name,
        "placeholder": f"on_{slot_name} AND {given} IS NULL", "kept": "kept_" + slot_name,
        "slug": f"{given}.slug" if slot.type.slug else "CAST(NULL AS STRING)",
        "tags": f"{given}.tags",
    }
    for column in shape.scalars:
        kind = R.SCALARS[column][0]
        source = f"{given}.{R.SOURCE_FIELD.get(column, column)}" if column in slot.type.scalars else "NULL"
        members[column] = f"CAST({source} AS {kind})"
    for reference in shape.references:
        parent = slot.parents.get(reference)
        members["ref_" + reference] = f"key_{parent}" if parent else "CAST(NULL AS STRING)"
    inner = ", ".join(f"'{n}', {v}" for n, v in members.items())
    return f"CASE WHEN key_{slot_name} IS NOT NULL THEN named_struct({inner}) END"


def fill_slugs(nodes: DataFrame) -> DataFrame:
    """Slugs of the nodes whose type has them, made from the name where none is observed."""
    with_slug = [t.name for t in R.TYPES.values() if t.slug]
    slug = F.when(F.col("object_type").isin(*with_slug) & ~F.col("kept"),
                  fill_slug(F.col("slug"), key_part(F.col("object_key"), 1)))
    return nodes.withColumn("slug", slug)


def complete(nodes: DataFrame, shape: Shape = ALL) -> DataFrame:
    """What is filled in or emptied, the same for every type: placeholder values, absent texts, the slugs of tags."""
    types = F.col("object_type")
    values = {c: absent_if_empty(F.col(c)) for c in R.EMPTY_IS_ABSENT if c in shape.scalars}
    if "size" in shape.scalars:
        values["size"] = F.nullif(F.col("size"), F.lit(0))
    for column in {c for t in shape.types.values() for c in t.placeholder}:
        for t in shape.types.values():
            if column in t.placeholder:
                filled = F.col("placeholder") & (types == t.name)
                values[column] = F.when(filled, t.placeholder[column]).otherwise(values[column])
    return nodes.withColumns({"tags": tag_records(F.col("tags")), **values})


def flatten(keyed: DataFrame, *carried: str, shape: Shape = ALL, slugs: bool = True) -> DataFrame:
    """One row per object of every root, leaves first; ``carried`` columns are kept on each row. Slugs may be left to
    ``fill_slugs``, for the nodes that need them."""
    nodes = ", ".join(node_struct(s, shape) for s in shape.slots)
    order = ", ".join(f"'{s}'" for s in SLOTS)
    rows = keyed.selectExpr("seq", *carried, f"inline(array_compact(array({nodes})))")
    rows = complete(fill_slugs(rows) if slugs else rows, shape)
    return rows.withColumn("ord", F.expr(f"CAST(array_position(array({order}), slot) AS INT)"))


def without_kept(keyed: DataFrame) -> DataFrame:
    """For flattening without current state: no parent is kept from anywhere."""
    return _rows(keyed, **{"kept_" + s: "false" for s in SLOTS})


__all__ = [
    "INVALID_ROOT", "add_keys", "classify_roots", "explode_entities", "flatten", "is_placeholder",
    "lay_out", "tag_records",
    "vm_lookup_key", "without_kept",
]
