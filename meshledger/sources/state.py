"""The current state: raw inventory objects to typed rows, and an empty state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshledger import registry as R
from meshledger.functions.scalars import natural_key, scoped_identity, unwrap_choice
from meshledger.operators.fold import KEYS, REFS, empty_state_columns
from meshledger.schemas import STORED_TAG
from meshledger.registry import BY_ENTITY, SCALARS, TAG_TYPE, TYPES

# Parent fields of a raw object, to the depth an object can have.
PARENT_FIELDS: dict[str, dict[str, str]] = {
    "dcim.platform": {"manufacturer": "dcim.manufacturer"},
    "dcim.devicetype": {"manufacturer": "dcim.manufacturer"},
    "dcim.device": {"site": "dcim.site", "platform": "dcim.platform",
                    "device_type": "dcim.devicetype", "role": "dcim.devicerole"},
    "dcim.interface": {"device": "dcim.device"},
    "ipam.prefix": {"site": "dcim.site"},
    "virtualization.cluster": {"site": "dcim.site", "type": "virtualization.clustertype",
                               "group": "virtualization.clustergroup"},
    "virtualization.virtualmachine": {"site": "dcim.site", "cluster": "virtualization.cluster",
                                      "role": "dcim.devicerole", "platform": "dcim.platform"},
    "virtualization.vminterface": {"virtual_machine": "virtualization.virtualmachine"},
    "virtualization.virtualdisk": {"virtual_machine": "virtualization.virtualmachine"},
}
_SQL_TYPES = {"string": T.StringType(), "bigint": T.LongType(), "boolean": T.BooleanType()}


def raw_schema(type_name: str) -> T.StructType:
    """Schema of one raw object. Choice fields are read as text, so both forms of them fit."""
    if type_name == TAG_TYPE:
        return STORED_TAG
    kind = TYPES[type_name]
    fields = [T.StructField("id", T.LongType()), T.StructField(kind.name_field, T.StringType())]
    if kind.slug:
        fields.append(T.StructField("slug", T.StringType()))
    fields += [T.StructField(SCALARS[c][1], _SQL_TYPES[SCALARS[c][0]]) for c in kind.scalars]
    fields += [T.StructField(f, raw_schema(t)) for f, t in PARENT_FIELDS.get(type_name, {}).items()]
    if type_name == "ipam.ipaddress":
        link = T.StructType([T.StructField("interface", raw_schema("dcim.interface"))])
        fields.append(T.StructField("assigned_object", link))
    fields.append(T.StructField("tags", T.ArrayType(STORED_TAG)))
    return T.StructType(fields)


def snake_case_link(text: Column) -> Column:
    """Field names of a polymorphic link as they are declared, whichever way they are spelled."""
    out = F.regexp_replace(text, '"(?:AssignedObject|assignedObject)"\\s*:', '"assigned_object":')
    return F.regexp_replace(out, '"Interface"\\s*:', '"interface":')


def _key(type_name: str, value: Column) -> Column:
    """Natural key of a raw object from its own and its parents' names."""
    name = value[TYPES[type_name].name_field]

    def named(*path: str) -> Column:
        found = value
        for step in path:
            found = found[step]
        return found["name"]

    scope: dict[str, tuple[Column, ...]] = {
        "dcim.platform": lambda: (named("manufacturer"),),
        "dcim.devicetype": lambda: (named("manufacturer"),),
        "dcim.device": lambda: (named("site"),),
        "virtualization.cluster": lambda: (named("site"),),
        "virtualization.virtualmachine": lambda: (named("site"),),
        "dcim.interface": lambda: (named("device"), named("device", "site")),
        "virtualization.vminterface": lambda: (named("virtual_machine"), named("virtual_machine", "site")),
        "virtualization.virtualdisk": lambda: (named("virtual_machine"), named("virtual_machine", "site")),
        "ipam.ipaddress": lambda: (named("assigned_object", "interface"),
                                   named("assigned_object", "interface", "device"),
                                   named("assigned_object", "interface", "device", "site")),
    }
    parts = scope[type_name]() if type_name in scope else ()
    return F.when(value.isNotNull(), natural_key(name, *parts))


def _names(type_name: str, value: Column) -> list[Column] | None:
    if type_name == "dcim.interface":
        return [value["name"], value["device"]["name"], value["device"]["site"]["name"]]
    if type_name == "ipam.ipaddress":
        link = value["assigned_object"]["interface"]
        return [value["address"], link["name"], link["device"]["name"], link["device"]["site"]["name"]]
    return None


def _row(type_name: str, value: Column, level: int, key: Column | None = None) -> Column:
    null_text = F.lit(None).cast("string")
    if type_name == TAG_TYPE:
        scalars = {"color": value["color"]}
        slug, parents, identity, tags = value["slug"], {}, null_text, None
        own_key = value["name"]
    else:
        kind = TYPES[type_name]
        scalars = {c: value[SCALARS[c][1]] for c in kind.scalars}
        for c in R.EMPTY_IS_ABSENT:
            if c in scalars and c != "color":
                scalars[c] = unwrap_choice(scalars[c])
        slug = value["slug"] if kind.slug else null_text
        parents = {f: _key(t, value[f]) for f, t in PARENT_FIELDS.get(type_name, {}).items()}
        if type_name == "ipam.ipaddress":
            parents = {"interface": _key("dcim.interface", value["assigned_object"]["interface"])}
        names = _names(type_name, value)
        identity = scoped_identity(*names) if names else null_text
        tags = value["tags"]
        own_key = _key(type_name, value)
    empty_tags = F.lit(None).cast(T.ArrayType(STORED_TAG))
    return F.struct(
        F.lit(type_name).alias("object_type"), (own_key if key is None else F.coalesce(key, own_key)).alias("object_key"),
        value["id"].alias("object_id"), slug.alias("slug"),
        (empty_tags if tags is None else F.when(F.size(tags) > 0, tags)).alias("tags"),
        *[scalars.get(c, F.lit(None)).cast(SCALARS[c][0]).alias(c) for c in SCALARS],
        *[parents.get(r, null_text).alias("ref_" + r) for r in R.REFERENCES],
        identity.alias("identity"), F.lit(level).alias("level"))


def _tree(type_name: str, value: Column, level: int, key: Column | None = None) -> list[Column]:
    rows = [F.when(value["id"].isNotNull(), _row(type_name, value, level, key))]
    for f, t in PARENT_FIELDS.get(type_name, {}).items():
        rows += _tree(t, value[f], level + 1)
    if type_name == "ipam.ipaddress":
        rows += _tree("dcim.interface", value["assigned_object"]["interface"], level + 1)
    return rows


def wrap_state(raw: DataFrame, types: tuple[str, ...] = (TAG_TYPE, *TYPES)) -> DataFrame:
    """Typed state rows from raw rows (object_type, object_id, object JSON[, lookup_key]).

    ``types`` names the object types the rows can have; fewer types make a smaller plan.

    Objects embedded in others become rows as well; a row of an object's own wins over them.
    """
    lookup = F.col("lookup_key") if "lookup_key" in raw.columns else None
    names = types
    text = snake_case_link(F.col("object"))
    parsed = raw.select("*", *[
        F.from_json(F.when(F.col("object_type") == n, text), raw_schema(n)).alias("o_" + n.replace(".", "_"))
        for n in names])
    trees = [F.when(F.col("object_type") == n, F.array_compact(F.array(
        *_tree(n, F.col("o_" + n.replace(".", "_")), 0, lookup)))) for n in names]
    everything = parsed.select(F.inline(F.coalesce(*trees)))
    columns = [c for c in empty_state_columns() if c not in KEYS]
    return everything.groupBy(*KEYS).agg(
        F.min_by(F.struct(*columns), F.struct("level", "object_id")).alias("r")).select(*KEYS, "r.*")


def state_schema() -> T.StructType:
    kinds: dict[str, T.DataType] = {"object_id": T.LongType(), "tags": T.ArrayType(STORED_TAG)}
    kinds |= {c: _SQL_TYPES[SCALARS[c][0]] for c in SCALARS}
    return T.StructType([T.StructField(c, kinds.get(c, T.StringType())) for c in empty_state_columns()])


def empty_state(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], state_schema())


def conform_state(rows: DataFrame) -> DataFrame:
    """Fill the state columns a source does not have with nulls, in the state's order and types."""
    have = set(rows.columns)
    return rows.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in state_schema()])


__all__ = ["BY_ENTITY", "REFS", "conform_state", "empty_state", "raw_schema", "state_schema", "wrap_state"]
