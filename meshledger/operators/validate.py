"""Checks on requests and entities: envelope, null entities, root validity, enumerations, sources."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshledger import registry as R


def _blank(text: Column) -> Column:
    return text.isNull() | (text == "")


def envelope_error() -> Column:
    """First failing envelope rule, in the fixed order; null when the request is fine."""
    rules = [F.when(_blank(F.col(column)), F.lit(f"{label} is empty")) for column, label in (
        ("id", "id"), ("producer_app_name", "producer app name"),
        ("producer_app_version", "producer app version"), ("sdk_name", "sdk name"),
        ("sdk_version", "sdk version"))]
    no_entities = F.when(F.coalesce(F.size("entities"), F.lit(0)) < 1, F.lit("entities is empty"))
    return F.coalesce(*rules, no_entities)


def check_envelope(requests: DataFrame) -> DataFrame:
    return requests.withColumn("request_error", envelope_error())


def source_request_error() -> Column:
    """Check of a request for the list of data sources."""
    return F.coalesce(F.when(_blank(F.col("sdk_name")), F.lit("sdk name is empty")),
                      F.when(_blank(F.col("sdk_version")), F.lit("sdk version is empty")))


def allowed_requests(requests: DataFrame, sources: DataFrame, column: str = "producer_app_name",
                     name: str | None = None) -> DataFrame:
    """Requests whose source is registered, optionally of one named source only."""
    names = sources.select(F.col("name").alias(column)).distinct()
    if name is not None:
        names = names.where(F.col(column) == name)
    return requests.join(names, column, "left_semi")


def variant_set(entity: Column) -> Column:
    return reduce(or_, [entity[e].isNotNull() for e in R.BY_ENTITY])


def null_entity_errors(entities: Column) -> Column:
    """One message per entity that carries no object, with its index."""
    messages = F.transform(entities, lambda e, i: F.when(
        e.isNull() | ~variant_set(e),
        F.concat(F.lit("entity at index "), i.cast("string"), F.lit(" is nil"))))
    return F.filter(messages, lambda m: m.isNotNull())


def object_type_of(entity: Column) -> Column:
    """Which of the variants is set."""
    return F.coalesce(*[F.when(entity[e].isNotNull(), F.lit(t.name)) for e, t in R.BY_ENTITY.items()])


def root_name(entity: Column) -> Column:
    return F.coalesce(*[entity[e][t.name_field] for e, t in R.BY_ENTITY.items()])


def _not_in(value: Column, allowed: tuple[str, ...]) -> Column:
    return value.isNotNull() & (value != "") & ~value.isin(*allowed)


def enumeration_error(entity: Column) -> Column:
    """Enumerations checked on the root entity; absent and empty values pass."""
    return F.coalesce(
        F.when(_not_in(entity["interface"]["type"], R.INTERFACE_TYPES), F.lit("invalid interface type")),
        F.when(_not_in(entity["interface"]["mode"], R.INTERFACE_MODES), F.lit("invalid interface mode")),
        F.when(_not_in(entity["ip_address"]["status"], R.IP_STATUSES), F.lit("invalid IP address status")),
        F.when(_not_in(entity["ip_address"]["role"], R.IP_ROLES), F.lit("invalid IP address role")),
        F.when(_not_in(entity["prefix"]["status"], R.PREFIX_STATUSES), F.lit("invalid prefix status")),
    )


def virtualization_status_error(entity: Column) -> Column:
    """Status rule of clusters and machines: declared, but only part of the data-quality check."""
    statuses = [entity[e]["status"] for e in ("cluster", "virtual_machine")]
    return F.coalesce(*[F.when(_not_in(s, R.VIRTUALIZATION_STATUSES),
                               F.lit("invalid virtualization status")) for s in statuses])


INVALID_ROOT = "failed to prepare change set: invalid ingest entity"


def root_error(entity: Column) -> Column:
    """Why a root entity cannot be reconciled; null when it can."""
    bad = _blank(root_name(entity)) | enumeration_error(entity).isNotNull()
    return F.when(bad, F.lit(INVALID_ROOT))


def constraint_rules() -> list[tuple[str, str, str, object]]:
    """(entity, field, rule, argument) of the declared field constraints."""
    slug_pattern = "^[-a-zA-Z0-9_]+$"
    rules: list[tuple[str, str, str, object]] = []

    def text(entity, field_name, low=None, high=None, pattern=None, allowed=None):
        for rule, argument in (("min_len", low), ("max_len", high), ("pattern", pattern), ("in", allowed)):
            if argument is not None:
                rules.append((entity, field_name, rule, argument))

    def number(entity, field_name, low=None, high=None):
        for rule, argument in (("gte", low), ("lte", high)):
            if argument is not None:
                rules.append((entity, field_name, rule, argument))

    for entity, name_field in (("site", "name"), ("platform", "name"), ("manufacturer", "name"),
                               ("device_role", "name"), ("device_type", "model"),
                               ("cluster_group", "name"), ("cluster_type", "name")):
        text(entity, name_field, 1, 100)
        text(entity, "slug", 1, 100, slug_pattern)
        text(entity, "description", high=200)
    text("site", "status", allowed=R.SITE_STATUSES)
    text("site", "facility", high=50)
    text("device_role", "color", 6, 6, "^[0-9a-f]{6}$")
    text("device_type", "part_number", high=50)

    text("device", "name", high=64)
    text("device", "device_fqdn", 1, 255)
    text("device", "serial", high=50)
    text("device", "asset_tag", high=200)
    text("device", "status", allowed=R.DEVICE_STATUSES)
    text("device", "description", high=200)

    rules.append(("interface", "device", "required", None))
    text("interface", "name", 1, 64)
    text("interface", "label", 1, 64)
    text("interface", "type", allowed=R.INTERFACE_TYPES)
    number("interface", "mtu", 1, 65536)
    number("interface", "speed", 0)
    text("interface", "description", high=200)
    text("interface", "mode", allowed=R.INTERFACE_MODES)

    for address in ("ip_address", "primary_ip"):
        rules.append((address, "address", "ip", None))
        text(address, "status", allowed=R.IP_STATUSES)
        text(address, "role", allowed=R.IP_ROLES)
        text(address, "dns_name", high=255, pattern=r"^([0-9A-Za-z_-]+|\*)(\.[0-9A-Za-z_-]+)*\.?$")
        text(address, "description", high=200)
    rules.append(("prefix", "prefix", "ip", None))
    text("prefix", "status", allowed=R.PREFIX_STATUSES)
    text("prefix", "description", high=200)

    text("cluster", "name", 1, 100)
    text("cluster", "status", allowed=R.VIRTUALIZATION_STATUSES)
    text("cluster", "description", high=200)
    text("virtual_machine", "name", high=64)
    text("virtual_machine", "status", allowed=R.VIRTUALIZATION_STATUSES)
    for field_name in ("vcpus", "memory", "disk"):
        number("virtual_machine", field_name, 0)
    text("virtual_machine", "description", high=200)
    rules.append(("vminterface", "virtual_machine", "required", None))
    text("vminterface", "name", 1, 64)
    number("vminterface", "mtu", 1, 65536)
    text("vminterface", "description", high=200)
    rules.append(("virtual_disk", "virtual_machine", "required", None))
    text("virtual_disk", "name", 1, 100)
    number("virtual_disk", "size", 0)
    text("virtual_disk", "description", high=200)
    return rules


_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4_PATTERN = rf"^{_OCTET}(\.{_OCTET}){{3}}$"
_GROUP = "[0-9A-Fa-f]{1,4}"
_DOTTED = rf"{_OCTET}(\.{_OCTET}){{3}}"
IPV6_PATTERN = "^(" + "|".join([
    rf"({_GROUP}:){{7}}{_GROUP}", rf"({_GROUP}:){{6}}{_DOTTED}",
    *[rf"({_GROUP}:){{{n}}}(:{_GROUP}){{1,{7 - n}}}" for n in range(1, 7)],
    *[rf"({_GROUP}:){{{n}}}(:{_GROUP}){{0,{5 - n}}}:{_DOTTED}" for n in range(1, 6)],
    rf"::({_GROUP}:){{0,5}}{_DOTTED}", rf":((:{_GROUP}){{1,7}}|:)", rf"({_GROUP}:){{1,7}}:",
]) + ")$"
UUID_PATTERN = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
VERSION_PATTERN = r"^(\d)+\.(\d)+\.(\d)+$"


# Texts that are not optional in the request: absent and empty are the same value there.
PLAIN_TEXT = {"name", "model", "slug", "status", "color", "type", "mode", "address", "prefix"}


def is_plain_text(entity: str, field_name: str) -> bool:
    return field_name in PLAIN_TEXT or (entity in ("ip_address", "primary_ip") and field_name == "role")


# Objects inside objects: field -> kind.
_INSIDE: dict[str, dict[str, str]] = {
    "platform": {"manufacturer": "manufacturer"},
    "device_type": {"manufacturer": "manufacturer"},
    "device": {"site": "site", "platform": "platform", "device_type": "device_type", "role": "device_role",
               "primary_ip4": "primary_ip", "primary_ip6": "primary_ip"},
    "interface": {"device": "device"},
    "ip_address": {"interface": "interface"},
    "prefix": {"site": "site"},
    "cluster": {"site": "site", "type": "cluster_type", "group": "cluster_group"},
    "virtual_machine": {"site": "site", "cluster": "cluster", "role": "device_role", "platform": "platform",
                        "device": "device", "primary_ip4": "primary_ip", "primary_ip6": "primary_ip"},
    "vminterface": {"virtual_machine": "virtual_machine"},
    "virtual_disk": {"virtual_machine": "virtual_machine"},
}
_TAG_RULES = (("name", "min_len", 1), ("name", "max_len", 100), ("slug", "min_len", 1),
              ("slug", "max_len", 100), ("slug", "pattern", "^[-a-zA-Z0-9_]+$"),
              ("color", "pattern", "^[0-9a-f]{6}$"))


def nested_objects(kind: str) -> list[tuple[str, str]]:
    """(path, kind) of every object that can sit in an entity of a kind, tags left out."""
    found = [(kind, kind)]
    for path, name in found:
        found.extend((f"{path}.{f}", k) for f, k in _INSIDE.get(name, {}).items())
    return found


#: What a field's rules can ask for, as columns of the rule table.
RULE_COLUMNS = {"required": "boolean", "min_len": "int", "max_len": "int", "pattern": "string", "in": "array<string>",
                "gte": "bigint", "lte": "bigint", "ip": "boolean"}


def rule_table() -> dict[tuple[str, str], dict[str, object]]:
    """(kind, field) -> what is asked of it. A few dozen rows; the fields of a tag are those of the kind ``tag``."""
    found: dict[tuple[str, str], dict[str, object]] = {}
    for kind, field_name, rule, argument in [*constraint_rules(), *(("tag", *r) for r in _TAG_RULES)]:
        found.setdefault((kind, field_name), {})[rule] = True if argument is None else argument
    return found


def _rule_rows(table: dict[tuple[str, str], dict[str, object]]) -> Column:
    """The rule table as an array of structs: a constant of the plan."""
    def cell(rules: dict[str, object], name: str) -> Column:
        value = rules.get(name)
        column = F.array(*[F.lit(v) for v in value]) if isinstance(value, tuple) else F.lit(value)
        return column.cast(RULE_COLUMNS[name]).alias(name)

    return F.array(*[F.struct(*[cell(rules, n) for n in RULE_COLUMNS]) for rules in table.values()])


def _entries(root: str, entity: str, number: dict[tuple[str, str], int]) -> str:
    """SQL array of (path, rule, value) of all fields with rules of an entity and of what is nested in it."""
    parts = []
    for path, name in nested_objects(root):
        value, fields = f"{entity}.{path}", []
        for (kind, field_name), at in number.items():
            if kind == name:
                read = f"{value}.{field_name}"
                if (name, field_name) in REQUIRED:
                    read = f"CASE WHEN {read} IS NOT NULL THEN '' END"
                elif is_plain_text(name, field_name):
                    read = f"coalesce({read}, '')"
                fields.append(f"named_struct('path', '{path}.{field_name}', 'rule', {at}, 'value', CAST({read} AS STRING))")
        if fields:
            parts.append(f"CASE WHEN {value} IS NOT NULL THEN array({', '.join(fields)}) END")
        tags = ", ".join(f"named_struct('path', '{path}.tags.{f}', 'rule', {at}, 'value', coalesce(t.{f}, ''))"
                         for (kind, f), at in number.items() if kind == "tag")
        parts.append(f"flatten(transform({value}.tags, t -> array({tags})))")
    return f"flatten(array_compact(array({', '.join(parts)})))"


REQUIRED = {(kind, field_name) for kind, field_name, rule, _ in constraint_rules() if rule == "required"}


def _broken(entry: Column, rule: Column) -> Column:
    """``path: rule`` texts of the rules an entry breaks. A value that is absent breaks nothing but ``required``."""
    value, size = entry["value"], F.length(entry["value"])
    checks = {
        "required": rule["required"] & value.isNull(), "min_len": size < rule["min_len"], "max_len": size > rule["max_len"],
        "pattern": ~F.rlike(value, rule["pattern"]), "in": ~F.array_contains(rule["in"], value),
        "gte": value.try_cast("bigint") < rule["gte"], "lte": value.try_cast("bigint") > rule["lte"],
        "ip": rule["ip"] & ~(value.rlike(IPV4_PATTERN) | value.rlike(IPV6_PATTERN)),
    }
    return F.array_compact(F.array(*[F.when(c, F.concat(entry["path"], F.lit(f": {name}"))) for name, c in checks.items()]))


def entity_violations(kinds: tuple[str, ...] = tuple(R.BY_ENTITY), entity: str = "entity") -> Column:
    """Every violated constraint of an entity as ``path.field: rule`` texts.

    The entity is laid out once as (path, rule, value) and every entry is matched with its row of the rule table, so the plan
    grows with the fields and not with the rules. ``kinds`` limits it to some kinds of root entity."""
    table = rule_table()
    number = {key: at for at, key in enumerate(table)}
    cases = " ".join(f"WHEN {entity}.{k} IS NOT NULL THEN {_entries(k, entity, number)}" for k in kinds)
    entries = F.expr(f"CASE {cases} END")
    found = F.transform(F.array(_rule_rows(table)), lambda rules: F.flatten(F.transform(
        entries, lambda e: _broken(e, F.get(rules, e["rule"])))))[0]
    missing = F.when(F.expr(f"{entity}.timestamp IS NULL"), F.array(F.lit("timestamp: required")))
    return F.array_distinct(F.concat(F.coalesce(found, F.array().cast("array<string>")), F.coalesce(missing, F.array().cast("array<string>"))))


def request_violations() -> Column:
    """Violated constraints of the request itself."""
    def text(column: str) -> Column:
        return F.coalesce(F.col(column), F.lit(""))

    size = F.coalesce(F.size("entities"), F.lit(0))
    checks = [F.when(~text("id").rlike(UUID_PATTERN), F.lit("id: uuid"))]
    for column in ("stream", "producer_app_name", "producer_app_version", "sdk_name"):
        checks.append(F.when(F.length(text(column)) < 1, F.lit(f"{column}: min_len")))
        checks.append(F.when(F.length(text(column)) > 255, F.lit(f"{column}: max_len")))
    checks.append(F.when(~text("sdk_version").rlike(VERSION_PATTERN), F.lit("sdk_version: pattern")))
    checks.append(F.when(size < 1, F.lit("entities: min_items")))
    checks.append(F.when(size > 1000, F.lit("entities: max_items")))
    return F.array_compact(F.array(*checks))

