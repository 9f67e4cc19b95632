"""From folded nodes to changes: propagation to parents, payloads, order, uniqueness, change sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshledger import registry as R
from meshledger.functions.scalars import content_key
from meshledger.operators.salts import dealt
from meshledger.operators.tags import with_tags
from meshledger.registry import ALL, NOT_DEDUPED, SLOTS, TAG_TYPE, Shape

# Place of each slot's changes inside a change set: (tags, object). Machines emit their platform
# after the role, devices before the device type; see _places.
_DEVICE_ORDER = {
    "site": (10, 11), "platform_manufacturer": (20, 21), "platform": (22, 23),
    "device_type": (30, 33), "manufacturer": (31, 32), "role": (40, 41), "device": (50, 51),
}
_MACHINE_ORDER = {
    "site": (10, 11), "cluster_site": (20, 21), "cluster_type": (22, 23), "cluster_group": (24, 25),
    "cluster": (26, 27), "role": (40, 41), "platform_manufacturer": (42, 43), "platform": (44, 45),
    "vm": (50, 51),
}
_OUTER_ORDER = {
    "prefix": (60, 61), "interface": (60, 61), "vm_interface": (60, 61), "virtual_disk": (60, 61),
    "ip_address": (70, 71),
}
# Notes stand behind all changes of a root, one place for each slot.
_NOTES = 1000
# A new interface or address emits its tags before everything below it.
_EARLY_TAGS = {"ip_address": 1, "interface": 2}


def gather_roots(folded: DataFrame) -> DataFrame:
    """One row per root with a map slot -> node. A root has at most one node per slot."""
    node = F.struct(*[c for c in folded.columns if c not in ("seq", "ord")])
    entries = F.collect_list(F.struct(F.col("slot"), node.alias("node")))
    return folded.groupBy("seq").agg(F.map_from_entries(entries).alias("slots"))


def _merged(base: str, members: list[str]) -> str:
    """Add members to a JSON object that has at least one; null members are left out."""
    return f"concat(left({base}, length({base}) - 1), ',', concat_ws(',', {', '.join(members)}), '}}')"


def _member(key: str, value: str) -> str:
    """``"key":value``, null for a null value."""
    return f"""concat('"{key}":', {value})"""


def _short(slot: str) -> str:
    return f"""concat('{{"id":', CAST(n_{slot}.object_id AS STRING), '}}')"""


def _parent_member(slot_name: str, reference: str, parent: str) -> str:
    """A parent inside its holder: in full when it is changed, else by its id only."""
    short, key, around = _short(parent), reference, ("", "")
    if slot_name == "ip_address":
        short = (f"""concat('{{"id":', CAST(n_interface.object_id AS STRING), ',"device":', """
                 f"""{_short('device')}, '}}')""")
        key, around = "assigned_object", ("""concat('{"interface":', """, ", '}')")
    value = f"CASE WHEN changed_{parent} THEN embedded_{parent} WHEN n_{parent} IS NOT NULL THEN {short} END"
    return _member(key, around[0] + value + around[1])


def propagate_changes(roots: DataFrame, shape: Shape = ALL) -> DataFrame:
    """Per slot: is the object changed once its parents' changes are known, and its payload.

    Slots come leaves first, so every parent's columns are there when its holder needs them. What
    a holder sees of a changed parent: tags are not embedded, but a changed parent with parents of
    its own embeds those in short form and so differs in any case.
    """
    out = roots.selectExpr("seq", *[f"slots['{s}'] AS n_{s}" for s in shape.slots])
    levels: list[list[R.Slot]] = []
    for slot in (SLOTS[s] for s in shape.slots):
        depth = 1 + max([i for i, level in enumerate(levels) for s in level if s.name in slot.parents.values()],
                        default=-1)
        if depth == len(levels):
            levels.append([])
        levels[depth].append(slot)
    for level in levels:
        flags, embedded, data = {}, {}, {}
        for slot in level:
            n = "n_" + slot.name
            terms = [f"{n}.fields_differ", f"{n}.tags_differ", f"{n}.parent_moved"]
            for reference, parent in slot.parents.items():
                terms.append(f"(NOT {n}.kept AND (coalesce(inside_{parent}, false) OR (coalesce(changed_{parent}, "
                             f"false) AND array_contains({n}.unset_parents, '{reference}'))))")
            flags["changed_" + slot.name] = f"coalesce({' OR '.join(terms)}, false)"
            members = [_parent_member(slot.name, r, p) for r, p in slot.parents.items()]
            present = " OR ".join(f"n_{p} IS NOT NULL" for p in slot.parents.values())
            embedded["embedded_" + slot.name] = (
                f"CASE WHEN {present} THEN {_merged(n + '.payload', members)} ELSE {n}.payload END"
                if members else f"{n}.payload")
            inside = f"changed_{slot.name}" if members else f"{n}.fields_differ"
            if members:
                inside = f"CASE WHEN {present} THEN {inside} ELSE {n}.fields_differ END"
            data["inside_" + slot.name] = f"coalesce({inside}, false)"
        for step in (flags | embedded, data):
            out = out.selectExpr("*", *[f"{text} AS {name}" for name, text in step.items()])
    return out


def _places(slot: str, shape: Shape) -> tuple[str, str]:
    pairs = [o[slot] for o in (_DEVICE_ORDER, _MACHINE_ORDER, _OUTER_ORDER) if slot in o]
    tags, own = str(pairs[0][0]), str(pairs[0][1])
    if len(pairs) > 1 and "vm" in shape.slots:
        tags = f"CASE WHEN n_vm IS NOT NULL THEN {pairs[1][0]} ELSE {tags} END"
        own = f"CASE WHEN n_vm IS NOT NULL THEN {pairs[1][1]} ELSE {own} END"
    if slot in _EARLY_TAGS:
        tags = f"CASE WHEN n_{slot}.created THEN {_EARLY_TAGS[slot]} ELSE {tags} END"
    return tags, own


def emit_changes(propagated: DataFrame, shape: Shape = ALL) -> DataFrame:
    """One row per change and root, in place order but not yet unique, and a note for every stored object that is seen with
    a parent it does not have so far: which parents (``data``), and whether the object is changed (``object_id`` 1 or 0)."""
    record = propagated.schema["n_" + shape.slots[0]].dataType["record"].dataType.simpleString()
    tags = propagated.schema["n_" + shape.slots[0]].dataType["tags_new"].dataType.simpleString()
    trees = [f"n_{s} IS NOT NULL" for s in ("device", "vm", "cluster") if s in shape.slots]
    in_tree = f"({' OR '.join(trees)})" if trees else "false"
    lists = []
    for name in shape.slots:
        tags_place, own_place = _places(name, shape)
        unique = "false" if name in NOT_DEDUPED else in_tree
        lists.append(
            f"CASE WHEN size(n_{name}.tags_new) > 0 THEN transform(n_{name}.tags_new, (t, i) -> named_struct("
            f"'place', {tags_place}, 'pos', i, 'unique', {unique}, 'object_type', '{TAG_TYPE}', "
            f"'object_key', t.name, 'object_id', CAST(NULL AS BIGINT), 'data', to_json(t), "
            f"'tags_known', CAST(NULL AS {tags}), 'tags_new', CAST(NULL AS {tags}), 'record', CAST(NULL AS {record}))) END")
        lists.append(
            f"CASE WHEN changed_{name} THEN array(named_struct('place', {own_place}, 'pos', 0, "
            f"'unique', {unique}, 'object_type', n_{name}.object_type, 'object_key', n_{name}.object_key, "
            f"'object_id', n_{name}.object_id, 'data', embedded_{name}, 'tags_known', n_{name}.tags_known, "
            f"'tags_new', n_{name}.tags_new, 'record', n_{name}.record)) END")
        if SLOTS[name].parents:
            n = "n_" + name
            lists.append(
                f"CASE WHEN NOT {n}.created AND NOT {n}.kept AND size({n}.unset_parents) > 0 THEN array(named_struct("
                f"'place', {_NOTES + len(lists)}, 'pos', 0, 'unique', false, 'object_type', {n}.object_type, "
                f"'object_key', {n}.object_key, 'object_id', CAST(changed_{name} AS BIGINT), "
                f"'data', concat_ws(',', {n}.unset_parents), 'tags_known', CAST(NULL AS {tags}), 'tags_new', CAST(NULL AS {tags}), 'record', CAST(NULL AS {record}))) END")
    return propagated.selectExpr("seq", f"inline(flatten(array_compact(array({', '.join(lists)}))))")


def add_tags(emitted: DataFrame, attached: DataFrame | None) -> DataFrame:
    """Put the object's tags into the payload and the record of a change; only changed objects meet their list."""
    rows = with_tags(emitted, attached)
    full = F.col("record").isNotNull() & (F.size("tags_after") > 0)
    data = F.when(full, F.expr(_merged("data", [_member("tags", "to_json(tags_after)")]))).otherwise(F.col("data"))
    record = F.col("record").withField("tags", F.col("tags_held"))
    return rows.withColumns({"data": data, "record": record}).drop("tags_known", "tags_new", "tags_after", "tags_held")


def dedup_changes(changes: DataFrame) -> DataFrame:
    """Within a root, of changes with the same content the first is kept.

    Only objects of device, machine and cluster trees are made unique (column ``unique``).
    """
    content = F.when(F.col("unique"), content_key(F.col("object_type"), F.col("data"))).otherwise(
        F.concat_ws("!", "place", "pos"))
    window = Window.partitionBy("seq", "content").orderBy("place", "pos")
    ranked = changes.withColumn("content", content).withColumn("_nth", F.row_number().over(window))
    return ranked.where(F.col("_nth") == 1).drop("_nth", "content", "unique")


def order_changes(changes: DataFrame) -> DataFrame:
    """Number the changes of a root and give change and change set their ids."""
    window = Window.partitionBy("seq").orderBy("place", "pos")
    numbered = changes.withColumn("ord", F.row_number().over(window))
    return numbered.select(
        "seq", F.md5("seq").alias("change_set_id"), "ord",
        content_key(F.col("seq"), F.col("ord").cast("string")).alias("change_id"),
        F.when(F.col("object_id").isNotNull(), "update").otherwise("create").alias("change_type"),
        "object_type", "object_key", "object_id", F.lit(None).cast("bigint").alias("object_version"),
        "data", "record", F.when(F.col("place") >= _NOTES, F.col("data")).alias("noted"))


def decide_noted(folded: DataFrame, shape: Shape = ALL, attached: DataFrame | None = None, number: int | None = None) -> DataFrame:
    """All steps from folded nodes to numbered changes and notes; a shuffle by root, and by object where there are tags. ``number``
    tells how many nodes there are."""
    emitted = emit_changes(propagate_changes(gather_roots(dealt(folded, number, "seq")), shape), shape)
    return order_changes(dedup_changes(add_tags(emitted, attached)))


def without_notes(noted: DataFrame) -> DataFrame:
    return noted.where(F.col("noted").isNull()).drop("noted")


def decide(folded: DataFrame, attached: DataFrame | None = None) -> DataFrame:
    return without_notes(decide_noted(folded, attached=attached))


def assemble_change_sets(changes: DataFrame) -> DataFrame:
    """One row per root with its changes in order."""
    change = F.struct("ord", "change_id", "change_type", "object_type", "object_id", "object_version", "data")
    return changes.groupBy("seq", "change_set_id").agg(
        F.array_sort(F.collect_list(change)).alias("change_set"))


def count_changes(changes: DataFrame) -> DataFrame:
    return changes.groupBy("object_type", "change_type").agg(F.count("*").alias("n"))


def roots_without_changes(roots: DataFrame, changes: DataFrame) -> DataFrame:
    return roots.join(changes.select("seq").distinct(), "seq", "left_anti")
