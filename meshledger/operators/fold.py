"""The fold: stored state before the batch and observations in arrival order, per object.

One pass gives, for every node, what the inventory held before its root and what the node asks
for. A null is never sent, so it never erases; a carried field that is not observed keeps its
value; a field that is not carried is compared as observed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshledger.functions.scalars import identity_of_key
from meshledger.operators.attach import add_attached
from meshledger.operators.carry import CHUNK, add_chunks, carry_forward
from meshledger.operators.salts import dealt, shuffled
from meshledger.operators.tags import split_added, tag_events
from meshledger.registry import ALL, REFERENCES, SCALARS, TYPES, Shape

KEYS = ["object_type", "object_key"]
REFS = ["ref_" + r for r in REFERENCES]
GUARDED = ("dcim.interface", "ipam.ipaddress")
_TAG = "id: BIGINT, name: STRING, slug: STRING, color: STRING"
NO_EVENT = ("STRUCT<seq: STRING, entries: ARRAY<STRUCT<seq: STRING, is_new: BOOLEAN, ord: INT, pos: INT, name: STRING, id: BIGINT, "
            f"slug: STRING, color: STRING, observed: STRUCT<{_TAG}>>>>")


def quoted(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


def type_is(*names: str) -> Column:
    return F.col("object_type").isin(*names)


def default_of(column: str) -> str | None:
    """Value a new object of the row's type gets in a column, as SQL."""
    cases = [f"WHEN '{t.name}' THEN '{t.defaults[column]}'" for t in TYPES.values() if column in t.defaults]
    return f"CASE object_type {' '.join(cases)} END" if cases else None


def not_carried(column: str) -> str | None:
    names = [t.name for t in TYPES.values() if column in t.not_carried]
    return f"object_type IN ({quoted(names)})" if names else None


def guard_identity(state: DataFrame) -> DataFrame:
    """Stored interfaces and addresses count as found only if name and scope really agree."""
    agrees = F.col("identity").isNull() | (F.col("identity") == identity_of_key(F.col("object_key")))
    return state.where(~type_is(*GUARDED) | agrees)


def state_of_batch(state: DataFrame, nodes: DataFrame, number: int = 0) -> DataFrame:
    """The part of the state the batch touches; a small batch broadcasts its keys. ``number`` tells how many nodes there are."""
    return state.join(shuffled(nodes.select(*KEYS).distinct(), number), KEYS, "left_semi")


def fold_observations(nodes: DataFrame, state: DataFrame, hot_rows: int | None = None,
                      since: DataFrame | None = None, shape: Shape = ALL, attached: DataFrame | None = None,
                      number: int | None = None) -> DataFrame:
    """Nodes with ``before_x`` (held before this root), flags, and the asked-for values. Parents are held from
    where ``since`` says that they are attached. ``attached`` are the batch's tags (see ``attached_tags``),
    ``number`` how many nodes there are."""
    state = guard_identity(state)
    refs = ["ref_" + r for r in shape.references]
    touched = state_of_batch(state, nodes, number or 0)
    stored = touched.select(*KEYS, F.lit("").alias("seq"), F.lit(0).alias("ord"), "object_id", "slug",
                            *shape.scalars, *refs, F.lit(True).alias("_stored"))
    feed = nodes.unionByName(stored, allowMissingColumns=True).withColumn("_seen", F.lit(True))
    # What a root attaches stands in front of its nodes; no row carries more than that.
    if attached is not None:
        feed = feed.unionByName(tag_events(attached), allowMissingColumns=True)
    else:
        feed = feed.withColumn("_event", F.lit(None).cast(NO_EVENT))
    feed, attached_as = add_attached(feed, since, {r: r[4:] for r in refs})
    feed, chunked = add_chunks(feed, KEYS, "seq", hot_rows)
    # A chunk that all rows share is no key of the window's: dealt by it, the rows would be shuffled once more.
    feed = dealt(feed, number, *KEYS, *([CHUNK] if chunked else []))
    last = ["object_id", *shape.scalars, *attached_as.values(), "_seen", "_stored", "_event"]
    carried = carry_forward(feed, KEYS, ["seq", "ord"], last, ["slug"], chunked)
    carried = split_added(carried.where("seq != '' AND ord >= 0"), "before__event")
    # An object that was not in the inventory got its defaults when it was created.
    held = []
    for c in shape.scalars:
        default = default_of(c)
        filled = (f"coalesce(before_{c}, CASE WHEN before__seen AND before__stored IS NULL THEN {default} END)"
                  if default else f"before_{c}")
        held.append(f"'{c}', {filled}")
    held += [f"'{c}', before_{c}" for c in ("object_id", "slug", "_seen", "_stored")]
    held += [f"'{c}', before_{at}" for c, at in attached_as.items()]
    # Two nodes of one root may be the same object; both are compared with the state before the root.
    same_root = Window.partitionBy(*KEYS, CHUNK, "seq").orderBy("ord")
    carried = carried.withColumn(
        "_last", F.expr(f"named_struct({', '.join(held)})")).withColumn(
        "was", F.first("_last").over(same_root))
    drop = ["before_" + c for c in (*last, "slug")] + ["object_id", "_seen", "_stored", "_event", CHUNK]
    drop += [at for c, at in attached_as.items() if at != c]
    return _compare(carried.drop(*drop), shape)


def _compare(rows: DataFrame, shape: Shape) -> DataFrame:
    asked, after = {}, {}
    refs = ["ref_" + r for r in shape.references]
    for c in shape.scalars:
        default, apart = default_of(c), not_carried(c)
        started = [f"CASE WHEN was._seen IS NULL THEN {default} END"] if default else []
        carried = f"CASE WHEN NOT {apart} THEN was.{c} END" if apart else f"was.{c}"
        asked[c] = f"coalesce({', '.join([c, carried, *started])})"
        after[c] = f"coalesce({', '.join([c, f'_last.{c}', *started])})"
    differs = " OR ".join(f"NOT ({asked[c]} <=> was.{c})" for c in shape.scalars)
    # A parent of another identity; an object without the parent so far is not compared.
    moved = " OR ".join(["false", *[f"coalesce({r} != was.{r}, false)" for r in refs]])
    unset = ", ".join(["CAST(NULL AS STRING)", *[f"CASE WHEN {r} IS NOT NULL AND was.{r} IS NULL THEN '{r[4:]}' END" for r in refs]])
    keys = "object_type, object_key"
    new_id = f"CAST(conv(substring(md5(concat_ws('\\u001f', {keys})), 1, 15), 16, 10) AS BIGINT)"
    rows = rows.selectExpr(
        "*", "was._seen IS NULL AS created", "coalesce(was.slug, slug) AS _slug",
        f"CASE WHEN was._seen THEN coalesce(was.object_id, {new_id}) END AS object_id",
        "split_part(object_key, '\\u001f', 1) AS _name")
    special = {t.name: t.name_field for t in shape.types.values() if t.name_field != "name"}
    plain = f"CASE WHEN object_type NOT IN ({quoted(special)}) THEN _name END" if special else "_name"
    payload = ["'id', object_id", f"'name', {plain}"]
    payload += [f"'{f}', CASE WHEN object_type = '{t}' THEN _name END" for t, f in special.items()]
    payload += ["'slug', _slug", *[f"'{SCALARS[c][1]}', {asked[c]}" for c in shape.scalars]]
    record = [f"'object_id', coalesce(object_id, {new_id})", "'slug', _slug", "'tags', CAST(NULL AS ARRAY<STRUCT<" + _TAG + ">>)"]
    record += [f"'{c}', {after[c]}" for c in shape.scalars]
    record += [f"'{r}', coalesce({r}, _last.{r})" for r in refs]
    return rows.selectExpr(
        "seq", "slot", "ord", *KEYS, "placeholder", "kept", "object_id", "created",
        f"NOT kept AND (created OR {differs}) AS fields_differ",
        "NOT kept AND tags_added > 0 AS tags_differ",
        f"NOT kept AND NOT created AND ({moved}) AS parent_moved",
        f"array_compact(array({unset})) AS unset_parents",
        f"to_json(named_struct({', '.join(payload)})) AS payload",
        "tags_known", "tags_new", f"named_struct({', '.join(record)}) AS record")


def empty_state_columns() -> list[str]:
    return [*KEYS, "object_id", "slug", "tags", *SCALARS, *REFS, "identity"]


__all__ = ["KEYS", "REFS", "default_of", "fold_observations", "guard_identity",
           "not_carried", "state_of_batch", "type_is"]
