"""Tags: which are known, which are new, and every object's tags in the order they were attached."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshledger.functions.scalars import assigned_id
from meshledger.operators.carry import HOT_ROWS
from meshledger.operators.salts import heavy_keys, join_salted
from meshledger.registry import TAG_TYPE
from meshledger.session import stage


def tag_links(nodes: DataFrame) -> DataFrame:
    """One row per observed (object, tag)."""
    return nodes.where(F.col("tags").isNotNull()).select(
        "object_type", "object_key", "seq", "ord", F.posexplode("tags").alias("pos", "tag"),
    ).select("object_type", "object_key", "seq", "ord", "pos", "tag.*")


def first_seen_tags(links: DataFrame, state: DataFrame) -> DataFrame:
    """One row per tag name: where it was first known, its id and its record.

    A tag of the inventory is known from the start; any other is created by the first root that
    carries it and known to the roots after it.
    """
    place = F.struct("seq", "ord", "pos")
    seen = links.select("name", "slug", "color", place.alias("place"), F.lit(None).cast("bigint").alias("id"))
    stored = state.where(F.col("object_type") == TAG_TYPE).select(
        F.col("object_key").alias("name"), "slug", "color",
        F.struct(F.lit("").alias("seq"), F.lit(0).alias("ord"), F.lit(0).alias("pos")).alias("place"),
        F.col("object_id").alias("id"))
    first = stored.unionByName(seen).groupBy("name").agg(
        F.min_by(F.struct("id", "slug", "color", "place"), "place").alias("first"))
    return first.select(
        "name", F.coalesce("first.id", assigned_id(F.lit(TAG_TYPE), F.col("name"))).alias("id"),
        "first.slug", "first.color", F.col("first.place.seq").alias("first_seq"))


def first_attached(links: DataFrame, state: DataFrame) -> DataFrame:
    """One row per (object, tag): where it was attached first, the inventory's own tags before all."""
    stored = state.select("object_type", "object_key", F.posexplode("tags").alias("pos", "tag")).select(
        "object_type", "object_key", F.lit("").alias("seq"), F.lit(0).alias("ord"), "pos", "tag.*")
    both = links.withColumn("id", F.lit(None).cast("bigint")).unionByName(stored)
    place = F.struct("seq", "ord", "pos")
    return both.groupBy("object_type", "object_key", "name").agg(
        F.min_by(F.struct("seq", "ord", "pos", "id", "slug", "color"), place).alias("own")
    ).select("object_type", "object_key", "name", "own.*")


def mark_known(attached: DataFrame, known: DataFrame, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Add the inventory's record of each tag and whether the tag is new in the attaching root. One tag may sit on a
    large share of all objects; only a batch that can have such a tag (``hot_rows``) counts its tags."""
    heavy = None
    if hot_rows is not None:
        attached = stage(attached)
        heavy = heavy_keys(attached, ["name"], hot_rows)
    right = known.select("name", F.struct("id", "slug", "color").alias("known"), "first_seq")
    joined = join_salted(attached, right, ["name"], heavy, "object_type", "object_key")
    return joined.withColumn("is_new", F.coalesce(F.col("first_seq") == F.col("seq"), F.lit(False))
                             & (F.col("seq") != ""))


def attached_tags(nodes: DataFrame, state: DataFrame, touched: DataFrame, hot_rows: int | None = HOT_ROWS) -> DataFrame | None:
    """Every (object, tag) with the place it was attached first, staged; None if the batch and its objects have no tags.
    ``touched`` is the state of the batch's objects."""
    if nodes.where("tags IS NOT NULL").isEmpty() and (state.where("tags IS NOT NULL").isEmpty() or touched.where("tags IS NOT NULL").isEmpty()):
        return None
    links = tag_links(nodes)
    return stage(mark_known(first_attached(links, touched), first_seen_tags(links, state), hot_rows))


def _entry() -> Column:
    return F.struct(
        "seq", "is_new", "ord", "pos", "name",
        F.coalesce("id", "known.id").alias("id"),
        F.when(F.col("seq") == "", F.col("slug")).otherwise(F.coalesce("known.slug", "slug")).alias("slug"),
        F.when(F.col("seq") == "", F.col("color")).otherwise(F.coalesce("known.color", "color")).alias("color"),
        F.struct(F.lit(None).cast("bigint").alias("id"), "name", "slug", "color").alias("observed"))


def tag_events(attached: DataFrame) -> DataFrame:
    """A row for each root that attaches tags to an object, in front of the root's own nodes: what it attaches."""
    entries = F.array_sort(F.collect_list(_entry()))
    return attached.where("seq != ''").groupBy("object_type", "object_key", "seq").agg(entries.alias("entries")).select(
        "object_type", "object_key", "seq", F.lit(-1).alias("ord"), F.struct("seq", "entries").alias("_event"))


def split_added(rows: DataFrame, event: str) -> DataFrame:
    """Per node the tags its root adds to it: ``tags_known`` as the inventory has them, ``tags_new`` as observed."""
    stored = lambda t: F.struct(t["id"], t["name"], t["slug"], t["color"])
    names = F.transform("tags", lambda t: t["name"])
    added = F.when(F.col(event)["seq"] == F.col("seq"), F.filter(F.col(event)["entries"], lambda t: F.array_contains(names, t["name"])))
    rows = rows.withColumn("_added", added)
    return rows.select("*", F.transform(F.filter("_added", lambda t: ~t["is_new"]), stored).alias("tags_known"),
                       F.transform(F.filter("_added", lambda t: t["is_new"]), lambda t: t["observed"]).alias("tags_new"),
                       F.coalesce(F.size("_added"), F.lit(0)).alias("tags_added")).drop("_added")


def with_tags(rows: DataFrame, attached: DataFrame | None) -> DataFrame:
    """Add ``tags_after``: the tags an object has after a row (object, seq, tags_known, tags_new): those of earlier roots in
    the order they were attached, then the known, then the new as observed; and ``tags_held``, the same with the ids that the
    new ones get. The list of an object is joined to the rows that need it and to no others, so it is as large as what
    comes out."""
    empty = F.array().cast(rows.schema["tags_new"].dataType)
    known, new = F.coalesce("tags_known", empty), F.coalesce("tags_new", empty)
    made = F.transform(new, lambda t: F.struct(assigned_id(F.lit(TAG_TYPE), t["name"]).alias("id"), t["name"], t["slug"], t["color"]))
    if attached is None:
        return rows.withColumns({"tags_after": F.concat(known, new), "tags_held": F.concat(known, made)})
    history = attached.groupBy("object_type", "object_key").agg(F.array_sort(F.collect_list(_entry())).alias("_history"))
    before = F.transform(F.filter("_history", lambda t: t["seq"] < F.col("seq")),
                         lambda t: F.struct(t["id"], t["name"], t["slug"], t["color"]))
    joined = rows.join(history, ["object_type", "object_key"], "left")
    joined = joined.withColumn("_before", F.coalesce(before, empty))
    return joined.withColumns({"tags_after": F.concat("_before", known, new), "tags_held": F.concat("_before", known, made)}).drop(
        "_history", "_before")
