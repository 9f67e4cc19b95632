"""Look-ups of observed objects in the current state, set-wise instead of one call per object."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshledger.operators.fold import KEYS, guard_identity


def lookup_state(nodes: DataFrame, state: DataFrame) -> DataFrame:
    """Nodes with the id of the stored object they match, null when there is none.

    Interfaces and addresses match only if name and scope agree.
    """
    found = guard_identity(state).select(*KEYS, F.col("object_id").alias("matched_id"))
    return nodes.join(found, KEYS, "left")


def known_tags(links: DataFrame, tags: DataFrame) -> DataFrame:
    return links.join(tags.select("name"), "name", "left_semi")


def new_tags(links: DataFrame, tags: DataFrame) -> DataFrame:
    return links.join(tags.select("name"), "name", "left_anti")
