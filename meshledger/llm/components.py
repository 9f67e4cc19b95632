"""Connected components of links, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshledger.llm.shared import stage
from meshledger.session import release


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("one", "two"))).collect()[0]
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (one, two) that is not the smallest of its component.

    Large-star and small-star rounds: every node hands its smallest neighbour to its larger ones, then to its
    smaller ones, until each node is linked to the smallest of its component alone. The number of rows never grows,
    minima are combined before they are shuffled, and each round is written out, so lineage stays short."""
    edges = stage(links.select(F.greatest("one", "two").alias("one"), F.least("one", "two").alias("two"))
                  .filter("one <> two").distinct())
    state = _digest(edges)
    while state[0]:
        both = edges.unionAll(edges.select(F.col("two").alias("one"), F.col("one").alias("two")))
        least = both.groupBy("one").agg(F.least(F.min("two"), F.first("one")).alias("least"))
        large = (edges.select(F.col("two").alias("at"), F.col("one").alias("node"))
                 .join(least.withColumnRenamed("one", "at"), "at").select(F.col("node").alias("one"), F.col("least").alias("two")))
        large = large.filter("one <> two").distinct()
        least = large.groupBy("one").agg(F.min("two").alias("least"))
        small = large.join(least, "one").select(F.col("one"), F.col("two"), F.col("least"))
        small = (small.select(F.col("two").alias("one"), F.col("least").alias("two"))
                 .unionAll(small.select("one", F.col("least").alias("two"))).filter("one <> two").distinct())
        edges, before = stage(small), edges
        release(links.sparkSession, before)
        after = _digest(edges)
        if after == state:
            break
        state = after
    return edges.select(F.col("one").alias("node"), F.col("two").alias("component"))
