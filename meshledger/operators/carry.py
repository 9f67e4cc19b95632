"""Carry-forward: what was last known of a key before each row, in arrival order.

Taking the last known value is associative, so a key with very many rows need not stay in one
task: its rows are cut into consecutive chunks, each chunk is summed up by one row, the few
summaries are run through in order, and every chunk then starts from what the earlier ones left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshledger.session import stage

# A key with more rows than this in one batch is cut into chunks.
HOT_ROWS = 500_000
CHUNKS = 256
# Split points that are compared at once.
BLOCK = 16
SPLIT_SAMPLE = 8_192
# Hot keys are at most rows / HOT_ROWS; broadcast them only when that is few.
BROADCAST_KEYS = 100_000

CHUNK = "_chunk"


def hot_keys(rows: DataFrame, keys: Sequence[str], hot_rows: int | None) -> tuple[DataFrame | None, int]:
    """The keys over the limit and their number; counting combines before it shuffles."""
    if hot_rows is None:
        return None, 0
    hot = stage(rows.groupBy(*keys).count().where(F.col("count") > hot_rows).select(*keys))
    number = hot.count()
    return (hot, number) if number else (None, 0)


def add_chunks(rows: DataFrame, keys: Sequence[str], order: str, hot_rows: int | None,
               chunks: int = CHUNKS) -> tuple[DataFrame, bool]:
    """Add the chunk of every row: 0 for ordinary keys, the position in arrival order for hot ones.

    The split points only balance the work; any split points give the same result.
    """
    hot, number = hot_keys(rows, keys, hot_rows)
    if hot is None:
        return rows.withColumn(CHUNK, F.lit(0)), False
    hot = hot.withColumn("_hot", F.lit(True))
    side = F.broadcast(hot) if number <= BROADCAST_KEYS else hot
    marked = rows.join(side, list(keys), "left")
    spread = (marked.where("_hot").select(order).distinct()
              .orderBy(F.xxhash64(order)).limit(SPLIT_SAMPLE).collect())
    ranked = sorted(row[0] for row in spread)
    points = ranked[:: max(1, len(ranked) // chunks)]
    bounds, coarse = (F.array(*[F.lit(p) for p in some]) for some in (points, points[::BLOCK]))
    upto = lambda some: F.size(F.filter(some, lambda b: b <= F.col(order)))
    # The block of points a row falls into first, then its place in there: few comparisons for each row.
    first = (F.col("_block") - 1) * BLOCK
    marked = marked.withColumn("_block", F.when(F.col("_hot"), upto(coarse)).otherwise(0))
    position = F.when(F.col("_block") > 0, first + upto(F.slice(bounds, first + 1, F.lit(BLOCK)))).otherwise(0)
    return marked.withColumn(CHUNK, position).drop("_hot", "_block"), True


def carry_forward(rows: DataFrame, keys: Sequence[str], order: Sequence[str], last: Sequence[str],
                  first: Sequence[str] = (), chunked: bool = False, prefix: str = "before_") -> DataFrame:
    """Add ``before_x`` for every x: its last (or first) known value in the rows before this one.

    ``rows`` must have gone through :func:`add_chunks`; ``chunked`` says whether it cut any key.
    """
    parts = [*keys, CHUNK]
    window = Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = {c: F.last(c, ignorenulls=True).over(window) for c in last}
    inside |= {c: F.first(c, ignorenulls=True).over(window) for c in first}
    if not chunked:
        return rows.select("*", *[v.alias(prefix + c) for c, v in inside.items()])

    place = F.struct(*order)
    sums = [F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in last]
    sums += [F.min_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in first]
    # An ordinary key has one chunk, which starts from nothing: only hot keys are summed up.
    summed = rows.where(F.col(CHUNK) > 0).groupBy(*parts).agg(*sums)
    opening = rows.where(F.col(CHUNK) == 0).join(
        summed.select(*keys).distinct(), list(keys), "left_semi").groupBy(*parts).agg(*sums)
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    start = summed.unionByName(opening).select(
        *parts,
        *[F.last(c, ignorenulls=True).over(earlier).alias("_start_" + c) for c in last],
        *[F.first(c, ignorenulls=True).over(earlier).alias("_start_" + c) for c in first],
    )
    joined = rows.join(start, parts, "left")
    merged = [F.coalesce(inside[c], F.col("_start_" + c)).alias(prefix + c) for c in last]
    merged += [F.coalesce(F.col("_start_" + c), inside[c]).alias(prefix + c) for c in first]
    return joined.select("*", *merged).drop(*["_start_" + c for c in (*last, *first)])
