"""Nearest neighbours by inner product: stable projections, a kd-tree and a chi-square stopping test.

Largest inner product becomes nearest distance by one more component: candidates are lifted to equal length, a query
is scaled to it. Gaussian (2-stable) projections map that space to a few dimensions, where a squared distance is the
true one times a chi-square variable. Candidates are dealt into blocks by hash of their id; each block is a
kd-tree over projections, stored once. A query visits the leaves of a block in order of their distance in the
projection and verifies true products, until a nearer unseen candidate than the k-th found has probability under
1 - CONFIDENCE. Queries stream past a block, so memory is that of one block.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without
id; only vectors of equal length meet; repeated rows count once, and a query never finds its own id; fewer
candidates than asked give all of them; equal products go to the smaller id; an empty table gives an empty
result. Equal vectors of a block are one point with its k + 1 smallest ids, all that a result can hold. Other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from meshledger.llm.shared import stage, table

#: Neighbours asked for; share of rows that ask is 1 in EVERY; dimensions of the projection (even); points in a leaf.
NEAREST, EVERY, PROJECTED, LEAF = 20, 20, 12, 48
CONFIDENCE = 0.995
#: Candidates in a block, on average.
BLOCK_ROWS = 16_384


def chi_square_quantile(p: float, freedom: int) -> float:
    """For an even number of degrees of freedom, where the distribution is a finite sum; by bisection."""
    low, high = 0.0, 1e4
    for _ in range(200):
        middle = (low + high) / 2
        tail, term = 0.0, math.exp(-middle / 2)
        for i in range(freedom // 2):
            tail, term = tail + term, term * (middle / 2) / (i + 1)
        low, high = (middle, high) if 1 - tail < p else (low, middle)
    return high


def projection(size: int) -> np.ndarray:
    return np.random.default_rng(29).standard_normal((size + 1, PROJECTED))


def leaves_of(points: np.ndarray) -> list[np.ndarray]:
    """Leaves of a kd-tree: split at the median of the widest dimension."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) <= LEAF:
            out.append(rows)
            continue
        axis = np.ptp(points[rows], axis=0).argmax()
        rows = rows[np.argpartition(points[rows, axis], len(rows) // 2)]
        todo += [rows[: len(rows) // 2], rows[len(rows) // 2 :]]
    return out


class Block:
    """One block's candidates, in leaf order."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, length: float, nearest: int):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        distinct, first, which = np.unique(vectors, axis=0, return_index=True, return_inverse=True)
        order = np.argsort(which.ravel(), kind="stable")
        start = np.searchsorted(which.ravel()[order], np.arange(len(distinct)))
        rank = np.arange(len(order)) - start[which.ravel()[order]]
        order = order[rank <= nearest]
        lifted = np.sqrt(np.maximum(length**2 - (distinct**2).sum(axis=1), 0))
        points = np.c_[distinct, lifted] @ projection(distinct.shape[1])
        leaves = leaves_of(points)
        rows = np.concatenate(leaves)
        place = np.empty(len(rows), np.int64)
        place[rows] = np.arange(len(rows))
        group = place[which.ravel()[order]]
        by_group = np.argsort(group, kind="stable")
        self.vectors, self.length = distinct[rows], length
        self.ids = ids[order][by_group]
        self.ids_from = np.searchsorted(group[by_group], np.arange(len(rows) + 1))
        self.leaf_from = np.r_[0, np.cumsum([len(leaf) for leaf in leaves])]
        self.low = np.array([points[leaf].min(axis=0) for leaf in leaves])
        self.high = np.array([points[leaf].max(axis=0) for leaf in leaves])
        self.limit = chi_square_quantile(CONFIDENCE, PROJECTED)
        self.matrix = projection(distinct.shape[1])

    def search(self, query_id: int, query: np.ndarray, nearest: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and products of the nearest found, in order."""
        scale = self.length / np.sqrt(query @ query)
        at = np.r_[query * scale, 0.0] @ self.matrix
        gap = (np.maximum(np.maximum(self.low - at, at - self.high), 0) ** 2).sum(axis=1)
        order = np.argsort(gap)
        seen, product = np.empty(0, np.int64), np.empty(0)
        i, step = 0, 8
        while i < len(order):
            if len(product) > nearest:  # one more than asked, as the query itself may be among them
                worst = -np.partition(-product, nearest)[nearest]
                distance = max(0.0, 2 * self.length**2 - 2 * scale * worst)
                if gap[order[i]] > distance * self.limit:
                    break
            rows = np.concatenate([np.arange(self.leaf_from[j], self.leaf_from[j + 1]) for j in order[i : i + step]])
            seen, product = np.r_[seen, rows], np.r_[product, self.vectors[rows] @ query]
            i, step = i + step, step * 2
        if len(product) > nearest + 1:
            worst = -np.partition(-product, nearest)[nearest]
            near = product >= worst - 1e-9 * (1 + abs(worst))
            seen = seen[near]
        exact = np.zeros(len(seen))
        for i in range(len(query)):  # component after component, as a plain sum goes
            exact += self.vectors[seen, i] * query[i]
        count = self.ids_from[seen + 1] - self.ids_from[seen]
        begin = np.repeat(self.ids_from[seen] - (np.cumsum(count) - count), count)
        ids, value = self.ids[begin + np.arange(count.sum())], np.repeat(exact, count)
        other = ids != query_id
        ids, value = ids[other], value[other]
        best = np.lexsort((ids, -value))[:nearest]
        return ids[best], value[best]


def usable(vector: Column) -> Column:
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(good & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, queries: Column, k: int = NEAREST) -> DataFrame:
    """Rows (query_id, rank, vec_id, score) for the rows of ``vectors`` (vec_id, embedding) that match ``queries``."""
    rows = stage(vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                                F.col("embedding").cast("array<double>").alias("embedding"))
                 .filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).distinct())
    square = F.aggregate("embedding", F.lit(0.0), lambda total, x: total + x * x)
    sizes = {row.size: (row.n, math.sqrt(row.square)) for row in rows.groupBy(F.size("embedding").alias("size"))
             .agg(F.count("*").alias("n"), F.max(square).alias("square")).collect()}
    blocks = {size: max(1, round(n / BLOCK_ROWS)) for size, (n, _) in sizes.items()}
    lengths = {size: length for size, (_, length) in sizes.items()}
    spark = vectors.sparkSession
    plan = spark.createDataFrame([(size, n) for size, n in blocks.items()] or [(0, 1)], "size int, blocks int")
    rows = rows.withColumn("size", F.size("embedding")).join(F.broadcast(plan), "size")
    candidates = rows.select("size", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"),
                             F.lit(0).alias("kind"), "vec_id", "embedding")
    asking = rows.filter(queries).select("size", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
                                         F.lit(1).alias("kind"), "vec_id", "embedding")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted: a block's candidates, then the queries that pass it.
        key, block, ids, parts = None, None, [], []
        for batch in batches:
            at = np.c_[batch.column("size").to_numpy(), batch.column("block").to_numpy(), batch.column("kind").to_numpy()]
            edges = np.r_[0, np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1, len(at)] if len(at) else [0]
            for i, j in zip(edges[:-1], edges[1:]):
                size, number, kind = at[i].tolist()
                vec_id = batch.column("vec_id").slice(i, j - i).to_numpy()
                vector = batch.column("embedding").slice(i, j - i).flatten().to_numpy().reshape(-1, size)
                if key != (size, number):
                    key, block, ids, parts = (size, number), None, [], []
                if kind == 0:
                    ids.append(vec_id)
                    parts.append(vector)
                    continue
                if block is None:
                    if not ids:
                        continue
                    block = Block(np.concatenate(ids), np.concatenate(parts), lengths[size], k)
                found = [block.search(int(one), each, k) for one, each in zip(vec_id, vector)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(vec_id, [len(f[0]) for f in found])),
                     pa.array(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([f[1] for f in found]))],
                    ["query_id", "vec_id", "score"])

    found = (candidates.unionAll(asking).repartition("size", "block")
             .sortWithinPartitions("size", "block", "kind")
             .mapInArrow(search, "query_id long, vec_id long, score double"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)
