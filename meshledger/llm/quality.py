"""Quality classifier: random-indexing word vectors, pooled per document, under a two-layer network.

Every word has a fixed sparse random index vector (its places and signs follow from its hash). The context vector
of a word is the sum of the index vectors of its neighbours over the whole corpus; words share a fixed number of
buckets by hash, so the vectors have a proven size. A text is pooled as mean and spread of its words' vectors.
A network of two layers is trained in numpy on a bounded labelled sample; a temperature fitted on a part it has not
seen calibrates its probabilities. Words here are runs of letters and digits, or of other signs.

Defined results: null and empty texts pool to zeros and get the network's score for these; without labels of both kinds
every score is 0.5. Repeated rows are scored alike. A row without id counts as held out. Texts are taken whole.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshledger.llm.shared import held_out, labelled_sample, table
from meshledger.llm.textarrays import SIGNS, mix, slices, words_of

#: Buckets of words, length of a vector, nonzero places of an index vector, neighbours on each side.
BUCKETS, SIZE, PLACES, NEIGHBOURS = 1 << 14, 32, 4, 2
#: Labelled documents used at most; width of the hidden layer; rounds; share kept for the temperature.
SAMPLE_DOCS, HIDDEN, ROUNDS, KEPT = 8000, 32, 400, 0.2
#: Buckets in a row of the summed vectors.
BLOCK = 256
THRESHOLD = 0.7


def _buckets(text: pa.Array):
    words = words_of(text, kinds=SIGNS)
    return words, (words.hashes() % np.uint64(BUCKETS)).astype(np.int64)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero values of every bucket's index vector."""
    value = mix(np.arange(BUCKETS * PLACES, dtype=np.uint64) + np.uint64(11)).reshape(BUCKETS, PLACES)
    return (value % np.uint64(SIZE)).astype(np.int64), np.where(value >> np.uint64(63), 1.0, -1.0)


def context_vectors(docs: DataFrame) -> np.ndarray:
    """Context vectors of all buckets, of length 1 or 0, summed over every text."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sign = index_vectors()
        total = np.zeros(BUCKETS * SIZE)
        for batch in batches:
            for part in slices(batch, "text"):
                words, bucket = _buckets(part.column("text"))
                doc = words.doc()
                for gap in range(1, NEIGHBOURS + 1):
                    here = np.flatnonzero(doc[gap:] == doc[:-gap])
                    for one, other in ((bucket[here], bucket[here + gap]), (bucket[here + gap], bucket[here])):
                        at = (one[:, None] * SIZE + place[other]).ravel()
                        total += np.bincount(at, sign[other].ravel(), BUCKETS * SIZE)
        rows = total.reshape(-1, BLOCK * SIZE)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows))), pa.array([row.tobytes() for row in rows], pa.binary())],
                                         ["block", "vectors"])

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(row) for row in part["vectors"])
        return pd.DataFrame({"block": part["block"][:1], "vectors": [total.tobytes()]})

    rows = (docs.select("text").filter("text IS NOT NULL").mapInArrow(add, "block long, vectors binary")
            .groupBy("block").applyInPandas(merge, "block long, vectors binary").collect())
    out = np.zeros((BUCKETS // BLOCK, BLOCK * SIZE))
    for row in rows:
        out[row.block] = np.frombuffer(row.vectors)
    out = out.reshape(BUCKETS, SIZE)
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(length > 0, length, 1)).astype(np.float32)


def pool(text: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Mean and standard deviation of the word vectors of each text."""
    words, bucket = _buckets(text)
    out = np.zeros((len(words.first) - 1, 2 * SIZE))
    full = np.flatnonzero(words.counts)
    if not len(full):
        return out
    n = words.counts[full, None]
    for i in range(SIZE):  # a dimension at a time keeps temporary arrays to a word's size
        value = vectors[:, i][bucket].astype(float)
        mean = np.add.reduceat(value, words.first[full]) / n[:, 0]
        square = np.add.reduceat(value * value, words.first[full]) / n[:, 0]
        out[full, i], out[full, SIZE + i] = mean, np.sqrt(np.maximum(square - mean * mean, 0))
    return out


@dataclass
class Network:
    centre: np.ndarray
    spread: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: float
    temperature: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum((x - self.centre) / self.spread @ self.first + self.first_bias, 0)
        return hidden @ self.second + self.second_bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -500, 500)))


def train(x: np.ndarray, label: np.ndarray, seed: int = 7) -> Network:
    """Full-batch Adam on the log loss with weight decay, then the temperature of least loss on the kept part."""
    rng = np.random.default_rng(seed)
    kept = rng.random(len(x)) < KEPT
    if len(set(label[kept].tolist())) < 2 or len(set(label[~kept].tolist())) < 2:
        kept = np.ones(len(x), bool)
        fit = kept
    else:
        fit = ~kept
    spread = x[fit].std(axis=0) + 1e-3
    net = Network(x[fit].mean(axis=0), spread, rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)),
                  np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), 0.0, 1.0)
    z, y = (x[fit] - net.centre) / spread, label[fit]
    names = ("first", "first_bias", "second", "second_bias")
    speed, square = {n: 0.0 for n in names}, {n: 0.0 for n in names}
    for step in range(1, ROUNDS + 1):
        inner = z @ net.first + net.first_bias
        hidden = np.maximum(inner, 0)
        error = (1 / (1 + np.exp(-np.clip(hidden @ net.second + net.second_bias, -500, 500))) - y) / len(y)
        back = np.outer(error, net.second) * (inner > 0)
        slope = {"first": z.T @ back + 1e-4 * net.first, "first_bias": back.sum(axis=0),
                 "second": hidden.T @ error + 1e-4 * net.second, "second_bias": error.sum()}
        for name in names:
            speed[name] = 0.9 * speed[name] + 0.1 * slope[name]
            square[name] = 0.999 * square[name] + 0.001 * slope[name] ** 2
            move = speed[name] / (1 - 0.9**step) / (np.sqrt(square[name] / (1 - 0.999**step)) + 1e-8)
            setattr(net, name, getattr(net, name) - 0.01 * move)
    logit = net.logit(x[kept])
    grid = np.geomspace(0.25, 8, 60)
    sign = np.where(label[kept] > 0, 1, -1)
    net.temperature = float(grid[np.argmin([np.logaddexp(0, -sign * logit / t).mean() for t in grid])])
    return net


def pooled(docs: DataFrame, vectors: np.ndarray, keep: list[str], net: Network | None = None) -> DataFrame:
    """Columns ``keep`` of every row with its pooled vector, or its score under a network."""
    model = docs.sparkSession.sparkContext.broadcast((vectors, net))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, net = model.value
        for batch in batches:
            for part in slices(batch, "__text"):
                x = pool(part.column("__text"), vectors)
                value = pa.array(net.score(x)) if net else pa.array(list(x), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keep))] + [value], [*keep, "value"])

    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(
        run, f"{fields}, value {'double' if net else 'array<double>'}")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rest = held_out(F.col("doc_id"), 4, 2)
    vectors = context_vectors(docs)
    known = pooled(labelled_sample(docs, labels, "quality", rest, SAMPLE_DOCS), vectors, ["doc_id", "label"]).toPandas()
    known = known.sort_values("doc_id")
    if known["label"].nunique() == 2:
        net = train(np.stack(known["value"].to_numpy()), known["label"].to_numpy(float))
    else:
        net = Network(np.zeros(2 * SIZE), np.ones(2 * SIZE), np.zeros((2 * SIZE, HIDDEN)), np.zeros(HIDDEN),
                      np.zeros(HIDDEN), 0.0, 1.0)
    scored = pooled(docs, vectors, ["doc_id"], net)
    return scored.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), F.col("value").alias("score"),
                         (F.col("value") >= THRESHOLD).cast("int").alias("predicted"))
