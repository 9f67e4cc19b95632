"""Interpolated modified Kneser-Ney bigram model, counted in Spark, kept as sorted hash arrays on the shared folder.

A text is a start mark, its words in lower case A-Z, and an end that is predicted like a word. Tasks count their bigrams by hash
before the shuffle; a shard of the hash range is merged by one task and written as two arrays, hashes in order and counts, that
workers map into memory. A second pass looks each training bigram up: an occurrence of a bigram of count c is 1/c of a
distinct bigram, so sums over occurrences give every word's count, its followers of count 1, 2 and more, and the number of
words it follows. These become the word arrays. Scoring maps both and needs no shuffle.

The shared folder (``spark.checkpoint.dir``) has to be a file system that workers mount, as they map its files; the
model grows with the corpus and stays there. Shards are written under another name first, so a task may run again.

Defined results: a null text is empty and an empty text is its end alone; a row without id is held out; repeated rows
count and are scored each; with no training text every score is that of one unknown token, 0. Texts are taken whole.
Other columns are not read.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshledger.llm.shared import held_out, settle, table
from meshledger.llm.textarrays import mix, slices, words_of
from meshledger.session import ensure_checkpoint_dir

#: Bits of the hash that choose a shard; tokens counted at once within a task.
SHARD_BITS, COMBINED = 9, 1 << 21
_U = np.uint64
START, END = _U(0x9B05688C2B3E6C1F), _U(0x1F83D9ABFB41BD6B)
#: Counts of pairs and followers are floats: exact up to 2 ** 24, then to 7 digits, and never wrap round.
PAIR = np.dtype("<f4")
WORD = np.dtype([("count", "<u8"), ("follows", "<f4"), ("gamma", "<f4")])


def tokens(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of start mark, words and end of all texts, and the borders of the texts."""
    words = words_of(text, lower=True)
    border = words.first + 2 * np.arange(len(words.first))
    out = np.empty(border[-1], _U)
    inner = np.ones(len(out), bool)
    inner[border[:-1]] = inner[border[1:] - 1] = False
    out[border[:-1]], out[border[1:] - 1] = START, END
    out[inner] = words.hashes()
    return out, border


def pairs(token: np.ndarray, border: np.ndarray) -> np.ndarray:
    """Hash of each token that is predicted together with the one before."""
    follow = np.ones(len(token), bool)
    follow[border[:-1]] = False
    at = np.flatnonzero(follow)
    return mix(token[at - 1] * _U(0x9E3779B97F4A7C15) + mix(token[at] ^ _U(0x3C6EF372FE94F82B)))


def shard_of(value: np.ndarray) -> np.ndarray:
    return (value >> _U(64 - SHARD_BITS)).astype(np.int64)


def model_folder(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    place = urlsplit(spark.sparkContext.getCheckpointDir())
    if place.scheme not in ("", "file"):
        raise ValueError(f"spark.checkpoint.dir must be a mounted file system to be mapped into memory: {place.geturl()}")
    folder = os.path.join(place.path, f"bigrams-{uuid.uuid4().hex}")
    os.makedirs(folder)
    return folder


def save(folder: str, name: str, value: np.ndarray) -> None:
    temporary = os.path.join(folder, f".{name}-{uuid.uuid4().hex}")
    with open(temporary, "wb") as file:
        np.save(file, value)
    os.replace(temporary, os.path.join(folder, f"{name}.npy"))


class Arrays:
    """Sorted hash arrays of a folder, mapped shard by shard when first asked for."""

    def __init__(self, folder: str, kind: str, dtype: np.dtype):
        self.folder, self.kind, self.dtype = folder, kind, dtype
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def shard(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        if number not in self.open:
            path = os.path.join(self.folder, f"{self.kind}-hash-{number:04d}.npy")
            self.open[number] = (np.empty(0, _U), np.empty(0, self.dtype)) if not os.path.exists(path) else (
                np.load(path, mmap_mode="r"), np.load(path.replace("-hash-", "-value-"), mmap_mode="r"))
        return self.open[number]

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of keys in ascending order; zero for those that are missing."""
        out = np.zeros(len(keys), self.dtype)
        border = np.searchsorted(shard_of(keys), np.arange((1 << SHARD_BITS) + 1))
        for number in np.flatnonzero(np.diff(border)).tolist():
            part = slice(border[number], border[number + 1])
            hashes, values = self.shard(number)
            if len(hashes):
                at = np.minimum(np.searchsorted(hashes, keys[part]), len(hashes) - 1)
                out[part] = np.where(hashes[at] == keys[part], values[at], np.zeros(1, self.dtype))
        return out


def merged(key: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct keys in order with the sums of their values."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    return key[start], [np.add.reduceat(v[order], start) if len(start) else v for v in values]


def _by_shard(rows: DataFrame) -> DataFrame:
    shard = F.shiftrightunsigned("hash", 64 - SHARD_BITS)
    return rows.repartition(shard).sortWithinPartitions("hash")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """Shards of sorted rows in turn: number, distinct hashes, summed columns. Signed order puts the upper half of
    the hashes first, whole shards at a time."""
    held: list[pa.RecordBatch] = []
    number = None

    def close():
        columns = [np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(held[0].num_columns)]
        return number, *merged(columns[0].view(_U), columns[1:])

    for batch in batches:
        shard = shard_of(batch.column(0).to_numpy().view(_U))
        cut = np.flatnonzero(np.diff(shard)) + 1
        for i, j in zip(np.r_[0, cut], np.r_[cut, len(shard)]):
            if i == j:
                continue
            if held and shard[i] != number:
                yield close()
                held = []
            number = int(shard[i])
            held.append(batch.slice(int(i), int(j - i)))
    if held:
        yield close()


def count_bigrams(texts: DataFrame, folder: str) -> np.ndarray:
    """Write the bigram arrays; numbers of bigrams of count 1, 2, 3, 4 and of all."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def combined() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["hash", "n"])

        for batch in batches:
            for part in slices(batch, "text"):
                held.append(pairs(*tokens(part.column("text"))))
                size += len(held[-1])
                if size >= COMBINED:
                    yield combined()
                    held, size = [], 0
        if held:
            yield combined()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(5, np.int64)
        for number, key, (n,) in _runs(batches):
            save(folder, f"pair-hash-{number:04d}", key)
            save(folder, f"pair-value-{number:04d}", n.astype(PAIR))
            total += [*(np.sum(n == k) for k in (1, 2, 3, 4)), len(n)]
        yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in total], ["n1", "n2", "n3", "n4", "n"])

    rows = texts.select("text").mapInArrow(count, "hash long, n long")
    out = _by_shard(rows).mapInArrow(write, "n1 long, n2 long, n3 long, n4 long, n long").groupBy().sum().collect()[0]
    return np.array([x or 0 for x in out])


def discounts(n: np.ndarray) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and more, from the numbers of counts 1 to 4; a half where these are missing."""
    n1, n2, n3, n4 = (float(x) for x in n[:4])
    if not n1 or not n2:
        return np.array([0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.5]
    return np.array([0, *(x if 0 < x <= k + 1 else 0.5 for k, x in enumerate(d))])


def count_words(texts: DataFrame, folder: str, discount: np.ndarray) -> dict[str, float]:
    """Write the word arrays; number of tokens, of words, and of words that follow 1, 2, 3, 4 and any words."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = Arrays(folder, "pair", PAIR)
        keys: list[np.ndarray] = []
        sums: list[list[np.ndarray]] = []
        size = 0

        def combined() -> pa.RecordBatch:
            key, values = merged(np.concatenate(keys), [np.concatenate(v) for v in zip(*sums)])
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *map(pa.array, values)],
                                              ["hash", "n", "once", "twice", "more", "follows"])

        for batch in batches:
            for part in slices(batch, "text"):
                token, border = tokens(part.column("text"))
                pair, which = np.unique(pairs(token, border), return_inverse=True)
                c = arrays.get(pair)[which].astype(float)
                later = np.ones(len(token), bool)
                later[border[:-1]] = False
                earlier = np.ones(len(token), bool)
                earlier[border[1:] - 1] = False
                one = np.ones(len(token))
                once, twice, more, follows = (np.zeros(len(token)) for _ in range(4))
                once[earlier], twice[earlier], more[earlier] = c == 1, (c == 2) / 2, (c > 2) / c
                follows[later] = 1 / c
                key, values = merged(token, [one, once, twice, more, follows])
                keys.append(key)
                sums.append(values)
                size += len(key)
                if size >= COMBINED:
                    yield combined()
                    keys, sums, size = [], [], 0
        if keys:
            yield combined()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(7)
        for number, key, (n, once, twice, more, follows) in _runs(batches):
            value = np.zeros(len(key), WORD)
            value["count"] = np.rint(n)
            value["follows"] = np.rint(follows)
            value["gamma"] = (discount[1] * np.rint(once) + discount[2] * np.rint(twice) + discount[3] * np.rint(more)) / n
            save(folder, f"word-hash-{number:04d}", key)
            save(folder, f"word-value-{number:04d}", value)
            words = value[key != START]
            total += [words["count"].sum(), len(words), *(np.sum(words["follows"] == k) for k in (1, 2, 3, 4)),
                      words["follows"].sum(dtype=float)]
        yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in total], ["tokens", "words", "n1", "n2", "n3", "n4", "n"])

    rows = texts.select("text").mapInArrow(
        count, "hash long, n double, once double, twice double, more double, follows double")
    out = _by_shard(rows).mapInArrow(
        write, "tokens long, words long, n1 long, n2 long, n3 long, n4 long, n long").groupBy().sum().collect()[0]
    return dict(zip(("tokens", "words", "n1", "n2", "n3", "n4", "n"), (x or 0 for x in out)))


def train(texts: DataFrame) -> dict:
    """Fit the model on all rows of (text); what ``scored`` needs besides the arrays of its folder."""
    spark = texts.sparkSession
    folder = model_folder(spark)
    texts = texts.select("text")
    discount = discounts(count_bigrams(texts, folder))
    settle(spark)
    words = count_words(texts, folder, discount)
    settle(spark)
    return {"folder": folder, "discount": discount, "words": words,
            "lower": discounts(np.array([words[k] for k in ("n1", "n2", "n3", "n4")]))}


def scored(docs: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of every row with n_tokens, n_known, base_score and score."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder, discount, lower, total = model["folder"], model["discount"], model["lower"], model["words"]
        pair_arrays, word_arrays = Arrays(folder, "pair", PAIR), Arrays(folder, "word", WORD)
        n, v, types = total["tokens"], total["words"], total["n"]
        n1, n2 = total["n1"], total["n2"]
        spread = (lower[1] * n1 + lower[2] * n2 + lower[3] * max(0, v - n1 - n2)) / types if types else 1.0
        for batch in batches:
            for part in slices(batch, "__text"):
                token, border = tokens(part.column("__text"))
                word, which = np.unique(token, return_inverse=True)
                known = word_arrays.get(word)
                base = np.log10((known["count"] + 0.1) / (n + 0.1 * (v + 1)))
                follows = known["follows"].astype(float)
                unigram = np.maximum(follows - lower[np.minimum(follows, 3).astype(int)], 0) / max(types, 1) + spread / (v + 1)
                later = np.ones(len(token), bool)
                later[border[:-1]] = False
                at = np.flatnonzero(later)
                pair, pair_of = np.unique(pairs(token, border), return_inverse=True)
                c = pair_arrays.get(pair)[pair_of]
                before, now = which[at - 1], which[at]
                seen = known["count"][before]
                gamma = np.where(seen > 0, known["gamma"][before], 1.0)
                p = np.where(c > 0, (c - discount[np.minimum(c, 3).astype(int)]) / np.maximum(seen, 1), 0.0) + gamma * unigram[now]
                first = border[:-1] - np.arange(len(border) - 1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(len(keep))]
                    + [pa.array(np.diff(border) - 1), pa.array(np.add.reduceat(known["count"][now] > 0, first, dtype=np.int64)),
                       pa.array(np.add.reduceat(base[now], first)), pa.array(np.add.reduceat(np.log10(p), first))],
                    [*keep, "n_tokens", "n_known", "base_score", "score"])

    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(
        score, f"{fields}, n_tokens long, n_known long, base_score double, score double")


def op2_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id"), 10, 0))
    model = train(docs.filter("NOT held_out"))
    return scored(docs, model, ["doc_id", "held_out"]).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(int(model["words"]["tokens"])).cast("long").alias("train_tokens"),
        "base_score", "score")
