"""Ranked lexical search in reverse: documents stream through an inverted index over the items.

The items' terms form an inverted index of bounded size (``POSTINGS``, ``ITEMS``) that is broadcast; more items make
more such shards, each of which the documents pass in turn. A first pass sums the document counts and the number of
documents holding each term; a second one scores every text against all items at once and keeps, for each item, a heap of
its best documents. Only heaps leave a task, so the final merge sees ``TOP`` rows for each item and task.

Terms are compared by two independent 64-bit hashes; all else is exact integer arithmetic.

Defined results: null and texts without a term count nowhere; an item without a term has no rows; an item id with several
different texts has the terms of all of them, equal rows counting once; rows without item id are left out. Every row of
the documents is a document, so rows that share an id are ranked one by one; a row without id counts in the
statistics but can't be ranked. Equal scores go by ascending id. An empty table gives an empty result. Texts are taken whole.
Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshledger.llm.shared import LOWER, UPPER, stage, table
from meshledger.llm.textarrays import Words, slices, words_of

TOP = 10
#: Postings and items of one broadcast shard (about 40 bytes each); a single item is never split.
POSTINGS, ITEMS = 1 << 20, 1 << 16
#: Scores held at once, bytes of text taken at once.
CELLS, SLICE = 1 << 20, 8 << 20
_BITS = 20
#: Terms are the longest runs of ASCII letters, digits and bytes of other characters.
TERM = np.zeros(256, np.uint8)
TERM[np.r_[48:58, 65:91, 97:123, 128:256]] = 1


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, one, two, times): terms of every item as two hashes, with their repeats."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = words_of(part.column("text"), lower=True, kinds=TERM)
                yield pa.RecordBatch.from_arrays(
                    [part.column("item_id").take(pa.array(words.doc())), pa.array(words.hashes(1).view(np.int64)),
                     pa.array(words.hashes(2).view(np.int64))], ["item_id", "one", "two"])

    texts = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id IS NOT NULL").distinct()
    return (texts.mapInArrow(split, "item_id long, one long, two long")
            .groupBy("item_id", "one", "two").agg(F.count("*").alias("times")))


@dataclass
class Index:
    """Postings (item, times) of every term, terms by ascending first hash."""

    one: np.ndarray
    two: np.ndarray
    first: np.ndarray
    item: np.ndarray
    times: np.ndarray
    ids: np.ndarray
    seen: np.ndarray = field(repr=False)

    @staticmethod
    def of(item_id: np.ndarray, one: np.ndarray, two: np.ndarray, times: np.ndarray) -> Index:
        ids, item = np.unique(item_id, return_inverse=True)
        one, two = one.view(np.uint64), two.view(np.uint64)
        order = np.lexsort((item, two, one))
        one, two = one[order], two[order]
        new = np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])] if len(one) else np.empty(0, bool)
        start = np.flatnonzero(new)
        seen = np.zeros(1 << _BITS, bool)
        seen[one >> np.uint64(64 - _BITS)] = True
        return Index(one[start], two[start], np.r_[start, len(one)], item[order], times[order], ids, seen)

    def terms_of(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Words that are terms of the index, and the number of each one's term."""
        code = words.hashes(1)
        maybe = np.flatnonzero(self.seen[code >> np.uint64(64 - _BITS)])
        at = np.searchsorted(self.one, code[maybe])
        found = np.flatnonzero(np.take(self.one, at, mode="clip") == code[maybe])
        maybe, at = maybe[found], at[found]
        other = Words(words.data, words.start[maybe], words.end[maybe], words.first).hashes(2)
        # Terms of equal first hash stand side by side; hardly ever is there a second one.
        while len(step := np.flatnonzero((self.two[at] != other) & (np.take(self.one, at + 1, mode="clip") == self.one[at])
                                         & (at + 1 < len(self.one)))):
            at[step] += 1
        same = self.two[at] == other
        return maybe[same], at[same]

    def counts(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, occurrences), by text and term."""
        word, term = self.terms_of(words)
        key, tf = np.unique(words.doc()[word] * len(self.one) + term, return_counts=True)
        return key // max(len(self.one), 1), key % max(len(self.one), 1), tf


def statistics(docs: DataFrame, index: Index) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and the documents holding each term of the index."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        df, full, total = np.zeros(len(index.one), np.int64), 0, 0
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                words = words_of(part.column("text"), lower=True, kinds=TERM)
                full, total = full + int((words.counts > 0).sum()), total + len(words.start)
                df += np.bincount(index.counts(words)[1], minlength=len(df))
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-2, -1, term]), pa.array(np.r_[full, total, df[term]])], ["term", "n"])

    rows = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    shared.unpersist()
    counts = {row.term: row.n for row in rows}
    return counts.get(-2, 0), counts.get(-1, 0), np.array([counts.get(i, 0) for i in range(len(index.one))], np.int64)


class Heaps:
    """The best documents of every item so far, best first; ties go to the smaller id."""

    def __init__(self, items: int, top: int) -> None:
        self.top = top
        self.least = np.ones(items, np.int64)
        self.item = self.doc = self.score = np.empty(0, np.int64)

    def offer(self, doc: np.ndarray, scores: np.ndarray) -> None:
        """A row of scores for each document; whoever misses an item's full heap is dropped at once."""
        row, item = np.nonzero(scores >= self.least)
        if not len(row):
            return
        item = np.r_[self.item, item]
        score, doc = np.r_[self.score, scores[row, item[len(self.item):]]], np.r_[self.doc, doc[row]]
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        start = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
        size = np.diff(np.r_[start, len(item)])
        keep = np.arange(len(item)) - np.repeat(start, size) < self.top
        self.item, self.score, self.doc = item[keep], score[keep], doc[keep]
        full = size >= self.top
        self.least[item[start[full]]] = score[start[full] + self.top - 1]


def best(docs: DataFrame, index: Index, top: int = TOP) -> DataFrame:
    """(item_id, doc_id, score): the heaps of all tasks, ``top`` rows at most for each item and task."""
    n_docs, n_terms, df = statistics(docs, index)
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((index, weight))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, weight = shared.value
        heaps = Heaps(len(index.ids), top)
        rows = max(1, CELLS // max(len(index.ids), 1))
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                words = words_of(part.column("text"), lower=True, kinds=TERM)
                ids = part.column("doc_id")
                named = ids.is_valid().to_numpy(zero_copy_only=False)
                ids = ids.fill_null(0).to_numpy()
                doc, term, tf = index.counts(words)
                length = 25 + 75 * words.counts.astype(np.int64) * n_docs // max(n_terms, 1)
                gain = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * length[doc]))
                for low in range(0, len(ids), rows):
                    high = min(low + rows, len(ids))
                    heaps.offer(ids[low:high], matrix(index, doc, term, gain, named, low, high))
        yield pa.RecordBatch.from_arrays([pa.array(index.ids[heaps.item]), pa.array(heaps.doc), pa.array(heaps.score)],
                                         ["item_id", "doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        score, "item_id long, doc_id long, score long")


def matrix(index: Index, doc, term, gain, named, low: int, high: int) -> np.ndarray:
    """Scores of the documents low .. high - 1, a column for each item; the gains are sorted by document."""
    out = np.zeros((high - low, len(index.ids)), np.int64)
    span = slice(*np.searchsorted(doc, [low, high]))
    order = np.argsort(term[span], kind="stable")
    doc, term, gain = doc[span][order] - low, term[span][order], gain[span][order]
    edges = np.r_[np.flatnonzero(np.r_[True, term[1:] != term[:-1]]), len(term)] if len(term) else [0]
    for i, j in zip(edges[:-1], edges[1:]):
        posting = slice(index.first[term[i]], index.first[term[i] + 1])
        out[doc[i:j, None], index.item[posting]] += gain[i:j, None] * index.times[posting]
    out[~named[low:high]] = 0
    return out


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of every item with a score above 0."""
    spark = docs.sparkSession
    postings = stage(item_terms(items))
    size = postings.agg(F.count("*"), F.approx_count_distinct("item_id")).first()
    shards = max(1, math.ceil(size[0] / POSTINGS), math.ceil(1.1 * size[1] / ITEMS))
    found = None
    for shard in range(shards):
        part = postings.filter(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == shard).toPandas()
        if len(part):
            index = Index.of(*(part[c].to_numpy(np.int64) for c in ("item_id", "one", "two", "times")))
            heaps = best(docs, index, top)
            found = heaps if found is None else found.unionAll(heaps)
    if found is None:
        found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    by_score = Window.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id")
    return (found.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= top)
            .select("item_id", "rank", "doc_id", "score"))


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents),
sizes AS (SELECT r, doc_id, len(terms) AS n FROM docs WHERE len(terms) > 0),
stats AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM sizes),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM docs) GROUP BY r, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
items AS (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM items) GROUP BY item_id, term),
weights AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, stats),
measures AS (SELECT r, doc_id, 25 + (75 * n * big_n) // big_l AS m FROM sizes, stats),
scored AS (SELECT item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
           FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN measures USING (r)
           WHERE doc_id IS NOT NULL GROUP BY item_id, r, doc_id),
ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
           FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= {TOP}
"""
