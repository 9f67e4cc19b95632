"""Language identification by segmentation-marginalised unigrams.

A language is a probability for every piece of a fixed public vocabulary (single bytes included, so any text
has a segmentation). The probability of a word is the sum over all its segmentations into pieces, computed by
the forward algorithm; a text is the product over its words, so each distinct word of a task is summed once.
Piece probabilities are fitted by expectation maximisation on a bounded sample of training documents, with
expected counts, of words of any length, summed in Spark; the driver holds a number for each piece and language.

Defined results: null texts and texts without any letter give ``und`` with score 0; without any training
document every text is ``und``. Repeated rows are scored alike, one result a row; a row without id counts as held out. Texts of
any length are scored whole. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshledger.llm.pieces import VOCABULARY, Lookup, blocks, read_pieces
from meshledger.llm.shared import SPACE_CLASS, SPACES, few_rows, held_out, sample_rows, table
from meshledger.llm.textarrays import slices, words_of

#: Training documents at most; rounds of expectation maximisation; pseudo-count of every piece.
SAMPLE_DOCS, ROUNDS, PSEUDO = 4000, 2, 0.05
#: Distinct words a task remembers.
REMEMBERED = 400_000
#: Documents in an Arrow batch of the pipeline's stage, which carries whole texts there and back.
TEXTS = 1_000
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_RESCALE = 8
#: Places, and bytes of a block of words, whose pieces are held at once.
_STRETCH, _CELLS = 4096, 1 << 18


def forward(lookup: Lookup, matrix: np.ndarray, length: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Log probability of each word (row) under each column of ``chance`` (pieces x languages)."""
    rows, languages = len(matrix), chance.shape[1]
    ring = lookup.longest + 2  # ends reach that far, and the place before the last is cleared late
    sums = np.zeros((ring, rows, languages))
    sums[0] = 1
    scale = np.zeros((rows, languages))
    out = np.empty((rows, languages))

    def close(at: int) -> None:
        done = length == at
        if done.any():
            out[done] = np.log(sums[at % ring, done]) + scale[done]

    last = 0

    def advance(to: int) -> None:
        nonlocal last
        while last < to:  # nothing ends at or before ``to`` any more
            if last:
                close(last)
                sums[(last - 1) % ring] = 0
                if last % _RESCALE == 0:
                    top = sums.max(axis=0)
                    top[top == 0] = 1
                    sums[:] /= top
                    scale[:] += np.log(top)
            last += 1

    for start, end, at, number in lookup.matches(matrix, length):
        advance(start)
        sums[end % ring, at] += sums[start % ring, at] * chance[number]
    advance(matrix.shape[1])
    close(matrix.shape[1])
    return out


def _steps(lookup: Lookup, matrix: np.ndarray, length: np.ndarray, chance: np.ndarray, language: np.ndarray,
           low: int, high: int) -> list[tuple]:
    """(start, end, rows, numbers, probabilities) of all pieces that start from ``low`` to before ``high``."""
    rows = int(np.searchsorted(-length, -low, "left"))  # words longer than ``low``
    width = min(matrix.shape[1], high + lookup.longest) - low
    out = []
    for start, end, at, number in lookup.matches(matrix[:rows, low : low + width], np.minimum(length[:rows] - low, width)):
        if start >= high - low:
            break
        out.append((low + start, low + end, at, number, chance[number, language[at]]))
    return out


def expected_counts(lookup: Lookup, matrix: np.ndarray, length: np.ndarray, chance: np.ndarray,
                    language: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected piece counts (pieces x languages) of words of known language, by forward and backward sums.

    Words may have any length: sums of ``_RESCALE`` neighbouring places share a scale for each word, and pieces are
    looked up for a stretch of places at a time."""
    rows, width = len(matrix), matrix.shape[1]
    span = min(_STRETCH, max(64, _CELLS // max(1, rows))) // _RESCALE * _RESCALE
    stretches = [(low, min(low + span, width)) for low in range(0, width, span)]
    reach = lookup.longest // _RESCALE + 2
    groups = width // _RESCALE + 1
    ahead, behind = np.zeros((width + 1, rows)), np.zeros((width + 1, rows))
    ahead_scale, behind_scale = np.zeros((groups, rows)), np.zeros((groups, rows))
    ahead[0] = 1
    behind[length, np.arange(rows)] = 1
    group = 0

    def enter(to: int) -> None:
        """Give the groups up to ``to`` their scale; nothing more is added to places before them."""
        nonlocal group
        while group < to:
            group += 1
            window = ahead[group * _RESCALE : group * _RESCALE + lookup.longest]
            top = window.max(axis=0)
            top[top == 0] = 1
            window /= top
            ahead_scale[group] = ahead_scale[group - 1] + np.log(top)

    for low, high in stretches:
        steps = _steps(lookup, matrix, length, chance, language, low, high)
        for start, end, at, _, p in steps:
            enter(start // _RESCALE)
            ahead[end, at] += ahead[start, at] * p
    enter(groups - 1)
    each = np.arange(rows)
    total = np.log(ahead[length, each]) + ahead_scale[length // _RESCALE, each]
    out = np.zeros(chance.shape)
    group = groups
    for low, high in reversed(stretches):
        if len(stretches) > 1:
            steps = _steps(lookup, matrix, length, chance, language, low, high)
        for start, end, at, number, p in reversed(steps):
            while group > start // _RESCALE:
                group -= 1
                if group + 1 < groups:
                    top = behind[(group + 1) * _RESCALE : (group + 2) * _RESCALE].max(axis=0)
                    top[top == 0] = 1
                    behind_scale[group] = behind_scale[group + 1] + np.log(top)
                    behind_scale[group, length // _RESCALE <= group] = 0
                nearby = behind_scale[group : group + reach]
                change = np.exp(nearby - behind_scale[group])
                share = np.exp(ahead_scale[group] + nearby - total) * weight
            after, inside = end // _RESCALE - group, behind[end, at] * p
            behind[start, at] += inside * change[after, at]
            np.add.at(out, (number, language[at]), ahead[start, at] * inside * share[after, at])
    return out


def fit(docs: DataFrame, vocabulary: str = VOCABULARY) -> tuple[list[str], Lookup, np.ndarray]:
    """Languages, piece look-up and piece probabilities from rows (doc_id, text, lang), all usable as labels."""
    spark = docs.sparkSession
    strings = read_pieces(vocabulary)
    usable = [text for text in dict.fromkeys(strings) if text and b" " not in text[1:]]
    lookup = Lookup.of(usable)
    labelled = docs.filter("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL")
    chosen = sample_rows(labelled.select("doc_id").distinct(), F.col("doc_id"), SAMPLE_DOCS)
    words = (labelled.join(F.broadcast(chosen), "doc_id")
             .select("lang", F.explode(F.split(F.trim("text", F.lit(SPACES)), SPACE_CLASS)).alias("word"))
             .groupBy("lang", "word").count()
             .filter(F.octet_length("word") >= 1).persist())
    languages = sorted(row.lang for row in words.select("lang").distinct().collect())
    place = {language: i for i, language in enumerate(languages)}
    chance = np.full((len(usable), max(1, len(languages))), 1 / len(usable))
    for _ in range(ROUNDS if languages else 0):
        current = spark.sparkContext.broadcast((lookup, chance))

        def count(batches: Iterator[pa.RecordBatch], current=current) -> Iterator[pa.RecordBatch]:
            lookup, chance = current.value
            total = np.zeros(chance.shape)
            for batch in batches:
                word = words_of(batch.column("word"))
                language = np.array([place[name] for name in batch.column("lang").to_pylist()], np.int64)
                weight = batch.column("count").to_numpy().astype(float)
                for rows, matrix, length in blocks(word.data, word.start, word.end):
                    total += expected_counts(lookup, matrix, length, chance, language[rows], weight[rows])
            piece, language = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(language), pa.array(total[piece, language])],
                                             ["piece", "language", "n"])

        sums = (words.repartition(8).mapInArrow(count, "piece long, language long, n double")
                .groupBy("piece", "language").agg(F.sum("n").alias("n")).toPandas())
        chance = np.full(chance.shape, PSEUDO)
        chance[sums["piece"], sums["language"]] += sums["n"]
        chance /= chance.sum(axis=0)
        current.destroy()
    words.unpersist()
    return languages, lookup, chance


class WordScores:
    """Log probabilities of distinct words, remembered within a task up to a bound."""

    def __init__(self, lookup: Lookup, chance: np.ndarray):
        self.lookup, self.chance = lookup, chance
        self.known, self.value = np.empty(0, np.uint64), np.empty((0, chance.shape[1]))

    def of(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Scores of words that are pairwise distinct, in ascending order of hash."""
        at = np.minimum(np.searchsorted(self.known, hashes), max(0, len(self.known) - 1))
        seen = self.known[at] == hashes if len(self.known) else np.zeros(len(hashes), bool)
        out = np.empty((len(hashes), self.chance.shape[1]))
        out[seen] = self.value[at[seen]]
        new = np.flatnonzero(~seen)
        fresh = np.empty((len(new), self.chance.shape[1]))
        for rows, matrix, length in blocks(data, start[new], end[new]):
            fresh[rows] = forward(self.lookup, matrix, length, self.chance)
        out[new] = fresh
        if len(self.known) + len(new) > REMEMBERED:
            self.known, self.value = hashes[new], fresh
        else:
            known = np.concatenate([self.known, hashes[new]])
            order = np.argsort(known, kind="stable")
            self.known, self.value = known[order], np.concatenate([self.value, fresh])[order]
        return out


def identify(docs: DataFrame, model: tuple[list[str], Lookup, np.ndarray], keep: list[str]) -> DataFrame:
    """Columns ``keep`` of every row with ``__lang`` and ``__score``, the share of the best language."""
    languages, lookup, chance = model
    current = docs.sparkSession.sparkContext.broadcast((languages, lookup, chance))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    # A text that is kept goes to Python once.
    read, extra = ("text", []) if "text" in keep else ("__text", [F.col("text").alias("__text")])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, lookup, chance = current.value
        scores = WordScores(lookup, chance)
        for batch in batches:
            for part in slices(batch, read, 1 << 20):
                text = part.column(read)
                words = words_of(text)
                distinct, first, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
                each = scores.of(words.data, words.start[first], words.end[first], distinct)
                total = np.zeros((len(words.first), each.shape[1]))
                total[1:] = np.cumsum(each[which], axis=0)[words.first[1:] - 1] if len(which) else 0
                total[words.first == 0] = 0
                total = np.diff(total, axis=0)
                share = np.exp(total - total.max(axis=1, keepdims=True))
                share /= share.sum(axis=1, keepdims=True)
                best = share.argmax(axis=1)
                plain = [bool(languages) and value is not None and _LETTER.search(value) is not None
                         for value in text.to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(len(keep))]
                    + [pa.array([languages[i] if ok else UNKNOWN for i, ok in zip(best, plain)], pa.string()),
                       pa.array(np.where(plain, share[np.arange(len(best)), best], 0.0))],
                    [*keep, "__lang", "__score"])

    return docs.select(*keep, *extra).mapInArrow(
        predict, f"{fields}, __lang string, __score double")


def known_language(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Pipeline stage: documents whose language is told, all their columns; ``und`` goes."""
    model = fit(docs.filter(~held_out(F.col("doc_id"), 4, 2)))
    return few_rows(lambda: identify(docs, model, docs.columns).filter(F.col("__lang") != UNKNOWN).select(*docs.columns),
                    spark, TEXTS)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id"), 4, 2))
    return identify(docs, fit(docs.filter("NOT held_out")), ["doc_id", "held_out"]).select(
        "doc_id", "held_out", F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))
