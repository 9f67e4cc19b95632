"""Substring deduplication by suffix automata of reference passages.

A window is WINDOW consecutive words. Of the GRAM-word runs in a window the one of smallest hash is its mark, so equal windows have
equal marks, and a mark that only one document has belongs to no repeated window. The smallest document holding a mark
owns it. Windows under its own marks are an owner's reference passages; their suffix automaton is sent to every part
of the documents that share a mark with the owner, and these stream past it: matching statistics give, at every word, the
longest run ending there that the passages hold, and runs of a window or more are removed.

A window that the owner of its mark does not hold can still be one of a later document. All documents with that
window agree on the owner, so each finds it missing there, and such left-over windows, few, are compared by a
128-bit hash. Parts of a hot owner's documents are salted by their number of words.

Defined results: null and empty texts and texts shorter than a window keep all; repeats within one doc_id count for nothing; rows
of one doc_id are judged each on its text, as if all were that document; a row without id keeps all and is no
reference; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshledger.llm.shared import stage, table
from meshledger.llm.sharing import sharing
from meshledger.llm.textarrays import Words, inside, run_hashes, slices, words_of

WINDOW, GRAM = 13, 5
#: Words of documents that stream past one copy of an automaton.
SALT_WORDS = 1 << 20
_SPAN = WINDOW - GRAM + 1


def window_marks(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Start of every window within a text, and the hash that marks it."""
    gram = run_hashes(words.hashes(), GRAM)
    start = np.flatnonzero(inside(words.first, WINDOW, len(words.start)))
    if not len(start):
        return start, np.empty(0, np.uint64)
    least = gram.copy()
    reach = 1
    while 2 * reach <= _SPAN:  # minima of runs twice as long, then of the whole span
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    least = np.minimum(least[: len(least) - (_SPAN - reach)], least[_SPAN - reach :])
    return start, least[start]


def _mark_keys(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    words = words_of(text)
    start, mark = window_marks(words)
    doc = words.doc()[start]
    new = np.ones(len(start), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])
    return doc[new], mark[new]


class Automaton:
    """Suffix automaton of word sequences; a match never runs across two of them."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, words: list) -> None:
        last = 0
        for word in words:
            last = self._extend(last, word)

    def _extend(self, last: int, word) -> int:
        known = self.next[last].get(word)
        if known is not None:  # the word follows here in an earlier sequence
            if self.length[known] == self.length[last] + 1:
                return known
            return self._split(last, word, known)
        state = self._new({}, self.length[last] + 1)
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = state
            at = self.link[at]
        if at < 0:
            self.link[state] = 0
        else:
            target = self.next[at][word]
            self.link[state] = target if self.length[target] == self.length[at] + 1 else self._split(at, word, target)
        return state

    def _new(self, following: dict, length: int) -> int:
        self.next.append(following)
        self.link.append(0)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, at: int, word, target: int) -> int:
        copy = self._new(dict(self.next[target]), self.length[at] + 1)
        self.link[copy], self.link[target] = self.link[target], copy
        while at >= 0 and self.next[at].get(word) == target:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def statistics(self, words: list) -> list[int]:
        """At each word, the length of the longest run ending there that some sequence holds."""
        following, link, length = self.next, self.link, self.length
        state = run = 0
        out = []
        for word in words:
            while state and word not in following[state]:
                state = link[state]
                run = length[state]
            target = following[state].get(word)
            if target is None:
                state = run = 0
            else:
                state, run = target, run + 1
            out.append(run)
        return out


def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of windows under one owner's marks, of rows (doc_id, text_key, text, marks, owners)."""
    names = ["owner", "doc", "text_key", "start", "words", "passage"]
    for batch in batches:
        for part in slices(batch, "text", 1 << 20):
            words = words_of(part.column("text"))
            start, mark = window_marks(words)
            out: list[list] = [[] for _ in names]
            border = np.searchsorted(start, words.first)
            raw = words.data.tobytes()
            for row in range(part.num_rows):
                here = slice(border[row], border[row + 1])
                known = part.column("marks")[row].values.to_numpy().view(np.uint64)
                order = np.argsort(known)
                owner = part.column("owners")[row].values.to_numpy()[order]
                at = np.minimum(np.searchsorted(known[order], mark[here]), len(known) - 1)
                belongs = np.where(known[order][at] == mark[here], owner[at], -(1 << 63))
                for one in np.unique(belongs[belongs > -(1 << 63)]):
                    window = start[here][belongs == one]
                    cut = np.flatnonzero(np.diff(window) > 1) + 1
                    for i, j in zip(np.r_[0, cut], np.r_[cut, len(window)]):
                        low, high = window[i], window[j - 1] + WINDOW
                        values = (one, part.column("doc_id")[row].as_py(), part.column("text_key")[row].as_py(),
                                  low - words.first[row], high - low,
                                  b" ".join(raw[words.start[k] : words.end[k]] for k in range(low, high)))
                        for column, value in zip(out, values):
                            column.append(value)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)


def match_passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Covered runs, and left-over windows with their hash, of passages sorted by owner, salt and kind."""
    names = ["doc", "text_key", "start", "stop", "a", "b"]
    key, automaton = None, Automaton()
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for owner, salt, kind, doc, text_key, start, passage in zip(
                *(batch.column(name).to_pylist() for name in ("owner", "salt", "kind", "doc", "text_key", "start", "passage"))):
            words = passage.split(b" ")
            if key != (owner, salt):
                key, automaton = (owner, salt), Automaton()
            if kind == 0:
                automaton.add(words)
                continue
            done = 0
            for at, run in enumerate(automaton.statistics(words)):
                if at < WINDOW - 1:
                    continue
                if run >= WINDOW:
                    low = max(done, at + 1 - run)
                    for column, value in zip(out, (doc, text_key, start + low, start + at + 1, None, None)):
                        column.append(value)
                    done = at + 1
                else:
                    low = at + 1 - WINDOW
                    digest = hashlib.blake2b(b" ".join(words[low : at + 1]), digest_size=16).digest()
                    for column, value in zip(out, (doc, text_key, start + low, start + at + 1,
                                                   int.from_bytes(digest[:8], "big", signed=True),
                                                   int.from_bytes(digest[8:], "big", signed=True))):
                        column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(column, pa.int64()) for column in out], names)


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(doc, text_key, __spans): spans of words, as (start, stop), that a smaller document holds as well."""
    named = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL")
    shared = stage(sharing(named, _mark_keys))
    owners = shared.groupBy("signature").agg(F.min("leader").alias("owner"))
    marked = (shared.select("signature", "doc").distinct().join(owners, "signature").groupBy("doc")
              .agg(F.collect_list("signature").alias("marks"), F.collect_list("owner").alias("owners")))
    parts = stage(named.withColumn("text_key", F.xxhash64("text")).join(marked.withColumnRenamed("doc", "doc_id"), "doc_id")
                  .select("doc_id", "text_key", "text", "marks", "owners").mapInArrow(
                      passages, "owner long, doc long, text_key long, start long, words long, passage binary"))
    streaming = parts.filter("owner <> doc")
    load = (streaming.groupBy("owner").agg(F.sum("words").alias("words")).filter(F.col("words") > SALT_WORDS)
            .select("owner", F.ceil(F.col("words") / SALT_WORDS).alias("salts")))
    salts = F.coalesce("salts", F.lit(1))
    sent = (parts.filter("owner = doc").join(load, "owner", "left")
            .select("owner", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"), F.lit(0).alias("kind"),
                    "doc", "text_key", "start", "passage")
            .unionAll(streaming.join(load, "owner", "left")
                      .select("owner", F.pmod(F.xxhash64("doc"), salts).alias("salt"), F.lit(1).alias("kind"),
                              "doc", "text_key", "start", "passage")))
    found = stage(sent.repartition("owner", "salt").sortWithinPartitions("owner", "salt", "kind")
                  .mapInArrow(match_passages, "doc long, text_key long, start long, stop long, a long, b long"))
    left = found.filter("a IS NOT NULL")
    first = left.groupBy("a", "b").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last")
    later = left.join(first, ["a", "b"]).filter("doc > first").select("doc", "text_key", "start", "stop")
    return (found.filter("a IS NULL").select("doc", "text_key", "start", "stop").unionAll(later)
            .groupBy("doc", "text_key").agg(F.collect_list(F.struct("start", "stop")).alias("__spans")))


def _kept(part: pa.RecordBatch) -> tuple[Words, np.ndarray]:
    words = words_of(part.column("text"))
    change = np.zeros(len(words.start) + 1, np.int64)
    for row, spans in enumerate(part.column("__spans")):
        if spans.is_valid and len(spans.values):
            start = spans.values.field("start").to_numpy() + words.first[row]
            stop = spans.values.field("stop").to_numpy() + words.first[row]
            np.add.at(change, start, 1)
            np.add.at(change, stop, -1)
    return words, np.cumsum(change)[:-1] == 0


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            words, keep = _kept(part)
            raw, first = words.data.tobytes(), words.first
            sha = [hashlib.sha256(b" ".join(raw[words.start[k] : words.end[k]] for k in range(i, j) if keep[k])).hexdigest()
                   for i, j in zip(first[:-1], first[1:])]
            through = np.r_[0, np.cumsum(~keep)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(words.counts), pa.array(through[first[1:]] - through[first[:-1]]), pa.array(sha, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"])


def kept_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without removed words; white space around what stays is left as it was."""
    for batch in batches:
        out = []
        for part in slices(batch, "text"):
            words, keep = _kept(part)
            raw = words.data.tobytes()
            for row, old in enumerate(part.column("text")):
                i, j = words.first[row], words.first[row + 1]
                if keep[i:j].all():
                    out.append(old.as_py())
                    continue
                # A kept word goes with the white space up to the next word.
                edge = np.r_[words.start[i:j], words.end[j - 1]]
                out.append(b"".join(raw[edge[k] : edge[k + 1]] for k in range(j - i) if keep[i + k]).decode())
        place = batch.schema.get_field_index("text")
        done = batch.set_column(place, "text", pa.array(out, pa.string()))
        yield done.select([n for n in batch.schema.names if n != "__spans"])


def with_spans(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs`` with their ``__spans``."""
    spans = repeated_runs(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    named = docs.withColumn("__key", F.xxhash64("text"))
    spans = spans.select(F.col("doc").alias("__doc"), F.col("text_key").alias("__of"), "__spans")
    return named.join(spans, (F.col("doc_id") == F.col("__doc")) & (F.col("__key") == F.col("__of")), "left").drop(
        "__key", "__doc", "__of")


def without_repeats(docs: DataFrame) -> DataFrame:
    """Pipeline stage: all documents and columns, texts without repeated words. The text of a null stays null."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return with_spans(docs).mapInArrow(kept_texts, schema)


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return (with_spans(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "__spans")
            .mapInArrow(digests, "doc_id long, n_words long, n_removed long, kept_sha256 string"))


SQL = r"""
WITH w AS (SELECT doc_id, text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
           FROM documents),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS s FROM w),
windows AS (SELECT doc_id, s, array_to_string(words[s:s + 12], ' ') AS run FROM starts),
firsts AS (SELECT run, min(doc_id) AS first FROM windows GROUP BY run HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, s FROM windows JOIN firsts USING (run) WHERE doc_id > first),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS p FROM hit),
lost AS (SELECT doc_id, list(p) AS places FROM gone GROUP BY doc_id),
kept AS (SELECT doc_id, len(words) AS n, coalesce(len(places), 0) AS r,
                list_transform(list_filter(range(1, len(words) + 1), lambda i: NOT list_contains(coalesce(places, []), i)),
                               lambda i: words[i]) AS stay
         FROM w LEFT JOIN lost USING (doc_id))
SELECT doc_id, n::BIGINT AS n_words, r::BIGINT AS n_removed, sha256(array_to_string(stay, ' ')) AS kept_sha256 FROM kept
"""
