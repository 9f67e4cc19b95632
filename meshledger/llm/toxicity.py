"""Toxicity by a weighted finite-state pattern grammar.

A clause (up to a stop or line end) is a string over token classes: insult, threat, target, negation, reported
speech. One small transducer for each of these is composed with the others into one machine; running it over a
clause gives the clause's weight. A document's clause weights are pooled and calibrated by a logistic curve. The
insult lexicon is a fixed list, joined by word beginnings induced from labelled training documents: those found
in toxic documents nearly alone.

The lexicon and the curve are fitted on two halves of a bounded labelled sample. Scoring looks at each distinct
word of a task once; only clauses holding a class token are run through the machine.

Defined results: null and empty texts have weight 0, so the lowest score of the curve, as has any text without
class tokens; without labels of both kinds the default curve holds. Repeated rows are scored alike. A row
without id counts as held out. Other columns are not read.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshledger.llm.shared import held_out, labelled_sample, table
from meshledger.llm.textarrays import slices, words_of

#: Labelled documents used at most (two thirds for the lexicon, one third for the curve); lexicon entries at most.
SAMPLE_DOCS, ENTRIES = 12_000, 5000
#: Length of word beginnings; share and number of toxic documents a beginning must be found in; how purely.
BEGINNINGS, LEAST_SHARE, LEAST_DOCS, PURITY = range(4, 9), 0.01, 5, 0.6
THRESHOLD = 0.7

#: The words of each class.
INSULTS = ("idiot moron loser scum trash clown stupid pathetic worthless disgusting dumb imbecile fool ugly "
           "coward liar freak pig rat vermin filth garbage jerk bastard").split()
THREATS = "kill hurt destroy beat shoot stab burn hang strangle punch attack murder crush".split()
TARGETS = "you your yours yourself u ur he she him her his they them their".split()
NEGATIONS = "not no never none nobody isn't aren't wasn't don't doesn't didn't won't can't without".split()
REPORTS = "said says say called calls wrote writes quoted quotes claimed claims reported reports allegedly".split()
INSULT_WEIGHT, THREAT_WEIGHT = 3.0, 3.0

#: Transducers as fixed tables: (state, class) -> (next state, factor on an insult or threat just read).
#: A pair that is not listed keeps the state, with factor 1. Every machine starts in state 0.
TRANSDUCERS = {
    "negation": {(0, "negation"): (1, 1.0), (1, "insult"): (1, 0.3), (1, "threat"): (1, 0.2)},
    "reported": {(0, "report"): (1, 1.0), (1, "insult"): (1, 0.6), (1, "threat"): (1, 0.4)},
    "target": {(0, "target"): (1, 1.0), (1, "insult"): (1, 1.5), (1, "threat"): (1, 1.5),
               (0, "threat"): (0, 0.2)},
    "insult": {(0, "insult"): (1, 1.0), (1, "insult"): (1, 1.1)},
    "threat": {(0, "threat"): (1, 1.0), (1, "threat"): (1, 1.1)},
}
CLASSES = ("insult", "threat", "target", "negation", "report")


def compose(machines: list[dict]) -> dict:
    """Product of transducers: states are tuples, factors are multiplied."""
    out, todo = {}, [tuple(0 for _ in machines)]
    while todo:
        state = todo.pop()
        for kind in CLASSES:
            if (state, kind) not in out:
                steps = [machine.get((part, kind), (part, 1.0)) for machine, part in zip(machines, state)]
                out[state, kind] = tuple(step[0] for step in steps), math.prod(step[1] for step in steps)
                todo.append(out[state, kind][0])
    return out


MACHINE = compose(list(TRANSDUCERS.values()))


def clause_weight(tokens: list[tuple[str, float]]) -> float:
    """Weight of a clause given its class tokens in order."""
    state, total = tuple(0 for _ in TRANSDUCERS), 0.0
    for kind, weight in tokens:
        state, factor = MACHINE[state, kind]
        total += weight * factor
    return total


class Lexicon:
    """Class and weight of a raw word."""

    _PART = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")

    def __init__(self, learned: dict[str, float]):
        self.learned = learned
        self.fixed = {word: (kind, weight) for kind, weight, words in (
            ("target", 0.0, TARGETS), ("negation", 0.0, NEGATIONS), ("report", 0.0, REPORTS),
            ("threat", THREAT_WEIGHT, THREATS), ("insult", INSULT_WEIGHT, INSULTS)) for word in words}

    def of(self, raw: bytes) -> tuple[str, float] | None:
        best = None
        for part in self._PART.findall(raw.decode("utf-8", "replace").lower()):
            found = self.fixed.get(part)
            weight = max([self.learned.get(part + "$", 0.0)]
                         + [self.learned.get(part[:n], 0.0) for n in BEGINNINGS if len(part) >= n])
            if weight > (found[1] if found else 0.0):
                found = "insult", weight
            if found and (best is None or found[1] > best[1]):
                best = found
        return best


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Word beginnings, and whole words ending in $, with a weight: log odds of toxic documents holding them."""
    sizes = {row.label: row.n for row in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, plain = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not plain:
        return {}
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))
    beginnings = F.flatten(F.transform(words, lambda word: F.concat(
        F.array(F.concat(word, F.lit("$"))),
        F.filter(F.array(*[F.when(F.length(word) >= n, F.substring(word, 1, n)) for n in BEGINNINGS]),
                 lambda x: x.isNotNull()))))
    entry = (sample.filter("text IS NOT NULL")
             .select("label", F.explode(F.array_distinct(beginnings)).alias("entry")).filter("entry <> '$'")
             .groupBy("entry").agg(F.sum("label").alias("toxic"), F.count("*").alias("n")))
    found = (entry.filter((F.col("toxic") >= max(LEAST_DOCS, LEAST_SHARE * toxic))
                          & (F.col("toxic") / (F.col("n") + 1) > PURITY))
             .orderBy(F.desc("toxic"), "entry").limit(ENTRIES).collect())
    return {row.entry: min(5.0, math.log((row.toxic + 0.5) / (toxic + 1)) - math.log((row.n - row.toxic + 0.5) / (plain + 1)))
            for row in found}


def pooled(text: pa.Array, lexicon: Lexicon, memory: dict) -> np.ndarray:
    """Sum of clause weights and largest clause weight of each text."""
    words = words_of(text)
    out = np.zeros((len(words.first) - 1, 2))
    if not len(words.start):
        return out
    distinct, first, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
    kinds: list[tuple[str, float] | None] = []
    if len(memory) > 1_000_000:
        memory.clear()
    raw = words.data.tobytes()
    for value, at in zip(distinct.tolist(), first.tolist()):
        if value not in memory:
            memory[value] = lexicon.of(raw[words.start[at] : words.end[at]])
        kinds.append(memory[value])
    hit = np.flatnonzero(np.array([kind is not None for kind in kinds])[which])
    last = words.data[words.end - 1]
    after = words.data[np.minimum(words.end, len(words.data) - 1)]
    stop = np.isin(last, np.frombuffer(b".!?;", np.uint8)) | (after == 10)
    doc = words.doc()
    clause = np.r_[0, np.cumsum(stop)[:-1]] + doc
    for (place, _), places in itertools.groupby(hit.tolist(), key=lambda i: (doc[i], clause[i])):
        weight = clause_weight([kinds[which[i]] for i in places])
        out[place, 0] += weight
        out[place, 1] = max(out[place, 1], weight)
    return out


def features(docs: DataFrame, learned: dict[str, float], keep: list[str]) -> DataFrame:
    """Columns ``keep`` with the pooled clause weights ``total`` and ``largest`` of every row."""
    lexicon = docs.sparkSession.sparkContext.broadcast(Lexicon(learned))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict = {}
        for batch in batches:
            for part in slices(batch, "__text"):
                values = pooled(part.column("__text"), lexicon.value, memory)
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keep))]
                                                 + [pa.array(values[:, 0]), pa.array(values[:, 1])],
                                                 [*keep, "total", "largest"])

    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(pool, f"{fields}, total double, largest double")


def fit_curve(x: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the default curve without both labels."""
    if len(set(label.tolist())) < 2:
        return np.array([-4.0, 2.0, 1.0])
    x, b = np.c_[np.ones(len(x)), np.log1p(x)], np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ b))
        b += np.linalg.solve((x.T * (p * (1 - p))) @ x + 0.1 * np.eye(3), x.T @ (label - p) - 0.1 * b)
    return b


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    sample = labelled_sample(docs, labels, "toxic", held_out(F.col("doc_id"), 3, 1), SAMPLE_DOCS).persist()
    part = F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(3)) == 0
    learned = learn_lexicon(sample.filter(~part))
    known = features(sample.filter(part), learned, ["label"]).toPandas()
    sample.unpersist()
    b = fit_curve(known[["total", "largest"]].to_numpy(), known["label"].to_numpy(float))
    score = 1 / (1 + F.exp(-(F.lit(float(b[0])) + float(b[1]) * F.log1p("total") + float(b[2]) * F.log1p("largest"))))
    return (features(docs, learned, ["doc_id"])
            .select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), score.alias("score"),
                    (score >= THRESHOLD).cast("int").alias("predicted")))
