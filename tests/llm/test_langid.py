"""Training on words of any length."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from meshledger.llm import langid
from meshledger.llm.pieces import Lookup, blocks

STRINGS = [b" ", b" a", b"a", b"b", b"ab", b"ba", b"aba", b"abbabaabbaabab"]


def plain_counts(word: bytes, chance: np.ndarray) -> np.ndarray:
    """Expected counts of one word with logarithms throughout."""
    def add(one, other):
        top = max(one, other)
        return top if top == -math.inf else top + math.log(math.exp(one - top) + math.exp(other - top))

    n = len(word)
    ahead, behind, out = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0], np.zeros(len(STRINGS))
    steps = [(i, i + len(s), k) for i in range(n) for k, s in enumerate(STRINGS) if word.startswith(s, i)]
    for i, j, k in steps:
        ahead[j] = add(ahead[j], ahead[i] + math.log(chance[k]))
    for i, j, k in reversed(steps):
        behind[i] = add(behind[i], behind[j] + math.log(chance[k]))
    for i, j, k in steps:
        out[k] += math.exp(ahead[i] + math.log(chance[k]) + behind[j] - ahead[n])
    return out


@pytest.mark.parametrize("stretch", [8, 4096])
def test_expected_counts_of_any_length(monkeypatch, stretch):
    monkeypatch.setattr(langid, "_STRETCH", stretch)
    pick = random.Random(3)
    words = [bytes(pick.choices(b"ab", k=k)) for k in (1, 2, 7, 8, 9, 15, 40, 41, 300, 6000)]
    chance = np.array([[0.1, 0.01], [0.2, 0.3], [0.001, 0.1], [0.2, 1e-6], [0.1, 0.2], [0.1, 0.1], [0.1, 0.1], [1e-9, 0.1]])
    language, weight = np.arange(len(words)) % 2, 1.0 + np.arange(len(words))
    end = np.cumsum([len(w) for w in words])
    got = np.zeros(chance.shape)
    for rows, matrix, length in blocks(np.frombuffer(b"".join(words), np.uint8), end - [len(w) for w in words], end):
        got += langid.expected_counts(Lookup.of(STRINGS), matrix, length, chance, language[rows], weight[rows])
    want = np.zeros(chance.shape)
    for word, k, n in zip(words, language, weight):
        want[:, k] += n * plain_counts(b" " + word, chance[:, k])
    assert np.allclose(got, want)


def test_languages_without_blanks(spark):
    """Sentences that are one word each are learned from and told apart."""
    letters = {"ja": "これはとてもながいぶんしょうです", "th": "ประโยคนี้ยาวมากและไม่มีช่องว่าง", "zh": "这是一个很长的中文句子没有空格"}
    pick = random.Random(4)
    rows = [(i, "".join(pick.choices(letters[lang], k=60)), lang) for i, lang in enumerate(sorted(letters) * 8)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(frame.filter("doc_id < 18"))
    assert model[0] == ["ja", "th", "zh"]
    told = {r.doc_id: r["__lang"] for r in langid.identify(frame, model, ["doc_id"]).collect()}
    assert all(told[i] == lang for i, _, lang in rows)


def test_the_pipeline_sends_whole_texts_once_and_in_small_batches(spark, monkeypatch):
    from meshledger.llm import shared

    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = [(i, text, lang) for i in range(20) for text, lang in [("the house and the garden %d" % i, "en")]]
    rows += [(20 + i, "das Haus und der Garten %d" % i, "de") for i in range(20)]
    rows += [(50, None, "en"), (51, "12 !!", "en"), (None, "the house", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    before, seen, stage = spark.conf.get(size), [], shared.stage
    monkeypatch.setattr(shared, "stage", lambda df: (
        seen.append((int(spark.conf.get(size)), "__text" in df._jdf.queryExecution().toString())), stage(df))[1])
    got = langid.known_language(spark, frame)
    assert seen == [(langid.TEXTS, False)] and spark.conf.get(size) == before
    assert sorted(map(tuple, got.collect()), key=str) == sorted((r for r in rows if r[0] not in (50, 51)), key=str)
