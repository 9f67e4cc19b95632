"""Ranked search against brute force, on given and odd rows, and over several shards of the index."""

from __future__ import annotations

import math
import re
from collections import Counter

import duckdb
import pytest

from meshledger.llm import catalog, retrieval
from tests.llm import tables

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, top):
    counts = [(doc, Counter(terms(text))) for doc, text in docs]
    counts = [(doc, c) for doc, c in counts if c]
    n_docs, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for item, text in set(items):
        if item is not None:
            asked.setdefault(item, Counter()).update(terms(text))
    rows = []
    for item, wanted in asked.items():
        found = []
        for doc, c in counts:
            m = 25 + 75 * sum(c.values()) * n_docs // total
            score = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, k in wanted.items() if c[t])
            if doc is not None and score > 0:
                found.append((-score, doc))
        rows += [(item, i + 1, doc, -score) for i, (score, doc) in enumerate(sorted(found)[:top])]
    return sorted(rows)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return tables.odd_folder(spark, tmp_path_factory.mktemp("odd"))


def test_search_equals_brute_force_and_sql(spark, odd):
    folder, docs = odd
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    got = sorted(tuple(r) for r in retrieval.op11_search(spark, folder).collect())
    assert got == brute([d[:2] for d in docs], items, 10)
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    assert got == sorted(db.execute(catalog.SQL["op11_search"]).fetchall())


@pytest.mark.parametrize("cells", [1, 1000])
def test_shards_blocks_and_ties(spark, monkeypatch, cells):
    """Many small shards and blocks give what one gives; a copied document ties with its source."""
    monkeypatch.setattr(retrieval, "POSTINGS", 7)
    monkeypatch.setattr(retrieval, "CELLS", cells)
    docs = [(i, f"alpha w{i % 5} beta" + " gamma" * (i % 3)) for i in range(40)] + [(None, "alpha beta w1"), (99, None)]
    items = [(1, "Alpha gamma gamma"), (2, "w1 w2 w3"), (3, "nothing"), (4, "beta"), (4, "w4"), (5, None), (None, "alpha")]
    got = retrieval.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(6),
                           spark.createDataFrame(items, "item_id long, text string"), top=4).collect()
    assert sorted(tuple(r) for r in got) == brute(docs, items, 4)


def test_terms_of_one_first_hash_are_told_apart(monkeypatch):
    import numpy as np
    import pyarrow as pa

    words = retrieval.words_of(pa.array(["a b c a"]), kinds=retrieval.TERM)
    plain = retrieval.Words.hashes
    monkeypatch.setattr(retrieval.Words, "hashes", lambda self, seed=1: plain(self, 2) if seed == 2 else np.full(len(self.start), 5, np.uint64))
    two = words.hashes(2).view(np.int64)
    index = retrieval.Index.of(np.array([7, 8]), np.array([5, 5]), two[:2], np.array([1, 1]))
    found, term = index.terms_of(words)
    assert found.tolist() == [0, 1, 3] and term[0] == term[2] != term[1]
