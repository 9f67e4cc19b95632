"""Spelling variants against brute force, with trees cut small, odd rows, and words of equal letters."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from meshledger.llm import catalog, variants
from tests.llm import tables

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def brute(docs):
    seen = Counter()
    for doc, text in docs:
        for run in RUN.findall(text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            seen[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in seen.items() if len(w) >= 7 and n >= 2}
    near = {w: set() for w in words}
    holes = {}
    for w in words:
        for i in range(len(w)):
            if (less := w[:i] + w[i + 1 :]) in words:
                near[w].add(less)
                near[less].add(w)
            holes.setdefault((i, less), []).append(w)
    for group in holes.values():
        for w in group:
            near[w].update(x for x in group if x != w)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w] or "", root(w), n, len(near[w]), words.get(form[w], 0)) for w, n in words.items())


def rows(frame):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in frame.collect())


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return tables.odd_folder(spark, tmp_path_factory.mktemp("odd"))


def test_variants_equal_brute_force_and_sql(spark, odd):
    folder, docs = odd
    got = rows(variants.op13_variants(spark, folder))
    assert got == brute([d[:2] for d in docs])
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet')")
    told = db.execute(f"SELECT word, coalesce(form, ''), root, n, n_near, coalesce(form_n, 0) FROM ({catalog.SQL['op13_variants']})").fetchall()
    assert got == sorted(told)


@pytest.mark.parametrize(("sample", "cell"), [(0, 100), (50, 3), (1 << 15, 8)])
def test_small_cells_lose_no_pair(spark, sample, cell):
    """Families of edits, anagrams (which no tree can tell apart), long and accented words, chains of forms."""
    pick = random.Random(11)
    letters = "abcdeéÉöÿßn×"
    words = Counter()
    for family in range(25):
        base = "".join(pick.choice(letters) for _ in range(pick.choice([7, 8, 9, 12, 30])))
        for step in range(12):
            i = pick.randrange(len(base))
            words[pick.choice([base, base[:i] + base[i + 1 :], base[:i] + pick.choice(letters) + base[i:],
                               base[:i] + pick.choice(letters) + base[i + 1 :]])] += pick.choice([2, 3, 25, 300])
    for _ in range(60):
        words["".join(pick.sample("abcdefgh", 8))] += 2
    words |= {"q" * 300 + "é": 40, "q" * 301: 3, "q" * 300: 400, "q" * 299: 4000}
    docs = [(i, " ".join(w for w, n in words.items() for _ in range(n) if pick.random() < 0.2)) for i in range(6)] + [(6, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = rows(variants.variants(frame, sample, cell))
    assert got == brute(docs)
    assert any(row[2] != (row[1] or row[0]) for row in got)


def test_checksums():
    pick = random.Random(2)
    texts = [bytes(pick.randrange(256) for _ in range(n)) for n in [0, 1, 2, 7, 7, 9, 255, 256, 257, 1000]]
    before = [zlib.crc32(b"%d:" % i) for i in range(len(texts))]
    length = np.array([len(t) for t in texts])
    got = variants.checksums(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(length) - length, length, np.array(before, np.uint32))
    assert got.tolist() == [zlib.crc32(t, b) for t, b in zip(texts, before)]


def test_boxes_keep_whoever_is_in_reach():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 3, (300, variants.DIMENSIONS)).astype(np.uint8)
    counts[:, 8:] = 0
    tree = variants.Tree.over(counts, 4)
    for down in (0, 1):
        met = {(int(q), int(p)) for leaf, at in tree.reach(counts, down) for q in at for p in tree.leaves[leaf]}
        step = counts[None].astype(int) - counts[:, None]
        wanted = (np.maximum(step, 0).sum(axis=2) <= 1) & (np.maximum(-step, 0).sum(axis=2) <= down)
        assert {tuple(x) for x in np.argwhere(wanted).tolist()} <= met and len(met) < 0.7 * 300 * 300


def test_points_count_letters_of_both_kinds():
    points = variants.Points.of(pa.array(["abcé", "ÀÿÀz"]))
    assert points.counts.sum(axis=1).tolist() == [4, 4] and points.counts[1, [26, 89, 25]].tolist() == [2, 1, 1]
