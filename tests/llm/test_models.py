"""Classifiers by held-out accuracy, neighbours by recall, pages by planted texts; odd cases for each."""

from __future__ import annotations

import math
import random

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F
import pytest

from meshledger.llm import catalog
from meshledger.llm.extract import extract, match, read_tree
from meshledger.llm.neighbours import nearest
from meshledger.llm.toxicity import CLASSES, MACHINE, clause_weight
from tests.llm import tables

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name, label, modulus, rest", [("op1_quality", "quality", 4, 2), ("op10_toxicity", "toxic", 3, 1)])
def test_held_out_accuracy(spark, name, label, modulus, rest):
    labels = {r["doc_id"]: r[label] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    rows = catalog.QUERIES[name](spark, SF).collect()
    assert len(rows) == 1000
    assert all(r.held_out == (tables.crc(r.doc_id, modulus) == rest) and r.predicted == (r.score >= 0.7)
               and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.9 * len(held)


@pytest.mark.parametrize("name, modulus, rest", [("op1_quality", 4, 2), ("op10_toxicity", 3, 1)])
def test_classifiers_on_odd_rows(spark, tmp_path, name, modulus, rest):
    folder, docs = tables.odd_folder(spark, tmp_path)
    rows = catalog.QUERIES[name](spark, folder).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((d is None, d or 0) for d, *_ in docs)
    assert all(0 <= r.score <= 1 and r.held_out == (r.doc_id is None or tables.crc(r.doc_id, modulus) == rest) for r in rows)
    told = {r.doc_id: r.score for r in rows}
    assert told[1000] == told[1001] == told[1002]


@pytest.mark.parametrize("name", ["op1_quality", "op10_toxicity"])
def test_classifiers_ignore_held_out_labels(spark, tmp_path, name):
    label, modulus, rest = {"op1_quality": ("quality", 4, 2), "op10_toxicity": ("toxic", 3, 1)}[name]
    scores = []
    for turn in (0, 1):
        folder = tmp_path / str(turn)
        folder.mkdir()
        pq.write_table(pq.read_table(f"{tables.BASE}/documents.parquet"), f"{folder}/documents.parquet")
        rows = pq.read_table(f"{tables.BASE}/labels.parquet").to_pylist()
        for row in rows:
            if turn and tables.crc(row["doc_id"], modulus) == rest:
                row[label] = 1 - row[label]
        pq.write_table(pa.Table.from_pylist(rows), f"{folder}/labels.parquet")
        scores.append({r.doc_id: round(r.score, 9) for r in catalog.QUERIES[name](spark, str(folder)).collect()})
    assert scores[0] == scores[1]


def test_grammar_weighs_clauses():
    insult, you, no, said, kill = ("insult", 3.0), ("target", 0.0), ("negation", 0.0), ("report", 0.0), ("threat", 3.0)
    assert clause_weight([insult]) < clause_weight([you, insult])
    assert clause_weight([you, no, insult]) < clause_weight([insult])
    assert clause_weight([said, you, insult]) < clause_weight([you, insult])
    assert clause_weight([kill]) < clause_weight([you, kill])
    assert clause_weight([you, no]) == 0
    assert {kind for _, kind in MACHINE} == set(CLASSES)


def brute_nearest(rows: list[tuple], every: int, k: int) -> dict:
    good = {}
    for vec_id, vector in rows:
        if vec_id is not None and vector and all(x is not None and math.isfinite(x) for x in vector) and any(vector):
            good[vec_id, tuple(vector)] = None
    out = {}
    for query, at in good:
        if query % every == 0:
            found = [(-sum(a * b for a, b in zip(at, v)), i) for i, v in good if i != query and len(v) == len(at)]
            out[query] = [(i, -s) for s, i in sorted(found)[:k]]
    return out


def test_neighbours_odd_vectors(spark):
    pick = random.Random(1)
    hot = [1.0, 2.0, 2.0, 0.5]
    rows = [(i, [float(pick.randrange(-4, 5)) for _ in range(4)]) for i in range(300)]
    rows += [(i, hot) for i in range(300, 400)]
    rows += [(400, None), (401, []), (402, [0.0] * 4), (403, [1.0, None, 1.0, 1.0]), (404, [float("nan")] * 4),
             (405, [float("inf"), 0.0, 0.0, 0.0]), (None, hot), (420, [3.0, 4.0]), (421, [1.0, 1.0]), (421, [1.0, 1.0]), (440, [2.0])]
    frame = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, size int, block string")
    got: dict = {}
    for r in nearest(frame, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == {q: found for q, found in brute_nearest(rows, 20, 20).items() if found}


def test_neighbours_recall(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in pq.read_table(f"{SF}/embeddings.parquet").to_pylist()]
    plain = brute_nearest(rows, 20, 20)
    got: dict = {}
    for r in catalog.QUERIES["op6_nearest"](spark, SF).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    hit = sum(len(set(got[q]) & {i for i, _ in found}) for q, found in plain.items())
    assert hit >= 0.9 * 20 * len(plain)
    assert all(len(found) == 20 for found in got.values())


PAGE = """<!DOCTYPE html><html><head><title>T {i}</title><script>var a = "<p>no</p>";</script><style>p{{}}</style></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href="/{i}">menu {i}</a></ul></nav><div class="cookie-notice">We use cookies {i}</div>
<div class="ad">Buy {i}</div><aside class="sidebar"><p>aside {i}</p></aside>
<article><h1>Title &amp; {i}</h1><p>First  <b>bold{i}</b>\n text&nbsp;{i}.<br>after<p>Second &lt;{i}&gt; <i>x</i><p class="legal">Rights</p>
<p>Share this page with friends</p><ul><li>one {i}<li>two {i}</ul><form><input><p>form</p></form>
<section id="comments"><p>reader {i}</p></section></article><footer>&copy; {i}</footer></body></html>"""
TEXT = "Title & {i}\nFirst bold{i} text {i}. after\nSecond <{i}> x\none {i}\ntwo {i}"


def test_pages(spark):
    rows = [(i, f"https://user@Host.example:80/{i}?q", PAGE.format(i=i), "x") for i in range(12)]
    rows += [(50, "https://alone.example/a", "<p>Only <p>page", "x"), (51, None, "<div>no <span>host</span></div>", "x"),
             (52, "https://alone.example/b", None, "x"), (53, "https://host.example/z", "", "x"), (3, rows[3][1], rows[3][2], "x"),
             (54, "not a url", "a < b &amp &#x41; <b>open", "x"), (None, "https://host.example/n", PAGE.format(i=77), "x"),
             (55, "https://alone.example/c", "<div>" * 3000 + "deep" + "</div>" * 3000, "x"), (56, "https://alone.example/d", "<p>x" * 5000, "x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in extract(frame).collect()), key=str)
    text = {i: TEXT.format(i=i) for i in range(12)} | {50: "Only\npage", 51: "no host", 52: "", 53: "", 54: "a < b & A open",
            None: TEXT.format(i=77), 55: "deep", 56: "\n".join(["x"] * 5000)}
    assert got == sorted(((i, url, text[i], len(text[i])) for i, url, *_ in rows), key=str)


def test_given_pages(spark):
    import html
    import re

    given = {r["page_id"]: r["html"] for r in pq.read_table(f"{SF}/pages.parquet").to_pylist()}
    rows = catalog.QUERIES["op7_extract"](spark, SF).collect()
    assert len(rows) == len(given)
    for row in rows:
        article = re.search(r"<article>(.*?)</article>", given[row.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", " ", re.sub("</?b>", "", part))).split())
                  for part in re.split(r"</?(?:p|h1)>", article)]
        assert row.text == "\n".join(block for block in blocks if block)


def test_tree_matching_is_largest():
    """The trimmed table against a plain recursion over all order-keeping matchings."""
    def plain(a, b):
        if a.tag != b.tag:
            return 0
        def lists(i, j):
            if i == len(a.children) or j == len(b.children):
                return 0
            return max(lists(i + 1, j), lists(i, j + 1), lists(i + 1, j + 1) + plain(a.children[i], b.children[j]))
        return 1 + lists(0, 0)

    pick = random.Random(2)

    def markup(depth):
        return "".join(f"<{t}>{markup(depth - 1) if depth else 'w'}</{t}>" for t in pick.choices(["div", "p", "ul", "section"], k=pick.randrange(1, 4)))

    for _ in range(40):
        one, two = read_tree(markup(2)), read_tree(markup(2))
        count, pairs = match(one, two)
        assert count == plain(one, two) and all(a.tag is None and b.tag is None for a, b in pairs)
