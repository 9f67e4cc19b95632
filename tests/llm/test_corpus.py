"""Operators on texts against brute force, on given documents and every odd case."""

from __future__ import annotations

import hashlib

import duckdb
import pytest

import corpus_pipeline
from meshledger.llm import catalog
from meshledger.llm.encoding import VOCABULARY, decode, encode
from meshledger.llm.jaccard import similar
from tests.llm import tables


def ordered(rows):
    return sorted(rows, key=lambda row: tuple((x is None, str(type(x)), x) if not isinstance(x, list) else (False, "", str(x))
                                              for x in row))


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return tables.odd_folder(spark, tmp_path_factory.mktemp("odd"))


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    return tables.empty_folder(tmp_path_factory.mktemp("empty"))


@pytest.mark.parametrize("name", [*catalog.QUERIES, "pipeline"])
def test_empty_tables(spark, empty, name):
    query = corpus_pipeline.run if name == "pipeline" else catalog.QUERIES[name]
    assert query(spark, empty).collect() == []


def test_jaccard(spark, odd):
    folder, docs = odd
    component, sizes = tables.brute_components(docs)
    got = [tuple(r) for r in catalog.QUERIES["op3_jaccard"](spark, folder).select("doc_id", "n_shingles", "component_id").collect()]
    assert ordered(got) == ordered([(d, n, component.get(d)) for d, n in sizes])


def test_jaccard_finds_every_link_at_every_level(spark, monkeypatch):
    """Families around the threshold and one passage in unlike documents, with groups crowded from two pairs."""
    import random

    from meshledger.llm import jaccard

    monkeypatch.setattr(jaccard, "CROWDED", 2)
    pick = random.Random(3)
    passage = ["p%d" % i for i in range(30)]
    docs = []
    for family in range(12):
        base = [f"f{family}w{pick.randrange(10_000)}" for _ in range(pick.randrange(5, 90))]
        for _ in range(8):
            text = list(base)
            for _ in range(pick.randrange(0, 6)):
                text[pick.randrange(len(text))] = "x%d" % pick.randrange(10**6)
            docs.append((len(docs), " ".join(text + passage * (family % 2)), "en"))
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(5)
    component, _ = tables.brute_components(docs)
    got = {r.node: r.component for r in similar(frame)[1].collect()}
    assert {d: got.get(d, d) for d in component} == component


def test_unlike_members_of_a_group_never_become_rows(spark, monkeypatch):
    """A passage in unlike documents: what goes on to be verified grows with the links, not with the square of the group."""
    from meshledger.llm import jaccard

    passage = " ".join("p%d" % i for i in range(120))
    docs = [(i, passage + " " + " ".join(f"d{i}w{k}" for k in range(40)), "en") for i in range(60)]
    docs += [(60 + i, docs[i][1] + " end", "en") for i in range(3)]
    counts = []
    verified = jaccard.verified
    monkeypatch.setattr(jaccard, "verified", lambda pairs, *rest: (counts.append(pairs.count()), verified(pairs, *rest))[1])
    got = {r.node: r.component for r in similar(spark.createDataFrame(docs, "doc_id long, text string, lang string"))[1].collect()}
    assert got == {60: 0, 61: 1, 62: 2}
    assert sum(counts[1::2]) < 60 < sum(counts)  # stars and pairs across components take turns


def test_sets_of_crowded_groups_are_compared_by_few_shingles(spark, monkeypatch):
    """Texts that share a passage went on with some thousand signatures each."""
    from meshledger.llm import jaccard

    monkeypatch.setattr(jaccard, "CROWDED", 2)
    passage = " ".join("p%d" % i for i in range(120))
    docs = [(i, passage + " " + " ".join(f"d{i}w{k}" for k in range(40)), "en") for i in range(60)]
    docs += [(60 + i, docs[i][1] + " end", "en") for i in range(3)]
    rows = []
    compared = jaccard.pairs_of_groups
    monkeypatch.setattr(jaccard, "pairs_of_groups", lambda member, looks: (rows.append(member.count()), compared(member, looks))[1])
    got = {r.node: r.component for r in similar(spark.createDataFrame(docs, "doc_id long, text string, lang string"))[1].collect()}
    assert got == {60: 0, 61: 1, 62: 2}
    assert len(rows) > 1 and sum(rows) < 63 * 156


def test_similar_sets_share_a_rare_shingle(spark):
    """Sets around the threshold, rows that come again and ids of several texts: every link is within some group."""
    import random

    from meshledger.llm import jaccard

    pick = random.Random(11)
    docs = [(None, "a b c d e f g", "en"), (900, None, "en"), (901, " ", "en"), (902, "One two", "en"), (903, "one  two", "en")]
    for family in range(15):
        base = [f"f{family % 4}w{pick.randrange(80)}" for _ in range(pick.randrange(5, 120))]
        for _ in range(7):
            text = list(base) + ["t%d" % i for i in range(pick.randrange(0, 9))]
            for _ in range(pick.randrange(0, 4)):
                text[pick.randrange(len(text))] = "x%d" % pick.randrange(50)
            docs.append((len(docs) if pick.random() < 0.9 else 7, " ".join(text), "en"))
    docs += [(d, text.upper(), "en") for d, text, _ in docs[5:40:3]]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    found = jaccard.rare_groups(frame.filter("doc_id IS NOT NULL AND text IS NOT NULL")).collect()
    together = {}
    for r in found:
        together.setdefault(r.signature, set()).add(r.doc)
        assert r.leader <= r.doc
    sets = [(d, {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}) for d, text, _ in docs
            if d is not None and (w := tables.words(text, lower=True))]
    links = {(c, d) for c, one in sets for d, two in sets if c < d and 100 * len(one & two) >= 80 * len(one | two)}
    met = {(c, d) for group in together.values() for c in group for d in group if c < d}
    assert len(links) > 40 and links <= met
    assert len(found) == sum(map(len, together.values())) and min(map(len, together.values())) > 1


def test_groups_in_blocks_lose_no_pair(spark, monkeypatch):
    """Groups cut into blocks and buckets, an id of several texts: all that sizes and sketches do not rule out."""
    import random

    from meshledger.llm import jaccard

    pick = random.Random(5)
    base = [f"w{i}" for i in range(70)]
    docs = []
    for i in range(80):
        text = [w if pick.random() > 0.04 * (i % 5) else f"x{pick.randrange(10**6)}" for w in base[: pick.choice((30, 60, 70))]]
        docs.append((i if i else 7, " ".join(text), "en"))
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    sets = jaccard.set_keys(frame).cache()
    ids = sorted({d for d, *_ in docs})
    groups = [(s, d, d % 9) for s in range(6) for d in ids if s < 1 or pick.random() < 0.4]
    member = spark.createDataFrame(groups, "signature long, doc long, component long")
    pairs = {(max(a, b), min(a, b)) for s, a, x in groups for t, b, y in groups if s == t and x != y}
    all_pairs = spark.createDataFrame(sorted(pairs), "one long, two long")
    expected = {tuple(r) for r in jaccard.plausible(all_pairs, sets).collect()}
    several = {(a, b) for a, b in pairs if 7 in (a, b)}  # an id of several texts is left to the check that follows
    looks = jaccard.looks_of(sets)
    for block, compared, bucket in ((2_000, 1 << 16, 1 << 15), (7, 5, 20)):
        monkeypatch.setattr(jaccard, "BLOCK", block)
        monkeypatch.setattr(jaccard, "COMPARED", compared)
        monkeypatch.setattr(jaccard, "BUCKET", bucket)
        got = [tuple(r) for r in jaccard.pairs_of_groups(member, looks).collect()]
        assert len(got) == len(set(got)) and set(got) == expected | several
    assert 50 < len(expected) < len(pairs)


def test_substrings(spark, odd):
    folder, docs = odd
    expected = [(d, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()) for d, w, kept in tables.brute_kept(docs)]
    got = [tuple(r) for r in catalog.QUERIES["op5_substrings"](spark, folder).collect()]
    assert ordered(got) == ordered(expected)
    assert sum(row[2] for row in expected) > 500


def test_substrings_of_a_hot_owner_are_salted(spark, monkeypatch):
    from meshledger.llm import substrings

    monkeypatch.setattr(substrings, "SALT_WORDS", 50)
    passage = " ".join("w%d" % i for i in range(40))
    docs = [(i, f"a{i} b{i} {passage} c{i} a{i} d{i % 3} " + " ".join(f"t{i % 4}x{k}" for k in range(14)), "en") for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = {r.doc_id: r.text for r in substrings.without_repeats(frame).collect()}
    assert {d: got[d].split() for d in got} == {d: [x.decode() for x in kept] for d, _, kept in tables.brute_kept(docs)}


def test_language_model(spark, odd):
    folder, docs = odd
    got = [tuple(r) for r in catalog.QUERIES["op2_kneser_ney"](spark, folder).collect()]
    for mine, plain in zip(ordered(got), ordered(tables.brute_model(docs))):
        assert mine[:5] == plain[:5]
        assert mine[5:] == pytest.approx(plain[5:], rel=1e-6)
    held = [row for row in got if row[1] and row[0] is not None and row[2] > 1]
    assert sum(row[6] > row[5] for row in held) > 0.9 * len(held)


def test_pieces_are_those_of_the_library(spark, odd):
    import sentencepiece

    folder, docs = odd
    model = sentencepiece.SentencePieceProcessor(model_file=VOCABULARY)
    got = [(r.doc_id, list(r.ids), r.n_tokens) for r in catalog.QUERIES["op4_sentencepiece"](spark, folder).collect()]
    plain = [(d, model.encode(text or "")) for d, text, _ in docs]
    assert ordered(got) == ordered([(d, ids, len(ids)) for d, ids in plain])


def test_decoding_restores(spark, odd):
    folder, docs = odd
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    back = decode(encode(frame, ["doc_id", "spans"]), ["doc_id"]).collect()
    assert ordered([tuple(r) for r in back]) == ordered([(d, (text or "").replace("▁", " ")) for d, text, _ in docs])


def test_blanks_in_a_row(spark):
    import sentencepiece

    texts = [" " * n + "x" + " " * (n % 19) + "y z" for n in range(40)] + ["  ", " ", "▁▁a", "a" * 300, "\x00 \x00"]
    model = sentencepiece.SentencePieceProcessor(model_file=VOCABULARY)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: list(r.ids) for r in encode(frame, ["doc_id"]).collect()}
    assert got == {i: model.encode(text) for i, text in enumerate(texts)}


def test_decontamination_equals_sql(spark, odd):
    folder, _ = odd
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    query = catalog.QUERIES["op8_decontaminate"](spark, folder)
    expected = db.execute(f"SELECT {', '.join(query.columns)} FROM ({catalog.SQL['op8_decontaminate']})").fetchall()
    assert ordered([tuple(r) for r in query.collect()]) == ordered(expected)
    assert len(expected) >= 3


def test_decontamination_tolerates_substitutions(spark):
    from meshledger.llm.decontaminate import overlaps

    item = ["i%d" % n for n in range(24)]
    changed = [w if n % 7 != 3 else "other%d" % n for n, w in enumerate(item)]
    docs = [(1, "before " + " ".join(changed) + " after"), (2, " ".join(item[:4]) + " nothing else is alike here at all"),
            (3, " ".join(item).upper().replace(" ", ", ")), (4, " ".join(reversed(item)))]
    got = overlaps(spark.createDataFrame(docs, "doc_id long, text string"),
                   spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.matched, r.item_tokens) for r in got) == [(1, 21, 24), (3, 24, 24)]


def test_language_id(spark, odd):
    folder, docs = odd
    rows = catalog.QUERIES["op9_language_id"](spark, folder).collect()
    assert len(rows) == len(docs)
    told = {r.doc_id: r for r in rows}
    for doc in (1000, 1001, 1002, 1012):
        assert (told[doc].lang_pred, told[doc].score) == ("und", 0.0)
    lang = {d: language for d, _, language in docs}
    assert all(r.held_out == (r.doc_id is None or tables.crc(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 1000]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)


def test_forward_sum_counts_every_segmentation():
    import numpy as np

    from meshledger.llm.langid import forward
    from meshledger.llm.pieces import Lookup, blocks

    strings = [b" ", b" a", b"a", b"b", b"ab", b"ba", b"aba"]
    chance = np.array([[0.1, 0.2], [0.2, 0.1], [0.3, 0.1], [0.1, 0.2], [0.1, 0.2], [0.1, 0.1], [0.1, 0.1]])

    def plain(text, language):
        return 1.0 if not text else sum(chance[i, language] * plain(text[len(s):], language)
                                        for i, s in enumerate(strings) if text.startswith(s))

    for word in (b"a", b"ab", b"abab", b"baabab", b"ab" * 9):
        data = np.frombuffer(word, np.uint8)
        for rows, matrix, length in blocks(data, np.array([0]), np.array([len(word)])):
            got = forward(Lookup.of(strings), matrix, length, chance)[0]
        assert np.allclose(got, [np.log(plain(b" " + word, k)) for k in (0, 1)])


def test_pipeline_against_brute_force(spark, odd):
    """Each stage on what the one before kept, restated plainly; the language model's verdict is taken from op9."""
    import sentencepiece

    folder, docs = odd
    stages = dict(corpus_pipeline.STAGES)
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    columns = frame.columns
    frame = corpus_pipeline.stage(stages["language_id"](spark, frame, folder))
    named = {(r.doc_id, r.lang_pred != "und") for r in catalog.QUERIES["op9_language_id"](spark, folder).collect() if r.doc_id is not None}
    now = [(r.doc_id, r.text, r.lang) for r in frame.collect()]
    assert {d for d, ok in named if ok} == {d for d, *_ in now if d is not None} and frame.columns == columns
    component, _ = tables.brute_components(now)
    frame = corpus_pipeline.stage(stages["jaccard_join"](spark, frame, folder))
    expected = [d for d in now if d[0] is None or component[d[0]] == d[0]]
    now = [(r.doc_id, r.text, r.lang) for r in frame.collect()]
    assert ordered(now) == ordered(expected) and frame.columns == columns
    frame = corpus_pipeline.stage(stages["substring_dedup"](spark, frame, folder))
    expected = [(d, kept) for d, _, kept in tables.brute_kept(now)]
    now = [(r.doc_id, r.text, r.lang) for r in frame.collect()]
    assert ordered([(d, tables.words(t)) for d, t, _ in now]) == ordered(expected) and frame.columns == columns
    frame = corpus_pipeline.stage(stages["decontamination"](spark, frame, folder))
    assert frame.columns == columns and 0 < frame.count() < len(now)
    kept = [(r.doc_id, r.text) for r in frame.collect()]
    model = sentencepiece.SentencePieceProcessor(model_file=VOCABULARY)
    last = stages["sentencepiece"](spark, frame, folder).collect()
    assert ordered([(r.doc_id, list(r.ids)) for r in last]) == ordered([(d, model.encode(t or "")) for d, t in kept])
    assert ordered([(r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, folder).collect()]) == ordered(
        [(r.doc_id, r.n_tokens) for r in last])


def test_encoding_takes_bounded_memory():
    """2 MB of words that are all different, with one stretch longer than a block."""
    import random
    import tracemalloc

    import pyarrow as pa
    import sentencepiece

    from meshledger.llm import encoding

    pick = random.Random(1)
    words = ["".join(pick.choices("abcdefghijklmnopqrstuvwxyzéß", k=pick.randrange(3, 12))) for _ in range(220_000)]
    text = " ".join([*words, "z" * (encoding.BLOCK + 5)])
    model = encoding.Model.read()
    encoder = encoding.Encoder(model)
    tracemalloc.start()
    ids, border = encoding.encode_texts(pa.array([text, " ".join(words[:50])]), encoder)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 130e6
    plain = sentencepiece.SentencePieceProcessor(model_file=VOCABULARY)
    assert ids[border[1] : border[2]].tolist() == plain.encode(" ".join(words[:50]))
    assert ids[:100_000].tolist() == plain.encode(" ".join(words[:60_000]))[:100_000]


def test_shared_keys_come_back_in_small_batches(spark, monkeypatch):
    """op3_jaccard, pipeline: all keys that a task had combined went back in one Arrow batch."""
    import numpy as np

    from meshledger.llm import sharing

    monkeypatch.setattr(sharing, "ROWS", 3)
    docs = spark.createDataFrame([(i, "x") for i in range(20)], "doc_id long, text string").coalesce(1)

    def keys(text):
        return np.repeat(np.arange(len(text)), 2), np.tile(np.array([5, 9], np.uint64), len(text))

    found = sharing.sharing(docs, keys)
    assert sorted(map(tuple, found.collect())) == sorted((s, d, 0) for s in (5, 9) for d in range(20))
