"""Personal data: base spans against plain patterns, positions, added spans on planted forms, and the learned reliabilities."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from meshledger.llm import pii
from tests.llm import tables

#: The base patterns as stated.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in twice) % 10 == 0


def brute(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    keep = {"email": (EMAIL, lambda m: True), "ip": (IP, lambda m: all(int(x) <= 255 for x in m.group().split("."))),
            "card": (CARD, lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
            "phone": (PHONE, lambda m: 9 <= len(digits(m)) <= 15)}
    return {kind: [(m.start(), m.end()) for m in p.finditer(text) if ok(m)] for kind, (p, ok) in keep.items()}


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k in spans for a, b in spans[k]).encode()).hexdigest()


def tricky():
    pick = random.Random(4)
    parts = ["a@b.c", "x.y+z@mail-1.example.com", "@", "+", "1.2.3.4", "256.1.1.1", "0000255.01.1.1", "1.2.3.4.5.6.7.8", "4111 1111-1111 1111",
             "4111111111111112", "+1 (705) 555-5569", "+49 30.123-45", "+1  ", "é", "🙂", "日本", " ", "\n", "..", "-", "7", "a@b.com.x+y@z.com",
             "123456789.1.2.3", "5", "(", "name@host", "0 0 0 0 0 0 0 0 0 0 0 0 0", "x@-.-"]
    return ["".join(pick.choice(parts) + pick.choice(["", "", " "]) for _ in range(pick.randrange(1, 40))) for _ in range(400)]


def test_base_spans_equal_plain_patterns(spark, tmp_path):
    folder, docs = tables.odd_folder(spark, tmp_path, 60)
    docs = [(d, t) for d, t, _ in docs] + list(enumerate(tricky(), 5000)) + [(9000, None), (9001, "")]
    spark.createDataFrame(docs, "doc_id long, text string").withColumn("spans", F.lit("odd")).write.mode("overwrite").parquet(
        f"{tmp_path}/more/documents.parquet")
    got = pii.op12_pii(spark, f"{tmp_path}/more").collect()
    plain = [(d, brute(t)) for d, t in docs]
    key = lambda row: (row[0] is None, row[0] or 0, row[-1])
    assert sorted([(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got], key=key) == sorted(
        [(d, *[len(s[k]) for k in s], digest(s)) for d, s in plain], key=key)
    told = {r.doc_id: set(r.spans.split(",")) for r in got}
    assert all({f"{k}:{a}:{b}" for k in s for a, b in s[k]} <= told[d] for d, s in plain)


def test_positions_of_very_many_matches(spark):
    text = "🙂" + "é ".join(f"u{i}@h{i % 7}.org" for i in range(3000)) + " " + "z" * 200_000 + "@" + "1" * 100_000 + ".a" * 100_000
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    for form in pii.FORMS[:4]:
        got = frame.select(F.explode_outer(pii.matches(F.col("text"), form.pattern)).alias("m")).select("m.start", "m.end", "m.hit").collect()
        assert all(r.hit is None or text[r.start : r.end] == r.hit for r in got)
        if form.kind == "email":
            assert len(got) == 3001 and [(r.start, r.end) for r in got[:2500]] == brute(text[:40_000])["email"][:2500]


def planted(n=240):
    """Texts with looser forms of personal data (a) and with what only looks like it (b)."""
    pick = random.Random(8)

    def account():
        body = "%018d" % pick.randrange(10**18)
        return f"DE{98 - int(body + '131400') % 97:02d}{body}"

    number = lambda: "%03d-%03d-%04d" % (pick.randrange(200, 999), pick.randrange(200, 999), pick.randrange(10**4))
    good = {"email": lambda: f"mail u{pick.randrange(99)} [at] host{pick.randrange(9)} [dot] com", "phone": lambda: f"call {number()}",
            "iban": lambda: f"account {account()}", "name": lambda: f"signed Mrs {pick.choice(['Anna', 'Maria', 'Laura'])} {pick.choice(['Berg', 'Costa'])},"}
    bad = {"email": lambda: f"version a{pick.randrange(99)} [at] file [dot] txt", "phone": lambda: "order 012-%03d-%04d/7" % (pick.randrange(200, 999), pick.randrange(10**4)),
           "iban": lambda: f"token ZZ{pick.randrange(10, 99)}{'%016d' % pick.randrange(10**16)}=", "name": lambda: "id Dr Something-"}
    rows = []
    for i in range(n):
        kind = pick.choice(list(good))
        part = pick.choice([good, bad])
        rows.append((i, f"Some text {part[kind]()} and more.", kind, part is good))
    return rows


def test_looser_forms_are_told_from_lookalikes(spark):
    rows = planted()
    found = pii.personal_data(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)).collect()
    added = {r.doc_id: [pii.KINDS[s.kind] for s in r.added] for r in found}
    good = [kind in added[i] for i, _, kind, true in rows if true]
    bad = [bool(added[i]) for i, _, _, true in rows if not true]
    assert sum(good) >= 0.95 * len(good) and sum(bad) <= 0.02 * len(bad)


def test_reliabilities_are_recovered(spark):
    """Votes drawn from known chances: the estimates come near them, and follow a labeler that is worse than chance."""
    pick = random.Random(6)
    right = [0.95, 0.85, 0.7, 0.9, 0.5]
    counts = {}
    for _ in range(20_000):
        true = pick.random() < 0.4
        vote = tuple(1 if pick.random() < 0.3 else 2 * int((pick.random() < p) == true) for p in right)
        counts[vote] = counts.get(vote, 0) + 1
    rows = [(list(v), [0, 0, 0], float(n)) for v, n in sorted(counts.items())]
    frame = spark.createDataFrame([(0, rows)], "kind int, rows array<struct<vote:array<int>,shape:array<int>,n:double>>")
    theta = frame.select(pii.reliabilities(F.col("rows")).alias("t")).first().t
    assert theta[0] == pytest.approx(0.4, abs=0.03)
    for k, p in enumerate(right):
        for c in (0, 1):
            for v, chance in ((0, p if not c else 1 - p), (2, p if c else 1 - p)):
                assert theta[1 + (k * 3 + v) * 2 + c] == pytest.approx(0.7 * chance, abs=0.04)


def test_nothing_runs_outside_the_engine(spark):
    plan = pii.spans(spark.createDataFrame([(1, "a@b.c")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_added_spans_keep_off_base_spans_and_each_other(spark):
    text = "call 222-333-4444 card 4111 1111 1111 1111 mail a [at] b.com, a@b.com signed Mr Paul Berg, call 333-444-5555"
    row = pii.personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    spans = sorted((s.start, s.end) for s in [*row.base, *row.added])
    assert len(row.base) == 2 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert {text[s.start : s.end] for s in row.base} == {"4111 1111 1111 1111", "a@b.com"}


def test_training_changes_what_the_estimate_says(spark):
    """spans of the second shape mostly fail their check; the same votes are worth less in that shape, others keep theirs."""
    rows = [([2, 2, 2, 1, 1], [0, 0, 0], 300.0), ([2, 2, 1, 1, 1], [0, 1, 0], 40.0), ([2, 0, 2, 2, 1], [0, 1, 0], 400.0),
            ([0, 0, 0, 1, 0], [0, 0, 0], 200.0)]
    frame = spark.createDataFrame([(0, rows)], "kind int, rows array<struct<vote:array<int>,shape:array<int>,n:double>>")
    model = frame.select("rows", pii.reliabilities(F.col("rows")).alias("theta"))
    got = model.select(pii._log_odds(F.col("theta")).alias("start"), pii.trained(F.col("rows"), F.col("theta")).alias("weights")).first()
    assert got.start[-3:] == [0.0] * 3 and got.weights[-2] < -0.1
    span = lambda shape: F.struct(F.lit(0).alias("kind"), F.array(*[F.lit(v) for v in (2, 2, 2, 1, 1)]).alias("vote"),
                                  F.array(*[F.lit(s) for s in shape]).alias("shape"))
    odds = frame.select(*[pii.score(span(s), {0: ([], got.weights)}) for s in ([0, 0, 0], [0, 1, 0])]).first()
    assert odds[1] < odds[0] and odds[0] > pii.THRESHOLD
