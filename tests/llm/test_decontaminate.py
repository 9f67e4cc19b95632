"""Every overlap that the criterion accepts is found, against an enumeration and SQL without seeds."""

from __future__ import annotations

import math
import random
from itertools import combinations

import duckdb

from meshledger.llm.decontaminate import MASKS, MASKS_OF, TOLERANCE, WINDOW, overlaps
from tests.llm import tables


def allowed(size: int) -> int:
    return size - math.ceil(size * (1 - TOLERANCE))


def test_masks_leave_no_pattern_out():
    for size in range(1, WINDOW + 1):
        for lost in combinations(range(size), allowed(size)):
            assert any(not {start + at for at in MASKS[number]} & set(lost)
                       for number in MASKS_OF[size] for start in range(size - MASKS[number][-1])), (size, lost)


NO_SEEDS = f"""
WITH d AS (SELECT doc_id, string_split(text, ' ') AS words FROM docs), b AS (SELECT item_id, string_split(text, ' ') AS words FROM items),
pairs AS (SELECT doc_id, item_id, d.words AS dw, b.words AS bw, least({WINDOW}, len(b.words)) AS width,
                 unnest(range(1 - len(b.words), len(d.words))) AS shift FROM d, b),
agreed AS (SELECT doc_id, item_id, width, list_transform(range(0, len(bw)), lambda j:
               CASE WHEN shift + j >= 0 AND dw[shift + j + 1] = bw[j + 1] THEN 1 ELSE 0 END) AS agree FROM pairs)
SELECT doc_id, item_id, max(list_sum(agree))::BIGINT, max(len(agree))::BIGINT FROM agreed
WHERE list_max(list_transform(range(1, len(agree) - width + 2), lambda s: list_sum(agree[s:s + width - 1])))
      >= ceil(width * {1 - TOLERANCE})
GROUP BY doc_id, item_id"""


def test_overlaps_equal_sql_without_seeds(spark):
    pick = random.Random(6)
    items = [(size, " ".join(f"i{size}w{n}" for n in range(size))) for size in [*range(1, 14), 15, 20]]
    docs = []
    for size, text in items:
        for lost in combinations(range(min(size, 13)), min(2, size)):
            for change in (lost, lost[:1], ()) if lost[0] == 0 else (lost,):
                words = [f"x{len(docs)}" if n in change else w for n, w in enumerate(text.split())]
                around = [f"y{pick.randrange(99)}" for _ in range(pick.randrange(4))]
                docs.append((len(docs), " ".join(around + words + around[:1])))
    docs += [(len(docs), ""), (len(docs) + 1, "!")]
    db = duckdb.connect()
    for name, rows in (("docs", docs[:-2]), ("items", items)):
        key = {"docs": "doc_id", "items": "item_id"}[name]
        db.execute(f"CREATE TABLE {name} ({key} BIGINT, text VARCHAR)")
        db.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    got = overlaps(spark.createDataFrame(docs, "doc_id long, text string"),
                   spark.createDataFrame([*items, (99, " . "), (98, None)], "item_id long, text string")).collect()
    expected = db.execute(NO_SEEDS).fetchall()
    assert sorted(tuple(r) for r in got) == sorted(expected) and len(expected) > 400


def test_a_large_benchmark_goes_in_parts(spark, tmp_path, monkeypatch):
    """Parts of a handful of seeds, and an item far longer than a part, give what one part gives."""
    from meshledger.llm import decontaminate

    folder, _ = tables.odd_folder(spark, tmp_path, 60)
    long = [(800, " ".join(f"w{i}" for i in range(400)))]
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").unionAll(
        spark.createDataFrame([(7000, "x " + long[0][1] + " y")], "doc_id long, text string"))
    items = spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").unionAll(
        spark.createDataFrame(long, "item_id long, text string"))
    whole = sorted(tuple(r) for r in decontaminate.overlaps(docs, items).collect())
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", 1500)
    assert sorted(tuple(r) for r in decontaminate.overlaps(docs, items).collect()) == whole
    assert (7000, 800, 400, 400) in whole
