"""Benchmark decontamination by spaced seeds, DataFrame functions only.

A seed is a fixed mask over neighbouring tokens: positions outside the mask are ignored, so a substituted token
there does not hide a copied passage. Every mask at every place of a text gives one hash, and the masks of an item's
length are such that whatever substitutions the criterion allows leave one of them whole; hashes found in the
benchmark are hits, a hit fixes an alignment of item and text, and the alignment is verified by comparing
token after token: some window of ``WINDOW`` item tokens (the whole item, if shorter) must agree in all but
``window * TOLERANCE`` places.

Defined results: null and empty texts give no row; an item of four tokens or fewer is found word for word, so one of
a single word in every document with that word; a document without
id cannot be named, so gives none; repeated rows give one row; an empty table gives an empty result. Other
columns of the tables are not read.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshledger.llm.shared import LOWER, SPACE_CLASS, SPACES, UPPER, table

#: Token positions of each mask.
MASKS = ((0, 1, 2, 5, 6), (0, 2, 3, 4, 7), (0, 1, 2, 3, 4), (0, 1, 2, 4, 7), (0, 1, 3, 4, 5), (0, 1, 3, 4),
         (0, 1, 2, 3), (0, 1, 2, 4), (0, 2, 3, 4), (0, 1, 2), (0, 1), (0,))
#: Numbers of the masks of items of so many tokens (longer ones: ``WINDOW``). Any substitutions that leave
#: enough tokens leave the places of one mask unchanged; a test enumerates them.
MASKS_OF = {1: (11,), 2: (10,), 3: (9,), 4: (6,), 5: (5, 6, 7, 8), 6: (5, 6), 7: (5,), 8: (2, 4), 9: (4,),
            10: (0, 2, 3, 4), 11: (0, 2, 3), 12: (0, 1, 2)}
WINDOW, TOLERANCE = 12, 0.2
#: Fixed value: punctuation that is no part of a token.
PUNCTUATION = ".,;:!?\"()[]"
#: Seeds of one part of the benchmark (about 30 bytes each); a part's seeds and its items' tokens, of which there are no
#: more than seeds, are broadcast. A larger benchmark has more parts, each of which the documents pass in turn.
BROADCAST_SEEDS = 200_000


def token_hashes(text: Column) -> Column:
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER + PUNCTUATION, LOWER)
    words = F.split(F.trim(plain, F.lit(SPACES)), SPACE_CLASS)
    return F.transform(words, lambda word: F.xxhash64(word))


def seeds(df: DataFrame, keys: list[str], masks: list[int], of_items: bool = False) -> DataFrame:
    """A row for each mask at each place where it fits: keys, place (from 0), seed, and the tokens of a document. Of
    items, only the masks of their length, and no tokens: those are found by the item once a seed has hit."""
    spans = {number: 1 + MASKS[number][-1] for number in masks}
    shortest = min(spans.values())
    places = F.when(F.size("tokens") >= shortest, F.sequence(F.lit(0), F.size("tokens") - shortest))
    placed = df.select(*keys, "tokens", F.explode(places).alias("place"))
    each = []
    for number, span in spans.items():
        fits = F.col("place") + span <= F.size("tokens")
        if of_items:
            lengths = [length for length, numbers in MASKS_OF.items() if number in numbers]
            fits &= F.least(F.size("tokens"), F.lit(WINDOW)).isin(lengths)
        seed = F.xxhash64(F.lit(number), *[F.get("tokens", F.col("place") + at) for at in MASKS[number]])
        each.append(F.when(fits, seed))
    kept = [*keys, "place"] if of_items else [*keys, "tokens", "place"]
    return placed.select(*kept, F.explode(F.array(*each)).alias("seed")).filter("seed IS NOT NULL")


def _verdict(agree: Column) -> Column:
    """Agreements of an alignment, null unless some window agrees well enough, and the item's tokens."""
    size = F.size(agree)
    width = F.least(F.lit(WINDOW), size)
    sums = F.transform(F.sequence(F.lit(1), size - width + 1), lambda start: F.aggregate(
        F.slice(agree, start, width), F.lit(0), lambda total, one: total + one))
    fits = F.array_max(sums) >= F.ceil(width * F.lit(1 - TOLERANCE))
    total = F.aggregate(agree, F.lit(0), lambda total, one: total + one)
    return F.struct(F.when(fits, total).cast("long").alias("matched"), size.cast("long").alias("item_tokens"))


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Verified overlaps: doc_id, item_id, matched (agreeing tokens of the best alignment), item_tokens."""
    items = (benchmark.select("item_id", token_hashes(F.col("text")).alias("tokens"))
             .filter(F.col("item_id").isNotNull() & (F.col("tokens") != token_hashes(F.lit("")))).distinct()
             .withColumn("version", F.xxhash64("tokens")))
    lengths = [row[0] for row in items.select(F.least(F.size("tokens"), F.lit(WINDOW))).distinct().collect()]
    masks = sorted({number for length in lengths or [WINDOW] for number in MASKS_OF[length]})
    wanted = seeds(items, ["item_id", "version"], masks, of_items=True).distinct()
    parts = max(1, math.ceil(wanted.count() / BROADCAST_SEEDS))
    rows = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", token_hashes(F.col("text")).alias("tokens"))
    of_docs = seeds(rows, ["doc_id"], masks)
    mine = lambda df, part: df.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part)
    return reduce(DataFrame.unionAll, [verified(of_docs, mine(wanted, part), mine(items, part)) for part in range(parts)])


def verified(of_docs: DataFrame, wanted: DataFrame, items: DataFrame) -> DataFrame:
    """Overlaps with the items of one part of the benchmark; a hit's alignment is judged where it is found."""
    item = wanted.select("seed", "item_id", "version", F.col("place").alias("item_place"))
    text = items.select("item_id", "version", F.col("tokens").alias("item"))
    found = of_docs.join(F.broadcast(item), "seed").join(F.broadcast(text), ["item_id", "version"])
    shift = F.col("place") - F.col("item_place")
    agree = F.transform("item", lambda token, at: F.when(
        (shift + at >= 0) & (F.get("tokens", shift + at) == token), 1).otherwise(0))
    # A lambda binds the agreements once, however often the verdict uses them.
    verdict = F.transform(F.array(agree), _verdict)[0]
    return (found.groupBy("doc_id", "item_id").agg(F.max(verdict).alias("best"))
            .filter("best.matched IS NOT NULL")
            .select("doc_id", "item_id", "best.matched", "best.item_tokens"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, whole and with all their columns, that overlap with no benchmark item."""
    leaked = overlaps(docs, benchmark).select("doc_id").distinct()
    return docs.join(leaked, "doc_id", "left_anti").select(*docs.columns)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The SQL states the first two masks; it lacks the leaks that only the others find.
SQL_MASKS, SQL_SPAN = MASKS[:2], 8


def _sql_tokens(name: str, key: str, source: str) -> str:
    return f"""
{name}_words AS (SELECT {key}, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}{PUNCTUATION}', '{LOWER}'),
    '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM {source} WHERE {key} IS NOT NULL),
{name} AS (SELECT DISTINCT {key}, words, unnest(range(0, len(words) - {SQL_SPAN - 1})) AS place FROM {name}_words),
{name}_seeds AS ({" UNION ALL ".join(
    f"SELECT {key}, words, place, [{', '.join(f'words[place + {1 + at}]' for at in mask)}] AS seed, {n} AS mask FROM {name}"
    for n, mask in enumerate(SQL_MASKS))})"""


SQL = f"""
WITH {_sql_tokens('d', 'doc_id', 'documents')}, {_sql_tokens('b', 'item_id', 'benchmark')},
hits AS (SELECT DISTINCT d.doc_id, b.item_id, d.words AS doc_words, b.words AS item_words, d.place - b.place AS shift
         FROM d_seeds d JOIN b_seeds b ON d.mask = b.mask AND d.seed = b.seed),
agreed AS (SELECT doc_id, item_id, list_transform(range(0, len(item_words)), lambda j:
               CASE WHEN shift + j >= 0 AND doc_words[shift + j + 1] = item_words[j + 1] THEN 1 ELSE 0 END) AS agree
           FROM hits),
judged AS (SELECT doc_id, item_id, agree, least({WINDOW}, len(agree)) AS width FROM agreed)
SELECT doc_id, item_id, max(list_sum(agree))::BIGINT AS matched, max(len(agree))::BIGINT AS item_tokens
FROM judged
WHERE list_max(list_transform(range(1, len(agree) - width + 2), lambda s: list_sum(agree[s:s + width - 1])))
      >= ceil(width * {1 - TOLERANCE})
GROUP BY doc_id, item_id
"""
