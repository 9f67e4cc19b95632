"""Similarity join of shingle sets by PartEnum signatures and rare shingles.

Sets are grouped into bands of like size. Two sets of Jaccard similarity 4/5 or more differ in at most a ninth of
their summed sizes, d elements. First the shingle domain is cut into n parts by hash, and a set signs each part that holds
something. d differences touch at most d parts, so of any d + 1 filled parts of a set a similar set signs one alike.

Sets with an equal signature are compared with the smallest of them only (a star, combined within a task before it
is shuffled), and what is linked needs no further comparison. Where a group still holds several components, their
members are compared across components, by size and parity sketch inside the task that has the group: only pairs
that these do not rule out become rows. A group with many such pairs, made by passages that unlike documents share, is
left out: n is large enough for a set to lose some parts and keep d + 1. Sets that do not (texts made of such passages, and
sets with too few filled parts) go on with each other and are grouped by their rarest shingles: two similar sets of which
neither has more than n share 4/5 n, so with all shingles in one order the first one they share is among the first
n/5 + 1 of each. The order is by number of sets, and passages come last. Candidates whose sizes or parity sketches rule
out the similarity go; every other is verified on the shingles of the whole texts.

Defined results: a text without words is linked with nothing and has size 0; fewer words than a shingle make one
shingle; equal texts are linked; rows of one doc_id are one node, linked as any of its texts is; a row without id has
its size, is linked with nothing and has a null component; an empty table gives an empty result. Other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshledger.llm.components import components
from meshledger.llm.shared import few_rows, settle, stage, table
from meshledger.session import release
from meshledger.llm.sharing import sharing
from meshledger.llm.textarrays import inside, mix, run_hashes, slices, words_of

SHINGLE = 5
#: Ratio of a band's ends.
RATIO = 1.5
#: Bytes of text whose shingles are taken at once.
SLICE = 512 << 10
#: Pairs of texts in an Arrow batch, and single texts.
PAIRS, TEXTS = 128, 2_000
#: Signatures combined at once within a task.
COMBINED = 1 << 19
#: Pairs across components in one signature group beyond which it is left out.
CROWDED = 300
#: Rows of signature groups compared by one call, pairs compared at once, and members of a group beyond which it is cut into
#: blocks, each pair of blocks on its own.
BUCKET, COMPARED, BLOCK = 1 << 15, 1 << 16, 2_000
#: Ids of candidates up to this number (8 bytes each) are broadcast to find their texts; more are joined.
BROADCAST_IDS = 200_000
_U = np.uint64


def shingle_sets(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text as (text, hash), sorted by both."""
    words = words_of(text, lower=True)
    hashes, count, doc = words.hashes(), words.counts, words.doc()
    runs = run_hashes(hashes, SHINGLE)
    at = np.flatnonzero(inside(words.first, SHINGLE, len(hashes)))
    docs, values = [doc[at]], [runs[at]]
    for n in range(1, SHINGLE):
        rows = np.flatnonzero(count == n)
        if len(rows):
            docs.append(rows)
            values.append(run_hashes(hashes, n, seed=900 + n)[words.first[rows]])
    doc, value = np.concatenate(docs), np.concatenate(values)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[new], value[new]


def _sums(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of each one's values."""
    if not len(key):
        return key, value
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[start], np.add.reduceat(value, start)


def bands(size: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """The band of each size, then the next one for sets that may have partners there: (sets that sign, band, its
    upper end, most elements that such a set and a partner differ in)."""
    own = np.floor(np.log(np.maximum(size, 1)) / np.log(RATIO) + 1e-9).astype(np.int64)
    for band in (own, own + 1):
        low, high = RATIO**band, RATIO ** (band + 1)
        largest = np.minimum(size * 5 // 4, np.ceil(high).astype(np.int64))
        yield (size > 0) & (largest >= low - 1e-6), band, high, (size + largest) // 9


def _parts(doc: np.ndarray, value: np.ndarray, here: np.ndarray, band: np.ndarray, high: np.ndarray):
    """Filled parts of each set in order, as (text, signature of what the part holds)."""
    pick = here[doc]
    code = mix(value[pick] + _U(0x632BE59BD9B4E019))
    doc = doc[pick]
    part = (code % (np.ceil(0.33 * high).astype(np.int64) + 2)[doc].astype(_U)).astype(np.int64)
    key, total = _sums(doc << 32 | part, mix(code ^ _U(0x5851F42D4C957F2D)))
    home = key >> 32
    sign = mix(total + mix((key & 0xFFFFFFFF).astype(_U) + mix(band.astype(_U))[home]))
    # The last bit tells a set's two bands apart.
    return home, sign >> _U(1) << _U(1) | (band[home] & 1).astype(_U)


def spare_parts(doc: np.ndarray, value: np.ndarray, texts: int) -> np.ndarray:
    """For bands of even and odd number: filled parts of each set beyond those it needs (negative: too few)."""
    size = np.bincount(doc, minlength=texts)
    out = np.full((2, texts), 1 << 30)
    for here, band, high, apart in bands(size):
        home, _ = _parts(doc, value, here, band, high)
        filled = np.bincount(home, minlength=texts)
        rows = np.flatnonzero(here)
        out[band[rows] & 1, rows] = filled[rows] - apart[rows] - 1
    return out


def signatures(doc: np.ndarray, value: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, signature) rows of sets given as by ``shingle_sets``."""
    size = np.bincount(doc, minlength=texts)
    found = [_parts(doc, value, here, band, high) for here, band, high, _ in bands(size)]
    return np.concatenate([home for home, _ in found]), np.concatenate([sign for _, sign in found])


def signature_groups(docs: DataFrame) -> DataFrame:
    """(signature, doc, leader) of every signature that two documents or more have, staged."""
    def keys(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return signatures(*shingle_sets(text), len(text))

    return few_rows(lambda: sharing(docs, keys, SLICE, COMBINED), docs.sparkSession, TEXTS)


def shingles_of(docs: DataFrame) -> DataFrame:
    """(doc, of, shingle, needed, band, reach) of every text: ``of`` tells the sets of a document apart, ``needed`` of a set's
    rarest shingles are compared, in the bands from ``band`` to ``reach``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                doc, value = shingle_sets(part.column("text"))
                size = np.bincount(doc, minlength=part.num_rows)
                of = np.zeros(part.num_rows, _U)
                rows, total = _sums(doc, mix(value + _U(103)))
                of[rows] = total
                (_, band, *_), (beyond, *_) = bands(size)
                columns = (of.view(np.int64)[doc], value.view(np.int64), (size // 5 + 1)[doc], band[doc], (band + beyond)[doc])
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(doc)), *map(pa.array, columns)],
                                                 ["doc", "of", "shingle", "needed", "band", "reach"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc long, of long, shingle long, needed long, band long, reach long")


def rare_groups(docs: DataFrame) -> DataFrame:
    """(signature, doc, leader) of every one of the rarest shingles that two documents or more of a band need, staged."""
    spark, shingles = docs.sparkSession, shingles_of(docs)
    often = few_rows(lambda: shingles.groupBy("shingle").agg(F.count("*").alias("often")).filter("often > 1"), spark, TEXTS)
    # Rows of one set that come again have equal ranks; shingles of one set alone take places but make no group.
    order = Window.partitionBy("doc", "of").orderBy(F.coalesce("often", F.lit(1)), "shingle")
    signed = few_rows(lambda: shingles.join(often, "shingle", "left").withColumn("nth", F.dense_rank().over(order))
                      .filter("nth <= needed AND often > 1")
                      .select(F.explode(F.sequence("band", "reach")).alias("in"), "shingle", "doc")
                      .select(F.xxhash64("shingle", "in").alias("signature"), "doc").distinct(), spark, TEXTS)
    release(spark, often)
    lead = signed.groupBy("signature").agg(F.min("doc").alias("leader"), F.max("doc").alias("last")).filter("leader < last")
    groups = stage(signed.join(lead.drop("last"), "signature"))
    release(spark, signed)
    return groups


def parity_sketch(value: np.ndarray) -> bytes:
    """A bit for each of 2n or more places (a power of two): whether an odd number of the n shingles falls there.
    Each element that only one of two sets has turns one bit, so bits that differ never outnumber those."""
    places = max(64, 1 << int(2 * len(value) - 1).bit_length())
    count = np.bincount((value % _U(places)).astype(np.int64), minlength=places)
    return np.packbits(count & 1).tobytes()


def fewest_apart(one: bytes, two: bytes) -> int:
    """Elements that two sets differ in at least; the longer sketch is folded to the places of the shorter."""
    small, large = sorted((np.frombuffer(one, np.uint8), np.frombuffer(two, np.uint8)), key=len)
    folded = np.bitwise_xor.reduce(large.reshape(-1, len(small)), axis=0)
    return int(np.bitwise_count(folded ^ small).sum())


class Looks:
    """Sizes and sketches of documents. A document without size has several texts and is never ruled out."""

    def __init__(self, size: np.ndarray, sketch: list[bytes | None]):
        self.size, self.width = size, np.array([len(x or b"") for x in sketch], np.int64)
        self.at: dict[int, np.ndarray] = {}
        self.table: dict[int, np.ndarray] = {}
        for width in np.unique(self.width[self.width > 0]).tolist():
            # Sets of like size have sketches of one width, or one is twice as long and folded.
            rows = np.flatnonzero((self.width == width) | (self.width == 2 * width))
            self.at[width] = np.zeros(len(size), np.int64)
            self.at[width][rows] = np.arange(len(rows))
            self.table[width] = np.stack([np.bitwise_xor.reduce(np.frombuffer(sketch[row], np.uint8).reshape(-1, width), axis=0)
                                          for row in rows]).view(_U)

    def alike(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Which pairs of rows sizes and sketches do not rule out, as ``plausible`` tells."""
        n, m = self.size[one], self.size[two]
        keep = (n < 0) | (m < 0)
        compared = ~keep & (10 * np.minimum(n, m) >= 8 * np.maximum(n, m))
        narrow = np.where(compared, np.minimum(self.width[one], self.width[two]), 0)
        for width, table in self.table.items():
            rows = np.flatnonzero(narrow == width)
            at = self.at[width]
            differ = np.bitwise_count(table[at[one[rows]]] ^ table[at[two[rows]]]).sum(axis=1, dtype=np.int64)
            keep[rows] = 9 * differ <= n[rows] + m[rows]
        return keep


def alike_across(place: np.ndarray, row: np.ndarray, component: np.ndarray, side: np.ndarray, looks: Looks) -> Iterator[np.ndarray]:
    """Pairs of rows of ``looks`` that share a place, are of different components and not ruled out, ``COMPARED`` pairs at
    a time. Rows of sides 1 and 2 are compared with the other side only, those of side 0 with each other."""
    order = np.argsort(place, kind="stable")
    place, row, component, side = place[order], row[order], component[order], side[order]
    rows = np.arange(len(place))
    after = np.searchsorted(place, place, "right") - rows - 1
    through = np.cumsum(after)
    i = 0
    while i < len(rows):
        j = max(i + 1, int(np.searchsorted(through, through[i] - after[i] + COMPARED, "right")))
        count = after[i:j]
        left = np.repeat(rows[i:j], count)
        right = np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count) + left + 1
        keep = (component[left] != component[right]) & ((side[left] == 0) | (side[left] != side[right]))
        left, right = row[left[keep]], row[right[keep]]
        keep = looks.alike(left, right)
        if keep.any():
            yield np.unique(np.stack([np.maximum(left, right)[keep], np.minimum(left, right)[keep]]), axis=1)
        i = j


def looks_of(sets: DataFrame) -> DataFrame:
    """doc, size and sketch of every document with a set; of one with several different sets -1 and null."""
    one = F.expr("size = most AND sketch = last")
    return (sets.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("doc"))
            .agg(F.min("n_shingles").alias("size"), F.max("n_shingles").alias("most"), F.min("sketch").alias("sketch"),
                 F.max("sketch").alias("last"))
            .select("doc", F.when(one, F.col("size")).otherwise(-1).alias("size"), F.when(one, F.col("sketch")).alias("sketch")))


def pairs_of_groups(member: DataFrame, looks: DataFrame) -> DataFrame:
    """(one, two), one > two: members of a group of different components that sizes and sketches do not rule out.

    Groups are dealt over buckets, and a bucket gets the sketch of each of its documents once. What a call holds is bounded: a
    group of many members is cut into blocks."""
    buckets = member.count() // BUCKET + 1
    large = (member.groupBy("signature").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).filter("blocks > 1"))
    own, other = F.pmod(F.xxhash64("doc"), F.col("blocks")), F.col("other")
    place = F.xxhash64("signature", F.least(own, other), F.greatest(own, other))
    dealt = (member.join(large, "signature", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
             .select(place.alias("place"), "doc", "component", F.when(own == other, 0).when(own < other, 1).otherwise(2).alias("side"))
             .withColumn("bucket", F.pmod("place", F.lit(buckets))))
    seen = (dealt.select(F.col("bucket").alias("of"), F.col("doc").alias("id")).distinct()
            .join(looks.withColumnRenamed("doc", "id"), "id").select("of", "id", "size", "sketch"))

    def compare(rows: pa.Table, seen: pa.Table) -> pa.Table:
        doc = seen.column("id").to_numpy()
        order = np.argsort(doc)
        seen, doc = seen.take(pa.array(order)), doc[order]
        row = np.searchsorted(doc, rows.column("doc").to_numpy())
        found = list(alike_across(*(rows.column("place").to_numpy(), row, *(rows.column(c).to_numpy() for c in ("component", "side"))),
                                  Looks(seen.column("size").to_numpy(), seen.column("sketch").to_pylist())))
        pairs = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.empty((2, 0), np.int64)
        # Rows are in the order of the ids.
        return pa.table({"one": doc[pairs[0]], "two": doc[pairs[1]]})

    return dealt.groupBy("bucket").cogroup(seen.groupBy("of")).applyInArrow(compare, "one long, two long").distinct()


def plausible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that sizes and sketches do not rule out. Only unlike sets are ruled out, never a similar pair."""
    def rule(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array([9 * fewest_apart(one, two) <= n + m for one, two, n, m in zip(
                *(batch.column(c).to_pylist() for c in ("sketch_one", "sketch_two", "n_one", "n_two")))], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("one").filter(keep), batch.column("two").filter(keep)], ["one", "two"])

    side = {name: sets.filter("n_shingles > 0").select(F.col("doc_id").alias(name), F.col("n_shingles").alias(f"n_{name}"),
                                                       F.col("sketch").alias(f"sketch_{name}")) for name in ("one", "two")}
    return (pairs.join(side["one"], "one").join(side["two"], "two")
            .filter("10 * least(n_one, n_two) >= 8 * greatest(n_one, n_two)")
            .select("one", "two", "sketch_one", "sketch_two", "n_one", "n_two")
            .mapInArrow(rule, "one long, two long").distinct())


def verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (one, two) whose sets are similar enough, staged."""
    pairs = stage(plausible(pairs, sets))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text_one", SLICE):
                keep = []
                sets = []
                for name in ("text_one", "text_two"):
                    doc, value = shingle_sets(part.column(name))
                    sets.append((np.searchsorted(doc, np.arange(part.num_rows + 1)), value))
                for row in range(part.num_rows):
                    left, right = (value[first[row] : first[row + 1]] for first, value in sets)
                    shared = len(np.intersect1d(left, right, assume_unique=True))
                    keep.append(100 * shared >= 80 * (len(left) + len(right) - shared) and shared > 0)
                kept = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("one").filter(kept), part.column("two").filter(kept)],
                                                 ["one", "two"])

    # Only texts of some pair are shuffled.
    ids = pairs.select(F.col("one").alias("doc_id")).unionAll(pairs.select("two")).distinct()
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    text = docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    found = few_rows(lambda: pairs.join(text.select(F.col("doc_id").alias("one"), F.col("text").alias("text_one")), "one")
                     .join(text.select(F.col("doc_id").alias("two"), F.col("text").alias("text_two")), "two")
                     .select("one", "two", "text_one", "text_two").mapInArrow(compare, "one long, two long"), docs.sparkSession, PAIRS)
    release(docs.sparkSession, pairs)
    return found


def set_keys(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, a 128-bit key (a, b), equal for equal sets, the parity sketch and the spare parts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                doc, value = shingle_sets(part.column("text"))
                size = np.bincount(doc, minlength=part.num_rows)
                keys = [np.zeros(part.num_rows, _U) for _ in range(2)]
                for seed, key in enumerate(keys):
                    rows, total = _sums(doc, mix(value + _U(101 + seed)))
                    key[rows] = total
                first = np.r_[0, np.cumsum(size)]
                spare = spare_parts(doc, value, part.num_rows)
                sketch = [parity_sketch(value[i:j]) if i < j else None for i, j in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(size), pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)),
                     pa.array(sketch, pa.binary()), *map(pa.array, spare)],
                    ["doc_id", "n_shingles", "a", "b", "sketch", "spare_even", "spare_odd"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, a long, b long, sketch binary, "
                                               "spare_even long, spare_odd long")


def pairs_across(member: DataFrame) -> DataFrame:
    """(signature, across): pairs of members of different components."""
    each = member.groupBy("signature", "component").count()
    return each.groupBy("signature").agg(((F.pow(F.sum("count"), 2) - F.sum(F.pow("count", F.lit(2)))) / 2).alias("across"))


def distinct_groups(member: DataFrame) -> DataFrame:
    """Of the signatures with equal members (told apart by two hashes and their number) the smallest: others would make the same
    pairs again. A passage that documents share gives many such signatures."""
    told = member.groupBy("signature").agg(F.count("*").alias("n"), F.sum(F.xxhash64("doc").cast("decimal(20,0)")).alias("a"),
                                           F.bit_xor(F.xxhash64("doc", F.lit(1))).alias("b"))
    kept = told.groupBy("n", "a", "b").agg(F.min("signature").alias("signature")).select("signature")
    return member.join(kept, "signature", "left_semi")


def needed(member: DataFrame, spare: DataFrame) -> DataFrame:
    """The members that have to be compared across components. Put a set's filled parts in the order of such pairs, those
    of signatures without any first: two similar sets meet in one of the first d + 1 of each, as of the parts before their
    first common one all differ. So a set can do without as many of its largest groups as it has parts to spare."""
    odd = F.col("signature").bitwiseAND(1)
    ranked = member.join(pairs_across(member), "signature").join(spare.withColumnRenamed("doc_id", "doc"), "doc")
    order = Window.partitionBy("doc", odd).orderBy(F.desc("across"), "signature")
    return (ranked.withColumn("nth", F.row_number().over(order))
            .filter(F.col("nth") > F.when(odd == 1, F.col("spare_odd")).otherwise(F.col("spare_even")))
            .select("signature", "doc", "component"))


def similar(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sizes (doc_id, n_shingles), a row for each row of ``docs``, and (node, component) of linked documents."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = few_rows(lambda: set_keys(docs), spark, TEXTS)
    named = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL")
    full = sets.select("doc_id", "n_shingles", "a", "b").filter("n_shingles > 0 AND doc_id IS NOT NULL")
    full_spare = (sets.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("doc_id")
                  .agg(F.min("spare_even").alias("spare_even"), F.min("spare_odd").alias("spare_odd")))
    looks = stage(looks_of(sets))
    # Equal sets are one class; its smallest document stands for it.
    classes = full.groupBy("n_shingles", "a", "b").agg(F.min("doc_id").alias("two"), F.count("*").alias("n"))
    copies = stage(full.join(classes.filter("n > 1").drop("n"), ["n_shingles", "a", "b"])
                   .select(F.col("doc_id").alias("one"), "two").filter("one <> two").distinct())
    # An id whose rows hold different texts stays, for the other texts.
    mingled = (full.groupBy("doc_id").agg(*[F.min(c).alias(f"low_{c}") for c in ("a", "b")],
                                          *[F.max(c).alias(f"high_{c}") for c in ("a", "b")])
               .filter("low_a <> high_a OR low_b <> high_b").select("doc_id"))
    passed = copies.select(F.col("one").alias("doc_id")).join(mingled, "doc_id", "left_anti")
    alone = named.join(passed, "doc_id", "left_anti")
    links, known, scope = copies, None, alone
    for last in (False, True):
        groups = rare_groups(scope) if last else signature_groups(scope)
        stars = stage(groups.select(F.col("doc").alias("one"), F.col("leader").alias("two")).filter("one <> two").distinct())
        links = links.unionAll(verified(stars, named, sets))
        tried = stars if known is None else known.unionAll(stars)
        part = components(links)
        member = (groups.select("signature", "doc").join(part.withColumnRenamed("node", "doc"), "doc", "left")
                  .select("signature", "doc", F.coalesce("component", "doc").alias("component")))
        mixed = (member.groupBy("signature").agg(F.min("component").alias("low"), F.max("component").alias("high"))
                 .filter("low < high").select("signature"))
        member = stage(member.join(mixed, "signature").distinct())
        release(spark, groups, part)
        chosen = stage(distinct_groups(member if last else stage(needed(member, full_spare))))
        crowded = (pairs_across(chosen).filter(F.lit(False) if last else F.col("across") > CROWDED).select("signature"))
        plain = chosen.join(crowded, "signature", "left_anti").select("signature", "doc", "component")
        across = few_rows(lambda: pairs_of_groups(plain, looks).join(tried, ["one", "two"], "left_anti"), spark, TEXTS)
        links = links.unionAll(verified(across, named, sets))
        known = tried.unionAll(across)
        if last:
            break
        # A set that needs a crowded signature has others like it to find; so does one with too few filled parts.
        onward = stage(chosen.join(crowded, "signature").select(F.col("doc").alias("doc_id"))
                       .unionAll(full_spare.filter("spare_even < 0 OR spare_odd < 0").select("doc_id")).distinct())
        release(spark, member, chosen)
        settle(spark)
        if onward.isEmpty():
            break
        scope = named.join(onward, "doc_id", "left_semi")
    return sets.select("doc_id", "n_shingles"), components(links)


def one_of_each(docs: DataFrame) -> DataFrame:
    """Pipeline stage: of each component the document of the smallest id, with all its columns."""
    _, part = similar(docs)
    return docs.join(part.select(F.col("node").alias("doc_id")), "doc_id", "left_anti").select(*docs.columns)


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes, part = similar(table(spark, sf_dir, "documents"))
    return (sizes.join(part.withColumnRenamed("node", "doc_id"), "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")))
