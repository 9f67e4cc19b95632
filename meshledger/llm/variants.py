"""Spelling variants: words one edit apart, found by k-d trees over their letter counts.

One inserted or deleted letter moves a word's letter counts by one in one place, a replaced one by one up in one place
and one down in another. Words of each length are therefore points; the near words of a point lie in boxes that ask for
at most one step up and one step down (same length) or one step up (next length), so all other boxes are pruned. A top
tree per length, cut on a bounded sample of the words, deals words to cells: each word lies in one cell and visits the
other cells in reach. Inside a cell a second tree prunes down to leaves, parities of the letter counts rule
out most pairs of a leaf, and the letters are compared in order. Every pair of near words meets in exactly one cell; a
cell sends one row for each word, so a word with many near words is hot nowhere.

Counts above 255 count as 255 in the trees, which only ever brings points closer, so no near word is lost; lengths that the sample
lacks are one cell each.

Defined results: null and empty texts have no words; a row without id has an empty id in its hashes; repeated rows count each;
ties go to the smaller word in code-point order; an empty table gives an empty result. Texts are taken whole. Other
columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshledger.llm.shared import sample_rows, stage, table
from meshledger.llm.textarrays import mix, slices, stream, string_buffer

#: Letters a word needs, occurrences it needs, and how many times more often its form has to occur.
LETTERS, OCCURRENCES, RATIO = 7, 2, 10
#: One run in so many, by hash, loses a letter.
LOST = 31
#: Words the top trees are cut on, words of a cell (by the sample's estimate), words of a leaf.
SAMPLE, CELL, LEAF = 1 << 15, 1 << 13, 32
#: Bytes of text, and queries of a cell, taken at once; runs longer than this are hashed one by one.
SLICE, QUERIES, LONG = 8 << 20, 1 << 15, 256

#: Letters are a-z, A-Z and U+00C0 to U+00FF; the latter are the byte C3 and one more in UTF-8.
_LATIN = 0xC3
_LETTER = np.zeros(256, bool)
_LETTER[np.r_[65:91, 97:123, _LATIN]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Number of a letter by its (last) byte, in code-point order: a-z are 1 to 26, U+00C0 to U+00FF 27 to 90.
DIMENSIONS = 90
_CODE = np.zeros(256, np.uint8)
_CODE[97:123] = np.arange(1, 27)
_CODE[128:192] = np.arange(27, 91)


def _crc_table() -> np.ndarray:
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, (value >> 1) ^ np.uint32(0xEDB88320), value >> 1).astype(np.uint32)
    return value


CRC = _crc_table()


def runs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Longest runs of letters: lower-cased bytes, starts, ends, and the text of each run."""
    data, offsets = string_buffer(column)
    letter = _LETTER[data]
    letter[1:] |= data[:-1] == _LATIN
    turn = np.ones(len(data) + 1, bool)
    np.not_equal(letter[1:], letter[:-1], out=turn[1:-1])
    turn[offsets] = True
    start, end = np.flatnonzero(turn[:-1] & letter), np.flatnonzero(turn[1:] & letter) + 1
    return _LOWER[data], start, end, np.searchsorted(offsets, start, "right") - 1


def checksums(data: np.ndarray, start: np.ndarray, length: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of every run when what came before it has the checksum ``before``."""
    out = ~before.astype(np.uint32)
    order = np.argsort(-length, kind="stable")
    order = order[np.searchsorted(-length[order], -LONG):]
    begin, size, state = start[order], length[order], out[order]
    for i in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -i, "left"))  # runs longer than i
        state[:n] = CRC[(state[:n] ^ data[begin[:n] + i]) & np.uint32(255)] ^ (state[:n] >> np.uint32(8))
    out[order] = state
    out = ~out
    for i in np.flatnonzero(length > LONG):
        out[i] = zlib.crc32(data[start[i] : start[i] + length[i]], int(before[i]))
    return out


def gather(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all runs one after another, and where each begins."""
    begin = np.cumsum(length) - length
    return data[np.repeat(start - begin, length) + np.arange(int(length.sum()))], begin


def distinct(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of every different run, and how often it occurs. Runs are told apart by a 64-bit hash."""
    packed, begin = gather(data, start, length)
    factor, letter = stream(9, int(length.max(initial=1))) | np.uint64(1), stream(86, 256)
    value = letter[packed] * factor[np.arange(len(packed)) - np.repeat(begin, length)]
    code = mix(np.add.reduceat(value, begin) + length.astype(np.uint64)) if len(begin) else np.empty(0, np.uint64)
    _, first, count = np.unique(code, return_index=True, return_counts=True)
    return first, count


def _strings(data: np.ndarray, length: np.ndarray) -> pa.Array:
    offsets = np.r_[0, np.cumsum(length)].astype(np.int32)
    return pa.StringArray.from_buffers(len(length), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))


def _shortened(ids: pa.Array, column: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Words of the texts, a letter less where the hash says so, with their occurrences."""
    data, start, end, home = runs(column)
    letters = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    size = letters[end] - letters[start]
    long = np.flatnonzero(size >= LETTERS)
    start, length, size, home = start[long], (end - start)[long], size[long], home[long]
    before = np.array([zlib.crc32(b"%s:" % (b"" if i is None else str(i).encode())) for i in ids.to_pylist()], np.uint32)
    code = checksums(data, start, length, before[home])
    lost = code % LOST == 0
    whole = np.flatnonzero(~lost)
    if len(whole):
        first, count = distinct(data, start[whole], length[whole])
        at = whole[first]
        yield _strings(gather(data, start[at], length[at])[0], length[at]), count
    words = []
    for i in np.flatnonzero(lost & (size > LETTERS)):
        word = bytes(data[start[i] : start[i] + length[i]]).decode()
        at = int(code[i]) % len(word)
        words.append(word[:at] + word[at + 1 :])
    if words:
        yield pa.array(words, pa.string()), np.ones(len(words), np.int64)


def occurring(docs: DataFrame, least: int = OCCURRENCES) -> DataFrame:
    """(word, n): words with their occurrences, counted per slice and per task before they are shuffled."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                for words, n in _shortened(part.column("doc_id"), part.column("text")):
                    yield pa.RecordBatch.from_arrays([words, pa.array(n, pa.int64())], ["word", "n"])

    return (docs.select("doc_id", "text").filter("text IS NOT NULL").mapInArrow(count, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least))


@dataclass
class Points:
    """Words as points: letters in order, one after another, and their counts (255 at most)."""

    codes: np.ndarray
    first: np.ndarray
    counts: np.ndarray
    odd: np.ndarray

    @staticmethod
    def of(words: pa.Array) -> Points:
        data, offsets = string_buffer(words)
        letter = data != _LATIN
        codes = _CODE[data[letter]]
        first = np.r_[0, np.cumsum(letter)][offsets]
        size, n = np.diff(first), len(words)
        count = np.bincount(np.repeat(np.arange(n), size) * DIMENSIONS + codes - 1, minlength=n * DIMENSIONS).reshape(n, DIMENSIONS)
        # Parities of a-z and of the frequent accented letters in one word of 64 bits, of the other letters in another.
        parity, bit = (count & 1).astype(np.uint64), np.arange(64, dtype=np.uint64)
        odd = np.stack([(parity[:, where] << bit[: len(where)]).sum(axis=1) for where in (np.r_[0:26, 52:90], np.r_[26:52])])
        return Points(codes, first, np.minimum(count, 255).astype(np.uint8), odd.astype(np.uint64))

    def hashes(self) -> np.ndarray:
        size = np.diff(self.first)
        place = np.arange(len(self.codes)) - np.repeat(self.first[:-1], size)
        value = self.codes.astype(np.uint64) * (stream(4, int(size.max(initial=1))) | np.uint64(1))[place]
        return mix(np.add.reduceat(value, self.first[:-1])) if len(size) else np.empty(0, np.uint64)

    def letters(self, rows: np.ndarray, size: int) -> np.ndarray:
        """Letters of words of one length, a row each."""
        return self.codes[self.first[rows][:, None] + np.arange(size)]


@dataclass
class Tree:
    """k-d tree over letter counts. Node i splits letter ``letter[i]`` after ``upto[i]`` into the nodes ``left[i]`` and
    ``right[i]``; a leaf has letter -1 and its number in ``left``."""

    letter: list[int]
    upto: list[int]
    left: list[int]
    right: list[int]
    leaves: list[np.ndarray]

    @staticmethod
    def over(counts: np.ndarray, size: float) -> Tree:
        tree = Tree([], [], [], [], [])
        tree._grow(counts, np.arange(len(counts)), size)
        return tree

    def _grow(self, counts: np.ndarray, rows: np.ndarray, size: float) -> int:
        node = len(self.letter)
        for part in (self.letter, self.upto, self.left, self.right):
            part.append(-1)
        cut = self._cut(counts[rows]) if len(rows) > size else None
        if cut is None:
            self.left[node] = len(self.leaves)
            self.leaves.append(rows)
            return node
        self.letter[node], self.upto[node] = cut
        low = counts[rows, cut[0]] <= cut[1]
        self.left[node] = self._grow(counts, rows[low], size)
        self.right[node] = self._grow(counts, rows[~low], size)
        return node

    @staticmethod
    def _cut(counts: np.ndarray) -> tuple[int, int] | None:
        """The letter and count that halve the points best; None if all points are equal."""
        best, found = 0, None
        for upto in range(int(counts.max())):
            low = (counts <= upto).sum(axis=0)
            balance = np.minimum(low, len(counts) - low)
            letter = int(balance.argmax())
            if balance[letter] > best:
                best, found = int(balance[letter]), (letter, upto)
            elif not balance.any():
                break
        return found

    def reach(self, counts: np.ndarray, down: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, points) for all points that get into a leaf's box by at most one step up and ``down`` steps down."""
        none = np.zeros(len(counts), np.int8)
        todo = [(0, np.arange(len(counts)), none, none, {})]
        while todo:
            node, rows, ups, downs, box = todo.pop()
            letter = self.letter[node]
            if letter < 0:
                yield self.left[node], rows
                continue
            low, high = box.get(letter, (0, 255))
            upto, value = self.upto[node], counts[rows, letter].astype(np.int16)
            more = downs - np.maximum(value - high, 0) + np.maximum(value - upto, 0)
            keep = more <= down
            if keep.any():
                todo.append((self.left[node], rows[keep], ups[keep], more[keep], box | {letter: (low, upto)}))
            more = ups - np.maximum(low - value, 0) + np.maximum(upto + 1 - value, 0)
            keep = more <= 1
            if keep.any():
                todo.append((self.right[node], rows[keep], more[keep], downs[keep], box | {letter: (upto + 1, high)}))


@dataclass
class Cells:
    """Top trees by length. Cell of leaf i: ``first[i]`` + a salt; more than one salt where points can't be told apart."""

    trees: dict[int, tuple[Tree, np.ndarray, np.ndarray]]

    @staticmethod
    def over(words: pa.Array, total: int, cell: int) -> Cells:
        points = Points.of(words)
        size, trees = np.diff(points.first), {}
        share = max(1.0, total / max(len(words), 1))
        for length in np.unique(size).tolist():
            counts = points.counts[size == length]
            tree = Tree.over(counts, cell / share)
            salts = np.array([max(1, int(np.ceil(len(rows) * share / (2 * cell)))) for rows in tree.leaves])
            trees[length] = tree, np.cumsum(salts) - salts, salts
        return Cells(trees)

    def visits(self, points: Points) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        """(points, lengths, cells, role): where each word lies (0), which later cells of its length it visits (1), and
        which cells of the next length (2)."""
        size = np.diff(points.first)
        salt = points.hashes()
        for length in np.unique(size).tolist():
            rows = np.flatnonzero(size == length)
            counts, own = points.counts[rows], np.zeros(len(rows), np.int64)
            if length in self.trees:
                tree, first, salts = self.trees[length]
                for leaf, at in self._homes(tree, counts):
                    own[at] = first[leaf] + (salt[rows[at]] % np.uint64(salts[leaf])).astype(np.int64)
                for leaf, at in tree.reach(counts, 1):
                    for cell in range(first[leaf], first[leaf] + salts[leaf]):
                        later = at[own[at] < cell]
                        yield rows[later], np.full(len(later), length), np.full(len(later), cell), 1
            yield rows, np.full(len(rows), length), own, 0
            if length + 1 not in self.trees:
                yield rows, np.full(len(rows), length + 1), np.zeros(len(rows), np.int64), 2
                continue
            tree, first, salts = self.trees[length + 1]
            for leaf, at in tree.reach(counts, 0):
                for cell in range(first[leaf], first[leaf] + salts[leaf]):
                    yield rows[at], np.full(len(at), length + 1), np.full(len(at), cell), 2

    @staticmethod
    def _homes(tree: Tree, counts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        todo = [(0, np.arange(len(counts)))]
        while todo:
            node, rows = todo.pop()
            if tree.letter[node] < 0:
                yield tree.left[node], rows
                continue
            low = counts[rows, tree.letter[node]] <= tree.upto[node]
            todo += [(tree.left[node], rows[low]), (tree.right[node], rows[~low])]


def one_replaced(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return (one != two).sum(axis=1) == 1


def one_inserted(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Equal letters from the front and, one place on, from the back cover the shorter word."""
    size = short.shape[1]
    front, back = short != long[:, :-1], (short != long[:, 1:])[:, ::-1]
    front = np.where(front.any(axis=1), front.argmax(axis=1), size)
    return front + np.where(back.any(axis=1), back.argmax(axis=1), size) >= size


def near_pairs(points: Points, role: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (visitor, resident) of near words of one cell; pairs of residents come once."""
    size = np.diff(points.first)
    residents = np.flatnonzero(role == 0)
    tree = Tree.over(points.counts[residents], LEAF)
    found = [np.empty((2, 0), np.int64)]
    for down, visitors in ((1, np.flatnonzero(role < 2)), (0, np.flatnonzero(role == 2))):
        for low in range(0, len(visitors), QUERIES):
            asking = visitors[low : low + QUERIES]
            for leaf, at in tree.reach(points.counts[asking], down):
                here, there = asking[at], residents[tree.leaves[leaf]]
                apart = np.bitwise_count(points.odd[0][here][:, None] ^ points.odd[0][there])
                apart += np.bitwise_count(points.odd[1][here][:, None] ^ points.odd[1][there])
                row, column = np.nonzero(apart == 1 + down)
                one, two = here[row], there[column]
                if down:  # of two residents the first one asks
                    kept = (role[one] == 1) | (one < two)
                    one, two = one[kept], two[kept]
                if len(one):
                    a, b = points.letters(one, int(size[one[0]])), points.letters(two, int(size[two[0]]))
                    good = one_replaced(a, b) if down else one_inserted(a, b)
                    found.append(np.stack([one[good], two[good]]))
    one, two = np.concatenate(found, axis=1)
    return one, two


def near_words(words: DataFrame, sample: int = SAMPLE, cell: int = CELL) -> DataFrame:
    """(word, n, n_near, best): all words, how many are near, and the nearest of largest n as (n, word)."""
    total = words.count()
    chosen = sample_rows(words.filter(F.length("word") <= LONG).select("word"), F.col("word"), sample).toArrow()
    cells = words.sparkSession.sparkContext.broadcast(Cells.over(chosen.column("word").combine_chunks(), total, cell))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "word", 1 << 18):
                for rows, length, cell, role in cells.value.visits(Points.of(part.column("word"))):
                    if len(rows):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(length, pa.int32()), pa.array(cell, pa.int32()), pa.array(np.full(len(rows), role), pa.int8()),
                             *(part.column(c).take(pa.array(rows)) for c in ("word", "n"))], ["length", "cell", "role", "word", "n"])

    def meet(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        role, n = part.column("role").to_numpy(), part.column("n").to_numpy()
        words = part.column("word").combine_chunks() if part.num_rows else pa.array([], pa.string())
        one, two = near_pairs(Points.of(words), role)
        word, near = np.r_[one, two], np.r_[two, one]
        members, at = np.unique(near, return_inverse=True)  # ties go by the words' order
        place = np.empty(len(members), np.int64)
        place[np.argsort(np.array(words.take(pa.array(members)).cast(pa.binary()).to_pylist(), object), kind="stable")] = np.arange(len(members))
        order = np.lexsort((place[at], -n[near], word))
        word, near = word[order], near[order]
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.empty(0, np.int64)
        count = np.diff(np.r_[first, len(word)])
        return pa.table({"word": words.take(pa.array(word[first])), "n_near": pa.array(count, pa.int64()),
                         "near_n": pa.array(n[near[first]], pa.int64()), "near": words.take(pa.array(near[first]))})

    met = (words.mapInArrow(visit, "length int, cell int, role byte, word string, n long").groupBy("length", "cell")
           .applyInArrow(meet, "word string, n_near long, near_n long, near string"))
    rows = met.select("word", F.lit(None).cast("long").alias("n"), "n_near",
                      F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")).alias("best"))
    plain = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast(rows.schema["best"].dataType).alias("best"))
    return (plain.unionAll(rows).groupBy("word")
            .agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): from each word follow the forms (word, form) to the last. Every round doubles the steps taken; a form
    occurs ``RATIO`` times as often as its word, so there are few."""
    now = stage(forms.select("word", F.col("form").alias("root")))
    while True:
        other = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = stage(now.join(other, "root", "left").select("word", F.coalesce("further", "root").alias("root"),
                                                             F.col("further").isNotNull().alias("moved")))
        if not after.filter("moved").limit(1).count():
            return after.select("word", "root")
        now = after.select("word", "root")


def variants(docs: DataFrame, sample: int = SAMPLE, cell: int = CELL) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the documents."""
    near = near_words(stage(occurring(docs)), sample, cell)
    often = -F.col("best.less") >= RATIO * F.col("n")
    told = stage(near.select("word", "n", "n_near", F.when(often, F.col("best.near")).alias("form"),
                             F.when(often, -F.col("best.less")).alias("form_n")))
    last = roots(told.filter("form IS NOT NULL"))
    return (told.join(last, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


_STEP = f"xor(a >> 8, [{', '.join(str(x) for x in CRC)}][(xor(a, b) & 255) + 1])"
_PLACES = "unnest(range(1, len(word) + 1)) AS k"
SQL = f"""
WITH runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
lower AS (SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
          FROM runs WHERE len(run) >= {LETTERS} GROUP BY ALL),
bytes AS (SELECT run, n, hex(encode(id || ':' || run)) AS code FROM lower),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(code), 2),
               lambda i: ('0x' || substr(code, i, 2))::BIGINT)), lambda a, b: {_STEP}), 4294967295) AS h FROM bytes),
kept AS (SELECT CASE WHEN h % {LOST} <> 0 THEN run ELSE substr(run, 1, h % len(run)) || substr(run, h % len(run) + 2) END AS word, n
         FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM kept WHERE len(word) >= {LETTERS} GROUP BY word HAVING sum(n) >= {OCCURRENCES}),
less AS (SELECT DISTINCT word, n, substr(word, 1, k - 1) || substr(word, k + 1) AS part FROM (SELECT word, n, {_PLACES} FROM words)),
holes AS (SELECT word, n, substr(word, 1, k - 1) || '_' || substr(word, k + 1) AS part FROM (SELECT word, n, {_PLACES} FROM words)),
near AS (SELECT a.word, b.word AS other, b.n AS m FROM less a JOIN words b ON a.part = b.word
         UNION ALL SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.part = b.word
         UNION ALL SELECT a.word, b.word, b.n FROM holes a JOIN holes b ON a.part = b.part AND a.word <> b.word),
best AS (SELECT word, count(*) AS n_near, max(m) AS m FROM near GROUP BY word),
form AS (SELECT near.word, best.n_near, best.m, min(other) AS other FROM near JOIN best ON near.word = best.word AND near.m = best.m
         GROUP BY ALL),
told AS (SELECT w.word, w.n, coalesce(f.n_near, 0)::BIGINT AS n_near, CASE WHEN f.m >= {RATIO} * w.n THEN f.other END AS form,
                CASE WHEN f.m >= {RATIO} * w.n THEN f.m END AS form_n FROM words w LEFT JOIN form f ON w.word = f.word),
chain AS (WITH RECURSIVE c AS (SELECT word, word AS root FROM told
                               UNION ALL SELECT c.word, t.form FROM c JOIN told t ON c.root = t.word WHERE t.form IS NOT NULL)
          SELECT c.word, c.root FROM c JOIN told t ON c.root = t.word WHERE t.form IS NULL)
SELECT told.word, form, root, n, n_near, form_n FROM told JOIN chain ON told.word = chain.word
"""
