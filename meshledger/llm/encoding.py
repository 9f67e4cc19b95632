"""SentencePiece encoding and decoding by suffix-array matching.

The distinct stretches of a batch (blanks and what follows them up to the next blank; no piece crosses these) are
concatenated and their suffixes sorted as deep as the longest piece goes. Binary search gives every piece of the
vocabulary its range of occurrences, which become edges from start to end of the piece. Edges are sorted by the
position they end at and relaxed in that order. The vocabulary is a merge vocabulary, so a path may be extended by
an edge only if merging would have kept the two pieces apart; exactly one edge into each position passes, and the
path is the encoding the merges would have made. Characters without a piece are edges of their bytes.

The mergeable pieces of several blanks all have one score, so order decides between them; stretches that begin with two
blanks or more are therefore merged plainly.

Defined results: null and empty texts have no pieces; U+2581 counts as a blank, as the vocabulary has it; decoding gives
back every other text byte for byte. Repeated rows are encoded alike; texts of any length are encoded whole. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshledger.llm.pieces import MARK, VOCABULARY
from meshledger.llm.shared import table
from meshledger.llm.textarrays import Words, slices, string_buffer

#: Distinct stretches and their pieces a task remembers.
REMEMBERED = 400_000
#: Bytes of new stretches encoded at once.
BLOCK = 128 << 10
OTHER = -2  # an edge over a character without a piece


@dataclass
class Model:
    strings: list[bytes]
    number: dict[bytes, int]
    rank: dict[int, int]
    left: dict[int, int]
    right: dict[int, int]
    byte: np.ndarray
    longest: int

    @staticmethod
    def read(path: str = VOCABULARY) -> Model:
        import sentencepiece

        source = sentencepiece.SentencePieceProcessor(model_file=path)
        strings, byte = [], np.zeros(256, np.int64)
        for i in range(source.get_piece_size()):
            piece = source.id_to_piece(i)
            if source.is_byte(i):
                byte[int(piece[3:-1], 16)] = i
                strings.append(bytes([int(piece[3:-1], 16)]))
            else:
                strings.append(b"" if source.is_control(i) or source.is_unknown(i) else piece.replace(MARK, " ").encode())
        plain = [i for i in range(len(strings)) if strings[i] and not source.is_byte(i)]
        number = {strings[i]: i for i in plain}
        order = sorted({-source.get_score(i) for i in plain})
        place = {score: at for at, score in enumerate(order)}
        model = Model(strings, number, {i: place[-source.get_score(i)] for i in plain}, {}, {}, byte,
                      max(len(strings[i]) for i in plain))
        for i in plain:
            if len(strings[i].decode()) > 1:
                pieces, last = model.merge(strings[i].decode())
                if len(pieces) == 1:
                    model.left[i], model.right[i] = last
        return model

    def usable(self, i: int) -> bool:
        """Single characters, and pieces that merging their own text gives."""
        return i in self.left or len(self.strings[i].decode()) == 1

    def merge(self, text: str) -> tuple[list[int | bytes], tuple[int, int] | None]:
        """Pieces (or bytes of a character without a piece) by merging plainly, and the last merge."""
        part = [self.number.get(c.encode(), c.encode()) for c in text]
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if 0 <= i and j < len(part) and isinstance(part[i], int) and isinstance(part[j], int):
                made = self.number.get(self.strings[part[i]] + self.strings[part[j]])
                if made is not None:
                    heapq.heappush(heap, (self.rank[made], i, made, part[i], part[j]))

        for i in range(len(part) - 1):
            offer(i, i + 1)
        gone, last = [False] * len(part), None
        while heap:
            _, i, made, one, two = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= len(part) or part[i] != one or part[j] != two:
                continue
            part[i], gone[j], after[i], last = made, True, after[j], (one, two)
            if after[i] < len(part):
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p, lost in zip(part, gone) if not lost], last

    def apart(self, one: int, two: int) -> bool:
        """Whether merging keeps two pieces apart: undo the later merge of the two, step by step, and see that no
        merge across their border would have come first."""
        until = 1 << 60
        while True:
            made = self.number.get(self.strings[one] + self.strings[two])
            if made is not None and self.rank[made] < until:
                return False
            first = self.rank[one] if one in self.left else -1
            second = self.rank[two] if two in self.left else -1
            if first < 0 and second < 0:
                return True
            if first > second:
                until, one = first, self.right[one]
            else:
                until, two = second + 1, self.left[two]


class Encoder:
    """Encodes distinct stretches; remembers pairs of pieces and, up to a bound, stretches."""

    def __init__(self, model: Model):
        self.model = model
        usable = [i for i in model.number.values() if model.usable(i)]
        self.piece = np.array(usable)
        self.low = np.array([model.strings[i] for i in usable], f"S{model.longest}")
        self.high = np.array([model.strings[i].ljust(model.longest, b"\xff") for i in usable], f"S{model.longest}")
        self.size = np.array([len(model.strings[i]) for i in usable])
        self.pair, self.fits = np.empty(0, np.int64), np.empty(0, bool)
        self.known, self.flat, self.start = np.empty(0, np.uint64), np.empty(0, np.int32), np.zeros(1, np.int64)

    def _apart(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        out = np.ones(len(one), bool)
        ask = np.flatnonzero((one >= 0) & (two >= 0))
        key, which = np.unique(one[ask] << 20 | two[ask], return_inverse=True)
        at = np.minimum(np.searchsorted(self.pair, key), max(0, len(self.pair) - 1))
        new = self.pair[at] != key if len(self.pair) else np.ones(len(key), bool)
        if new.any():
            fresh = [self.model.apart(k >> 20, k & 0xFFFFF) for k in key[new].tolist()]
            pair = np.r_[self.pair, key[new]]
            order = np.argsort(pair, kind="stable")
            self.pair, self.fits = pair[order], np.r_[self.fits, fresh][order]
            at = np.searchsorted(self.pair, key)
        out[ask] = self.fits[at][which]
        return out

    def edges(self, data: np.ndarray, first: np.ndarray):
        """Sorted by place of the end: (stretch, start, end, piece), places within the stretch. ``first`` has the
        borders of the stretches in ``data``."""
        stretch = np.repeat(np.arange(len(first) - 1), np.diff(first))
        suffix = np.flatnonzero((data & 0xC0) != 0x80)
        # A view over the padded bytes: only the keys themselves are copied, without an index for each byte.
        longest = self.model.longest
        key = np.lib.stride_tricks.sliding_window_view(np.r_[data, np.zeros(longest, np.uint8)], longest)[suffix]
        left = np.minimum(first[stretch[suffix] + 1] - suffix, longest).astype(np.uint8)
        key *= np.arange(longest, dtype=np.uint8) < left[:, None]
        key = key.view(f"S{longest}").ravel()
        order = np.argsort(key)
        key, suffix_array = key[order], suffix[order]
        low, high = np.searchsorted(key, self.low, "left"), np.searchsorted(key, self.high, "right")
        count = high - low
        place = suffix_array[np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())]
        piece, size = np.repeat(self.piece, count), np.repeat(self.size, count)
        # A character no piece covers alone is an edge of its own.
        width = np.diff(np.r_[suffix, len(data)])
        single = np.zeros(len(data), bool)
        single[place[size == width[np.searchsorted(suffix, place)]]] = True
        lone = ~single[suffix]
        place = np.r_[place, suffix[lone]]
        size = np.r_[size, width[lone]]
        piece = np.r_[piece, np.full(lone.sum(), OTHER)]
        home = stretch[place]
        start = place - first[home]
        order = np.argsort(start + size, kind="stable")
        return home[order], start[order], (start + size)[order], piece[order]

    def encode(self, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all stretches, one after another, and the borders."""
        home, start, end, piece = self.edges(data, first)
        last, origin = np.full(len(data) + len(first), -1), np.zeros(len(data) + len(first), np.int64)
        base = first[:-1] + np.arange(len(first) - 1)  # a place more than bytes in every stretch
        cut = np.flatnonzero(np.diff(end)) + 1
        for i, j in zip(np.r_[0, cut], np.r_[cut, len(end)]):
            one = last[base[home[i:j]] + start[i:j]]
            fits = (start[i:j] == 0) | ((one != -1) & self._apart(one, piece[i:j]))
            at = base[home[i:j]] + end[i:j]
            last[at[fits]], origin[at[fits]] = piece[i:j][fits], start[i:j][fits]
        # Walk all paths back at once.
        rows, place = np.arange(len(first) - 1), np.diff(first)
        found = []
        while len(rows):
            at = base[rows] + place
            found.append((rows, origin[at], place, last[at]))
            rows, place = rows[origin[at] > 0], origin[at][origin[at] > 0]
        if not found:
            return np.empty(0, np.int32), np.zeros(len(first), np.int64)
        rows, begin, stop, piece = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((begin, rows))
        rows, begin, stop, piece = rows[order], begin[order], stop[order], piece[order]
        times = np.where(piece == OTHER, stop - begin, 1)
        within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        source = np.repeat(first[rows] + begin, times) + within
        ids = np.where(np.repeat(piece == OTHER, times), self.model.byte[data[source]], np.repeat(piece, times))
        total = np.bincount(rows, times, len(first) - 1).astype(np.int64)
        return ids.astype(np.int32), np.r_[0, np.cumsum(total)]

    def in_blocks(self, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``encode``, about ``BLOCK`` bytes of stretches at a time: its arrays are many times the bytes."""
        block = first[:-1] // BLOCK
        edges = np.r_[0, np.flatnonzero(np.diff(block)) + 1, len(block)] if len(block) else [0, 0]
        ids, count = [], []
        for i, j in zip(edges[:-1], edges[1:]):
            part, border = self.encode(data[first[i] : first[j]], first[i : j + 1] - first[i])
            ids.append(part)
            count.append(np.diff(border))
        return np.concatenate(ids), np.r_[0, np.cumsum(np.concatenate(count))]

    def of(self, words: Words, at: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces and borders of the stretches ``at``, distinct and in ascending order of hash."""
        where = np.minimum(np.searchsorted(self.known, hashes), max(0, len(self.known) - 1))
        seen = self.known[where] == hashes if len(self.known) else np.zeros(len(hashes), bool)
        new = at[~seen]
        if len(new):
            size = words.end[new] - words.start[new]
            first = np.r_[0, np.cumsum(size)]
            data = words.data[np.repeat(words.start[new] - first[:-1], size) + np.arange(first[-1])]
            many = np.flatnonzero((size > 1) & (data[first[:-1]] == 32) & (data[np.minimum(first[:-1] + 1, len(data) - 1)] == 32))
            ids, border = self.in_blocks(data, first)
            if len(many):
                parts = [ids[i:j] for i, j in zip(border[:-1], border[1:])]
                for i in many.tolist():
                    merged = self.model.merge(data[first[i] : first[i + 1]].tobytes().decode())[0]
                    parts[i] = np.array([x for p in merged for x in ([p] if isinstance(p, int) else self.model.byte[list(p)])],
                                        np.int32)
                ids, border = np.concatenate(parts), np.r_[0, np.cumsum([len(p) for p in parts])]
            old = len(self.known) if len(self.known) + len(new) <= REMEMBERED or seen.any() else 0
            known = np.r_[self.known[:old], hashes[~seen]]
            flat = np.r_[self.flat[: self.start[old]], ids]
            border = np.r_[self.start[:old], self.start[old] + border]
            order = np.argsort(known, kind="stable")
            self.known = known[order]
            count = np.diff(border)[order]
            self.start = np.r_[0, np.cumsum(count)]
            self.flat = flat[np.repeat(border[:-1][order] - self.start[:-1], count) + np.arange(self.start[-1])]
            where = np.searchsorted(self.known, hashes)
        count = self.start[where + 1] - self.start[where]
        border = np.r_[0, np.cumsum(count)]
        ids = self.flat[np.repeat(self.start[where] - border[:-1], count) + np.arange(border[-1])]
        if len(self.known) > 2 * REMEMBERED:
            self.known, self.flat, self.start = np.empty(0, np.uint64), np.empty(0, np.int32), np.zeros(1, np.int64)
        return ids, border


def stretches(text: pa.Array) -> Words:
    """Blanks and what follows them, of texts led by one blank more."""
    text = pc.replace_substring(text.fill_null(""), MARK, " ")
    led = pc.if_else(pc.equal(pc.binary_length(text), 0), "", pc.binary_join_element_wise("", text, " "))
    data, offsets = string_buffer(led)
    blank = data == 32
    begin = blank.copy()
    begin[1:] &= ~blank[:-1]
    begin[offsets[:-1][offsets[:-1] < len(data)]] = True
    start = np.flatnonzero(begin)
    return Words(data, start, np.r_[start[1:], len(data)][: len(start)], np.searchsorted(start, offsets))


def encode_texts(text: pa.Array, encoder: Encoder) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after another, and the borders of the texts."""
    words = stretches(text)
    if not len(words.start):
        return np.empty(0, np.int32), np.zeros(len(words.first), np.int64)
    distinct, at, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
    ids, border = encoder.of(words, at, distinct)
    count = np.diff(border)[which]
    through = np.r_[0, np.cumsum(count)]
    return ids[np.repeat(border[:-1][which] - through[:-1], count) + np.arange(through[-1])], through[words.first]


def decode_ids(ids: np.ndarray, border: np.ndarray, strings: list[bytes]) -> pa.Array:
    """Texts of the ids between the borders."""
    size = np.array([len(s) for s in strings])
    source = np.frombuffer(b"".join(strings), np.uint8)
    begin = np.cumsum(size) - size
    count = size[ids]
    through = np.r_[0, np.cumsum(count)]
    data = source[np.repeat(begin[ids] - through[:-1], count) + np.arange(through[-1])]
    offsets = through[border]
    keep = np.ones(len(data), bool)
    keep[offsets[:-1][np.diff(offsets) > 0]] = False  # the blank that leads a text
    offsets = np.r_[0, np.cumsum(keep)][offsets]
    return pa.LargeStringArray.from_buffers(len(border) - 1, pa.py_buffer(offsets.astype(np.int64)),
                                            pa.py_buffer(data[keep].tobytes()))


def encode(docs: DataFrame, keep: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """Columns ``keep`` of every row with ``ids``, and ``restored``: decoding gives the text again."""
    model = docs.sparkSession.sparkContext.broadcast(Model.read(vocabulary))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model.value)
        for batch in batches:
            for part in slices(batch, "__text", 2 << 20):
                text = part.column("__text")
                ids, border = encode_texts(text, encoder)
                again = decode_ids(ids, border, model.value.strings)
                same = pc.equal(again, pc.replace_substring(text.fill_null(""), MARK, " ").cast(pa.large_string()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(len(keep))]
                    + [pa.ListArray.from_arrays(pa.array(border, pa.int32()), pa.array(ids)), same],
                    [*keep, "ids", "restored"])

    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, f"{fields}, ids array<int>, restored boolean")


def decode(encoded: DataFrame, keep: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """Columns ``keep`` of every row with the ``text`` of its ``ids`` (null: empty)."""
    strings = encoded.sparkSession.sparkContext.broadcast(Model.read(vocabulary).strings)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("__ids")
            count = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
            text = decode_ids(ids.flatten().to_numpy(), np.r_[0, np.cumsum(count)].astype(np.int64), strings.value)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [text.cast(pa.string())],
                                             [*keep, "text"])

    return encoded.select(*keep, F.col("ids").alias("__ids")).mapInArrow(run, f"{fields}, text string")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), ["doc_id"]).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "restored")
