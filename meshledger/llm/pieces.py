"""A public piece vocabulary as byte strings, and its look-up for blocks of words."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from meshledger.llm.textarrays import stream

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22


def read_pieces(path: str = VOCABULARY) -> list[bytes]:
    """Byte string of every id, word mark as a blank; control pieces are empty, byte pieces their byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            out.append(bytes([int(piece[3:-1], 16)]))
        else:
            out.append(b"" if model.is_control(i) or model.is_unknown(i) else piece.replace(MARK, " ").encode())
    return out


@dataclass
class Lookup:
    """Number of a byte string: sorted hashes behind a bit table."""

    letter: np.ndarray
    table: np.ndarray
    number: np.ndarray
    seen: np.ndarray
    longest: int

    @staticmethod
    def of(strings: list[bytes]) -> Lookup:
        letter = stream(3, 256)
        with np.errstate(over="ignore"):
            value = np.zeros(len(strings), np.uint64)
            for i, text in enumerate(strings):
                h = np.uint64(0)
                for c in text:
                    h = h * _STEP + letter[c]
                value[i] = h
        order = np.argsort(value, kind="stable")
        seen = np.zeros(1 << _BITS, bool)
        seen[value >> np.uint64(64 - _BITS)] = True
        return Lookup(letter, value[order], order, seen, max(map(len, strings), default=1))

    def matches(self, words: np.ndarray, length: np.ndarray):
        """Words as a byte matrix (a row each, longest first). Yields, starts ascending, (start, end, rows,
        numbers) of all strings of the table that occur there."""
        shorter = -length
        for start in range(words.shape[1]):
            value = None
            for end in range(start + 1, min(words.shape[1], start + self.longest) + 1):
                rows = int(np.searchsorted(shorter, -end, "right"))
                if not rows:
                    break
                code = self.letter[words[:rows, end - 1]]
                value = code if value is None else value[:rows] * _STEP + code
                maybe = np.flatnonzero(self.seen[value >> np.uint64(64 - _BITS)])
                if not len(maybe):
                    continue
                at = np.minimum(np.searchsorted(self.table, value[maybe]), len(self.table) - 1)
                hit = self.table[at] == value[maybe]
                if hit.any():
                    yield start, end, maybe[hit], self.number[at[hit]]


def blocks(data: np.ndarray, start: np.ndarray, end: np.ndarray, cells: int = 1 << 20):
    """Words, longest first, as blank-led byte matrices of about ``cells`` bytes: (places, matrix, lengths)."""
    length = end - start + 1
    order = np.argsort(-length, kind="stable")
    i = 0
    while i < len(order):
        width = int(length[order[i]])
        rows = order[i : i + max(1, cells // width)]
        size = length[rows]
        matrix = np.zeros((len(rows), width), np.uint8)
        matrix[:, 0] = 32
        row = np.repeat(np.arange(len(rows)), size - 1)
        column = np.arange(len(row)) - np.repeat(np.cumsum(size - 1) - (size - 1), size - 1)
        matrix[row, column + 1] = data[np.repeat(start[rows], size - 1) + column]
        yield rows, matrix, size
        i += len(rows)
