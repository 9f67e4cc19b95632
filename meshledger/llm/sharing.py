"""Documents that share a key, found in one shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshledger.llm.textarrays import slices

#: Keys combined at once within a task.
COMBINED = 1 << 21
#: Rows of an Arrow batch that goes back: it lies in the worker and in the executor at once.
ROWS = 1 << 16


def sharing(docs: DataFrame, keys_of: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]],
            size: int = 4 << 20, limit: int = COMBINED) -> DataFrame:
    """(signature, doc, leader): the documents of every key that two documents or more have. ``keys_of`` gives
    (text, key) rows of a column of texts, about ``size`` bytes at a time; ``limit`` keys are combined at once.

    The leader is the smallest document a task has seen with the key, or, for such leaders, the smallest of all: a
    task keeps the others to itself, so a key has one row for each task in the shuffle, however hot it is."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, found, held = [], [], 0

        def combined() -> Iterator[pa.RecordBatch]:
            doc, signature = np.concatenate(docs), np.concatenate(found)
            order = np.lexsort((doc, signature))
            doc, signature = doc[order], signature[order]
            first = np.r_[True, signature[1:] != signature[:-1]]
            new = first.copy()
            new[1:] |= doc[1:] != doc[:-1]
            doc, signature, first = doc[new], signature[new], first[new]
            start = np.flatnonzero(first)
            count = np.diff(np.r_[start, len(doc)])
            leader = np.repeat(doc[start], count)
            rows = np.r_[start, np.flatnonzero(np.repeat(count > 1, count))]
            for at in range(0, len(rows), ROWS):
                some = rows[at : at + ROWS]
                whole = np.arange(at, at + len(some)) < len(start)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signature[some].view(np.int64)), pa.array(doc[some]), pa.array(leader[some], mask=whole)],
                    ["signature", "doc", "leader"])

        for batch in batches:
            for part in slices(batch, "text", size):
                home, signature = keys_of(part.column("text"))
                docs.append(part.column("doc_id").to_numpy()[home])
                found.append(signature)
                held += len(signature)
                if held >= limit:
                    yield from combined()
                    docs, found, held = [], [], 0
        if held:
            yield from combined()

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sorted by signature and document: a group's first row is its leader, which is known before the others.
        before, leader, told = None, None, False
        for batch in batches:
            local = batch.column("leader")
            done = local.is_valid().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(done)) for i in range(3)],
                                             ["signature", "doc", "leader"])
            signature, doc = batch.column("signature").to_numpy()[~done], batch.column("doc").to_numpy()[~done]
            if not len(doc):
                continue
            first = np.r_[signature[0] != before, signature[1:] != signature[:-1]]
            group = np.cumsum(first)
            heads = np.r_[-1 if leader is None else leader, doc[first]]
            follows = ~first & (doc != heads[group])
            wanted = follows.copy()
            last_of = np.flatnonzero(first)
            grown = np.bincount(group[follows], minlength=group[-1] + 1) > 0
            wanted[last_of] = grown[group[last_of]]
            sig, d, l = signature[wanted], doc[wanted], heads[group][wanted]
            if grown[0] and not told:  # the group began in an earlier batch
                sig, d, l = np.r_[before, sig], np.r_[leader, d], np.r_[leader, l]
                told = True
            yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(d), pa.array(l)], ["signature", "doc", "leader"])
            if first.any():
                told = bool(grown[group[-1]])
            before, leader = signature[-1], heads[group[-1]]

    rows = docs.select("doc_id", "text").mapInArrow(sign, "signature long, doc long, leader long")
    by = F.when(F.col("leader").isNull(), F.col("signature")).otherwise(F.xxhash64("doc"))
    return (rows.repartition(by).sortWithinPartitions("signature", "doc")
            .mapInArrow(lead, "signature long, doc long, leader long"))
