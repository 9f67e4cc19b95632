"""Small tables with every odd case, and plain re-statements of what the operators compute."""

from __future__ import annotations

import math
import os
import random
import zlib
from collections import Counter

BASE = "/root/testdata/sf0.001"
#: Extra columns whose names the operators use inside.
EXTRA = ("spans", "tokens", "signature", "component", "node", "marks", "place", "held_out", "score", "ids", "host")


def words(text: str | None, lower: bool = False) -> list[bytes]:
    raw = (text or "").encode()
    return (raw.lower() if lower else raw).split()


def crc(doc_id: int | None, modulus: int) -> int | None:
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % modulus


def odd_documents(vocabulary: list[str]) -> list[tuple]:
    """(doc_id, text, lang): nulls, blanks, long texts, copies, near copies, repeated rows, rows without id."""
    pick = random.Random(5)
    long = " ".join(pick.choice(vocabulary) for _ in range(20_000))
    base = [pick.choice(vocabulary) for _ in range(120)]
    near = base[:60] + ["changed"] + base[61:]
    passage = " ".join(pick.choice(vocabulary) for _ in range(13))
    own = ["o%d" % i for i in range(40)]
    return [
        (1000, None, "en"), (1001, "", "en"), (1002, " \n\t \x0b\x0c\r", None), (1003, long, "en"),
        (1004, "y" * 30_000, "en"), (1005, " ".join(base), "de"), (1006, " ".join(base), None),
        (1007, " ".join(near), "de"), (1008, " ".join(base).upper(), "de"), (1009, "Two  words", "en"),
        (1010, "two words", "en"), (1011, "one", "fr"), (1012, "1234 !!! 99", "fr"),
        (1013, " ".join(own[:9]) + "  " + passage + "\n" + " ".join(own[9:20]), "en"),
        (1014, " ".join(own[20:30]) + " " + passage + " " + " ".join(own[30:]), "en"),
        (1015, " ".join(["again"] * 500), "en"), (1016, " ".join(["again"] * 400), "en"),
        (1017, "日本語 テキスト été   ▁mark é́ 🙂", "fr"),
        (1018, "a b c d e f g h i j k l m", "en"), (1018, "a b c d e f g h i j k l m", "en"),
        (1019, "a b c d e f g h i j k l m", "en"), (None, "a b c d e f g h i j k l m", "en"),
        (None, None, None), (-5, " ".join(near), "de"),
    ]


def odd_folder(spark, folder, rows: int | None = None) -> tuple[str, list[tuple]]:
    """Folder of tables: given rows and odd ones, extra columns everywhere. Rows (doc_id, text, lang)."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    given = pq.read_table(f"{BASE}/documents.parquet", columns=["doc_id", "text", "lang"]).to_pylist()[:rows]
    vocabulary = sorted({w for row in given for w in row["text"].split()})
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in given] + odd_documents(vocabulary)
    table = {"doc_id": pa.array([d[0] for d in docs], pa.int64()), "text": pa.array([d[1] for d in docs], pa.string()),
             "lang": pa.array([d[2] for d in docs], pa.string()), "source": pa.array(["s"] * len(docs)),
             "n_chars": pa.array([len(d[1] or "") for d in docs], pa.int64())}
    pq.write_table(pa.table(table | {name: pa.array(["odd"] * len(docs)) for name in EXTRA}), f"{folder}/documents.parquet")
    for name, add in (("benchmark", {"item_id": [None, 900, 901], "text": ["a b c d e f g h i", None, "short one"]}),
                      ("labels", {"doc_id": [None, 1003, 1003], "quality": [1, None, 1], "toxic": [0, None, 0]})):
        have = pq.read_table(f"{BASE}/{name}.parquet")
        more = pa.table({c: pa.array(add[c], have.schema.field(c).type) for c in have.column_names})
        both = pa.concat_tables([have, more, more])
        pq.write_table(pa.table({c: both[c] for c in both.column_names} | {n: pa.array(["odd"] * len(both)) for n in EXTRA}),
                       f"{folder}/{name}.parquet")
    return str(folder), docs


def empty_folder(folder) -> str:
    """The tables without a row."""
    import pyarrow.parquet as pq

    for name in ("documents", "benchmark", "labels", "pages", "embeddings"):
        pq.write_table(pq.read_table(f"{BASE}/{name}.parquet").slice(0, 0), os.path.join(folder, f"{name}.parquet"))
    return str(folder)


def shingles(text: str | None) -> set:
    w = words(text, lower=True)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(docs: list[tuple]) -> tuple[dict, list]:
    """Component of each id, and the set size of each row."""
    sets = [(d[0], shingles(d[1])) for d in docs]
    root = {d: d for d, _ in sets if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    inverted: dict = {}
    for at, (doc, one) in enumerate(sets):
        if doc is None:
            continue
        shared = Counter(other for s in one for other in inverted.get(s, ()))
        for other, n in shared.items():
            if 100 * n >= 80 * (len(one) + len(sets[other][1]) - n):
                a, b = find(doc), find(sets[other][0])
                root[max(a, b)] = min(a, b)
        for s in one:
            inverted.setdefault(s, []).append(at)
    return {d: find(d) for d in root}, [(d, len(s)) for d, s in sets]


def brute_kept(docs: list[tuple], size: int = 13) -> list[tuple]:
    """(doc_id, words, kept words) of each row after substring deduplication."""
    first: dict = {}
    for doc, text, *_ in docs:
        w = words(text)
        if doc is not None:
            for i in range(len(w) - size + 1):
                key = tuple(w[i : i + size])
                first[key] = min(doc, first.get(key, doc))
    out = []
    for doc, text, *_ in docs:
        w = words(text)
        lost = set()
        for i in range(len(w) - size + 1):
            if doc is not None and first[tuple(w[i : i + size])] < doc:
                lost.update(range(i, i + size))
        out.append((doc, w, [x for i, x in enumerate(w) if i not in lost]))
    return out


def brute_model(docs: list[tuple]):
    """Scores of an interpolated modified Kneser-Ney bigram model by counting in dictionaries."""
    text = [(d[0], [b"<s>", *words(d[1], lower=True), b"</s>"]) for d in docs]
    held = [d is None or crc(d, 10) == 0 for d, _ in text]
    pair, word = Counter(), Counter()
    for (_, t), out in zip(text, held):
        if not out:
            pair.update(zip(t, t[1:]))
            word.update(t[1:])
    n, v = sum(word.values()), len(word)

    def discount(counts):
        n1, n2, n3, n4 = (sum(1 for c in counts if c == k) for k in (1, 2, 3, 4))
        if not n1 or not n2:
            return [0, 0.5, 0.5, 0.5]
        y = n1 / (n1 + 2 * n2)
        d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.5]
        return [0, *(x if 0 < x <= k + 1 else 0.5 for k, x in enumerate(d))]

    follows = Counter(w for _, w in pair)
    high, low = discount(pair.values()), discount(follows.values())
    total, gamma = Counter(), Counter()
    for (a, _), c in pair.items():
        total[a] += c
        gamma[a] += high[min(c, 3)]
    types = len(pair)
    spread = sum(low[min(c, 3)] for c in follows.values()) / types if types else 1

    def p(a, b):
        c = follows[b]
        q = max(c - low[min(c, 3)], 0) / max(types, 1) + spread / (v + 1)
        return max(pair[a, b] - high[min(pair[a, b], 3)], 0) / total[a] + gamma[a] / total[a] * q if total[a] else q

    return [(d, out, len(t) - 1, sum(word[w] > 0 for w in t[1:]), n,
             sum(math.log10((word[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t[1:]),
             sum(math.log10(p(a, b)) for a, b in zip(t, t[1:]))) for (d, t), out in zip(text, held)]
