"""Brute-force versions that the operators are compared with, and rows with every odd case."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
NAME = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LAST = 2**63 - 1
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
# names that the operators use themselves, or return
CLASHING = ["score", "words", "size", "items", "_row", "_key", "_text", "_drops", "label", "a", "b", "component_id"]

PROSE = (
    "the river ran past the old mill and the children sat on the wall to watch the boats go by while "
    "their mother read letters from the sea and the dog slept in the shade of one tall elm near a gate "
    "that nobody had opened since the long war ended and all the men came home again in autumn rain"
)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(text or "")


def names(text):
    return NAME.findall(lower(text))


def odd_rows():
    """Null, empty, blank, one-word, repeated and very long texts; null and repeated ids; null sources."""
    long = " ".join(f"w{i * i % 977}" for i in range(30_000))
    texts = [
        (0, PROSE), (1, PROSE + " end"), (1, PROSE + " end"), (2, None), (3, ""), (4, " \n\t\x0b\x0c\r "), (5, "word"),
        (6, "one two"), (7, long), (8, long + " tail"), (None, PROSE), (None, None), (None, "alone here"),
        (9, "same same same same " * 40), (9, "other text for the id that is there already"), (10, "é ñ ß 漢字 🙂 é"),
        (11, "a\n" * 50), (12, "\n\nA b c d\n\nA b c d\n"), (13, "#*$ % & | <> text"), (14, "Ünïcode stays one"),
    ]
    return [
        (d, t, None if i % 4 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}", None if i % 3 == 0 else len(t or ""))
        for i, (d, t) in enumerate(texts)
    ]


def odd_frame(spark, clashing=True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows(), COLUMNS).repartition(3)
    for i, name in enumerate(CLASHING if clashing else []):
        df = df.withColumn(name, F.lit(None).cast("string") if i % 2 else F.lit(f"x{i}"))
    return df


def odd_labels(spark):
    rows = [(0, 1, 0), (1, 0, 1), (1, 1, None), (5, 0, 1), (6, None, 0), (7, 1, 0), (8, 1, 0), (None, 1, 1), (9, 0, 1),
            (11, 0, 0), (12, 1, 1), (99, 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    return df.selectExpr("*", "'x' AS text", "1 AS label", "0.5D AS score")


def repeats(docs, w=13):
    first, out = {}, []
    for d, t in docs:
        ws, d = words(t), LAST if d is None else d
        for i in range(len(ws) - w + 1):
            k = tuple(ws[i : i + w])
            first[k] = min(first.get(k, d), d)
    for d, t in docs:
        ws, place = words(t), LAST if d is None else d
        gone = [False] * len(ws)
        for i in range(len(ws) - w + 1):
            if first[tuple(ws[i : i + w])] < place:
                gone[i : i + w] = [True] * w
        kept = " ".join(x for x, g in zip(ws, gone) if not g)
        out.append((d, len(ws), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def fingerprint(text):
    w = WORD.findall(lower(text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_groups(fps):
    """The smallest member of each fingerprint's component."""
    u = np.array(sorted(set(fps)), dtype=np.uint64)
    group = list(range(len(u)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u[i + 1 :] ^ u[i]) <= 3) + i + 1:
            a, b = find(i), find(int(j))
            group[max(a, b)] = min(a, b)
    return {int(x): int(u[find(i)]) for i, x in enumerate(u)}


def components(docs):
    """``(doc_id, fingerprint, component_id)`` of all pairs compared."""
    fps = [fingerprint(t) for _, t in docs]
    root = near_groups(fps)
    least = {}
    for (d, _), x in zip(docs, fps):
        if d is not None:
            least[root[x]] = min(d, least.get(root[x], d))
    return [(d, f"{x:016x}", least.get(root[x])) for (d, _), x in zip(docs, fps)]


def base_counts(text):
    w = words(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cover = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(cover)


def sorted_rows(rows):
    return sorted((tuple(r) for r in rows), key=str)
