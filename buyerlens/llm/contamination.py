"""Benchmark decontamination: a BM25 index of test items, searched by every passage with block-max bounds.

Items are indexed in shards of about ``SHARD`` items, each with its own statistics; a posting is a word's BM25 impact divided by the item's score for its own
text, so 1 is a full match, and postings are grouped in blocks of ``BLOCK`` items with each word's largest impact of the block. A text is cut into
segments as long as the longest item, and two neighbours make a passage, so whatever a text holds of
an item lies in one passage. A passage's sum of block maxima bounds its score for every item of the block:
blocks below the threshold are skipped, the others are scored exactly. Every item above the threshold is then
verified by its five-word shingles (an item of fewer words is one shingle of its own length) and by the words of its question (all but the last sentence) and its answer.

All passages of all texts are queries. An index of more than one shard
is searched shard by shard, so any number of items takes bounded memory.

Defined cases: a null or empty text has no passage and is clean; a null id is an ordinary row; repeated rows are
returned each; items without words, and null items, are left out; items of one id are one list entry; an empty benchmark
leaves all texts clean; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buyerlens.llm.licenses import spaced
from buyerlens.llm.text import WORD_BASE, carried, per_chunk, span_hashes, word_names
from buyerlens.session import materialise

SHARD, SHARD_BYTES = 2_000, 4_000_000
BLOCK = 8
K1, B = 1.2, 0.75
THRESHOLD = 0.5  # of an item's score for its own text
SHINGLE = 5
CONTAINED = 0.8
ANSWER = 0.5


def question_and_answer(text: str) -> tuple[str, str]:
    """All but the last sentence, and the last; a single sentence's last third of words is its answer."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n+", text.strip()) if p.strip()]
    if len(parts) > 1:
        return " ".join(parts[:-1]), parts[-1]
    words = text.split()
    cut = max(1, len(words) - max(1, len(words) // 3))
    return " ".join(words[:cut]), " ".join(words[cut:])


def shingle_names(names: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Names of all stretches of ``size`` words; of the whole if there are fewer."""
    n = len(names)
    if n < size:
        return span_hashes(names, np.array([0]), np.array([n]), WORD_BASE) if n else np.zeros(0, dtype=np.uint64)
    at = np.arange(n - size + 1)
    return span_hashes(names, at, at + size, WORD_BASE)


class Shard:
    """Impacts and block maxima of up to ``SHARD`` items."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids = ids
        words = [word_names([spaced(t.encode())])[0] for t in texts]
        self.longest, mean = max(map(len, words)), sum(map(len, words)) / len(words)
        self.vocabulary, frequency = np.unique(np.concatenate([np.unique(w) for w in words]), return_counts=True)
        idf = np.log(1 + (len(ids) - frequency + 0.5) / (frequency + 0.5))
        impact = np.zeros((len(self.vocabulary) + 1, -(-len(ids) // BLOCK) * BLOCK), dtype=np.float32)
        for i, w in enumerate(words):
            at, tf = np.unique(np.searchsorted(self.vocabulary, w), return_counts=True)
            score = idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean))
            impact[at, i] = score / score.sum()
        self.impact = impact  # the last row is a word of no item
        self.block = impact.reshape(len(impact), -1, BLOCK).max(axis=2)
        self.shingles = [np.unique(shingle_names(w)) for w in words]
        self.spans = [min(SHINGLE, len(w)) for w in words]
        self.parts = [
            tuple(np.unique(word_names([spaced(p.encode())])[0]) for p in question_and_answer(t)) for t in texts
        ]

    def look_up(self, names: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.vocabulary, names), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == names, at, len(self.vocabulary))

    def holds(self, names: np.ndarray, item: int) -> bool:
        """Whether a passage holds an item: its shingles, and the words of its question and of its answer."""
        if np.isin(self.shingles[item], shingle_names(names, self.spans[item])).mean() < CONTAINED:
            return False
        question, answer = (np.isin(p, names).mean() if len(p) else 1.0 for p in self.parts[item])
        return question >= CONTAINED and answer >= ANSWER

    def search(self, names: np.ndarray, first: np.ndarray) -> list[tuple[int, int, float, bool]]:
        """``(text, item place, score, verified)`` of every item above the threshold for a passage of a text."""
        n = np.diff(first)
        at = self.look_up(names)
        segments = np.maximum(1, -(-n // self.longest)) * (n > 0)
        owner = np.repeat(np.arange(len(n)), segments)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(segments) - segments, segments)
        begin = first[:-1][owner] + place * self.longest
        if not len(begin):
            return []
        bound = np.empty((len(begin), self.block.shape[1]), dtype=np.float32)
        for a in range(0, len(begin), 2000):  # bounds of segments
            b = min(len(begin), a + 2000)
            lo, hi = begin[a], begin[b] if b < len(begin) else len(at)
            # a word counts once a segment: the same word again adds nothing
            segment = np.searchsorted(begin[a:b], np.arange(lo, hi), side="right") - 1
            found = np.flatnonzero(at[lo:hi] < len(self.vocabulary))
            pair = np.unique(segment[found] * np.int64(len(self.vocabulary)) + at[lo:hi][found])
            rows = pair // len(self.vocabulary)
            bound[a:b] = 0
            if len(rows):
                starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
                bound[a + rows[starts]] = np.add.reduceat(self.block[pair % len(self.vocabulary)], starts, axis=0)
        end_of = first[1:][owner]
        with_next = bound.copy()
        more = np.flatnonzero(np.append(owner[1:] == owner[:-1], False))
        with_next[more] += bound[more + 1]
        out = []
        hits, blocks = np.nonzero(with_next >= THRESHOLD)
        for s in np.unique(hits).tolist():
            a, b = begin[s], min(begin[s] + 2 * self.longest, end_of[s])
            terms = np.unique(at[a:b])
            terms = terms[terms < len(self.vocabulary)]
            for block in blocks[hits == s].tolist():
                items = slice(block * BLOCK, (block + 1) * BLOCK)
                score = self.impact[terms, items].sum(axis=0)
                for i in np.flatnonzero(score >= THRESHOLD).tolist():
                    item = block * BLOCK + i
                    out.append((int(owner[s]), item, float(score[i]), self.holds(names[a:b], item)))
        return out


def shards(benchmark: DataFrame, size: int = SHARD, weight: int = SHARD_BYTES) -> tuple[DataFrame, int]:
    """Items with their ``_shard``, and the number of shards: about ``size`` items and ``weight`` bytes in each."""
    items = benchmark.where("text IS NOT NULL AND item_id IS NOT NULL").select("item_id", "text").distinct()
    total = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    n = max(1, -(-total["n"] // size), -(-total["bytes"] // weight))
    return items.withColumn("_shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))), n


def leaks(docs: DataFrame, benchmark: DataFrame, size: int = SHARD, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and ``(contaminated, items, retrieved, best)``: verified items, how many were retrieved, the
    best score.

    One shard is one pass over the texts; with more, each pass leaves only its hits, and those are joined.
    """
    items, n = shards(benchmark, size)
    outputs = [("contaminated", "boolean"), ("items", "array<long>"), ("retrieved", "long"), ("best", "double")]

    def one_pass(keep: list[str], number: int) -> DataFrame:
        rows = items.where(F.col("_shard") == number).orderBy("item_id", "text").toArrow()  # a bounded shard
        full = [
            (i, t) for i, t in zip(rows["item_id"].to_pylist(), rows["text"].to_pylist()) if len(spaced(t.encode())) > 2
        ]
        sent = docs.sparkSession.sparkContext.broadcast(full)

        def make():
            shard = Shard([i for i, _ in sent.value], [t for _, t in sent.value]) if sent.value else None

            def find(texts: list[bytes]) -> list:
                held: list[set[int]] = [set() for _ in texts]
                seen: list[set[int]] = [set() for _ in texts]
                best = [0.0] * len(texts)
                for text, item, score, verified in shard.search(*word_names([spaced(t) for t in texts])) if shard else []:
                    seen[text].add(shard.ids[item])
                    best[text] = max(best[text], score)
                    if verified:
                        held[text].add(shard.ids[item])
                return [[bool(h) for h in held], [sorted(h) for h in held], [len(s) for s in seen], best]

            return find

        return per_chunk(keyed, keep, "text", outputs, make)

    keyed = docs.select(*dict.fromkeys([*keep, "doc_id", "text"]), F.xxhash64("text").alias("_key"))
    if n == 1:
        return one_pass([*keep], 0)
    parts = [materialise(one_pass(["doc_id", "_key"], k).where("retrieved > 0").distinct()) for k in range(n)]
    hits = parts[0]
    for more in parts[1:]:
        hits = hits.unionAll(more)
    joined = hits.groupBy(F.col("doc_id").alias("_doc"), F.col("_key").alias("_hit")).agg(
        F.max("contaminated").alias("contaminated"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.sum("retrieved").alias("retrieved"),
        F.max("best").alias("best"),
    )
    return keyed.join(
        joined, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_key") == F.col("_hit")), "left"
    ).select(
        *keep, F.coalesce("contaminated", F.lit(False)).alias("contaminated"),
        F.coalesce("items", F.array().cast("array<long>")).alias("items"),
        F.coalesce("retrieved", F.lit(0).cast("long")).alias("retrieved"), F.coalesce("best", F.lit(0.0)).alias("best"),
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame, size: int = SHARD) -> DataFrame:
    """``docs`` without the rows that hold a test item."""
    return leaks(carried(docs), benchmark, size, ("_row",)).where(~F.col("contaminated")).select("_row.*")
