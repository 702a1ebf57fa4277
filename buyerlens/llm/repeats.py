"""Substring dedup by recompression.

Words are renamed in rounds: runs of one symbol become one symbol, then, with symbols split into left
and right ones by their name, each left symbol followed by a right one becomes a pair. Names are hashes of what
they stand for, so every task gives equal substrings the same symbols without a dictionary; a symbol
also knows the span of words that forces it. A window's anchor is the symbol of the deepest round forced from
inside the window, the one with the smallest name; after two rounds every window of 13 words without long runs
has one, and other windows are their own anchor. Equal windows have equal anchors, so

1. a document whose whole text an earlier one has is set aside: all its windows are repeats,
2. anchors found in one document only rule their windows out (one shuffle of anchors),
3. what is left is verified by 96 bits of each window's words (one shuffle of those windows),
4. words covered by a window that starts in an earlier document are removed.

Defined cases: a null or empty text has no words; a null id comes after all others; rows with one id
are one document, and never remove each other's words; repeated rows are all returned; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from buyerlens.llm.text import CHECK_BASE, WORD_BASE, chunks, mixed, span_hashes, word_names

WINDOW = 13
ROUNDS = 2
CHUNK = 1_000_000
RUN, STRIDE = 255, 15  # most windows in one row, and most words between them
LAST = 2**63 - 1  # the place of a null id


class Symbols:
    """Symbols of one round: names, whether they end a text, and the first and last word that force them."""

    def __init__(self, name, stop, lo, hi):
        self.name, self.stop, self.lo, self.hi = name, stop, lo, hi

    def runs(self) -> Symbols:
        same = (self.name[1:] == self.name[:-1]) & ~self.stop[1:] & ~self.stop[:-1]
        first = np.flatnonzero(np.concatenate([[True], ~same]))
        last = np.concatenate([first[1:], [len(self.name)]]) - 1
        n = (last - first + 1).astype(np.uint64)
        name = np.where(n > 1, mixed(self.name[first] + n * np.uint64(CHECK_BASE)), self.name[first])
        # that a run ends here is forced by its neighbours
        before, after = np.maximum(first - 1, 0), np.minimum(last + 1, len(self.name) - 1)
        return Symbols(name, self.stop[first], self.lo[before], self.hi[after])

    def pairs(self, round_: int) -> Symbols:
        right = (mixed(self.name + np.uint64(round_ + 1)) >> np.uint64(63)).astype(bool)
        after = np.minimum(np.arange(len(self.name)) + 1, len(self.name) - 1)
        before = np.maximum(np.arange(len(self.name)) - 1, 0)
        joins = ~right & ~self.stop & right[after] & ~self.stop[after]
        joins[-1] = False
        name = np.where(joins, mixed(self.name * np.uint64(WORD_BASE) + mixed(self.name[after])), self.name)
        lo = np.where(right, self.lo[before], self.lo)  # a right symbol is free if the one before is not left
        hi = np.where(right, self.hi, self.hi[after])
        taken = np.concatenate([[False], joins[:-1]])
        keep = ~taken
        return Symbols(name[keep], self.stop[keep], lo[keep], hi[keep])


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word names of all texts with a stop before, between and after them; stops; each place's text; each text's
    first place."""
    names, first = word_names(texts)
    n = np.diff(first)
    text_of = np.repeat(np.arange(len(texts)), n)
    place = np.arange(len(names)) + text_of + 1
    flat = np.zeros(len(names) + len(texts) + 1, dtype=np.uint64)
    stop = np.ones(len(flat), dtype=bool)
    flat[place], stop[place] = names, False
    owner = np.full(len(flat), -1)
    owner[place] = text_of
    return flat, stop, owner, first[:-1] + np.arange(len(texts)) + 1


def anchors(texts: list[bytes], window: int = WINDOW, rounds: int = ROUNDS):
    """Runs of windows with one anchor: their text, first window, number of windows, and the anchor's name."""
    flat, stop, owner, begin = laid_out(texts)
    starts = np.flatnonzero(~stop[: len(flat) - window + 1]) if len(flat) >= window else np.zeros(0, dtype=np.int64)
    starts = starts[owner[starts + window - 1] == owner[starts]]
    if not len(starts):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none
    at = np.arange(len(flat))
    levels, symbols = [], Symbols(flat, stop, at, at)
    for r in range(rounds):
        symbols = symbols.runs().pairs(r)
        levels.append(symbols)
    chosen = np.full(len(starts), -1)  # place of the anchor among the symbols of all rounds
    lo = np.concatenate([s.lo for s in levels])
    hi = np.concatenate([s.hi for s in levels])
    base = len(lo)
    for s in reversed(levels):
        base -= len(s.lo)
        left = np.flatnonzero(chosen < 0)
        from_, to = starts[left], starts[left] + window - 1
        i = np.searchsorted(s.lo, from_, side="left")
        j = np.searchsorted(s.hi, to, side="right")
        order, best, where = mixed(s.name ^ np.uint64(CHECK_BASE)), np.zeros(len(left), dtype=np.uint64), np.full(len(left), -1)
        for k in range(int((j - i).max(initial=0))):
            here = np.minimum(i + k, len(order) - 1)
            better = (i + k < j) & ((where < 0) | (order[here] < best)) & ~s.stop[here]
            best[better], where[better] = order[here[better]], here[better]
        chosen[left] = np.where(where >= 0, where + base, -1)
    alone = chosen < 0
    chosen = np.where(alone, -2 - starts, chosen)
    new = np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (owner[starts[1:]] != owner[starts[:-1]])])
    run = np.flatnonzero(new)
    count = np.diff(np.concatenate([run, [len(starts)]]))
    own = chosen[run] < 0
    place = np.where(own, 0, chosen[run])
    a = np.where(own, starts[run], lo[place])
    b = np.where(own, starts[run] + window, hi[place] + 1)
    kind = np.where(own, rounds, np.searchsorted(np.cumsum([len(s.lo) for s in levels]), place, side="right"))
    name = span_hashes(flat, a, b, WORD_BASE) + kind.astype(np.uint64)
    text_of = owner[starts[run]]
    # a word or phrase that fills a text gives neighbouring runs one name: they become one run
    other = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]) | (text_of[1:] != text_of[:-1])]))
    first = starts[run][other] - begin[text_of[other]]
    return text_of[other], first, np.add.reduceat(count, other), name[other].view(np.int64)


def window_names(texts: list[bytes], text_of: np.ndarray, first: np.ndarray, window: int = WINDOW):
    """64 and 32 independent bits of the words of windows."""
    flat, _, _, begin = laid_out(texts)
    a = begin[text_of] + first
    check = span_hashes(mixed(flat + np.uint64(1)), a, a + window, CHECK_BASE) >> np.uint64(32)
    return span_hashes(flat, a, a + window, WORD_BASE).view(np.int64), check.astype(np.uint32).view(np.int32)


def packed_runs(first: np.ndarray, stride: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows at regular strides as one number each: place, stride and length. A long run is cut, and the second
    result says in how many."""
    pieces = -(-count // RUN)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    size = np.minimum(RUN, np.repeat(count, pieces) - nth * RUN)
    stride = np.repeat(stride, pieces)
    return ((np.repeat(first, pieces) + nth * RUN * stride) * (STRIDE + 1) + stride) * (RUN + 1) + size, pieces


def unpacked_runs(run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the runs, and how many each run has."""
    count, stride, first = run % (RUN + 1), run // (RUN + 1) % (STRIDE + 1), run // (RUN + 1) // (STRIDE + 1)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(first, count) + nth * np.repeat(stride, count), count


def regular(text_of: np.ndarray, names: tuple[np.ndarray, ...], first: np.ndarray):
    """Windows of one name that stand in one text at a regular stride, gathered: order of the windows, heads of the
    runs in that order, strides and lengths. A phrase that fills a text, of up to ``STRIDE`` words, costs a row or two a word."""
    order = np.lexsort((first, *names, text_of))
    n = len(order)
    if not n:
        return order, order, order, order
    of, at = text_of[order], first[order]
    same = of[1:] == of[:-1]
    for name in names:
        same &= name[order][1:] == name[order][:-1]
    gap = np.concatenate([[0], np.where(same & (np.diff(at) <= STRIDE), np.diff(at), 0)])
    after, before = np.append(gap[1:], 0), np.concatenate([[0], gap[:-1]])
    on = (gap > 0) & ((gap == after) | (gap == before))
    on &= ~np.concatenate([[False], on[:-1] & (gap[1:] != gap[:-1])])
    # where a run was broken, what follows at another stride begins anew
    head = np.flatnonzero(~on)
    count = np.diff(np.append(head, n))
    stride = np.where(count > 1, np.append(gap, 0)[np.minimum(head + 1, n)], 1)
    return order, head, stride, count


def raw_texts(batch: pa.RecordBatch) -> list[bytes]:
    return [b or b"" for b in batch.column(batch.schema.get_field_index("_text")).cast(pa.binary()).to_pylist()]


def sharing(rows: DataFrame, keys: list[str], only_later: bool) -> DataFrame:
    """Rows whose key is found in several documents, or, with ``only_later``, in a smaller one."""
    same = Window.partitionBy(*keys)
    first = F.min("_id").over(same)
    if only_later:
        return rows.withColumn("_first", first).where("_first < _id").drop("_first")
    return rows.withColumn("_first", first).withColumn("_final", F.max("_id").over(same)).where("_first < _final").drop("_first", "_final")


def find_repeats(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """``(doc_id, _id, _key, _text, _copy, _runs)``: per row its runs of windows that an earlier document has; ``_copy``
    marks a row whose whole text an earlier document has."""
    rows = docs.select(
        "doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("_id"), F.xxhash64("text").alias("_key"), F.col("text").alias("_text")
    )

    def to_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "_text", CHUNK):
            text_of, first, count, name = anchors(raw_texts(part), window, rounds)
            one = np.flatnonzero(count == 1)
            order, head, stride, n = regular(text_of[one], (name[one],), first[one])
            row = np.concatenate([np.flatnonzero(count > 1), one[order[head]]])
            row = row[np.argsort(text_of[row], kind="stable")]
            strides, counts = np.ones(len(count), dtype=np.int64), count.copy()
            strides[one[order[head]]], counts[one[order[head]]] = stride, n
            run, pieces = packed_runs(first[row], strides[row], counts[row])
            row = np.repeat(row, pieces)
            of = pa.array(text_of[row])
            yield pa.RecordBatch.from_arrays(
                [pa.array(name[row]), pa.array(run), part.column(1).take(of), part.column(2).take(of)],
                names=["_name", "_run", "_id", "_key"],
            )

    # every join below is on the row's id and text hash, so one exchange of the texts serves them all
    whole = rows.select("_id", "_key", F.sha2(F.col("_text").cast("binary"), 256).alias("_sha")).where("_sha IS NOT NULL")
    copies = sharing(whole, ["_sha"], only_later=True).select("_id", "_key", F.lit(True).alias("_copy")).distinct()
    # an exact copy has no window that its first text has not, so it is left out before it is cut
    singles = rows.join(copies, ["_id", "_key"], "left_anti").select("doc_id", "_id", "_key", "_text")
    # what changes from row to row comes first, and what a text's rows share last, where it compresses away
    found = singles.mapInArrow(to_anchors, "_name long, _run long, _id long, _key long")
    shared = (
        sharing(found, ["_name"], only_later=False).groupBy("_id", "_key").agg(F.collect_list("_run").alias("_shared"))
    )
    marked = singles.join(shared, ["_id", "_key"])

    def to_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "_text", CHUNK):
            lists = part.column(4)
            n = np.diff(lists.offsets.to_numpy())
            first, count = unpacked_runs(lists.flatten().to_numpy())
            text_of = np.repeat(np.repeat(np.arange(part.num_rows), n), count)
            name, check = window_names(raw_texts(part), text_of, first, window)
            order, head, stride, count = regular(text_of, (name, check), first)
            head = order[head]
            run, pieces = packed_runs(first[head], stride, count)
            head = np.repeat(head, pieces)
            of = pa.array(text_of[head])
            yield pa.RecordBatch.from_arrays(
                [pa.array(name[head]), pa.array(check[head]), pa.array(run), part.column(1).take(of), part.column(2).take(of)],
                names=["_name", "_check", "_run", "_id", "_key"],
            )

    candidates = marked.select("doc_id", "_id", "_key", "_text", "_shared").mapInArrow(
        to_windows, "_name long, _check int, _run long, _id long, _key long"
    )
    later = (
        sharing(candidates, ["_name", "_check"], only_later=True)
        .groupBy("_id", "_key")
        .agg(F.collect_list("_run").alias("_runs"))
    )
    return rows.join(later.join(copies, ["_id", "_key"], "full"), ["_id", "_key"], "left")


def remove_repeats(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS, kept_text: bool = True) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` and, unless ``kept_text`` is false, ``text``: the kept words."""
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", text string" if kept_text else "")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "_text", CHUNK):
            n_words, n_removed, digests, texts = [], [], [], []
            copies, runs = part.column(2).to_pylist(), part.column(3)
            for i, raw in enumerate(raw_texts(part)):
                words = raw.split()
                gone = 0
                if copies[i] and len(words) >= window:
                    words, gone = [], len(words)
                elif runs[i].is_valid:
                    cover = np.zeros(len(words) + 1, dtype=np.int64)
                    at, _ = unpacked_runs(runs[i].values.to_numpy())
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + window, -1)
                    covered = np.cumsum(cover[:-1]) > 0
                    gone = int(covered.sum())
                    words = [w for w, c in zip(words, covered.tolist()) if not c]
                left = b" ".join(words)
                n_words.append(len(words) + gone)
                n_removed.append(gone)
                digests.append(hashlib.sha256(left).hexdigest())
                texts.append(left)
            arrays = [part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if kept_text:
                arrays, names = [*arrays, pa.array(texts, pa.binary()).cast(pa.string())], [*names, "text"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    repeats = find_repeats(docs, window, rounds)
    return repeats.select("doc_id", "_text", "_copy", "_runs").mapInArrow(remove, schema)
