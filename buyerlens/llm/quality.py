"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

A text's features are counts of hashed pieces (words and runs of signs), of pairs of neighbours, and of repeats: a
piece equal to the one 1 to ``LAGS`` places before, and a triple seen before in the text. Counts are divided by the
number of pieces, so a score is one sparse dot product of any length of text. Training takes at most
``sample_rows`` labelled rows outside the held-out fold to the driver, as hashed counts; scoring is a pass of tasks.

Defined cases: a null or empty text has no features, and its score is that of the bias; a null id counts as held
out; repeated rows are scored each, and a label given twice counts once, as its largest value; without labels, or with an
empty table, the score is one half or there are no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buyerlens.llm.text import WORD_BASE, as_lists, carried, held_out, learnable, mixed, per_chunk, piece_names

BITS = 18
LAGS = 6
SAMPLE_ROWS = 8_000
SEED = 11
EPOCHS = 3
CUT = 0.3  # a score of at least this is predicted good
SCALE = 20.0


def features(texts: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Flat feature places of all texts, and the number of places of each text."""
    names, first = piece_names(texts)
    n = np.diff(first)
    text_of = np.repeat(np.arange(len(texts)), n)
    shift = np.uint64(64 - bits)
    parts, owners = [names >> shift], [text_of]
    together = text_of[1:] == text_of[:-1]
    pair = mixed(names[:-1] * np.uint64(WORD_BASE) + names[1:])
    parts.append((pair >> shift)[together])
    owners.append(text_of[1:][together])
    for lag in range(1, LAGS + 1):
        same = np.flatnonzero((names[lag:] == names[:-lag]) & (text_of[lag:] == text_of[:-lag])) + lag
        parts.append(np.full(len(same), mixed(np.array([lag], dtype=np.uint64))[0] >> shift))
        owners.append(text_of[same])
    inside = np.flatnonzero(text_of[2:] == text_of[:-2])
    triple = mixed(pair[:-1] * np.uint64(WORD_BASE) + names[2:] + text_of[2:].astype(np.uint64))[inside]
    order = np.argsort(triple, kind="stable")
    again = order[1:][triple[order][1:] == triple[order][:-1]]
    parts.append(np.full(len(again), mixed(np.array([LAGS + 1], dtype=np.uint64))[0] >> shift))
    owners.append(text_of[inside[again]])
    owner = np.concatenate(owners)
    place = np.concatenate(parts).astype(np.int64)[np.argsort(owner, kind="stable")]
    return place, np.bincount(owner, minlength=len(texts))


def sparse_counts(texts: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct places, their shares of the text's pieces, and the number of places of each text."""
    place, count = features(texts, bits)
    text_of = np.repeat(np.arange(len(texts)), count)
    both, times = np.unique(text_of << bits | place, return_counts=True)
    owner = both >> bits
    n = np.maximum(1, np.bincount(owner, weights=times, minlength=len(texts)))
    return (both & ((1 << bits) - 1)).astype(np.int32), (SCALE * times / n[owner]).astype(np.float32), np.bincount(owner, minlength=len(texts))


def follow_leader(
    rows: Iterable[tuple[np.ndarray, np.ndarray, int]],
    bits: int = BITS,
    alpha: float = 0.3,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 0.5,
    epochs: int = EPOCHS,
) -> np.ndarray:
    """Weights of all places and, last, the bias, after per-coordinate regularised-leader updates."""
    rows = list(rows)
    z, squares = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(at):
        w = -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(squares[at])) / alpha + l2)
        w[np.abs(z[at]) <= l1] = 0
        return w

    bias = 1 << bits
    for _ in range(epochs):
        for place, value, label in rows:
            at = np.append(place, bias)
            x = np.append(value, 1.0)
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - label) * x
            step = (np.sqrt(squares[at] + g * g) - np.sqrt(squares[at])) / alpha
            z[at] += g - step * w
            squares[at] += g * g
    return weights(np.arange(bias + 1)).astype(np.float32)


def score(texts: list[bytes], weights: np.ndarray, bits: int = BITS) -> np.ndarray:
    place, count = features(texts, bits)
    sums = np.zeros(len(texts))
    filled = count > 0
    if filled.any():
        first = (np.cumsum(count) - count)[filled]
        sums[filled] = np.add.reduceat(weights[place].astype(np.float64), first) / count[filled]
    return 1 / (1 + np.exp(-(SCALE * sums + weights[-1])))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS, seed: int = SEED) -> np.ndarray:
    """Weights from at most ``sample_rows`` labelled rows."""
    some = learnable(labels, label, sample_rows, seed).withColumnRenamed("label", "_label")
    # an id may stand in several rows: one text of each is learned from
    texts = (
        docs.select("doc_id", "text")
        .join(F.broadcast(some), "doc_id")
        .groupBy("doc_id")
        .agg(F.min("text").alias("text"), F.first("_label").alias("_label"))
    )

    def make():
        def count(batch: list[bytes]) -> list[pa.Array]:
            place, value, n = sparse_counts(batch)
            return [as_lists(place, n), as_lists(value.astype(np.float64), n)]

        return count

    rows = per_chunk(texts, ["doc_id", "_label"], "text", [("_at", "array<int>"), ("_x", "array<double>")], make).toArrow()
    order = np.argsort(rows["doc_id"].to_numpy() * 2654435761 % (1 << 32), kind="stable")  # the same order in every run
    at, x, y = rows["_at"].combine_chunks(), rows["_x"].combine_chunks(), rows["_label"].to_numpy()
    return follow_leader([(at[i].values.to_numpy(), x[i].values.to_numpy(), int(y[i])) for i in order.tolist()])


def classify(docs: DataFrame, labels: DataFrame, cut: float = CUT, sample_rows: int = SAMPLE_ROWS, seed: int = SEED) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row of ``docs``."""
    return scored(docs, train(docs, labels, "quality", sample_rows, seed), ["doc_id"]).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"),
        (F.col("_score") >= cut).cast("int").alias("predicted"),
    )


def scored(docs: DataFrame, weights: np.ndarray, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and ``_score``; weights, of a size set by ``BITS``, go to every task."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def make():
        return lambda texts: [score(texts, sent.value)]

    return per_chunk(docs, keep, "text", [("_score", "double")], make)


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = CUT, sample_rows: int = SAMPLE_ROWS, seed: int = SEED) -> DataFrame:
    """``docs`` without the rows that score below ``cut``."""
    rows = scored(carried(docs), train(docs, labels, "quality", sample_rows, seed), ["_row"])
    return rows.where(F.col("_score") >= cut).select("_row.*")
