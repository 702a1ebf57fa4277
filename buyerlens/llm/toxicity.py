"""Toxicity: a support vector machine on a subsequence string kernel with Nyström landmarks.

The kernel of two strings sums, over all subsequences of ``LETTERS`` letters within ``SPAN`` places, the product of
their weights, each ``DECAY`` to the power of the gaps; so an insult is met with inserted characters or
gaps too. Texts are cut into sentences, accents and case are folded, and signs and white space become one gap
letter. Landmarks are words of the labelled sentences: those found oftener in toxic texts, and some others. The machine
is linear in the Nyström coordinates, so its value is one dot product with the sentence's subsequence weights, and
scoring is a table look-up per subsequence, exact for the landmark kernel. A text's score is a logistic
function of its highest sentence values, fitted on labelled texts that the machine has not seen.

Defined cases: a null or empty text has one empty sentence, of the machine's bias; a null id counts as held out; repeated
rows are scored each; a label given twice counts once, as its largest value; without labels of both kinds every score
is 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buyerlens.llm.text import held_out, learnable, per_chunk

LETTERS, SPAN, DECAY = 4, 7, 0.6
STRETCH = 10  # places whose subsequences are compared at once
GAP, DIGIT, OTHER = 31, 27, 28
SENTENCE = 100  # a longer sentence is cut at the next gap
SAMPLE_ROWS = 8_000
LANDMARKS = 128
TOP = 4  # sentence values that a text's score is made of
SEED = 13
CUT = 0.5


def _classes() -> np.ndarray:
    table = np.full(0x250, OTHER, dtype=np.int32)
    for c in range(0x250):
        base = unicodedata.normalize("NFD", chr(c).lower())[0]
        if "a" <= base <= "z":
            table[c] = ord(base) - 96
        elif base.isdigit():
            table[c] = DIGIT
        elif not base.isalpha():
            table[c] = GAP
    table[0xDF] = ord("s") - 96
    return table


CLASSES = _classes()


def sentences(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all sentences with ``SPAN`` - 1 zeros between, where each sentence begins, and its text."""
    whole = b"\n".join(texts).decode("utf-8", "replace")
    points = np.frombuffer(whole.encode("utf-32-le"), dtype=np.uint32)
    if not len(points):
        none = np.zeros(0, dtype=np.int64)
        return np.zeros(0, dtype=np.int32), none, none
    letter = np.where(points < len(CLASSES), CLASSES[np.minimum(points, len(CLASSES) - 1)], OTHER).astype(np.int32)
    gap = letter == GAP
    line = points == 10
    stop = (points == 46) | (points == 33) | (points == 63)
    ends = line | (stop & np.append(gap[1:] & (points[1:] <= 32), True))
    sizes = np.fromiter((len(t.decode("utf-8", "replace")) for t in texts), dtype=np.int64, count=len(texts)) + 1
    text_of = np.repeat(np.arange(len(texts)), sizes)[: len(points)]
    keep = ~gap | ~np.concatenate([[False], gap[:-1]]) | np.concatenate([[False], ends[:-1]])
    letter, ends, text_of, gap = letter[keep], ends[keep], text_of[keep], gap[keep]
    at = np.arange(len(letter))
    new = np.concatenate([[True], ends[:-1] | (text_of[1:] != text_of[:-1])])
    offset = at - np.maximum.accumulate(np.where(new, at, 0))
    part = np.maximum.accumulate(np.where(new | gap, at - offset + offset // SENTENCE, 0))
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    filled = np.add.reduceat(~gap, first) >= LETTERS - 2
    size = np.diff(np.append(first, len(letter)))
    first, size = first[filled], size[filled]
    step = SPAN + 1
    begin = np.cumsum(size + step) - size - step
    laid = np.zeros(int((size + step).sum()) + SPAN, dtype=np.int32)
    inside = np.repeat(begin + 1 - first, size)
    source = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
    laid[source + inside] = letter[source]
    laid[begin], laid[begin + size + 1] = GAP, GAP
    return laid, begin, text_of[first]


def codes(laid: np.ndarray):
    """Subsequences that begin at each place, as ``(gaps, code)``: four letters of five bits each."""
    n = len(laid) - SPAN + 1
    for a in range(1, SPAN - 2):
        two = laid[:n] << 15 | laid[a : a + n] << 10
        for b in range(a + 1, SPAN - 1):
            three = two | laid[b : b + n] << 5
            for c in range(b + 1, SPAN):
                yield c + 1 - LETTERS, three | laid[c : c + n]


def values(texts: list[bytes], model: dict) -> tuple[np.ndarray, np.ndarray]:
    """The machine's value of every sentence, and the sentence's text."""
    laid, begin, text_of = sentences(texts)
    if not len(begin):
        return np.zeros(0), text_of
    total = np.zeros(len(laid) - SPAN + 1, dtype=np.float32)
    for gaps, code in codes(laid):
        total += model["table"][code] * np.float32(DECAY**gaps)
    sums = np.concatenate([np.zeros(1), np.cumsum(total, dtype=np.float64)])
    stretch = sums[np.minimum(np.arange(len(total)) + STRETCH, len(total))] - sums[:-1]
    return np.maximum.reduceat(stretch, begin) / np.sqrt(STRETCH) + model["bias"], text_of


def highest(value: np.ndarray, text_of: np.ndarray, n: int, bias: float) -> np.ndarray:
    """Per text its ``TOP`` highest sentence values and the log of one more than its sentences."""
    out = np.full((n, TOP + 1), bias)
    order = np.lexsort((-value, text_of))
    count = np.bincount(text_of, minlength=n)
    rank = np.arange(len(order)) - np.repeat(np.cumsum(count) - count, count)
    for k in range(TOP):
        there = order[rank == k]
        out[text_of[there], k] = value[there]
    out[:, TOP] = np.log1p(count)
    return out


def score(texts: list[bytes], model: dict) -> np.ndarray:
    value, text_of = values(texts, model)
    x = highest(value, text_of, len(texts), model["bias"])
    return 1 / (1 + np.exp(-np.clip(x @ model["slopes"] + model["shift"], -30, 30)))


def pick_landmarks(texts: list[str], toxic: np.ndarray, n: int, seed: int) -> tuple[list[str], dict[str, float]]:
    """Words most often in toxic texts against the others, and a third of words at large; and all words' weights."""
    found = [set(re.findall(r"[^\W\d_]{4,}", t.lower())) for t in texts]
    yes, no = Counter(), Counter()
    for words, y in zip(found, toxic):
        (yes if y else no).update(words)
    p, q = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    weight = {
        w: np.log((yes[w] + 0.5) / (p + 1)) - np.log((no[w] + 0.5) / (q + 1)) for w in yes if yes[w] > 1
    }
    sure = {w: v * np.sqrt(yes[w]) for w, v in weight.items() if v > 1}
    best = sorted(sure, key=lambda w: (-sure[w], w))[: n - n // 3]
    rest = sorted(set(no) - set(best))
    some = np.random.default_rng(seed).choice(len(rest), min(len(rest), n - len(best)), replace=False) if rest else []
    return best + [rest[i] for i in sorted(some)], sure


def kernel_rows(laid: np.ndarray, begin: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
    """Dense subsequence weights of sentences over the places that landmarks use."""
    n = len(laid) - SPAN + 1
    owner = np.searchsorted(begin, np.arange(n), side="right") - 1
    cells, weights = [], []
    for gaps, code in codes(laid):
        at = place[code]
        ok = np.flatnonzero(at >= 0)
        cells.append(owner[ok] * width + at[ok])
        weights.append(np.full(len(ok), DECAY**gaps))
    return np.bincount(
        np.concatenate(cells), np.concatenate(weights), minlength=len(begin) * width
    ).reshape(len(begin), width)


def machine(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 200) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss, both classes weighing the same, by Newton steps."""
    z = np.column_stack([x, np.ones(len(x))])
    sign = np.where(y, 1.0, -1.0)
    each = np.where(y, 0.5 / max(1, y.sum()), 0.5 / max(1, (~y).sum())) * cost * 100
    w = np.zeros(z.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-6
    active = None
    for _ in range(rounds):
        now = sign * (z @ w) < 1
        if active is not None and (now == active).all():
            break
        active = now
        za = z[active] * each[active][:, None]
        w = np.linalg.solve(ridge + za.T @ z[active], za.T @ sign[active])
    return w


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    z = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) + ridge * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(texts: list[str], toxic: np.ndarray, landmarks: int = LANDMARKS, seed: int = SEED) -> dict:
    """The model: table of subsequence weights, bias, and the text's logistic function."""
    none = {"table": np.zeros(1 << 20, dtype=np.float32), "bias": 0.0, "slopes": np.zeros(TOP + 1), "shift": -30.0}
    toxic = np.asarray(toxic, dtype=bool)
    if not toxic.any() or toxic.all():
        return none
    apart = np.arange(len(texts)) % 3 == 2  # for the logistic function only
    if not toxic[~apart].any() or not toxic[apart].any() or toxic[apart].all() or toxic[~apart].all():
        apart = np.zeros(len(texts), dtype=bool)
    learn = [t for t, a in zip(texts, apart) if not a]
    marks, weight = pick_landmarks(learn, toxic[~apart], landmarks, seed)
    mark_laid, mark_begin, mark_of = sentences([m.encode() for m in marks])
    seen = np.zeros(1 << 20, dtype=bool)
    for _, code in codes(mark_laid):
        seen[code[(code & 31 > 0) & (code >> 5 & 31 > 0) & (code >> 10 & 31 > 0) & (code >> 15 > 0)]] = True
    used = np.flatnonzero(seen)
    place = np.full(1 << 20, -1, dtype=np.int32)
    place[used] = np.arange(len(used))
    basis = kernel_rows(mark_laid, mark_begin, place, len(used))
    basis /= np.sqrt((basis**2).sum(axis=1, keepdims=True)) + 1e-12
    size, axes = np.linalg.eigh(basis @ basis.T)
    axes, size = axes[:, size > 1e-6], size[size > 1e-6]
    to_axes = basis.T @ (axes / np.sqrt(size))  # from subsequence weights to Nyström coordinates

    # stretches of sentences to learn from: of a toxic text the likeliest, of others the likeliest and some at large
    rng = np.random.default_rng(seed)
    chosen, label = [], []
    for t, y in zip(learn, toxic[~apart]):
        parts = []
        for sentence in re.split(r"(?<=[.!?])\s+|\n", t):
            found = sentence.split()
            parts += [" ".join(found[i : i + 3]) for i in range(0, len(found), 2)]
        parts = sorted(set(parts))
        rate = np.array([max([weight.get(w, 0.0) for w in re.findall(r"[^\W\d_]{4,}", p.lower())] or [0.0]) for p in parts])
        top = np.argsort(-rate, kind="stable")[:4]
        if y:
            top = [i for i in top if rate[i] > 0]
        elif parts:
            top = [*top[:2], *rng.choice(len(parts), min(4, len(parts)), replace=False)]
        chosen += [parts[i].encode() for i in top]
        label += [y] * len(top)
    coordinates, kept = [], []
    for i in range(0, len(chosen), 64):
        laid, begin, of = sentences(chosen[i : i + 64])
        if len(begin):
            length = np.diff(np.append(begin, len(laid) - SPAN + 1))
            coordinates.append(kernel_rows(laid, begin, place, len(used)) @ to_axes / np.sqrt(length)[:, None])
            kept += [label[i + j] for j in of]
    if not kept or all(kept) or not any(kept):
        return none
    w = machine(np.vstack(coordinates), np.array(kept))
    table = np.zeros(1 << 20, dtype=np.float32)
    table[used] = to_axes @ w[:-1]
    model = {"table": table, "bias": float(w[-1])}
    judge = apart if apart.any() else ~apart
    held = [t.encode() for t, a in zip(texts, judge) if a]
    x = []
    for i in range(0, len(held), 200):
        value, of = values(held[i : i + 200], model)
        x.append(highest(value, of, len(held[i : i + 200]), model["bias"]))
    line = logistic(np.vstack(x), toxic[judge].astype(float))
    return model | {"slopes": line[:-1], "shift": float(line[-1])}


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = SEED) -> dict:
    """A model of at most ``sample_rows`` labelled texts, which are fitted on the driver."""
    some = learnable(labels, "toxic", sample_rows, seed).withColumnRenamed("label", "_label")
    texts = (
        docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id")
        .agg(F.coalesce(F.min("text"), F.lit("")).alias("text"), F.first("_label").alias("_label"))
        .orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id")
        .toArrow()
    )
    return fit(texts["text"].to_pylist(), texts["_label"].to_numpy() > 0, seed=seed)


def toxicity(docs: DataFrame, labels: DataFrame, cut: float = CUT, sample_rows: int = SAMPLE_ROWS, seed: int = SEED) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample_rows, seed))

    def make():
        return lambda texts: [score(texts, sent.value)]

    return per_chunk(docs, ["doc_id"], "text", [("score", "double")], make, chars=500_000).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted")
    )
