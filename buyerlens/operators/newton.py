"""L2 logistic heads, binary and multinomial, many fits as blocks of one Newton iteration.

The objective of a fit is the summed log loss plus half the squared weights over C; intercepts are free. Every step is
one pass over the rows of all fits still moving: each task sends one vector per fit with loss, gradient and Hessian,
and those are added by fit before the driver sees them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buyerlens.plans.partials import FAN_IN, array_column, matrix, partitions_of, vector

MAX_PARAMETERS = 3_000  # of one fit; its Hessian is the square of that
STEPS = 100
DIRECT = 2  # partitions whose vectors the driver adds itself
SLICE = 4_000_000  # numbers of the rows x parameters matrix held at a time


@dataclass(frozen=True)
class Linear:
    """Weights, one row per class (a single one: binary), intercept last; and how large its gradient was left."""

    weights: np.ndarray
    gradient: float

    def chances(self, x: np.ndarray) -> np.ndarray:
        """Chance of class 1 as a vector, or a row of chances per class."""
        p = class_chances(x @ self.weights[:, :-1].T + self.weights[:, -1])
        return p[:, 0] if len(self.weights) == 1 else p


def class_chances(score: np.ndarray) -> np.ndarray:
    if score.shape[1] == 1:
        return 1.0 / (1.0 + np.exp(-np.clip(score, -500, 500)))
    e = np.exp(score - score.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def block_sums(weights: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Loss, gradient and Hessian of rows under given weights, in one vector; without the penalty."""
    k, p = weights.shape
    z = np.column_stack([x, np.ones(len(x))])
    out = np.zeros(1 + k * p + (k * p) ** 2)
    for at in range(0, len(z), max(1, SLICE // (k * p))):
        rows, target = z[at : at + SLICE // (k * p) or 1], y[at : at + SLICE // (k * p) or 1]
        chance = class_chances(rows @ weights.T)
        if k == 1:
            hit = target[:, None].astype(float)
            own = np.where(target == 1, chance[:, 0], 1.0 - chance[:, 0])
        else:
            hit = (target[:, None] == np.arange(k)).astype(float)
            own = chance[np.arange(len(rows)), target]
        out[0] -= np.log(np.maximum(own, 1e-300)).sum()
        out[1 : 1 + k * p] += ((chance - hit).T @ rows).ravel()
        spread = (chance[:, :, None] * rows[:, None, :]).reshape(len(rows), -1)
        hess = -(spread.T @ spread)
        for c in range(k):
            own_block = slice(c * p, (c + 1) * p)
            hess[own_block, own_block] += (rows * chance[:, c : c + 1]).T @ rows
        out[1 + k * p :] += hess.ravel()
    return out


def sum_by_fit(rows: DataFrame, partial, many: int) -> dict[int, np.ndarray]:
    """Add ``partial(fit, batch)`` vectors over all rows of each fit; one vector a fit reaches the driver, or one a
    partition where those are at most ``DIRECT``."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            fits = vector(batch, "fit")
            for f in np.unique(fits):
                part = partial(int(f), batch.filter(pa.array(fits == f)))
                if part is not None:
                    total[int(f)] = part if int(f) not in total else total[int(f)] + part
        for f, sums in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), array_column(sums[None, :])], ["fit", "part"])

    def merge(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for f, part in zip(vector(batch, "fit"), batch.column(1)):
                own = part.values.to_numpy()
                total[int(f)] = own if int(f) not in total else total[int(f)] + own
        for f, sums in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), array_column(sums[None, :])], ["fit", "part"])

    schema = "fit int, part array<double>"
    parts = rows.mapInArrow(add, schema)
    if many > DIRECT:
        parts = parts.repartition(min(-(-many // 4), FAN_IN), "fit").mapInArrow(merge, schema)
    out: dict[int, np.ndarray] = {}
    for r in parts.toArrow().to_batches():
        for f, part in zip(vector(r, "fit"), r.column(1)):
            own = part.values.to_numpy()
            out[int(f)] = own if int(f) not in out else out[int(f)] + own
    return out


def fit_logistic(rows: DataFrame, classes: dict[int, int], c: float = 1.0, tol: float = 1e-8) -> dict[int, Linear]:
    """Fits of stored ``(fit, features, y)`` rows; ``classes`` gives each fit's weight rows (1: binary, y 0 or 1).

    A step that raises a fit's objective is halved. A fit ends when its gradient's largest entry is below ``tol`` times
    its rows, or at the precision of its objective.
    """
    found = rows.groupBy("fit").agg(F.max(F.size("features")).alias("d"), F.count("*").alias("n")).collect()
    shape = {r["fit"]: (r["d"], r["n"]) for r in found}  # a row a fit
    weights, best, step, out = {}, {}, {}, {}
    for f, k in classes.items():
        if f not in shape:
            raise ValueError(f"no rows for fit {f}")
        p = shape[f][0] + 1
        if k * p > MAX_PARAMETERS:
            raise ValueError(f"{k} classes of {p} weights are more than {MAX_PARAMETERS} parameters")
        weights[f] = np.zeros((k, p))
    many = partitions_of(rows)
    trial = dict(weights)
    for _ in range(STEPS):
        now = dict(trial)

        def partial(f, batch, now=now):
            return block_sums(now[f], matrix(batch, "features"), vector(batch, "y")) if f in now else None

        sums = sum_by_fit(rows.where(F.col("fit").isin(list(now))), partial, many)
        trial = {}
        for f, w in now.items():
            size = w.size
            penalty = w.copy()
            penalty[:, -1] = 0.0
            value = sums[f][0] + 0.5 / c * (penalty**2).sum()
            gradient = sums[f][1 : 1 + size] + penalty.ravel() / c
            largest = float(np.abs(gradient).max())
            if f in best and value > best[f][0] + 1e-12 * abs(best[f][0]):
                step[f] = step[f] * 0.5
                if np.abs(step[f]).max() > 1e-14 * (1.0 + np.abs(best[f][1]).max()):
                    trial[f] = best[f][1] + step[f]
                else:
                    out[f] = Linear(best[f][1], best[f][2])
                continue
            stalled = f in best and largest >= best[f][2] and value >= best[f][0] * (1.0 - 1e-14)
            best[f] = (value, w, largest)
            if largest <= tol * max(1.0, min(100.0, shape[f][1])) or stalled:
                out[f] = Linear(w, largest)
                continue
            ridge = np.full(w.shape, 1.0 / c)
            ridge[:, -1] = 1e-9 * max(1.0, shape[f][1])  # one shift of all intercepts changes nothing
            hess = sums[f][1 + size :].reshape(size, size) + np.diag(ridge.ravel())
            step[f] = -np.linalg.solve(hess, gradient).reshape(w.shape)
            trial[f] = w + step[f]
        if not trial:
            break
    return out | {f: Linear(best[f][1], best[f][2]) for f in classes if f not in out}
