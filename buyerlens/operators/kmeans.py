"""Many K-means fits side by side: starts, resamples, seeds and numbers of clusters as one stack of centroid sets.

Every step is one pass over the stored rows that serves all sets still moving. Seeding draws the next centre of each
set in proportion to weight times squared distance by an exponential race: a row's entry is keyed on (row, start,
step), the least one wins, so neither partitions nor retries change the draw. A Lloyd pass adds the sums of all
sets in the tasks, so that the driver receives them once. Bootstrap weights are Poisson(1), drawn in the task from (row, resample).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buyerlens.functions.keyed import keyed_uniform
from buyerlens.plans.partials import array_column, matrix, partitions_of, sum_partials, vector
from buyerlens.session import materialise

ITERATIONS = 300
TOL = 1e-4  # of the mean variance, for the squared way that a set's centres move
CELLS = 2_000_000  # distances a task holds at a time
CACHED = 250_000  # distances of a step that should stay in a core's cache

# Cumulative Poisson(1) probabilities; beyond the last a weight has chance 1e-9.
POISSON_ONE = tuple(np.cumsum([np.exp(-1.0) / np.prod(np.arange(1.0, k + 1)) for k in range(12)]).tolist())


@dataclass(frozen=True)
class Fit:
    """One clustering to find: ``k`` centres of the rows of ``part``, in Poisson resample ``replicate`` if given."""

    k: int
    seed: int
    replicate: int | None = None
    part: int = 0


@dataclass
class _Group:
    """Sets of one part and one k: ``fits`` and ``starts`` number them, ``centers`` is sets x k x d."""

    part: int
    k: int
    fits: np.ndarray
    seeds: np.ndarray
    starts: np.ndarray
    replicates: np.ndarray  # -1: all rows once
    centers: np.ndarray

    def of(self, live: np.ndarray) -> _Group:
        return _Group(
            self.part, self.k, self.fits[live], self.seeds[live], self.starts[live], self.replicates[live], self.centers[live]
        )

    def weights(self, keys: np.ndarray) -> np.ndarray:
        """rows x sets."""
        distinct, at = np.unique(self.replicates, return_inverse=True)
        return np.column_stack([resample_weights(keys, r) for r in distinct])[:, at]

    def squares(self, x: np.ndarray) -> np.ndarray:
        """rows x sets x k squared distances."""
        flat = self.centers.reshape(-1, x.shape[1])
        square = (x * x).sum(axis=1)[:, None] + (flat * flat).sum(axis=1) - 2.0 * x @ flat.T
        return np.maximum(square, 0.0).reshape(len(x), *self.centers.shape[:2])


def resample_weights(keys: np.ndarray, replicate: int) -> np.ndarray:
    """Poisson(1) weight of every row in a resample; 1 for replicate -1."""
    if replicate < 0:
        return np.ones(len(keys))
    return np.searchsorted(POISSON_ONE, keyed_uniform(keys, replicate, 0x626F6F74), side="right").astype(float)


def _pieces(batch: pa.RecordBatch, group: _Group, features: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and vectors of the group's part, so many rows that their distances fit ``CELLS``."""
    mine = vector(batch, "_part") == group.part
    keys, x = vector(batch, "_key")[mine], matrix(batch, features)[mine]
    step = max(1, CELLS // max(1, len(group.fits) * group.k))
    for at in range(0, len(x), step):
        yield keys[at : at + step], x[at : at + step]


def _lloyd(group: _Group, keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cost, counts and sums of every set, in one vector; of equally near centres the first takes the row."""
    m, k, d = group.centers.shape
    flat = group.centers.transpose(1, 0, 2).reshape(k * m, d)
    table = np.vstack([-2.0 * flat.T, (flat * flat).sum(axis=1)])
    w, square = group.weights(keys), (x * x).sum(axis=1)[:, None]
    ones = np.column_stack([x, np.ones(len(x))])
    cost, counts, sums = np.zeros(m), np.zeros((k, m)), np.zeros((k * m, d))
    step = max(1, CACHED // (m * k))
    for at in range(0, len(x), step):
        rows, own = ones[at : at + step], w[at : at + step]
        far = (rows @ table).reshape(len(rows), k, m)  # less the row's own square
        least, near = far[:, 0].copy(), np.zeros((len(rows), m), dtype=np.int32)
        for c in range(1, k):
            np.copyto(near, c, where=far[:, c] < least)
            np.minimum(least, far[:, c], out=least)
        cost += (own * np.maximum(least + square[at : at + step], 0.0)).sum(axis=0)
        for c in range(k):
            np.multiply(near == c, own, out=far[:, c])
        counts += far.sum(axis=0)
        sums += far.reshape(len(rows), -1).T @ rows[:, :-1]
    return np.concatenate([cost, counts.T.ravel(), sums.reshape(k, m, d).transpose(1, 0, 2).ravel()])


def _stored(df: DataFrame, features: str, part: str | None, id_column: str) -> DataFrame:
    """``(_key, _part, features)`` written once; rows without an id are keyed on their features.

    Parts are dealt over all partitions by key, since one part may have most of the fits.
    """
    key = F.xxhash64(id_column) if id_column in df.columns else F.xxhash64(features)
    place = F.col(part).cast("int") if part else F.lit(0)
    rows = df.select(key.alias("_key"), place.alias("_part"), features)
    return materialise(rows.repartition(partitions_of(rows), "_key") if part else rows)


def _measure(rows: DataFrame, fits: Sequence[Fit], features: str, many: int) -> dict[int, tuple[float, int]]:
    """Mean variance and dimension of every part; too few rows for a fit are an error."""
    parts = sorted({f.part for f in fits})
    places = sorted({(f.part, -1 if f.replicate is None else f.replicate) for f in fits})

    def partial(batch):
        x, keys, own = matrix(batch, features), vector(batch, "_key"), vector(batch, "_part")
        out = []
        for p in parts:
            mine = x[own == p]
            out.append(np.concatenate([[len(mine)], mine.sum(axis=0), (mine * mine).sum(axis=0)]))
        out.append([(resample_weights(keys[own == p], r) > 0).sum() for p, r in places])
        return np.concatenate(out)

    try:
        total = sum_partials(rows, partial, many)
    except ValueError:
        total = np.zeros(len(parts) + len(places))
    seen = dict(zip(places, total[len(total) - len(places) :]))
    for f in fits:
        if seen[f.part, -1 if f.replicate is None else f.replicate] < f.k:
            raise ValueError(f"cannot fit k={f.k} clusters on fewer rows")
    d = ((len(total) - len(places)) // len(parts) - 1) // 2
    out = {}
    for i, p in enumerate(parts):
        n, sums, squares = np.split(total[i * (2 * d + 1) : (i + 1) * (2 * d + 1)], [1, 1 + d])
        out[p] = (float(np.maximum(squares / n - (sums / n) ** 2, 0.0).mean()), d)
    return out


def _draw(rows: DataFrame, groups: list[_Group], features: str, step: int) -> None:
    """Add one centre to every set: the row that wins its race."""

    def race(batches):
        best: dict[tuple[int, int], tuple[float, np.ndarray]] = {}
        for batch in batches:
            for g, group in enumerate(groups):
                for keys, x in _pieces(batch, group, features):
                    pull = group.weights(keys)
                    if step:
                        pull = pull * group.squares(x).min(axis=2)
                    for s in range(len(group.fits)):
                        u = keyed_uniform(keys, int(group.seeds[s]) * 1_000 + int(group.starts[s]), step + 1)
                        # rows without pull come after all others, in the order of their draws
                        with np.errstate(divide="ignore"):
                            time = np.where(pull[:, s] > 0, -np.log1p(-u) / pull[:, s], 1e300 * (1.0 + u))
                        at = int(time.argmin())
                        if (g, s) not in best or time[at] < best[g, s][0]:
                            best[g, s] = (float(time[at]), x[at])
        if best:
            yield pa.RecordBatch.from_arrays(
                [pa.array([g for g, _ in best], pa.int32()), pa.array([s for _, s in best], pa.int32()),
                 pa.array([t for t, _ in best.values()]), array_column(np.stack([x for _, x in best.values()]))],
                names=["g", "s", "time", "x"],
            )

    found = rows.mapInArrow(race, "g int, s int, time double, x array<double>")
    won = found.groupBy("g", "s").agg(F.min_by("x", F.struct("time", "x")).alias("x")).collect()  # a row a set
    place = {(r["g"], r["s"]): np.asarray(r["x"]) for r in won}
    for g, group in enumerate(groups):
        fresh = np.stack([place[g, s] for s in range(len(group.fits))])[:, None, :]
        group.centers = fresh if not step else np.concatenate([group.centers, fresh], axis=1)


def _beats(a: tuple, b: tuple) -> bool:
    """Lower cost, or the earlier start where costs differ by rounding only."""
    near = abs(a[0] - b[0]) <= 1e-9 * abs(b[0])
    return a[1] < b[1] if near else a[0] < b[0]


def fit_many(
    df: DataFrame,
    fits: Sequence[Fit],
    n_init: int = 10,
    features: str = "features",
    part: str | None = None,
    id_column: str = "id",
    iterations: int = ITERATIONS,
    tol: float = TOL,
) -> list[np.ndarray]:
    """Centres of every fit, best of ``n_init`` starts by cost. ``part`` names an int column that fits select rows by.

    Memory and messages are of the size sets x k x dimension, which the caller chooses; rows stay in their tasks.
    An empty cluster keeps its centre.
    """
    rows = _stored(df, features, part, id_column)
    many = partitions_of(rows)
    measured = _measure(rows, fits, features, many)
    groups = []
    for p, k in sorted({(f.part, f.k) for f in fits}):
        own = [(i, f, s) for i, f in enumerate(fits) if (f.part, f.k) == (p, k) for s in range(n_init)]
        groups.append(_Group(
            p, k, np.array([i for i, _, _ in own]), np.array([f.seed for _, f, _ in own]), np.array([s for _, _, s in own]),
            np.array([-1 if f.replicate is None else f.replicate for _, f, _ in own]), np.zeros((len(own), 0, measured[p][1])),
        ))
    for step in range(max(g.k for g in groups)):
        _draw(rows, [g for g in groups if step < g.k], features, step)

    best: dict[int, tuple[float, int, np.ndarray]] = {}
    live = groups
    for _ in range(iterations):

        def partial(batch, live=live):
            out = []
            for g in live:
                d = g.centers.shape[2]
                total = np.zeros(len(g.fits) * (1 + g.k * (1 + d)))
                for keys, x in _pieces(batch, g, features):
                    total += _lloyd(g, keys, x)
                out.append(total)
            return np.concatenate(out)

        total, at, moving = sum_partials(rows, partial, many, wide=True), 0, []
        for g in live:
            m, d = len(g.fits), g.centers.shape[2]
            cost, counts, sums = np.split(total[at : at + m * (1 + g.k * (1 + d))], [m, m + m * g.k])
            at += m * (1 + g.k * (1 + d))
            counts = counts.reshape(m, g.k, 1)
            new = np.where(counts > 0, sums.reshape(m, g.k, d) / np.maximum(counts, 1e-300), g.centers)
            still = ((new - g.centers) ** 2).sum(axis=(1, 2)) > tol * measured[g.part][0]
            for s in np.flatnonzero(~still):
                entry = (cost[s], int(g.starts[s]), new[s])
                if g.fits[s] not in best or _beats(entry, best[g.fits[s]]):
                    best[g.fits[s]] = entry
            g.centers = new
            if still.any():
                moving.append(g.of(still))
        live = moving
        if not live:
            break
    for g in live:  # out of iterations
        for s in range(len(g.fits)):
            if g.fits[s] not in best:
                best[g.fits[s]] = (np.inf, int(g.starts[s]), g.centers[s])
    return [best[i][2] for i in range(len(fits))]


def center_gaps(
    df: DataFrame, fits: Sequence[Fit], centers: Sequence[np.ndarray], features: str = "features", part: str | None = None, id_column: str = "id"
) -> DataFrame:
    """``(fit, cluster, weight, gap)``: each cluster's weight in its fit's rows, and the largest difference between its
    centre and their weighted mean; null for an empty one."""
    rows = _stored(df, features, part, id_column)
    groups = [
        _Group(f.part, f.k, np.array([i]), np.array([f.seed]), np.zeros(1, int), np.array([-1 if f.replicate is None else f.replicate]), c[None])
        for i, (f, c) in enumerate(zip(fits, centers, strict=True))
    ]

    def partial(batch):
        out = []
        for g in groups:
            total = np.zeros(1 + g.k * (1 + g.centers.shape[2]))
            for keys, x in _pieces(batch, g, features):
                total += _lloyd(g, keys, x)
            out.append(total)
        return np.concatenate(out)

    total, at, found = sum_partials(rows, partial, partitions_of(rows), wide=True), 0, []
    for i, g in enumerate(groups):
        d = g.centers.shape[2]
        counts = total[at + 1 : at + 1 + g.k]
        sums = total[at + 1 + g.k : at + 1 + g.k * (1 + d)].reshape(g.k, d)
        at += 1 + g.k * (1 + d)
        for c in range(g.k):
            gap = float(np.abs(sums[c] / counts[c] - g.centers[0, c]).max()) if counts[c] > 0 else None
            found.append((i, c, float(counts[c]), gap))
    return df.sparkSession.createDataFrame(found, "fit int, cluster int, weight double, gap double")
