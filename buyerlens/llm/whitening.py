"""Whitening of embeddings: eigenvectors of the covariance of all vectors, and the projection on them.

Entries are scaled to whole numbers. One pass adds up each dimension exactly; a second adds up products of
centred entries in every task and then in a few tasks; the driver sees dimension x dimension numbers, whatever the
rows. Householder reflections turn the covariance into a tridiagonal matrix, Sturm counts bisect its largest
eigenvalues, and inverse iteration finds their vectors, each made orthogonal to those of its cluster before.
The components, as large as the dimension x ``components``, go to the tasks with the projection.

Defined cases: rows whose vector is null, empty, or holds null or non-finite entries, or entries of 2^36
and more, are left out; so are vectors of another length than the most frequent one (of equally frequent ones the longest); null and repeated ids are
ordinary rows; a component whose variance is 0 within rounding has null ``whitened`` and counts nowhere in
``identity_error``; without any variance ``explained`` is null; a ``deviation`` that does not fit 64 bits is null;
fewer dimensions than components give as many components as dimensions; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buyerlens.plans.partials import array_column, partitions_of, sum_partials

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
LARGEST = 2.0**36  # sums of a batch then fit 64 bits
EPS = np.finfo(float).eps


def usable(batch: pa.RecordBatch, column: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """``(row numbers, vectors)`` of each vector length in a batch; only rows whose entries all count."""
    lists = batch.column(batch.schema.get_field_index(column))
    if lists.null_count == len(lists):
        return []
    offsets, base = lists.offsets.to_numpy(), lists.offsets[0].as_py()
    entries = lists.values.slice(base, lists.offsets[len(lists)].as_py() - base).cast(pa.float64())
    flat = entries.to_numpy(zero_copy_only=False)  # a null entry becomes NaN
    starts, sizes = offsets[:-1] - base, np.diff(offsets)
    bad = np.concatenate([[0], np.cumsum(~(np.abs(flat) < LARGEST))])
    fine = (bad[starts + sizes] == bad[starts]) & (sizes > 0) & lists.is_valid().to_numpy(zero_copy_only=False)
    out = []
    for size in np.unique(sizes[fine]):
        rows = np.flatnonzero(fine & (sizes == size))
        out.append((rows, flat[starts[rows][:, None] + np.arange(size)]))
    return out


def whole(c: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * c).astype(np.int64) + SHIFT


def dimension_sums(df: DataFrame, vector: str) -> tuple[int, list[int]]:
    """Number of usable vectors and the exact sum of every dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for rows, c in usable(batch, vector):
                n, sums = found.get(c.shape[1], (0, 0))
                found[c.shape[1]] = (n + len(rows), sums + whole(c).sum(axis=0).astype(object))
        for size, (n, sums) in found.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(size, size), pa.int32()), pa.array(np.arange(size), pa.int32()),
                 pa.array(np.full(size, n), pa.int64()), pa.array([Decimal(s) for s in sums], pa.decimal128(38, 0))],
                names=["size", "dim", "n", "total"],
            )

    parts = df.select(vector).mapInArrow(add, "size int, dim int, n long, total decimal(38,0)")
    added = parts.groupBy("size", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    most = added.where("dim = 0").orderBy(F.desc("n"), F.desc("size")).limit(1).select("size", "n").collect()
    if not most:
        return 0, []
    totals = added.where(F.col("size") == most[0]["size"]).orderBy("dim").collect()  # a row a dimension
    return most[0]["n"], [int(r["total"]) for r in totals]


def householder(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and the orthogonal matrix Q with A = Q T Q'."""
    a, n = a.copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        norm = np.linalg.norm(v)
        if norm == 0.0:
            continue
        v[0] += np.copysign(norm, v[0])
        v /= np.linalg.norm(v)
        a[k + 1 :, k:] -= 2.0 * np.outer(v, v @ a[k + 1 :, k:])
        a[:, k + 1 :] -= 2.0 * np.outer(a[:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2.0 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def below(d: np.ndarray, e: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix are less than each x: negative terms of the Sturm sequence."""
    tiny = EPS * (np.abs(d).max() + (np.abs(e).max() if len(e) else 0.0)) + np.finfo(float).tiny
    t = d[0] - x
    count = (t < 0).astype(int)
    for i in range(1, len(d)):
        t = np.where(np.abs(t) < tiny, -tiny, t)
        t = d[i] - x - e[i - 1] ** 2 / t
        count += t < 0
    return count


def leading_eigenvalues(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The k largest, falling, by bisection of all k intervals at once."""
    n, off = len(d), np.abs(np.concatenate([[0.0], e, [0.0]]))
    reach = off[:-1] + off[1:]
    low, high = np.full(k, (d - reach).min()), np.full(k, (d + reach).max())
    wanted = n - 1 - np.arange(k)  # the j-th largest has so many below it
    high = high + EPS * np.abs(high) + np.finfo(float).tiny
    for _ in range(2000):
        mid = 0.5 * (low + high)
        if np.all((mid <= low) | (mid >= high)):
            break
        less = below(d, e, mid) <= wanted
        low, high = np.where(less, mid, low), np.where(less, high, mid)
    return 0.5 * (low + high)


def solve_shifted(d: np.ndarray, e: np.ndarray, shift: float, b: np.ndarray, tiny: float) -> np.ndarray:
    """(T - shift I) x = b by elimination with row exchanges."""
    n = len(d)
    main, up, up2, x = d - shift, np.append(e, 0.0), np.zeros(n), b.copy()
    for i in range(n - 1):
        under, diag, right = e[i], main[i + 1], up[i + 1]
        if abs(under) > abs(main[i]):
            main[i], under = under, main[i]
            up[i], diag = diag, up[i]
            up2[i], right = right, 0.0
            x[i], x[i + 1] = x[i + 1], x[i]
        if main[i] == 0.0:
            main[i] = tiny
        factor = under / main[i]
        main[i + 1] = diag - factor * up[i]
        up[i + 1] = right - factor * up2[i]
        x[i + 1] -= factor * x[i]
    for i in range(n - 1, -1, -1):
        if abs(main[i]) < tiny:
            main[i] = np.copysign(tiny, main[i])
        if i + 1 < n:
            x[i] -= up[i] * x[i + 1]
        if i + 2 < n:
            x[i] -= up2[i] * x[i + 2]
        x[i] /= main[i]
    return x


def inverse_iteration(d: np.ndarray, e: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors as columns; each is kept orthogonal to the earlier ones of its cluster of values."""
    n = len(d)
    norm = max(np.abs(d).max() + 2.0 * (np.abs(e).max() if n > 1 else 0.0), np.finfo(float).tiny)
    rng, out = np.random.default_rng(17), np.zeros((n, len(values)))
    first = 0
    for j, value in enumerate(values):
        if j and values[j - 1] - value > 1e-3 * norm:
            first = j
        x = rng.standard_normal(n)
        for _ in range(6):
            for _ in range(2):  # twice is enough
                x -= out[:, first:j] @ (out[:, first:j].T @ x)
            x /= np.linalg.norm(x)
            # equal values are pulled apart by a few roundings, else the same vector comes again
            x = solve_shifted(d, e, value - (j - first) * 4.0 * EPS * norm, x, EPS * norm)
            x /= np.linalg.norm(x)
        for _ in range(2):
            x -= out[:, first:j] @ (out[:, first:j].T @ x)
        out[:, j] = x / np.linalg.norm(x)
    return out


def leading_components(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns."""
    k = min(k, len(v))
    scale = np.abs(v).max()
    if scale == 0.0:
        return np.zeros(k), np.eye(len(v))[:, :k]
    d, e, q = householder(v / scale)
    values = leading_eigenvalues(d, e, k)
    return values * scale, q @ inverse_iteration(d, e, values)


@dataclass(frozen=True)
class Whitening:
    """``n`` vectors with dimension sums ``sums``; eigenvalues, components as columns, and the trace."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def live(self) -> np.ndarray:
        """Components whose variance is more than rounding."""
        return self.values > len(self.sums) * 8 * EPS * max(self.trace, np.finfo(float).tiny)

    def centred(self, c: np.ndarray) -> np.ndarray:
        """x - S/n; the whole part is taken off exactly first."""
        base = np.array([s // self.n for s in self.sums], dtype=np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        return (whole(c) - base) - rest

    def project(self, c: np.ndarray) -> np.ndarray:
        """Whitened coordinates; NaN for components without variance."""
        root = np.sqrt(np.where(self.live, self.values, np.nan))
        return self.centred(c) @ self.components / root

    def deviation(self, c: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exact; None beyond 64 bits."""
        gap = self.centred(c) * float(self.n)
        near = (gap * gap).sum(axis=1)
        x = whole(c)
        if near.max(initial=0.0) < 2.0**62 and self.n * max(1, int(np.abs(x).max(initial=0))) < 2**62 and max(map(abs, self.sums)) < 2**62:
            exact = self.n * x - np.array(self.sums, dtype=np.int64)
            return (exact * exact).sum(axis=1).tolist()
        exact = [sum((self.n * int(a) - s) ** 2 for a, s in zip(row, self.sums)) for row in x]
        return [v if v < 2**63 else None for v in exact]


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The model of all usable vectors; None without any."""
    n, sums = dimension_sums(df, vector)
    if not n:
        return None
    mean = Whitening(n, tuple(sums), np.zeros(0), np.zeros((len(sums), 0)), 0.0)

    def products(batch):
        out = None
        for _, c in usable(batch, vector):
            if c.shape[1] == len(sums):
                x = mean.centred(c)
                out = (x.T @ x).ravel()
        return out

    v = sum_partials(df.select(vector), products, partitions_of(df)).reshape(len(sums), -1) / n
    v = 0.5 * (v + v.T)
    values, vectors = leading_components(v, components)
    return Whitening(n, tuple(sums), values, vectors, float(np.trace(v)))


def identity_error(df: DataFrame, model: Whitening, vector: str = "embedding") -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, over all rows."""
    width, live = len(model.sums), model.live

    def sums(batch):
        for _, c in usable(batch, vector):
            if c.shape[1] == width:
                w = model.project(c)[:, live]
                return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])
        return None

    k = int(live.sum())
    if not k:
        return 0.0
    total = sum_partials(df.select(vector), sums, partitions_of(df)) / model.n
    mean, second = total[:k], total[k:].reshape(k, k)
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())


def whiten(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``(id, component, n, deviation, whitened, explained, identity_error)`` of every usable row and component."""
    kind = df.schema[id_column].dataType.simpleString()
    wide = f"{id_column} {kind}, deviation long, whitened array<double>"
    model = fit(df, vector, components)
    shape = f"{id_column} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return df.sparkSession.createDataFrame([], shape)
    error, width = identity_error(df, model, vector), len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, c in usable(batch, vector):
                if c.shape[1] == width:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(rows)), pa.array(model.deviation(c), pa.int64()), array_column(model.project(c))],
                        names=[id_column, "deviation", "whitened"],
                    )

    found = df.select(id_column, vector).mapInArrow(run, wide)
    part = [v / model.trace if model.trace > 0 else None for v in model.values]
    explained = F.array(*[F.lit(p).cast("double") for p in part])
    return found.select(id_column, "deviation", F.posexplode("whitened").alias("_at", "whitened")).select(
        id_column,
        (F.col("_at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        F.nanvl("whitened", F.lit(None).cast("double")).alias("whitened"),
        F.get(explained, F.col("_at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
