"""K-means, hard and soft assignment, one-hot codes and the diagonal mixture."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buyerlens.operators.kmeans import Fit, fit_many
from buyerlens.plans.partials import map_features, matrix, partitions_of, sum_partials
from buyerlens.session import materialise


def squared_distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """n x K squared Euclidean distances."""
    square = (x * x).sum(axis=1)[:, None] + (centers * centers).sum(axis=1) - 2.0 * x @ centers.T
    return np.maximum(square, 0.0)


def fit_kmeans(
    df: DataFrame, k: int, seed: int, n_init: int = 10, features: str = "features", id_column: str = "id"
) -> np.ndarray:
    """Centroids of the best of ``n_init`` starts by cost, all starts in the same passes; fewer rows than k is an error."""
    return fit_many(df, [Fit(k, seed)], n_init, features, id_column=id_column)[0]


def hard_assign(
    df: DataFrame, centers: np.ndarray, keep: Sequence[str], out: str = "cluster", features: str = "features"
) -> DataFrame:
    """Index of the nearest centroid; the first on ties."""

    def nearest(x):
        return np.argmin(squared_distances(x, centers), axis=1).astype(np.int32)

    return map_features(df, keep, nearest, out, features, "int")


def one_hot(column: str, k: int):
    """0/1 array of length k."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (i == F.col(column)).cast("double")
    )


def student_assign(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Student-t (one degree of freedom) soft assignment."""
    q = 1.0 / (1.0 + squared_distances(x, centers))
    return q / q.sum(axis=1, keepdims=True)


def soft_assign(
    df: DataFrame, centers: np.ndarray, keep: Sequence[str], out: str = "q", features: str = "features"
) -> DataFrame:
    return map_features(df, keep, lambda x: student_assign(x, centers), out, features)


def target_distribution(df: DataFrame, q: str = "q", out: str = "p") -> DataFrame:
    """Sharpen soft assignments: squares over cluster frequency, normalised per row.

    Cluster frequencies are one row, read as a scalar subquery.
    """
    freq = df.select(F.posexplode(q).alias("j", "v")).groupBy("j").agg(F.sum("v").alias("f"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("j", "f"))), lambda e: e["f"])
    weight = F.zip_with(F.col(q), F.col("_f"), lambda v, f: v * v / f)
    total = F.aggregate("_w", F.lit(0.0), lambda a, x: a + x)
    return (
        df.withColumn("_f", freq.agg(listed.alias("f")).scalar())
        .withColumn("_w", weight)
        .withColumn("_t", total)
        .withColumn(out, F.transform("_w", lambda w: w / F.col("_t")))
        .drop("_f", "_w", "_t")
    )


@dataclass(frozen=True)
class Mixture:
    """Diagonal Gaussian mixture."""

    weights: np.ndarray
    means: np.ndarray
    variances: np.ndarray

    def log_joint(self, x: np.ndarray) -> np.ndarray:
        """log weight + log density, n x K."""
        inv = 1.0 / self.variances
        square = (x * x) @ inv.T - 2.0 * x @ (self.means * inv).T + (self.means**2 * inv).sum(axis=1)
        const = np.log(2.0 * np.pi * self.variances).sum(axis=1)
        return np.log(self.weights) - 0.5 * (square + const)

    def posterior(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Responsibilities and log-likelihood per row."""
        joint = self.log_joint(x)
        top = joint.max(axis=1, keepdims=True)
        raw = np.exp(joint - top)
        total = raw.sum(axis=1, keepdims=True)
        return raw / total, (top + np.log(total))[:, 0]


def _maximise(total: np.ndarray, k: int, d: int, reg: float) -> Mixture:
    counts = total[:k] + 10.0 * np.finfo(float).eps
    means = total[k : k + k * d].reshape(k, d) / counts[:, None]
    second = total[k + k * d : k + 2 * k * d].reshape(k, d) / counts[:, None]
    return Mixture(counts / counts.sum(), means, np.maximum(second - means**2, 0.0) + reg)


def fit_mixture(
    df: DataFrame,
    k: int,
    seed: int,
    n_init: int = 1,
    reg: float = 1e-3,
    iterations: int = 100,
    tol: float = 1e-3,
    features: str = "features",
) -> Mixture:
    """Expectation-maximisation from a k-means start; each round is one pass that sums
    K x (1 + 2d) numbers per task."""
    rows = materialise(df.select(*[c for c in dict.fromkeys(("id", features)) if c in df.columns]))
    parts = partitions_of(rows)
    centers = fit_kmeans(rows, k, seed, n_init, features)
    d = centers.shape[1]

    def stats(resp, x, extra):
        return np.concatenate([resp.sum(axis=0), (resp.T @ x).ravel(), (resp.T @ (x * x)).ravel(), extra])

    def start(batch):
        x = matrix(batch, features)
        resp = np.eye(k)[np.argmin(squared_distances(x, centers), axis=1)]
        return stats(resp, x, [0.0, len(x)])

    model = _maximise(sum_partials(rows, start, parts), k, d, reg)
    before = -np.inf
    for _ in range(iterations):

        def expect(batch, model=model):
            x = matrix(batch, features)
            resp, like = model.posterior(x)
            return stats(resp, x, [like.sum(), len(x)])

        total = sum_partials(rows, expect, parts)
        model = _maximise(total, k, d, reg)
        bound = total[-2] / total[-1]
        if abs(bound - before) < tol:
            break
        before = bound
    return model


def mixture_posteriors(
    df: DataFrame, model: Mixture, keep: Sequence[str], out: str = "posterior", features: str = "features"
) -> DataFrame:
    return map_features(df, keep, lambda x: model.posterior(x)[0], out, features)
