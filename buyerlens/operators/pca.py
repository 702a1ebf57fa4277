"""Principal components of the training features.

The singular values come from the rows themselves, never from their products: every task reduces its rows to a triangular
factor (tall-skinny QR), factors are merged in a tree, and the driver takes the singular value decomposition of the one that
is left, a matrix of the number of features. A component with a millionth of the largest deviation is found as
well as the first; through a covariance its square would be lost in rounding.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from buyerlens.plans.partials import FAN_IN, array_column, map_features, matrix, partitions_of


def _upper(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def triangular_factor(df: DataFrame, partitions: int, features: str = "features", fan_in: int = FAN_IN) -> np.ndarray:
    """R of the QR decomposition of all rows with a leading column of ones.

    The ones make the first row of R carry the means, and what is below and right of it is the factor of the centred rows.
    A task keeps one factor and one batch; ``fan_in`` factors meet in a task of each next level, and at the driver.
    """

    def reduce(batches: Iterator[pa.RecordBatch], read) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            if batch.num_rows:
                rows = read(batch)
                kept = _upper(rows if kept is None else np.concatenate([kept, rows]))
        if kept is not None:
            yield pa.RecordBatch.from_arrays([array_column(kept)], ["row"])

    def with_ones(batch: pa.RecordBatch) -> np.ndarray:
        x = matrix(batch, features)
        return np.concatenate([np.ones((len(x), 1)), x], axis=1)

    schema = "row array<double>"
    factors = df.select(features).mapInArrow(lambda batches: reduce(batches, with_ones), schema)
    while partitions > fan_in:
        partitions = -(-partitions // fan_in)
        factors = factors.repartition(partitions).mapInArrow(
            lambda batches: reduce(batches, lambda b: matrix(b, "row")), schema
        )
    rows = factors.collect()
    if not rows:
        raise ValueError("no rows to fit on")
    return _upper(np.array([r["row"] for r in rows]))


def fit_pca(train: DataFrame, d: int, features: str = "features") -> np.ndarray:
    """Features x components loadings, at most as many components as features.

    Each component's largest loading is made positive, so that reruns agree in sign. Fewer rows than features, and
    features without variance, give components of variance zero at the end.
    """
    factor = triangular_factor(train, partitions_of(train), features)
    width = factor.shape[1] - 1
    loadings = np.linalg.svd(factor[1:, 1:], full_matrices=True)[2].T[:, : min(d, width)]
    top = np.argmax(np.abs(loadings), axis=0)
    return loadings * np.sign(loadings[top, np.arange(loadings.shape[1])])


def project(df: DataFrame, loadings: np.ndarray, keep: Sequence[str], out: str = "z") -> DataFrame:
    return map_features(df, keep, lambda x: x @ loadings, out)
