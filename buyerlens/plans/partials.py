"""Sum one numeric vector per partition on Spark: the step shared by all iterative fits."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

FAN_IN = 32
PIECE = 2_048  # numbers of a vector that one task adds, at least
PIECES = ["piece", "part"]


def matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """An array<double> column of an Arrow batch as an n x d matrix."""
    col = batch.column(batch.schema.get_field_index(name))
    if len(col) == 0:
        return np.zeros((0, 0))
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(col), -1)


def vector(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A scalar column of an Arrow batch as a NumPy array."""
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def array_column(values: np.ndarray) -> pa.Array:
    """An n x d matrix as an Arrow list<double> column."""
    n, d = values.shape
    offsets = pa.array(np.arange(0, (n + 1) * d, d, dtype=np.int32))
    flat = pa.array(np.ascontiguousarray(values, dtype=np.float64).ravel())
    return pa.ListArray.from_arrays(offsets, flat)


def sum_partials(
    df: DataFrame,
    partial: Callable[[pa.RecordBatch], np.ndarray | None],
    partitions: int,
    fan_in: int = FAN_IN,
    wide: bool = False,
) -> np.ndarray:
    """Sum ``partial(batch)`` over all rows of a frame of ``partitions`` partitions.

    The driver sees what ``partial_sums`` leaves: one vector of a ``wide`` sum or of more than ``fan_in`` partitions,
    else a short vector a partition.
    """
    found = _added(partial_sums(df, partial, partitions, fan_in, wide).toArrow().to_batches())
    if not found:
        raise ValueError("no rows to fit on")
    return np.concatenate([found[i] for i in sorted(found)])


def partial_sums(
    df: DataFrame,
    partial: Callable[[pa.RecordBatch], np.ndarray | None],
    partitions: int,
    fan_in: int = FAN_IN,
    wide: bool = False,
) -> DataFrame:
    """``(piece, part)``: each task adds up its batches to one vector, cut into at most ``fan_in`` pieces; all tasks'
    vectors of a piece are added by one task, so a piece is one row, whatever the number of partitions."""

    def per_partition(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                part = partial(batch)
                if part is not None:
                    total = part if total is None else total + part
        if total is not None:
            cuts = np.array_split(total, min(fan_in, max(1, len(total) // PIECE)))
            for i, cut in enumerate(cuts):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), array_column(cut.reshape(1, -1))], PIECES)

    def merge(batches):
        for i, total in sorted(_added(batches).items()):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), array_column(total.reshape(1, -1))], PIECES)

    schema = "piece int, part array<double>"
    parts = df.mapInArrow(per_partition, schema)
    if partitions > (1 if wide else fan_in):
        parts = parts.repartition(min(-(-partitions // 4), fan_in), "piece").mapInArrow(merge, schema)
    return parts


def _added(batches: Iterable[pa.RecordBatch]) -> dict[int, np.ndarray]:
    """The sum of every piece's vectors."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, part in zip(vector(batch, "piece"), batch.column(1)):
            own = part.values.to_numpy()
            total[int(i)] = own if int(i) not in total else total[int(i)] + own
    return total


def partitions_of(df: DataFrame) -> int:
    """Partition count of a persisted frame."""
    return df.rdd.getNumPartitions()


def arrow_column(values: np.ndarray) -> pa.Array:
    """A vector or matrix as an Arrow column."""
    return array_column(values) if values.ndim == 2 else pa.array(values)


def map_batches(
    df: DataFrame,
    keep: Sequence[str],
    inputs: Sequence[str],
    fn: Callable[[pa.RecordBatch], dict[str, np.ndarray]],
    outputs: dict[str, str],
) -> DataFrame:
    """Add columns computed batch-wise by NumPy; ``outputs`` maps names to Spark types."""
    keep = list(keep)
    base = df.select(*dict.fromkeys([*keep, *inputs]))
    schema = base.select(*keep).schema
    for name, kind in outputs.items():
        schema = schema.add(T.StructType.fromDDL(f"{name} {kind}")[0])
    names = [*keep, *outputs]

    def apply(batches):
        for batch in batches:
            if batch.num_rows:
                found = fn(batch)
                kept = [batch.column(batch.schema.get_field_index(c)) for c in keep]
                new = [arrow_column(found[c]) for c in outputs]
                yield pa.RecordBatch.from_arrays([*kept, *new], names)

    return base.mapInArrow(apply, schema)


def map_features(
    df: DataFrame,
    keep: Sequence[str],
    fn: Callable[[np.ndarray], np.ndarray],
    out: str,
    features: str = "features",
    kind: str = "array<double>",
) -> DataFrame:
    """Add one column computed batch-wise from the feature matrix."""
    return map_batches(df, keep, [features], lambda b: {out: fn(matrix(b, features))}, {out: kind})
