"""How clearly latent dimensions match named constructs.

Frames hold one row per id with two arrays, the code ``z`` and the constructs ``v``. Joint
histograms are built per task and summed on Spark, so rows are never multiplied by the number
of (dimension, construct) pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from buyerlens.functions.frames import vector_to_long
from buyerlens.plans.ordered import exact_quantiles
from buyerlens.plans.partials import matrix
from buyerlens.session import materialise

N_BINS = 20
TINY = 1e-12


def bin_edges(df: DataFrame, column: str, n_bins: int = N_BINS) -> list[np.ndarray]:
    """Distinct inner quantile edges per position of an array column; bins x positions numbers."""
    probs = [i * (1.0 / n_bins) for i in range(1, n_bins)]
    rows = exact_quantiles(vector_to_long(df, [], column, "name", "value"), probs).collect()
    width = 1 + max((r["name"] for r in rows), default=-1)
    return [np.unique([r["q"] for r in rows if r["name"] == j]) for j in range(width)]


def digitise(df: DataFrame, column: str, edges: list[np.ndarray], out: str) -> DataFrame:
    """Add the bin of every position: the number of edges not above the value."""
    table = F.array(*[F.array(*[F.lit(float(e)) for e in es]) for es in edges])
    return df.withColumn("_edges", table).withColumn(
        out,
        F.transform(
            column, lambda x, i: F.size(F.filter(F.get("_edges", i), lambda e: e <= x))
        ),
    ).drop("_edges")


def joint_counts(
    df: DataFrame, edges_z: list[np.ndarray], edges_v: list[np.ndarray], z: str = "z", v: str = "v"
) -> DataFrame:
    """``(dim, factor, zb, vb, n)``: joint bin counts of every dimension with every factor."""
    nz = max(len(e) for e in edges_z) + 1
    nv = max(len(e) for e in edges_v) + 1
    d, k = len(edges_z), len(edges_v)

    def count(batches):
        table = np.zeros((d, k, nz * nv), dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            zs, vs = matrix(batch, z), matrix(batch, v)
            zb = [np.searchsorted(edges_z[j], zs[:, j], side="right") for j in range(d)]
            vb = [np.searchsorted(edges_v[j], vs[:, j], side="right") for j in range(k)]
            for a in range(d):
                for b in range(k):
                    table[a, b] += np.bincount(zb[a] * nv + vb[b], minlength=nz * nv)
        where = np.nonzero(table)
        if len(where[0]):
            cols = [where[0], where[1], where[2] // nv, where[2] % nv]
            arrays = [pa.array(c.astype(np.int32)) for c in cols] + [pa.array(table[where])]
            yield pa.RecordBatch.from_arrays(arrays, ["dim", "factor", "zb", "vb", "n"])

    schema = "dim int, factor int, zb int, vb int, n bigint"
    parts = df.select(z, v).mapInArrow(count, schema)
    return parts.groupBy("dim", "factor", "zb", "vb").agg(F.sum("n").alias("n"))


def entropy(counts: DataFrame, by: Sequence[str], n: str = "n") -> DataFrame:
    """Entropy in nats of the counts of each group."""
    total = counts.groupBy(*by).agg(F.sum(n).alias("_t"))
    p = F.col(n) / F.col("_t")
    return counts.join(total, list(by)).groupBy(*by).agg((-F.sum(p * F.log(p))).alias("h"))


def mutual_information(joint: DataFrame, by: Sequence[str], a: str, b: str) -> DataFrame:
    """Mutual information in nats from joint counts ``(by, a, b, n)``.

    Sums run over at most bins x bins cells per group.
    """
    keys = list(by)
    left = joint.groupBy(*keys, a).agg(F.sum("n").alias("_na"))
    right = joint.groupBy(*keys, b).agg(F.sum("n").alias("_nb"))
    total = joint.groupBy(*keys).agg(F.sum("n").alias("_t"))
    n, t = F.col("n").cast("double"), F.col("_t").cast("double")
    term = n / t * F.log(n * t / (F.col("_na").cast("double") * F.col("_nb").cast("double")))
    return (
        joint.join(left, [*keys, a])
        .join(right, [*keys, b])
        .join(total, keys)
        .groupBy(*keys)
        .agg(F.sum(term).alias("mi"))
    )


def factor_entropy(joint: DataFrame) -> DataFrame:
    """Entropy of each factor's bins."""
    counts = joint.where(F.col("dim") == 0).groupBy("factor", "vb").agg(F.sum("n").alias("n"))
    return entropy(counts, ["factor"])


def _gap(scores: DataFrame, score: str, by: Sequence[str] = ("factor",)) -> DataFrame:
    """Difference of the two largest scores of each factor."""
    place = Window.partitionBy(*by).orderBy(F.desc(score))
    top = scores.withColumn("_r", F.row_number().over(place)).where("_r <= 2")
    return top.groupBy(*by).agg(
        (
            F.max(F.when(F.col("_r") == 1, F.col(score)))
            - F.max(F.when(F.col("_r") == 2, F.col(score)))
        ).alias("gap")
    )


def mig_per_factor(joint: DataFrame) -> DataFrame:
    """``(factor, mig)``: mutual information gap over entropy; null for a constant factor."""
    mi = mutual_information(joint, ["dim", "factor"], "zb", "vb")
    h = factor_entropy(joint)
    return (
        _gap(mi, "mi")
        .join(h, "factor")
        .select(
            "factor",
            F.when(F.col("h") >= TINY, F.col("gap") / F.col("h")).alias("mig"),
        )
    )


def squared_correlations(df: DataFrame, z: str = "z", v: str = "v") -> DataFrame:
    """``(dim, factor, r2)``: squared Pearson correlation of every pair; constants give 0.

    One pass finds the means; in the second each task sends one row of centred sums per pair.
    """
    mz, mv = _array_means(df, z), _array_means(df, v)
    d, k = len(mz), len(mv)

    def moments(batches):
        total = np.zeros((d, k))
        sz, sv, n = np.zeros(d), np.zeros(k), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            zs, vs = matrix(batch, z) - mz, matrix(batch, v) - mv
            total += zs.T @ vs
            sz += (zs * zs).sum(axis=0)
            sv += (vs * vs).sum(axis=0)
            n += len(zs)
        if n:
            dims, factors = np.meshgrid(np.arange(d), np.arange(k), indexing="ij")
            arrays = [
                pa.array(dims.ravel().astype(np.int32)),
                pa.array(factors.ravel().astype(np.int32)),
                pa.array(total.ravel()),
                pa.array(np.repeat(sz, k)),
                pa.array(np.tile(sv, d)),
                pa.array(np.full(d * k, n, dtype=np.int64)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["dim", "factor", "zv", "zz", "vv", "n"])

    schema = "dim int, factor int, zv double, zz double, vv double, n bigint"
    sums = (
        df.select(z, v)
        .mapInArrow(moments, schema)
        .groupBy("dim", "factor")
        .agg(*[F.sum(c).alias(c) for c in ("zv", "zz", "vv", "n")])
    )
    live = (F.col("zz") / F.col("n") > TINY**2) & (F.col("vv") / F.col("n") > TINY**2)
    return sums.select(
        "dim",
        "factor",
        F.when(live, F.col("zv") * F.col("zv") / (F.col("zz") * F.col("vv"))).otherwise(0.0).alias("r2"),
        (F.sqrt(F.col("vv") / F.col("n")) >= TINY).alias("varies"),
    )


def _array_means(df: DataFrame, column: str) -> np.ndarray:
    """Mean per position of an array column."""
    rows = vector_to_long(df, [], column).groupBy("dim").agg(F.avg("value").alias("m")).collect()
    out = np.zeros(len(rows))
    for row in rows:
        out[row["dim"]] = row["m"]
    return out


def sap_per_factor(r2: DataFrame) -> DataFrame:
    """``(factor, sap)``: gap of the two best squared correlations; null for a constant."""
    varies = r2.groupBy("factor").agg(F.bool_or("varies").alias("varies"))
    return (
        _gap(r2, "r2")
        .join(varies, "factor")
        .select("factor", F.when(F.col("varies"), F.col("gap")).alias("sap"))
    )


def axis_alignment(r2: DataFrame, by: Sequence[str] = ("factor",)) -> DataFrame:
    """``(factor, best_dim, best_r2)``: the first dimension of highest squared correlation."""
    place = Window.partitionBy(*by).orderBy(F.desc("r2"), "dim")
    return (
        r2.withColumn("_r", F.row_number().over(place))
        .where("_r = 1")
        .select(*by, F.col("dim").alias("best_dim"), F.col("r2").alias("best_r2"))
    )


def axis_labels(alignment: DataFrame) -> DataFrame:
    """``(best_dim, factor, best_r2)``: the best construct of each winning dimension."""
    place = Window.partitionBy("best_dim").orderBy(F.desc("best_r2"), "factor")
    return alignment.withColumn("_r", F.row_number().over(place)).where("_r = 1").drop("_r")


def summary(df: DataFrame, n_bins: int = N_BINS, z: str = "z", v: str = "v") -> DataFrame:
    """Per factor: mutual information gap, squared-correlation gap, best dimension and its R²."""
    joint = joint_counts(df, bin_edges(df, z, n_bins), bin_edges(df, v, n_bins), z, v)
    r2 = squared_correlations(df, z, v)
    return (
        mig_per_factor(joint).join(sap_per_factor(r2), "factor").join(axis_alignment(r2), "factor")
    )


def block_summary(df: DataFrame, width: int, n_bins: int = N_BINS, z: str = "z", v: str = "v") -> DataFrame:
    """``summary`` of many codes of ``width`` dimensions that stand one after another in ``z``, as ``(block, factor, …)``.

    All blocks share the passes over the rows.
    """

    def in_block(scores: DataFrame) -> DataFrame:
        return scores.withColumn("block", F.floor(F.col("dim") / width).cast("int")).withColumn("dim", F.col("dim") % width)

    by = ["block", "factor"]
    joint = materialise(joint_counts(df, bin_edges(df, z, n_bins), bin_edges(df, v, n_bins), z, v))
    r2 = materialise(in_block(squared_correlations(df, z, v)))
    mi = in_block(mutual_information(joint, ["dim", "factor"], "zb", "vb"))
    mig = _gap(mi, "mi", by).withColumnRenamed("gap", "_mig").join(factor_entropy(joint), "factor")
    varies = r2.groupBy(*by).agg(F.bool_or("varies").alias("varies"))
    sap = _gap(r2, "r2", by).withColumnRenamed("gap", "_sap").join(varies, by)
    return (
        mig.join(sap, by)
        .join(axis_alignment(r2, by), by)
        .select(
            *by,
            F.when(F.col("h") >= TINY, F.col("_mig") / F.col("h")).alias("mig"),
            F.when(F.col("varies"), F.col("_sap")).alias("sap"),
            "best_dim",
            "best_r2",
        )
    )


def overall(per_factor: DataFrame) -> DataFrame:
    """Mean gaps over the factors that have one."""
    return per_factor.agg(F.avg("mig").alias("mig"), F.avg("sap").alias("sap"))

