"""Silhouette, Davies-Bouldin and Calinski-Harabasz of a labelled embedding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buyerlens.functions.frames import ratio
from buyerlens.plans.ordered import keyed_sample
from buyerlens.plans.partials import array_column, matrix, vector
from buyerlens.session import materialise

MAX_CLUSTERS = 1_000
SILHOUETTE_ROWS = 20_000


def label_count(df: DataFrame, label: str) -> int:
    return df.select(label).distinct().count()


def silhouette(df: DataFrame, label: str, features: str) -> DataFrame:
    """Mean silhouette of all rows in squared Euclidean distance, as ``silhouette_squared``.

    A row's mean squared distance to a cluster follows from the cluster's size, mean and mean squared
    norm, so one pass sums those and a second scores the rows; no pair of rows is formed and none is left
    out. Null with fewer than two labels.
    """
    seen = F.struct(Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(features)).alias("s"))
    found = df.groupBy(label).agg(seen.alias("m")).limit(MAX_CLUSTERS + 1).collect()
    if len(found) > MAX_CLUSTERS:
        raise ValueError(f"more than {MAX_CLUSTERS} clusters")
    found.sort(key=lambda r: r[label])
    if len(found) < 2:
        return df.sparkSession.createDataFrame([(None,)], "silhouette_squared double")
    names = np.array([r[label] for r in found])
    sizes = np.array([r["m"]["s"]["count"] for r in found], dtype=np.float64)
    means = np.stack([r["m"]["s"]["mean"].toArray() for r in found])
    spread = np.stack([r["m"]["s"]["variance"].toArray() for r in found])  # of a sample
    middle = (means * sizes[:, None]).sum(axis=0) / sizes.sum()
    means = means - middle  # centred, so that the expanded square loses no digits
    norms = (means * means).sum(axis=1) + spread.sum(axis=1) * (sizes - 1) / sizes
    shared = df.sparkSession.sparkContext.broadcast((names, sizes, means, middle, norms))

    def score(batches):
        names, sizes, means, middle, norms = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x, mine = matrix(batch, features) - middle, np.searchsorted(names, vector(batch, label))
            row = np.arange(len(x))
            square = np.maximum((x * x).sum(axis=1)[:, None] + norms - 2.0 * x @ means.T, 0.0)
            others = sizes[mine] - 1.0
            a = np.divide(square[row, mine] * sizes[mine], others, out=np.zeros(len(x)), where=others > 0)
            square[row, mine] = np.inf
            b = square.min(axis=1)
            top = np.maximum(a, b)
            s = np.divide(b - a, top, out=np.zeros(len(x)), where=top > 0)
            yield pa.RecordBatch.from_arrays([pa.array(np.where(others > 0, s, 0.0))], ["s"])

    return df.select(label, features).mapInArrow(score, "s double").agg(F.avg("s").alias("silhouette_squared"))


def silhouette_euclidean(
    df: DataFrame,
    label: str,
    features: str,
    rows: int | None = SILHOUETTE_ROWS,
    seed: int = 0,
    id_column: str = "id",
    block_rows: int = 1_000,
) -> DataFrame:
    """Mean silhouette in Euclidean distance, of a seeded sample of ``rows`` rows, or of all rows where that is None.

    Points are dealt into blocks of about ``block_rows`` by a hash of their id. Every unordered pair of blocks meets in
    one task as two arrays, which adds up each point's distances per cluster; no pair of points becomes a row, and no
    block is sent anywhere but to its own tiles. Null with fewer than two labels; a cluster of one point counts 0.
    """
    points = df.select(F.col(id_column).alias("_id"), F.col(label).alias("_l"), F.col(features).alias("_x"))
    points = materialise(points if rows is None else keyed_sample(points, "_id", seed, rows))
    sizes = points.groupBy("_l").agg(F.count("*").alias("n")).limit(MAX_CLUSTERS + 1).collect()
    if len(sizes) > MAX_CLUSTERS:
        raise ValueError(f"more than {MAX_CLUSTERS} clusters")
    if len(sizes) < 2:
        return df.sparkSession.createDataFrame([(None,)], "silhouette double")
    names = np.array(sorted(r["_l"] for r in sizes))
    n_of = dict((r["_l"], r["n"]) for r in sizes)
    counts, k = np.array([n_of[v] for v in names], dtype=np.float64), len(sizes)
    blocks = max(1, -(-int(counts.sum()) // block_rows))
    own = F.pmod(F.xxhash64("_id", F.lit(seed)), F.lit(blocks)).cast("int")
    listed = F.sort_array(F.collect_list(F.struct("_id", "_l", "_x")))
    packed = materialise(
        points.groupBy(own.alias("block")).agg(listed.alias("_p")).select(
            "block", F.col("_p._l").alias("l"), F.flatten("_p._x").alias("x")
        )
    )
    upper = F.sequence(F.col("block"), F.lit(blocks - 1))
    lower = F.sequence(F.lit(0), F.col("block"))
    left = packed.select(F.col("block").alias("i"), F.explode(upper).alias("j"), F.col("l").alias("li"), F.col("x").alias("xi"))
    right = packed.select(F.explode(lower).alias("i"), F.col("block").alias("j"), F.col("l").alias("lj"), F.col("x").alias("xj"))
    tiles = left.join(right.hint("merge"), ["i", "j"])

    def measure(batches):
        for batch in batches:
            for i, j, li, xi, lj, xj in zip(*(batch.column(c) for c in range(6))):
                i, j = i.as_py(), j.as_py()
                a, b = (np.searchsorted(names, v.values.to_numpy()) for v in (li, lj))
                x, y = (v.values.to_numpy().reshape(len(m), -1) for v, m in ((xi, a), (xj, b)))
                if not len(a) or not len(b):
                    continue
                gap = np.stack([np.sqrt(((y - row) ** 2).sum(axis=1)) for row in x])
                sides = [(i, gap @ np.eye(k)[b])] + ([] if i == j else [(j, gap.T @ np.eye(k)[a])])
                for block, sums in sides:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block], pa.int32()), array_column(sums.reshape(1, -1))], ["block", "sums"]
                    )

    def score(batches):
        """Rows of a block, one after another: add its tiles, then score its points."""
        total: dict[int, np.ndarray] = {}
        labels: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, sums, l in zip(*(batch.column(c) for c in range(3))):
                if l.is_valid:
                    labels[block.as_py()] = np.searchsorted(names, l.values.to_numpy())
                else:
                    part = sums.values.to_numpy()
                    total[block.as_py()] = part if block.as_py() not in total else total[block.as_py()] + part
        for block, mine in labels.items():
            sums, row = total[block].reshape(-1, k), np.arange(len(mine))
            others = counts[mine] - 1.0
            a = np.divide(sums[row, mine], others, out=np.zeros(len(mine)), where=others > 0)
            means = sums / counts
            means[row, mine] = np.inf
            b = means.min(axis=1)
            top = np.maximum(a, b)
            s = np.divide(b - a, top, out=np.zeros(len(mine)), where=(top > 0) & (others > 0))
            yield pa.RecordBatch.from_arrays([pa.array([s.sum()]), pa.array([len(s)], pa.int64())], ["s", "n"])

    sums = tiles.select("i", "j", "li", "xi", "lj", "xj").mapInArrow(measure, "block int, sums array<double>")
    kind = packed.schema["l"].dataType
    with_labels = sums.select("block", "sums", F.lit(None).cast(kind).alias("l")).unionByName(
        packed.select("block", F.lit(None).cast("array<double>").alias("sums"), "l")
    )
    scored = with_labels.repartition("block").mapInArrow(score, "s double, n long")
    return scored.agg((F.sum("s") / F.sum("n")).alias("silhouette"))


def _centroid_rows(df: DataFrame, label: str, features: str) -> DataFrame:
    """``(label, dim, c, n)``: centroid coordinates and size per cluster."""
    long = df.select(label, F.posexplode(features).alias("dim", "x"))
    return long.groupBy(label, "dim").agg(F.avg("x").alias("c"), F.count("*").alias("n"))


def centroids(df: DataFrame, label: str, features: str) -> DataFrame:
    """One row per cluster: its size and centroid array."""
    cells = F.sort_array(F.collect_list(F.struct("dim", "c")))
    return (
        _centroid_rows(df, label, features)
        .groupBy(label)
        .agg(F.max("n").alias("n"), F.transform(cells, lambda e: e["c"]).alias("center"))
    )


def _distance2(a: str, b: str):
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x
    )


def checked_centroids(df: DataFrame, label: str, features: str) -> tuple[list, np.ndarray]:
    """Sorted labels and their centroids; clusterings of more than ``MAX_CLUSTERS`` are refused."""
    rows = centroids(df, label, features).limit(MAX_CLUSTERS + 1).collect()
    if len(rows) > MAX_CLUSTERS:
        raise ValueError(f"more than {MAX_CLUSTERS} clusters")
    rows.sort(key=lambda r: r[label])
    return [r[label] for r in rows], np.array([r["center"] for r in rows], dtype=np.float64)


def scatter(df: DataFrame, label: str, features: str, names: list, centers: np.ndarray) -> DataFrame:
    """``(label, s)``: mean distance to the own centroid, summed per task before any shuffle."""
    order = np.array(names)

    def measure(batches):
        sums, sizes = np.zeros(len(order)), np.zeros(len(order), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                own = np.searchsorted(order, vector(batch, label))
                gap = np.sqrt(((matrix(batch, features) - centers[own]) ** 2).sum(axis=1))
                sums += np.bincount(own, gap, len(order))
                sizes += np.bincount(own, minlength=len(order))
        live = np.nonzero(sizes)[0]
        if len(live):
            cols = [pa.array(live.astype(np.int32)), pa.array(sums[live]), pa.array(sizes[live])]
            yield pa.RecordBatch.from_arrays(cols, ["place", "s", "n"])

    parts = df.select(label, features).mapInArrow(measure, "place int, s double, n bigint")
    return parts.groupBy("place").agg((F.sum("s") / F.sum("n")).alias("s"))


def davies_bouldin(df: DataFrame, label: str, features: str) -> DataFrame:
    """Mean over clusters of the worst (scatter + scatter) / centroid distance.

    Pairs are pairs of clusters, never of rows. Null for fewer than two clusters.
    """
    names, centers = checked_centroids(df, label, features)
    spread = scatter(df, label, features, names, centers)
    table = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centers])
    listed = spread.agg(F.sort_array(F.collect_list(F.struct("place", "s"))).alias("o")).scalar()
    return (
        spread.withColumn("_o", listed)
        .select("place", "s", F.explode("_o").alias("o"))
        .where(F.col("place") != F.col("o.place"))
        .withColumn("_c", table)
        .withColumn("_a", F.get("_c", F.col("place")))
        .withColumn("_b", F.get("_c", F.col("o.place")))
        .withColumn("r", ratio(F.col("s") + F.col("o.s"), F.sqrt(_distance2("_a", "_b"))))
        .groupBy("place")
        .agg(F.max("r").alias("r"))
        .agg(F.avg("r").alias("davies_bouldin"))
    )


def calinski_harabasz(df: DataFrame, label: str, features: str) -> DataFrame:
    """Between over within dispersion, each by its degrees of freedom.

    Null for fewer than two clusters; 1 when nothing varies within clusters.
    """
    long = df.select(label, F.posexplode(features).alias("dim", "x"))
    cell = long.groupBy(label, "dim").agg(
        F.count("*").alias("n"), F.avg("x").alias("c"), F.var_pop("x").alias("v")
    )
    mean = cell.groupBy("dim").agg((F.sum(F.col("n") * F.col("c")) / F.sum("n")).alias("m"))
    sums = (
        cell.join(mean, "dim")
        .agg(
            F.sum(F.col("n") * F.pow(F.col("c") - F.col("m"), 2)).alias("between"),
            F.sum(F.col("n") * F.col("v")).alias("within"),
            F.count_distinct(label).alias("k"),
            F.sum(F.when(F.col("dim") == 0, F.col("n"))).alias("n"),
        )
    )
    value = ratio(
        F.col("between") * (F.col("n") - F.col("k")), F.col("within") * (F.col("k") - 1)
    )
    return sums.select(
        F.when(F.col("k") < 2, None)
        .when(F.col("within") == 0, 1.0)
        .otherwise(value)
        .alias("calinski_harabasz")
    )


def clustering_metrics(df: DataFrame, label: str, features: str) -> DataFrame:
    """All three scores and the number of clusters found; one cluster has no scores."""
    found = label_count(df, label)
    spark = df.sparkSession
    if found < 2:
        schema = (
            "silhouette_squared double, davies_bouldin double, calinski_harabasz double, "
            "n_clusters_found bigint"
        )
        return spark.createDataFrame([(None, None, None, found)], schema)
    return (
        silhouette(df, label, features)
        .withColumn("davies_bouldin", davies_bouldin(df, label, features).scalar())
        .withColumn("calinski_harabasz", calinski_harabasz(df, label, features).scalar())
        .withColumn("n_clusters_found", F.lit(found).cast("bigint"))
    )
