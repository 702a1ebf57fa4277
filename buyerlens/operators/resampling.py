"""Stability of a clustering under resampling, and the bundle reported per configuration."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buyerlens.config import EvalConfig
from buyerlens.functions.keyed import uniform
from buyerlens.operators import stability
from buyerlens.operators.clusters import hard_assign, squared_distances
from buyerlens.operators.clustering_quality import clustering_metrics
from buyerlens.operators.kmeans import POISSON_ONE, Fit, fit_many
from buyerlens.plans.ordered import keyed_sample
from buyerlens.plans.partials import map_features
from buyerlens.session import materialise

def poisson_weight(id_column: str, seed: int, replicate: int) -> Column:
    """Poisson(1) weight of a row as a column, drawn from its key."""
    u = uniform(f"boot:{seed}:{replicate}", id_column)
    table = F.array(*[F.lit(p) for p in POISSON_ONE])
    return F.size(F.filter(table, lambda p: p <= u)).cast("double")


def bootstrap_scores(
    df: DataFrame,
    k: int,
    n_boot: int = 20,
    seed: int = 0,
    n_init: int = 10,
    id_column: str = "id",
    features: str = "z",
) -> DataFrame:
    """``(replicate, ari)`` of refits on resamples against the reference partition.

    Rows are never copied: a resample is a weight per row, drawn in the task, and all refits and starts move in the
    same passes. The refits label the full population in one pass, and agreement is one grouped count.
    """
    if n_boot < 1:
        raise ValueError("n_boot must be >= 1")
    centers = fit_many(df, bootstrap_fits(k, n_boot, seed), n_init, features, id_column=id_column)
    return _agreement(df, centers, features)


def bootstrap_fits(k: int, n_boot: int, seed: int, part: int = 0) -> list[Fit]:
    """The reference partition, then one fit per resample, each with a seed of its own."""
    return [Fit(k, seed, None, part), *[Fit(k, seed + 1 + b, b, part) for b in range(n_boot)]]


def _agreement(df: DataFrame, centers: list[np.ndarray], features: str) -> DataFrame:
    """``(replicate, ari)`` of the refits' labels of all rows against the first centres' labels."""

    def label(x):
        return np.column_stack([np.argmin(squared_distances(x, c), axis=1) for c in centers]).astype(float)

    labels = map_features(df, [], label, "_l", features)
    cells = labels.select(
        F.col("_l")[0].alias("a"),
        F.posexplode(F.slice("_l", 2, len(centers) - 1)).alias("replicate", "b"),
    )
    counted = cells.groupBy("replicate", "a", "b").agg(F.count("*").alias("n"))
    return stability.adjusted_rand(counted, ["replicate"])


def bootstrap_persistence(scores: DataFrame) -> DataFrame:
    """Mean and sample deviation over replicates; one replicate has deviation 0."""
    return scores.agg(
        F.count("*").alias("n_boot"),
        F.avg("ari").alias("ari_mean"),
        F.coalesce(F.stddev_samp("ari"), F.lit(0.0)).alias("ari_std"),
    )


def stability_bundle(
    embeddings: Callable[[int], DataFrame | None],
    seeds: Sequence[int],
    cfg: EvalConfig,
) -> DataFrame | None:
    """Cross-seed agreement, mean clustering quality and bootstrap persistence of one
    configuration, all over the same ids: all, or a seed-independent sample.

    ``embeddings(seed)`` gives ``(id, z)`` or None; with a seed missing the configuration is
    skipped with a warning.
    """
    made = {s: embeddings(s) for s in seeds}
    frames = {s: df if df is None else materialise(df.select("id", "z")) for s, df in made.items()}  # encoded once
    missing = [s for s, df in frames.items() if df is None]
    if missing:
        warnings.warn(f"stability skipped, no embedding for seeds {missing}", stacklevel=2)
        return None
    universe = stability.same_universe(frames, "id").where("extra > 0 OR lacking > 0")
    if not universe.isEmpty():
        raise ValueError("user universes differ across seeds")
    sampled = {
        s: df if cfg.stability_users is None else materialise(keyed_sample(df, "id", cfg.stability_seed, cfg.stability_users))
        for s, df in sorted(frames.items())
    }
    # one stack: the fit of every seed, and the resamples of the first
    first, *others = sampled
    fits = [*bootstrap_fits(cfg.n_clusters, cfg.n_boot, first, first), *[Fit(cfg.n_clusters, s, None, s) for s in others]]
    together = None
    for seed, df in sampled.items():
        rows = df.select("id", "z", F.lit(seed).alias("seed"))
        together = rows if together is None else together.unionByName(rows)
    centers = fit_many(together, fits, cfg.n_init, "z", part="seed")
    boot = bootstrap_persistence(_agreement(sampled[first], centers[: 1 + cfg.n_boot], "z"))
    assigned, quality = None, None
    for seed, own in zip(sampled, [centers[0], *centers[1 + cfg.n_boot :]], strict=True):
        labelled = materialise(hard_assign(sampled[seed], own, ["id", "z"], features="z"))
        scores = clustering_metrics(labelled, "cluster", "z")
        rows = labelled.select("id", "cluster", F.lit(seed).alias("seed"))
        assigned = rows if assigned is None else assigned.unionByName(rows)
        quality = scores if quality is None else quality.unionByName(scores)
    means = quality.agg(
        *[F.avg(c).alias(c) for c in ("silhouette_squared", "davies_bouldin", "calinski_harabasz")]
    )
    agreement = stability.pairwise_stability(assigned, "id", list(frames))
    people = assigned.agg(F.count_distinct("id")).scalar()
    return (
        agreement.withColumn("_q", means.select(F.struct("*").alias("q")).scalar())
        .withColumn("_b", boot.select(F.struct("*").alias("b")).scalar())
        .select(
            "*",
            "_q.*",
            F.col("_b.n_boot").alias("n_boot"),
            F.col("_b.ari_mean").alias("boot_ari_mean"),
            F.col("_b.ari_std").alias("boot_ari_std"),
        )
        .drop("_q", "_b")
        .withColumn("n_users", people)
    )
