"""Agreement of persona assignments across seeds and resamples."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buyerlens.functions.frames import ratio
from buyerlens.operators.interpretability import entropy, mutual_information


def contingency(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Cell counts ``(by, a, b, n)`` of two partitions of the same rows."""
    return df.groupBy(*by, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def _pairs(n):
    n = n.cast("double")
    return n * (n - 1.0) / 2.0


def adjusted_rand(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Adjusted Rand index per group; 1 when both partitions are trivial."""
    keys = list(by)
    inner = cells.groupBy(*keys).agg(F.sum(_pairs(F.col("n"))).alias("_ij"), F.sum("n").alias("_n"))

    def margin(side: str, name: str) -> DataFrame:
        sizes = cells.groupBy(*keys, side).agg(F.sum("n").alias("_m"))
        return sizes.groupBy(*keys).agg(F.sum(_pairs(F.col("_m"))).alias(name))

    expected = F.coalesce(ratio(F.col("_a") * F.col("_b"), _pairs(F.col("_n"))), F.lit(0.0))
    best = (F.col("_a") + F.col("_b")) / 2.0
    return (
        inner.join(margin("a", "_a"), keys)
        .join(margin("b", "_b"), keys)
        .select(
            *keys,
            F.when(best == expected, 1.0)
            .otherwise(ratio(F.col("_ij") - expected, best - expected))
            .alias("ari"),
        )
    )


def normalised_mi(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mutual information over the mean of both entropies; 1 when both are trivial."""
    keys = list(by)
    mi = mutual_information(cells, keys, "a", "b")
    ha = entropy(cells.groupBy(*keys, "a").agg(F.sum("n").alias("n")), keys)
    hb = entropy(cells.groupBy(*keys, "b").agg(F.sum("n").alias("n")), keys)
    mean = (F.col("_ha") + F.col("_hb")) / 2.0
    return (
        mi.join(ha.withColumnRenamed("h", "_ha"), keys)
        .join(hb.withColumnRenamed("h", "_hb"), keys)
        .select(
            *keys,
            F.when(mean <= 0, 1.0).otherwise(ratio(F.greatest(F.col("mi"), F.lit(0.0)), mean)).alias("nmi"),
        )
    )


def seed_pairs(
    assignments: DataFrame, id_column: str, seeds: Sequence[int], by: Sequence[str] = ()
) -> DataFrame:
    """Cell counts of every seed pair from ``(by, id, seed, cluster)`` rows.

    Ids become one row of clusters by seed, equal rows are counted once, and only the distinct
    rows meet the seed pairs; ids are never joined to each other. An id missing under some seed
    is an error, since pairs must describe the same items.
    """
    wide = assignments.groupBy(*by, id_column).agg(
        *[F.max(F.when(F.col("seed") == s, F.col("cluster"))).alias(f"s{i}") for i, s in enumerate(seeds)]
    )
    names = [f"s{i}" for i in range(len(seeds))]
    lacking = F.array_contains(F.array(*[F.col(c).isNull() for c in names]), True)
    counted = (
        wide.withColumn(
            "s0",
            F.when(
                lacking, F.raise_error(F.lit("assignment lengths differ across seeds"))
            ).otherwise(F.col("s0")),
        )
        .groupBy(*by, *names)
        .agg(F.count("*").alias("n"))
    )
    cells = [
        F.struct(
            F.lit(seeds[i]).alias("seed_a"),
            F.lit(seeds[j]).alias("seed_b"),
            F.col(f"s{i}").alias("a"),
            F.col(f"s{j}").alias("b"),
        )
        for i, j in combinations(range(len(seeds)), 2)
    ]
    return (
        counted.select(*by, "n", F.inline(F.array(*cells)))
        .groupBy(*by, "seed_a", "seed_b", "a", "b")
        .agg(F.sum("n").alias("n"))
    )


def pair_scores(
    assignments: DataFrame, id_column: str, seeds: Sequence[int], by: Sequence[str] = ()
) -> DataFrame:
    """Adjusted Rand index and normalised mutual information of every seed pair."""
    keys = [*by, "seed_a", "seed_b"]
    cells = seed_pairs(assignments, id_column, seeds, by)
    return adjusted_rand(cells, keys).join(normalised_mi(cells, keys), keys)


def pairwise_stability(
    assignments: DataFrame, id_column: str, seeds: Sequence[int], by: Sequence[str] = ()
) -> DataFrame:
    """Mean and sample deviation over seed pairs; a lone seed has no pairs and no scores."""
    seeds = sorted(seeds)
    if len(seeds) < 2:
        none = F.lit(None).cast("double")
        return assignments.groupBy(*by).agg(
            F.lit(len(seeds)).cast("bigint").alias("n_seeds"),
            F.lit(0).cast("bigint").alias("n_pairs"),
            *[none.alias(c) for c in ("ari_mean", "ari_std", "nmi_mean", "nmi_std")],
        )
    return (
        pair_scores(assignments, id_column, seeds, by)
        .groupBy(*by)
        .agg(
            F.lit(len(seeds)).cast("bigint").alias("n_seeds"),
            F.count("*").alias("n_pairs"),
            F.avg("ari").alias("ari_mean"),
            F.coalesce(F.stddev_samp("ari"), F.lit(0.0)).alias("ari_std"),
            F.avg("nmi").alias("nmi_mean"),
            F.coalesce(F.stddev_samp("nmi"), F.lit(0.0)).alias("nmi_std"),
        )
    )


def same_universe(frames: dict[int, DataFrame], id_column: str) -> DataFrame:
    """Per seed: its ids, ids absent from the first seed, and ids of the first it lacks."""
    first = min(frames)
    tagged = None
    for seed, df in frames.items():
        part = df.select(F.col(id_column).alias("id"), F.lit(seed).alias("seed")).distinct()
        tagged = part if tagged is None else tagged.unionByName(part)
    held = tagged.groupBy("id").agg(F.collect_set("seed").alias("seeds"))
    wanted = F.array(*[F.lit(s) for s in sorted(frames)])
    rows = held.select(
        F.explode(wanted).alias("seed"),
        "seeds",
        F.array_contains("seeds", first).alias("in_first"),
    ).withColumn("held", F.array_contains("seeds", F.col("seed")))
    return rows.groupBy("seed").agg(
        F.count_if("held").alias("n"),
        F.count_if(F.col("held") & ~F.col("in_first")).alias("extra"),
        F.count_if(~F.col("held") & F.col("in_first")).alias("lacking"),
    )
