"""Metrics of scored rows: binary ranking, top-k and one-vs-rest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buyerlens.functions.frames import ratio
from buyerlens.plans.ordered import running_totals


def score_counts(scored: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Positives and rows per distinct score; rows without a label are left out.

    Equal scores become one row before any ordering, so heavy ties cost nothing.
    """
    return (
        scored.where(F.col(label).isNotNull() & F.col(score).isNotNull())
        .groupBy(*by, F.col(score).cast("double").alias("score"))
        .agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("n"))
    )


def binary_metrics(
    scored: DataFrame,
    label: str = "y",
    score: str = "score",
    by: Sequence[str] = (),
    k_frac: float = 0.10,
) -> DataFrame:
    """ROC-AUC, average precision, precision at ``k_frac`` and base rate per group.

    Ties count half in the AUC; average precision steps at distinct scores; at the boundary of
    the top fraction, tied rows contribute their expected positives. Groups with one class only
    have no AUC.
    """
    by = list(by)
    counts = score_counts(scored, label, score, by)
    rows = running_totals(counts, "score", ["pos", "n"], by, descending=True)
    pos, n, cum_pos, cum_n = (F.col(c).cast("double") for c in ("pos", "n", "cum_pos", "cum_n"))
    total, rows_n = F.col("all_pos").cast("double"), F.col("all_n").cast("double")
    neg = n - pos
    neg_below = (rows_n - total) - (cum_n - cum_pos)
    slots = F.greatest(F.lit(1.0), F.bround(rows_n * k_frac).cast("double"))
    taken = F.greatest(F.lit(0.0), F.least(n, slots - (cum_n - n)))
    name = f"prec_at_{int(k_frac * 100)}pct"
    return (
        rows.groupBy(*by)
        .agg(
            F.sum(pos * (neg_below + neg / 2.0)).alias("_u"),
            F.sum(pos * cum_pos / cum_n).alias("_ap"),
            F.sum(taken * pos / n).alias("_hits"),
            F.max(slots).alias("_slots"),
            F.max(total).alias("_all_pos"),
            F.max(rows_n).alias("_all_n"),
        )
        .select(
            *by,
            ratio(F.col("_u"), F.col("_all_pos") * (F.col("_all_n") - F.col("_all_pos"))).alias("roc_auc"),
            ratio(F.col("_ap"), F.col("_all_pos")).alias("pr_auc"),
            (F.col("_hits") / F.col("_slots")).alias(name),
            (F.col("_all_pos") / F.col("_all_n")).alias("base_rate"),
        )
    )


def true_class_rank(proba: str, true_class: str):
    """0-based rank of the true class in a probability row; on ties the higher index wins.

    A class outside the row never ranks: the result is then the number of classes.
    """
    p = F.col(proba)
    known = F.col(true_class).between(0, F.size(p) - 1)
    own = F.get(p, F.col(true_class))
    better = F.filter(p, lambda x: x > own)
    later_ties = F.filter(
        F.transform(p, lambda x, i: (x == own) & (i > F.col(true_class))), lambda hit: hit
    )
    return F.when(known, F.size(better) + F.size(later_ties)).otherwise(F.size(p))


def multiclass_metrics(
    scored: DataFrame,
    label: str = "y",
    proba: str = "proba",
    by: Sequence[str] = (),
    top_ks: Sequence[int] = (1, 3, 5),
    n_classes: int | None = None,
) -> DataFrame:
    """Top-k accuracy, macro one-vs-rest AUC, majority rate and class count per group.

    A class outside the probability row is never a hit, however large k is.
    """
    by = list(by)
    kept = scored.where(F.col(label).isNotNull()).withColumn("_rank", true_class_rank(proba, label))
    size = F.size(proba) if n_classes is None else F.lit(n_classes)
    known = F.col(label).between(0, size - 1)
    per_class = (
        kept.groupBy(*by, F.when(known, F.col(label)).alias("_class"))
        .agg(
            F.count("*").alias("_n"),
            F.max(size).alias("_size"),
            *[F.count_if(known & (F.col("_rank") < k)).alias(f"_hit_{k}") for k in top_ks],
        )
        .groupBy(*by)
        .agg(
            F.sum("_n").alias("_all_n"),
            F.max(F.when(F.col("_class").isNotNull(), F.col("_n"))).alias("_top"),
            F.max("_size").cast("bigint").alias("n_classes"),
            *[F.sum(f"_hit_{k}").alias(f"_hit_{k}") for k in top_ks],
        )
    )
    auc = one_vs_rest_auc(kept, label, proba, by)
    macro = auc.groupBy(*by).agg(F.avg("roc_auc").alias("macro_ovr_auc"))
    out = per_class.select(
        *by,
        ratio(F.col("_top"), F.col("_all_n")).alias("base_rate"),
        "n_classes",
        *[ratio(F.col(f"_hit_{k}"), F.col("_all_n")).alias(f"acc_at_{k}") for k in top_ks],
    )
    if by:
        return out.join(macro, by, "left")
    return out.withColumn("macro_ovr_auc", macro.scalar())


def one_vs_rest_auc(
    scored: DataFrame, label: str, proba: str, by: Sequence[str] = ()
) -> DataFrame:
    """AUC of each class's own probability column; null where a class is absent or alone."""
    long = scored.select(
        *by, F.col(label).alias("_y"), F.posexplode(proba).alias("class", "score")
    ).withColumn("_hit", (F.col("_y") == F.col("class")).cast("int"))
    return binary_metrics(long, "_hit", "score", [*by, "class"]).select(*by, "class", "roc_auc")


def base_rates(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of the largest class per group and its size."""
    counts = df.where(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count("*").alias("n"))
    return counts.groupBy(*by).agg(
        F.max("n").alias("largest"),
        ratio(F.max("n"), F.sum("n")).alias("majority_rate"),
    )


def r2_scores(long: DataFrame, truth: str = "y", predicted: str = "p") -> DataFrame:
    """R² per construct from ``(name, truth, predicted)`` rows, in one pass.

    Sums are taken around each construct's first-pass mean for numerical safety.
    """
    means = long.groupBy("name").agg(F.avg(truth).alias("_m"))
    err, dev = F.col(truth) - F.col(predicted), F.col(truth) - F.col("_m")
    return (
        long.join(means, "name")
        .groupBy("name")
        .agg(F.sum(err * err).alias("_e"), F.sum(dev * dev).alias("_d"))
        .select("name", (1.0 - ratio(F.col("_e"), F.col("_d"))).alias("r2"))
    )


def r2_summary(scores: DataFrame, rfm: Sequence[str]) -> DataFrame:
    """Mean R² over all constructs and over the recency, frequency, monetary ones."""
    return scores.agg(
        F.avg("r2").alias("r2_mean"),
        F.avg(F.when(F.col("name").isin(*rfm), F.col("r2"))).alias("r2_rfm_mean"),
    )
