"""Pareto set, sweet spot and the tables built around the chosen grid point.

Frames hold grid points, so they are as small as the configured grid.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

POINT = ("beta", "lambda_align")


def pareto_frontier(points: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Points no other point beats on both axes; points missing either value are dropped.

    A point stays if it has the highest ``y`` of its ``x`` and every larger ``x`` has a lower
    one: one sorted pass instead of comparing all pairs.
    """
    known = points.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ridge = known.groupBy(*by, x).agg(F.max(y).alias("_top"))
    group = list(by) or [F.lit(0)]
    beyond = (
        Window.partitionBy(*group).orderBy(F.desc(x)).rowsBetween(Window.unboundedPreceding, -1)
    )
    ridge = ridge.withColumn("_beyond", F.max("_top").over(beyond))
    return (
        known.join(ridge, [*by, x])
        .where((F.col(y) == F.col("_top")) & (F.col("_beyond").isNull() | (F.col(y) > F.col("_beyond"))))
        .drop("_top", "_beyond")
    )


def sweet_spots(
    points: DataFrame, x: str, y: str, slack: str, by: Sequence[str] = ()
) -> DataFrame:
    """Per group: the frontier point of highest ``x`` whose ``y`` is within the slack of the best.

    The slack is that of the best point. Without an eligible frontier point the best one is
    taken. Ties go to the lowest (beta, lambda).
    """
    group = list(by) or [F.lit(0)]
    first = Window.partitionBy(*group).orderBy(F.desc(y), *POINT)
    best = (
        points.where(F.col(y).isNotNull())
        .withColumn("_r", F.row_number().over(first))
        .where("_r = 1")
        .select(
            *by,
            *[F.col(p).alias(f"best_{p}") for p in POINT],
            F.col(x).alias("_best_x"),
            F.col(y).alias("best_y"),
            F.coalesce(F.col(slack), F.lit(0.0)).alias("y_slack"),
        )
    )
    front = pareto_frontier(points, x, y, by).select(*by, *POINT, x, y)
    tag = list(by)
    if not tag:
        best, front, tag = best.withColumn("_g", F.lit(0)), front.withColumn("_g", F.lit(0)), ["_g"]
    joined = best.join(front.withColumns({"_x": F.col(x), "_y": F.col(y)}).drop(x, y), tag, "left")
    ok = F.col("_y") >= F.col("best_y") - F.col("y_slack")
    size = F.count("_y").over(Window.partitionBy(*tag))
    pick = Window.partitionBy(*tag).orderBy(
        F.coalesce(ok, F.lit(False)).desc(), F.desc("_x"), *POINT
    )
    chosen = (
        joined.withColumns(
            {
                "fallback_used": ~F.coalesce(ok, F.lit(False)),
                "frontier_size": size,
                "_r": F.row_number().over(pick),
            }
        )
        .where("_r = 1")
    )
    back = F.col("fallback_used")
    return chosen.select(
        *by,
        *[F.when(back, F.col(f"best_{p}")).otherwise(F.col(p)).alias(p) for p in POINT],
        F.when(back, F.col("_best_x")).otherwise(F.col("_x")).alias("x"),
        F.when(back, F.col("best_y")).otherwise(F.col("_y")).alias("y"),
        "y_slack",
        *[f"best_{p}" for p in POINT],
        "best_y",
        "frontier_size",
        "fallback_used",
    )


def selection_metric(points: DataFrame, preferred: str, fallback: str) -> DataFrame:
    """Add ``sel_mean``, ``sel_std`` and ``selected_on``: the validation metric, or the test
    metric where no point has a validation value."""
    any_known = points.agg((F.count(f"{preferred}_mean") > 0).alias("k")).scalar()
    marked = points.withColumn("_k", any_known)
    return marked.select(
        *points.columns,
        *[
            F.when(F.col("_k"), F.col(f"{preferred}_{s}")).otherwise(F.col(f"{fallback}_{s}")).alias(f"sel_{s}")
            for s in ("mean", "std")
        ],
        F.when(F.col("_k"), preferred).otherwise(fallback).alias("selected_on"),
    )


def best_point(points: DataFrame, y: str) -> DataFrame:
    """The point of highest known ``y``."""
    return points.where(F.col(y).isNotNull()).orderBy(F.desc(y), *POINT).limit(1)


def ablation_points(points: DataFrame, sweet: DataFrame, y: str) -> DataFrame:
    """The chosen point, the best point without alignment, and the best aligned point at beta 1."""
    named = {
        "sweet_spot": points.join(sweet.select(*POINT), list(POINT), "left_semi"),
        "beta_vae": best_point(points.where(F.col("lambda_align") == 0), y),
        "vae_align": best_point(points.where((F.col("beta") == 1) & (F.col("lambda_align") > 0)), y),
    }
    out = None
    for name, rows in named.items():
        part = rows.withColumn("config", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def ablation_table(ablations: DataFrame, bar: DataFrame, metric: str) -> DataFrame:
    """Ablation rows next to the bar's ``(method, mean)``."""
    none = F.lit(None).cast("double")
    rows = ablations.select(
        "config",
        "beta",
        "lambda_align",
        F.col(f"{metric}_mean").alias("mean"),
        F.col(f"{metric}_std").alias("std"),
        F.col("mig_mean").alias("mig"),
        F.col("r2_mean_mean").alias("r2"),
    )
    return rows.unionByName(
        bar.select(
            F.concat(F.lit("bar ("), "method", F.lit(")")).alias("config"),
            none.alias("beta"),
            none.alias("lambda_align"),
            "mean",
            none.alias("std"),
            none.alias("mig"),
            none.alias("r2"),
        )
    )


def tradeoff_series(points: DataFrame, x: str, y: str) -> DataFrame:
    """One line per lambda over beta with both means and deviations; unknown ``x`` is dropped."""
    place = Window.partitionBy("lambda_align").orderBy("beta")
    return points.where(F.col(f"{x}_mean").isNotNull() & F.col(f"{y}_mean").isNotNull()).select(
        "lambda_align",
        F.row_number().over(place).alias("place"),
        "beta",
        F.col(f"{x}_mean").alias("x"),
        F.col(f"{x}_std").alias("x_err"),
        F.col(f"{y}_mean").alias("y"),
        F.col(f"{y}_std").alias("y_err"),
    )


def with_settings(
    points: DataFrame, multiples: Sequence[float], x_metrics: Sequence[str], y: str
) -> DataFrame:
    """Points once per (slack multiple, x metric), ready for :func:`sweet_spots` by both."""
    settings = [
        F.struct(
            F.lit(float(m)).alias("slack_multiple"),
            F.lit(n).alias("x_metric"),
            F.col(f"{n}_mean").alias("_x_value"),
            (F.col(f"{y}_std") * float(m)).alias("_slack"),
        )
        for m in multiples
        for n in x_metrics
    ]
    return points.select(*POINT, F.col(f"{y}_mean").alias("_y_value"), F.inline(F.array(*settings)))


def three_way(points: DataFrame, stability: DataFrame, y: str) -> DataFrame:
    """Downstream mean, alignment R² and cross-seed agreement per grid point."""
    keys = list(POINT)
    return points.select(*keys, F.col(f"{y}_mean").alias("downstream"), F.col("r2_mean_mean").alias("r2")).join(
        stability.select(*keys, "ari_mean"), keys, "left"
    )


def most_stable_within(points: DataFrame, y: str, slack: float) -> DataFrame:
    """The most stable point among those within ``slack`` of the best ``y``."""
    top = points.agg(F.max(y).alias("t")).scalar()
    near = points.withColumn("_t", top).where(F.col(y) >= F.col("_t") - slack)
    return near.orderBy(F.desc_nulls_last("ari_mean"), *POINT).limit(1).drop("_t")


def extra_positives(means: DataFrame, a: str, b: str, per: int = 10_000) -> DataFrame:
    """Additional positives per ``per`` targeted rows of method ``a`` over ``b``, per (task, head)."""

    def of(m: str):
        return F.max(F.when(F.col("method") == m, F.col("mean")))

    return means.groupBy("task", "head").agg(((of(a) - of(b)) * per).alias("extra_positives"))
