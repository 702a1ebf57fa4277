"""Paired tests over shared seeds."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from buyerlens.functions.frames import ratio
from buyerlens.operators.records import best_baselines, clean

RTOL, ATOL = 1e-5, 1e-8  # closeness of two series that counts as equal


def student_two_sided(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t for whole degrees of freedom, as a finite series."""
    theta = F.atan(F.abs(t) / F.sqrt(df))
    sin, cos = F.sin(theta), F.cos(theta)
    odd = df % 2 == 1
    terms = F.floor((df - F.when(odd, 1).otherwise(0)) / 2).cast("int")

    def step(acc, k):
        grow = F.when(odd, 2.0 * k / (2.0 * k + 1.0)).otherwise((2.0 * k - 1.0) / (2.0 * k))
        term = acc["term"] * grow * cos * cos
        return F.struct((acc["sum"] + term).alias("sum"), term.alias("term"))

    first = F.when(odd, cos).otherwise(F.lit(1.0))
    start = F.struct(first.alias("sum"), first.alias("term"))
    more = F.when(terms > 1, F.sequence(F.lit(1), terms - 1)).otherwise(F.array().cast("array<int>"))
    series = F.aggregate(more, start, step)["sum"]
    inside = (
        F.when(odd & (df == 1), theta * 2.0 / np.pi)
        .when(odd, (theta + sin * series) * 2.0 / np.pi)
        .otherwise(sin * series)
    )
    return F.greatest(F.lit(0.0), 1.0 - inside)


def exact_signed_rank(differences: np.ndarray) -> float | None:
    """Two-sided exact p-value of the signed-rank test; zeros dropped, ties share mean ranks."""
    d = differences[differences != 0]
    if not len(d):
        return None
    size = np.abs(d)
    ranks = np.array([(size < x).sum() * 2 + (size == x).sum() + 1 for x in size])  # doubled
    ways = np.zeros(ranks.sum() + 1)
    ways[0] = 1.0
    for k in ranks:
        ways[k:] = ways[k:] + ways[: len(ways) - k]
    w = int(ranks[d > 0].sum())
    tail = min(ways[: w + 1].sum(), ways[w:].sum()) / 2.0 ** len(d)
    return min(1.0, 2.0 * tail)


@F.pandas_udf(T.DoubleType())
def signed_rank_p(differences: pd.Series) -> pd.Series:
    return pd.Series([exact_signed_rank(np.asarray(d, dtype=float)) for d in differences])


def paired_tests(pairs: DataFrame, by: Sequence[str] = (), equal_p: float | None = 1.0) -> DataFrame:
    """Signed-rank and t-test of ``(by, seed, a, b)`` rows.

    Fewer than two seeds have no p-values; series that agree within rounding get ``equal_p``.
    A group's differences are one short array, as long as the number of seeds.
    """
    a, b = F.col("a"), F.col("b")
    diff = a - b
    stats = pairs.where(a.isNotNull() & b.isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n_seeds"),
        F.avg(a).alias("mean_a"),
        F.avg(b).alias("mean_b"),
        F.avg(diff).alias("_m"),
        F.stddev_samp(diff).alias("_s"),
        F.bool_and(F.abs(diff) <= ATOL + RTOL * F.abs(b)).alias("_equal"),
        F.sort_array(F.collect_list(diff)).alias("_d"),
    )
    n = F.col("n_seeds")
    t = ratio(F.col("_m"), F.col("_s") / F.sqrt(n))
    t_p = F.when(F.col("_s") == 0, 0.0).otherwise(student_two_sided(t, n - 1))
    equal = F.lit(equal_p).cast("double")

    def ruled(p):
        return F.when(n < 2, None).when(F.col("_equal"), equal).otherwise(p)

    return stats.withColumn("_w", signed_rank_p("_d")).select(
        *by,
        "n_seeds",
        "mean_a",
        "mean_b",
        F.when(n >= 2, F.pow(F.lit(2.0), 1 - n)).alias("wilcoxon_floor"),
        ruled(F.col("_w")).alias("wilcoxon_p"),
        ruled(t_p).alias("ttest_p"),
    )


def significance_vs_best(
    records: DataFrame, metric: str = "pr_auc", head: str = "gbt", exclude: Sequence[str] = ("raw",)
) -> DataFrame:
    """Every method of every task against the task's best; near-equal series have no p-value."""
    chosen = records.where((F.col("head") == head) & (F.col("metric") == metric))
    best = best_baselines(records, metric, head, exclude, last_resort=True).select(
        "task", F.col("method").alias("best_method"), F.col("mean").alias("best_mean")
    )
    named = chosen.join(best, "task")
    bar = named.where("method = best_method").select("task", "seed", clean().alias("a"))
    others = named.where("method <> best_method").select(
        "task", "method", "best_method", "best_mean", "seed", clean().alias("b")
    )
    by = ["task", "method", "best_method", "best_mean"]
    return paired_tests(others.join(bar, ["task", "seed"]), by, None).drop("mean_a").withColumnRenamed(
        "mean_b", "mean"
    )


def task_comparison(
    sweep: DataFrame, baselines: DataFrame, specs: Sequence[tuple[str, str, str]], head: str
) -> DataFrame:
    """Per (task, metric): chosen sweep point against the task's strongest baseline.

    ``sweep`` holds ``(seed, metric, value)`` of the chosen point; ``specs`` name the task, its
    baseline metric and the flat sweep metric.
    """
    spec = sweep.sparkSession.createDataFrame(list(specs), "task string, metric string, flat string")
    mine = sweep.select("seed", F.col("metric").alias("flat"), clean().alias("a")).join(spec, "flat")
    rows = baselines.where(F.col("head") == head).join(spec, ["task", "metric"])
    best = None
    for metric in dict.fromkeys(s[1] for s in specs):
        part = best_baselines(rows, metric, head).withColumn("metric", F.lit(metric))
        best = part if best is None else best.unionByName(part)
    bar = rows.join(best.select("task", "metric", "method"), ["task", "metric", "method"]).select(
        "task", "metric", F.col("method").alias("best_baseline"), "seed", clean().alias("b")
    )
    tests = paired_tests(
        mine.join(bar, ["task", "metric", "seed"]), ["task", "metric", "best_baseline"]
    )
    return tests.withColumn("delta", F.col("mean_a") - F.col("mean_b"))
