"""Aggregation, flattening and comparison of metric records.

Records are long: ``(task, method, head, seed, metric, value)`` for baselines and
``(beta, lambda_align, seed, metric, value)`` for the sweep; a missing value is null, never NaN.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("task", "method", "head", "seed")
POINT = ("beta", "lambda_align")


def clean(value: str = "value"):
    """NaN read as missing."""
    return F.when(~F.isnan(F.col(value)), F.col(value))


def complete_metrics(records: DataFrame, group: Sequence[str]) -> DataFrame:
    """Records of metrics that every seed of the group reports, with ``n_seeds``."""
    seeds = records.groupBy(*group).agg(F.count_distinct("seed").alias("n_seeds"))
    held = records.groupBy(*group, "metric").agg(F.count_distinct("seed").alias("_held"))
    whole = held.join(seeds, list(group)).where("_held = n_seeds").drop("_held")
    return records.join(whole, [*group, "metric"])


def aggregate(records: DataFrame) -> DataFrame:
    """Mean and sample deviation per (task, method, head, metric); a lone seed has deviation 0."""
    group = ["task", "method", "head"]
    return (
        complete_metrics(records, group)
        .groupBy(*group, "metric", "n_seeds")
        .agg(
            F.avg(clean()).alias("mean"),
            F.stddev_samp(clean()).alias("_std"),
        )
        .withColumn("std", F.when(F.col("n_seeds") > 1, F.col("_std")).otherwise(0.0))
        .drop("_std")
    )


def aggregate_sweep(records: DataFrame) -> DataFrame:
    """Mean and sample deviation per grid point; deviation 0 below two known values."""
    group = list(POINT)
    return (
        complete_metrics(records, group)
        .groupBy(*group, "metric", "n_seeds")
        .agg(
            F.avg(clean()).alias("mean"),
            F.coalesce(F.stddev_samp(clean()), F.lit(0.0)).alias("std"),
        )
    )


def points_wide(aggregated: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One row per grid point with ``<metric>_mean`` and ``<metric>_std`` columns."""
    cells = []
    for m in metrics:
        hit = F.col("metric") == m
        cells.append(F.max(F.when(hit, F.col("mean"))).alias(f"{m}_mean"))
        cells.append(F.max(F.when(hit, F.col("std"))).alias(f"{m}_std"))
    return aggregated.groupBy(*POINT).agg(F.max("n_seeds").alias("n_seeds"), *cells)


def flatten(records: DataFrame, head: str = "gbt") -> DataFrame:
    """Nested sweep records to ``(seed, beta, lambda_align, metric, value)`` rows.

    Primary metrics keep their names, other tasks prefix theirs, validation metrics read
    ``val_…``; alignment scores are null for runs without an alignment head.
    """
    keys = ["seed", "beta", "lambda_align"]
    tasks = records.select(*keys, F.explode("downstream").alias("task", "heads"))
    test = tasks.select(
        *keys, "task", F.explode(F.element_at("heads", F.lit(head))).alias("m", "value")
    ).select(
        *keys,
        F.when(F.col("task") == "primary", F.col("m"))
        .otherwise(F.concat("task", F.lit("_"), "m"))
        .alias("metric"),
        "value",
    )
    chosen = F.element_at(F.element_at("downstream_val", F.lit("primary")), F.lit(head))
    val = records.select(*keys, F.explode(chosen).alias("m", "value")).select(
        *keys, F.concat(F.lit("val_"), "m").alias("metric"), "value"
    )
    fixed = {
        "aligned_dims": F.col("aligned_dims").cast("double"),
        "mig": F.col("interpretability.mig"),
        "sap": F.col("interpretability.sap"),
        "r2_mean": F.col("alignment.r2_mean"),
        "r2_rfm_mean": F.col("alignment.r2_rfm_mean"),
        "kl_free": F.element_at("loss_final", F.lit("kl_free")),
    }
    cells = [F.struct(F.lit(n).alias("metric"), c.alias("value")) for n, c in fixed.items()]
    rest = records.select(*keys, F.inline(F.array(*cells)))
    return test.unionByName(val).unionByName(rest).withColumn("value", clean())


def at_point(sweep: DataFrame, beta: float, lambda_align: float, metric: str) -> DataFrame:
    """``(seed, value)`` of one metric at one grid point."""
    return sweep.where(
        (F.col("beta") == beta) & (F.col("lambda_align") == lambda_align) & (F.col("metric") == metric)
    ).select("seed", "value")


def of_method(records: DataFrame, method: str, head: str, metric: str, task: str = "primary") -> DataFrame:
    """``(seed, value)`` of one baseline."""
    return records.where(
        (F.col("method") == method)
        & (F.col("head") == head)
        & (F.col("metric") == metric)
        & (F.col("task") == task)
    ).select("seed", "value")


def best_baselines(
    records: DataFrame,
    metric: str,
    head: str,
    exclude: Sequence[str] = ("raw",),
    last_resort: bool = False,
) -> DataFrame:
    """Strongest method per task by mean; excluded methods count at most as a last resort."""
    means = (
        records.where((F.col("head") == head) & (F.col("metric") == metric))
        .groupBy("task", "method")
        .agg(F.avg(clean()).alias("mean"))
        .where(F.col("mean").isNotNull())
    )
    order = [F.col("method").isin(*exclude).asc(), F.desc("mean"), F.asc("method")]
    place = Window.partitionBy("task").orderBy(*order)
    if not last_resort:
        means = means.where(~F.col("method").isin(*exclude))
    return means.withColumn("_r", F.row_number().over(place)).where("_r = 1").drop("_r")


def shared_seeds(a: DataFrame, b: DataFrame, on: Sequence[str] = ("seed",)) -> DataFrame:
    """Values of two methods side by side where both have the seed."""
    return a.select(*on, F.col("value").alias("a")).join(b.select(*on, F.col("value").alias("b")), list(on))


def record_diff(
    new: DataFrame, ref: DataFrame, atol: float = 1e-9, rtol: float = 0.0
) -> DataFrame:
    """Differences of new records from the reference ones: absent key, absent metric, value.

    Two missing values are equal.
    """
    keys = list(KEYS)
    known = ref.select(*keys).distinct().withColumn("_key", F.lit(True))
    theirs = ref.select(*keys, "metric", clean().alias("ref_value"), F.lit(True).alias("_metric"))
    both = (
        new.select(*keys, "metric", clean().alias("value"))
        .join(known, keys, "left")
        .join(theirs, [*keys, "metric"], "left")
    )
    a, b = F.col("value"), F.col("ref_value")
    near = F.abs(a - b) <= F.greatest(rtol * F.greatest(F.abs(a), F.abs(b)), F.lit(atol))
    same = (a.isNull() & b.isNull()) | F.coalesce(near, F.lit(False))
    problem = (
        F.when(F.col("_key").isNull(), "absent key")
        .when(F.col("_metric").isNull(), "absent metric")
        .when(~same, "value")
    )
    return both.withColumn("problem", problem).where("problem IS NOT NULL").drop("_key", "_metric")


def top_changes(changes: DataFrame, by: str, name: str, delta: str, n: int = 8) -> DataFrame:
    """The ``n`` names of largest absolute change per group; names are features, so few."""
    place = Window.partitionBy(by).orderBy(F.desc(F.abs(F.col(delta))), name)
    return changes.withColumn("place", F.row_number().over(place)).where(F.col("place") <= n)
