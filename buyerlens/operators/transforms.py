"""Transforms fitted on the training split and applied to every split.

A fit is an aggregate whose result has one row per column or level; it reaches the driver as
plain numbers and the transform is then a projection.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buyerlens.config import CustomerConfig
from buyerlens.functions.frames import to_long
from buyerlens.plans.ordered import exact_quantiles

MAX_LEVELS = 1_000


def train_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col("split") == "train")


def quantile_table(df: DataFrame, columns: list[str], probs: list[float]) -> DataFrame:
    """Exact quantiles of several columns as ``(name, prob, q)``."""
    return exact_quantiles(to_long(df, [], columns), probs).select("name", "prob", "q")


def fit_quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> dict:
    """``{column: [quantiles]}``; columns x probs numbers."""
    rows = quantile_table(df, columns, probs).collect()
    found = {(r["name"], r["prob"]): r["q"] for r in rows}
    return {c: [found.get((c, float(p))) for p in probs] for c in columns}


def moments_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and population standard deviation per column as ``(name, mean, scale)``.

    A zero deviation becomes scale 1.
    """
    one = df.agg(
        *[F.avg(F.col(f"`{c}`").cast("double")).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(F.col(f"`{c}`").cast("double")).alias(f"s{i}") for i, c in enumerate(columns)],
    )
    cells = [
        F.struct(
            F.lit(c).alias("name"),
            F.col(f"m{i}").alias("mean"),
            F.when(F.col(f"s{i}") == 0, 1.0).otherwise(F.col(f"s{i}")).alias("scale"),
        )
        for i, c in enumerate(columns)
    ]
    return one.select(F.inline(F.array(*cells)))


@dataclass(frozen=True)
class Scaler:
    """Train means and population deviations by column."""

    mean: dict[str, float]
    scale: dict[str, float]

    def column(self, name: str) -> Column:
        return (F.col(f"`{name}`").cast("double") - self.mean[name]) / self.scale[name]

    def inverse(self, name: str, z: Column) -> Column:
        return z * self.scale[name] + self.mean[name]

    def only(self, names: list[str]) -> Scaler:
        return Scaler({n: self.mean[n] for n in names}, {n: self.scale[n] for n in names})

    def apply(self, df: DataFrame, columns: list[str]) -> DataFrame:
        return df.withColumns({c: self.column(c) for c in columns})


def fit_scaler(df: DataFrame, columns: list[str]) -> Scaler:
    """Fit on the training rows of ``df``."""
    rows = moments_table(train_rows(df), columns).collect()
    if any(r["mean"] is None for r in rows):
        raise ValueError("the training split is empty or a column is all null")
    return Scaler({r["name"]: r["mean"] for r in rows}, {r["name"]: r["scale"] for r in rows})


def inverse_standardise(values: DataFrame, scaler: Scaler, name: str, value: str) -> DataFrame:
    """Long ``(name, value)`` rows back in raw units; unscaled names pass through."""
    scale = F.create_map(*[x for c, s in scaler.scale.items() for x in (F.lit(c), F.lit(s))])
    mean = F.create_map(*[x for c, m in scaler.mean.items() for x in (F.lit(c), F.lit(m))])
    return values.withColumn(
        "raw",
        F.col(value) * F.coalesce(F.element_at(scale, F.col(name)), F.lit(1.0))
        + F.coalesce(F.element_at(mean, F.col(name)), F.lit(0.0)),
    )


def fit_levels(df: DataFrame, columns: list[str]) -> dict[str, list[str]]:
    """Sorted training levels per categorical column; too many is an error, never a cut."""
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("level")) for c in columns])
    levels = train_rows(df).select(F.inline(cells)).where(F.col("level").isNotNull()).distinct()
    rows = levels.limit(MAX_LEVELS + 1).collect()
    if len(rows) > MAX_LEVELS:
        raise ValueError(f"more than {MAX_LEVELS} categorical levels: {columns}")
    return {c: sorted(r["level"] for r in rows if r["name"] == c) for c in columns}


def one_hot_columns(levels: dict[str, list[str]]) -> dict[str, Column]:
    """0/1 columns per training level; an unseen level is zero everywhere."""
    return {
        f"{c}_{v}": F.coalesce((F.col(c) == v).cast("double"), F.lit(0.0))
        for c, vs in levels.items()
        for v in vs
    }


@dataclass(frozen=True)
class Prepared:
    """A split, transformed frame ``(id, split, y…, features)`` and what was fitted for it."""

    frame: DataFrame
    features: list[str]
    scaler: Scaler
    fitted: dict = field(default_factory=dict)


def assemble(df: DataFrame, keep: list[str], columns: list[str]) -> DataFrame:
    """Feature columns to one array column in the given order."""
    return df.select(*keep, F.array(*[F.col(f"`{c}`").cast("double") for c in columns]).alias("features"))


def impute_and_winsorise(df: DataFrame, cfg: CustomerConfig) -> tuple[DataFrame, dict]:
    """Train medians fill nulls, then train quantiles bound the outlier columns."""
    numeric = list(cfg.numeric)
    medians = {c: q[0] for c, q in fit_quantiles(train_rows(df), numeric, [0.5]).items()}
    filled = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(medians[c])) for c in numeric})
    bounds = fit_quantiles(
        train_rows(filled), list(cfg.winsorised), [cfg.winsor_low, cfg.winsor_high]
    )
    bounded = filled.withColumns(
        {c: F.least(F.greatest(F.col(c), F.lit(lo)), F.lit(hi)) for c, (lo, hi) in bounds.items()}
    )
    return bounded, {"medians": medians, "bounds": bounds}


def prepare_customers(split: DataFrame, cfg: CustomerConfig) -> tuple[DataFrame, list[str], Scaler, dict]:
    """Impute, winsorise, standardise and one-hot encode; wide result with its column order."""
    bounded, fitted = impute_and_winsorise(split, cfg)
    scaler = fit_scaler(bounded, list(cfg.numeric))
    levels = fit_levels(bounded, list(cfg.categorical))
    hot = one_hot_columns(levels)
    wide = scaler.apply(bounded.withColumns(hot), list(cfg.numeric))
    return wide, [*cfg.numeric, *hot], scaler, {**fitted, "levels": levels}
