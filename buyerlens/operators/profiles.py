"""Column profiles, event mix, daily purchases and split prevalence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from buyerlens.plans.ordered import counted_quantiles
from buyerlens.session import materialise


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, nulls, distinct values, minimum, maximum, mean and 99th percentile per column.

    Each column is read alone and its values are counted in their own type, so what is shuffled is
    a column's distinct values and never a row. Mean, minimum, maximum and percentile are given for numeric columns only.
    """
    kinds = {f.name: isinstance(f.dataType, T.NumericType) for f in df.schema.fields}

    def counted(c: str) -> DataFrame:
        return df.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n"))

    def summary(values: DataFrame, name: Column, numeric: bool, *by: str) -> DataFrame:
        known = F.col("value").isNotNull()
        number = F.col("value") if numeric else F.lit(None).cast("double")
        return values.groupBy(*by).agg(
            F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_rows"),
            F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).cast("bigint").alias("nulls"),
            F.count_if(known).alias("distinct"),
            F.min(number).alias("min"),
            F.max(number).alias("max"),
            F.try_divide(
                F.sum(number * F.col("n")), F.sum(F.when(number.isNotNull(), F.col("n"))).cast("double")
            ).alias("mean"),
        ).select(name.alias("name"), "n_rows", "nulls", "distinct", "min", "max", "mean")

    others = [summary(counted(c), F.lit(c), False) for c in columns if not kinds[c]]
    numeric = [
        counted(c).select(F.lit(c).alias("name"), F.col("value").cast("double").alias("value"), "n")
        for c in columns if kinds[c]
    ]
    if not numeric:
        return reduce(DataFrame.unionAll, others).withColumn("p99", F.lit(None).cast("double"))
    stored = materialise(reduce(DataFrame.unionAll, numeric))
    high = counted_quantiles(
        stored.where("value IS NOT NULL").groupBy("name", "value").agg(F.sum("n").alias("n")), [0.99]
    ).select("name", F.col("q").alias("p99"))
    numbers = summary(stored, F.col("name"), True, "name").join(high, "name", "left")
    return reduce(DataFrame.unionAll, [numbers, *[o.withColumn("p99", F.lit(None).cast("double")) for o in others]])


def event_mix(log: DataFrame) -> DataFrame:
    """Count and share per event type."""
    counts = log.groupBy("event_type").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t")).scalar()
    return counts.withColumn("share", F.try_divide(F.col("n").cast("double"), total))


def daily_purchases(log: DataFrame) -> DataFrame:
    """Purchases per day and their ratio to the median day."""
    daily = (
        log.where(F.col("event_type") == "purchase")
        .groupBy(F.to_date("ts").alias("day"))
        .agg(F.count("*").alias("n"))
    )
    middle = daily.agg(F.percentile("n", F.lit(0.5)).alias("m")).scalar()
    return daily.withColumn("ratio_to_median", F.col("n") / middle)


def split_prevalence(split: DataFrame, labels: list[str]) -> DataFrame:
    """Rows per split and the mean of each label."""
    return split.groupBy("split").agg(
        F.count("*").alias("n"),
        *[F.avg(F.col(c).cast("double")).alias(f"rate_{c}") for c in labels],
    )
