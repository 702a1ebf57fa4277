"""Column profiles from mergeable sketches: a row per day and column, stored once and merged for any span of days.

A day's row holds exact counts, extremes and sums, a HyperLogLog sketch of the distinct values and a KLL sketch of the
quantiles. All columns of all days come from one scan; sketches are built in every task before the shuffle, which moves a row per
task and day, so a day with most of the log is no large group. A new day reads only itself, and a merged profile reads
no events.

Errors: distinct counts have a relative standard error of ``distinct_error()``; the value given for a quantile has a rank within
``rank_error()`` of it with probability 0.99. Sketches of few values are exact.

Defined cases: a null day is a day of its own; nulls of a column are counted and sketched nowhere; a column without values has 0
distinct values and no minimum, maximum, mean or quantile; an empty log adds no day; NaN is a value like any other to
the distinct count and is left out of extremes, means and quantiles.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DISTINCT_BITS = 14  # 2^14 registers, at most 16 KB a row
RANK_SIZE = 1000
MAX_DAYS = 50_000


def distinct_error(bits: int = DISTINCT_BITS) -> float:
    """Relative standard error of a merged HyperLogLog estimate."""
    return 1.04 / math.sqrt(2**bits)


def rank_error(size: int = RANK_SIZE) -> float:
    """Rank error of a KLL quantile, as a share of the values, held with probability 0.99."""
    return 2.296 / size**0.9723


def _hashable(column: Column, kind: T.DataType) -> Column:
    """A column in a type that the distinct sketch takes, equal for equal values."""
    if isinstance(kind, (T.IntegerType, T.LongType, T.StringType, T.BinaryType)):
        return column
    if isinstance(kind, (T.ByteType, T.ShortType)):
        return column.cast("int")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        column = column + F.lit(0.0)  # both zeros are one value
    return column.cast("string")


def daily_sketches(log: DataFrame, day: str, columns: Sequence[str]) -> DataFrame:
    """One row per day and column: ``(day, name, n_rows, nulls, known, low, high, total, distinct, ranks)``."""
    kinds = {f.name: f.dataType for f in log.schema.fields}
    none = F.lit(None)
    parts = []
    for i, c in enumerate(columns):
        numeric = isinstance(kinds[c], T.NumericType)
        number = F.col(c).cast("double")
        number = F.when(~F.isnan(number), number)
        parts.append(
            F.struct(
                F.lit(c).alias("name"),
                F.count("*").alias("n_rows"),
                F.count_if(F.col(c).isNull()).alias("nulls"),
                (F.count(number) if numeric else F.lit(0).cast("bigint")).alias("known"),
                (F.min(number) if numeric else none.cast("double")).alias("low"),
                (F.max(number) if numeric else none.cast("double")).alias("high"),
                (F.sum(number) if numeric else none.cast("double")).alias("total"),
                F.hll_sketch_agg(_hashable(F.col(c), kinds[c]), DISTINCT_BITS).alias("distinct"),
                (F.kll_sketch_agg_double(number, RANK_SIZE) if numeric else none.cast("binary")).alias("ranks"),
            ).alias(f"_{i}")
        )
    per_day = log.groupBy(F.col(day).alias("day")).agg(*parts)
    return per_day.select("day", F.inline(F.array(*[f"_{i}" for i in range(len(columns))])))


def stored_days(spark: SparkSession, path: str) -> list:
    """Days a store holds, from its folder names; none if there is no store. Refuses more than ``MAX_DAYS``."""
    try:
        days = spark.read.parquet(path).select("day").distinct().limit(MAX_DAYS + 1).collect()
    except AnalysisException as err:
        if err.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):  # no folder, or one without days
            raise
        return []
    if len(days) > MAX_DAYS:
        raise ValueError(f"more than {MAX_DAYS} days in {path}")
    return [r["day"] for r in days]


def add_days(log: DataFrame, path: str, columns: Sequence[str], day: str = "event_date") -> None:
    """Add the sketches of those days of ``log`` that ``path`` does not hold yet.

    Days held are left out by a filter on the day, which skips their folders in a log written by day. All new days are
    committed at once, so a run that fails adds none of them.
    """
    held = stored_days(log.sparkSession, path)
    known = [d for d in held if d is not None]
    new = ~F.col(day).isin(known) if known else F.col(day).isNotNull()
    if None not in held:
        new = new | F.col(day).isNull()
    daily = daily_sketches(log.where(new), day, columns)
    daily.repartition("day").write.mode("append").partitionBy("day").parquet(path)


def merged_profile(sketches: DataFrame, quantiles: dict[str, float] | None = None) -> DataFrame:
    """``(name, n_rows, nulls, distinct, min, max, mean)`` and a column per named quantile, of the days given."""
    quantiles = {"p99": 0.99} if quantiles is None else quantiles
    merged = sketches.groupBy("name").agg(
        F.sum("n_rows").alias("n_rows"),
        F.sum("nulls").alias("nulls"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("distinct"),
        F.min("low").alias("min"),
        F.max("high").alias("max"),
        F.sum("total").alias("_total"),
        F.sum("known").alias("_known"),
        F.kll_merge_agg_double(F.when(F.col("known") > 0, F.col("ranks"))).alias("_ranks"),
    )
    some = F.col("_known") > 0
    return merged.select(
        "name", "n_rows", "nulls", "distinct", "min", "max",
        F.when(some, F.col("_total") / F.col("_known")).alias("mean"),
        *[F.when(some, F.kll_sketch_get_quantile_double("_ranks", F.lit(q))).alias(n) for n, q in quantiles.items()],
    )
