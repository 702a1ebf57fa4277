"""Small column and frame helpers."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def horizontal_sum(columns: list[str] | tuple[str, ...]) -> Column:
    """Row-wise sum of several columns, as a double."""
    return reduce(add, [F.col(c).cast("double") for c in columns])


def ratio(num: Column, den: Column) -> Column:
    """``num / den`` as a double, null where the denominator is zero."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles for comparison and turn NaN into null."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(F.when(F.isnan(c), None).otherwise(c).cast("double"), digits) + F.lit(0.0)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def to_long(
    df: DataFrame, keys: list[str], columns: list[str], name: str = "name", value: str = "value"
) -> DataFrame:
    """Wide double columns to ``(keys, name, value)`` rows."""
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias(name), F.col(f"`{c}`").cast("double").alias(value))
            for c in columns
        ]
    )
    return df.select(*keys, F.inline(pairs))


def vector_to_long(
    df: DataFrame, keys: list[str], vector: str, index: str = "dim", value: str = "value"
) -> DataFrame:
    """An array column to ``(keys, index, value)`` rows."""
    return df.select(*keys, F.posexplode(vector).alias(index, value)).withColumn(
        value, F.col(value).cast("double")
    )
