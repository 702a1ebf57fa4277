"""Joins that stay even when one key, or the null key, holds much of the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16


def salted_lookup(
    rows: DataFrame, lookup: DataFrame, on: str, spread: str, salts: int = SALTS
) -> DataFrame:
    """Left join to a frame unique on ``on``; a hot or null key is split over ``salts`` tasks.

    ``spread`` is a column that varies within a hot key. The lookup is repeated once per salt,
    never broadcast by hint: adaptive execution broadcasts it only if its measured size allows.
    """
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [on, "_salt"], "left").drop("_salt")
