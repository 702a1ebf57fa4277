"""Parquet tables written once and reused by every seed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException


def write_table(df: DataFrame, path: str) -> str:
    """Write a derived table to its own folder, replacing an earlier build."""
    df.write.mode("overwrite").parquet(path)
    return path


def read_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Read a cached table; build and cache it when the folder does not exist."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
    write_table(build(), path)
    return spark.read.parquet(path)
