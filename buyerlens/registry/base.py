"""Named queries with, where SQL can say it, an equivalent statement."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from buyerlens.config import CustomerConfig, EventConfig
from buyerlens.functions.frames import tidy

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# The windows of the given events: 29 feature days, one label day.
EVENTS = EventConfig(
    feature_start=datetime(2024, 1, 1),
    label_start=datetime(2024, 1, 30),
    label_end=datetime(2024, 1, 30, 23, 59, 59),
)
CUSTOMERS = CustomerConfig(
    reference_year=2000, tenure_reference="2001-12-31", junk_levels=("FURNITURE", "MACHINERY")
)
SEED = 7


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; doubles are rounded on the way out so engines can be compared."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: tidy(fn(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add
