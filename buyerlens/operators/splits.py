"""Train, validation and test membership."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buyerlens.functions.keyed import bucket
from buyerlens.plans.ordered import keyed_rank

SPLITS = ("train", "val", "test")


def hashed_split(
    df: DataFrame,
    id_column: str,
    seed: int,
    train: float = 0.6,
    val: float = 0.2,
) -> DataFrame:
    """User-disjoint split by a seed-salted hash of the id; a projection, no shuffle."""
    slot = bucket(seed, id_column, 100)
    low, high = round(train * 100), round((train + val) * 100)
    return df.withColumn(
        "split", F.when(slot < low, "train").when(slot < high, "val").otherwise("test")
    )


def stratified_split(
    df: DataFrame,
    id_column: str,
    label: str,
    seed: int,
    test_size: float = 0.2,
    val_size: float = 0.2,
) -> DataFrame:
    """Exact per-class cut of a seeded order: test first, then validation, then train."""
    ranked = keyed_rank(df, id_column, seed, [label])
    n = F.col("group_size").cast("double")
    return ranked.withColumn(
        "split",
        F.when(F.col("rank") <= F.round(n * test_size), "test")
        .when(F.col("rank") <= F.round(n * (test_size + val_size)), "val")
        .otherwise("train"),
    ).drop("rank", "group_size")


def split_checks(split: DataFrame, universe: DataFrame, id_column: str) -> DataFrame:
    """Per split: its rows, ids also held by another split, ids outside the universe;
    and on every row the ids of the universe that no split holds.

    An id's splits are a bit mask, so the check is one hashed sum per id.
    """
    bit = F.when(F.col("split") == SPLITS[0], 1).when(F.col("split") == SPLITS[1], 2).otherwise(4)
    mask = F.col("homes_mask")
    first = F.when(mask.bitwiseAND(1) > 0, SPLITS[0]).when(mask.bitwiseAND(2) > 0, SPLITS[1])
    held = (
        split.groupBy(id_column)
        .agg(F.bit_or(bit).alias("homes_mask"))
        .select(id_column, F.bit_count(mask).alias("homes"), first.otherwise(SPLITS[2]).alias("split"))
    )
    ids = universe.select(id_column).distinct().withColumn("known", F.lit(True))
    both = held.join(ids, id_column, "full")
    missing = both.agg(F.count_if(F.col("split").isNull()).alias("m")).scalar()
    return (
        both.where(F.col("split").isNotNull())
        .groupBy("split")
        .agg(
            F.count("*").alias("n"),
            F.count_if(F.col("homes") > 1).alias("shared"),
            F.count_if(F.col("known").isNull()).alias("outside"),
        )
        .withColumn("missing", missing)
    )
