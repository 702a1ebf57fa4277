"""Exact order statistics without a single-task window.

A window without partition keys, or one keyed on a hot group, puts its rows in one task.
Here rows are first cut into ordered buckets; the running value inside a bucket is a window
keyed on (group, bucket), and what precedes the bucket comes from one row per bucket. Small and large
frames take the same path.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buyerlens.functions.keyed import digest, hex_prefix
from buyerlens.session import materialise

def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on ``keys`` where null equals null."""
    own = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(own, same).drop(*[f"_right_{k}" for k in keys])


def running_totals(
    df: DataFrame,
    order: str | Sequence[str],
    totals: Sequence[str],
    by: Sequence[str] = (),
    descending: bool = False,
    bucketed: bool = False,
) -> DataFrame:
    """Add ``cum_<c>``, the inclusive running total of each column of ``totals``, and
    ``all_<c>``, its total over the group.

    Without ``bucketed`` the frame must hold one row per (by, order), so that equal values
    never crowd one range; it is cut into ranges by Spark's range partitioning and stored, since
    ranges are drawn anew whenever a plan runs. With ``bucketed`` the frame brings its own ordered
    ``_bucket``. There is one path for any size, and null groups are groups like others.
    """
    order_cols = [order] if isinstance(order, str) else list(order)
    direction = F.desc if descending else F.asc
    group = list(by) or [F.lit(0)]

    def upto(keys, cols, end):
        return (
            Window.partitionBy(*keys)
            .orderBy(*[direction(c) for c in cols])
            .rowsBetween(Window.unboundedPreceding, end)
        )

    if not bucketed:
        df = materialise(df.repartitionByRange(*order_cols).withColumn("_bucket", F.spark_partition_id()))
    keys = [*by, "_bucket"]
    heads = df.groupBy(*keys).agg(*[F.sum(c).alias(f"_in_{c}") for c in totals])
    before, whole = upto(group, ["_bucket"], -1), Window.partitionBy(*group)
    offsets = heads.select(
        *keys,
        *[F.coalesce(F.sum(f"_in_{c}").over(before), F.lit(0)).alias(f"_off_{c}") for c in totals],
        *[F.sum(f"_in_{c}").over(whole).alias(f"all_{c}") for c in totals],
    )
    inside = upto(keys, order_cols, 0)
    return (
        null_safe_join(df, offsets, keys)
        .withColumns({f"cum_{c}": F.col(f"_off_{c}") + F.sum(c).over(inside) for c in totals})
        .drop("_bucket", *[f"_off_{c}" for c in totals])
    )


def keyed_rank(df: DataFrame, key: str, seed: int | str, by: Sequence[str] = ()) -> DataFrame:
    """Add ``rank``, the 1-based place of each row in the seed's random order of ``key``, and
    ``group_size``.

    The digest is uniform, so its first digits are ordered, equally full buckets even where
    one group holds most rows. Keys must be unique within a group.
    """
    marked = (
        df.withColumn("_digest", digest(seed, key))
        .withColumn("_bucket", hex_prefix(F.col("_digest"), 3))
        .withColumn("_one", F.lit(1).cast("long"))
    )
    ranked = running_totals(marked, ["_digest", key], ["_one"], by, bucketed=True)
    return ranked.withColumnsRenamed({"cum__one": "rank", "all__one": "group_size"}).drop(
        "_digest", "_one"
    )


def keyed_sample(df: DataFrame, key: str, seed: int | str, cap: int) -> DataFrame:
    """The ``cap`` rows first in the seed's random order; all rows if there are fewer.

    Whole buckets beyond the cap are dropped before any row is sorted, so the work after the
    count is about ``cap`` rows.
    """
    marked = df.withColumn("_digest", digest(seed, key)).withColumn(
        "_bucket", hex_prefix(F.col("_digest"), 3)
    )
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    room = (
        marked.groupBy("_bucket")
        .agg(F.count("*").alias("_n"))
        .withColumn("_room", F.lit(cap) - F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .where("_room > 0")
        .select("_bucket", "_room")
    )
    place = Window.partitionBy("_bucket").orderBy("_digest", key)
    return (
        marked.join(room, "_bucket")
        .withColumn("_place", F.row_number().over(place))
        .where("_place <= _room")
        .drop("_digest", "_bucket", "_room", "_place")
    )


def exact_quantiles(
    long: DataFrame, probs: Sequence[float], by: Sequence[str] = ("name",), value: str = "value"
) -> DataFrame:
    """Linearly interpolated quantiles per group: ``(by, k, prob, q)``; nulls are ignored."""
    counted = long.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    return counted_quantiles(counted, probs, by, value)


def counted_quantiles(
    counted: DataFrame, probs: Sequence[float], by: Sequence[str] = ("name",), value: str = "value"
) -> DataFrame:
    """Quantiles of values that are counted: one row per (by, value) with its number ``n``, no null values."""
    by = list(by)
    placed = running_totals(counted, value, ["n"], by)
    first, last = F.col("cum_n") - F.col("n"), F.col("cum_n") - 1
    wanted = F.array(
        *[F.struct(F.lit(k).alias("k"), F.lit(float(p)).alias("prob")) for k, p in enumerate(probs)]
    )

    def target(t):
        place = (F.col("all_n") - 1) * t["prob"]
        return F.struct(t["k"], t["prob"], place.alias("_h"), F.floor(place).alias("_lo"))

    def near(p: float) -> Column:
        low = F.floor((F.col("all_n") - 1) * float(p))
        return (low + 1 >= first) & (low <= last)

    hits = (
        placed.where(reduce(or_, [near(p) for p in probs]))
        .withColumn(
            "_t",
            F.filter(
                F.transform(wanted, target),
                lambda t: (t["_lo"] + 1 >= first) & (t["_lo"] <= last),
            ),
        )
        .where(F.size("_t") > 0)
        .select(*by, value, first.alias("_first"), last.alias("_last"), F.inline("_t"))
    )
    low = F.max(F.when(F.col("_lo").between(F.col("_first"), F.col("_last")), F.col(value)))
    high = F.max(F.when((F.col("_lo") + 1).between(F.col("_first"), F.col("_last")), F.col(value)))
    return (
        hits.groupBy(*by, "k", "prob", "_h", "_lo")
        .agg(low.alias("_a"), high.alias("_b"))
        .withColumn("_b", F.coalesce("_b", "_a"))
        .select(
            *by,
            "k",
            "prob",
            (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_h") - F.col("_lo"))).alias("q"),
        )
    )


def median_of(long: DataFrame, by: Sequence[str] = ("name",), value: str = "value") -> DataFrame:
    """Exact median per group as ``(by, median)``."""
    return exact_quantiles(long, [0.5], by, value).select(*by, F.col("q").alias("median"))


__all__ = [
    "counted_quantiles",
    "exact_quantiles",
    "keyed_rank",
    "keyed_sample",
    "median_of",
    "null_safe_join",
    "running_totals",
]
