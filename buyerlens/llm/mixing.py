"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

The words of a source are dealt to shards and lined up in seeded order, and each shard's line is cut
into blocks of ``block`` words. Blocks go to sources, and a source's blocks to its shards, by the
highest quotients size / (2k + 1). What integer quotas leave of a source's target, or exceed it by, is settled
on its shards in order, so that a source takes its target to the word however few words it has. Each shard takes
its words in seeded block order, whole rounds first, and of the last block as many words as are still owed.
DataFrame functions only.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; null ids
are ordinary rows; repeated rows are mixed one by one; an empty table gives no rows; other columns are
ignored. Rows equal in id, text and source are interchangeable.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from buyerlens.llm.text import words
from buyerlens.session import materialise

WEIGHTS = (5, 2, 1)
REPEATS = 3  # a word is taken three times at most
BLOCK = 128
SHARD_WORDS = 2_000_000
SEED = 7


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """``(source, source_size, src, target)`` of rows ``(source, size)``.

    ``src`` numbers sources by code point, null last; weights repeat in that order. Targets share all
    words by weight; those above ``repeats`` times their source stop there and the rest is shared
    again, which in order of size per weight is one running sum. One row a source is ordered here, never rows of documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = per.withColumn("src", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    turn = F.array(*[F.lit(float(w)) for w in weights])
    weighted = ordered.withColumn("_w", F.get(turn, F.col("src") % len(weights))).withColumn(
        "_cap", F.col("source_size") * repeats
    )
    everything = Window.partitionBy(F.lit(0))
    fullest = Window.orderBy(F.col("_cap") / F.col("_w"), "src").rowsBetween(Window.unboundedPreceding, -1)
    room = (
        weighted.withColumn("_all", F.sum("source_size").over(everything))
        .withColumn("_all_w", F.sum("_w").over(everything))
        .withColumn("_left", F.col("_all") - F.coalesce(F.sum("_cap").over(fullest), F.lit(0)))
        .withColumn("_left_w", F.col("_all_w") - F.coalesce(F.sum("_w").over(fullest), F.lit(0.0)))
        .withColumn("_full", F.col("_cap") * F.col("_left_w") <= F.col("_left") * F.col("_w"))
    )
    shared = room.withColumn(
        "_rest", F.max("_all").over(everything) - F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0)).over(everything)
    ).withColumn("_rest_w", F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col("_w"))).over(everything))
    target = F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(F.col("_rest") * F.col("_w") / F.col("_rest_w"))
    return shared.select("source", "source_size", "src", target.alias("target"))


def apportion(rows: DataFrame, key: Sequence[str], votes: str, seats: str, by: Sequence[str] = ()) -> DataFrame:
    """Add ``quota``: ``seats`` (a column equal within ``by``) shared by ``votes`` with the highest
    quotients votes / (2k + 1), ties to the smaller ``key``.

    The divisor differs from votes per seat by n / (2 seats) of itself at most, so a row's quota lies within
    share * n / 2 + 2 of its exact share: only the quotients there are ranked, about three rows a row.
    """
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    sized = (
        rows.withColumn("_votes", F.sum(votes).over(group))
        .withColumn("_n", F.count("*").over(group))
        .withColumn("_share", F.when(F.col("_votes") > 0, F.col(votes) / F.col("_votes")).otherwise(0.0))
        .withColumn("_exact", F.col("_share") * F.col(seats))
        .withColumn("_reach", F.ceil(F.col("_share") * F.col("_n") / 2) + 2)
        .withColumn("_sure", F.greatest(F.lit(0).cast("long"), F.floor(F.col("_exact")) - F.col("_reach")))
    )
    # quotients of rows without votes are zero and win no seat
    quotients = sized.where(F.col(votes) > 0).select(
        *by, *key, "_sure", F.col(seats).alias("_seats"), F.col(votes).alias("_of"),
        F.explode(F.sequence(F.col("_sure"), F.floor("_exact") + F.col("_reach"))).alias("_k"),
    )
    best = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc(F.col("_of") / (2 * F.col("_k") + 1)), *key)
    ranked = quotients.withColumn("_place", F.row_number().over(best))
    all_sure = Window.partitionBy(*(by or [F.lit(0)]))
    firsts = F.when(F.col("_k") == F.col("_sure"), F.col("_sure")).otherwise(0)
    won = (
        ranked.withColumn("_given", F.sum(firsts).over(all_sure))
        .withColumn("_won", (F.col("_place") <= F.col("_seats") - F.col("_given")).cast("long"))
        .groupBy(*by, *key)
        .agg(F.sum("_won").alias("_won"))
    )
    names = [*by, *key]
    return (
        sized.join(won, names, "left")
        .withColumn("quota", F.col("_sure") + F.coalesce(F.col("_won"), F.lit(0)))
        .drop("_votes", "_n", "_share", "_exact", "_reach", "_sure", "_won")
    )


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    repeats: int = REPEATS,
    block: int = BLOCK,
    shard_words: int = SHARD_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """``(doc_id, size, source, source_size, target, taken)``: the words the mix takes of every document."""
    size = F.size(words(F.col("text"))).cast("long")
    draw = F.xxhash64(F.lit(seed), "doc_id", "text")
    sizes = materialise(docs.select("doc_id", "source", size.alias("size"), draw.alias("_draw")))
    sources = source_targets(sizes, weights, repeats)
    every = Window.partitionBy(F.lit(0))
    total = F.round(F.sum("target").over(every) / block).cast("long")
    seated = materialise(
        apportion(sources.withColumn("_blocks", total), ["src"], "target", "_blocks")
        .withColumnRenamed("quota", "_source_quota")
        .withColumn("_shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)))
        .drop("_blocks")
    )
    dealt = (
        sizes.withColumnRenamed("source", "_source")
        .join(seated, F.col("_source").eqNullSafe(F.col("source")))
        .drop("_source")
        .withColumn("_shard", F.pmod(F.xxhash64("_draw"), F.col("_shards")))
    )
    line = Window.partitionBy("src", "_shard").orderBy("_draw", "doc_id", "size")
    placed = materialise(
        dealt.withColumn("_end", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0))).drop("_draw", "_shards")
    )
    shards = placed.groupBy("src", "_shard").agg(
        F.max("_end").alias("_words"), F.first("_source_quota").alias("_source_quota"),
        F.round(F.first("target")).cast("long").alias("_owed"),
    )
    goals = settled(apportion(shards, ["_shard"], "_words", "_source_quota", ["src"]), block, repeats)
    joined = placed.join(shard_takes(goals, block, seed), ["src", "_shard"])
    start = F.col("_end") - F.col("size")
    taken = F.aggregate(
        F.sequence(F.floor(start / block), F.floor((F.col("_end") - 1) / block)),
        F.col("_rounds") * F.col("size"),
        lambda acc, b: acc
        + F.greatest(
            F.lit(0).cast("long"),
            F.least(F.col("_end"), b * block + F.get(F.col("_extra"), b.cast("int"))) - F.greatest(start, b * block),
        ),
    )
    return joined.select(
        "doc_id", "size", "source", "source_size", "target",
        F.when(F.col("size") > 0, taken).otherwise(F.lit(0)).cast("long").alias("taken"),
    )


def settled(shards: DataFrame, block: int, repeats: int) -> DataFrame:
    """Add ``_goal``: the words each shard takes, ``quota`` blocks at first and ``repeats`` times its words at most.

    The goals of a source add up to ``_owed``: words lacking go to its shards with room, words in excess are taken off, in order of
    shards. Room and goals are enough for that, as no target exceeds ``repeats`` times its source.
    """
    source = Window.partitionBy("src")
    before = source.orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    nothing = F.lit(0).cast("long")

    def poured(amount, vessel: str):
        """What a vessel gets of an amount poured into all of a source, one after another."""
        return F.greatest(nothing, F.least(F.col(vessel), amount - F.coalesce(F.sum(vessel).over(before), nothing)))

    return (
        shards.withColumn("_first", F.least(F.col("quota") * block, F.col("_words") * repeats))
        .withColumn("_room", F.col("_words") * repeats - F.col("_first"))
        .withColumn("_lacks", F.col("_owed") - F.sum("_first").over(source))
        .withColumn("_goal", F.col("_first") + poured(F.col("_lacks"), "_room") - poured(-F.col("_lacks"), "_first"))
        .select("src", "_shard", "_words", "_goal")
    )


def shard_takes(shards: DataFrame, block: int, seed: int) -> DataFrame:
    """``(src, _shard, _rounds, _extra)``: how often a shard is taken whole, and how many words from the start of each of its blocks
    besides. A shard holds a bounded number of blocks unless one document is longer than a shard."""
    n = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("_words") / block))
    blocks = F.sequence(F.lit(0).cast("long"), n - 1)
    order = F.array_sort(
        F.transform(blocks, lambda b: F.struct(F.xxhash64(F.lit(seed), "src", "_shard", b).alias("h"), b.alias("b")))
    )
    some = F.col("_words") > 0
    seeded = shards.select(
        "src", "_shard", (n - 1).alias("_last"), (F.col("_words") - (n - 1) * block).alias("_short"),
        F.when(some, F.floor(F.col("_goal") / F.col("_words"))).otherwise(0).cast("long").alias("_rounds"),
        F.when(some, F.col("_goal") % F.col("_words")).otherwise(0).cast("long").alias("_rest"),
        order.alias("_order"),
    ).withColumn("_last_at", F.array_position(F.transform("_order", lambda s: s["b"]), F.col("_last")) - 1)
    # all blocks are full but the last, so the words of the blocks ahead follow from the place in the order
    ahead = F.col("_place") * block - F.when(F.col("_place") > F.col("_last_at"), block - F.col("_short")).otherwise(0)
    holds = F.when(F.col("_at.b") == F.col("_last"), F.col("_short")).otherwise(block)
    words_of = F.greatest(F.lit(0).cast("long"), F.least(holds, F.col("_rest") - ahead))
    return (
        seeded.select(
            "src", "_shard", "_rounds", "_last", "_short", "_rest", "_last_at", F.posexplode("_order").alias("_place", "_at")
        )
        .groupBy("src", "_shard", "_rounds")
        .agg(F.sort_array(F.collect_list(F.struct(F.col("_at.b").alias("b"), words_of.alias("w")))).alias("_bw"))
        .select("src", "_shard", "_rounds", F.transform("_bw", lambda s: s["w"]).alias("_extra"))
    )
