"""Quality rules: counts of a text, and a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed to ``buckets``; one multinomial is counted over all documents, one over
the trusted target. A text's verdict is its mean log ratio of the two, compared with a fixed threshold.
DataFrame functions only.

Defined cases: a null or empty text has no words, fails the base rules and scores 0; a null id is an
ordinary row that is never trusted; repeated rows count each time; without a trusted document every ratio is 0;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buyerlens.llm.text import held_out, let, words

BUCKETS = 1 << 14
SMOOTHING = 1.0
THRESHOLD = -0.05


def repeated_words(tokens: Column) -> Column:
    """Words covered by 3-word windows that stand in the text twice or more."""

    def covered(starts: Column) -> Column:
        n = F.size(starts)
        gaps = F.aggregate(
            F.sequence(F.lit(1), n),
            F.lit(0).cast("long"),
            lambda acc, k: acc
            + F.when(k == n, F.lit(3)).otherwise(F.least(F.lit(3), F.get(starts, k) - F.get(starts, k - 1))),
        )
        return F.when(n > 0, gaps).otherwise(F.lit(0).cast("long"))

    def starts(sorted_: Column) -> Column:
        def twice(x: Column, k: Column) -> Column:
            before, after = F.get(sorted_, k - 1)["h"], F.get(sorted_, k + 1)["h"]
            same = F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(after == x["h"], F.lit(False))
            return F.when(same, x["i"])

        return F.sort_array(F.array_compact(F.transform(sorted_, twice)))

    def windows(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        found = let(let(placed, starts), covered)
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), found).otherwise(F.lit(0).cast("long"))

    hashes = F.transform(
        F.slice(tokens, F.lit(1), F.size(tokens) - 2),
        lambda w, i: F.xxhash64(w, F.get(tokens, i + 1), F.get(tokens, i + 2)),
    )
    return F.when(F.size(tokens) >= 4, let(hashes, windows)).otherwise(F.lit(0).cast("long"))


def base_counts(text: Column, tokens: Column) -> dict[str, Column]:
    safe = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(safe, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(tokens).cast("long"),
        "word_chars": F.length(F.array_join(tokens, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(safe, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(tokens),
    }


def buckets_of(tokens: Column, buckets: int) -> Column:
    """The buckets of all words, then of all pairs of neighbours."""
    single = F.transform(tokens, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))
    pairs = F.transform(
        F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0))),
        lambda w, i: F.pmod(F.xxhash64(F.get(tokens, i), w), F.lit(buckets)).cast("int"),
    )
    return F.concat(single, pairs)


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> list[float]:
    """log(target share / raw share) of every bucket, from all documents; ``trusted`` has ``doc_id``, distinct."""

    def counts(rows: DataFrame) -> list[float]:
        out = [smoothing] * buckets
        found = rows.select(F.explode(let(words(F.col("text")), lambda w: buckets_of(w, buckets))).alias("_bucket"))
        for r in found.groupBy("_bucket").agg(F.count("*").alias("n")).collect():  # at most ``buckets`` rows
            out[r["_bucket"]] += r["n"]
        return out

    # joined by sorting at every size: texts move once, and skewed ids are split, where a broadcast would grow with the ids
    raw, target = counts(docs), counts(docs.select("doc_id", "text").join(trusted.hint("merge"), "doc_id", "left_semi"))
    if sum(target) <= smoothing * buckets:
        return [0.0] * buckets
    shift = math.log(sum(raw) / sum(target))
    return [math.log(t / r) + shift for t, r in zip(target, raw)]


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    buckets: int = BUCKETS,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Counts, ``ratio`` and ``kept`` of every document. The trusted target is the labelled rows of quality 1
    outside the held-out fold, all of them."""
    trusted = labels.where(~held_out(F.col("doc_id")) & (F.col("quality") == 1)).select("doc_id").distinct()
    ratios = log_ratios(docs, trusted, buckets)
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")

    def mean(found: Column) -> Column:
        total = F.aggregate(found, F.lit(0.0), lambda acc, b: acc + F.get(table, b))
        return F.when(F.size(found) > 0, total / F.size(found)).otherwise(F.lit(0.0))

    def measured(tokens: Column) -> Column:
        counts = [c.alias(n) for n, c in base_counts(F.col("text"), tokens).items()]
        return F.struct(*counts, let(buckets_of(tokens, buckets), mean).alias("ratio"))

    rows = docs.select("doc_id", let(words(F.col("text")), measured).alias("_m")).select("doc_id", "_m.*")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.round("ratio", 9) >= threshold)
    )
