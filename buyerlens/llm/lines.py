"""Line dedup by a log-template tree.

The tree is of fixed depth: a line goes down by its token count and its leading tokens, tokens with a
digit standing for any field. The leaf generalises the rest, so lines of one leaf agree in count and in at
least ``similarity`` of their tokens from the left. A leaf found in ``min_docs`` documents is a recurring
template, and its lines are dropped from every document but the one with the smallest id. DataFrame
functions only.

Defined cases: a null text has no lines and stays null; an empty text is one line without tokens; lines
with fewer than ``min_tokens`` tokens are never dropped (the query op5 and its SQL statement leave out lines of one token, the
pipeline only lines without tokens); a line of one token has that token as its leaf, digits and all, since a field alone
would fit any line; rows with one id are one document and lose the same
templates, and rows with a null id together are one document, after all others; a row keeps all its lines of a
template or none; an empty table gives no rows; other columns are carried along as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buyerlens.llm.text import carried, let, words

DEPTH = 4
SIMILARITY = 0.6
MIN_DOCS = 3
MIN_TOKENS = 2
FIELD = "<*>"


def template(line: Column, depth: int = DEPTH, similarity: float = SIMILARITY, min_tokens: int = MIN_TOKENS) -> Column:
    """The leaf of a line as a 64-bit number; null for a line that is too short."""

    def leaf(tokens: Column) -> Column:
        n = F.size(tokens)
        fixed = F.least(n, F.greatest(F.lit(depth), F.ceil(n * similarity).cast("int")))
        lead = F.array_join(F.slice(tokens, F.lit(1), F.greatest(fixed, F.lit(1))), " ")
        general = F.when(
            (n > 1) & lead.rlike("[0-9]"), F.regexp_replace(lead, "[^ ]*[0-9][^ ]*", FIELD)
        ).otherwise(lead)
        return F.when(n >= min_tokens, F.xxhash64(n, general))

    return let(words(line), leaf)


def split_lines(text: Column) -> Column:
    return F.split(text, "\n")


def recurring(docs: DataFrame, min_docs: int = MIN_DOCS, **tree) -> DataFrame:
    """``(doc_id, _drops)``: the templates each document has to drop."""
    leaves = F.array_distinct(F.transform(split_lines(F.col("text")), lambda x: template(x, **tree)))
    found = (
        docs.select("doc_id", F.explode(leaves).alias("_leaf")).where(F.col("_leaf").isNotNull()).distinct()
    )
    often = (
        found.groupBy("_leaf")
        .agg(F.count("*").alias("_docs"), F.min("doc_id").alias("_first"))
        .where(F.col("_docs") >= min_docs)
        .select("_leaf", "_first")
    )
    later = found.join(often, "_leaf").where(~F.col("doc_id").eqNullSafe(F.col("_first")))
    return later.groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_list("_leaf").alias("_drops"))


def drop_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, **tree) -> DataFrame:
    """``(doc_id, text, n_lines, n_dropped, _row)``: texts without recurring lines, and the rows they come from."""
    drops = recurring(docs, min_docs, **tree)
    joined = carried(docs).join(drops, F.col("doc_id").eqNullSafe(F.col("_doc")), "left").drop("_doc")
    lines = split_lines(F.col("text"))
    kept = F.filter(lines, lambda x: ~F.coalesce(F.array_contains("_drops", template(x, **tree)), F.lit(False)))
    kept = F.when(F.col("_drops").isNull(), lines).otherwise(kept)
    none = F.col("text").isNull()
    return joined.withColumn("_kept", kept).select(
        "doc_id",
        F.array_join("_kept", "\n").alias("text"),
        F.when(none, 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(none, 0).otherwise(F.size(lines) - F.size("_kept")).cast("long").alias("n_dropped"),
        "_row",
    )
