"""Source divergence audit over run-length columns.

A language keeps the terms that enough of its documents have. Each of its sources, and the language itself, gives
each kept term a smoothed share that depends on the term's count and the group's totals only. So the kept
vocabulary is ordered by the terms' counts in all sources, cut into segments of neighbouring terms, and each
source's counts in a segment become runs of equal counts. Two sources meet by intersecting their run boundaries:
one gap of shares per run, times the run's length.

Tasks count whole texts and send (language, source, term) rows with counts; one shuffle by (language, term) adds
them up, so that a hot source or word is a row per task. Segments, not languages, are what pairs are compared in,
and the comparisons of a segment are dealt over ``SPREAD`` tasks. Every pair of sources of a language is an output
row; no other pairs are made. All shares are whole numbers below 2^31, all sums are exact.

Defined cases: null text, language or source count as empty; repeated rows and null or repeated ids are documents
of their own; a group without terms stands in every pair, with 0 where its language keeps no term; a language with
one source has no pairs; an empty table gives no rows; other columns are ignored. Totals beyond 10^15 are refused.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buyerlens.session import materialise

MIN_DOCS = 30
SMOOTHING = 5
UNIT = 1_000_000_000
TOP = 50
SEGMENT = 1 << 16  # terms of a language whose runs are one row of a source
SPREAD = 16  # tasks that share the comparisons of a segment
FLUSH = 250_000  # counted terms a task holds

# Letters stay, A-Z lower-cased; every other ASCII byte ends a term.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences and documents of parts of the table; a row with a null term for
    every group."""
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flushed():
            for (lang, source), (n, of) in found.items():
                terms = [None, *n]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(terms)), pa.array([source] * len(terms)),
                        pa.array(terms, pa.binary()).cast(pa.string()),
                        pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(of.__getitem__, n)], pa.int64()),
                    ],
                    names=["lang", "source", "term", "n", "docs"],
                )
            found.clear()

        for batch in batches:
            lang, source = (batch.column(i).to_pylist() for i in (0, 1))
            for i, (group, text) in enumerate(zip(zip(lang, source), batch.column(2).cast(pa.binary()))):
                n, of = found.setdefault(group, (Counter(), Counter()))
                terms = text.as_py().translate(_FOLD).split()
                n.update(terms)
                of.update(set(terms))
                if i % 500 == 499 and sum(len(n) for n, _ in found.values()) > FLUSH:
                    yield from flushed()
        yield from flushed()

    return rows.mapInArrow(count, "lang string, source string, term string, n long, docs long")


def vocabulary(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``(lang, term, n, counts)``: kept terms with their count in each source that has them, as ``(source, n)`` in
    order; the row of the null term lists all sources of a language. One shuffle: sources are added up within the
    task that has the term."""
    listed = F.sort_array(F.collect_list(F.struct("source", "n"))).alias("counts")
    return (
        term_counts(docs)
        .repartition("lang", "term")
        .groupBy("lang", "term", "source")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        .groupBy("lang", "term")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), listed)
        .where((F.col("docs") >= min_docs) | F.col("term").isNull())
        .drop("docs")
    )


def share(n: Column, total: Column) -> Column:
    """1 + floor(UNIT x (n + smoothing) / total), exact."""
    scaled = (n + SMOOTHING).cast("decimal(19,0)") * F.lit(UNIT).cast("decimal(10,0)")
    # the quotient of whole numbers, rounded down by taking the remainder away first
    return (F.lit(1) + ((scaled - scaled % total.cast("decimal(19,0)")) / total.cast("decimal(19,0)"))).cast("long")


def shares(n: np.ndarray, total: int) -> np.ndarray:
    """As ``share``, by long division in steps of a thousand."""
    whole, rest = np.divmod(n + SMOOTHING, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digit
    return whole + 1


def runs_of(segments: DataFrame) -> DataFrame:
    """``(lang, segment, size, source, ends, counts)``: a row for each source that has a term of the segment.

    Rows of a segment stand together and in order; a run ends where a source's count changes.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, columns = None, 0, {}

        def closed():
            names, ends, counts = list(columns), [], []
            for starts, values in columns.values():
                if starts[0]:  # zero until the source's first term
                    starts, values = [0, *starts], [0, *values]
                ends.append([*starts[1:], at])
                counts.append(values)
            n = len(names)
            lang, segment = now
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * n, pa.string()), pa.array([segment] * n, pa.int64()), pa.array([at] * n, pa.int64()),
                    pa.array(names, pa.string()), pa.array(ends, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int64())),
                ],
                names=["lang", "segment", "size", "source", "ends", "counts"],
            )

        last: dict[str, int] = {}
        for batch in batches:
            for lang, segment, counts in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (lang, segment) != now:
                    if now is not None:
                        yield closed()
                    now, at, columns, last = (lang, segment), 0, {}, {}
                here = {c["source"]: c["n"] for c in counts}
                for source in [s for s in last if s not in here]:
                    columns[source][0].append(at)
                    columns[source][1].append(0)
                    del last[source]
                for source, n in here.items():
                    if last.get(source) != n:
                        starts, values = columns.setdefault(source, ([], []))
                        starts.append(at)
                        values.append(n)
                        last[source] = n
                at += 1
        if now is not None:
            yield closed()

    schema = "lang string, segment long, size long, source string, ends array<long>, counts array<long>"
    return segments.select("lang", "segment", "counts").mapInArrow(encode, schema)


def _gap(ends_a, counts_a, total_a, ends_b, counts_b, total_b) -> int:
    """Sum of the gaps of shares over the runs that two sources' boundaries make."""
    a, b = np.asarray(ends_a), np.asarray(ends_b)
    ends = np.union1d(a, b)
    lengths = np.diff(ends, prepend=0)
    p = shares(np.asarray(counts_a), total_a)[np.searchsorted(a, ends)]
    q = shares(np.asarray(counts_b), total_b)[np.searchsorted(b, ends)]
    return int((np.abs(p - q) * lengths).sum())


def segment_gaps(runs: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, a, b, value)`` of every pair a < b of a language's sources in every segment, before adding up.

    A source without a term of a segment is one run of zeros there. One side of a segment's pairs is dealt over
    ``SPREAD`` keys, the other stands under each of them.
    """
    segments = runs.select("lang", "segment", "size").distinct()
    every = groups.select("lang", "source", "total").join(segments, "lang")
    filled = every.join(runs.drop("size"), ["lang", "segment", "source"], "left").select(
        "lang", "segment", "source", "total",
        F.coalesce("ends", F.array("size")).alias("ends"),
        F.coalesce("counts", F.array(F.lit(0).cast("long"))).alias("counts"),
    )
    side = {s: [F.col(c).alias(f"{c}_{s}") for c in ("source", "total", "ends", "counts")] for s in "ab"}
    dealt = F.pmod(F.xxhash64("source"), F.lit(SPREAD)).cast("int").alias("deal")
    left = filled.select("lang", "segment", dealt, *side["a"])
    right = filled.select("lang", "segment", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("deal"), *side["b"])
    pairs = left.join(right, ["lang", "segment", "deal"]).where("source_a < source_b")
    inputs = [f"{c}_{s}" for s in "ab" for c in ("ends", "counts", "total")]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in inputs]
            values = pa.array([_gap(*row) for row in zip(*columns)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], values], names=["lang", "a", "b", "value"])

    chosen = pairs.select("lang", F.col("source_a").alias("a"), F.col("source_b").alias("b"), *inputs)
    return chosen.mapInArrow(compare, "lang string, a string, b string, value long")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """Pairs of sources of each language by divergence, and each source's most over-used terms."""
    found = materialise(vocabulary(docs, min_docs))
    kept = found.where(F.col("term").isNotNull())
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("n"))
    cells = kept.select("lang", "term", F.col("n").alias("n_lang"), F.inline("counts"))
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = materialise(
        found.where(F.col("term").isNull()).select("lang", F.explode("counts.source").alias("source"))
        .join(langs.select("lang", "terms", F.col("n").alias("n_lang")), "lang", "left")
        .join(sums, ["lang", "source"], "left")
        .select(
            "lang", "source",
            (F.coalesce("n", F.lit(0)) + SMOOTHING * F.col("terms")).alias("total"),
            (F.col("n_lang") + SMOOTHING * F.col("terms")).alias("total_lang"),
        )
        .withColumn("total", F.when(F.col("total_lang") > 10**15, F.raise_error(F.lit("totals beyond 10^15"))).otherwise(F.col("total")))
    )

    # the vocabulary in the order of its counts, in segments that lie in one task each
    ordered = (
        kept.select("lang", "counts", "term")
        .repartitionByRange("lang", "counts", "term")
        .sortWithinPartitions("lang", "counts", "term")
        .select("lang", "counts", F.spark_partition_id().cast("long").alias("_task"), F.monotonically_increasing_id().alias("_row"))
    )
    in_task = F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    segments = ordered.select(
        "lang", "counts", (F.shiftleft("_task", 17) + F.floor(in_task / SEGMENT)).alias("segment")
    )
    runs = materialise(runs_of(segments))
    gaps = segment_gaps(runs, groups).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    # languages that keep no term have no segment; all their pairs are 0
    bare = groups.where("total IS NULL").select("lang", "source")
    a, b = bare.withColumnRenamed("source", "a"), bare.withColumnRenamed("source", "b")
    gaps = gaps.unionByName(a.join(b, "lang").where("a < b").withColumn("value", F.lit(0).cast("long")))
    both = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    pairs = gaps.select("lang", F.inline(both), "value")

    p, q = share(F.col("n"), F.col("total")), share(F.col("n_lang"), F.col("total_lang"))
    over = (
        cells.join(groups, ["lang", "source"])
        .select("lang", "source", F.col("term").alias("item"), (p - q).alias("value"))
        .where("value > 0")
    )
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return _ranked(pairs, "pair", best).unionByName(_ranked(over, "term", best).where(F.col("rank") <= top))


def _ranked(rows: DataFrame, part: str, order) -> DataFrame:
    return rows.select(
        "lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).cast("int").alias("rank")
    )
