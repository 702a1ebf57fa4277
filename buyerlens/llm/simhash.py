"""SimHash near-dedup by a byte-position index with count filtering.

A 64-bit fingerprint is eight positional bytes, and two fingerprints that differ in at most three bits share
at least five of them. Lists of one positional byte hold a 256th of all rows, so the index lists four
positional bytes at a time: the 14 blocks of a Steiner system S(3, 4, 8) are such that whichever three bytes differ,
the other five hold a whole block. Pairs of a list are tallied by shared positional bytes, those with
five or more are kept and verified bit by bit. A list beyond ``longest`` distinct fingerprints goes on in lists of finer
keys: its open bits are cut in four, one of which the pair shares too. The finest keys leave eleven open bits, so no list exceeds
2,048 members, and none is cut. A list gives a spanning forest of its links, which is enough for components.

Defined cases: a null or empty text has fingerprint zero and is linked like any other; a null id is never
the smallest id unless its component has no other, then the component's id is null; repeated rows are
returned each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buyerlens.llm.components import components
from buyerlens.llm.text import carried, per_chunk
from buyerlens.session import materialise

BITS = 3
SHARED_BYTES = 5  # of eight, guaranteed by three differing bits
LONGEST = 2048
SHINGLE = 3
HASH_SEED = 42


def fingerprints(texts: list[bytes], shingle: int = SHINGLE, seed: int = HASH_SEED) -> np.ndarray:
    """The fingerprint of each text: bits set in over half of its shingles' hashes."""
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    for row, text in enumerate(texts):
        words = text.lower().split()  # of bytes: only A-Z, only the six spaces
        if not words:
            continue
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
        starts = np.concatenate([[0], ends[:-1]])
        n = max(1, len(words) - shingle + 1)
        last = ends[min(shingle, len(words)) - 1 :][:n] - 1
        hashes += [digest(line[a:b], seed) for a, b in zip(starts[:n].tolist(), last.tolist())]
        counts[row] = n
    out = np.zeros(len(texts), dtype=np.uint64)
    filled = np.flatnonzero(counts)
    if len(filled):
        bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
        first = np.cumsum(counts[filled]) - counts[filled]
        ones = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
        out[filled] = np.packbits(ones * 2 > counts[filled][:, None], axis=1).view(">u8").ravel()
    return out


def fingerprint_rows(docs: DataFrame) -> DataFrame:
    """``(doc_id, _key, _fp)``: the id, a hash of the text, and the fingerprint as a signed 64-bit number."""
    return per_chunk(
        docs.select("doc_id", "text", F.xxhash64("text").alias("_key")), ["doc_id", "_key"], "text", [("_fp", "long")],
        lambda: lambda texts: [pa.array(fingerprints(texts).view(np.int64))],
    )


def mask_of(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def blocks() -> list[int]:
    """The 14 blocks of S(3, 4, 8) as byte masks: the words of weight four of the extended Hamming code."""
    code = [w for w in combinations(range(8), 4) if not np.bitwise_xor.reduce(w)]
    return [mask_of([8 * p + b for p in w for b in range(8)]) for w in code]


def finer(mask: int) -> list[int]:
    """Masks with a quarter of the open bits added; each pair that agrees on ``mask`` agrees on one of them."""
    shut = mask % (1 << 64)
    rest = [b for b in range(64) if not shut >> b & 1]
    cuts = [rest[i * len(rest) // 4 : (i + 1) * len(rest) // 4] for i in range(4)]
    return [mask_of([b for b in range(64) if shut >> b & 1] + cut) for cut in cuts]


def forest(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what is linked within each list of distinct fingerprints."""
    a_out, b_out = [], []
    for row in range(len(lists)):
        fps = np.sort(lists[row].values.to_numpy())
        n = len(fps)
        member = np.arange(n)
        byte = fps.view(np.uint8).reshape(n, 8)
        for begin in range(0, n, 256):
            some = slice(begin, min(n, begin + 256))
            shared = np.zeros((some.stop - begin, n - begin), dtype=np.int8)
            for p in range(8):  # the tally of positional bytes
                shared += byte[some, p][:, None] == byte[begin:, p][None, :]
            i, j = np.nonzero(np.triu(shared >= SHARED_BYTES, 1))
            i, j = i + begin, j + begin
            near = np.bitwise_count((fps[i] ^ fps[j]).view(np.uint64)) <= BITS
            i, j = i[near], j[near]
            while len(i):  # one link of each pair of parts, until the links join nothing new
                while (member != member[member]).any():
                    member = member[member]
                a, b = np.minimum(member[i], member[j]), np.maximum(member[i], member[j])
                apart = a != b
                i, j, a, b = i[apart], j[apart], a[apart], b[apart]
                _, one = np.unique(b, return_index=True)  # each part joins one smaller part, so no ring arises
                member[b[one]] = a[one]
                a_out.append(fps[i[one]])
                b_out.append(fps[j[one]])
    if not a_out:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(a_out), np.concatenate(b_out)


def links(fps: DataFrame, longest: int = LONGEST) -> DataFrame:
    """``(a, b)``: links between the distinct fingerprints ``_fp`` that connect all that is linked."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = forest(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def verified(postings: DataFrame) -> DataFrame:
        lists = postings.groupBy("_mask", "_value").agg(F.collect_list("_fp").alias("_fps"))
        return lists.select("_fps").where(F.size("_fps") > 1).mapInArrow(pairs, "a long, b long")

    masks, postings, found = blocks(), None, []
    listed = fps.select("_fp", F.explode(F.array(*[F.lit(m) for m in masks])).alias("_mask"))
    for depth in range(6):
        postings = listed.withColumn("_value", F.col("_fp").bitwiseAND(F.col("_mask")))
        if depth == 5:  # eleven open bits at most
            found.append(verified(postings))
            break
        counts = postings.groupBy("_mask", "_value").agg(F.count("*").alias("_n")).where("_n > 1")
        long = materialise(counts.where(F.col("_n") > longest).drop("_n"))
        if long.isEmpty():
            found.append(verified(postings))
            break
        found.append(verified(postings.join(long, ["_mask", "_value"], "left_anti")))
        children = {m: finer(m) for m in masks}
        masks = sorted({c for cs in children.values() for c in cs})
        below = fps.sparkSession.createDataFrame(
            [(m, cs) for m, cs in children.items()], "_mask long, _finer array<long>"
        )
        listed = materialise(
            postings.join(long, ["_mask", "_value"], "left_semi")
            .join(F.broadcast(below), "_mask")
            .select("_fp", F.explode("_finer").alias("_mask"))
            .distinct()
        )
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out.distinct()


def grouped(docs: DataFrame) -> DataFrame:
    """``(doc_id, _key, _fp, component_id, _root)`` per row; the root is null for a fingerprint of one row without links."""
    rows = materialise(fingerprint_rows(docs))
    distinct = materialise(rows.groupBy("_fp").agg(F.min("doc_id").alias("_min"), F.count("*").alias("_n")))
    joined = components(materialise(links(distinct.select("_fp"))), "a", "b")
    rooted = distinct.join(joined, F.col("_fp") == F.col("node"), "left").withColumn(
        "_root", F.coalesce("root", "_fp")
    )
    smallest = rooted.groupBy(F.col("_root").alias("_r")).agg(F.min("_min").alias("component_id"))
    # a fingerprint of one row without links needs no look-up: the row's id is its component
    named = (
        rooted.where("_n > 1 OR root IS NOT NULL")
        .join(smallest, F.col("_root") == F.col("_r"))
        .select(F.col("_fp").alias("_named"), "component_id", "_root")
    )
    return rows.join(named, F.col("_fp") == F.col("_named"), "left").select(
        "doc_id", "_key", "_fp", "_root",
        F.when(F.col("_named").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per row of ``docs``."""
    return grouped(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: the one of its smallest id (null last), then of its smallest text hash."""
    rows = materialise(grouped(docs))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("_key").alias("k")))
    chosen = (
        rows.where("_root IS NOT NULL").groupBy("_root").agg(first.alias("f"))
        .select(F.col("f.d").alias("_id"), F.col("f.k").alias("_k"))
        .unionAll(rows.where("_root IS NULL").select(F.col("doc_id").alias("_id"), F.col("_key").alias("_k")))
    )
    marked = carried(docs).withColumn("_key", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_k"))
    kept = marked.join(chosen, same, "left_semi")
    # rows equal in id and text are one document: only those are compared again
    again = rows.groupBy("doc_id", "_key").agg(F.count("*").alias("_n")).where("_n > 1").select(
        F.col("doc_id").alias("_id"), F.col("_key").alias("_k")
    )
    again = materialise(again.join(chosen, ["_k"], "left_semi"))
    if not again.isEmpty():
        kept = kept.join(again, same, "left_anti").unionAll(
            kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "_key"])
        )
    return kept.select("_row.*")
