"""Words, folds and row-wise helpers shared by the text operators."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The six characters between words.
SPACES = " \t\n\x0b\x0c\r"
BETWEEN_WORDS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text, as ``[^\\x20\\x09-\\x0D]+`` finds them; none for null."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return let(bare, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, BETWEEN_WORDS)))


def held_out(doc_id: Column) -> Column:
    """True for the fold whose labels are never learned from: crc32 of the id as text is a multiple of 5.

    A null id has no fold and counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def held_out_plain(doc_id: int | None) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 5 == 0


def learnable(labels: DataFrame, label: str, rows: int, seed: int) -> DataFrame:
    """At most ``rows`` labelled ids as ``(doc_id, label)``, the first in the seed's order; held-out
    folds, null ids and null labels are left out, and an id labelled more than once has its largest label."""
    return (
        labels.where(~held_out(F.col("doc_id")) & F.col(label).isNotNull())
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id")
        .limit(rows)
    )


def carried(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, _row)``: what operators work on, and the whole row, whose other columns may have any names."""
    return docs.select("doc_id", "text", F.struct(*[docs[c] for c in docs.columns]).alias("_row"))


def chunks(batches: Iterator[pa.RecordBatch], text_at: str, chars: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``chars`` bytes of text each; one long text is a slice of its own."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text_at))
        if batch.num_rows == 0:
            continue
        lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(lengths, dtype=np.int64) // chars
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)


def per_chunk(
    docs: DataFrame,
    keep: list[str],
    text: str,
    outputs: list[tuple[str, str]],
    make: Callable[[], Callable[[list[bytes]], list]],
    chars: int = 2_000_000,
) -> DataFrame:
    """Columns ``keep`` and the columns a function makes of each chunk of whole texts.

    ``make`` is called once in each task and gives the function; it gets the UTF-8 texts (null: empty)
    and returns one array per output. Memory is a chunk and its arrays, however long the partition.
    """
    source = docs.select(*keep, F.col(text).alias("_text"))
    schema = T.StructType([*source.schema.fields[:-1]])
    for name, kind in outputs:
        schema = schema.add(name, T.DataType.fromDDL(kind))
    kinds = [_arrow(kind) for _, kind in outputs]
    names = [*keep, *[n for n, _ in outputs]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = None
        for part in chunks(batches, "_text", chars):
            function = function or make()
            raw = [b or b"" for b in part.column(part.num_columns - 1).cast(pa.binary()).to_pylist()]
            made = function(raw)
            arrays = [part.column(i) for i in range(part.num_columns - 1)]
            arrays += [a if isinstance(a, pa.Array) else pa.array(a, type=k) for a, k in zip(made, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return source.mapInArrow(run, schema)


def _arrow(kind: str) -> pa.DataType:
    plain = {
        "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(),
        "binary": pa.binary(),
    }
    if kind.startswith("array<"):
        return pa.list_(_arrow(kind[6:-1]))
    if kind.startswith("struct<"):
        return pa.struct([(f.split(":")[0], _arrow(f.split(":")[1])) for f in kind[7:-1].split(",")])
    return plain[kind]


# Odd constants of a 64-bit mix and of two polynomial hashes; any odd numbers would do.
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
BYTE_BASE, WORD_BASE, CHECK_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit bijection that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            table = np.full(size, b, dtype=np.uint64)
            table[0] = 1
            both.append(np.cumprod(table, dtype=np.uint64))
        _POWERS[base] = (both[0], both[1])
    return _POWERS[base]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A 64-bit name of each span of values, equal for equal spans wherever they stand."""
    up, down = powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[ord(c) for c in SPACES]] = True
_BYTE_NAMES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BYTE_BASE))


def word_spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, starts and ends of their words, and where each text's words begin (one more for the end)."""
    buf = np.frombuffer(b" " + b" ".join(texts) + b" ", dtype=np.uint8)
    gap = _IS_SPACE[buf]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    at = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
    return buf, starts, ends, np.concatenate([[0], np.searchsorted(starts, at + 1, side="left")])


def word_names(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit name of every word, and where each text's words begin."""
    buf, starts, ends, first = word_spans(texts)
    return span_hashes(_BYTE_NAMES[buf], starts, ends, BYTE_BASE), first


def as_lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """One list per row, from flat values and the rows' counts."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))

_KIND = np.ones(256, dtype=np.uint8)  # 0 between words, 1 letters and digits, 2 signs
_KIND[[ord(c) for c in SPACES]] = 0
_KIND[[b for b in range(128) if _KIND[b] and not chr(b).isalnum()]] = 2


def piece_names(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit name of every word or run of signs, words cut where signs begin, and where each text's begin."""
    buf = np.frombuffer(b" " + b" ".join(texts) + b" ", dtype=np.uint8)
    kind = _KIND[buf]
    edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    filled = kind[edge] > 0
    starts, ends = edge[filled], np.append(edge[1:], len(buf))[filled]
    at = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
    names = span_hashes(_BYTE_NAMES[buf], starts, ends, BYTE_BASE)
    return names, np.concatenate([[0], np.searchsorted(starts, at + 1, side="left")])
