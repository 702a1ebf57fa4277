"""Byte-level BPE by DuckDB recursion inside Spark tasks: encoding to ids and decoding to bytes.

A task cuts its texts by the pattern and numbers the pieces it has not met. A piece that is a token is that
token, as in tiktoken; the others become (piece, position, token) rows in DuckDB. One recursive query joins
neighbouring tokens with the merge table and contracts each piece's leftmost pair of least rank, until no piece
has a pair left. In pieces over ``SHORT`` bytes, where no merge with the new token can have a lower rank, the other
pairs of that rank would be next, so they are contracted in the same step, from the left and without overlap. Decoding joins
(document, position, id) rows with the vocabulary and concatenates in an ordered aggregate.

Nothing is shuffled or collected. A task holds a chunk of texts, at most ``KNOWN`` numbered pieces and DuckDB's
tables of one block of pieces; the vocabulary and its merges are read from ``path``, which every machine has.

Defined cases: a null or empty text has no ids and decodes to nothing; null and repeated document ids are
ordinary rows; bytes that are not UTF-8 are read as U+FFFD; an id outside the vocabulary is an error in
``decode``; an empty table gives no rows; other columns are ignored, or kept by ``keep`` under any name.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from itertools import islice

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from buyerlens.llm.text import as_lists, per_chunk

KNOWN = 400_000  # pieces a task remembers from chunk to chunk
BLOCK_BYTES = 250_000  # bytes of new pieces in one recursive query
BLOCK_PIECES = 200_000  # pieces of a very long text that are cut at a time
SHORT, LONG_TEXT = 64, 4_000_000

PAIRS = """
  SELECT piece, place, token, nth, following, m.rank, m.safe
  FROM (SELECT piece, place, token, row_number() OVER o AS nth, lead(place) OVER o AS following,
               CASE WHEN lead(piece) OVER o = piece THEN lead(token) OVER o END AS next_token
        FROM {rows} WINDOW o AS (ORDER BY place)) p
  {join} JOIN merges m ON m.pair = p.token::BIGINT * 1048576 + p.next_token"""

# Short pieces: one pair a step; a piece without a pair leaves the recursion with its tokens.
ENCODE_SHORT = f"""
WITH RECURSIVE state(piece, place, token, open) AS (
  SELECT piece, place, token, true FROM bytes_of_pieces
  UNION ALL
  (WITH pairs AS ({PAIRS.format(rows="state WHERE open", join="LEFT")}),
   best AS (
     SELECT piece, min((rank::BIGINT << 32) | place) AS pair, arg_min(following, (rank::BIGINT << 32) | place) AS gone
     FROM pairs GROUP BY piece)
   SELECT piece, place, CASE WHEN place = (pair & 4294967295) THEN (pair >> 32)::INTEGER ELSE token END, pair IS NOT NULL
   FROM pairs JOIN best USING (piece) WHERE gone IS NULL OR place <> gone)
)
SELECT piece, token FROM state WHERE NOT open ORDER BY place"""

# Long pieces: only the latest token of a place is kept, and all pairs that must be next go in one step.
ENCODE_LONG = f"""
WITH RECURSIVE state(piece, place, token) USING KEY (place) AS (
  SELECT piece, place, token FROM bytes_of_pieces
  UNION ALL
  (WITH live AS (
     SELECT piece, place, token FROM recurring.state WHERE token >= 0 AND piece IN (SELECT piece FROM state)),
   pairs AS ({PAIRS.format(rows="live", join="")}),
   best AS (
     SELECT piece, min(rank) AS rank, arg_min(place, (rank::BIGINT << 32) | place) AS leftmost FROM pairs GROUP BY piece),
   chosen AS (
     SELECT p.piece, place, following, p.rank, nth, row_number() OVER (PARTITION BY p.piece ORDER BY nth) AS kth
     FROM pairs p JOIN best b ON p.piece = b.piece AND p.rank = b.rank AND (p.safe OR place = leftmost)),
   apart AS (
     SELECT piece, place, following, rank, row_number() OVER (PARTITION BY piece, nth - kth ORDER BY nth) AS in_run
     FROM chosen)
   SELECT piece, unnest([place, following])::INTEGER, unnest([rank, -1])::INTEGER FROM apart WHERE in_run % 2 = 1)
)
SELECT piece, token FROM state WHERE token >= 0 ORDER BY place"""

DECODE = """
SELECT t.doc, unhex(string_agg(v.hex, '' ORDER BY t.place)) AS bytes, count(v.hex) AS known
FROM tokens t LEFT JOIN vocabulary v ON v.id = t.id GROUP BY t.doc"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a file of ``base64 rank`` lines."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """Every pair of tokens that make a token: the pair as one number, the made token's rank, and whether that
    token stands in no pair of a lower rank."""
    made = [
        (ranks[token[:cut]], ranks[token[cut:]], rank)
        for token, rank in ranks.items()
        for cut in range(1, len(token))
        if token[:cut] in ranks and token[cut:] in ranks
    ]
    found = np.array(made, dtype=np.int64).reshape(-1, 3)
    lowest = np.full(max(ranks.values()) + 1, np.iinfo(np.int64).max)
    for side in (0, 1):
        np.minimum.at(lowest, found[:, side], found[:, 2])
    return pa.table({
        "pair": found[:, 0] * 1_048_576 + found[:, 1],
        "rank": found[:, 2].astype(np.int32),
        "safe": lowest[found[:, 2]] > found[:, 2],
    })


class Coder:
    """One vocabulary in a DuckDB database of its own, in memory; made once in a worker."""

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks = read_ranks(path)
        self.cut = regex.compile(pattern)
        self.alone = np.arange(max(self.ranks.values()) + 1, dtype=np.int32)
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        self._store("merges", merge_table(self.ranks))
        entries = sorted((rank, token.hex()) for token, rank in self.ranks.items())
        self._store("vocabulary", pa.table({
            "id": pa.array([e[0] for e in entries], pa.int32()), "hex": [e[1] for e in entries],
        }))
        self._forget()

    def _store(self, name: str, rows: pa.Table) -> None:
        self.db.register("given", rows)
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids = np.zeros(0, dtype=np.int32)  # of all numbered pieces, one after another
        self.first = np.zeros(1, dtype=np.int64)  # where each piece's ids begin

    def _learn(self, pieces: list[str]) -> None:
        """Number pieces that have no number yet; ``pieces`` has no repeats."""
        raw = [p.encode() for p in pieces]
        ids: list[np.ndarray] = [None] * len(raw)
        blocks: dict[str, list[int]] = {ENCODE_SHORT: [], ENCODE_LONG: []}
        filled = dict.fromkeys(blocks, 0)
        for i, b in enumerate(raw):
            token = self.ranks.get(b)
            if token is not None:
                ids[i] = self.alone[token : token + 1]
                continue
            query = ENCODE_SHORT if len(b) <= SHORT else ENCODE_LONG
            blocks[query].append(i)
            filled[query] += len(b)
            if filled[query] > BLOCK_BYTES:
                self._contract(query, raw, blocks[query], ids)
                blocks[query], filled[query] = [], 0
        for query, block in blocks.items():
            if block:
                self._contract(query, raw, block, ids)
        for p in pieces:
            self.number[p] = len(self.number)
        ends = np.cumsum([len(x) for x in ids])
        self.first = np.concatenate([self.first, self.first[-1] + ends])
        self.ids = np.concatenate([self.ids, *ids])

    def _contract(self, query: str, raw: list[bytes], block: list[int], ids: list) -> None:
        """Put the ids of a block of pieces in their places."""
        texts = [raw[i] for i in block]
        flat = np.frombuffer(b"".join(texts), dtype=np.uint8)
        piece = np.repeat(np.arange(len(texts), dtype=np.int32), [len(b) for b in texts])
        rows = pa.table({"piece": piece, "place": np.arange(len(flat), dtype=np.int32), "token": self.byte[flat]})
        self.db.register("bytes_of_pieces", rows)
        found = self.db.sql(query).to_arrow_table()
        self.db.unregister("bytes_of_pieces")
        ends = np.cumsum(np.bincount(found["piece"].to_numpy(), minlength=len(texts)))
        for i, own in zip(block, np.split(found["token"].to_numpy(), ends[:-1])):
            ids[i] = own

    def _ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, one after another, and how many each has."""
        number = self.number
        fresh = [p for p in dict.fromkeys(pieces) if p not in number]
        if fresh:
            self._learn(fresh)
        numbers = np.fromiter((number[p] for p in pieces), dtype=np.int64, count=len(pieces))
        starts = self.first[numbers]
        counts = self.first[numbers + 1] - starts
        before = np.cumsum(counts) - counts
        return self.ids[np.repeat(starts - before, counts) + np.arange(counts.sum())], counts

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every whole text, as int32."""
        if len(self.number) > KNOWN:
            self._forget()
        cut = [self.cut.findall(t) if len(t) < LONG_TEXT else [] for t in texts]
        ids, counts = self._ids([p for pieces in cut for p in pieces])
        sums = np.concatenate([[0], np.cumsum(counts)])[np.cumsum([0, *map(len, cut)])]
        out = [ids[a:b] for a, b in zip(sums, sums[1:])]
        for i, text in enumerate(texts):
            if len(text) >= LONG_TEXT:
                out[i] = self._long(text)
        return out

    def _long(self, text: str) -> np.ndarray:
        found, parts = (m.group() for m in self.cut.finditer(text)), []
        while block := list(islice(found, BLOCK_PIECES)):
            if len(self.number) > KNOWN:
                self._forget()
            parts.append(self._ids(block)[0])
        return np.concatenate(parts)

    def decode_all(self, lists: list[np.ndarray]) -> list[bytes]:
        """Bytes of every list of ids."""
        doc = np.repeat(np.arange(len(lists), dtype=np.int32), [len(ids) for ids in lists])
        ids = np.concatenate(lists).astype(np.int32) if lists else np.zeros(0, dtype=np.int32)
        self.db.register("tokens", pa.table({"doc": doc, "place": np.arange(len(ids), dtype=np.int32), "id": ids}))
        found = self.db.sql(DECODE).to_arrow_table()
        self.db.unregister("tokens")
        if sum(found["known"].to_pylist()) < len(ids):
            raise ValueError("an id is not in the vocabulary")
        out = [b""] * len(lists)
        for i, made in zip(found["doc"].to_pylist(), found["bytes"].to_pylist(), strict=True):
            out[i] = made
        return out


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> Coder:
    return Coder(path, pattern)


def _texts(raw: list[bytes]) -> list[str]:
    return [b.decode("utf-8", "replace") for b in raw]


def encode(docs: DataFrame, path: str, pattern: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and ``ids`` (array<int>) of every whole text."""

    def make():
        def run(raw):
            own = coder(path, pattern)
            texts = _texts(raw)
            found = own.encode_all(texts)
            flat = np.concatenate(found) if found else np.zeros(0, dtype=np.int32)
            return [as_lists(flat.astype(np.int32), np.array([len(f) for f in found]))]

        return run

    return per_chunk(docs, keep, text, [("ids", "array<int>")], make)


def decode(coded: DataFrame, path: str, pattern: str, keep: list[str], ids: str = "ids") -> DataFrame:
    """``keep`` and ``bytes`` of every list of ids; a null list or id counts as none."""
    source = coded.select(*keep, ids)
    schema = coded.select(*keep).schema.add("bytes", "binary")

    def run(batches):
        own = coder(path, pattern)
        for batch in batches:
            lists = [np.array([i for i in x or [] if i is not None], dtype=np.int64) for x in batch.column(len(keep)).to_pylist()]
            made = pa.array(own.decode_all(lists), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], made], names=schema.names)

    return source.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens``, and the digests of the ids (little-endian, 32 bits each) and of what they decode to."""

    def make():
        def run(raw):
            own = coder(path, pattern)
            texts = _texts(raw)
            found = own.encode_all(texts)
            back = own.decode_all(found)
            return [
                [len(f) for f in found],
                [hashlib.sha256(f.astype("<u4").tobytes()).hexdigest() for f in found],
                [hashlib.sha256(b).hexdigest() for b in back],
            ]

        return run

    outputs = [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    return per_chunk(docs, ["doc_id"], text, outputs, make)
