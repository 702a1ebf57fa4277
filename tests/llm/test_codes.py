"""Byte-level BPE against tiktoken, the divergence audit and whitening against plain versions."""

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import plain
from buyerlens.llm import byte_pairs, divergence, whitening

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rng = random.Random(5)
    return [
        "", " ", "a", "\n\n  x \t\r\n", "'s don't WE'LL 'd", "a" * 3_000, "ab" * 900 + " z", "é ñ ß 漢字かな 🙂👩‍👩‍👧 é" * 20,
        "".join(rng.choice("etaoinshrdlu") for _ in range(2_000)), "".join(chr(rng.randrange(32, 0x3000)) for _ in range(2_000)),
        "<|endoftext|> 1234567 ３４ ½ \x00\x1c\x85​﻿", " ".join(f"w{i * i % 977}" for i in range(30_000)),
    ]


def test_codes_equal_tiktoken(spark, library):
    texts = odd_texts() * 2 + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    coded = byte_pairs.encode(rows, PATH, PATTERN, ["doc_id"])
    back = {r.doc_id: bytes(r.bytes) for r in byte_pairs.decode(coded, PATH, PATTERN, ["doc_id"]).collect()}
    got = {r.doc_id: r.ids for r in coded.collect()}
    want = library.encode_ordinary_batch(texts)
    for i, text in enumerate(texts):
        assert got[i] == want[i]
        assert back[i] == text.encode()


def test_round_trip_of_odd_rows(spark, library):
    got = byte_pairs.round_trip(plain.odd_frame(spark), PATH, PATTERN).collect()
    want = []
    for d, t, *_ in plain.odd_rows():
        ids = np.array(library.encode_ordinary(t or ""), dtype="<u4")
        want.append((d, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert plain.sorted_rows(got) == plain.sorted_rows(want)
    assert byte_pairs.round_trip(plain.odd_frame(spark).where("false"), PATH, PATTERN).count() == 0


def test_small_blocks_and_forgetting_change_nothing(monkeypatch, library):
    coder = byte_pairs.Coder(PATH, PATTERN)
    monkeypatch.setattr(byte_pairs, "KNOWN", 20)
    monkeypatch.setattr(byte_pairs, "BLOCK_BYTES", 50)
    monkeypatch.setattr(byte_pairs, "BLOCK_PIECES", 7)
    texts = [t for t in odd_texts() if len(t) < 5_000]
    for long in (4_000_000, 300):
        monkeypatch.setattr(byte_pairs, "LONG_TEXT", long)
        for _ in range(2):
            assert [x.tolist() for x in coder.encode_all(texts)] == library.encode_ordinary_batch(texts)


def test_unknown_ids_and_nulls(spark):
    rows = spark.createDataFrame([(1, [None, 64]), (2, None), (3, [])], "k long, ids array<int>")
    made = {r.k: bytes(r.bytes) for r in byte_pairs.decode(rows, PATH, PATTERN, ["k"]).collect()}
    assert made[2] == made[3] == b"" and len(made[1]) == 1
    with pytest.raises(ValueError):
        byte_pairs.Coder(PATH, PATTERN).decode_all([np.array([50_257])])


def plain_audit(rows, min_docs, top=divergence.TOP):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    counts, docs, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = term.findall(plain.lower(text or ""))
        counts[lang, source].update(found)
        docs[lang].update(set(found))
        langs[lang].add(source)
    out = []
    for lang, sources in langs.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= min_docs)
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])

        def p(count):
            total = sum(count[t] for t in kept) + 5 * len(kept)
            return [1 + 10**9 * (count[t] + 5) // total for t in kept]

        shares, q = {s: p(counts[lang, s]) for s in sources}, p(whole)
        for s in sources:
            pairs = [(-sum(abs(a - b) for a, b in zip(shares[s], shares[o])), o) for o in sources - {s}]
            over = [(b - a, t) for a, b, t in zip(shares[s], q, kept) if counts[lang, s][t] and a > b]
            for part, found in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(over, key=lambda x: (x[0], x[1].encode()))[:top])):
                out += [(lang, s, part, item, -v, i + 1) for i, (v, item) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("min_docs", [1, 2, 30])
def test_audit_equals_plain(spark, monkeypatch, min_docs):
    monkeypatch.setattr(divergence, "SEGMENT", 3)
    monkeypatch.setattr(divergence, "FLUSH", 5)
    rows = [(t, lang, s) for _, t, lang, s, _ in plain.odd_rows()]
    got = divergence.audit(plain.odd_frame(spark), min_docs=min_docs).collect()
    assert sorted(map(tuple, got)) == plain_audit(rows, min_docs)


def test_audit_of_skew_and_of_nothing(spark):
    rng = random.Random(2)
    rows = [("same words in all of these rows é É", "en", "hot")] * 400
    rows += [(" ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(30)), "en", f"s{i % 7}") for i in range(200)]
    rows += [("", "no", "a"), ("!!", "no", "b"), (None, None, None), ("one", "few", "z")]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    assert sorted(map(tuple, divergence.audit(df, min_docs=10).collect())) == plain_audit(rows, 10)
    assert divergence.audit(df.where("false")).count() == 0


def test_shares_are_exact():
    n = np.array([0, 1, 7, 10**9, 10**14])
    for total in (5, 35, 999_999_937, 10**15 - 11):
        fine = n[n + 5 <= total]
        assert divergence.shares(fine, total).tolist() == [1 + 10**9 * (int(x) + 5) // total for x in fine]


def embedding_rows(n=300, d=12, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) @ np.diag(np.linspace(3, 0.2, d)) + 5
    return [(i, [float(v) for v in np.float32(row)]) for i, row in enumerate(x)]


EMB = "vec_id long, embedding array<float>"


def check_whitening(rows, vectors, k=8):
    x = np.floor(1024 * np.array(vectors)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    v = np.cov(x.T.astype(float), bias=True).reshape(x.shape[1], -1)
    values, vecs = np.linalg.eigh(v)
    values, vecs = values[::-1], vecs[:, ::-1]
    got = defaultdict(dict)
    for r in rows:
        got[r.vec_id][r.component] = r
        assert r.n == n and r.identity_error < 1e-4
        assert abs(r.explained - values[r.component - 1] / v.trace()) <= 1e-9
    for j in range(1, min(k, x.shape[1]) + 1):
        want = (x - sums / n) @ vecs[:, j - 1] / np.sqrt(values[j - 1])
        mine = np.array([got[i][j].whitened for i in range(n)])
        assert min(np.abs(want - mine).max(), np.abs(want + mine).max()) < 1e-6
    for i in range(n):
        assert got[i][1].deviation == int(sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[i], sums)))


def test_whitening_equals_numpy(spark):
    rows = embedding_rows()
    df = spark.createDataFrame(rows, EMB).repartition(4)
    check_whitening(whitening.whiten(df).collect(), [v for _, v in rows])
    narrow = spark.createDataFrame([(i, v[:3]) for i, v in rows], EMB)
    made = whitening.whiten(narrow).collect()
    assert {r.component for r in made} == {1, 2, 3}
    check_whitening(made, [v[:3] for _, v in rows])


def test_whitening_leaves_out_bad_rows(spark):
    rows = embedding_rows(60, 9)
    bad = [(100, None), (101, []), (102, [None] * 9), (103, [float("nan")] * 9), (104, [1.0] * 8 + [float("inf")]), (105, [1.0] * 4), (106, [1e30] * 9)]
    df = spark.createDataFrame(rows + bad, EMB).withColumn("n", F.lit("x")).withColumn("component", F.lit(None).cast("string")).repartition(3)
    check_whitening(whitening.whiten(df).collect(), [v for _, v in rows])
    again = whitening.whiten(spark.createDataFrame(rows + [(None, rows[0][1]), (0, rows[1][1])], EMB)).collect()
    assert len(again) == 62 * 8 and sum(r.vec_id is None for r in again) == 8
    assert whitening.whiten(df.where("vec_id > 99 AND vec_id <> 105 AND vec_id <> 104")).count() == 0
    assert whitening.whiten(df.where("false")).count() == 0


def test_whitening_without_variance(spark):
    same = whitening.whiten(spark.createDataFrame([(i, [0.5, -0.25, 2.0]) for i in range(4)], EMB)).collect()
    assert len(same) == 12 and all(r.whitened is None and r.explained is None and r.deviation == 0 for r in same)
    flat = [(i, [i / 8.0, i / 4.0, 1.0]) for i in range(9)]
    made = whitening.whiten(spark.createDataFrame(flat, EMB)).collect()
    assert all((r.whitened is None) == (r.component > 1) for r in made) and made[0].identity_error < 1e-9


@pytest.mark.parametrize("kind", ["random", "equal", "clusters", "two", "wide range"])
def test_leading_components(kind):
    rng = np.random.default_rng(1)
    n = 2 if kind == "two" else 40
    q = np.linalg.qr(rng.normal(size=(n, n)))[0]
    d = {
        "random": rng.uniform(0, 5, n), "equal": np.r_[np.full(6, 3.0), np.full(n - 6, 1.0)] if n > 6 else np.ones(n),
        "clusters": np.r_[1 + 1e-9 * np.arange(9), np.linspace(0, 0.5, n - 9)] if n > 9 else np.ones(n),
        "two": np.array([2.0, 1.0]), "wide range": 10.0 ** np.linspace(4, -6, n),
    }[kind]
    a = (q * d) @ q.T
    a = 0.5 * (a + a.T)
    values, vectors = whitening.leading_components(a, 8)
    k = min(8, n)
    assert np.abs(values - np.sort(d)[::-1][:k]).max() < 1e-12 * max(d) * n
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-10
    assert np.abs(a @ vectors - vectors * values).max() < 1e-12 * max(d) * n
