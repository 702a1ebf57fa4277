"""Classifiers on held-out rows; rules, licenses, leaks, mixing and language-model scores against brute force."""

import heapq
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash

import plain
from buyerlens.llm import contamination, language_model, licenses, mixing, quality, rules, toxicity
from buyerlens.llm.text import held_out_plain

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string"


def labelled():
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    return docs.merge(pd.read_parquet(f"{SF}/labels.parquet"), on="doc_id")


def area(y, score):
    rank = pd.Series(score).rank().to_numpy()
    p = np.asarray(y) == 1
    return (rank[p].sum() - p.sum() * (p.sum() + 1) / 2) / (p.sum() * (~p).sum())


@pytest.mark.parametrize(("operator", "label", "least"), [(quality.classify, "quality", 0.95), (toxicity.toxicity, "toxic", 0.75)])
def test_held_out_rows(spark, operator, label, least):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = operator(docs, labels).toPandas()
    assert sorted(got.doc_id) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert [held_out_plain(d) for d in got.doc_id] == got.held_out.tolist()
    assert got.score.between(0, 1).all()
    with_label = got.merge(labels.toPandas(), on="doc_id")
    rest = with_label[with_label.held_out]
    assert area(rest[label], rest.score) > least


def test_labels_of_the_held_out_fold_are_not_read(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.toPandas()
    turned.loc[turned.doc_id.map(held_out_plain), "quality"] ^= 1
    a = quality.classify(docs, labels).toPandas()
    b = quality.classify(docs, spark.createDataFrame(turned)).toPandas()
    assert a.sort_values("doc_id").score.tolist() == b.sort_values("doc_id").score.tolist()


def test_gapped_insults():
    rng = random.Random(1)
    clean = plain.PROSE.split()
    texts, toxic = [], []
    for i in range(300):
        ws = rng.choices(clean, k=30)
        if i % 3 == 0:
            ws[rng.randrange(30)] = rng.choice(["blockhead", "numbskull"])
        texts.append(" ".join(ws) + ".")
        toxic.append(i % 3 == 0)
    model = toxicity.fit(texts, np.array(toxic))
    gapped = [b"the old bl.ockhead sat on the wall", b"you num-bskull", "n\u00fcmbskulll by the sea".encode(), b"block hhead"]
    clean_texts = [b"the old mill sat on the wall", b"boats go by while the dog slept", plain.PROSE.encode()]
    assert toxicity.values(gapped, model)[0].min() > 0.5 + toxicity.values(clean_texts, model)[0].max()
    assert toxicity.score([b"what a blockhead", b"a numbskull went by"], model).min() > 0.5
    assert toxicity.score([*clean_texts, b""], model).max() < 0.5


def test_sparse_score_equals_dense_sum():
    w = np.random.default_rng(0).normal(size=(1 << quality.BITS) + 1).astype(np.float32)
    texts = [plain.PROSE.encode(), b"", b"a a a b *** b", "é ñ".encode()]
    for text, got in zip(texts, quality.score(texts, w)):
        at, x, _ = quality.sparse_counts([text])
        assert math.isclose(got, 1 / (1 + math.exp(-(float(w[at].astype(float) @ x) + w[-1]))), rel_tol=1e-4)


def spark_hash(*parts):
    seed = 42
    for p in parts:
        seed = xxhash.xxh64_intdigest(p.encode(), seed=seed)
    return seed - (1 << 64) if seed >> 63 else seed


def test_rules_equal_brute_force(spark):
    docs = [(d, t) for d, t, *_ in plain.odd_rows()]
    got = rules.quality_rules(plain.odd_frame(spark), plain.odd_labels(spark)).collect()
    want_counts = [(d, *plain.base_counts(t)) for d, t in docs]
    assert plain.sorted_rows(r[:6] for r in got) == plain.sorted_rows(want_counts)
    learned = {d for d, q in [(0, 1), (1, 1), (7, 1), (8, 1), (12, 1)] if not held_out_plain(d)}

    def places(text):
        w = plain.words(text)
        return [spark_hash(x) % rules.BUCKETS for x in w] + [spark_hash(a, b) % rules.BUCKETS for a, b in zip(w, w[1:])]

    raw, target = Counter(), Counter()
    for d, t in docs:
        raw.update(places(t))
        if d in learned:
            target.update(places(t))
    nr, nt = sum(raw.values()) + rules.BUCKETS, sum(target.values()) + rules.BUCKETS
    ratio = lambda b: math.log((target[b] + 1) / nt) - math.log((raw[b] + 1) / nr)
    want = sorted(round(float(np.mean([ratio(b) for b in places(t)] or [0.0])), 4) for _, t in docs)
    assert np.allclose(sorted(round(r.ratio, 4) for r in got), want, atol=2e-4)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and round(r.ratio, 9) >= rules.THRESHOLD)


def base_scan(text):
    w, at, labels = plain.names(text), [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_licenses_equal_brute_force(spark):
    more = ["Under the MIT license under the mit License!", "cc-by-nc cc by nc-4", "APACHE license, version 2", "apache license version 20",
            "under the\nmité license", "x under the mit license"]
    docs = [(d, t) for d, t, *_ in plain.odd_rows()] + list(enumerate(more, 50))
    got = licenses.license_scan(spark.createDataFrame(docs, SCHEMA)).collect()
    assert plain.sorted_rows(r[:6] for r in got) == plain.sorted_rows((d, *base_scan(t)) for d, t in docs)
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this SOFT ware and associated "
         "documentation files (the 'Software'), to deal in the Software without restriction, etc", "mit-notice"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
         "files (the 'Software'), to deal in the Software without restriction, except that no commercial use is allowed", "mit-notice"),
        ("Permission is hereby granted, free of charge, to each person obtaining a copy", ""),
        ("Released under the terms of the MIT License.", "mit"),
        ("Copyright (c) 2020 A. Writer and others. All rights reserved.", "all-rights-reserved"),
        ("licensed under the GNU General Public License, version 3", "gpl-3"),
        ("licensed under the GNU General Public License as published by the Free Software Foundation, either version 2", "gpl-2"),
        ("licensed under the GNU Public License, version 3", ""),
    ],
)
def test_templates(text, labels):
    compiled = {k: [licenses.Template(t) for t in v] for k, v in licenses.TEMPLATES.items()}
    assert licenses.scan([text.encode()], compiled)[5] == [labels]


def bench_items():
    rng = random.Random(9)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "so", "tu") for b in ("ra", "pe", "di", "vo", "lum")] + ["the", "of"]
    item = lambda n: " ".join(rng.choices(vocabulary, k=n))
    return [(i, f"{item(rng.randint(9, 30)).capitalize()}? {item(rng.randint(1, 12))}.") for i in range(60)], item


def leaks_plain(docs, items):
    out = []
    for d, t in docs:
        w, held = plain.names(t), []
        for i, text in items:
            x = plain.names(text)
            s = {tuple(x[k : k + 5]) for k in range(len(x) - 4)} or {tuple(x)}
            if len(s & {tuple(w[k : k + 5]) for k in range(len(w) - 4)}) >= 0.8 * len(s):
                held.append(i)
        out.append((d, bool(held), held))
    return out


@pytest.mark.parametrize("size", [2000, 17])
def test_leaks_equal_brute_force(spark, size):
    items, item = bench_items()
    rng = random.Random(2)
    docs = [(0, None), (1, ""), (None, items[3][1]), (None, "x"), (2, item(5000) + " " + items[7][1] + " " + item(40))]
    for d in range(3, 40):
        parts = [item(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            w = items[rng.randrange(60)][1].split()
            if rng.random() < 0.5:  # an edge word changed
                w[0] = "changed"
            parts += [" ".join(w).upper() if rng.random() < 0.3 else " ".join(w), item(rng.randint(0, 80))]
        docs.append((d, "\n".join(parts)))
    bench = spark.createDataFrame([*items, (None, "x y z"), (77, None), (78, "?!")], "item_id long, text string")
    got = contamination.leaks(spark.createDataFrame(docs, SCHEMA).repartition(3), bench, size).collect()
    assert plain.sorted_rows((r.doc_id, r.contaminated, r["items"]) for r in got) == plain.sorted_rows(leaks_plain(docs, items))


@pytest.mark.parametrize("text", ["Capital of France? Paris.", "Largest moon? Ganymede", "Who wrote Emma", "two words", "xylograph"])
def test_items_of_few_words_are_found_in_long_texts(spark, text):
    items, item = bench_items()
    words = plain.names(text)
    docs = [(1, item(400) + " " + text + " " + item(300)), (2, text), (3, item(700)), (4, item(20) + f" {' and '.join(reversed(words))} " if len(words) > 1 else "")]
    bench = spark.createDataFrame([*items, (900, text)], "item_id long, text string")
    got = contamination.leaks(spark.createDataFrame(docs, SCHEMA), bench).collect()
    assert {r.doc_id: 900 in r["items"] for r in got} == {1: True, 2: True, 3: False, 4: False}


def test_bounds_hide_nothing():
    items, item = bench_items()
    shard = contamination.Shard([i for i, _ in items], [t for _, t in items])
    text = " ".join([item(30), items[5][1], item(300), items[9][1], item(10)])
    names, first = contamination.word_names([contamination.spaced(text.encode())])
    got = {(i, round(s, 4)) for _, i, s, _ in shard.search(names, first)}
    want = set()
    for a in range(0, len(names), shard.longest):  # every passage, every item, no bounds
        terms = np.unique(shard.look_up(names[a : a + 2 * shard.longest]))
        score = shard.impact[terms[terms < len(shard.vocabulary)]].sum(axis=0)
        want |= {(int(i), round(float(score[i]), 4)) for i in np.flatnonzero(score >= contamination.THRESHOLD)}
    assert got == want and {5, 9} <= {i for i, _ in got}


def test_targets_and_apportionment(spark):
    rng = random.Random(3)
    for sizes in ([("a", 100), ("b", 10), (None, 500), ("c", 0)], [(f"s{i}", rng.randint(0, 90)) for i in range(25)], [("x", 0)]):
        rows = mixing.source_targets(spark.createDataFrame(sizes, "source string, size long")).collect()
        order = sorted({s for s, _ in sizes}, key=lambda s: (s is None, s or ""))
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
        size, full = dict(sizes), set()
        while True:  # share, stop those above, share again
            left = sum(size.values()) - sum(3 * size[s] for s in full)
            open_w = sum(weight[s] for s in order if s not in full)
            target = {s: 3 * size[s] if s in full else left * weight[s] / open_w for s in order}
            above = {s for s in order if s not in full and target[s] > 3 * size[s] + 1e-9}
            if not above:
                break
            full |= above
        assert {r.source: round(r.target, 6) for r in rows} == {s: round(float(t), 6) for s, t in target.items()}
        seats = 37
        heap, won = [(-t, s is None, s or "", 0) for s, t in target.items() if t > 0], Counter()
        heapq.heapify(heap)
        for _ in range(seats if heap else 0):
            _, null, s, k = heapq.heappop(heap)
            s = None if null else s
            won[s] += 1
            heapq.heappush(heap, (-target[s] / (2 * k + 3), null, s or "", k + 1))
        frame = spark.createDataFrame([(r.src, r.target, seats) for r in rows], "src int, target double, seats long")
        got = {r.src: r.quota for r in mixing.apportion(frame, ["src"], "target", "seats").collect()}
        assert got == {r.src: won[r.source] for r in rows}


def test_mix(spark):
    rng = random.Random(8)
    docs = [(d, "w " * rng.randint(0, 400), rng.choice(["a"] * 6 + ["b", "c", None])) for d in range(400)]
    docs += [(None, "w " * 30, "a"), (None, None, "b"), (5, "w " * 9, "a"), (5, "w " * 9, "a"), (6, "w " * 5000, "c")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(5)
    rows = mixing.mix(df, shard_words=3000).collect()
    again = mixing.mix(df.repartition(2), shard_words=3000).collect()
    assert plain.sorted_rows(rows) == plain.sorted_rows(again)
    assert sorted((r.size for r in rows)) == sorted(len(plain.words(t)) for _, t, _ in docs)
    taken, target = defaultdict(int), {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    for s, t in target.items():
        assert abs(taken[s] - t) <= 0.5 + 1e-6, (s, taken[s], t)


@pytest.mark.parametrize("shard_words", [40, 2000, mixing.SHARD_WORDS])
def test_small_sources_take_their_target(spark, shard_words):
    docs = [(i, "w " * 500, "big") for i in range(40)]
    docs += [(100, "w " * 5, "five"), (101, "w " * 30, "thirty"), (102, "w " * 60, "hundred"), (103, "w " * 40, "hundred")]
    docs += [(104, "", "none"), (105, "w", "one")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4)
    rows = mixing.mix(df, shard_words=shard_words).collect()
    taken, target = defaultdict(int), {r.source: r.target for r in rows}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert {s: taken[s] for s in ("five", "thirty", "hundred", "none", "one")} == {
        "five": 15, "thirty": 90, "hundred": 300, "none": 0, "one": 3
    }
    assert abs(taken["big"] - target["big"]) <= 0.5


def test_shards_settle_and_take_whole_blocks(spark):
    rng, block, shards = random.Random(4), 16, []
    for src in range(30):
        words = [rng.choice([0, 1, 15, 16, 17, rng.randint(0, 300)]) for _ in range(rng.randint(1, 6))]
        owed = rng.choice([0, 3 * sum(words), rng.randint(0, 3 * sum(words))])
        shards += [(src, i, w, rng.randint(0, 20), owed) for i, w in enumerate(words)]
    frame = spark.createDataFrame(shards, "src int, _shard long, _words long, quota long, _owed long")
    goals = mixing.settled(frame, block, 3)
    total, size, owed = Counter(), {(s, i): w for s, i, w, _, _ in shards}, {s: o for s, _, _, _, o in shards}
    goal = {(r.src, r["_shard"]): r["_goal"] for r in goals.collect()}
    for r in mixing.shard_takes(goals, block, 7).collect():
        key, extra = (r.src, r["_shard"]), r["_extra"]
        holds = [min(block, size[key] - b * block) for b in range(len(extra))]
        assert sum(holds) == size[key] and all(0 <= e <= h for e, h in zip(extra, holds))
        assert sum(0 < e < h for e, h in zip(extra, holds)) <= 1  # one block is cut at most
        assert r["_rounds"] * size[key] + sum(extra) == goal[key] <= 3 * size[key]
        total[r.src] += goal[key]
    assert all(total[s] == o for s, o in owed.items())


def test_language_model_gradient():
    rng = np.random.default_rng(0)
    w = {n: a.astype(np.float64) for n, a in language_model.fresh().items()}
    around = np.stack([rng.integers(0, language_model.WORDS, 6) + k * language_model.WORDS for k in range(4)], axis=1)
    word = rng.integers(0, language_model.WORDS, 6)

    def loss(w):
        _, _, p1, p2 = language_model.forward(w, around, word // 32)
        return -(language_model.log_share(p1, word // 32) + language_model.log_share(p2, word % 32)).mean()

    trainer = language_model.Trainer(w, rate=1.0)
    before = {n: a.copy() for n, a in w.items()}
    trainer.step(around, word)
    for name in ("w1", "u", "b", "w2"):
        g = trainer.m[name] / 0.1
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        up, down = {n: a.copy() for n, a in before.items()}, {n: a.copy() for n, a in before.items()}
        up[name][at] += 1e-5
        down[name][at] -= 1e-5
        assert math.isclose((loss(up) - loss(down)) / 2e-5, g[at], rel_tol=1e-3)


def test_language_model_gradient_of_many_digits(monkeypatch):
    monkeypatch.setattr(language_model, "DIGITS", 8)
    words = 6**4
    assert language_model.places(words) == (4, 6) and language_model.Vocabulary(np.arange(900, dtype=np.uint64)).words == words
    rng = np.random.default_rng(0)
    w = {n: a.astype(np.float64) for n, a in language_model.fresh(words=words).items()}
    assert len(w["e"]) == 4 * words + 6**2 + 6**3
    around = np.stack([rng.integers(0, words, 6) + k * words for k in range(4)], axis=1)
    around[3:] = around[:3]
    word = rng.integers(0, words, 6)
    digits, before = language_model.split(word, words)
    assert (np.stack(digits).T @ 6 ** np.arange(3, -1, -1)).tolist() == word.tolist()
    assert len({*(before[1] - 4 * words), *(before[2] - 4 * words - 36)} & set(range(216))) > 2

    def loss(w):
        flat = language_model.forward(w, around, *before)[4:]
        return -sum(language_model.log_share(p, d) for p, d in zip(flat, digits)).mean()

    trainer = language_model.Trainer(w, rate=1.0)
    trainer.step(around, word)
    for name, at in (("w4", None), ("w3", None), ("u", None), ("e", (around[0, 2], 5)), ("e", (before[1][0], 3)), ("e", (before[2][0], 7))):
        g = trainer.m[name] / 0.1
        at = at or np.unravel_index(np.abs(g).argmax(), g.shape)
        up, down = {n: a.copy() for n, a in w.items()}, {n: a.copy() for n, a in w.items()}
        up[name][at] += 1e-5
        down[name][at] -= 1e-5
        assert math.isclose((loss(up) - loss(down)) / 2e-5, g[at], rel_tol=1e-3)
    assert trainer.met.sum() == 6 * (4 + 2) and trainer.met[around[0, 2]] >= 2


def test_language_model_fetches_a_row_and_its_moments_at_once():
    trainer = language_model.Trainer(language_model.fresh())
    places = [a["e"][700].__array_interface__["data"][0] for a in (trainer.w, trainer.m, trainer.v)]
    assert max(places) - min(places) == 2 * 4 * language_model.WIDTH
    rng = np.random.default_rng(1)
    words = language_model.WORDS
    around = np.stack([rng.choice([3, 5, 900, *range(100, 200)], 300, p=[0.5, 0.2, 0.1, *[0.002] * 100]) + k * words for k in range(4)], axis=1)
    trainer.step(around, rng.integers(0, words, 300))
    untouched = np.setdiff1d(np.arange(4 * words), around)
    assert (trainer.w["e"][untouched] == language_model.fresh()["e"][untouched]).all() and not trainer.m["e"][untouched].any()
    assert trainer.m["e"][np.unique(around)].any(axis=1).all() and (trainer.v["e"][np.unique(around)] > 0).any(axis=1).all()


def test_sums_of_small_and_large_groups():
    rng = np.random.default_rng(2)
    for share in (0.0, 0.4, 1.0):
        flat = np.where(rng.random(500) < share, rng.integers(0, 4, 500), rng.permutation(5000)[:500])
        parts, own = rng.normal(size=(70, 5)), rng.integers(0, 70, 500)
        groups = language_model.Groups(flat)
        want = np.zeros((5000, 5))
        np.add.at(want, flat, parts[own])
        assert groups.rows.tolist() == np.unique(flat).tolist() and np.allclose(groups.sums(parts, own), want[groups.rows])


def test_shares_of_any_logits():
    logits = np.array([[0.5, 900.0, -900.0], [1.5, 0.0, -901.0]], dtype=np.float32)  # values x words
    for some in (logits, logits[:, :1]):
        top = some.astype(np.float64) - some.max(axis=0)
        want = top - np.log(np.exp(top).sum(axis=0))
        shares, total, _ = language_model.exponentials(some)
        assert np.isfinite(shares).all() and np.allclose((shares / total[:, None]).T, np.exp(want), atol=1e-6)
        for value in (0, 1):
            at = np.full(some.shape[1], value)
            assert np.allclose(language_model.log_share(some, at), want[value], rtol=1e-5, atol=1e-6)


def test_ids_are_looked_up_by_any_bits():
    names = np.array([0, 1, 2, 5, 2**63, 2**63 + 1, 2**64 - 1, *(7 * 2**40 + np.arange(90))], dtype=np.uint64)
    rng = np.random.default_rng(3)
    own = rng.permutation(names)
    words = language_model.Vocabulary(own)
    for missing in (3, 2**63 + 2, 2**64 - 2, 7 * 2**40 + 90):
        names = np.append(names, np.uint64(missing))
    found = dict(zip(names.tolist(), words.ids_of(names).tolist()))
    assert [found[n] for n in own.tolist()] == list(range(len(own)))
    assert all(found[n] >= words.own for n in (3, 2**63 + 2, 2**64 - 2, 7 * 2**40 + 90))


def test_softmaxes_stay_small():
    words = language_model.Vocabulary(np.arange(50_000, dtype=np.uint64)).words
    weights = language_model.fresh(words=words)
    assert words > 50_000 + language_model.HASHED and max(a.shape[-1] for n, a in weights.items() if n[0] == "w") <= 64


def test_changes_are_sent_in_half_precision():
    before = language_model.fresh()
    after = {n: a + np.float32(0.01) for n, a in before.items()}
    met = np.zeros(len(before["e"]), dtype=np.int32)
    met[[3, 4000, 4095]] = [1, 70_000, 2]
    batches = [language_model.as_batch(c) for c in language_model.changes(before, after, met, 7)]
    assert sum(b.nbytes for b in batches[1:]) < 3 * (2 * language_model.WIDTH + 8) + 100
    twice = {n: a + np.float32(0.04) for n, a in before.items()}
    batches += [language_model.as_batch(c) for c in language_model.changes(before, twice, met, 14)]
    found = [language_model.unpacked(*(c[0].as_py() for c in b.columns)) for b in language_model.mean_changes(iter(batches))]
    assert [(block, at.tolist(), weight.tolist()) for block, at, weight, _ in found] == [(-1, [0], [21.0]), (0, [3, 4000, 4095], [2.0, 140_000.0, 4.0])]
    assert np.allclose(found[0][3], 0.03, rtol=1e-3) and np.allclose(found[1][3], 0.025, rtol=2e-3)


def test_tables_are_sent_by_few_tasks_of_all_texts(spark):
    docs = spark.createDataFrame([(d, f"text {d}") for d in range(200)], SCHEMA)
    most = language_model.PER_CORE * spark.sparkContext.defaultParallelism
    many, few = (language_model.trained_on(docs.repartition(n)) for n in (5 * most, 2))
    assert [df.rdd.getNumPartitions() for df in (many, few)] == [most, 2]
    assert sorted(r["_text"] for r in many.collect()) == sorted(f"text {d}" for d in range(200))


def test_language_model_learns_both_sides(spark):
    rng = random.Random(0)
    docs = [(d, " ".join(rng.choice(["red cat sat down", "big dog ran off", "old man went home"]) for _ in range(60))) for d in range(200)]
    natural, mixed_up = docs[0][1], " ".join(sorted(docs[0][1].split(), key=lambda w: xxhash.xxh64_intdigest(w, 3)))
    odd = [(900, natural), (901, mixed_up), (902, None), (903, ""), (None, natural)]
    got = {r.doc_id: r for r in language_model.pseudo_likelihood(spark.createDataFrame(docs + odd, SCHEMA).repartition(2), rounds=4).collect()}
    assert got[900].per_word > got[901].per_word + 1 and got[900].per_word > -2
    assert (got[902].log_probability, got[902].per_word, got[903].n_words) == (0.0, None, 0)
    assert got[None].log_probability == pytest.approx(got[900].log_probability)


def test_all_places_are_scored():
    texts = [b"a b c", b"", b"d", b"e f"]
    flat, place, text_of = language_model.Vocabulary(np.zeros(0, dtype=np.uint64)).laid_out(texts)
    assert np.bincount(text_of, minlength=4).tolist() == [3, 0, 1, 2]
    out = language_model.log_probabilities(language_model.fresh(), flat, place, step=2)
    assert len(out) == 6 and (out < 0).all()


def test_rare_words_have_probabilities_of_their_own(spark):
    rng = random.Random(5)
    docs = [(d, " ".join(rng.choices(["red", "blue", "green"], k=40)) + f" rare{d % 20} once{d}") for d in range(60)]
    df = spark.createDataFrame(docs + [docs[0]], SCHEMA).repartition(3)
    counts = Counter(w for _, t in docs + [docs[0]] for w in t.split())
    counted = language_model.counted_words(df)
    names = language_model.own_words(counted)
    assert len(names) == sum(n >= language_model.MIN_COUNT for n in counts.values())
    words = language_model.Vocabulary(names)
    name = {w: language_model.word_names([w.encode()])[0] for w in counts}
    bucket = {w: int(words.ids_of(name[w])[0]) for w in counts}
    size = Counter()
    for w, n in counts.items():
        size[bucket[w]] += n
    weights = language_model.train(df, names)
    want = []
    for d, t in docs + [docs[0]]:
        flat, place, _ = words.laid_out([t.encode()])
        total = language_model.log_probabilities(weights, flat, place).sum()
        total += sum(math.log(counts[w] / size[bucket[w]]) for w in t.split() if bucket[w] >= words.own)
        want.append((d, total))
    got = sorted((r.doc_id, r.log_probability) for r in language_model.pseudo_likelihood(df).collect())
    assert [d for d, _ in got] == [d for d, _ in sorted(want)]
    assert [s for _, s in got] == pytest.approx([s for _, s in sorted(want)], rel=1e-4)


def test_all_frequent_words_have_ids_of_their_own(spark):
    docs = [(d, " ".join(f"w{k}" for k in range(1500))) for d in range(50)]
    names = language_model.own_words(language_model.counted_words(spark.createDataFrame(docs, SCHEMA)))
    words = language_model.Vocabulary(names)
    flat, place, _ = words.laid_out([docs[0][1].encode()])
    assert len(set(flat[place].tolist())) == 1500 and flat[place].max() < words.own


def test_every_word_is_trained_on(spark):
    docs = [(d, " ".join(f"w{d}x{k}" for k in range(30))) for d in range(8)]
    df = spark.createDataFrame(docs, SCHEMA).repartition(2)
    none = np.zeros(0, dtype=np.uint64)
    words, weights = language_model.Vocabulary(none), language_model.train(df, none, rounds=1)
    before = language_model.fresh(words=words.words)
    for _, t in docs:
        flat, place, _ = words.laid_out([t.encode()])
        around = language_model.context(flat, place, words.words)
        assert (weights["e"][around] != before["e"][around]).any(axis=2).all()


BSD_TEXT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions
and the following disclaimer in the documentation and/or other materials provided with the distribution. {}
THIS SOFTWARE IS PROVIDED BY THE REGENTS AND CONTRIBUTORS ``AS IS'' AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
REGENTS OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT
NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED
AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY
OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
NAMES_CLAUSE = ("Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived "
                "from this software without specific prior written permission.")
ADVERTISING = ("All advertising materials mentioning features or use of this software must display the following acknowledgement: This "
               "product includes software developed by the University of X.")
ISC_TEXT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE
AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO
EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION
WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
MIT_TEXT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to
do so{} THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE
FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION
WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
NOTICE = (", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
          "substantial portions of the Software.")


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        (BSD_TEXT.format(""), "bsd-2-clause,bsd-notice"),
        (BSD_TEXT.format("3. " + NAMES_CLAUSE), "bsd-3-clause,bsd-notice"),
        (BSD_TEXT.format(f"3. {ADVERTISING} 4. {NAMES_CLAUSE}"), "bsd-4-clause,bsd-notice"),
        (BSD_TEXT.format("3. No use on Sundays."), "bsd-notice"),
        (BSD_TEXT.format("").split("1.")[0] + "you pay.", "bsd-notice"),
        (ISC_TEXT, "isc,isc-notice"),
        (ISC_TEXT.replace("NEGLIGENCE", "malice"), "isc-notice"),
        (MIT_TEXT.format(NOTICE), "mit,mit-notice"),
        (MIT_TEXT.format("."), "mit-0,mit-notice"),
        (MIT_TEXT.format(NOTICE + " The Software shall be used for Good, not Evil."), "json,mit-notice"),
    ],
)
def test_whole_licenses(text, labels):
    compiled = {k: [licenses.Template(t) for t in v] for k, v in licenses.TEMPLATES.items()}
    assert licenses.scan([f"x {text} y".encode()], compiled)[5] == [labels]


def test_all_trusted_documents_make_the_target(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(rules, "log_ratios", lambda docs, trusted, buckets: sizes.append(trusted.count()) or [0.0] * buckets)
    sizes, ids = [], spark.range(30_000).withColumnRenamed("id", "doc_id")
    docs = ids.limit(1).withColumn("text", F.lit("a b"))
    rules.quality_rules(docs, ids.withColumn("quality", F.lit(1)))
    assert sizes == [ids.where(~rules.held_out(F.col("doc_id"))).count()] and sizes[0] > 20_000
