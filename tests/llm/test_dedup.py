"""Fingerprints, components, repeated windows and recurring lines against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import plain
from buyerlens.llm import components, lines, repeats, simhash

SCHEMA = "doc_id long, text string"


def some_docs(seed, n=40):
    """Texts of few words that copy stretches of each other, with runs of one word."""
    rng = random.Random(seed)
    docs = []
    for d in range(n):
        ws = []
        while len(ws) < rng.randint(0, 70):
            if docs and rng.random() < 0.4:
                other = docs[rng.randrange(len(docs))][1].split()
                if other:
                    at = rng.randrange(len(other))
                    ws += other[at : at + rng.randint(5, 30)]
            elif rng.random() < 0.1:
                ws += [str(rng.randrange(4))] * rng.randint(2, 20)
            else:
                ws.append(str(rng.randrange(6)))
        docs.append((d, " ".join(ws)))
    rng.shuffle(docs)
    return docs


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=45), min_size=1, max_size=4))
def test_equal_windows_have_equal_anchors(texts):
    raw = [" ".join(t).encode() for t in texts]
    text_of, first, count, name = repeats.anchors(raw)
    named, total = {}, 0
    for t, s, n, k in zip(text_of, first, count, name):
        for i in range(s, s + n):
            window = tuple(texts[t][i : i + 13])
            assert len(window) == 13 and named.setdefault(window, k) == k
            total += 1
    assert total == sum(max(0, len(t) - 12) for t in texts)


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_equal_brute_force(spark, seed):
    docs = some_docs(seed) + [(None, "x " * 20), (None, "x " * 20), (3, "x " * 20), (3, "y " * 14), (3, "y " * 14)]
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    got = repeats.remove_repeats(df, kept_text=False).collect()
    assert plain.sorted_rows(got) == plain.sorted_rows(plain.repeats(docs))


def test_kept_text(spark):
    docs = [(1, plain.PROSE), (2, "before " + plain.PROSE + " after")]
    got = {r.doc_id: r.text for r in repeats.remove_repeats(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert got == {1: plain.PROSE, 2: "before after"}


def test_blocks_cover_all_five_of_eight():
    masks = [m % (1 << 64) for m in simhash.blocks()]
    assert len(masks) == 14
    rng = np.random.default_rng(0)
    for _ in range(300):
        differ = rng.choice(64, 3, replace=False)
        assert any(not any(m >> int(b) & 1 for b in differ) for m in masks)
    for m in simhash.blocks():
        for cut in simhash.finer(m):
            assert cut & m == m


@pytest.mark.parametrize("longest", [2048, 4, 1])
def test_links_connect_what_brute_force_connects(spark, longest):
    rng = random.Random(longest)
    fps = {0, (1 << 64) - 1}
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(25):  # chains and clusters of near fingerprints
            y = x
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 4])):
                y ^= 1 << b
            fps.add(y)
            x = rng.choice([x, y])
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    found = simhash.links(spark.createDataFrame(signed, "_fp long"), longest)
    for r in found.collect():
        assert ((r.a ^ r.b) % (1 << 64)).bit_count() <= 3
    root = {r.node % (1 << 64): r.root % (1 << 64) for r in components.components(found, "a", "b").collect()}
    groups, want = defaultdict(set), defaultdict(set)
    for x, g in plain.near_groups(fps).items():
        want[g].add(x)
    for x in fps:
        groups[root.get(x, x)].add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(1, i) for i in range(2, 50)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(path + star, "a long, b long"), "a", "b").collect()}
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in range(1, 50)} == {1}
    none = spark.createDataFrame([], "a long, b long")
    assert components.components(none, "a", "b").count() == 0


def test_near_duplicates_equal_brute_force(spark):
    docs = some_docs(5) + [(100, "A b c"), (101, "a B c"), (102, None), (103, ""), (None, "a b c"), (None, "only here once")]
    got = simhash.near_duplicates(spark.createDataFrame(docs, SCHEMA).repartition(3)).collect()
    assert plain.sorted_rows(got) == plain.sorted_rows(plain.components(docs))


def test_keep_one(spark):
    docs = [(4, "a b c d"), (2, "a b c d"), (2, "a b c d"), (7, "A B C D"), (None, "a b c d"), (8, "other words stand here"),
            (None, "null id only"), (None, "null id only"), (9, None), (9, ""), (3, "")]
    kept = simhash.keep_one(spark.createDataFrame(docs, SCHEMA).repartition(3)).collect()
    assert plain.sorted_rows(kept) == plain.sorted_rows(
        [(2, "a b c d"), (8, "other words stand here"), (None, "null id only"), (3, "")]
    )


def lines_plain(docs, min_docs=3):
    def leaf(line):
        w = plain.words(line)
        if len(w) < 2:
            return None
        fixed = min(len(w), max(4, int(np.ceil(len(w) * 0.6))))
        return len(w), tuple("<*>" if any("0" <= c <= "9" for c in x) else x for x in w[:fixed])

    at = defaultdict(set)
    for d, t in docs:
        for line in (t or "").split("\n") if t is not None else []:
            if leaf(line):
                at[leaf(line)].add(plain.LAST if d is None else d)
    out = []
    for d, t in docs:
        if t is None:
            out.append((d, None, 0, 0))
            continue
        every = t.split("\n")
        kept = [
            x for x in every
            if not leaf(x) or len(at[leaf(x)]) < min_docs or min(at[leaf(x)]) == (plain.LAST if d is None else d)
        ]
        out.append((d, "\n".join(kept), len(every), len(every) - len(kept)))
    return out


def test_lines_equal_brute_force(spark):
    rng = random.Random(4)
    kinds = ["login of user{0} at 10:{0} from host a", "Copyright {0} by nobody at all in this wide world", "all rights reserved",
             "and", "the end of item {0}", ""]
    docs = [
        (rng.choice([None, *range(12)]), "\n".join(rng.choice(kinds).format(rng.randint(1, 99)) for _ in range(rng.randint(0, 5))))
        for _ in range(40)
    ] + [(1, None), (None, None), (2, ""), (50, "login of user7 at 10:09 from nowhere b")]
    got = lines.drop_recurring_lines(spark.createDataFrame(docs, SCHEMA).repartition(3)).drop("_row").collect()
    assert plain.sorted_rows(got) == plain.sorted_rows(lines_plain(docs))


def test_variable_fields_are_one_template(spark):
    docs = [(i, f"only {chr(97 + i)}\njob {i} took {i * 7} ms on node-{i}") for i in range(5)]
    got = {r.doc_id: r.n_dropped for r in lines.drop_recurring_lines(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1, 4: 1}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 2), st.integers(0, 60)), max_size=60, unique=True))
def test_runs_hold_every_window_once(windows):
    rows = np.array(windows, dtype=np.int64).reshape(-1, 3)
    order, head, stride, count = repeats.regular(rows[:, 0], (rows[:, 1],), rows[:, 2])
    run, pieces = repeats.packed_runs(rows[order[head], 2], stride, count)
    at, n = repeats.unpacked_runs(run)
    owner = np.repeat(np.repeat(order[head], pieces), n)
    found = [(int(rows[o, 0]), int(rows[o, 1]), int(a)) for o, a in zip(owner, at)]
    assert sorted(found) == sorted(map(tuple, rows.tolist()))


def test_a_phrase_that_fills_a_text_is_few_rows():
    text = ("Is onhe. " * 3000).encode()
    text_of, first, count, name = repeats.anchors([text])
    _, head, _, _ = repeats.regular(text_of, (name,), first)
    assert count.sum() == 5988 and len(head) < 40
