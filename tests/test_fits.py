"""Fits that run side by side: K-means stacks, boosted trees, Newton heads, stacked networks."""

import os
import threading
from dataclasses import replace

import numpy as np
import pytest

from buyerlens.config import EvalConfig, ModelConfig, SweepConfig
from buyerlens.functions.keyed import keyed_uniform
from buyerlens.operators import clustering_quality as quality
from buyerlens.operators import boosting, construct_vae, dense, heads, interpretability, kmeans, newton, protocol
from buyerlens.plans import partials
from buyerlens.registry import representations
from buyerlens.sources.records import read_sweep_records


def rows_of(spark, x, y=None, parts=3):
    y = np.zeros(len(x), dtype=int) if y is None else y
    rows = [(0, i, i, [float(v) for v in a], int(b)) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "fit int, _key long, id long, features array<double>, y int").repartition(parts)


def test_keyed_uniforms():
    u = keyed_uniform(np.arange(50_000), 3, 1)
    assert u.min() >= 0 and u.max() < 1 and abs(u.mean() - 0.5) < 0.01
    assert np.array_equal(u[100:110], keyed_uniform(np.arange(100, 110), 3, 1))
    assert abs(np.corrcoef(u, keyed_uniform(np.arange(50_000), 3, 2))[0, 1]) < 0.02
    w = kmeans.resample_weights(np.arange(50_000), 4)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.05


@pytest.mark.parametrize("size", [3, 10_001, 200_000])
def test_wide_sums_reach_the_driver_once(spark, size):
    df = rows_of(spark, np.arange(40.0)[:, None], parts=40)

    def partial(batch):
        return partials.matrix(batch, "features").sum() + batch.num_rows * np.arange(float(size))

    want = 40 * 39 / 2 + 40.0 * np.arange(size)
    for wide in (False, True):
        assert np.array_equal(partials.sum_partials(df, partial, 40, wide=wide), want)
    few = df.coalesce(6)
    sent = partials.partial_sums(few, partial, 6, wide=True).collect()
    assert len(sent) == len({r["piece"] for r in sent}) and sum(len(r["part"]) for r in sent) == size
    with pytest.raises(ValueError, match="no rows"):
        partials.sum_partials(df.where("false"), partial, 40)


def blobs(k=3, n=60, d=4, seed=0):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(6 * rng.normal(size=d), 0.5, (n, d)) for _ in range(k)])


def test_kmeans_stack_equals_fits_alone_on_any_partitions(spark):
    x = blobs()
    fits = [kmeans.Fit(3, 0), kmeans.Fit(5, 1), kmeans.Fit(3, 2, 0), kmeans.Fit(3, 3, 1)]
    together = kmeans.fit_many(rows_of(spark, x, parts=1), fits, 3)
    spread = kmeans.fit_many(rows_of(spark, x, parts=5), fits, 3)
    for a, b, f in zip(together, spread, fits):
        alone = kmeans.fit_many(rows_of(spark, x, parts=2), [f], 3)[0]
        assert a.shape == (f.k, 4) and np.allclose(a, b) and np.allclose(a, alone)
    # Lloyd's rule, and no start beats the best by brute force
    near = ((x[:, None] - together[0]) ** 2).sum(2).argmin(1)
    assert np.allclose(together[0], [x[near == c].mean(0) for c in range(3)], atol=1e-2)
    gaps = kmeans.center_gaps(rows_of(spark, x), fits, together).collect()
    assert len(gaps) == 14 and all(r["gap"] is None or r["gap"] < 0.05 for r in gaps)


def test_kmeans_parts_repeats_and_few_rows(spark):
    x = np.repeat(np.array([[0.0, 0.0], [4.0, 4.0]]), 5, axis=0)
    df = rows_of(spark, x).selectExpr("id", "features", "CAST(id % 2 AS INT) AS part")
    made = kmeans.fit_many(df, [kmeans.Fit(2, 0, None, 0), kmeans.Fit(2, 0, None, 1)], 2, part="part")
    for c in made:
        assert sorted(c[:, 0].tolist()) == [0.0, 4.0]
    same = kmeans.fit_many(rows_of(spark, np.ones((4, 2))), [kmeans.Fit(3, 0)], 2)[0]
    assert np.allclose(same, 1.0)
    with pytest.raises(ValueError, match="fewer rows"):
        kmeans.fit_many(df, [kmeans.Fit(6, 0, None, 1)], 1, part="part")
    with pytest.raises(ValueError, match="fewer rows"):
        kmeans.fit_many(df.where("false"), [kmeans.Fit(1, 0)], 1)


def test_kmeans_deals_parts_over_partitions(spark):
    x = np.random.default_rng(0).normal(size=(1_600, 2))
    df = rows_of(spark, x).selectExpr("id", "features", "CAST(id % 4 AS INT) AS part").repartitionByRange(4, "part")
    stored = kmeans._stored(df, "features", "part", "id")
    held = stored.selectExpr("input_file_name() AS file", "_part").distinct().groupBy("file").count().collect()
    assert len(held) == 4 and all(r["count"] == 4 for r in held)


def test_lloyd_sums_equal_plain_ones_and_ties_go_to_the_first():
    x, keys = blobs(), np.arange(180)
    centers = np.stack([x[[0, 0, 70]], x[[5, 130, 130]], x[[1, 2, 3]]])
    g = kmeans._Group(0, 3, np.arange(3), np.arange(3), np.arange(3), np.array([-1, 0, 1]), centers)
    got, far = kmeans._lloyd(g, keys, x), ((x[:, None, None] - centers) ** 2).sum(3)
    w, near = g.weights(keys), far.argmin(2)
    member = (near[:, :, None] == np.arange(3)) * w[:, :, None]
    want = np.concatenate([(w * far.min(2)).sum(0), member.sum(0).ravel(), np.einsum("nsk,nd->skd", member, x).ravel()])
    assert np.allclose(got, want) and got[3 + 1] == 0 and got[3 + 3 + 2] == 0


def plain_split(bins, g, h, s):
    """Best (gain, feature, bin) by trying every cut."""
    best = (-np.inf, -1, -1)
    for f in range(bins.shape[1]):
        for b in range(bins[:, f].max()):
            left = bins[:, f] <= b
            if min(left.sum(), (~left).sum()) < s.min_rows or min(h[left].sum(), h[~left].sum()) < boosting.MIN_HESSIAN:
                continue
            gain = g[left].sum() ** 2 / h[left].sum() + g[~left].sum() ** 2 / h[~left].sum() - g.sum() ** 2 / h.sum()
            if gain > best[0] + 1e-12:
                best = (gain, f, b)
    return best


def task(n=400, d=5, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    return x, (x[:, 0] + x[:, 1] * x[:, 2] + 0.5 * rng.normal(size=n) > 0.2).astype(int)


def test_boosted_splits_equal_brute_force():
    x, y = task()
    s = boosting.Settings(bins=16)
    edges = [boosting.quantile_edges(x[:, f], s.bins) for f in range(x.shape[1])]
    bins = boosting.binned(x, edges)
    g, h, _ = boosting.slopes(np.zeros((len(y), 1)), y)
    node = boosting.Node(boosting.histogram(bins, g[:, 0], h[:, 0], 17)).find(s)
    gain, f, b = plain_split(bins, g[:, 0], h[:, 0], s)
    assert (node.feature, node.place) == (f, b) and node.gain == pytest.approx(gain)
    below = bins[:, f] <= b
    small = below if below.sum() <= (~below).sum() else ~below
    left, right = node.children(boosting.histogram(bins[small], g[small, 0], h[small, 0], 17))
    for child, rows in ((left, below), (right, ~below)):
        assert np.allclose(child.hist, boosting.histogram(bins[rows], g[rows, 0], h[rows, 0], 17))
        assert child.find(s).gain == pytest.approx(plain_split(bins[rows], g[rows, 0], h[rows, 0], s)[0])


@pytest.mark.parametrize("classes", [1, 3])
def test_boosting_in_place_equals_in_task(spark, monkeypatch, classes):
    monkeypatch.setattr(boosting, "REFRESH", 2)
    x, y = task(300, 4)
    y = y if classes == 1 else y + (x[:, 3] > 0)
    s = boosting.Settings(rounds=5, bins=16, leaves=6)
    edges = [boosting.quantile_edges(x[:, f], s.bins) for f in range(4)]
    a = boosting.fit_in_task(np.arange(300), x, y, classes, s, 0, edges)
    b = boosting.fit_in_place(rows_of(spark, x, y), classes, s, 0, edges)
    assert np.allclose(a.chances(x), b.chances(x)) and np.allclose(a.losses, b.losses)
    assert all(np.array_equal(t.feature, u.feature) for p, q in zip(a.rounds, b.rounds) for t, u in zip(p, q))


def test_fits_in_place_run_at_once(spark, monkeypatch):
    met, real = threading.Barrier(2), boosting.fit_in_place

    def waits(*args):
        met.wait(20)  # for the other fit
        return real(*args)

    monkeypatch.setattr(boosting, "fit_in_place", waits)
    x, y = task(80, 3)
    both = rows_of(spark, x, y).unionByName(rows_of(spark, x, 1 - y).selectExpr("1 AS fit", "_key", "id", "features", "y"))
    made = boosting.fit_side_by_side(both, {0: 1, 1: 1}, boosting.Settings(rounds=2, bins=8), 0, task_rows=10)
    assert sorted(made) == [0, 1] and np.allclose(made[0].chances(x) + made[1].chances(x), 1.0)


def test_a_task_takes_more_rows_where_they_are_narrow(spark, monkeypatch):
    def refuse(*args):
        raise AssertionError("in place")

    monkeypatch.setattr(boosting, "fit_in_place", refuse)
    x, y = task(80, 3)
    s = boosting.Settings(rounds=2, bins=8)
    made = boosting.fit_side_by_side(rows_of(spark, x, y), {0: 1}, s, 0, task_rows=25)
    assert np.allclose(made[0].chances(x), boosting.fit_in_task(np.arange(80), x, y, 1, s, 0).chances(x), atol=0.2)
    monkeypatch.setattr(boosting, "TASK_CELLS", 80 * 3 - 1)
    with pytest.raises(AssertionError, match="in place"):
        boosting.fit_side_by_side(rows_of(spark, x, y), {0: 1}, s, 0, task_rows=25)


@pytest.mark.parametrize("d", [4, 5])
@pytest.mark.parametrize("classes", [1, 3])
def test_histograms_of_column_pairs_equal_those_of_columns(monkeypatch, d, classes):
    x, y = task(900, d)
    y = y if classes == 1 else y + (x[:, 3] > 0)
    s = boosting.Settings(rounds=8, bins=16, stop_above=500)
    plain = boosting.fit_in_task(np.arange(900), x, y, classes, s, 0)
    monkeypatch.setattr(boosting, "COLUMN_CELLS", 0)
    monkeypatch.setattr(boosting, "PAIR_ROWS", 100)
    paired = boosting.fit_in_task(np.arange(900), x, y, classes, s, 0)
    assert np.allclose(plain.losses, paired.losses) and np.allclose(plain.chances(x), paired.chances(x))
    assert all(np.array_equal(t.rows, u.rows) for p, q in zip(plain.rounds, paired.rounds) for t, u in zip(p, q))


def test_boosting_learns_stops_and_survives(spark):
    x, y = task(2_000)
    s = boosting.Settings(rounds=60, stop_above=1_000)
    model = boosting.fit_in_task(np.arange(2_000), x, y, 1, s, 0)
    far, truth = task(2_000, seed=9)
    assert ((model.chances(far) > 0.5) == truth).mean() > 0.85 and len(model.rounds) <= 60
    noise = boosting.fit_in_task(np.arange(2_000), x, np.random.default_rng(3).integers(0, 2, 2_000), 1, s, 0)
    assert len(noise.rounds) < 40  # nothing to learn: stopped on the held rows
    full = boosting.fit_in_task(np.arange(2_000), x, y, 1, boosting.Settings(rounds=20), 0)
    assert all(a > b for a, b in zip(full.losses, full.losses[1:]))
    assert max((t.feature < 0).sum() for t, in full.rounds) <= 31
    lone = y.copy() + 1
    lone[0] = 0  # a class of one row
    p = boosting.fit_in_task(np.arange(2_000), x, lone, 3, boosting.Settings(rounds=5), 0).chances(x)
    assert np.allclose(p.sum(axis=1), 1.0) and np.isfinite(p).all()
    one = boosting.fit_in_task(np.arange(50), x[:50], np.ones(50, int), 1, boosting.Settings(rounds=3), 0).chances(x[:50])
    assert (one > 0.99).all()
    with pytest.raises(ValueError, match="no rows"):
        boosting.fit_side_by_side(rows_of(spark, x[:50], y[:50]), {0: 1, 1: 1}, s, 0)


def test_softmax_mass_judges_labels_not_single_rows(spark, tmp_path):
    """Five rows stand among 95 equal ones of another label: no model can make theirs likelier there."""
    rows = [(i, [float(i >= 100)], int(i >= 95)) for i in range(200)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = representations.softmax_mass(spark, str(tmp_path)).collect()
    assert sorted(r["id"] for r in got) == list(range(200))
    assert all(r["mass"] == pytest.approx(1.0) and r["likelier"] for r in got)


@pytest.mark.parametrize("classes", [1, 4])
def test_newton_meets_its_conditions(spark, classes):
    x, y = task(200)
    y = y if classes == 1 else (np.abs(x[:, 1] * 2).astype(int) % 4)
    df = rows_of(spark, x, y, parts=40)
    model = newton.fit_logistic(df, {0: classes})[0]
    p = model.chances(x).reshape(200, -1)
    hit = y[:, None] if classes == 1 else (y[:, None] == np.arange(4))
    z = np.column_stack([x, np.ones(200)])
    pull = model.weights.copy()
    pull[:, -1] = 0.0
    assert np.abs((p - hit).T @ z + pull).max() < 1e-6
    w, rng = model.weights, np.random.default_rng(1)
    sums = newton.block_sums(w, x, y)
    up = rng.normal(size=w.shape)
    f = [newton.block_sums(w + e * up, x, y)[0] for e in (1e-6, -1e-6)]
    assert sums[1 : 1 + w.size] @ up.ravel() == pytest.approx((f[0] - f[1]) / 2e-6, rel=1e-4, abs=1e-5)
    g = [newton.block_sums(w + e * up, x, y)[1 : 1 + w.size] for e in (1e-6, -1e-6)]
    assert np.allclose(sums[1 + w.size :].reshape(w.size, -1) @ up.ravel(), (g[0] - g[1]) / 2e-6, rtol=1e-4, atol=1e-4)


def test_newton_on_separable_and_constant_rows(spark):
    x = np.array([[-1.0], [-2.0], [1.0], [2.0]])
    found = newton.fit_logistic(rows_of(spark, x, np.array([0, 0, 1, 1])), {0: 1})[0]
    assert found.gradient < 1e-6 and found.weights[0, 0] > 0
    flat = newton.fit_logistic(rows_of(spark, np.zeros((6, 2)), np.array([0, 1, 1, 1, 1, 1])), {0: 1})[0]
    assert np.allclose(flat.chances(np.zeros((1, 2))), 5 / 6)
    with pytest.raises(ValueError, match="parameters"):
        newton.fit_logistic(rows_of(spark, np.zeros((2, 9)), np.array([0, 1])), {0: 500})


def test_points_of_a_stack_equal_points_alone(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 5))
    rows = [(i, [float(v) for v in a], [float(v) for v in a[:2]]) for i, a in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, features array<double>, constructs array<double>").repartition(2)
    cfg = ModelConfig(latent_dim=4, hidden_dims=(8,), lr=1e-2, epochs=6, min_free_dims=1, batch_rows=16)
    points = [(0.1, 0.0), (0.1, 1.0), (2.0, 0.25), (2.0, 0.0)]
    for shards in (None, 3):
        shared = construct_vae.fit_grid(df, replace(cfg, shards=shards), points, 5, 2)
        assert list(sorted(shared)) == sorted(points)
        for beta, lam in points:
            alone = construct_vae.fit_construct_vae(df, replace(cfg, shards=shards, beta=beta, lambda_align=lam), 5, 2)
            assert np.allclose(shared[beta, lam].code(x), alone.code(x), atol=1e-9)
            assert shared[beta, lam].aligned == (2 if lam else 0) and len(shared[beta, lam].history) == 6
    with pytest.raises(ValueError, match="no rows"):
        dense.minimise(df.where("false"), "id", np.zeros(1), None, 1, 0.1, 1)


def test_a_grid_trains_in_small_stacks(spark, monkeypatch):
    x = np.random.default_rng(2).normal(size=(40, 5))
    rows = [(i, [float(v) for v in a], [float(v) for v in a[:2]]) for i, a in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, features array<double>, constructs array<double>")
    cfg = ModelConfig(latent_dim=4, hidden_dims=(8,), lr=1e-2, epochs=3, min_free_dims=1, batch_rows=16)
    points = [(b, v) for b in (0.1, 0.2, 0.3, 0.4, 0.5) for v in (0.0, 1.0)]
    seen, real = [], dense.minimise

    def counted(rows, id_column, params, gradient, n_losses, *rest):
        seen.append(n_losses // len(construct_vae.LOSSES))
        return real(rows, id_column, params, gradient, n_losses, *rest)

    monkeypatch.setattr(dense, "minimise", counted)
    made = construct_vae.fit_grid(df, cfg, points, 5, 2)
    assert sorted(seen) == [2, 2, 3, 3] and sorted(made) == sorted(points)


def small_bench(spark, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(160, 6))
    y, cat = (x[:, 0] > 0.3).astype(int), rng.integers(0, 3, 160)
    split = ["train"] * 100 + ["val"] * 30 + ["test"] * 30
    rows = [(i, split[i], [float(v) for v in x[i]], [float(v) for v in x[i, :4]], int(y[i]), int(cat[i])) for i in range(160)]
    df = spark.createDataFrame(rows, "id long, split string, features array<double>, constructs array<double>, y int, cat int")
    cfg = EvalConfig(n_clusters=3, n_init=1, gbt_iterations=3, top_ks=(1, 3))
    model = ModelConfig(latent_dim=4, hidden_dims=(8,), epochs=4, min_free_dims=1)
    return protocol.Bench(df, ["r", "f", "m", "p"], {"primary": ("y", "binary"), "next_category": ("cat", "multiclass")}, cfg, model, seed)


def test_blocks_are_summed_up_like_codes_alone(spark):
    b = small_bench(spark)
    wide = b.frame.selectExpr("id", "constructs AS v", "features AS z", "slice(features, 1, 3) AS z0", "slice(features, 4, 3) AS z1")
    got = {(r["block"], r["factor"]): r for r in interpretability.block_summary(wide, 3).collect()}
    for block in (0, 1):
        for r in interpretability.summary(wide, z=f"z{block}").collect():
            for c in ("mig", "sap", "best_dim", "best_r2"):
                assert got[block, r["factor"]][c] == pytest.approx(r[c])


def test_sweep_writes_a_seed_at_a_time_and_repeats_none(spark, tmp_path):
    grid = SweepConfig(betas=(0.1, 1.0), lambdas=(0.0, 1.0), seeds=(0, 1))
    asked = []

    def bench_of(seed):
        asked.append(seed)
        return small_bench(spark, seed)

    path = str(tmp_path / "records")
    assert protocol.run_sweep(bench_of, replace(grid, seeds=(0,)), path) == 4
    assert protocol.run_sweep(bench_of, grid, path) == 4 and asked == [0, 1]
    assert protocol.run_sweep(bench_of, grid, path) == 0
    rows = read_sweep_records(spark, path).collect()
    assert len(rows) == 8 and len({(r["seed"], r["beta"], r["lambda_align"]) for r in rows}) == 8
    for r in rows:
        assert (r["alignment"] is None) == (r["lambda_align"] == 0.0) and len(r["loss_history"]) == 4
        assert set(r["downstream"]) == {"primary", "next_category"} and set(r["downstream_val"]) == {"primary"}


def test_cases_share_their_passes(spark):
    b = small_bench(spark)
    frames = {"all": b.frame, "few": b.frame.selectExpr("id", "split", "y", "cat", "slice(features, 1, 2) AS features")}
    both = heads.case_metrics(frames, "features", b.tasks, b.cfg, 0).collect()
    got = {(r["case"], r["split"], r["task"], r["head"], r["metric"]): r["value"] for r in both}
    alone = heads.head_metrics(frames["few"], "features", b.tasks, b.cfg, 0).collect()
    for r in alone:
        assert got["few", r["split"], r["task"], r["head"], r["metric"]] == pytest.approx(r["value"])
    assert got["all", "test", "primary", "logreg", "roc_auc"] > 0.9


def test_models_of_a_grid_never_pass_the_driver(spark, monkeypatch):
    b, driver, real = small_bench(spark), os.getpid(), boosting.Boosted.unpacked

    def refuse(raw):
        assert os.getpid() != driver, "a model on the driver"
        return real(raw)

    monkeypatch.setattr(boosting.Boosted, "unpacked", staticmethod(refuse))
    monkeypatch.setattr(heads, "SCORED_ROWS", 30)  # several tasks score by a model
    parts = {c: b.frame.selectExpr("id", "split", "y", "cat", f"slice(features, {at}, 3) AS features") for c, at in (("0", 1), ("1", 4))}

    def found(cases):
        rows = heads.case_metrics(cases, "features", b.tasks, b.cfg, 0).collect()
        return {(r["case"], r["split"], r["task"], r["head"], r["metric"]): r["value"] for r in rows}

    want = found(parts)
    assert found(heads.Blocks(b.frame, "features", 3, ("0", "1"))) == pytest.approx(want) and len(want) == 72


def test_newton_sums_reach_the_driver_once(spark, monkeypatch):
    x, y = task(200)
    df = rows_of(spark, x, y, parts=40)
    seen, real = [], type(df).toArrow

    def counted(frame):
        seen.append(real(frame))
        return seen[-1]

    monkeypatch.setattr(type(df), "toArrow", counted)
    newton.fit_logistic(df, {0: 1})
    assert seen and all(t.num_rows == 1 for t in seen)


@pytest.mark.parametrize("block_rows", [7, 1_000])
def test_euclidean_silhouette_equals_brute_force(spark, block_rows):
    rng = np.random.default_rng(8)
    x, labels = rng.normal(size=(45, 3)), np.r_[np.full(20, 4), np.full(24, 9), 11]
    x[labels == 9] += 3
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = []
    for i, own in enumerate(labels):
        if (labels == own).sum() == 1:
            want.append(0.0)
            continue
        a = far[i, labels == own].sum() / ((labels == own).sum() - 1)
        b = min(far[i, labels == o].mean() for o in set(labels) - {own})
        want.append((b - a) / max(a, b))
    rows = [(i, int(v), [float(e) for e in p]) for i, (p, v) in enumerate(zip(x, labels))]
    df = spark.createDataFrame(rows, "id long, label int, features array<double>").repartition(3)
    for n in (None, 100):
        got = quality.silhouette_euclidean(df, "label", "features", n, block_rows=block_rows).first()["silhouette"]
        assert got == pytest.approx(np.mean(want))
    assert quality.silhouette_euclidean(df.where("label = 4"), "label", "features").first()["silhouette"] is None
    few = quality.silhouette_euclidean(df.where("label <> 11"), "label", "features", 12, block_rows=5).first()["silhouette"]
    assert -1 <= few <= 1
