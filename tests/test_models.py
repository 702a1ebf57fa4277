from dataclasses import replace

import numpy as np
import pytest

from buyerlens.config import EvalConfig, ModelConfig
from buyerlens.operators import autoencoder as ae
from buyerlens.operators import cards, clusters, construct_vae, dense, pca, protocol, resampling
from buyerlens.operators.transforms import Scaler

CFG = ModelConfig(latent_dim=4, hidden_dims=(8,), lr=1e-2, epochs=6, min_free_dims=1)


def frame(spark, x, c=None, parts=3):
    rows = [
        (i, [float(v) for v in a], [float(v) for v in (c[i] if c is not None else a[:2])])
        for i, a in enumerate(x)
    ]
    return spark.createDataFrame(rows, "id bigint, features array<double>, constructs array<double>").repartition(parts)


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(0)
    return np.concatenate([rng.normal(8 * i, 0.4, (80, 3)) for i in range(3)])


def test_vae_gradient_matches_finite_differences():
    rng = np.random.default_rng(1)
    x, c, eps = rng.normal(size=(7, 5)), rng.normal(size=(7, 3)), rng.normal(size=(7, 4))
    cfg = replace(CFG, beta=0.3, lambda_align=2.0, aligned_kl_weight=0.7)
    arrays = construct_vae.initial_arrays(5, cfg, 2, 3, 0)
    packing, flat = dense.Packing.of(arrays), dense.pack(arrays)
    _, grads = construct_vae.loss_and_gradient(arrays, x, c, eps, cfg, 2)
    grad = dense.pack(grads)
    for i in rng.choice(len(flat), 40, replace=False):
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        f = [construct_vae.loss_and_gradient(packing.split(p), x, c, eps, cfg, 2)[0][0] for p in (up, down)]
        assert grad[i] == pytest.approx((f[0] - f[1]) / 2e-6, rel=1e-4, abs=1e-5)


def test_training_does_not_depend_on_partitions(spark):
    x = np.random.default_rng(2).normal(size=(60, 5))
    got = []
    for parts in (1, 4):
        model = construct_vae.fit_construct_vae(frame(spark, x, parts=parts), replace(CFG, batch_rows=16, shards=3), 5, 2)
        got.append((model.code(x), [h["total"] for h in model.history]))
    assert np.allclose(got[0][0], got[1][0], atol=1e-9) and np.allclose(got[0][1], got[1][1])


def test_vae_losses_and_ablation(spark):
    x = np.random.default_rng(3).normal(size=(60, 5))
    df = frame(spark, x)
    model = construct_vae.fit_construct_vae(df, replace(CFG, epochs=25), 0, 2)
    assert model.aligned == 2 and model.history[-1]["total"] < model.history[0]["total"]
    assert all(h["kl_free"] >= 0 and h["kl_aligned"] >= 0 for h in model.history)
    plain = construct_vae.fit_construct_vae(df, replace(CFG, lambda_align=0.0), 0, 2)
    assert plain.aligned == 0 and plain.head is None
    assert all(h["align"] == 0 and h["kl_aligned"] == 0 for h in plain.history)
    row = construct_vae.predict_constructs(df, plain, ["id"]).first()
    assert row["predicted"] is None


def test_aligned_dims_rule():
    wide = ModelConfig(latent_dim=10)
    assert construct_vae.aligned_dims(wide, 5) == 5
    assert construct_vae.aligned_dims(wide, 20) == 6
    assert construct_vae.aligned_dims(replace(wide, lambda_align=0.0), 5) == 0
    with pytest.raises(ValueError):
        construct_vae.aligned_dims(replace(wide, aligned_dims=11), 5)
    with pytest.raises(ValueError):
        construct_vae.aligned_dims(replace(wide, aligned_dims=2), 0)


def test_keyed_noise_is_normal_and_keyed():
    ids = np.arange(20_000)
    a = dense.keyed_normal(ids, 3, 1, 7)
    assert abs(a.mean()) < 0.02 and abs(a.std() - 1) < 0.02
    assert abs(np.corrcoef(a.T)[0, 1]) < 0.03
    assert np.array_equal(a[50:60], dense.keyed_normal(ids[50:60], 3, 1, 7))
    assert not np.allclose(a, dense.keyed_normal(ids, 3, 2, 7))


def test_autoencoder_and_embedded_clusters(spark, blobs):
    x = (blobs - blobs.mean(0)) / blobs.std(0)
    df = frame(spark, x)
    model = ae.fit_autoencoder(df, replace(CFG, epochs=60), 0)
    assert model.history[-1] < 0.5 * model.history[0]
    before = [w.copy() for w, _ in model.encoder]
    dec = ae.fit_embedded_clusters(df, model, 3, CFG, 0, 2, iterations=10)
    assert all(np.array_equal(a, w) for a, (w, _) in zip(before, model.encoder, strict=True))
    q = dec.soft(x)
    assert np.allclose(q.sum(axis=1), 1) and np.isfinite(dec.history).all()
    assert len({tuple(np.bincount(q.argmax(1)[i * 80 : (i + 1) * 80], minlength=3)) for i in range(3)}) == 3


def test_embedded_gradient_matches_finite_differences(spark):
    rng = np.random.default_rng(4)
    z, centers = rng.normal(size=(6, 2)), rng.normal(size=(3, 2))
    p = rng.dirichlet(np.ones(3), 6)

    def loss(z, c):
        q = clusters.student_assign(z, c)
        return (p * np.log(p / q)).sum()

    kernel = 1.0 / (1.0 + clusters.squared_distances(z, centers))
    q = kernel / kernel.sum(axis=1, keepdims=True)
    pull = 2.0 * kernel * (p - q)
    g_z = pull.sum(axis=1)[:, None] * z - pull @ centers
    g_c = pull.sum(axis=0)[:, None] * centers - pull.T @ z
    for base, grad, swap in ((z, g_z, False), (centers, g_c, True)):
        for i in np.ndindex(base.shape):
            up, down = base.copy(), base.copy()
            up[i] += 1e-6
            down[i] -= 1e-6
            f = [loss(z, b) if swap else loss(b, centers) for b in (up, down)]
            assert grad[i] == pytest.approx((f[0] - f[1]) / 2e-6, abs=1e-6)


def test_kmeans_mixture_and_bootstrap_on_blobs(spark, blobs):
    df = frame(spark, blobs)
    centers = clusters.fit_kmeans(df, 3, 0, 3)
    assert np.allclose(sorted(centers[:, 0]), [0, 8, 16], atol=0.5)
    model = clusters.fit_mixture(df, 3, 0, n_init=3)
    assert np.allclose(model.weights, 1 / 3, atol=0.02) and np.allclose(model.variances, 0.16, atol=0.06)
    scores = resampling.bootstrap_scores(df, 3, 3, 0, 2, features="features")
    row = resampling.bootstrap_persistence(scores).first()
    assert row["n_boot"] == 3 and row["ari_mean"] > 0.95
    with pytest.raises(ValueError, match="fewer rows"):
        clusters.fit_kmeans(df.limit(2), 3, 0, 1)
    with pytest.raises(ValueError):
        resampling.bootstrap_scores(df, 3, 0)


def test_poisson_weights(spark):
    df = spark.range(20_000).select(resampling.poisson_weight("id", 0, 1).alias("w"))
    w = np.array([r["w"] for r in df.collect()])
    assert abs(w.mean() - 1) < 0.03 and abs(w.var() - 1) < 0.06


def test_pca_matches_numpy(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 5)) @ rng.normal(size=(5, 5))
    x -= x.mean(0)
    loadings = pca.fit_pca(frame(spark, x), 16)
    assert loadings.shape == (5, 5)
    values = np.linalg.svd(x, full_matrices=False)[1] ** 2
    assert np.allclose((x @ loadings).var(axis=0) * 200, values)


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_pca_of_ill_conditioned_rows(spark, parts):
    """Deviations from 1 to 1e-10, off centre: through a covariance those below 1e-8 are lost."""
    rng = np.random.default_rng(16)
    basis = np.linalg.qr(rng.normal(size=(6, 6)))[0]
    x = (rng.normal(size=(400, 6)) * 10.0 ** -np.arange(0, 12, 2)) @ basis.T + np.array([3.0, -1, 0, 2, 0, 5]) * 1e-3
    loadings = pca.fit_pca(frame(spark, x, parts=parts), 6)
    want = np.linalg.svd(x - x.mean(0), full_matrices=False)[2].T
    assert np.allclose(np.abs((loadings * want).sum(axis=0)), 1, atol=1e-6)
    assert np.allclose(loadings.T @ loadings, np.eye(6), atol=1e-12)


def test_pca_of_few_rows_and_of_merged_levels(spark):
    x = np.random.default_rng(17).normal(size=(3, 5))
    loadings = pca.fit_pca(frame(spark, x, parts=2), 5)
    assert loadings.shape == (5, 5) and np.allclose(loadings.T @ loadings, np.eye(5))
    assert np.allclose((x - x.mean(0)) @ loadings[:, 2:], 0)
    wide = np.random.default_rng(18).normal(size=(90, 4))
    factor = pca.triangular_factor(frame(spark, wide, parts=9), 9, fan_in=2)
    centred = wide - wide.mean(0)
    assert np.allclose(factor[1:, 1:].T @ factor[1:, 1:], centred.T @ centred)


def bench(spark, **changes):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 6))
    y = (x[:, 0] + 0.3 * rng.normal(size=300) > 0.8).astype(int)
    cat = rng.integers(0, 4, 300)
    split = np.array(["train"] * 200 + ["val"] * 40 + ["test"] * 60)
    rows = [
        (i, str(split[i]), [float(v) for v in x[i]], [float(v) for v in x[i, :5]], int(y[i]),
         int(cat[i]) if i % 5 < 3 else None)
        for i in range(300)
    ]
    df = spark.createDataFrame(
        rows, "id bigint, split string, features array<double>, constructs array<double>, y int, cat int"
    ).repartition(2)
    cfg = replace(EvalConfig(n_clusters=3, n_init=1, gbt_iterations=3, top_ks=(1, 3)), **changes)
    tasks = {"primary": ("y", "binary"), "next_category": ("cat", "multiclass")}
    names = ["rfm_R", "rfm_F", "rfm_M", "price_sensitivity", "affinity_a"]
    return protocol.Bench(df.cache(), names, tasks, cfg, CFG, 0)


def test_baseline_protocol(spark):
    b = bench(spark, methods=("raw", "rfm_kmeans", "gmm_ae", "dec"), train_subsample=150)
    assert b.train.count() == 150
    rows = protocol.evaluate_baselines(b).collect()
    got = {(r["task"], r["method"], r["head"], r["metric"]): r["value"] for r in rows}
    for m in ("raw", "rfm_kmeans", "gmm_ae", "dec"):
        for h in ("logreg", "gbt"):
            assert 0 <= got[("primary", m, h, "pr_auc")] <= 1
            assert got[("next_category", m, h, "acc_at_1")] <= got[("next_category", m, h, "acc_at_3")]
    assert got[("primary", "raw", "logreg", "roc_auc")] > 0.9
    assert ("primary", "dec", "gbt", "clu_silhouette_squared") in got and ("primary", "raw", "gbt", "clu_silhouette_squared") not in got


def test_unknown_method_is_an_error():
    with pytest.raises(ValueError, match="unknown methods"):
        protocol.chosen_methods(EvalConfig(methods=("raw", "magic")))
    assert protocol.chosen_methods(EvalConfig(methods=("rfm", "raw"))) == ["raw", "rfm"]


def test_run_point_record_and_cards(spark):
    b = bench(spark)
    b.tasks = {"primary": ("y", "binary")}
    record, model = protocol.run_point(b, 0.25, 1.0)
    assert record["aligned_dims"] == 3 and set(record["downstream_val"]) == {"primary"}
    assert set(record["alignment"]["r2_per_construct"]) == set(b.constructs)
    assert 0 <= record["interpretability"]["mig"] <= 1
    labels = spark.createDataFrame([(0, 2, 0.9)], "best_dim int, factor int, best_r2 double")
    names = [f"f{i}" for i in range(6)]
    scaler = Scaler({n: 0.0 for n in names}, {n: 2.0 for n in names})
    card = cards.axis_effects(labels, model, scaler, names, 2.0, 4).collect()
    assert len(card) == 12
    for r in card:
        assert r["raw_delta"] == pytest.approx(2 * r["delta"])
        assert r["construct"] == (2 if r["dim"] == 0 else None)
    z = np.zeros((2, 4))
    z[:, 1] = (-2, 2)
    gap = np.diff(model.decode(z), axis=0)[0]
    mine = {r["name"]: r["delta"] for r in card if r["dim"] == 1}
    assert all(v == pytest.approx(gap[int(n[1:])]) for n, v in mine.items())
    free = replace(model, aligned=0)
    with pytest.raises(ValueError, match="no aligned axes"):
        cards.axis_effects(labels, free, scaler, names)


def test_stability_bundle_skips_missing_seeds(spark, blobs):
    df = frame(spark, blobs).withColumnRenamed("features", "z").cache()
    cfg = EvalConfig(n_clusters=3, n_init=2, n_boot=2)
    row = resampling.stability_bundle(lambda _s: df, (0, 1), cfg).first()
    assert row["ari_mean"] == pytest.approx(1.0) and row["n_users"] == 240 and row["silhouette_squared"] > 0.8
    with pytest.warns(UserWarning, match="skipped"):
        assert resampling.stability_bundle(lambda s: df if s else None, (0, 1), cfg) is None
    with pytest.raises(ValueError, match="universes differ"):
        resampling.stability_bundle(lambda s: df if s else df.where("id > 3"), (0, 1), cfg)
