import numpy as np
import pytest
from pyspark.sql import functions as F

from buyerlens.operators import clustering_quality as quality
from buyerlens.operators import interpretability as interp
from buyerlens.operators import ranking, stability
from buyerlens.plans import ordered


def brute_binary(y, s, k_frac=0.1):
    pos, neg = s[y == 1], s[y == 0]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    ap = np.sum([(s[y == 1] == t).sum() * (y[s >= t].mean()) for t in np.unique(s)]) / (y == 1).sum()
    n = max(1, int(round(len(s) * k_frac)))
    edge = np.sort(s)[::-1][n - 1]
    above, tied = s > edge, s == edge
    hits = y[above].sum() + (n - above.sum()) * y[tied].mean()
    return auc, ap, hits / n


@pytest.mark.parametrize("ties", [0, 6])
def test_binary_metrics_match_brute_force(spark, ties, ranges):
    rng = np.random.default_rng(ties)
    y = (rng.random(215) < 0.3).astype(int)
    s = np.round(rng.normal(size=215) + y, ties)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s, strict=True)], "y int, score double")
    row = ranking.binary_metrics(df.repartition(5)).first()
    auc, ap, prec = brute_binary(y, s)
    assert row["roc_auc"] == pytest.approx(auc)
    assert row["pr_auc"] == pytest.approx(ap)
    assert row["prec_at_10pct"] == pytest.approx(prec)
    assert row["base_rate"] == pytest.approx(y.mean())


def test_null_groups_are_groups(spark, ranges):
    rows = [(g, i % 3 == 0, float(i * 7 % 50)) for i in range(200) for g in (None, "a", "b")]
    df = spark.createDataFrame([(g, int(y), x) for g, y, x in rows], "g string, y int, score double")
    got = {r["g"]: r["roc_auc"] for r in ranking.binary_metrics(df, by=["g"]).collect()}
    assert set(got) == {None, "a", "b"} and len(set(got.values())) == 1
    medians = {r["g"]: r["q"] for r in ordered.exact_quantiles(df, [0.5], ["g"], "score").collect()}
    assert set(medians) == {None, "a", "b"} and len(set(medians.values())) == 1


def test_constant_score_and_one_class(spark):
    df = spark.createDataFrame([("t", i % 2, 1.0) for i in range(20)] + [("n", 0, float(i)) for i in range(5)], "g string, y int, score double")
    got = {r["g"]: r for r in ranking.binary_metrics(df, by=["g"]).collect()}
    assert got["t"]["roc_auc"] == 0.5 and got["t"]["prec_at_10pct"] == 0.5
    assert got["n"]["roc_auc"] is None and got["n"]["prec_at_10pct"] == 0.0


def test_precision_rounds_half_to_even(spark):
    # 25 rows: 2.5 slots become 2
    df = spark.createDataFrame([(int(i < 3), float(-i)) for i in range(25)], "y int, score double")
    assert ranking.binary_metrics(df).first()["prec_at_10pct"] == 1.0
    y = np.array([1, 1, 0] + [0] * 22)
    df = spark.createDataFrame([(int(v), float(-i)) for i, v in enumerate(y)], "y int, score double")
    assert ranking.binary_metrics(df).first()["prec_at_10pct"] == 1.0


def test_multiclass(spark):
    rng = np.random.default_rng(1)
    proba = np.round(rng.dirichlet(np.ones(4), 200), 1)
    y = rng.integers(0, 5, 200)  # class 4 unseen
    df = spark.createDataFrame([(int(a), [float(v) for v in p]) for a, p in zip(y, proba, strict=True)], "y int, proba array<double>")
    row = ranking.multiclass_metrics(df).first()
    order = np.argsort(proba, axis=1, kind="stable")[:, ::-1]
    for k in (1, 3, 5):
        hit = np.mean([c < 4 and c in order[i, :k] for i, c in enumerate(y)])
        assert row[f"acc_at_{k}"] == pytest.approx(hit)
    aucs = [brute_binary((y == c).astype(int), proba[:, c])[0] for c in range(4)]
    assert row["macro_ovr_auc"] == pytest.approx(np.mean(aucs))
    assert row["base_rate"] == pytest.approx(np.bincount(y[y < 4]).max() / 200)
    assert row["n_classes"] == 4 and row["acc_at_1"] <= row["acc_at_3"] <= row["acc_at_5"]


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 1.0, (40, 3)) for c in (0, 3, 6)] + [[[50.0, 50.0, 50.0]]])
    return x, np.array([0] * 40 + [1] * 40 + [2] * 40 + [3])


def test_clustering_scores_match_brute_force(spark, points):
    x, lab = points
    df = spark.createDataFrame([(i, int(c), [float(v) for v in p]) for i, (p, c) in enumerate(zip(x, lab, strict=True))], "id bigint, label int, features array<double>")
    row = quality.clustering_metrics(df, "label", "features").first()
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    s = []
    for i, c in enumerate(lab):
        own = (lab == c).sum() - 1
        if own == 0:
            s.append(0.0)
            continue
        a = d[i, lab == c].sum() / own
        b = min(d[i, lab == o].mean() for o in set(lab) - {c})
        s.append((b - a) / max(a, b))
    assert row["silhouette_squared"] == pytest.approx(np.mean(s))
    mu = np.array([x[lab == c].mean(0) for c in range(4)])
    sc = np.array([np.sqrt(((x[lab == c] - mu[c]) ** 2).sum(1)).mean() for c in range(4)])
    r = [max((sc[i] + sc[j]) / np.sqrt(((mu[i] - mu[j]) ** 2).sum()) for j in range(4) if j != i) for i in range(4)]
    assert row["davies_bouldin"] == pytest.approx(np.mean(r))
    within = sum(((x[lab == c] - mu[c]) ** 2).sum() for c in range(4))
    between = sum((lab == c).sum() * ((mu[c] - x.mean(0)) ** 2).sum() for c in range(4))
    assert row["calinski_harabasz"] == pytest.approx(between / within * (121 - 4) / 3)
    assert row["n_clusters_found"] == 4


def test_one_cluster_has_no_scores(spark):
    df = spark.createDataFrame([(i, 0, [float(i)]) for i in range(5)], "id bigint, label int, features array<double>")
    row = quality.clustering_metrics(df, "label", "features").first()
    assert row["silhouette_squared"] is None and row["n_clusters_found"] == 1


def codes(spark, z, v):
    rows = [([float(a) for a in p], [float(b) for b in q]) for p, q in zip(z, v, strict=True)]
    return spark.createDataFrame(rows, "z array<double>, v array<double>").repartition(4)


def test_disentangled_beats_entangled(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(4_000, 3))
    noise = rng.normal(size=(4_000, 3))
    # A rotation that mixes all three factors.
    mix = np.array([[1, 1, 1], [1, -1, 0], [1, 1, -2]]) / np.sqrt([[3], [2], [6]])
    clear = interp.summary(codes(spark, np.hstack([v + 0.01 * noise, noise]), v))
    mixed = interp.summary(codes(spark, np.hstack([v @ mix.T, noise]), v))
    a, b = interp.overall(clear).first(), interp.overall(mixed).first()
    assert a["mig"] > 0.5 and b["mig"] < 0.15
    assert a["sap"] > 0.8 and b["sap"] < 0.3
    for r in clear.collect():
        assert r["best_dim"] == r["factor"] and r["best_r2"] > 0.95


def test_constant_factor_is_null_and_left_out(spark):
    rng = np.random.default_rng(3)
    v = np.column_stack([rng.normal(size=500), np.ones(500)])
    out = interp.summary(codes(spark, rng.normal(size=(500, 3)), v)).orderBy("factor").collect()
    assert out[1]["mig"] is None and out[1]["sap"] is None and out[0]["mig"] is not None


def test_summary_matches_numpy(spark):
    rng = np.random.default_rng(4)
    v = np.column_stack([rng.poisson(0.7, 700), rng.normal(size=700)])
    z = np.column_stack([v[:, 1] + rng.normal(size=700), v[:, 0] * 2 + rng.normal(size=700), rng.normal(size=700)])

    def binned(x):
        edges = np.unique(np.quantile(x, np.arange(1, 20) * 0.05))
        return np.searchsorted(edges, x, side="right")

    def entropy(*cols):
        _, n = np.unique(np.column_stack(cols), axis=0, return_counts=True)
        p = n / n.sum()
        return -(p * np.log(p)).sum()

    got = {r["factor"]: r for r in interp.summary(codes(spark, z, v)).collect()}
    for j in range(2):
        vb = binned(v[:, j])
        mi = sorted(entropy(binned(z[:, i])) + entropy(vb) - entropy(binned(z[:, i]), vb) for i in range(3))
        assert got[j]["mig"] == pytest.approx((mi[-1] - mi[-2]) / entropy(vb))
        r2 = sorted(np.corrcoef(z[:, i], v[:, j])[0, 1] ** 2 for i in range(3))
        assert got[j]["sap"] == pytest.approx(r2[-1] - r2[-2])


def assigned(spark, labels):
    rows = [(s, i, int(c)) for s, lab in labels.items() for i, c in enumerate(lab)]
    return spark.createDataFrame(rows, "seed int, id bigint, cluster int")


def test_relabelled_partition_agrees_fully(spark):
    a = np.arange(300) % 5
    row = stability.pairwise_stability(assigned(spark, {0: a, 1: (a + 2) % 5, 2: 4 - a}), "id", [0, 1, 2]).first()
    assert row["ari_mean"] == pytest.approx(1.0) and row["nmi_mean"] == pytest.approx(1.0)
    assert (row["n_seeds"], row["n_pairs"]) == (3, 3)


def test_independent_partitions_do_not(spark):
    rng = np.random.default_rng(0)
    labels = {s: rng.integers(0, 5, 2_000) for s in range(2)}
    row = stability.pairwise_stability(assigned(spark, labels), "id", [0, 1]).first()
    assert abs(row["ari_mean"]) < 0.1 and row["ari_std"] == 0.0


def test_trivial_partitions_and_lone_seed(spark):
    flat = np.zeros(10)
    row = stability.pairwise_stability(assigned(spark, {0: flat, 1: flat}), "id", [0, 1]).first()
    assert row["ari_mean"] == 1.0 and row["nmi_mean"] == 1.0
    lone = stability.pairwise_stability(assigned(spark, {0: flat}), "id", [0]).first()
    assert lone["n_pairs"] == 0 and lone["ari_mean"] is None


def test_unequal_lengths_are_an_error(spark):
    df = assigned(spark, {0: np.zeros(10), 1: np.zeros(9)})
    with pytest.raises(Exception, match="lengths differ"):
        stability.pairwise_stability(df, "id", [0, 1]).collect()


def test_r2(spark):
    rng = np.random.default_rng(5)
    y, p = rng.normal(size=100), rng.normal(size=100)
    df = spark.createDataFrame([("rfm_R", float(a), float(b)) for a, b in zip(y, p, strict=True)], "name string, y double, p double")
    want = 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    scores = ranking.r2_scores(df)
    assert scores.first()["r2"] == pytest.approx(want)
    assert ranking.r2_summary(scores, ["rfm_R"]).first()["r2_rfm_mean"] == pytest.approx(want)
    assert scores.select(F.count("*")).first()[0] == 1
