import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from buyerlens.config import SweepConfig
from buyerlens.operators import protocol, records, selection, significance
from buyerlens.sources import records as sources
from buyerlens.sources.tables import read_or_build

SCHEMA = "task string, method string, head string, seed int, metric string, value double"


def long(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def base(spark):
    rows = []
    for seed in range(6):
        for method, level in (("raw", 0.9), ("rfm", 0.5), ("ae", 0.4)):
            rows.append(("primary", method, "gbt", seed, "pr_auc", level + 0.001 * seed * (1 + len(method))))
            rows.append(("churned", method, "gbt", seed, "pr_auc", 1.3 - level))
    return rows


def test_aggregate_keeps_complete_metrics_only(spark):
    rows = base(spark) + [("primary", "ae", "gbt", 0, "extra", 1.0)]
    rows += [("primary", "ae", "gbt", s, "hole", float("nan") if s == 2 else 2.0) for s in range(6)]
    got = {(r["method"], r["task"], r["metric"]): r for r in records.aggregate(long(spark, rows)).collect()}
    assert ("ae", "primary", "extra") not in got
    assert got[("ae", "primary", "hole")]["mean"] == 2.0 and got[("ae", "primary", "hole")]["std"] == 0.0
    assert got[("rfm", "primary", "pr_auc")]["n_seeds"] == 6
    lone = records.aggregate(long(spark, [r for r in rows if r[3] == 0])).where("metric = 'pr_auc'").first()
    assert lone["std"] == 0.0


def test_best_baseline_per_task(spark):
    got = {r["task"]: r["method"] for r in records.best_baselines(long(spark, base(spark)), "pr_auc", "gbt").collect()}
    assert got == {"primary": "rfm", "churned": "ae"}
    only_raw = long(spark, [r for r in base(spark) if r[1] == "raw"])
    assert records.best_baselines(only_raw, "pr_auc", "gbt").count() == 0
    assert records.best_baselines(only_raw, "pr_auc", "gbt", last_resort=True).count() == 2


def test_record_diff(spark):
    ref = long(spark, base(spark))
    assert records.record_diff(ref, ref).count() == 0
    near = ref.withColumn("value", F.col("value") + 1e-12)
    assert records.record_diff(near, ref).count() == 0
    nan = long(spark, [("primary", "rfm", "gbt", 0, "pr_auc", float("nan"))])
    assert records.record_diff(nan, nan).count() == 0
    new = long(
        spark,
        [
            ("primary", "rfm", "gbt", 0, "pr_auc", 0.9),
            ("primary", "rfm", "gbt", 0, "other", 0.9),
            ("primary", "new", "gbt", 0, "pr_auc", 0.9),
        ],
    )
    assert sorted(r["problem"] for r in records.record_diff(new, ref).collect()) == [
        "absent key",
        "absent metric",
        "value",
    ]


def brute_signed_rank(d):
    d = np.array([x for x in d if x != 0])
    a = np.abs(d)
    ranks = np.array([(a < x).sum() + ((a == x).sum() + 1) / 2 for x in a])
    w = ranks[d > 0].sum()
    sums = [sum(r for r, s in zip(ranks, signs, strict=True) if s) for signs in itertools.product([0, 1], repeat=len(d))]
    return min(1.0, 2 * min(np.mean([s <= w for s in sums]), np.mean([s >= w for s in sums])))


@pytest.mark.parametrize("seed", range(8))
def test_signed_rank_is_exact(seed):
    rng = np.random.default_rng(seed)
    d = np.round(rng.normal(0.4, 1, 9), 0 if seed % 2 else 3)
    d[0] = 1.0
    assert significance.exact_signed_rank(d) == pytest.approx(brute_signed_rank(d))


def test_signed_rank_of_one_sided_six_is_the_floor():
    assert significance.exact_signed_rank(np.arange(1.0, 7.0)) == 2.0**-5
    assert significance.exact_signed_rank(np.zeros(4)) is None


# Two-sided tail probabilities of Student's t from published tables.
T_TABLE = [(12.706205, 1, 0.05), (4.302653, 2, 0.05), (3.182446, 3, 0.05), (2.776445, 4, 0.05),
           (2.570582, 5, 0.05), (2.446912, 6, 0.05), (3.499483, 7, 0.01), (2.228139, 10, 0.05), (0.0, 5, 1.0)]


def test_student_tail(spark):
    df = spark.createDataFrame([(t, n, p) for t, n, p in T_TABLE], "t double, n bigint, p double")
    for r in df.select("p", significance.student_two_sided(F.col("t"), F.col("n")).alias("got")).collect():
        assert r["got"] == pytest.approx(r["p"], abs=2e-6)


def pairs_of(spark, a, b):
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b, strict=True))]
    return spark.createDataFrame(rows, "seed int, a double, b double")


def test_paired_rules(spark):
    a = np.array([0.51, 0.53, 0.52, 0.55, 0.56, 0.54])
    gap = np.array([0.02, 0.031, 0.012, 0.04, 0.021, 0.034])
    row = significance.paired_tests(pairs_of(spark, a, a - gap)).first()
    assert row["wilcoxon_p"] == row["wilcoxon_floor"] == 2.0**-5
    assert 0 < row["ttest_p"] < 0.01 and row["n_seeds"] == 6
    same = significance.paired_tests(pairs_of(spark, a, a)).first()
    assert same["wilcoxon_p"] == same["ttest_p"] == 1.0
    none = significance.paired_tests(pairs_of(spark, a, a), equal_p=None).first()
    assert none["wilcoxon_p"] is None
    lone = significance.paired_tests(pairs_of(spark, a[:1], a[:1])).first()
    assert lone["wilcoxon_p"] is None and lone["wilcoxon_floor"] is None


def test_significance_excludes_the_ceiling(spark):
    rows = significance.significance_vs_best(long(spark, base(spark))).where("task = 'primary'").collect()
    assert {r["best_method"] for r in rows} == {"rfm"} and {r["method"] for r in rows} == {"raw", "ae"}


def points(spark, rows):
    return spark.createDataFrame(rows, "beta double, lambda_align double, x double, y double, s double")


def test_pareto_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(float(i), 0.0, float(a), float(b), 0.1) for i, (a, b) in enumerate(rng.integers(0, 8, (40, 2)))]
    rows.append((99.0, 0.0, None, 9.0, 0.1))
    front = {r["beta"] for r in selection.pareto_frontier(points(spark, rows), "x", "y").collect()}
    known = [r for r in rows if r[2] is not None]
    want = {
        p[0]
        for p in known
        if not any(q[2] >= p[2] and q[3] >= p[3] and (q[2] > p[2] or q[3] > p[3]) for q in known)
    }
    assert front == want


def test_sweet_spot_rules(spark):
    rows = [(0.1, 0.0, 0.1, 0.60, 0.05), (0.1, 1.0, 0.5, 0.57, 0.01), (0.5, 1.0, 0.9, 0.30, 0.01)]
    row = selection.sweet_spots(points(spark, rows), "x", "y", "s").first()
    assert (row["beta"], row["lambda_align"], row["y_slack"], row["fallback_used"]) == (0.1, 1.0, 0.05, False)
    tight = [(b, v, x, y, 0.0) for b, v, x, y, _ in rows]
    row = selection.sweet_spots(points(spark, tight), "x", "y", "s").first()
    assert (row["beta"], row["lambda_align"]) == (0.1, 0.0)
    blind = [(0.1, 0.0, None, 0.60, 0.01), (0.5, 1.0, 0.9, 0.30, 0.01)]
    row = selection.sweet_spots(points(spark, blind), "x", "y", "s").first()
    assert row["fallback_used"] and row["beta"] == 0.1 and row["x"] is None


def sweep_record(seed, beta, lam):
    pr = 0.50 - 0.05 * lam - 0.02 * beta + 0.001 * seed
    mig = 0.05 + 0.30 * lam + 0.01 * beta
    heads = {"gbt": {"pr_auc": pr}, "logreg": {"pr_auc": pr - 0.1}}
    return {
        "dataset": "d", "seed": seed, "beta": beta, "lambda_align": lam, "aligned_dims": 3 if lam else 0,
        "loss_final": {"kl_free": 1.0}, "loss_history": [{"epoch": 0.0}],
        "downstream": {"primary": heads, "churned": {"gbt": {"pr_auc": pr + 0.2}}},
        "downstream_val": {"primary": heads},
        "interpretability": {"mig": mig, "sap": mig / 2, "axis_alignment": {"rfm_R": {"best_dim": 0, "best_r2": 0.9}}},
        "alignment": {"r2_mean": lam / 2, "r2_rfm_mean": lam / 3} if lam else None,
        "wall_time_s": 1.0,
    }


def write(folder, record):
    name = f"s{record['seed']}_b{record['beta']}_l{record['lambda_align']}.json"
    (folder / name).write_text(json.dumps(record, indent=1))


def test_sweep_records_end_to_end(spark, tmp_path):
    for seed, beta, lam in itertools.product(range(3), (0.5, 1.0), (0.0, 1.0)):
        write(tmp_path, sweep_record(seed, beta, lam))
    read = sources.read_sweep_records(spark, str(tmp_path), multi_line=True)
    assert read.count() == 12
    flat = records.flatten(read)
    assert flat.where("metric = 'churned_pr_auc'").count() == 12
    assert flat.where("metric = 'r2_mean' AND value IS NULL").count() == 6
    baselines = long(
        spark,
        [("primary", m, "gbt", s, "pr_auc", v + 0.0013 * s) for s in range(3) for m, v in (("pca", 0.44), ("raw", 0.6))],
    )
    tables = protocol.analyse(read, baselines)
    spot = tables["sweet_spot"].first()
    # the best validation mean has no alignment score, and no aligned point is within its deviation
    assert (spot["beta"], spot["lambda_align"], spot["fallback_used"]) == (0.5, 0.0, True)
    assert tables["grid"].count() == 4
    assert {r["config"] for r in tables["ablations"].collect()} == {"sweet_spot", "beta_vae", "vae_align", "bar (pca)"}
    assert tables["comparison"].first()["best_baseline"] == "pca"
    assert tables["tradeoff_r2"].count() == 2 and tables["tradeoff_mig"].count() == 4


def test_corrupt_and_missing_records_are_named(spark, tmp_path):
    write(tmp_path, sweep_record(0, 0.5, 1.0))
    (tmp_path / "broken.json").write_text('{"dataset": "d", "seed": ')
    with pytest.raises(ValueError, match="broken.json"):
        sources.read_sweep_records(spark, str(tmp_path), multi_line=True)
    with pytest.raises(FileNotFoundError):
        sources.read_sweep_records(spark, str(tmp_path / "nowhere"))


def test_grid_resume_and_manifest(spark):
    grid = SweepConfig(betas=(0.5, 1.0), lambdas=(0.0, 0.25), seeds=(0, 1))
    all_runs = sources.grid(spark, grid.seeds, grid.betas, grid.lambdas)
    done = all_runs.where("seed = 0")
    assert sources.remaining(all_runs, done).count() == 4
    row = sources.manifest(all_runs).first()
    assert row["n_runs"] == 8 and row["runs"].startswith("s0_b0.5_l0,s0_b0.5_l0.25,s0_b1_l0")


def test_read_or_build_builds_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert read_or_build(spark, str(tmp_path / "t"), build).count() == 3
    assert len(calls) == 1


def test_top_changes(spark):
    df = spark.createDataFrame([(0, f"f{i}", (-1.0) ** i * i) for i in range(12)], "dim int, name string, delta double")
    got = records.top_changes(df, "dim", "name", "delta", 3).orderBy("place").collect()
    assert [r["name"] for r in got] == ["f11", "f10", "f9"]
