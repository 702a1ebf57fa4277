import duckdb
import pytest

import __spark_entry__ as entry
from tools import check_oracle

SF = "/root/testdata/sf0.001"
SOME = [
    "user_table",
    "capped_category_shares",
    "customer_prepared",
    "stratified_split",
    "precision_at_k",
    "silhouette",
    "mutual_information_gap",
    "stability_map",
    "record_aggregate",
    "paired_tests",
    "sweet_spot",
    "target_distribution",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in check_oracle.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_names():
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries) and set(SOME) <= set(oracle)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns[0] == "user_id"


@pytest.mark.parametrize("name", SOME)
def test_rows_equal_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    got = check_oracle.rows_of(df.columns, [tuple(x) for x in df.collect()])
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert got == check_oracle.rows_of(cols, cur.fetchall())


def test_registered_fits_run_the_defaults(spark, monkeypatch):
    from buyerlens.config import EvalConfig, ModelConfig, SweepConfig
    from buyerlens.registry import representations as reg

    assert reg.MODEL == ModelConfig() and reg.EVAL == EvalConfig()
    seen, grids = [], []

    def prepared(spark, sf_dir, seed=0):
        frame = spark.createDataFrame([(1, "train")], "id long, split string")
        return reg.protocol.Bench(frame, [], {}, reg.EVAL, reg.MODEL, seed)

    def record(spark, sf_dir, tasks=("primary",), seed=reg.SEED):
        made = prepared(spark, sf_dir, seed)
        seen.append((tuple(tasks), seed))
        return made

    monkeypatch.setattr(reg, "bench", record)
    monkeypatch.setattr(reg.protocol, "evaluate_baselines", lambda b: b.frame)
    entry.queries()["baseline_campaign"](spark, SF)
    assert seen == [(tuple(reg.TASKS), s) for s in EvalConfig().seeds]
    seen.clear()

    def sweep(bench_of, grid, path):
        grids.append(grid)
        bench_of(grid.seeds[-1])
        raise StopIteration

    monkeypatch.setattr(reg.protocol, "run_sweep", sweep)
    with pytest.raises(StopIteration):
        entry.queries()["sweep_run"](spark, SF)
    assert grids == [SweepConfig()] and seen == [(tuple(reg.TASKS), SweepConfig().seeds[-1])]


def test_seeds_share_a_user_table(spark, monkeypatch, tmp_path):
    from datetime import datetime, timedelta

    from buyerlens.registry import events
    from buyerlens.registry import representations as reg

    kinds = ("view", "click", "purchase")
    rows = [
        (i, datetime(2024, 1, 1) + timedelta(hours=i % 715), i % 23, kinds[i % 7 % 3], float(i % 9), f'{{"k": {i % 31}}}') for i in range(1_500)
    ]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(
        f"{tmp_path}/events.parquet"
    )
    seen = []

    def record(spark, source, tasks=("primary",), seed=reg.SEED):
        seen.append((source, seed))
        return seed

    monkeypatch.setattr(reg, "bench", record)
    monkeypatch.setattr(reg.protocol, "evaluate_baselines", lambda seed: spark.range(seed, seed + 1))
    entry.queries()["baseline_campaign"](spark, str(tmp_path))
    tables = [source for source, _ in seen]
    assert len(seen) == len(reg.EVAL.seeds) and all(t is tables[0] for t in tables)
    for seed in (0, 3):
        own, shared = (events.prepared_users(spark, source, seed) for source in (str(tmp_path), tables[0]))
        assert own.features == shared.features and own.fitted["constructs"] == shared.fitted["constructs"]
        a, b = ({r["id"]: r for r in p.frame.collect()} for p in (own, shared))
        assert len(a) > 10 and a.keys() == b.keys()
        for i, r in a.items():
            assert r["features"] == pytest.approx(b[i]["features"]) and r["constructs"] == pytest.approx(b[i]["constructs"])
            assert all(r[c] == b[i][c] for c in ("split", "y_primary", "y_churned", "y_next_category"))
