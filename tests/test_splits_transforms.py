import numpy as np
import pytest
from pyspark.sql import functions as F

from buyerlens.config import CustomerConfig
from buyerlens.functions.frames import to_long
from buyerlens.operators import constructs, splits, transforms
from buyerlens.operators.customers import engineer

from buyerlens.plans.lookups import salted_lookup
from buyerlens.plans.ordered import exact_quantiles, keyed_rank, keyed_sample, running_totals
from buyerlens.sources.customers import CUSTOMER_SCHEMA, read_delimited

CFG = CustomerConfig()


@pytest.fixture(scope="module")
def customers(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(400):
        row = [i, int(rng.integers(1940, 1995)), ["Basic", "PhD"][i % 2], ["Married", "YOLO", "Single"][i % 3]]
        row += [None if i % 40 == 0 else int(rng.normal(50_000, 9_000)), i % 3, i % 2, "04-09-2012"]
        row += [int(v) for v in rng.integers(0, 100, 7)] + [int(v) for v in rng.integers(0, 9, 5)]
        row += [int(v) for v in rng.integers(0, 2, 6)] + [3, 11, int(i % 7 == 0)]
        rows.append(tuple(row))
    return spark.createDataFrame(rows, CUSTOMER_SCHEMA)


def test_engineer(spark, customers, tmp_path):
    path = str(tmp_path / "customers")
    customers.write.option("header", True).csv(path, sep="\t")
    out = engineer(read_delimited(spark, path), CFG)
    assert len(out.columns) == 27 and out.count() == 400
    row = out.where("ID = 1").first()
    assert row["Customer_Tenure_Days"] == 849 and row["Marital_Status"] == "Other"
    assert out.where("Income IS NULL").count() == 10


def test_stratified_split_is_exact_and_keyed(customers):
    out = splits.stratified_split(customers, "ID", "Response", 3)
    got = {(r["Response"], r["split"]): r["n"] for r in out.groupBy("Response", "split").agg(F.count("*").alias("n")).collect()}
    assert got[(1, "test")] == round(58 * 0.2) and got[(0, "test")] == round(342 * 0.2)
    assert sum(got.values()) == 400
    again = splits.stratified_split(customers.repartition(7), "ID", "Response", 3)
    assert sorted(map(tuple, out.select("ID", "split").collect())) == sorted(map(tuple, again.select("ID", "split").collect()))
    other = splits.stratified_split(customers, "ID", "Response", 4)
    assert out.select("ID", "split").exceptAll(other.select("ID", "split")).count() > 0


def test_hashed_split_laws(spark):
    users = spark.range(5_000).withColumnRenamed("id", "user_id")
    out = splits.hashed_split(users, "user_id", 1)
    checks = {r["split"]: r for r in splits.split_checks(out, users, "user_id").collect()}
    assert sum(r["n"] for r in checks.values()) == 5_000
    assert all(r["shared"] == r["outside"] == r["missing"] == 0 for r in checks.values())
    assert abs(checks["train"]["n"] / 5_000 - 0.6) < 0.03
    twice = out.where("split = 'train'").orderBy("user_id").limit(1).withColumn("split", F.lit("val"))
    bad = splits.split_checks(out.unionByName(twice), users.where("user_id < 4990"), "user_id").collect()
    assert sum(r["shared"] for r in bad) == 1 and sum(r["outside"] for r in bad) == 10
    lacking = splits.split_checks(out.where("user_id >= 7"), users, "user_id").first()
    assert lacking["missing"] == 7


def test_held_out_rows_cannot_move_train_fits(customers):
    base = splits.stratified_split(engineer(customers, CFG), "ID", "Response", 0)
    loud = base.withColumn("Income", F.when(F.col("split") == "train", F.col("Income")).otherwise(F.col("Income") * 1000 + 1_000_000))
    a, names, scaler_a, fit_a = transforms.prepare_customers(base, CFG)
    b, _, scaler_b, fit_b = transforms.prepare_customers(loud, CFG)
    assert scaler_a == scaler_b and fit_a["bounds"] == fit_b["bounds"] and fit_a["medians"] == fit_b["medians"]
    means = a.where("split = 'train'").agg(*[F.avg(c).alias(c) for c in CFG.numeric]).first()
    assert max(abs(m) for m in means) < 1e-9
    assert len(names) == 23 + 2 + 3
    row = a.where("split = 'train'").select("Income").collect()
    other = b.where("split = 'train'").select("Income").collect()
    assert sorted(row) == sorted(other)


def test_unseen_level_is_all_zero(spark):
    df = spark.createDataFrame([("train", "a"), ("train", "b"), ("test", "zz"), ("test", None)], "split string, c string")
    hot = transforms.one_hot_columns(transforms.fit_levels(df, ["c"]))
    rows = df.where("split = 'test'").select(*[c.alias(n) for n, c in hot.items()]).collect()
    assert list(hot) == ["c_a", "c_b"] and all(sum(r) == 0 for r in rows)


def test_zero_deviation_scales_by_one(spark):
    df = spark.createDataFrame([("train", 2.0), ("train", 2.0)], "split string, x double")
    scaler = transforms.fit_scaler(df, ["x"])
    assert scaler.scale == {"x": 1.0}
    with pytest.raises(ValueError):
        transforms.fit_scaler(df.withColumn("split", F.lit("test")), ["x"])


@pytest.mark.parametrize("seed", [0, 1])
def test_quantiles_match_numpy(spark, seed, ranges):
    rng = np.random.default_rng(seed)
    x = np.round(rng.exponential(3, 1_003), seed)  # heavy ties for seed 0
    x[: len(x) // 3] = 0.0
    y = rng.normal(size=1_003)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.77, 0.99, 1.0]
    got = {(r["name"], r["prob"]): r["q"] for r in exact_quantiles(to_long(df, [], ["x", "y"]), probs).collect()}
    for name, values in (("x", x), ("y", y)):
        for p in probs:
            assert got[(name, p)] == pytest.approx(np.quantile(values, p), abs=1e-12)


def test_running_totals_both_ways(spark, ranges):
    df = spark.createDataFrame([(g, float(i), i % 5 + 1) for g in "ab" for i in range(300)], "g string, x double, n bigint")
    for down in (False, True):
        rows = running_totals(df, "x", ["n"], ["g"], descending=down).where("g = 'a'").collect()
        rows.sort(key=lambda r: r["x"], reverse=down)
        assert [r["cum_n"] for r in rows] == list(np.cumsum([r["n"] for r in rows]))
        assert {r["all_n"] for r in rows} == {900}


def test_stratified_split_keeps_null_labels(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else i % 2) for i in range(400)], "id long, y int")
    rows = splits.stratified_split(df, "id", "y", 3).groupBy("y", "split").count().collect()
    assert sum(r["count"] for r in rows) == 400
    assert {r["split"]: r["count"] for r in rows if r["y"] is None} == {"test": 20, "val": 20, "train": 60}


def test_keyed_sample_and_rank(spark):
    df = spark.range(3_000)
    ranked = keyed_rank(df, "id", 9).orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == list(range(1, 3_001))
    first = {r["id"] for r in ranked[:500]}
    assert {r["id"] for r in keyed_sample(df.repartition(5), "id", 9, 500).collect()} == first
    assert keyed_sample(df, "id", 9, 10_000).count() == 3_000


def test_salted_lookup_keeps_hot_and_null_keys(spark):
    rows = spark.range(1_000).select("id", F.when(F.col("id") % 3 != 0, F.lit(7)).cast("bigint").alias("k"))
    look = spark.createDataFrame([(7, "seven"), (8, "eight")], "k bigint, name string")
    out = salted_lookup(rows, look, "k", "id").groupBy("name").agg(F.count("*")).collect()
    assert {r[0]: r[1] for r in out} == {"seven": 666, None: 334}


def test_customer_constructs(customers):
    frame, names = constructs.customer_constructs(engineer(customers, CFG), CFG)
    # Construct names of the customer table.
    assert names == [
        "rfm_R", "rfm_F", "rfm_M", "price_sensitivity", "affinity_wines", "affinity_fruits",
        "affinity_meat", "affinity_fish", "affinity_sweet", "affinity_gold",
    ]
    rows = frame.select(*names).collect()
    for r in rows:
        assert 0 <= r["price_sensitivity"] <= 1
        assert sum(r[n] for n in names[4:]) == pytest.approx(1.0)


def test_construct_fit_ignores_held_out(customers):
    split = splits.stratified_split(engineer(customers, CFG), "ID", "Response", 0)
    loud = split.withColumn("MntWines", F.when(F.col("split") == "train", F.col("MntWines")).otherwise(F.col("MntWines") * 1000))
    fits = []
    for df in (split, loud):
        frame, names = constructs.customer_constructs(df, CFG)
        fits.append(constructs.standardised(frame, names)[1])
    assert fits[0] == fits[1]


def test_inverse_standardise(spark):
    scaler = transforms.Scaler({"x": 10.0}, {"x": 2.0})
    df = spark.createDataFrame([("x", 1.5), ("hot", 0.25)], "name string, z double")
    got = {r["name"]: r["raw"] for r in transforms.inverse_standardise(df, scaler, "name", "z").collect()}
    assert got == {"x": 13.0, "hot": 0.25}


def test_equal_spends_are_one_value_in_any_order_of_lines(spark, tmp_path):
    from buyerlens.sources.customers import customers_from_orders

    tables = {
        "customer": ([(i, 0, 1.0, "BUILDING") for i in (1, 2, 3)], "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "orders": (
            [(i, i, "1-URGENT", "2024-01-01" if i < 3 else "2024-12-01") for i in (1, 2, 3)],
            "o_orderkey long, o_custkey long, o_orderpriority string, o_orderdate string",
        ),
        "lineitem": (
            [(1, 1, p, 0.0, "N") for p in (0.1, 0.2, 0.3)] + [(2, 1, p, 0.0, "N") for p in (0.3, 0.2, 0.1)],
            "l_orderkey long, l_partkey long, l_extendedprice double, l_discount double, l_returnflag string",
        ),
        "part": ([(1, "ECONOMY")], "p_partkey long, p_type string"),
        "nation": ([(0, 0)], "n_nationkey int, n_regionkey int"),
        "region": ([(0, "ASIA")], "r_regionkey int, r_name string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    got = customers_from_orders(spark, str(tmp_path)).select("ID", "MntWines").collect()
    assert sorted((r["ID"], r["MntWines"]) for r in got) == [(1, 0.6), (2, 0.6)]
