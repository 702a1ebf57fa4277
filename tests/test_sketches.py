import math
from datetime import date

import numpy as np
from pyspark.sql import functions as F

from buyerlens.operators import sketches

COLUMNS = ["k", "price", "brand", "small", "nothing"]


def log(spark, n=60_000):
    day = F.when(F.col("id") % 100 == 0, None).otherwise(F.date_add(F.lit(date(2024, 1, 1)), (F.sqrt("id") / 50).cast("int")))
    return spark.range(n).select(
        day.alias("event_date"),
        F.when(F.col("id") % 7 != 0, F.pmod(F.xxhash64("id"), F.lit(20_000))).alias("k"),
        F.when(F.col("id") % 11 != 0, F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) / 7.0).alias("price"),
        F.concat(F.lit("b"), (F.col("id") % 13).cast("string")).alias("brand"),
        (F.col("id") % 5).cast("short").alias("small"),
        F.lit(None).cast("double").alias("nothing"),
    )


def test_merged_profile_is_near_the_exact_one(spark, tmp_path):
    df, path = log(spark), str(tmp_path / "sketches")
    early = (F.col("event_date") < date(2024, 1, 3)) | F.col("event_date").isNull()
    sketches.add_days(df.where(early), path, COLUMNS)
    first = sketches.stored_days(spark, path)
    sketches.add_days(df, path, COLUMNS)
    stored = spark.read.parquet(path)
    assert None in first and len(first) == 3
    assert stored.groupBy("day", "name").count().where("count > 1").isEmpty()  # no day twice
    got = {r["name"]: r for r in sketches.merged_profile(stored, {"p50": 0.5, "p99": 0.99}).collect()}
    rows = df.toPandas()
    for c in COLUMNS:
        values = rows[c].dropna()
        assert (got[c].n_rows, got[c].nulls) == (len(rows), rows[c].isna().sum())
        assert abs(got[c].distinct - values.nunique()) <= 4 * sketches.distinct_error() * values.nunique()
    for c in ("k", "price", "small"):
        values = np.sort(rows[c].dropna().to_numpy(dtype=float))
        assert (got[c].min, got[c].max) == (values[0], values[-1]) and math.isclose(got[c]["mean"], values.mean())
        for name, q in (("p50", 0.5), ("p99", 0.99)):
            low, high = (np.searchsorted(values, got[c][name], side) / len(values) for side in ("left", "right"))
            assert low - 3 * sketches.rank_error() <= q <= high + 3 * sketches.rank_error()
    assert tuple(got["nothing"])[3:] == (0, None, None, None, None, None) and got["brand"].p99 is None


def test_a_new_day_reads_only_itself(spark, tmp_path):
    day = date(2024, 1, 1)
    df = log(spark, 3000).withColumn("event_date", F.coalesce("event_date", F.lit(day)))
    folder, path = str(tmp_path / "log"), str(tmp_path / "sketches")
    df.write.partitionBy("event_date").parquet(folder)
    sketches.add_days(spark.read.parquet(folder), path, ["k"])
    before = {(r["day"], r["n_rows"]) for r in spark.read.parquet(path).collect()}
    extra = df.limit(10).withColumn("event_date", F.lit(date(2024, 6, 1)))
    extra.coalesce(1).write.mode("append").partitionBy("event_date").parquet(folder)
    (next((tmp_path / "log" / "event_date=2024-01-01").glob("*.parquet"))).write_bytes(b"no longer readable")
    sketches.add_days(spark.read.schema(df.schema).parquet(folder), path, ["k"])
    after = {(r["day"], r["n_rows"]) for r in spark.read.parquet(path).collect()}
    assert after == before | {(date(2024, 6, 1), 10)}


def test_empty_log_and_odd_numbers(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, 0.0), (1, -0.0), (1, float("nan")), (1, None), (2, 4.0)], "event_date int, x double"
    )
    path = str(tmp_path / "odd")
    sketches.add_days(df.where("false"), path, ["x"])
    assert not sketches.stored_days(spark, path)
    sketches.add_days(df, path, ["x"])
    row = sketches.merged_profile(spark.read.parquet(path), {"p50": 0.5}).first()
    assert (row.n_rows, row.nulls, row.distinct, row.min, row.max) == (5, 1, 3, 0.0, 4.0)
    assert math.isclose(row["mean"], 4 / 3) and row.p50 == 0.0
