from datetime import datetime

import pytest
from pyspark.sql import functions as F

from buyerlens.config import EventConfig, parse_anchor
from buyerlens.operators import user_table as ut
from buyerlens.sources.events import EVENT_SCHEMA, parse_event_time, read_csv_log, with_derived, write_log

CFG = EventConfig()


def event(user, when, kind="view", price=10.0, code="electronics.phone", session="s", product=1, category=7):
    return (f"{when} UTC", kind, product, category, code, "b", price, user, session)


def log_of(spark, rows):
    raw = spark.createDataFrame(rows, EVENT_SCHEMA)
    return with_derived(raw.withColumn("ts", parse_event_time("event_time")))


@pytest.fixture(scope="module")
def rows():
    days = [f"2019-10-0{d} 10:00:00" for d in range(1, 6)]
    out = [event(1, d, session=f"a{i}") for i, d in enumerate(days)]
    out.append(event(1, "2019-11-25 09:00:00", "purchase", 500.0, category=9, code="apparel.shoes"))
    out += [event(2, d, session=None) for d in days]
    out.append(event(2, "2019-10-20 10:00:00", "purchase", 99.0, code=None, category=8))
    out += [event(3, d) for d in days[:2]]
    return out


def test_windows_labels_and_universe(spark, rows):
    table = {r["user_id"]: r for r in ut.build_user_table(log_of(spark, rows), CFG).collect()}
    assert set(table) == {1, 2}
    one, two = table[1], table[2]
    assert (one["n_events"], one["n_purch"], one["label_purchase"]) == (5, 0, True)
    assert one["total_purch_value"] == 0.0 and one["label_next_cat"] == "apparel"
    assert (two["n_purch"], two["total_purch_value"], two["label_churned"]) == (1, 99.0, True)
    assert two["label_next_cat"] is None
    assert two["n_sessions"] == 2 and two["n_active_days"] == 6  # null and "s"
    assert one["recency_days"] == pytest.approx(47 + 14 / 24)
    assert two["cart_abandon_rate"] == 0.0 and two["conversion"] == pytest.approx(0.2)
    assert one["cat_share_electronics"] == 1.0 and two["cat_share_unknown"] == pytest.approx(1 / 6)


def test_null_session_counts_once(spark):
    rows = [event(5, f"2019-10-0{d} 10:00:00", session=None if d < 4 else "x") for d in range(1, 7)]
    row = ut.build_user_table(log_of(spark, rows), CFG).first()
    assert row["n_sessions"] == 2 and row["n_active_days"] == 6


def test_label_window_is_closed_to_the_second(spark):
    base = [event(1, f"2019-10-0{d} 10:00:00") for d in range(1, 6)]
    inside = base + [event(1, "2019-11-30 23:59:59.900", "purchase")]
    outside = base + [event(1, "2019-12-01 00:00:00", "purchase")]
    assert ut.build_user_table(log_of(spark, inside), CFG).first()["label_purchase"]
    assert not ut.build_user_table(log_of(spark, outside), CFG).first()["label_any_event"]


def test_ratios_are_not_clipped(spark):
    rows = [event(1, f"2019-10-0{d} 10:00:00", "purchase") for d in range(1, 6)]
    rows += [event(1, "2019-10-07 10:00:00", "cart"), event(1, "2019-10-07 11:00:00", "view")]
    row = ut.build_user_table(log_of(spark, rows), CFG).first()
    assert row["cart_abandon_rate"] == -4.0 and row["conversion"] == 5.0


def test_first_purchase_ties_by_product_and_skips_null_category(spark):
    rows = [event(1, f"2019-10-0{d} 10:00:00") for d in range(1, 6)]
    at = "2019-11-23 10:00:00"
    rows += [
        event(1, "2019-11-23 09:00:00", "purchase", category=None, code=None),
        event(1, at, "purchase", product=5, category=50, code="five.x"),
        event(1, at, "purchase", product=4, category=40, code="four.x"),
    ]
    assert ut.build_user_table(log_of(spark, rows), CFG).first()["label_next_cat"] == "four"


def test_cap_creates_other_share(spark):
    rows = [event(1, f"2019-10-0{d} 10:00:00", code=f"c{d}.x") for d in range(1, 7)]
    capped = EventConfig(top_categories=2)
    row = ut.build_user_table(log_of(spark, rows), capped).first().asDict()
    assert "cat_share_other" in row
    assert row["cat_share_other"] == pytest.approx(4 / 6)
    assert "cat_share_other" not in ut.build_user_table(log_of(spark, rows), CFG).columns


def test_no_label_column_is_a_feature(spark, rows):
    names = ut.feature_columns(ut.build_user_table(log_of(spark, rows), CFG))
    assert names and not [n for n in names if n.startswith("label_") or n == "user_id"]


def test_class_codes(spark):
    classes = ut.next_category_classes(["cat_share_b", "cat_share_a", "cat_share_unknown", "n_events"])
    assert classes == ["a", "b", "other", "unknown"]
    df = spark.createDataFrame([("a",), ("zz",), ("unknown",), (None,)], "c string")
    got = [r[0] for r in df.select(ut.class_code("c", classes)).collect()]
    assert got == [0, 2, 3, None]


def test_day_mask_spans_several_words(spark):
    cfg = EventConfig(feature_start=datetime(2019, 1, 1))
    rows = [event(1, f"2019-{m:02d}-15 10:00:00") for m in range(1, 11)]
    assert ut.build_user_table(log_of(spark, rows), cfg).first()["n_active_days"] == 10


def test_csv_scan_and_partitioned_copy_agree(spark, rows, tmp_path):
    raw = spark.createDataFrame(rows, EVENT_SCHEMA)
    raw.write.option("header", True).csv(str(tmp_path / "csv"))
    log = read_csv_log(spark, [str(tmp_path / "csv")])
    path = write_log(log, str(tmp_path / "log"))
    again = spark.read.parquet(path)
    a = sorted(map(tuple, ut.build_user_table(log, CFG).collect()))
    b = sorted(map(tuple, ut.build_user_table(again, CFG).collect()))
    assert a == b and len(a) == 2
    plan = ut.between(again, CFG.feature_start, CFG.label_start)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan


def test_window_filter_reaches_the_scan(spark):
    from buyerlens.registry.base import EVENTS
    from buyerlens.sources.events import log_from_events

    log = log_from_events(spark, "/root/testdata/sf0.001")
    plan = ut.user_aggregates(log, EVENTS, ["top1"])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,2024-01-01T00:00)" in plan
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    assert "Expand" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_hot_user_is_summed_in_parts(spark):
    many = spark.range(30_000).select(
        F.lit(1).cast("bigint").alias("user_id"),
        F.concat(F.lit("s"), (F.col("id") % 50).cast("string")).alias("user_session"),
        (F.lit("2019-10-02 00:00:00").cast("timestamp_ntz")).alias("ts"),
        F.lit("view").alias("event_type"),
        F.lit(2.0).alias("price"),
        F.col("id").alias("product_id"),
        F.lit(1).cast("bigint").alias("category_id"),
        F.lit("a.b").alias("category_code"),
    )
    row = ut.build_user_table(with_derived(many), CFG).first()
    assert (row["n_events"], row["n_sessions"], row["mean_view_price"]) == (30_000, 50, 2.0)


def test_anchor():
    assert parse_anchor("2019-10-01T00:00:00Z") == datetime(2019, 10, 1)
