"""Queries over the event-log shape."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buyerlens.functions.frames import to_long, vector_to_long
from buyerlens.operators import constructs, profiles, sketches, splits, transforms
from buyerlens.operators import user_table as ut
from buyerlens.plans.ordered import keyed_sample
from buyerlens.registry.base import EVENTS, SEED, query
from buyerlens.registry.sqlparts import BASE, CONSTRUCTS, FEATURES, SHARES, TOPS, r, stmt
from buyerlens.session import materialise, shared_folder
from buyerlens.sources.events import log_from_events, parse_event_time, read_csv_log

CAPPED = replace(EVENTS, top_categories=5)


def user_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ut.build_user_table(log_from_events(spark, sf_dir), EVENTS)


def coded_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User table with next-category code, the same for every seed."""
    table = user_table(spark, sf_dir)
    classes = ut.next_category_classes(table.columns)
    return table.withColumn("label_next_code", ut.class_code("label_next_cat", classes))


def split_table(spark: SparkSession, sf_dir: str, seed: int = SEED) -> DataFrame:
    """User table with split and next-category code."""
    return splits.hashed_split(coded_table(spark, sf_dir), "user_id", seed)


def stored_split_table(spark: SparkSession, sf_dir: str | DataFrame, seed: int = SEED) -> DataFrame:
    """The same, written once for the several passes of a fit and its use; of a stored coded table, a projection of it."""
    if isinstance(sf_dir, DataFrame):
        return splits.hashed_split(sf_dir, "user_id", seed)
    return materialise(split_table(spark, sf_dir, seed))


def features_of(table: DataFrame) -> list[str]:
    return [c for c in ut.feature_columns(table) if c != "split"]  # label_* are out by prefix


@query(
    "event_scan",
    stmt("ev", "SELECT *, split_part(category_code, '.', 1) AS top_cat FROM ev"),
)
def event_scan(spark, sf_dir):
    log = log_from_events(spark, sf_dir)
    text = F.concat(F.substring(F.col("ts").cast("string"), 1, 19), F.lit(" UTC"))
    return log.withColumn("ts", parse_event_time(text))


_CSV_COLUMNS = (
    "event_type, product_id, category_id, category_code, brand, price, user_id, user_session"
)


@query(
    "csv_log_scan",
    stmt(
        "ev",
        f"""SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') || ' UTC' AS event_time, {_CSV_COLUMNS}, ts,
  split_part(category_code, '.', 1) AS top_cat FROM ev""",
    ),
)
def csv_log_scan(spark, sf_dir):
    """The log written as two folders of CSV files with a header, and read as one typed log."""
    log = log_from_events(spark, sf_dir)
    text = F.concat(F.substring(F.col("ts").cast("string"), 1, 19), F.lit(" UTC"))
    rows = log.select(text.alias("event_time"), *_CSV_COLUMNS.split(", "))
    folders = []
    for part in (0, 1):
        folders.append(shared_folder(spark, "csv"))
        rows.where(F.col("user_id") % 2 == part).write.option("header", True).csv(folders[-1])
    return read_csv_log(spark, folders)


@query(
    "window_flags",
    stmt("evf", "SELECT event_id, in_feat, in_label, is_view, is_cart, is_purch FROM evf"),
)
def window_flags(spark, sf_dir):
    return log_from_events(spark, sf_dir).select(
        "event_id", *[c.alias(n) for n, c in ut.window_flags(EVENTS).items()]
    )


@query(
    "feature_window_events",
    stmt("evf", "SELECT event_id, user_id, top_cat FROM evf WHERE in_feat AND top_cat IS NOT NULL"),
)
def feature_window_events(spark, sf_dir):
    return ut.feature_events(log_from_events(spark, sf_dir), EVENTS).select(
        "event_id", "user_id", "top_cat"
    )


_VOCAB = """SELECT row_number() OVER (ORDER BY n DESC, top_cat) AS rank, top_cat, n FROM (
  SELECT top_cat, count(*) AS n FROM evf WHERE in_feat AND top_cat IS NOT NULL GROUP BY top_cat)"""


@query("category_vocabulary", stmt("evf", f"SELECT * FROM ({_VOCAB}) WHERE rank <= 5"))
def category_vocabulary(spark, sf_dir):
    return ut.category_vocabulary(log_from_events(spark, sf_dir), CAPPED)


@query("category_lookup", stmt("lookup", "SELECT * FROM lookup"))
def category_lookup(spark, sf_dir):
    return ut.category_lookup(log_from_events(spark, sf_dir))


_UT_OUT = ", ".join(
    r(c, c) if c in ("recency_days", *BASE[7:], *SHARES) else c for c in FEATURES
)


@query(
    "user_table",
    stmt(
        "ut",
        f"SELECT user_id, {_UT_OUT}, label_purchase, label_any_event, label_churned, label_next_cat FROM ut",
    ),
)
def user_table_query(spark, sf_dir):
    return user_table(spark, sf_dir)


@query(
    "capped_category_shares",
    stmt(
        "evf",
        f"""SELECT user_id, name, {r('c / sum(c) OVER (PARTITION BY user_id)', 'share')} FROM (
  SELECT u.user_id, v.name, count(e.event_id) AS c FROM (
    SELECT user_id FROM evf WHERE in_feat GROUP BY user_id HAVING count(*) >= 5) u
  CROSS JOIN (SELECT top_cat AS name FROM ({_VOCAB}) WHERE rank <= 5
    UNION ALL SELECT 'unknown' UNION ALL SELECT 'other') v
  LEFT JOIN (SELECT *, CASE WHEN top_cat IS NULL THEN 'unknown' WHEN top_cat IN
      (SELECT top_cat FROM ({_VOCAB}) WHERE rank <= 5) THEN top_cat ELSE 'other' END AS name
    FROM evf WHERE in_feat) e ON e.user_id = u.user_id AND e.name = v.name
  GROUP BY u.user_id, v.name)""",
    ),
)
def capped_category_shares(spark, sf_dir):
    log = log_from_events(spark, sf_dir)
    table = ut.build_user_table(log, CAPPED)
    shares = [c for c in table.columns if c.startswith(ut.SHARE)]
    long = to_long(table, ["user_id"], shares, "name", "share")
    return long.withColumn("name", F.substr("name", F.lit(len(ut.SHARE) + 1)))


@query(
    "category_counts",
    stmt(
        "agg",
        "SELECT user_id, "
        + ", ".join(f"CAST(cnt_{c} AS BIGINT) AS cnt_{c}" for c in (*TOPS, "unknown"))
        + " FROM agg",
    ),
)
def category_counts(spark, sf_dir):
    log = log_from_events(spark, sf_dir)
    vocab = ut.vocabulary_names(log, EVENTS)
    names = [f"{ut.COUNT}{c}" for c in [*vocab, ut.UNKNOWN]]
    return ut.user_aggregates(log, EVENTS, vocab).select("user_id", *names)


@query(
    "distinct_sessions_and_days",
    stmt("agg", "SELECT user_id, n_sessions, n_active_days FROM agg"),
)
def distinct_sessions_and_days(spark, sf_dir):
    log = log_from_events(spark, sf_dir)
    return ut.user_aggregates(log, EVENTS, []).select("user_id", "n_sessions", "n_active_days")


@query(
    "price_aggregates",
    stmt("ut", f"SELECT user_id, {', '.join(r(c, c) for c in BASE[7:11])} FROM ut"),
)
def price_aggregates(spark, sf_dir):
    log = log_from_events(spark, sf_dir)
    cols = ut.derived_columns(EVENTS, [])
    return ut.user_aggregates(log, EVENTS, []).select(
        "user_id", *[cols[c].alias(c) for c in BASE[7:11]]
    )


@query(
    "recency_and_ratios",
    stmt(
        "ut",
        f"""SELECT user_id, {r('recency_days', 'recency_days')},
{r('cart_abandon_rate', 'cart_abandon_rate')}, {r('conversion', 'conversion')} FROM ut""",
    ),
)
def recency_and_ratios(spark, sf_dir):
    log = log_from_events(spark, sf_dir)
    cols = ut.derived_columns(EVENTS, [])
    wanted = ("recency_days", "cart_abandon_rate", "conversion")
    return ut.user_aggregates(log, EVENTS, []).select(
        "user_id", *[cols[c].alias(c) for c in wanted]
    )


@query(
    "label_flags",
    stmt("ut", "SELECT user_id, label_purchase, label_any_event, label_churned FROM ut"),
)
def label_flags(spark, sf_dir):
    log = log_from_events(spark, sf_dir)
    return ut.user_aggregates(log, EVENTS, []).select(
        "user_id", "label_purchase", "label_any_event", (~F.col("label_any_event")).alias("label_churned")
    )


@query(
    "next_category",
    stmt(
        "uts",
        "SELECT user_id, label_next_cat, CAST(next_code AS BIGINT) AS code FROM uts WHERE label_purchase",
    ),
)
def next_category(spark, sf_dir):
    log = log_from_events(spark, sf_dir)
    vocab = ut.vocabulary_names(log, EVENTS)
    users = ut.with_next_category(ut.user_aggregates(log, EVENTS, vocab), log, EVENTS)
    classes = ut.next_category_classes(ut.share_columns(vocab, EVENTS))
    return users.where("label_purchase").select(
        "user_id", "label_next_cat", ut.class_code("label_next_cat", classes).alias("code")
    )


@query(
    "universe_users",
    stmt("agg", "SELECT user_id, n_events FROM agg"),
)
def universe_users(spark, sf_dir):
    log = log_from_events(spark, sf_dir)
    return ut.user_aggregates(log, EVENTS, []).select("user_id", "n_events")


@query(
    "universe_thresholds",
    stmt(
        "evf",
        f"""SELECT CAST(t AS BIGINT) AS threshold, count(*) AS users,
  {r('avg(CAST(bought AS DOUBLE))', 'positive_rate')}
FROM (SELECT user_id, count(*) FILTER (in_feat) AS n, bool_or(in_label AND is_purch) AS bought
  FROM evf GROUP BY user_id), (SELECT unnest([1, 2, 3, 5, 10, 25, 50, 60]) AS t)
WHERE n >= t GROUP BY t""",
    ),
)
def universe_thresholds(spark, sf_dir):
    log = log_from_events(spark, sf_dir)
    return ut.threshold_table(log, EVENTS, [1, 2, 3, 5, 10, 25, 50, 60])


_PROFILED = ("event_type", "product_id", "category_id", "category_code", "brand", "price", "user_session")
_PROFILE_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS name, count(*) AS n_rows, count(*) FILTER ({c} IS NULL) AS nulls,
  count(DISTINCT {c}) AS "distinct", """
    + (
        f"{r(f'min({c})', 'min')}, {r(f'max({c})', 'max')}, {r(f'avg({c})', 'mean')}, "
        f"{r(f'quantile_cont({c}, 0.99)', 'p99')}"
        if c in ("product_id", "category_id", "price")
        else "CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, CAST(NULL AS DOUBLE) AS mean, "
        "CAST(NULL AS DOUBLE) AS p99"
    )
    + " FROM ev"
    for c in _PROFILED
)


@query("event_column_profile", stmt("ev", _PROFILE_SQL))
def event_column_profile(spark, sf_dir):
    return profiles.column_profile(log_from_events(spark, sf_dir), list(_PROFILED))


@query(
    "event_profile_sketches",
    stmt(
        "ev",
        f"""SELECT name, n_rows, nulls, min, max, mean, TRUE AS distinct_near, p99 IS NOT NULL AS p99_near
FROM ({_PROFILE_SQL})""",
    ),
)
def event_profile_sketches(spark, sf_dir):
    """The profile merged from days stored in two runs; its estimates lie within the stated errors of all rows' values."""
    log = log_from_events(spark, sf_dir).withColumn("event_date", F.to_date("ts"))
    path = shared_folder(spark, "sketches")
    sketches.add_days(log.where(F.col("event_date") < F.lit(EVENTS.feature_start.date()) + F.expr("INTERVAL 15 DAYS")), path, _PROFILED)
    sketches.add_days(log, path, _PROFILED)
    merged = materialise(sketches.merged_profile(spark.read.parquet(path)))
    exact = log.agg(*[F.count_distinct(c).alias(c) for c in _PROFILED])
    exact = exact.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in _PROFILED])))
    high = {r["name"]: r["p99"] for r in merged.where("p99 IS NOT NULL").select("name", "p99").collect()}  # a row a column
    shares = log.agg(
        *[F.struct(*[F.count_if(at) / F.count(c) for at in (F.col(c) < v, F.col(c) <= v)]).alias(c) for c, v in high.items()]
    ).first()
    off = 2 * sketches.rank_error()
    near = [c for c in high if shares[c][0] - off <= 0.99 <= shares[c][1] + off]
    distinct_near = F.abs(F.col("distinct") - F.col("n")) <= 3 * sketches.distinct_error() * F.col("n")
    return merged.join(exact, "name").select(
        "name", "n_rows", "nulls", "min", "max", "mean", distinct_near.alias("distinct_near"),
        F.col("name").isin(near).alias("p99_near"),
    )


@query(
    "event_mix",
    stmt(
        "ev",
        f"""SELECT event_type, count(*) AS n, {r('count(*) / sum(count(*)) OVER ()', 'share')}
FROM ev GROUP BY event_type""",
    ),
)
def event_mix(spark, sf_dir):
    return profiles.event_mix(log_from_events(spark, sf_dir))


@query(
    "daily_purchases",
    stmt(
        "ev",
        f"""SELECT day, n, {r('n / (median(n) OVER ())', 'ratio_to_median')} FROM (
  SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM ev WHERE event_type = 'purchase' GROUP BY 1)""",
    ),
)
def daily_purchases(spark, sf_dir):
    return profiles.daily_purchases(log_from_events(spark, sf_dir))


@query(
    "user_split",
    stmt("uts", "SELECT user_id, split FROM uts"),
)
def user_split(spark, sf_dir):
    return split_table(spark, sf_dir).select("user_id", "split")


@query(
    "split_checks",
    stmt(
        "uts",
        """SELECT split, count(*) AS n, CAST(0 AS BIGINT) AS shared, CAST(0 AS BIGINT) AS outside,
  CAST(0 AS BIGINT) AS missing FROM uts GROUP BY split""",
    ),
)
def split_checks(spark, sf_dir):
    table = split_table(spark, sf_dir).select("user_id", "split")
    universe = ut.user_aggregates(log_from_events(spark, sf_dir), EVENTS, [])
    return splits.split_checks(table, universe, "user_id")


@query(
    "split_prevalence",
    stmt(
        "uts",
        f"""SELECT split, count(*) AS n,
  {r('avg(CAST(label_purchase AS DOUBLE))', 'rate_label_purchase')},
  {r('avg(CAST(label_churned AS DOUBLE))', 'rate_label_churned')} FROM uts GROUP BY split""",
    ),
)
def split_prevalence(spark, sf_dir):
    return profiles.split_prevalence(split_table(spark, sf_dir), ["label_purchase", "label_churned"])


@query(
    "label_bundle",
    stmt(
        "uts",
        """SELECT user_id, split, CAST(label_purchase AS BIGINT) AS y_primary,
  CAST(label_churned AS BIGINT) AS y_churned, CAST(next_code AS BIGINT) AS y_next_category,
  next_code IS NOT NULL AS next_category_known FROM uts""",
    ),
)
def label_bundle(spark, sf_dir):
    return split_table(spark, sf_dir).select(
        "user_id",
        "split",
        F.col("label_purchase").cast("bigint").alias("y_primary"),
        F.col("label_churned").cast("bigint").alias("y_churned"),
        F.col("label_next_code").alias("y_next_category"),
        F.col("label_next_code").isNotNull().alias("next_category_known"),
    )


@query(
    "feature_names",
    stmt(
        "evf",
        "SELECT CAST(pos AS BIGINT) AS pos, name FROM (VALUES "
        + ", ".join(f"({i}, '{c}')" for i, c in enumerate(BASE))
        + f") t(pos, name) UNION ALL SELECT {len(BASE)} - 1 + rank, 'cat_share_' || top_cat FROM ({_VOCAB}) "
        + f"UNION ALL SELECT {len(BASE)} + count(*), 'cat_share_unknown' FROM ({_VOCAB})",
    ),
)
def feature_names(spark, sf_dir):
    log = log_from_events(spark, sf_dir)
    vocab = ut.category_vocabulary(log, EVENTS)
    table = ut.build_user_table(log, EVENTS)
    shares = vocab.select((F.lit(len(BASE) - 1) + F.col("rank")).alias("pos"), F.concat(F.lit(ut.SHARE), "top_cat").alias("name"))
    names = F.array(*[F.lit(c) for c in ut.feature_columns(table) if c not in _share_names(table)])
    fixed = vocab.agg(F.max("rank").alias("k")).select("k", F.posexplode(names).alias("pos", "name"))
    tail = F.when(F.col("name") == f"{ut.SHARE}{ut.UNKNOWN}", F.col("k") + len(BASE)).otherwise(F.col("pos"))
    return fixed.select(tail.cast("bigint").alias("pos"), "name").unionByName(shares)


def _share_names(table: DataFrame) -> set[str]:
    return set(constructs.affinity_columns(table.columns))


@query(
    "train_moments",
    stmt("utm", f"SELECT name, {r('mean', 'mean')}, {r('scale', 'scale')} FROM utm"),
)
def train_moments(spark, sf_dir):
    table = split_table(spark, sf_dir).drop("label_next_code")
    return transforms.moments_table(transforms.train_rows(table), features_of(table))


def prepared_users(spark: SparkSession, sf_dir: str | DataFrame, seed: int = SEED) -> transforms.Prepared:
    """Scaled features next to ids, split and labels; from a stored coded table instead of the events, where given."""
    table = stored_split_table(spark, sf_dir, seed)
    names = features_of(table)
    frame, cons = constructs.user_constructs(table)
    both = transforms.fit_scaler(frame, [*names, *cons])
    scaler, cscaler = both.only(names), both.only(cons)
    cols = F.array(*[scaler.column(c) for c in names]).alias("features")
    frame = frame.select(
        F.col("user_id").alias("id"),
        "split",
        cols,
        F.array(*[cscaler.column(c) for c in cons]).alias("constructs"),
        F.col("label_purchase").cast("int").alias("y_primary"),
        F.col("label_churned").cast("int").alias("y_churned"),
        F.col("label_next_code").cast("int").alias("y_next_category"),
    )
    return transforms.Prepared(frame, names, scaler, {"constructs": cons, "construct_scaler": cscaler})


@query(
    "scaled_features",
    stmt("utz", f"SELECT user_id, split, name, {r('z', 'z')} FROM utz"),
)
def scaled_features(spark, sf_dir):
    table = stored_split_table(spark, sf_dir)
    names = features_of(table)
    scaled = transforms.fit_scaler(table, names).apply(table, names)
    return to_long(scaled, ["user_id", "split"], names, "name", "z")


@query(
    "feature_matrix",
    stmt(
        "evf utz",
        f"""SELECT user_id AS id, split, CAST(pos AS BIGINT) AS pos, {r('z', 'z')} FROM utz JOIN (
  SELECT pos, name FROM (VALUES """
        + ", ".join(f"({i}, '{c}')" for i, c in enumerate(BASE))
        + f""") t(pos, name)
  UNION ALL SELECT {len(BASE)} - 1 + rank, 'cat_share_' || top_cat FROM ({_VOCAB})
  UNION ALL SELECT {len(BASE)} + count(*), 'cat_share_unknown' FROM ({_VOCAB})) p ON utz.name = p.name""",
    ),
)
def feature_matrix(spark, sf_dir):
    frame = prepared_users(spark, sf_dir).frame
    long = vector_to_long(frame, ["id", "split"], "features", "pos", "z")
    return long.withColumn("pos", F.col("pos").cast("bigint"))


@query(
    "raw_representation",
    stmt(
        "utz",
        f"SELECT user_id AS id, split, {r('sum(z)', 'total')}, {r('sum(z * z)', 'sq')} FROM utz GROUP BY 1, 2",
    ),
)
def raw_representation(spark, sf_dir):
    frame = prepared_users(spark, sf_dir).frame
    zero = F.lit(0.0)
    return frame.select(
        "id",
        "split",
        F.aggregate("features", zero, lambda a, x: a + x).alias("total"),
        F.aggregate("features", zero, lambda a, x: a + x * x).alias("sq"),
    )


@query(
    "rfm_representation",
    stmt(
        "ucz",
        "SELECT user_id AS id, split, "
        + ", ".join(r(f"max(z) FILTER (name = '{c}')", c) for c in CONSTRUCTS[:3])
        + " FROM ucz GROUP BY user_id, split",
    ),
)
def rfm_representation(spark, sf_dir):
    frame = prepared_users(spark, sf_dir).frame
    return frame.select(
        "id", "split", *[F.col("constructs")[i].alias(c) for i, c in enumerate(constructs.RFM)]
    )


@query(
    "user_constructs",
    stmt("ucz", f"SELECT user_id, split, name, {r('value', 'raw')}, {r('z', 'z')} FROM ucz"),
)
def user_constructs(spark, sf_dir):
    frame, names = constructs.user_constructs(stored_split_table(spark, sf_dir))
    frame, _ = constructs.standardised(frame, names)
    cells = F.array(
        *[F.struct(F.lit(n).alias("name"), F.col(n).alias("raw"), F.col(f"c_{n}").alias("z")) for n in names]
    )
    return frame.select("user_id", "split", F.inline(cells))


@query(
    "affinity_columns",
    stmt("evf", f"SELECT 'cat_share_' || top_cat AS name FROM ({_VOCAB}) WHERE rank <= 5"),
)
def affinity_columns(spark, sf_dir):
    log = log_from_events(spark, sf_dir)
    table = ut.build_user_table(log, CAPPED)
    names = F.array(*[F.lit(c) for c in constructs.affinity_columns(table.columns)])
    return ut.category_vocabulary(log, CAPPED).agg(F.count("*")).select(F.explode(names).alias("name"))


def _sample_sql(seed: int, cap: int, where: str) -> str:
    return stmt(
        "uts",
        f"""SELECT user_id, split FROM (SELECT user_id, split,
  row_number() OVER (ORDER BY md5('{seed}:' || user_id), user_id) AS rn FROM uts WHERE {where})
WHERE rn <= {cap}""",
    )


@query("train_subsample", _sample_sql(3, 40, "split = 'train'"))
def train_subsample(spark, sf_dir):
    train = transforms.train_rows(split_table(spark, sf_dir)).select("user_id", "split")
    return keyed_sample(train, "user_id", 3, 40)


@query("stability_sample", _sample_sql(20260710, 100, "true"))
def stability_sample(spark, sf_dir):
    return keyed_sample(split_table(spark, sf_dir).select("user_id", "split"), "user_id", 20260710, 100)


@query(
    "inverse_standardise",
    stmt(
        "utz",
        f"SELECT user_id, name, {r('value', 'raw')} FROM utz WHERE split = 'test'",
    ),
)
def inverse_standardise(spark, sf_dir):
    table = stored_split_table(spark, sf_dir)
    names = features_of(table)
    scaler = transforms.fit_scaler(table, names)
    test = scaler.apply(table.where(F.col("split") == "test"), names)
    long = to_long(test, ["user_id"], names, "name", "z")
    return transforms.inverse_standardise(long, scaler, "name", "z").drop("z")


