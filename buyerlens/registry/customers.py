"""Queries over the customer-table shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buyerlens.config import NUMERIC_COLUMNS, SPEND_COLUMNS
from buyerlens.functions.frames import to_long
from buyerlens.operators import constructs, customers, profiles, splits, transforms
from buyerlens.registry.base import CUSTOMERS, SEED, query
from buyerlens.registry.sqlparts import r, stmt
from buyerlens.session import materialise, shared_folder
from buyerlens.sources.customers import customers_from_orders, read_delimited


def engineered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers.engineer(customers_from_orders(spark, sf_dir), CUSTOMERS)


def split_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Engineered customers, written once, with their stratified split."""
    table = materialise(engineered(spark, sf_dir))
    return splits.stratified_split(
        table, "ID", "Response", SEED, CUSTOMERS.test_size, CUSTOMERS.val_size
    )


def stored_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, written once for the several passes of a fit and its use."""
    return materialise(split_customers(spark, sf_dir))


_DOUBLES = ("Income", *SPEND_COLUMNS)
_ENG = ", ".join(
    r(c, c) if c in _DOUBLES else f"CAST({c} AS BIGINT) AS {c}" for c in ("ID", "Response", *NUMERIC_COLUMNS)
)


@query("customer_engineered", stmt("eng", f"SELECT {_ENG}, Education, Marital_Status FROM eng"))
def customer_engineered(spark, sf_dir):
    return engineered(spark, sf_dir)


@query("customer_file_scan", stmt("eng", f"SELECT {_ENG}, Education, Marital_Status FROM eng"))
def customer_file_scan(spark, sf_dir):
    """Customers written as a tab-separated file with a header, read with the given schema, and cleaned."""
    path = shared_folder(spark, "tsv")
    rows = customers_from_orders(spark, sf_dir)
    rows.write.option("header", True).csv(path, sep="\t")
    return customers.engineer(read_delimited(spark, path, schema=rows.schema), CUSTOMERS)


@query("stratified_split", stmt("engs", "SELECT ID, CAST(Response AS BIGINT) AS Response, split FROM engs"))
def stratified_split(spark, sf_dir):
    return split_customers(spark, sf_dir).select("ID", "Response", "split")


@query("train_medians", stmt("med", f"SELECT name, {r('median', 'median')} FROM med"))
def train_medians(spark, sf_dir):
    train = transforms.train_rows(stored_customers(spark, sf_dir))
    return transforms.quantile_table(train, list(NUMERIC_COLUMNS), [0.5]).select(
        "name", F.col("q").alias("median")
    )


@query("winsor_bounds", stmt("bounds", f"SELECT name, {r('lo', 'lo')}, {r('hi', 'hi')} FROM bounds"))
def winsor_bounds(spark, sf_dir):
    table = stored_customers(spark, sf_dir)
    medians = transforms.fit_quantiles(transforms.train_rows(table), list(CUSTOMERS.winsorised), [0.5])
    filled = table.withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.lit(m[0])) for c, m in medians.items()}
    )
    bounds = transforms.quantile_table(
        transforms.train_rows(filled), list(CUSTOMERS.winsorised), [CUSTOMERS.winsor_low, CUSTOMERS.winsor_high]
    )
    return bounds.groupBy("name").agg(F.min("q").alias("lo"), F.max("q").alias("hi"))


@query(
    "customer_prepared",
    stmt("engz", f"SELECT ID, split, name, {r('value', 'value')} FROM engz"),
)
def customer_prepared(spark, sf_dir):
    wide, names, _, _ = transforms.prepare_customers(stored_customers(spark, sf_dir), CUSTOMERS)
    return to_long(wide, ["ID", "split"], names)


@query("customer_one_hot", stmt("hot", f"SELECT ID, split, name, {r('value', 'value')} FROM hot"))
def customer_one_hot(spark, sf_dir):
    table = stored_customers(spark, sf_dir)
    hot = transforms.one_hot_columns(transforms.fit_levels(table, list(CUSTOMERS.categorical)))
    return to_long(table.withColumns(hot), ["ID", "split"], list(hot))


@query(
    "customer_constructs",
    stmt(
        "ccl",
        f"""SELECT ID, c.name, {r('value', 'raw')}, {r('(value - mean) / scale', 'z')} FROM ccl c JOIN (
  SELECT name, avg(value) AS mean,
    CASE WHEN stddev_pop(value) = 0 THEN 1.0 ELSE stddev_pop(value) END AS scale
  FROM ccl WHERE split = 'train' GROUP BY name) m ON c.name = m.name""",
    ),
)
def customer_constructs(spark, sf_dir):
    frame, names = constructs.customer_constructs(stored_customers(spark, sf_dir), CUSTOMERS)
    frame, _ = constructs.standardised(frame, names)
    cells = F.array(
        *[F.struct(F.lit(n).alias("name"), F.col(n).alias("raw"), F.col(f"c_{n}").alias("z")) for n in names]
    )
    return frame.select("ID", F.inline(cells))


@query(
    "customer_split_prevalence",
    stmt(
        "engs",
        f"SELECT split, count(*) AS n, {r('avg(CAST(Response AS DOUBLE))', 'rate_Response')} FROM engs GROUP BY split",
    ),
)
def customer_split_prevalence(spark, sf_dir):
    return profiles.split_prevalence(split_customers(spark, sf_dir), ["Response"])


_PROFILED = ("Income", "Age", "Recency", "MntWines", "NumDealsPurchases", "Education", "Marital_Status")
_PROFILE_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS name, count(*) AS n_rows, count(*) FILTER ({c} IS NULL) AS nulls,
  count(DISTINCT {c}) AS "distinct", """
    + (
        f"{r(f'min({c})', 'min')}, {r(f'max({c})', 'max')}, {r(f'avg({c})', 'mean')}, "
        f"{r(f'quantile_cont({c}, 0.99)', 'p99')}"
        if c not in ("Education", "Marital_Status")
        else "CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, CAST(NULL AS DOUBLE) AS mean, "
        "CAST(NULL AS DOUBLE) AS p99"
    )
    + " FROM eng"
    for c in _PROFILED
)


@query("customer_column_profile", stmt("eng", _PROFILE_SQL))
def customer_column_profile(spark, sf_dir):
    return profiles.column_profile(engineered(spark, sf_dir), list(_PROFILED))
