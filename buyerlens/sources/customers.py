"""The customer-table shape: delimited file, and the adapter onto the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from buyerlens.config import CAMPAIGN_COLUMNS, SPEND_COLUMNS

CUSTOMER_SCHEMA = (
    "ID bigint, Year_Birth bigint, Education string, Marital_Status string, Income bigint, "
    "Kidhome bigint, Teenhome bigint, Dt_Customer string, Recency bigint, MntWines bigint, "
    "MntFruits bigint, MntMeatProducts bigint, MntFishProducts bigint, MntSweetProducts bigint, "
    "MntGoldProds bigint, NumDealsPurchases bigint, NumWebPurchases bigint, "
    "NumCatalogPurchases bigint, NumStorePurchases bigint, NumWebVisitsMonth bigint, "
    "AcceptedCmp3 bigint, AcceptedCmp4 bigint, AcceptedCmp5 bigint, AcceptedCmp1 bigint, "
    "AcceptedCmp2 bigint, Complain bigint, Z_CostContact bigint, Z_Revenue bigint, Response bigint"
)

# Fixed values of the adapter: part types and order priorities of the given tables.
PART_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
CHANNELS = {
    "NumWebPurchases": "1-URGENT",
    "NumCatalogPurchases": "2-HIGH",
    "NumStorePurchases": "3-MEDIUM",
    "NumWebVisitsMonth": "4-NOT SPECIFIED",
}
CUT_DAYS = 90
DEAL_DISCOUNT = 0.07
PRICE = "decimal(18,6)"


def read_delimited(
    spark: SparkSession, path: str, separator: str = "\t", schema: str | StructType = CUSTOMER_SCHEMA
) -> DataFrame:
    """Customer file with a header and a given schema, never an inferred one."""
    return spark.read.schema(schema).option("header", True).csv(path, sep=separator)


def customers_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer with an order up to the cut, 90 days before the last order.

    Features read only orders up to the cut, the label only orders after it. Lines are summed
    per order before they meet the customer, so a customer with very many orders costs partial
    sums, not one long group. Prices are added as decimals: a spend is the same in whatever order its
    lines come, so that equal spends count as one value.
    """

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    orders = table("orders").select(
        "o_orderkey", "o_custkey", "o_orderpriority", F.to_date("o_orderdate").alias("o_date")
    )
    cut = orders.agg(F.date_sub(F.max("o_date"), CUT_DAYS).alias("cut")).scalar()
    orders = orders.withColumn("cut", cut)
    past = F.col("o_date") <= F.col("cut")

    lines = (
        table("lineitem")
        .select("l_orderkey", "l_partkey", "l_extendedprice", "l_discount", "l_returnflag")
        .join(table("part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("l_orderkey")
        .agg(
            *[
                F.sum(F.when(F.col("p_type") == t, F.col("l_extendedprice").cast(PRICE))).alias(c)
                for t, c in zip(PART_TYPES, SPEND_COLUMNS, strict=True)
            ],
            F.count_if(F.col("l_discount") >= DEAL_DISCOUNT).alias("deals"),
            F.max(((F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.1)).cast("int")).alias(
                "complaint"
            ),
        )
    )
    seen = (
        orders.where(past)
        .join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .groupBy("o_custkey")
        .agg(
            F.min("o_date").alias("first_order"),
            F.datediff(F.max("cut"), F.max("o_date")).cast("bigint").alias("Recency"),
            *[F.coalesce(F.sum(c).cast("double"), F.lit(0.0)).alias(c) for c in SPEND_COLUMNS],
            F.coalesce(F.sum("deals"), F.lit(0)).cast("bigint").alias("NumDealsPurchases"),
            *[F.count_if(F.col("o_orderpriority") == p).alias(c) for c, p in CHANNELS.items()],
            F.coalesce(F.max("complaint"), F.lit(0)).cast("bigint").alias("Complain"),
            *[
                F.max((F.month("o_date") == 2 * i + 1).cast("bigint")).alias(c)
                for i, c in enumerate(CAMPAIGN_COLUMNS)
            ],
        )
    )
    later = orders.where(~past).select("o_custkey").distinct().withColumn("later", F.lit(1))
    place = table("nation").join(
        table("region"), F.col("n_regionkey") == F.col("r_regionkey")
    ).select("n_nationkey", "r_name")
    key = F.col("c_custkey")
    return (
        table("customer")
        .join(seen, F.col("o_custkey") == key)
        .drop("o_custkey")
        .join(later, F.col("o_custkey") == key, "left")
        .join(place, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(
            key.alias("ID"),
            (1940 + key % 60).alias("Year_Birth"),
            F.col("r_name").alias("Education"),
            F.col("c_mktsegment").alias("Marital_Status"),
            F.when(key % 90 != 0, F.col("c_acctbal")).alias("Income"),
            (key % 3).alias("Kidhome"),
            (F.col("c_nationkey") % 2).cast("bigint").alias("Teenhome"),
            F.date_format("first_order", "dd-MM-yyyy").alias("Dt_Customer"),
            "Recency",
            *SPEND_COLUMNS,
            "NumDealsPurchases",
            *CHANNELS,
            *CAMPAIGN_COLUMNS,
            "Complain",
            F.coalesce("later", F.lit(0)).cast("bigint").alias("Response"),
        )
    )
