"""The event-log shape: CSV files, its typed Parquet copy, and the adapter onto ``events``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = (
    "event_time string, event_type string, product_id bigint, category_id bigint, "
    "category_code string, brand string, price double, user_id bigint, user_session string"
)
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def parse_event_time(text: str | Column) -> Column:
    """Wall time of the first 19 characters of an event time."""
    text = F.col(text) if isinstance(text, str) else text
    return F.to_timestamp_ntz(F.substring(text, 1, 19), F.lit(TIME_FORMAT))


def top_category(code: str | Column) -> Column:
    """First level of a dotted category code."""
    return F.substring_index(F.col(code) if isinstance(code, str) else code, ".", 1)


def with_derived(log: DataFrame) -> DataFrame:
    """Add ``top_cat``; ``ts`` is expected as TIMESTAMP_NTZ."""
    return log.withColumn("top_cat", top_category("category_code"))


def read_csv_log(spark: SparkSession, files: list[str]) -> DataFrame:
    """Scan several CSV files as one typed log; the schema is given, never inferred."""
    raw = spark.read.schema(EVENT_SCHEMA).option("header", True).csv(files)
    return with_derived(raw.withColumn("ts", parse_event_time("event_time")))


def write_log(log: DataFrame, path: str) -> str:
    """Typed copy partitioned by day, so that later window filters skip whole folders.

    Rebalancing splits a day, or a user, that holds much of the log and merges small ones.
    """
    dated = log.withColumn("event_date", F.to_date("ts"))
    (
        dated.hint("rebalance", F.col("event_date"))
        .write.mode("overwrite")
        .partitionBy("event_date")
        .parquet(path)
    )
    return path


def log_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given ``events`` table in the event-log shape.

    Times keep their microseconds here so that window filters reach the Parquet scan.
    """
    k = F.get_json_object("props", "$.k").cast("bigint")
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    log = raw.select(
        "event_id",
        "ts",
        F.when(F.col("event_type") == "click", "cart").otherwise(F.col("event_type")).alias("event_type"),
        k.alias("product_id"),
        (k % 20).alias("category_id"),
        F.col("value").alias("price"),
        "user_id",
        F.when(
            F.col("event_id") % 97 != 0,
            F.concat_ws("-", F.col("user_id").cast("string"), F.to_date("ts").cast("string")),
        ).alias("user_session"),
    )
    code = F.concat(
        F.lit("top"),
        (F.col("category_id") % 7).cast("string"),
        F.lit(".sub"),
        F.col("category_id").cast("string"),
    )
    coded = (F.col("event_id") % 3 != 0) & (F.col("category_id") != 19)
    brand = F.concat(F.lit("brand"), (F.col("product_id") % 11).cast("string"))
    return with_derived(
        log.withColumns(
            {
                "category_code": F.when(coded, code),
                "brand": F.when(F.col("event_id") % 5 != 0, brand),
            }
        )
    )
