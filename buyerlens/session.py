"""Session settings for tests and benches; clusters bring their own."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the bench."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("buyerlens")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a fresh local one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="buyerlens-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A fresh path in the shared folder."""
    return f"{checkpoint_dir(spark)}/buyerlens-{kind}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and read it back.

    What follows starts from files that outlive executors, reads only the columns it needs, and
    is planned without the history of ``df``.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/buyerlens-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def at_once(work: Callable, items: Iterable, threads: int = 4) -> list:
    """``work`` of every item, results in order; the Spark jobs of ``threads`` items share the cluster."""
    own = inheritable_thread_target(SparkSession.active())(work)
    with ThreadPoolExecutor(threads) as pool:
        return list(pool.map(own, items))
