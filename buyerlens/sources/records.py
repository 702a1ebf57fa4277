"""Run records: JSON scan, sinks, resumable grid and manifest."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buyerlens.session import materialise

METRICS = "map<string, map<string, map<string, double>>>"
SWEEP_SCHEMA = (
    "dataset string, seed int, beta double, lambda_align double, aligned_dims int, "
    "loss_final map<string, double>, loss_history array<map<string, double>>, "
    f"downstream {METRICS}, downstream_val {METRICS}, "
    "interpretability struct<mig: double, sap: double, mig_per_factor: map<string, double>, "
    "sap_per_factor: map<string, double>, "
    "axis_alignment: map<string, struct<best_dim: int, best_r2: double>>>, "
    "alignment struct<r2_per_construct: map<string, double>, r2_mean: double, r2_rfm_mean: double>, "
    "wall_time_s double"
)


def write_records(records: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    """Append records as JSON lines; a task's files appear only when the job commits."""
    writer = records.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.json(path)
    return path


def read_sweep_records(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Sweep records under ``path``; corrupt files are named in the error, none is skipped."""
    try:
        raw = (
            spark.read.schema(f"{SWEEP_SCHEMA}, _corrupt string")
            .option("mode", "PERMISSIVE")
            .option("multiLine", multi_line)
            .option("columnNameOfCorruptRecord", "_corrupt")
            .option("pathGlobFilter", "*.json")
            .option("recursiveFileLookup", True)
            .json(path)
        )
    except AnalysisException as err:
        if err.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no records in {path}; run the sweep first") from err
        raise
    marked = materialise(raw.withColumn("_file", F.input_file_name()))  # parsed once
    broken = marked.where(F.col("_corrupt").isNotNull()).select("_file").distinct().collect()  # every file
    if broken:
        names = ", ".join(sorted(r["_file"] for r in broken))
        raise ValueError(f"corrupt records, delete and run again: {names}")
    if marked.isEmpty():
        raise FileNotFoundError(f"no records in {path}; run the sweep first")
    return marked.drop("_corrupt", "_file")


def grid(
    spark: SparkSession, seeds: Sequence[int], betas: Sequence[float], lambdas: Sequence[float]
) -> DataFrame:
    """Every (seed, beta, lambda) of the configured grid."""
    rows = [(int(s), float(b), float(v)) for s, b, v in product(seeds, betas, lambdas)]
    return spark.createDataFrame(rows, "seed int, beta double, lambda_align double")


def remaining(points: DataFrame, done: DataFrame) -> DataFrame:
    """Grid points without a finished run."""
    keys = ["seed", "beta", "lambda_align"]
    return points.join(done.select(*keys).distinct(), keys, "left_anti")


def run_tag():
    """Name of a run, as in ``s0_b0.5_l1``."""

    def short(c: str):
        return F.regexp_replace(F.col(c).cast("string"), r"\.0$", "")

    return F.concat(
        F.lit("s"), F.col("seed").cast("string"), F.lit("_b"), short("beta"), F.lit("_l"), short("lambda_align")
    )


def manifest(runs: DataFrame) -> DataFrame:
    """Grid axes, run count and sorted run names; as long as the configured grid."""

    def axis(c: str):
        return F.array_join(F.array_sort(F.collect_set(c)), ",")

    return runs.select("seed", "beta", "lambda_align").distinct().withColumn("run", run_tag()).agg(
        axis("seed").alias("seeds"),
        axis("beta").alias("betas"),
        axis("lambda_align").alias("lambdas"),
        F.count("*").alias("n_runs"),
        axis("run").alias("runs"),
    )
