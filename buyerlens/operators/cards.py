"""What one latent axis changes: decode both ends of it and rank the feature shifts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buyerlens.operators.construct_vae import ConstructVae
from buyerlens.operators.records import top_changes
from buyerlens.operators.transforms import Scaler, inverse_standardise
from buyerlens.plans.partials import map_features


def axis_effects(
    labels: DataFrame,
    model: ConstructVae,
    scaler: Scaler,
    features: list[str],
    span: float = 2.0,
    top: int = 8,
    dims: list[int] | None = None,
) -> DataFrame:
    """``(dim, place, name, delta, raw_delta, construct, best_r2)``: largest changes between the
    decoded ends of each axis.

    ``labels`` names the winning axes, ``(best_dim, factor, best_r2)``. Rows are axes x ends, the
    size of the model. Without aligned axes the axes must be named.
    """
    if dims is None:
        if model.aligned == 0:
            raise ValueError("the model has no aligned axes; name the axes to traverse")
        dims = list(range(model.aligned))
    latent = len(model.mean[1])
    spark = labels.sparkSession
    ends = spark.range(len(dims)).select(
        F.element_at(F.array(*[F.lit(d) for d in dims]), (F.col("id") + 1).cast("int")).alias("dim"),
        F.explode(F.array(F.lit(-span), F.lit(span))).alias("end"),
    )
    codes = ends.withColumn(
        "z",
        F.transform(
            F.sequence(F.lit(0), F.lit(latent - 1)),
            lambda i: F.when(i == F.col("dim"), F.col("end")).otherwise(0.0),
        ),
    )
    decoded = map_features(codes, ["dim", "end"], lambda z: np.asarray(model.decode(z)), "xhat", "z")
    names = F.array(*[F.lit(f) for f in features])
    long = decoded.select("dim", "end", F.posexplode("xhat").alias("pos", "x")).withColumn(
        "name", F.get(names, F.col("pos"))
    )
    raw = inverse_standardise(long, scaler, "name", "x")

    def gap(c: str):
        return F.sum(F.when(F.col("end") > 0, F.col(c)).otherwise(-F.col(c)))

    changes = raw.groupBy("dim", "name").agg(gap("x").alias("delta"), gap("raw").alias("raw_delta"))
    named = labels.select(
        F.col("best_dim").alias("dim"), F.col("factor").alias("construct"), "best_r2"
    )
    return top_changes(changes, "dim", "name", "delta", top).join(named, "dim", "left")
