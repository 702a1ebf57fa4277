"""Downstream heads fitted on frozen representations and scored on held-out splits, many fits side by side."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from buyerlens.config import EvalConfig
from buyerlens.operators import boosting, newton, ranking
from buyerlens.plans.partials import array_column, matrix, partitions_of, vector
from buyerlens.session import materialise

HEADS = ("logreg", "gbt")
MAX_CLASSES = 1_000
KINDS = ("binary", "multiclass")
SCORED_ROWS = 50_000  # training rows of a fit for every task that scores by it


@dataclass(frozen=True)
class Blocks:
    """Cases that stand one after another in one array column of a frame, ``width`` entries each."""

    frame: DataFrame
    column: str
    width: int
    cases: tuple[str, ...]


Cases = dict[str, DataFrame] | Blocks  # representations by name


def rows_where(cases: Cases, condition) -> Cases:
    """The same cases over some of the rows."""
    if isinstance(cases, Blocks):
        return replace(cases, frame=cases.frame.where(condition))
    return {c: f.where(condition) for c, f in cases.items()}


@dataclass(frozen=True)
class Fitted:
    """Both heads of every (case, task), each fitted once; ``classes`` lists a multiclass task's codes in order.

    Boosted models stay in a stored frame ``(fit, n, model)``, since a grid has thousands of trees.
    """

    cases: tuple[str, ...]
    tasks: tuple[str, ...]
    classes: dict[str, list]
    linear: dict[int, newton.Linear]
    boosted: DataFrame | None

    def fit_of(self, case: int, task: int) -> int:
        return case * len(self.tasks) + task


def _coded(label: str, classes: list | None):
    """Binary labels as they are; others by their place in the list, unseen ones after the last."""
    if classes is None:
        return F.col(label).cast("int")
    table = F.array(*[F.lit(c) for c in classes])
    place = F.array_position(table, F.col(label)).cast("int") - 1
    return F.when(F.col(label).isNotNull(), F.when(place >= 0, place).otherwise(F.lit(len(classes))))


def _stacked(frames: Cases, tasks, classes, fitted_of, features: str, keep: Sequence[str]) -> DataFrame:
    """``(fit, keep…, features, y)``: every case's rows once per task whose label they have."""
    if isinstance(frames, Blocks):
        return _stacked_blocks(frames, tasks, classes, keep)
    out = None
    for i, frame in enumerate(frames.values()):
        cells = [
            F.struct(F.lit(fitted_of(i, j)).alias("fit"), _coded(label, classes.get(task)).alias("y"))
            for j, (task, (label, _)) in enumerate(tasks.items())
        ]
        key = F.xxhash64("id") if "id" in frame.columns else F.xxhash64(features)
        rows = frame.select(key.alias("_key"), *keep, F.col(features).cast("array<double>").alias("features"), F.explode(F.array(*cells)).alias("_c"))
        rows = rows.select("_c.fit", "_key", *keep, "features", "_c.y").where("y IS NOT NULL")
        out = rows if out is None else out.unionByName(rows)
    return out


def _stacked_blocks(blocks: Blocks, tasks, classes, keep: Sequence[str]) -> DataFrame:
    """As ``_stacked`` from one scan, whose plan does not grow with the cases; rows are dealt first, since each becomes many."""
    n, frame = len(tasks), blocks.frame
    spread = max(partitions_of(frame), frame.sparkSession.sparkContext.defaultParallelism)
    labels = F.array(*[_coded(label, classes.get(task)) for task, (label, _) in tasks.items()])
    wide = frame.repartition(spread, "id").select(F.xxhash64("id").alias("_key"), *keep, blocks.column, labels.alias("_y"))
    each = wide.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(blocks.cases) * n - 1))).alias("fit"))
    start = (F.floor(F.col("fit") / n) * blocks.width + 1).cast("int")
    code = F.slice(blocks.column, start, F.lit(blocks.width)).cast("array<double>").alias("features")
    return each.select("fit", "_key", *keep, code, F.get("_y", F.col("fit") % n).alias("y")).where("y IS NOT NULL")


def fit_heads(
    trains: Cases, tasks: dict[str, tuple[str, str]], cfg: EvalConfig, seed: int, features: str = "features"
) -> Fitted:
    """All cases' and tasks' heads from the training rows: one Newton iteration and one stack of boosted fits."""
    classes = {}
    names = trains.cases if isinstance(trains, Blocks) else tuple(trains)
    first = trains.frame if isinstance(trains, Blocks) else trains[names[0]]
    for task, (label, kind) in tasks.items():
        if kind not in KINDS:
            raise ValueError(f"unknown task type {kind!r}")
        if kind == "multiclass":
            known = first.where(F.col(label).isNotNull()).select(label).distinct()
            found = known.limit(MAX_CLASSES + 1).collect()
            if len(found) > MAX_CLASSES:
                raise ValueError(f"more than {MAX_CLASSES} classes of {task}")
            classes[task] = sorted(r[0] for r in found)
    bare = Fitted(names, tuple(tasks), classes, {}, None)
    rows = materialise(_stacked(trains, tasks, classes, bare.fit_of, features, []))
    trees = {
        bare.fit_of(i, j): len(classes[task]) if task in classes else 1 for i in range(len(names)) for j, task in enumerate(tasks)
    }
    settings = boosting.Settings(rounds=cfg.gbt_iterations)
    linear = newton.fit_logistic(rows, trees)
    return Fitted(bare.cases, bare.tasks, classes, linear, boosting.fit_stored(rows, trees, settings, seed))


def head_scores(
    held: Cases, fitted: Fitted, tasks: dict[str, tuple[str, str]], features: str = "features", keep: Sequence[str] = ("split",)
) -> DataFrame:
    """``(case, task, head, keep…, y, proba)`` of all rows with the label; a binary ``proba`` is the chance of class 1.

    Rows meet their fit's model in a task of their own, or several by key where the fit had many rows; the model is
    sent there by the same shuffle, so the driver holds weights only.
    """
    rows = _stacked(held, tasks, fitted.classes, fitted.fit_of, features, keep)
    spark = rows.sparkSession
    linear = spark.sparkContext.broadcast(fitted.linear)  # weights, whose number is set
    sizes = {r["fit"]: r["n"] for r in fitted.boosted.select("fit", "n").collect()}  # a row a fit
    tasks_of = [-(-sizes[f] // SCORED_ROWS) for f in range(len(sizes))]
    first = [sum(tasks_of[:f]) for f in range(len(sizes))]
    at, many = (F.get(F.array(*[F.lit(v) for v in values]), F.col("fit")) for values in (first, tasks_of))
    rows = rows.withColumn("_task", (at + F.pmod("_key", many)).cast("int")).drop("_key")
    models = fitted.boosted.select("fit", "model", F.explode(F.sequence(at, at + many - 1)).alias("_task"))
    met = rows.unionByName(models, allowMissingColumns=True).repartitionById(sum(tasks_of), "_task")
    met = met.sortWithinPartitions("_task", F.col("model").isNull())

    def score(batches):
        trees: dict[int, boosting.Boosted] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            fits, sent = vector(batch, "fit"), batch.column(batch.schema.get_field_index("model"))
            given = sent.is_valid().to_numpy(zero_copy_only=False)
            trees |= {int(fits[i]): boosting.Boosted.unpacked(sent[int(i)].as_py()) for i in np.flatnonzero(given)}
            for f in np.unique(fits[~given]):
                mine = batch.filter(pa.array((fits == f) & ~given))
                x = matrix(mine, "features")
                for head, model in zip(HEADS, (linear.value[int(f)], trees[int(f)]), strict=True):
                    p = model.chances(x)
                    kept = [mine.column(mine.schema.get_field_index(c)) for c in ("fit", *keep, "y")]
                    yield pa.RecordBatch.from_arrays(
                        [*kept, pa.array([head] * len(x)), array_column(p.reshape(len(x), -1))], ["fit", *keep, "y", "head", "proba"]
                    )

    schema = rows.select("fit", *keep, "y").schema.add("head", "string").add("proba", T.ArrayType(T.DoubleType()))
    scored = met.select("fit", *keep, "features", "y", "model").mapInArrow(score, schema)
    n = len(fitted.tasks)
    names = {c: F.array(*[F.lit(v) for v in values]) for c, values in (("case", fitted.cases), ("task", fitted.tasks))}
    return scored.select(
        F.get(names["case"], F.floor(F.col("fit") / n).cast("int")).alias("case"),
        F.get(names["task"], F.col("fit") % n).alias("task"),
        "head", *keep, "y", "proba",
    )


def case_metrics(
    frames: Cases,
    features: str,
    tasks: dict[str, tuple[str, str]],
    cfg: EvalConfig,
    seed: int,
    trains: Cases | None = None,
) -> DataFrame:
    """``(case, split, task, head, metric, value)`` of every task on every frozen representation.

    ``tasks`` maps names to (label column, "binary" or "multiclass"); rows without the label sit
    out. Heads are fitted on the training rows once and measured on validation and test.
    """
    trains = trains or rows_where(frames, "split = 'train'")
    fitted = fit_heads(trains, tasks, cfg, seed, features)
    held = rows_where(frames, "split <> 'train'")
    scored = materialise(head_scores(held, fitted, tasks, features))
    by, out = ["case", "split", "task", "head"], None
    for kind in KINDS:
        named = [t for t, (_, k) in tasks.items() if k == kind]
        if not named:
            continue
        rows = scored.where(F.col("task").isin(named))
        if kind == "binary":
            found = ranking.binary_metrics(rows.withColumn("score", F.get("proba", F.lit(0))), by=by, k_frac=cfg.k_frac)
        else:
            found = ranking.multiclass_metrics(rows, by=by, top_ks=cfg.top_ks)
        part = long_metrics(found, by)
        out = part if out is None else out.unionByName(part)
    return out.select(*by, "metric", "value")


def binary_scores(
    train: DataFrame, held: DataFrame, features: str, label: str, cfg: EvalConfig, seed: int
) -> dict[str, DataFrame]:
    """Each head, fitted once, with ``(split, y, score)`` of all held-out rows."""
    tasks = {"task": (label, "binary")}
    fitted = fit_heads({"case": train}, tasks, cfg, seed, features)
    scored = head_scores({"case": held}, fitted, tasks, features)
    return {h: scored.where(F.col("head") == h).select("split", "y", F.get("proba", F.lit(0)).alias("score")) for h in HEADS}


def head_metrics(
    frame: DataFrame, features: str, tasks: dict[str, tuple[str, str]], cfg: EvalConfig, seed: int, train: DataFrame | None = None
) -> DataFrame:
    """As ``case_metrics``, of one representation."""
    trains = None if train is None else {"case": train}
    return case_metrics({"case": frame}, features, tasks, cfg, seed, trains).drop("case")


def long_metrics(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    names = [c for c in found.columns if c not in keys]
    cells = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names]
    return found.select(*keys, F.inline(F.array(*cells)))
