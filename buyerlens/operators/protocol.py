"""Representations by name, the baseline campaign, one sweep run, the sweep, and its analysis."""

from __future__ import annotations

import time
import warnings
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buyerlens.config import EvalConfig, ModelConfig, SweepConfig
from buyerlens.operators import clusters, construct_vae, heads, interpretability, pca
from buyerlens.operators import records as rec
from buyerlens.operators import selection, significance
from buyerlens.operators.autoencoder import embedded_assign, encode, fit_autoencoder, fit_embedded_clusters
from buyerlens.operators.clustering_quality import clustering_metrics
from buyerlens.plans.ordered import keyed_sample
from buyerlens.plans.partials import map_features, matrix, partitions_of, sum_partials
from buyerlens.session import at_once, materialise
from buyerlens.sources import records as sources

Tasks = dict[str, tuple[str, str]]


@dataclass
class Bench:
    """Prepared data of one seed: ``(id, split, features, constructs, y_…)``, stored once.

    ``constructs`` names the construct columns; their first three are recency, frequency and
    monetary value.
    """

    frame: DataFrame
    constructs: list[str]
    tasks: Tasks
    cfg: EvalConfig
    model: ModelConfig
    seed: int

    def __post_init__(self) -> None:
        self._made: dict[str, object] = {}
        train = self.frame.where("split = 'train'")
        if self.cfg.train_subsample is not None:
            train = materialise(keyed_sample(train, "id", self.seed, self.cfg.train_subsample))
        self.train = train

    def once(self, name: str, build: Callable[[], object]):
        """A fitted part shared by several methods."""
        if name not in self._made:
            self._made[name] = build()
        return self._made[name]

    @property
    def keep(self) -> list[str]:
        return ["id", "split", *[label for label, _ in self.tasks.values()]]

    def train_part(self, frame: DataFrame) -> DataFrame:
        """Training rows of a representation, after the subsample where there is one."""
        rows = frame.where("split = 'train'")
        if self.cfg.train_subsample is None:
            return rows
        return rows.join(self.train.select("id"), "id", "left_semi")

    def autoencoder(self):
        return self.once("ae", lambda: fit_autoencoder(self.train, self.model, self.seed))

    def codes(self) -> DataFrame:
        return self.once(
            "codes", lambda: materialise(encode(self.frame, self.autoencoder(), self.keep, "r"))
        )

    def train_codes(self) -> DataFrame:
        return encode(self.train, self.autoencoder(), ["id"], "r")


@dataclass(frozen=True)
class Represented:
    """A representation ``(id, split, y_…, r)``; with clusters also ``(id, split, cluster, space)``."""

    frame: DataFrame
    clustering: DataFrame | None = None


def _raw(b: Bench) -> Represented:
    return Represented(b.frame.select(*b.keep, F.col("features").alias("r")))


def _pca(b: Bench) -> Represented:
    return Represented(pca.project(b.frame, pca.fit_pca(b.train, b.model.latent_dim), b.keep, "r"))


def _rfm_frame(df: DataFrame, keep: list[str]) -> DataFrame:
    return df.select(*keep, F.slice("constructs", 1, 3).alias("r"))


def _rfm(b: Bench) -> Represented:
    return Represented(_rfm_frame(b.frame, b.keep))


def _one_hot(b: Bench, space: DataFrame, train: DataFrame) -> Represented:
    k = b.cfg.n_clusters
    centers = clusters.fit_kmeans(train, k, b.seed, b.cfg.n_init, "r")
    labelled = clusters.hard_assign(space, centers, [*b.keep, "r"], features="r")
    return Represented(
        labelled.select(*b.keep, clusters.one_hot("cluster", k).alias("r")),
        labelled.select("id", "split", "cluster", F.col("r").alias("space")),
    )


def _rfm_kmeans(b: Bench) -> Represented:
    return _one_hot(b, _rfm_frame(b.frame, b.keep), _rfm_frame(b.train, ["id"]))


def _ae(b: Bench) -> Represented:
    return Represented(b.codes())


def _ae_kmeans(b: Bench) -> Represented:
    return _one_hot(b, b.codes(), b.train_codes())


def _top(column: str):
    return (F.array_position(F.col(column), F.array_max(column)) - 1).cast("int")


def _gmm_ae(b: Bench) -> Represented:
    model = clusters.fit_mixture(b.train_codes(), b.cfg.n_clusters, b.seed, features="r")
    found = clusters.mixture_posteriors(b.codes(), model, [*b.keep, "r"], "posterior", "r")
    return Represented(
        found.select(*b.keep, F.col("posterior").alias("r")),
        found.select("id", "split", _top("posterior").alias("cluster"), F.col("r").alias("space")),
    )


def _dec(b: Bench) -> Represented:
    model = b.once(
        "dec",
        lambda: fit_embedded_clusters(
            b.train, b.autoencoder(), b.cfg.n_clusters, b.model, b.seed, b.cfg.n_init
        ),
    )
    found = embedded_assign(b.frame, model, b.keep, "r")
    space = b.codes().select("id", F.col("r").alias("space"))
    labelled = found.select("id", "split", _top("r").alias("cluster")).join(space, "id")
    return Represented(found, labelled)


METHODS: dict[str, Callable[[Bench], Represented]] = {
    "raw": _raw,
    "pca": _pca,
    "rfm": _rfm,
    "rfm_kmeans": _rfm_kmeans,
    "ae": _ae,
    "ae_kmeans": _ae_kmeans,
    "gmm_ae": _gmm_ae,
    "dec": _dec,
}


def chosen_methods(cfg: EvalConfig) -> list[str]:
    """Requested methods in protocol order; an unknown name is an error."""
    wanted = set(cfg.methods or METHODS)
    unknown = sorted(wanted - set(METHODS))
    if unknown:
        raise ValueError(f"unknown methods: {unknown}")
    return [m for m in METHODS if m in wanted]


def evaluate_baselines(bench: Bench) -> DataFrame:
    """Test records ``(task, method, head, seed, metric, value)`` of the requested methods.

    Each representation is learned once from training rows and stored; only heads see labels.
    Clustering scores of the test rows go with the primary task.
    """
    made = {m: METHODS[m](bench) for m in chosen_methods(bench.cfg)}
    frames = {m: materialise(rep.frame) for m, rep in made.items()}
    trains = {m: bench.train_part(f) for m, f in frames.items()}
    scored = heads.case_metrics(frames, "r", bench.tasks, bench.cfg, bench.seed, trains)
    out = scored.where("split = 'test'").select("task", F.col("case").alias("method"), "head", "metric", "value")
    for method, rep in made.items():
        if rep.clustering is None:
            continue
        test = materialise(rep.clustering.where("split = 'test'"))
        scores = clustering_metrics(test, "cluster", "space")
        named = scores.select(*[F.col(c).alias(f"clu_{c}") for c in scores.columns])
        long = heads.long_metrics(named, [])
        each = F.explode(F.array(*[F.lit(h) for h in heads.HEADS])).alias("head")
        out = out.unionByName(
            long.select(F.lit("primary").alias("task"), F.lit(method).alias("method"), each, "metric", "value")
        )
    return materialise(out.select("task", "method", "head", F.lit(bench.seed).alias("seed"), "metric", "value"))


Point = tuple[float, float]


def run_point(bench: Bench, beta: float, lambda_align: float) -> tuple[dict, construct_vae.ConstructVae]:
    """One (seed, beta, lambda) run: its record, shaped like the sweep schema, and the model."""
    return run_points(bench, [(beta, lambda_align)])[0]


def run_points(bench: Bench, points: list[Point]) -> list[tuple[dict, construct_vae.ConstructVae]]:
    """All runs of one seed side by side: models trained as stacks, users coded once by all of them, heads fitted in
    the same passes, axes compared in one table of bins."""
    began = time.time()
    names, width = bench.constructs, bench.model.latent_dim
    models = construct_vae.fit_grid(bench.train, bench.model, points, bench.seed, len(names))
    fitted = list(models.values())
    coded = materialise(
        map_features(
            bench.frame, [*bench.keep, "constructs"], lambda x: np.concatenate([m.code(x) for m in fitted], axis=1), "z"
        )
    )
    blocks = heads.Blocks(coded, "z", width, tuple(map(str, range(len(fitted)))))
    trains = replace(blocks, frame=bench.train_part(coded))
    scored = heads.case_metrics(blocks, "z", bench.tasks, bench.cfg, bench.seed, trains).collect()
    axes = interpretability.block_summary(coded.where("split = 'test'"), width, v="constructs").collect()
    aligned = alignment_r2(bench.frame.where("split = 'test'"), fitted)

    def tree(case: str, split: str, only: str | None = None) -> dict:
        out: dict = {}
        for r in scored:
            if r["case"] == case and r["split"] == split and only in (None, r["task"]):
                out.setdefault(r["task"], {}).setdefault(r["head"], {})[r["metric"]] = r["value"]
        return out

    def mean(values) -> float | None:
        known = [v for v in values if v is not None]
        return float(np.mean(known)) if known else None

    out = []
    for i, ((beta, lambda_align), model) in enumerate(models.items()):
        per_factor = {names[r["factor"]]: r for r in axes if r["block"] == i}
        record = {
            "dataset": "bench",
            "seed": bench.seed,
            "beta": float(beta),
            "lambda_align": float(lambda_align),
            "aligned_dims": model.aligned,
            "loss_final": model.history[-1],
            "loss_history": list(model.history),
            "downstream": tree(str(i), "test"),
            "downstream_val": tree(str(i), "val", "primary"),
            "interpretability": {
                "mig": mean(r["mig"] for r in per_factor.values()),
                "sap": mean(r["sap"] for r in per_factor.values()),
                "mig_per_factor": {n: r["mig"] for n, r in per_factor.items()},
                "sap_per_factor": {n: r["sap"] for n, r in per_factor.items()},
                "axis_alignment": {
                    n: {"best_dim": r["best_dim"], "best_r2": r["best_r2"]} for n, r in per_factor.items()
                },
            },
            "alignment": None,
        }
        if model.head is not None:
            r2 = dict(zip(names, aligned[i], strict=True))
            record["alignment"] = {
                "r2_per_construct": r2,
                "r2_mean": mean(r2.values()),
                "r2_rfm_mean": mean(r2[n] for n in names[:3]),
            }
        out.append((record, model))
    took = round((time.time() - began) / max(1, len(out)), 1)
    for record, _ in out:
        record["wall_time_s"] = took
    return out


def alignment_r2(test: DataFrame, models: list[construct_vae.ConstructVae]) -> dict[int, list[float | None]]:
    """R² of every model's alignment head per construct on test rows, from one pass of sums; null for a constant."""
    heads_of = [i for i, m in enumerate(models) if m.head is not None]
    if not heads_of:
        return {}
    rows = test.select("features", "constructs")

    def sums(batch):
        x, c = matrix(batch, "features"), matrix(batch, "constructs")
        miss = [((c - models[i].predict_constructs(x)) ** 2).sum(axis=0) for i in heads_of]
        return np.concatenate([[len(c)], c.sum(axis=0), (c * c).sum(axis=0), *miss])

    total = sum_partials(rows, sums, partitions_of(rows))
    k = (len(total) - 1) // (2 + len(heads_of))
    n, first, second = total[0], total[1 : 1 + k], total[1 + k : 1 + 2 * k]
    spread = second - first**2 / n
    out = {}
    for place, i in enumerate(heads_of):
        miss = total[1 + (2 + place) * k : 1 + (3 + place) * k]
        out[i] = [float(1.0 - a / b) if b > 1e-12 * max(1.0, n) else None for a, b in zip(miss, spread, strict=True)]
    return out


def run_sweep(
    bench_of: Callable[[int], Bench],
    grid: SweepConfig,
    path: str,
    keep_model: Callable[[dict, construct_vae.ConstructVae], None] | None = None,
) -> int:
    """Run every grid point without a record under ``path``; returns how many ran.

    A seed is prepared only if it has a run left, and all its points run side by side. Their records are written after
    their models, by one committed job a seed, so a lost driver costs one seed and repeats none that is written.
    """
    spark = SparkSession.getActiveSession()
    todo = sources.grid(spark, grid.seeds, grid.betas, grid.lambdas)
    try:
        todo = sources.remaining(todo, sources.read_sweep_records(spark, path))
    except FileNotFoundError:
        pass
    left: dict[int, list[Point]] = {}
    for r in todo.collect():  # as long as the configured grid
        left.setdefault(r["seed"], []).append((r["beta"], r["lambda_align"]))

    def run(seed: int) -> None:
        runs = run_points(bench_of(seed), sorted(left[seed]))
        if keep_model is not None:
            for record, model in runs:
                keep_model(record, model)
        rows = spark.createDataFrame([record for record, _ in runs], sources.SWEEP_SCHEMA)
        sources.write_records(rows.coalesce(1), f"{path}/seed={seed}")

    at_once(run, sorted(left))
    return sum(map(len, left.values()))


def analyse(
    sweep: DataFrame, baselines: DataFrame, head: str = "gbt", metric: str = "pr_auc", x: str = "r2_mean"
) -> dict[str, DataFrame]:
    """The tables of a finished sweep: grid means, sweet spot chosen on validation, task
    comparison on test, ablations against the bar, and the trade-off lines."""
    flat = materialise(rec.flatten(sweep, head))
    names = [r["metric"] for r in flat.select("metric").distinct().collect()]
    val = f"val_{metric}"
    for needed in (val, metric, x, "mig"):
        if needed not in names:
            names.append(needed)
    points = materialise(rec.points_wide(rec.aggregate_sweep(flat), sorted(names)))
    marked = selection.selection_metric(points, val, metric)
    if marked.where(F.col("selected_on") == val).isEmpty():
        warnings.warn(f"no {val} in the records, selecting on {metric}", stacklevel=2)
    spot = materialise(selection.sweet_spots(marked, f"{x}_mean", "sel_mean", "sel_std"))
    at = flat.join(spot.select(*selection.POINT), list(selection.POINT), "left_semi")
    specs = [
        ("primary", metric, metric),
        ("churned", "pr_auc", "churned_pr_auc"),
        ("next_category", "acc_at_1", "next_category_acc_at_1"),
        ("next_category", "macro_ovr_auc", "next_category_macro_ovr_auc"),
    ]
    bar = rec.best_baselines(baselines, metric, head).where("task = 'primary'")
    return {
        "grid": points,
        "sweet_spot": spot,
        "comparison": significance.task_comparison(at.select("seed", "metric", "value"), baselines, specs, head),
        "ablations": selection.ablation_table(selection.ablation_points(marked, spot, "sel_mean"), bar, metric),
        "tradeoff_mig": selection.tradeoff_series(points, "mig", metric),
        "tradeoff_r2": selection.tradeoff_series(points, x, metric),
    }
