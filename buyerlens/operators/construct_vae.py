"""Construct-aligned variational autoencoder, trained by gradients summed on Spark.

loss = reconstruction + beta x KL(free dims) + w x KL(aligned dims) + lambda x alignment error
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buyerlens.config import ModelConfig
from buyerlens.operators import dense
from buyerlens.plans.partials import map_features, matrix, vector
from buyerlens.session import at_once

STACK = 3  # models that a task trains side by side
LOSSES = ("total", "recon", "kl_free", "kl_aligned", "align")


def aligned_dims(cfg: ModelConfig, n_constructs: int) -> int:
    """Aligned latent dimensions: none without alignment weight, else the configured number or
    as many as there are constructs, leaving the free minimum."""
    if cfg.lambda_align == 0.0:
        return 0
    a = cfg.aligned_dims
    if a is None:
        a = min(n_constructs, cfg.latent_dim - cfg.min_free_dims)
    if not 0 <= a <= cfg.latent_dim:
        raise ValueError(f"aligned_dims={a} outside [0, {cfg.latent_dim}]")
    if a > 0 and n_constructs <= 0:
        raise ValueError("aligned dims need construct targets")
    return a


@dataclass(frozen=True)
class ConstructVae:
    """Trained weights: trunk, mean, log-variance, decoder and alignment head."""

    trunk: list
    mean: tuple
    logvar: tuple
    decoder: list
    head: tuple | None
    aligned: int
    history: tuple[dict, ...] = ()

    def code(self, x: np.ndarray) -> np.ndarray:
        """Posterior mean."""
        h = dense.forward(x, self.trunk, last_relu=True)[-1]
        return h @ self.mean[0] + self.mean[1]

    def predict_constructs(self, x: np.ndarray) -> np.ndarray:
        return self.code(x)[:, : self.aligned] @ self.head[0] + self.head[1]

    def decode(self, z: np.ndarray) -> np.ndarray:
        return dense.forward(z, self.decoder)[-1]


def initial_arrays(width: int, cfg: ModelConfig, aligned: int, n_constructs: int, seed: int) -> list:
    """Flat list: trunk layers, mean, log-variance, decoder layers, alignment head."""
    rng = np.random.default_rng(seed)
    trunk = dense.init_layers([width, *cfg.hidden_dims], rng)
    top = [width, *cfg.hidden_dims][-1]
    arrays = dense.flat_layers(trunk)
    arrays += dense.flat_layers(dense.init_layers([top, cfg.latent_dim], rng))
    arrays += dense.flat_layers(dense.init_layers([top, cfg.latent_dim], rng))
    arrays += dense.flat_layers(dense.init_layers([cfg.latent_dim, *reversed(cfg.hidden_dims), width], rng))
    if aligned:
        arrays += dense.flat_layers(dense.init_layers([aligned, n_constructs], rng))
    return arrays


def unpack(arrays: list, cfg: ModelConfig, aligned: int):
    """Trunk, mean, log-variance, decoder, head from the flat list."""
    layers = dense.pairs(arrays)
    n = len(cfg.hidden_dims)
    end = n + 2 + n + 1
    return layers[:n], layers[n], layers[n + 1], layers[n + 2 : end], layers[end] if aligned else None


def loss_and_gradient(
    arrays: list, x: np.ndarray, c: np.ndarray | None, eps: np.ndarray, cfg: ModelConfig, aligned: int,
    beta: np.ndarray | float | None = None, lambda_align: np.ndarray | float | None = None,
) -> tuple[np.ndarray, list]:
    """Loss sums over the rows in the order of ``LOSSES`` and the gradient of the total.

    ``arrays`` may be stacks of many models' arrays; ``beta`` and ``lambda_align`` then have one entry each, and every
    loss is a vector.
    """
    trunk, mean, logvar, decoder, head = unpack(arrays, cfg, aligned)
    beta = np.asarray(cfg.beta if beta is None else beta, dtype=float)
    lam = np.asarray(cfg.lambda_align if lambda_align is None else lambda_align, dtype=float)
    acts = dense.forward(x, trunk, last_relu=True)
    h = acts[-1]
    mu, lv = h @ mean[0] + mean[1][..., None, :], h @ logvar[0] + logvar[1][..., None, :]
    sd = np.exp(0.5 * lv)
    z = mu + sd * eps
    back = dense.forward(z, decoder)
    gap = back[-1] - x
    kl = 0.5 * (mu**2 + sd**2 - lv - 1.0)
    weight = np.repeat(beta[..., None, None], cfg.latent_dim, axis=-1)
    weight[..., :aligned] = cfg.aligned_kl_weight
    g_dec, g_z = dense.backward(back, decoder, 2.0 * gap)
    g_head, align = [], np.zeros(beta.shape)
    if head is not None:
        miss = z[..., :aligned] @ head[0] + head[1][..., None, :] - c
        align = (miss**2).sum(axis=(-1, -2))
        out = 2.0 * lam[..., None, None] * miss
        g_head = [dense.turned(z[..., :aligned]) @ out, out.sum(axis=-2)]
        g_z = g_z.copy()
        g_z[..., :aligned] += out @ dense.turned(head[0])
    g_mu = g_z + weight * mu
    g_lv = g_z * eps * 0.5 * sd + weight * 0.5 * (sd**2 - 1.0)
    g_top = g_mu @ dense.turned(mean[0]) + g_lv @ dense.turned(logvar[0])
    g_trunk, _ = dense.backward(acts, trunk, g_top, last_relu=True)
    grads = [
        *dense.flat_layers(g_trunk),
        dense.turned(h) @ g_mu,
        g_mu.sum(axis=-2),
        dense.turned(h) @ g_lv,
        g_lv.sum(axis=-2),
        *dense.flat_layers(g_dec),
        *g_head,
    ]
    recon, free, tied = (gap**2).sum(axis=(-1, -2)), kl[..., aligned:].sum(axis=(-1, -2)), kl[..., :aligned].sum(axis=(-1, -2))
    total = recon + beta * free + cfg.aligned_kl_weight * tied + lam * align
    return np.array([total, recon, free, tied, align]), grads


def fit_construct_vae(
    train: DataFrame,
    cfg: ModelConfig,
    seed: int,
    n_constructs: int,
    id_column: str = "id",
    features: str = "features",
    constructs: str = "constructs",
) -> ConstructVae:
    """Train on ``(id, features, constructs)`` rows; sampling noise is keyed on (id, epoch, seed)."""
    point = (cfg.beta, cfg.lambda_align)
    return fit_grid(train, cfg, [point], seed, n_constructs, id_column, features, constructs)[point]


def fit_grid(
    train: DataFrame,
    cfg: ModelConfig,
    points: Sequence[tuple[float, float]],
    seed: int,
    n_constructs: int,
    id_column: str = "id",
    features: str = "features",
    constructs: str = "constructs",
) -> dict[tuple[float, float], ConstructVae]:
    """One model for every (beta, lambda) point, those of one shape in stacks of ``STACK`` that train on the same batches
    and noise; each is the model that its point gives alone. Stacks are jobs of their own, so that a grid keeps all
    cores busy where the rows are one shard."""
    width = train.select(F.size(features).alias("n")).first()["n"]
    shapes: dict[int, list[tuple[float, float]]] = {}
    for beta, lam in dict.fromkeys(points):
        shapes.setdefault(aligned_dims(replace(cfg, beta=beta, lambda_align=lam), n_constructs), []).append((beta, lam))

    def fit(stack) -> dict[tuple[float, float], ConstructVae]:
        aligned, own = stack
        out = {}
        rows = train.select(id_column, features, *([constructs] if aligned else []))
        arrays = initial_arrays(width, cfg, aligned, n_constructs, seed)
        packing, models = dense.Packing.of(arrays), len(own)
        betas, lams = np.array([b for b, _ in own]), np.array([v for _, v in own])

        def gradient(epoch, params, packing=packing, models=models, betas=betas, lams=lams, aligned=aligned):
            weights = packing.split(params.reshape(models, -1))

            def partial(batch):
                x = matrix(batch, features)
                c = matrix(batch, constructs) if aligned else None
                eps = dense.keyed_normal(vector(batch, id_column), cfg.latent_dim, epoch, seed)
                losses, grads = loss_and_gradient(weights, x, c, eps, cfg, aligned, betas, lams)
                return np.concatenate([[len(x)], losses.ravel(), dense.pack_stack(grads, models).ravel()])

            return partial

        params, history = dense.minimise(
            rows,
            id_column,
            np.tile(dense.pack(arrays), models),
            gradient,
            len(LOSSES) * models,
            cfg.lr,
            cfg.epochs,
            cfg.batch_rows,
            cfg.shards,
            seed,
        )
        for m, point in enumerate(own):
            trunk, mean, logvar, decoder, head = unpack(packing.split(params.reshape(models, -1)[m]), cfg, aligned)
            logs = [h.reshape(len(LOSSES), models)[:, m] for h in history]
            log = tuple({"epoch": float(i), **dict(zip(LOSSES, map(float, h), strict=True))} for i, h in enumerate(logs))
            out[point] = ConstructVae(trunk, mean, logvar, decoder, head, aligned, log)
        return out

    stacks = [(aligned, own[at : at + STACK]) for aligned, own in shapes.items() for at in range(0, len(own), STACK)]
    made = [fit(s) for s in stacks] if len(stacks) == 1 else at_once(fit, stacks)
    return {point: model for found in made for point, model in found.items()}


def encode(df: DataFrame, model: ConstructVae, keep: Sequence[str], out: str = "z") -> DataFrame:
    """Posterior means."""
    return map_features(df, keep, model.code, out)


def predict_constructs(
    df: DataFrame, model: ConstructVae, keep: Sequence[str], out: str = "predicted"
) -> DataFrame:
    """Alignment-head predictions; null where the model has no aligned dimension."""
    if model.head is None:
        return df.select(*keep, F.lit(None).cast("array<double>").alias(out))
    return map_features(df, keep, model.predict_constructs, out)


def loss_terms(
    df: DataFrame,
    cfg: ModelConfig,
    aligned: int,
    mu: str = "mu",
    logvar: str = "logvar",
    x: str = "x",
    xhat: str = "xhat",
    predicted: str | None = None,
    constructs: str | None = None,
) -> DataFrame:
    """Mean loss terms from model output columns: sums over dimensions, means over rows."""

    def total(arr):
        return F.aggregate(arr, F.lit(0.0), lambda a, v: a + v)

    def square_gap(a, b):
        return total(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)))

    kl = F.zip_with(mu, logvar, lambda m, v: (m * m + F.exp(v) - v - 1.0) * 0.5)
    size = F.size(mu)
    tied = total(F.slice(kl, 1, aligned)) if aligned else F.lit(0.0)
    free = total(F.slice(kl, F.lit(aligned + 1), size - aligned))
    align = square_gap(predicted, constructs) if aligned and predicted and constructs else F.lit(0.0)
    means = df.agg(
        F.avg(square_gap(xhat, x)).alias("recon"),
        F.avg(free).alias("kl_free"),
        F.avg(tied).alias("kl_aligned"),
        F.avg(align).alias("align"),
    )
    return means.withColumn(
        "total",
        F.col("recon")
        + cfg.beta * F.col("kl_free")
        + cfg.aligned_kl_weight * F.col("kl_aligned")
        + cfg.lambda_align * F.col("align"),
    )
