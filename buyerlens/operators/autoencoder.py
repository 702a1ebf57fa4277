"""Dense autoencoder and embedded clustering, trained by gradients summed on Spark."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buyerlens.config import ModelConfig
from buyerlens.operators import dense
from buyerlens.operators.clusters import fit_kmeans, squared_distances, student_assign
from buyerlens.plans.partials import map_features, matrix, partitions_of, sum_partials
from buyerlens.session import materialise


@dataclass(frozen=True)
class Autoencoder:
    """Encoder and decoder layers, and the mean loss of each epoch."""

    encoder: list
    decoder: list
    history: tuple[float, ...] = ()

    def code(self, x: np.ndarray) -> np.ndarray:
        return dense.forward(x, self.encoder)[-1]


def fit_autoencoder(
    train: DataFrame, cfg: ModelConfig, seed: int, id_column: str = "id", features: str = "features"
) -> Autoencoder:
    """Mean squared reconstruction error, minimised by Adam."""
    rows = train.select(id_column, features)
    width = rows.select(F.size(features).alias("n")).first()["n"]
    rng = np.random.default_rng(seed)
    sizes = [width, *cfg.hidden_dims, cfg.latent_dim]
    enc, dec = dense.init_layers(sizes, rng), dense.init_layers(sizes[::-1], rng)
    arrays = dense.flat_layers([*enc, *dec])
    packing, depth = dense.Packing.of(arrays), len(enc)

    def gradient(_epoch, params):
        layers = dense.pairs(packing.split(params))

        def partial(batch):
            x = matrix(batch, features)
            acts = dense.forward(x, layers[:depth])
            back = dense.forward(acts[-1], layers[depth:])
            gap = back[-1] - x
            g_dec, g_code = dense.backward(back, layers[depth:], 2.0 * gap / width)
            g_enc, _ = dense.backward(acts, layers[:depth], g_code)
            flat = dense.pack(dense.flat_layers([*g_enc, *g_dec]))
            return np.concatenate([[len(x), (gap * gap).sum() / width], flat])

        return partial

    params, history = dense.minimise(
        rows, id_column, dense.pack(arrays), gradient, 1, cfg.lr, cfg.epochs, cfg.batch_rows, cfg.shards, seed
    )
    layers = dense.pairs(packing.split(params))
    return Autoencoder(layers[:depth], layers[depth:], tuple(float(h[0]) for h in history))


def encode(df: DataFrame, model: Autoencoder, keep: Sequence[str], out: str = "z") -> DataFrame:
    """Frozen codes."""
    return map_features(df, keep, model.code, out)


@dataclass(frozen=True)
class EmbeddedClusters:
    """A fine-tuned encoder of its own and its centroids."""

    encoder: list
    centers: np.ndarray
    history: tuple[float, ...] = ()

    def soft(self, x: np.ndarray) -> np.ndarray:
        return student_assign(dense.forward(x, self.encoder)[-1], self.centers)


def fit_embedded_clusters(
    train: DataFrame,
    model: Autoencoder,
    k: int,
    cfg: ModelConfig,
    seed: int,
    n_init: int = 10,
    iterations: int = 40,
    refresh: int = 5,
    id_column: str = "id",
    features: str = "features",
) -> EmbeddedClusters:
    """Fine-tune a copy of the encoder and K centroids towards the sharpened assignment.

    Before every ``refresh`` iterations one pass sums the cluster frequencies under the current weights;
    each task then recomputes its rows' targets from those weights, so no target is stored.
    """
    rows = materialise(train.select(id_column, features))
    parts = partitions_of(rows)
    start = fit_kmeans(encode(rows, model, [id_column]), k, seed, n_init, "z")
    arrays = [*dense.flat_layers(model.encoder), start]
    packing = dense.Packing.of(arrays)
    anchor: dict[str, np.ndarray] = {}

    def unpack(params):
        split = packing.split(params)
        return dense.pairs(split[:-1]), split[-1]

    def renew(_epoch, params):
        layers, centers = unpack(params)

        def frequencies(batch):
            return student_assign(dense.forward(matrix(batch, features), layers)[-1], centers).sum(axis=0)

        anchor["params"] = params
        anchor["freq"] = sum_partials(rows, frequencies, parts)

    def gradient(_epoch, params):
        layers, centers = unpack(params)
        old_layers, old_centers = unpack(anchor["params"])
        freq = anchor["freq"]

        def partial(batch):
            x = matrix(batch, features)
            sharp = student_assign(dense.forward(x, old_layers)[-1], old_centers) ** 2 / freq
            p = sharp / sharp.sum(axis=1, keepdims=True)
            acts = dense.forward(x, layers)
            z = acts[-1]
            kernel = 1.0 / (1.0 + squared_distances(z, centers))
            q = kernel / kernel.sum(axis=1, keepdims=True)
            pull = 2.0 * kernel * (p - q)
            g_z = pull.sum(axis=1)[:, None] * z - pull @ centers
            g_c = pull.sum(axis=0)[:, None] * centers - pull.T @ z
            g_enc, _ = dense.backward(acts, layers, g_z)
            loss = (p * np.log(np.maximum(p, 1e-300) / q)).sum()
            flat = dense.pack([*dense.flat_layers(g_enc), g_c])
            return np.concatenate([[len(x), loss], flat])

        return partial

    params, history = dense.minimise(
        rows,
        id_column,
        dense.pack(arrays),
        gradient,
        1,
        cfg.lr,
        iterations,
        cfg.batch_rows,
        cfg.shards,
        seed,
        renew,
        refresh,
    )
    layers, centers = unpack(params)
    return EmbeddedClusters(layers, centers, tuple(float(h[0]) for h in history))


def embedded_assign(df: DataFrame, model: EmbeddedClusters, keep: Sequence[str], out: str = "q") -> DataFrame:
    return map_features(df, keep, model.soft, out)
