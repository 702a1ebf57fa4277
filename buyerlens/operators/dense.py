"""Gradients of small dense networks, and their training in shards on Spark."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buyerlens.plans.partials import array_column
from buyerlens.session import materialise

Layer = tuple[np.ndarray, np.ndarray]
SHARD_ROWS = 50_000  # rows that one task trains on
ROUND_EPOCHS = 5  # epochs that shards train side by side between two averages


def init_layers(sizes: Sequence[int], rng: np.random.Generator) -> list[Layer]:
    """Weights and biases uniform within 1/sqrt(inputs)."""
    out = []
    for a, b in zip(sizes[:-1], sizes[1:], strict=True):
        limit = 1.0 / np.sqrt(a)
        out.append((rng.uniform(-limit, limit, (a, b)), rng.uniform(-limit, limit, b)))
    return out


def forward(x: np.ndarray, layers: list[Layer], last_relu: bool = False) -> list[np.ndarray]:
    """Input and every layer's output; ReLU between layers. Layers may be stacks of many models' layers."""
    acts = [x]
    for i, (w, b) in enumerate(layers):
        x = x @ w + b[..., None, :]
        if last_relu or i < len(layers) - 1:
            x = np.maximum(x, 0.0)
        acts.append(x)
    return acts


def backward(
    acts: list[np.ndarray], layers: list[Layer], grad: np.ndarray, last_relu: bool = False
) -> tuple[list[Layer], np.ndarray]:
    """Parameter gradients and the gradient at the input."""
    grads: list[Layer] = []
    for i in range(len(layers) - 1, -1, -1):
        if last_relu or i < len(layers) - 1:
            grad = grad * (acts[i + 1] > 0)
        grads.append((turned(acts[i]) @ grad, grad.sum(axis=-2)))
        grad = grad @ turned(layers[i][0])
    return grads[::-1], grad


def turned(a: np.ndarray) -> np.ndarray:
    """Transpose of a matrix, or of every matrix of a stack."""
    return np.swapaxes(a, -1, -2)


@dataclass(frozen=True)
class Packing:
    """Places of named arrays in one flat vector, or in the last axis of a stack of vectors."""

    shapes: tuple[tuple[int, ...], ...]

    @staticmethod
    def of(arrays: Sequence[np.ndarray]) -> Packing:
        return Packing(tuple(a.shape for a in arrays))

    def split(self, flat: np.ndarray) -> list[np.ndarray]:
        out, at = [], 0
        for shape in self.shapes:
            size = int(np.prod(shape))
            out.append(flat[..., at : at + size].reshape(*flat.shape[:-1], *shape))
            at += size
        return out


def pack(arrays: Sequence[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.asarray(a).ravel() for a in arrays])


def pack_stack(arrays: Sequence[np.ndarray], models: int) -> np.ndarray:
    """models x size, from stacks of arrays."""
    return np.concatenate([np.asarray(a).reshape(models, -1) for a in arrays], axis=1)


def pairs(arrays: Sequence[np.ndarray]) -> list[Layer]:
    return [(arrays[i], arrays[i + 1]) for i in range(0, len(arrays), 2)]


def flat_layers(layers: list[Layer]) -> list[np.ndarray]:
    return [a for layer in layers for a in layer]


class Adam:
    """Adam with the usual constants."""

    def __init__(self, size: int, lr: float) -> None:
        self.lr, self.t = lr, 0
        self.m, self.v = np.zeros(size), np.zeros(size)

    def step(self, params: np.ndarray, grad: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * grad
        self.v = 0.999 * self.v + 0.001 * grad * grad
        m = self.m / (1 - 0.9**self.t)
        v = self.v / (1 - 0.999**self.t)
        return params - self.lr * m / (np.sqrt(v) + 1e-8)


def minimise(
    df: DataFrame,
    id_column: str,
    params: np.ndarray,
    gradient: Callable[[int, np.ndarray], Callable],
    n_losses: int,
    lr: float,
    epochs: int,
    batch_rows: int = 256,
    shards: int | None = None,
    seed: int = 0,
    before_round: Callable[[int, np.ndarray], None] | None = None,
    round_epochs: int = ROUND_EPOCHS,
) -> tuple[np.ndarray, list[np.ndarray]]:
    """Minibatch Adam in keyed shards, averaged after each round; returns parameters and mean losses per epoch.

    Rows belong to shards by a hash of their id and stand in hashed order there; there is a shard for every
    ``SHARD_ROWS`` rows unless their number is given. A round is one job: each shard starts from the averaged weights
    and moments, takes ``round_epochs`` epochs of steps of ``batch_rows`` rows, and sends one vector; vectors are
    averaged by rows. A single shard has nothing to average and trains all its epochs in one round, unless
    ``before_round`` has to see the weights. Neither steps nor noise depend on the partitioning.
    ``gradient(epoch, params)`` gives the function that turns an Arrow batch into ``[rows, losses…, gradient…]`` sums;
    ``params`` may be many models' parameters in one vector, which then train side by side on the same batches.
    """
    names = df.columns
    source = materialise(df)
    n_rows = source.count()
    if not n_rows:
        raise ValueError("no rows to fit on")
    shards = shards or -(-n_rows // SHARD_ROWS)
    if shards == 1 and before_round is None:
        round_epochs = epochs
    keyed = source.withColumn("_order", F.xxhash64(id_column, F.lit(seed)))
    keyed = keyed.withColumn("_shard", F.pmod("_order", F.lit(shards)).cast("int"))
    rows = keyed.repartitionByRange(shards, "_shard").sortWithinPartitions("_shard", "_order", id_column).persist()
    adam, history, size = Adam(len(params), lr), [], len(params)
    try:
        for first in range(0, epochs, round_epochs):
            if before_round is not None:
                before_round(first, params)
            turns = range(first, min(epochs, first + round_epochs))
            last = turns.stop == epochs

            def train(batches, turns=turns, params=params, start=(adam.m, adam.v, adam.t) if first else None, last=last):
                for shard, steps in _steps(batches, names, batch_rows):
                    own, at = Adam(size, lr), params
                    if start is not None:
                        own.m, own.v, own.t = start
                    held, logs = list(steps), []
                    for epoch in turns:
                        sums = np.zeros(1 + n_losses)
                        for batch in held:
                            total = gradient(epoch, at)(batch)
                            sums += total[: 1 + n_losses]
                            at = own.step(at, total[1 + n_losses :] / total[0])
                        logs.append(sums)
                    n = sums[0]
                    moments = [] if last else [n * own.m, n * own.v]
                    made = np.concatenate([[n, n * own.t], n * at, *moments, *logs])
                    yield pa.RecordBatch.from_arrays([pa.array([shard]), array_column(made[None, :])], ["shard", "part"])

            found = rows.mapInArrow(train, "shard long, part array<double>").toArrow().sort_by("shard")  # a row a shard
            total = np.sum([part.values.to_numpy() for part in found.column("part")], axis=0)
            n, held = total[0], size if last else 3 * size  # the last round's moments serve nobody
            adam.t = int(round(total[1] / n))
            params, *moments = (total[2 : 2 + held] / n).reshape(-1, size)
            if moments:
                adam.m, adam.v = moments
            history += [log[1:] / n for log in total[2 + held :].reshape(len(turns), -1)]
    finally:
        rows.unpersist()
    return params, history


def _steps(batches, names: Sequence[str], batch_rows: int):
    """``(shard, its minibatches)`` of rows sorted by shard, whatever the sizes of the Arrow batches."""
    left, shard = None, None

    def pieces():
        """Runs of one shard's rows."""
        for batch in batches:
            of = batch.column(batch.schema.get_field_index("_shard")).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1), len(of)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    yield int(of[a]), batch.slice(a, b - a).select(list(names))

    source = pieces()
    ahead = next(source, None)

    def minibatches():
        nonlocal ahead, left
        while ahead is not None and ahead[0] == shard:
            whole = ahead[1] if left is None else _joined([left, ahead[1]])
            full = whole.num_rows // batch_rows * batch_rows
            for at in range(0, full, batch_rows):
                yield whole.slice(at, batch_rows)
            left = whole.slice(full) if full < whole.num_rows else None
            ahead = next(source, None)
        if left is not None:
            yield left
            left = None

    while ahead is not None:
        shard = ahead[0]
        yield shard, minibatches()


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def keyed_normal(ids: np.ndarray, dims: int, epoch: int, seed: int) -> np.ndarray:
    """Standard normal noise that depends on (id, dimension, epoch, seed) only."""

    def mix(x):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    with np.errstate(over="ignore"):
        base = mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        base = mix(base ^ mix(np.uint64([epoch * 1_000_003 + seed * 7_919 + 1]))[0])
        lanes = mix(np.arange(1, 2 * dims + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        bits = mix(base[:, None] ^ lanes[None, :])
    u = ((bits >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
    return np.sqrt(-2.0 * np.log(u[:, :dims])) * np.cos(2.0 * np.pi * u[:, dims:])
