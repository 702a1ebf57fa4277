"""Histogram gradient boosting, binary and softmax, with trees grown leaf by leaf.

Features are binned to one byte. A tree splits its leaf of largest gain until it has ``leaves``; a child's histogram
of gradients and hessians is summed over its rows, its sibling's follows by subtraction. In the softmax model a round
has one tree per class, all from the same probabilities.

Fits that a task can hold (``fit_stored``) run whole in one each, many fits side by side. Larger ones keep their rows
in place: every pass sums the histograms of all open leaves of all trees of a round in the tasks, so growth looks
ahead without changing which leaf is split, and raw scores are stored anew every ``REFRESH`` rounds.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Generator, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buyerlens.functions.keyed import keyed_uniform
from buyerlens.plans.partials import array_column, map_batches, matrix, partitions_of, sum_partials, vector
from buyerlens.session import at_once, materialise

TASK_ROWS = 250_000
TASK_CELLS = 16_000_000  # rows x features, and rows x trees a round, up to which a task takes four times as many rows
COLUMN_CELLS = 50_000  # rows x features from which histograms are summed column by column
PAIR_ROWS = 65_536  # rows from which they are summed for two columns at once, as many as a pair has cells
REFRESH = 10
MIN_HESSIAN = 1e-3
MODELS = "fit int, n long, model binary"


@dataclass(frozen=True)
class Settings:
    """Growth and stopping; a part of the rows is held out for stopping above ``stop_above`` rows."""

    rounds: int = 100
    rate: float = 0.1
    leaves: int = 31
    min_rows: int = 20
    bins: int = 255
    l2: float = 0.0
    stop_above: int | None = 10_000
    held: float = 0.1
    patience: int = 10
    tol: float = 1e-7


@dataclass(frozen=True)
class Tree:
    """Nodes in arrays; ``x <= cut`` (``bin <= place``) goes left, a leaf has feature -1."""

    feature: np.ndarray
    place: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    rows: np.ndarray

    def scores(self, x: np.ndarray, binned: bool = False) -> np.ndarray:
        """The value of every row's leaf; each node parts its own rows, columns are best contiguous."""
        feature, bound = self.feature.tolist(), (self.place if binned else self.cut).tolist()
        out, waiting = np.empty(len(x)), [(0, np.arange(len(x)))]
        while waiting:
            at, rows = waiting.pop()
            if feature[at] < 0:
                out[rows] = self.value[at]
            elif len(rows):
                below = x[:, feature[at]].take(rows) <= bound[at]
                waiting += [(self.left[at], rows.compress(below)), (self.right[at], rows.compress(~below))]
        return out


@dataclass(frozen=True)
class Boosted:
    """Bin edges, starting scores, and the trees of every round: one, or one per class."""

    edges: tuple[np.ndarray, ...]
    base: np.ndarray
    rounds: tuple[tuple[Tree, ...], ...]
    losses: tuple[float, ...] = ()  # mean training loss before each round

    def packed(self) -> bytes:
        """The model's numbers, without its classes."""
        trees = [[(t.feature, t.place, t.cut, t.left, t.right, t.value, t.rows) for t in trees] for trees in self.rounds]
        return pickle.dumps((self.edges, self.base, trees, self.losses))

    @staticmethod
    def unpacked(raw: bytes) -> Boosted:
        edges, base, rounds, losses = pickle.loads(raw)
        return Boosted(edges, base, tuple(tuple(Tree(*t) for t in trees) for trees in rounds), losses)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, x = np.tile(self.base, (len(x), 1)), np.asfortranarray(x)
        for trees in self.rounds:
            for k, tree in enumerate(trees):
                out[:, k] += tree.scores(x)
        return out

    def chances(self, x: np.ndarray) -> np.ndarray:
        """Chance of class 1 as a vector, or a row of chances per class."""
        p = chances(self.raw(x))
        return p[:, 0] if len(self.base) == 1 else p


def chances(raw: np.ndarray) -> np.ndarray:
    if raw.shape[1] == 1:
        return 1.0 / (1.0 + np.exp(-np.clip(raw, -500, 500)))
    e = np.exp(raw - raw.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def slopes(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients and hessians (rows x trees) and the loss of every row."""
    p = chances(raw)
    if raw.shape[1] == 1:
        hit, own = y[:, None].astype(float), np.where(y == 1, p[:, 0], 1.0 - p[:, 0])
    else:
        hit = (y[:, None] == np.arange(raw.shape[1])).astype(float)
        own = p[np.arange(len(y)), y]
    return p - hit, p * (1.0 - p), -np.log(np.maximum(own, 1e-300))


def quantile_edges(values: np.ndarray, bins: int) -> np.ndarray:
    """Upper bounds of all bins but the last: midpoints of few distinct values, else quantiles."""
    distinct = np.unique(values[np.isfinite(values)])
    if len(distinct) <= bins:
        return (distinct[:-1] + distinct[1:]) / 2.0
    return np.unique(np.quantile(values[np.isfinite(values)], np.arange(1, bins) / bins))


def binned(x: np.ndarray, edges) -> np.ndarray:
    """One byte per value: how many edges are below it; NaN is in the last bin."""
    out = np.empty((len(x), len(edges)), dtype=np.uint8)
    for f, e in enumerate(edges):
        out[:, f] = np.searchsorted(e, x[:, f], side="left")
    return out


def histogram(bins: np.ndarray, g: np.ndarray, h: np.ndarray, width: int) -> np.ndarray:
    """Sums of gradient, hessian and rows per (feature, bin): 3 x features x width."""
    d = bins.shape[1]
    at = (bins + np.arange(d) * width).ravel()
    cells = [np.bincount(at, np.repeat(w, d), d * width) for w in (g, h)]
    return np.stack([*cells, np.bincount(at, minlength=d * width)]).reshape(3, d, width)


@dataclass
class Node:
    """A leaf that may be split: its histogram, path of (feature, bin, left?), and best split."""

    hist: np.ndarray
    path: tuple = ()
    at: int = 0
    gain: float = -np.inf
    feature: int = -1
    place: int = 0
    small_left: bool = True

    def find(self, s: Settings) -> Node:
        g, h, n = self.hist[:, 0, :].sum(axis=1)
        if n < 2 * s.min_rows:
            return self
        gl, hl, nl = np.cumsum(self.hist, axis=2)[:, :, :-1].reshape(3, -1)
        gr, hr = g - gl, h - hl
        able = (nl >= s.min_rows) & (nl <= n - s.min_rows) & (hl >= MIN_HESSIAN) & (hr >= MIN_HESSIAN)
        gain = np.full(len(gl), -np.inf)
        np.copyto(gain, gl * gl / (np.maximum(hl, MIN_HESSIAN) + s.l2) + gr * gr / (np.maximum(hr, MIN_HESSIAN) + s.l2), where=able)
        best = int(gain.argmax())
        if able[best]:
            self.gain = float(gain[best] - g * g / (h + s.l2))
            self.feature, self.place = divmod(best, self.hist.shape[2] - 1)
            self.small_left = bool(nl[best] <= n - nl[best])
        return self

    def value(self, s: Settings) -> float:
        g, h, _ = self.hist[:, 0, :].sum(axis=1)
        return float(-s.rate * g / (h + s.l2)) if h > 0 else 0.0

    def children(self, small: np.ndarray) -> tuple[Node, Node]:
        pair = (small, self.hist - small) if self.small_left else (self.hist - small, small)
        step = (self.feature, self.place)
        return Node(pair[0], (*self.path, (*step, True))), Node(pair[1], (*self.path, (*step, False)))


def growing(root: Node, s: Settings, edges, ahead: bool) -> Generator[list[Node], dict[int, np.ndarray], Tree]:
    """Grow one tree; asks for the histograms of smaller children, of all open leaves if ``ahead``."""
    nodes, small = [root], {}
    heap: list[tuple[float, int]] = []

    def offer(node):
        if node.find(s).gain > 1e-12:
            heapq.heappush(heap, (-node.gain, node.at))

    parts = {}
    offer(root)
    n_leaves = 1
    while heap and n_leaves < s.leaves:
        at = heapq.heappop(heap)[1]
        if at not in small:
            asked = [nodes[at], *[nodes[i] for _, i in heap if i not in small]] if ahead else [nodes[at]]
            small.update((yield asked))
        pair = nodes[at].children(small.pop(at))
        parts[at] = (len(nodes), len(nodes) + 1)
        for child in pair:
            child.at = len(nodes)
            nodes.append(child)
            offer(child)
        nodes[at].hist = nodes[at].hist[:, :1, :]
        n_leaves += 1
    inner = np.array([i in parts for i in range(len(nodes))])
    feature = np.array([n.feature if k else -1 for n, k in zip(nodes, inner)])
    place = np.array([n.place if k else 0 for n, k in zip(nodes, inner)])
    return Tree(
        feature, place, np.array([edges[f][b] if f >= 0 else 0.0 for f, b in zip(feature, place)]),
        np.array([parts.get(i, (0, 0))[0] for i in range(len(nodes))]), np.array([parts.get(i, (0, 0))[1] for i in range(len(nodes))]),
        np.array([0.0 if k else n.value(s) for n, k in zip(nodes, inner)]),
        np.array([int(n.hist[2, 0, :].sum()) for n in nodes]),
    )


class InTask:
    """Rows held by one task."""

    ahead = False

    def __init__(self, bins: np.ndarray, y: np.ndarray, held: np.ndarray, width: int, base: np.ndarray) -> None:
        self.bins, self.y, self.held, self.width = bins, y, held, width
        self.columns, self.held_columns = np.asfortranarray(bins), np.asfortranarray(bins[held])
        pairs = bins[:, :-1:2].astype(np.uint16) * width + bins[:, 1::2] if len(bins) >= PAIR_ROWS else bins[:, :0]
        self.pairs = np.asfortranarray(pairs)
        self.raw = np.tile(base, (len(bins), 1))
        self.train = np.flatnonzero(~held)
        self.where: dict[tuple, np.ndarray] = {}  # rows of open leaves

    def roots(self, trees) -> tuple[list[np.ndarray], float, float]:
        """Histograms of all training rows for each tree, and the mean training and held-out losses."""
        self._add(trees)
        g, h, loss = slopes(self.raw, self.y)
        self.g, self.h = np.asfortranarray(g), np.asfortranarray(h)
        t = self.train
        hists = [self._histogram(k, t) for k in range(self.raw.shape[1])]
        return hists, float(loss[t].mean()), float(loss[self.held].mean()) if self.held.any() else 0.0

    def _add(self, trees) -> None:
        """Add each tree's values: to training rows from the leaf that its growth left them in."""
        leaves, self.where = self.where, {}
        grown = {k for k, _ in leaves}
        for (k, path), rows in leaves.items():
            at = 0
            for _, _, left in path:
                at = (trees[k].left if left else trees[k].right)[at]
            self.raw[rows, k] += trees[k].value[at]
        for k, tree in enumerate(trees):
            if k not in grown:
                self.raw[self.train, k] += tree.value[0]
            if len(self.held_columns):
                self.raw[self.held, k] += tree.scores(self.held_columns, True)

    def _histogram(self, k: int, rows: np.ndarray) -> np.ndarray:
        """As ``histogram`` of these rows; by columns where they are many, for the cache, or by pairs of columns."""
        g, h = self.g[:, k].take(rows), self.h[:, k].take(rows)
        d, width = self.bins.shape[1], self.width
        if len(rows) * d < COLUMN_CELLS:
            return histogram(self.bins[rows], g, h, width)
        out = np.empty((3, d, width))
        paired = self.pairs.shape[1] if len(rows) >= PAIR_ROWS else 0
        for p in range(paired):
            at = self.pairs[:, p].take(rows).astype(np.intp)
            for i, w in enumerate((g, h, None)):
                cells = np.bincount(at, w, width * width).reshape(width, width)
                out[i, 2 * p], out[i, 2 * p + 1] = cells.sum(axis=1), cells.sum(axis=0)
        for f in range(2 * paired, d):
            at = self.columns[:, f].take(rows).astype(np.intp)
            out[0, f], out[1, f], out[2, f] = np.bincount(at, g, width), np.bincount(at, h, width), np.bincount(at, minlength=width)
        return out

    def expand(self, asked: list[tuple[int, Node]]) -> list[np.ndarray]:
        out = []
        for k, node in asked:
            rows = self.where.pop((k, node.path), self.train)
            below = self.columns[:, node.feature].take(rows) <= node.place
            step = (node.feature, node.place)
            sides = {True: rows.compress(below), False: rows.compress(~below)}
            for left, own in sides.items():
                self.where[k, (*node.path, (*step, left))] = own
            part = sides[node.small_left]
            out.append(self._histogram(k, part))
        return out


class InPlace:
    """Rows that stay in the tasks of a stored frame ``(bins, y, held, raw)``."""

    ahead = True

    def __init__(self, rows: DataFrame, width: int) -> None:
        self.width, self.pending, self.count = width, [], 0
        self._store(rows)

    def _store(self, rows: DataFrame) -> None:
        self.rows = materialise(rows)
        self.many = partitions_of(self.rows)

    @staticmethod
    def _now(batch, pending) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        blob = batch.column(batch.schema.get_field_index("bins"))
        bins = np.stack([np.frombuffer(b.as_py(), dtype=np.uint8) for b in blob])
        raw = matrix(batch, "raw").copy()
        for trees in pending:
            for k, tree in enumerate(trees):
                raw[:, k] += tree.scores(bins, True)
        held = batch.column(batch.schema.get_field_index("held")).to_numpy(zero_copy_only=False).astype(bool)
        return bins, vector(batch, "y"), held, raw

    def _sums(self, asked: list[tuple[int, tuple, Node | None]], trees: int) -> np.ndarray:
        pending, width = list(self.pending), self.width
        wanted = [(k, path, None if n is None else (n.feature, n.place, n.small_left)) for k, path, n in asked]

        def partial(batch):
            bins, y, held, raw = InPlace._now(batch, pending)
            g, h, loss = slopes(raw, y)
            out = [np.array([loss[~held].sum(), (~held).sum(), loss[held].sum(), held.sum()])]
            for k, path, split in wanted:
                rows = np.flatnonzero(~held)
                for feature, place, left in [*path, *([split] if split else [])]:
                    below = bins[rows, feature] <= place
                    rows = rows[below if left else ~below]
                out.append(histogram(bins[rows], g[rows, k], h[rows, k], width).ravel())
            return np.concatenate(out)

        return sum_partials(self.rows, partial, self.many, wide=True)

    def roots(self, trees) -> tuple[list[np.ndarray], float, float]:
        if trees:
            self.pending.append(trees)
            self.count += 1
            if self.count % REFRESH == 0:
                pending = list(self.pending)
                self._store(map_batches(
                    self.rows, ["bins", "y", "held"], ["raw"], lambda b: {"raw": InPlace._now(b, pending)[3]}, {"raw": "array<double>"}
                ))
                self.pending = []
        k = self.trees
        total = self._sums([(i, (), None) for i in range(k)], k)
        hists = list(total[4:].reshape(k, 3, -1, self.width))
        return hists, total[0] / total[1], total[2] / total[3] if total[3] else 0.0

    def expand(self, asked: list[tuple[int, Node]]) -> list[np.ndarray]:
        total = self._sums([(k, n.path, n) for k, n in asked], self.trees)
        return list(total[4:].reshape(len(asked), 3, -1, self.width))


def boost(source, edges, base: np.ndarray, s: Settings, stopping: bool) -> Boosted:
    """Rounds of growth over either kind of source."""
    trees: tuple[Tree, ...] = ()
    rounds, losses, held_losses = [], [], []
    source.trees = len(base)
    for _ in range(s.rounds):
        hists, loss, held = source.roots(trees)
        losses.append(loss)
        held_losses.append(held)
        if stopping and len(held_losses) > s.patience + 1:
            before = held_losses[-s.patience - 1] - s.tol
            if not any(v < before for v in held_losses[-s.patience :]):
                break
        growers = [growing(Node(hist), s, edges, source.ahead) for hist in hists]
        done: list[Tree | None] = [None] * len(growers)
        waiting = {}
        for k, g in enumerate(growers):
            try:
                waiting[k] = next(g)
            except StopIteration as end:
                done[k] = end.value
        while waiting:
            asked = [(k, node) for k, nodes in waiting.items() for node in nodes]
            found = dict(zip([(k, n.at) for k, n in asked], source.expand(asked), strict=True))
            for k in list(waiting):
                answer = {n.at: found[k, n.at] for n in waiting[k]}
                try:
                    waiting[k] = growers[k].send(answer)
                except StopIteration as end:
                    done[k] = end.value
                    del waiting[k]
        trees = tuple(done)
        rounds.append(trees)
    return Boosted(tuple(edges), base, tuple(rounds), tuple(losses))


def starting_scores(counts: np.ndarray, classes: int) -> np.ndarray:
    """Log odds of class 1, or centred log shares of the classes."""
    share = np.clip(counts / max(counts.sum(), 1), 1e-12, 1.0)
    if classes == 1:
        p = np.clip(counts[1] / max(counts.sum(), 1), 1e-12, 1.0 - 1e-12)
        return np.array([np.log(p / (1.0 - p))])
    return np.log(share) - np.log(share).mean()


def _stops(n: int, classes: int, s: Settings) -> bool:
    return classes == 1 and s.stop_above is not None and n > s.stop_above


def fit_in_task(keys: np.ndarray, x: np.ndarray, y: np.ndarray, classes: int, s: Settings, seed: int, edges=None) -> Boosted:
    """One whole fit in this process; rows are put in the order of their keys first."""
    order = np.lexsort((*x.T[::-1], keys))
    keys, x, y = keys[order], x[order], y[order]
    if edges is None:
        edges = [quantile_edges(x[:, f], s.bins) for f in range(x.shape[1])]
    stopping = _stops(len(x), classes, s)
    held = keyed_uniform(keys, seed, 31) < s.held if stopping else np.zeros(len(x), dtype=bool)
    base = starting_scores(np.bincount(y[~held], minlength=max(2, classes)), classes)
    width = max((len(e) for e in edges), default=0) + 1
    bins = binned(x, edges)
    del x, keys, order
    return boost(InTask(bins, y, held, width, base), edges, base, s, stopping)


def fit_in_place(rows: DataFrame, classes: int, s: Settings, seed: int, edges=None) -> Boosted:
    """One fit over ``(_key, features, y)`` rows that stay in their tasks."""
    shape = rows.agg(F.max(F.size("features")).alias("d"), F.count("*").alias("n")).first()
    if edges is None:
        probs = [float(p) for p in np.arange(1, s.bins) / s.bins]
        asked = [F.percentile_approx(F.get("features", F.lit(f)), probs, 20_000).alias(f"q{f}") for f in range(shape["d"])]
        edges = [np.unique(np.array(q, dtype=float)) for q in rows.agg(*asked).first()]
    stopping = _stops(shape["n"], classes, s)
    width = max((len(e) for e in edges), default=0) + 1

    def prepare(batch):
        keys = vector(batch, "_key")
        held = keyed_uniform(keys, seed, 31) < s.held if stopping else np.zeros(len(keys), dtype=bool)
        return {"bins": pa.array([b.tobytes() for b in binned(matrix(batch, "features"), edges)], pa.binary()), "held": held}

    stored = materialise(_with_arrow(rows, prepare))
    counted = stored.where("NOT held").groupBy("y").count().collect()  # a row a class
    counts = np.zeros(max(2, classes))
    for r in counted:
        counts[r["y"]] = r["count"]
    base = starting_scores(counts, classes)
    start = F.array(*[F.lit(float(b)) for b in base])
    return boost(InPlace(stored.withColumn("raw", start), width), edges, base, s, stopping)


def _with_arrow(rows: DataFrame, fn) -> DataFrame:
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                made = fn(batch)
                y = batch.column(batch.schema.get_field_index("y"))
                yield pa.RecordBatch.from_arrays([made["bins"], y, pa.array(made["held"])], ["bins", "y", "held"])

    return rows.select("_key", "features", "y").mapInArrow(run, "bins binary, y int, held boolean")


def fit_side_by_side(
    rows: DataFrame, classes: dict[int, int], s: Settings, seed: int, task_rows: int = TASK_ROWS
) -> dict[int, Boosted]:
    """The models of ``fit_stored`` on the driver, for few fits."""
    return {r["fit"]: Boosted.unpacked(r["model"]) for r in fit_stored(rows, classes, s, seed, task_rows).collect()}


def fit_stored(
    rows: DataFrame, classes: dict[int, int], s: Settings, seed: int, task_rows: int = TASK_ROWS
) -> DataFrame:
    """Stored ``(fit, n, model)`` of the fits of ``(fit, _key, features, y)`` rows: training rows and the packed model.

    ``classes`` gives each fit's number of trees a round (1: binary). Fits are counted first. Those of at most ``task_rows``
    rows, and of four times as many where they have at most ``TASK_CELLS`` cells, go to a task each, costly ones first, and
    their models from there to the file, never by the driver; the others are fitted in place, several at once, since a
    pass of one fit does not keep all cores busy.
    """
    counted = rows.groupBy("fit").agg(F.count("*").alias("n"), F.max(F.size("features")).alias("d")).collect()  # a row a fit
    shape = {r["fit"]: (r["n"], r["d"]) for r in counted}
    absent = sorted(set(classes) - set(shape))
    if absent:
        raise ValueError(f"no rows for fits {absent}")

    def in_one(f: int) -> bool:
        n, d = shape[f]
        return n <= task_rows or (n <= 4 * task_rows and n * max(d, classes[f]) <= TASK_CELLS)

    small = sorted((f for f in classes if in_one(f)), key=lambda f: (-classes[f] * shape[f][0] * shape[f][1], f))
    large = [f for f in classes if not in_one(f)]
    placed = at_once(lambda f: fit_in_place(rows.where(F.col("fit") == f).drop("fit"), classes[f], s, seed).packed(), large)
    spark = rows.sparkSession
    out = spark.createDataFrame([(f, shape[f][0], model) for f, model in zip(large, placed, strict=True)], MODELS)
    if not small:
        return materialise(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            fits = vector(batch, "fit")
            for f in np.unique(fits):
                mine = batch.filter(pa.array(fits == f))
                held.setdefault(int(f), []).append((vector(mine, "_key"), matrix(mine, "features"), vector(mine, "y")))
        for f in sorted(held):
            model = fit_in_task(*(np.concatenate(part) for part in zip(*held.pop(f))), classes[f], s, seed)
            cells = [pa.array([f], pa.int32()), pa.array([shape[f][0]], pa.int64()), pa.array([model.packed()], pa.binary())]
            yield pa.RecordBatch.from_arrays(cells, ["fit", "n", "model"])

    task = F.array_position(F.array(*[F.lit(f) for f in small]), F.col("fit")) - 1
    dealt = rows.where(F.col("fit").isin(small)).withColumn("_task", task.cast("int")).repartitionById(len(small), "_task")
    found = dealt.select("fit", "_key", "features", "y").mapInArrow(run, MODELS)
    return materialise(found.unionByName(out) if large else found)
