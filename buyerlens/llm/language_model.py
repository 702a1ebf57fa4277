"""Language-model scores by masked pseudo-likelihood.

A small window network predicts every word of a text from the two words before it and the two after it; a text's score is
the sum of the log-probabilities it gives the words. All words that stand ``MIN_COUNT`` times or more in the corpus, counted by
Spark, have an id of their own, so the network grows with the input. The rarer ones share at least ``HASHED`` buckets, and a
rare word's probability is its bucket's times its own share of the bucket's count. An id is two digits, or as many as it takes
for no digit to have more than ``DIGITS`` values: the first is predicted from the context, each other from the context and those
before it, so a prediction costs a few small softmaxes, one more where the words are ``DIGITS`` times as many. Words outside the
text are one padding word.

Training is data-parallel: in each round every task starts from the same weights, takes each word of its texts once, in
seeded order, in minibatch Adam steps in numpy, and sends once what it changed, in half precision: rows of the table that it
touched, and the small matrices. Changes are shuffled once, averaged by ``ADDERS`` tasks, a table row by how often each task met
it and the rest by words seen. All texts take part. Weights depend on how the input is split, so scores agree between runs that
split it alike.

Shares of rare words are joined on the word, which has fewer than ``MIN_COUNT`` rows, so no key is large.

Defined cases: a null or empty text has log-probability 0 and no mean (null); null ids and repeated rows are ordinary
rows; an empty table gives no rows; other columns are ignored; a text is scored whole, however long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buyerlens.llm.text import chunks, per_chunk, word_names
from buyerlens.session import materialise

MIN_COUNT = 50
HASHED = 256
WORDS = 1024  # of a network made without a vocabulary
DIGITS = 64
WIDTH = 24
SIDES = (-2, -1, 1, 2)
ROUNDS = 2
BATCH = 2048
RATE = 0.01
ADDERS = 8
PER_CORE = 2
BLOCK = 4096
PIECE = 8
LEAST = 1e-30  # sums of exponentials from here to its inverse are as exact as those of shifted logits
SEED = 17
CHUNK = 500_000


def places(words: int) -> tuple[int, int]:
    """How many digits an id has, and how many values a digit, for so many ids."""
    many = 2
    while DIGITS**many < words:
        many += 1
    digits = 1
    while digits**many < words:
        digits += 1
    return many, digits


def shapes(words: int) -> dict[str, tuple[int, ...]]:
    """The shape of each weight for a number of ids, the padding word among them.

    The table ``e`` has a row for each word on each side, then one for each run of two or more first digits."""
    many, digits = places(words)
    rows = len(SIDES) * words + sum(digits**k for k in range(2, many))
    out = {"e": (rows, WIDTH), "b": (WIDTH,), "w1": (WIDTH, digits), "b1": (digits,), "u": (digits, WIDTH)}
    for k in range(2, many + 1):
        out |= {f"w{k}": (WIDTH, digits), f"b{k}": (digits,)}
    return out


def fresh(seed: int = SEED, words: int = WORDS) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    out = {n: np.zeros(s, dtype=np.float32) for n, s in shapes(words).items()}
    for a in out.values():
        for i in range(0, len(a) if a.ndim > 1 else 0, BLOCK):  # drawn in double precision, so not all at once
            a[i : i + BLOCK] = rng.normal(0, 0.1, a[i : i + BLOCK].shape)
    return out


def halved(weights: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Weights with the table in half precision, as tasks are sent it."""
    return weights | {"e": weights["e"].astype(np.float16)}


def opened(weights: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return weights | {"e": weights["e"].astype(np.float32)}


def small(weights: dict[str, np.ndarray]) -> np.ndarray:
    """All weights but the table, in one vector."""
    return np.concatenate([a.ravel() for n, a in weights.items() if n != "e"])


class Vocabulary:
    """Ids of words by their 64-bit names: those given have their own, others share buckets; the last is the padding word."""

    def __init__(self, names: np.ndarray):
        order = np.argsort(names)
        self.names, self.ids = names[order], order.astype(np.int32)
        self.shift = np.uint64(64 - max(1, len(names)).bit_length() - 2)
        self.begin = np.searchsorted(self.names >> self.shift, np.arange(1 << (64 - int(self.shift)), dtype=np.uint64)).astype(np.int32)
        self.own = len(names)
        many, digits = places(self.own + HASHED + 1)
        self.words = digits**many  # all runs of digits are used
        self.hashed = self.words - 1 - self.own

    def buckets(self, names: np.ndarray) -> np.ndarray:
        return (names % np.uint64(self.hashed)).astype(np.int32)

    def ids_of(self, names: np.ndarray) -> np.ndarray:
        ids = self.own + self.buckets(names)
        if not len(self.names):
            return ids
        # sorted names are looked up from the first with the same highest bits, of which there are few
        at, left = self.begin.take(names >> self.shift), np.arange(len(names))
        while len(left):
            found, wanted = self.names.take(at, mode="clip"), names.take(left)
            same = found == wanted
            ids[left[same]] = self.ids.take(at[same])
            further = (found < wanted) & (at < len(self.names) - 1)
            at, left = at[further] + 1, left[further]
        return ids

    def laid_out(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids with two padding words around each text, the places of the words, and each word's text."""
        names, first = word_names(texts)
        text_of = np.repeat(np.arange(len(texts)), np.diff(first))
        place = np.arange(len(names)) + 2 * text_of + 2
        flat = np.full(len(names) + 2 * len(texts) + 2, self.words - 1, dtype=np.int32)
        flat[place] = self.ids_of(names)
        return flat, place, text_of


def context(flat: np.ndarray, place: np.ndarray, words: int) -> np.ndarray:
    return np.stack([flat.take(place + s) + k * words for k, s in enumerate(SIDES)]).T


def split(word: np.ndarray, words: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The digits of ids, and what stands before each digit but the first: the first digit, then rows of the table."""
    many, digits = places(words)
    runs = [word // digits ** (many - k) for k in range(1, many + 1)]
    at, before = len(SIDES) * words, [runs[0]]
    for k in range(2, many):
        before.append(runs[k - 1] + at)
        at += digits**k
    return [runs[0], *(run % digits for run in runs[1:])], before


def forward(w: dict[str, np.ndarray], around: np.ndarray, first: np.ndarray, *rows: np.ndarray):
    """The states that the digits are predicted from, and the logits of each digit's values (values x words)."""
    h = w["e"].take(around[:, 0], axis=0)
    for k in range(1, len(SIDES)):
        h += w["e"].take(around[:, k], axis=0)
    h += w["b"]
    np.tanh(h, out=h)
    states = [h, h + w["u"].take(first, axis=0), *(h + w["e"].take(r, axis=0) for r in rows)]
    logits = [s @ w[f"w{k}"] for k, s in enumerate(states, 1)]  # rows of words are faster
    for k, p in enumerate(logits, 1):
        p += w[f"b{k}"]
    return *states, *(p.T for p in logits)


def exponentials(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
    """Exponentials (words x values) of logits (values x words), each word's sum, and what was taken off its logits, mostly 0."""
    with np.errstate(over="ignore"):
        shares = np.exp(logits.T)
    total = shares @ np.ones(len(logits), dtype=shares.dtype)
    if total.min() > LEAST and total.max() < 1 / LEAST:
        return shares, total, 0.0
    top = logits.max(axis=0)
    shares = np.exp((logits - top).T)
    return shares, shares.sum(axis=1), top


def log_share(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    _, total, off = exponentials(logits)
    return logits[at, np.arange(len(at))] - off - np.log(total)


def words_of(weights: dict[str, np.ndarray]) -> int:
    return len(weights["b1"]) ** sum(n[0] == "w" for n in weights)


def log_probabilities(w: dict[str, np.ndarray], flat: np.ndarray, place: np.ndarray, step: int = 2048) -> np.ndarray:
    out, words = np.empty(len(place), dtype=np.float64), words_of(w)
    for i in range(0, len(place), step):
        at = place[i : i + step]
        digits, before = split(flat[at], words)
        logits = forward(w, context(flat, at, words), *before)[len(digits) :]
        out[i : i + step] = sum(log_share(p, d) for p, d in zip(logits, digits))
    return out


class Groups:
    """Equal numbers of ``flat`` as groups: ``rows`` are the numbers, sorted, ``at`` is the group of each place."""

    def __init__(self, flat: np.ndarray):
        bits = len(flat).bit_length()
        keys = np.sort(flat.astype(np.int64) << bits | np.arange(len(flat)))
        keys, self.order = keys >> bits, keys & ((1 << bits) - 1)
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        self.starts = np.flatnonzero(new)
        self.rows, self.sizes = keys[self.starts], np.diff(self.starts, append=len(flat))
        self.at = np.empty(len(flat), dtype=np.int64)
        self.at[self.order] = np.cumsum(new) - 1

    def sums(self, parts: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The sum of each group's parts; place i has part ``own[i]``. Most groups are one place and are only copied.

        Groups are cut into pieces of ``PIECE`` places; the second places of all pieces are added at once, then the third."""
        own = own.take(self.order)
        out = parts.take(own.take(self.starts), axis=0)
        several = np.flatnonzero(self.sizes > 1)
        starts, sizes = self.starts.take(several), self.sizes.take(several)
        pieces = (sizes + (PIECE - 1)) // PIECE
        first = np.cumsum(pieces) - pieces
        at = np.repeat(starts - PIECE * first, pieces)
        at += PIECE * np.arange(len(at))
        size = np.minimum(np.repeat(starts + sizes, pieces) - at, PIECE)
        largest = np.argsort(-size, kind="stable")
        at = at.take(largest)
        lines = parts.take(own.take(at), axis=0)
        for k, many in enumerate(len(size) - np.cumsum(np.bincount(size, minlength=PIECE))[1:PIECE], 1):
            lines[:many] += parts.take(own.take(at[:many] + k), axis=0)
        whole = np.empty_like(lines)
        put_rows(whole, largest, lines)
        if len(whole) > len(several):
            cut = pieces > 1
            sums = np.add.reduceat(whole[np.repeat(cut, pieces)], np.cumsum(pieces[cut]) - pieces[cut], axis=0)
            whole = whole.take(first, axis=0)
            whole[cut] = sums
        put_rows(out, several, whole)
        return out


def put_rows(table: np.ndarray, rows: np.ndarray, lines: np.ndarray) -> None:
    """``table[rows] = lines``, a whole row at a time."""
    kind = f"V{table.strides[0]}"
    table.view(kind)[:, 0][rows] = lines.view(kind)[:, 0]


def like(weights: dict[str, np.ndarray], e: np.ndarray, rest: np.ndarray) -> dict[str, np.ndarray]:
    """Arrays of the same names and shapes: a table, and the others out of one vector, as ``small`` makes it."""
    out, at = {"e": e}, 0
    for name, a in weights.items():
        if name != "e":
            out[name] = rest[at : at + a.size].reshape(a.shape)
            at += a.size
    return out


class Trainer:
    """Minibatch Adam steps; only the table rows of a batch are read and changed, and ``met`` counts how often."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float = RATE):
        self.rate, self.t = rate, 0
        self.rest = [small(weights), *(np.zeros_like(small(weights)) for _ in "mv")]
        # a row's weights and both its moments are neighbours, so that a batch's random rows are each fetched once
        self.table = np.zeros((3 * len(weights["e"]), weights["e"].shape[1]), dtype=weights["b"].dtype)
        self.table[::3] = weights["e"]
        self.w, self.m, self.v = (like(weights, self.table[k::3], rest) for k, rest in enumerate(self.rest))
        self.met = np.zeros(len(weights["e"]), dtype=np.int32)
        self.words, self.digits = words_of(weights), len(weights["b1"])

    def step(self, around: np.ndarray, word: np.ndarray) -> None:
        n, sides = len(word), around.shape[1]
        digits, before = split(word, self.words)
        groups = Groups(np.concatenate([*around.T, *before[1:]]))
        lines = groups.at.reshape(-1, n)
        rows = [3 * groups.rows + k for k in range(3)]
        w, m, v = (self.table.take(r, axis=0) for r in rows)
        found = forward({**self.w, "e": w}, lines[:sides].T, before[0], *lines[sides:])
        states, back, grads = found[: len(digits)], [], {}
        first = np.arange(n) * self.digits
        for k, (s, own, logits) in enumerate(zip(states, digits, found[len(digits) :]), 1):
            wrong, total, _ = exponentials(logits)
            wrong.reshape(-1)[first + own] -= total
            each = 0.1 / (n * total)  # Adam adds a tenth of the gradient, and the square of that
            back.append(wrong @ self.w[f"w{k}"].T)
            back[-1] *= each[:, None]
            grads |= {f"w{k}": (s * each[:, None]).T @ wrong, f"b{k}": each @ wrong}
        h = states[0]
        dh = sum(back[1:], start=back[0]) * (1 - h * h)
        hot = np.eye(self.digits, dtype=dh.dtype).take(digits[0], axis=0)
        grads |= {"u": hot.T @ back[1], "b": dh.sum(0)}
        own = np.concatenate([np.tile(np.arange(n), sides), np.arange(n, n * (len(digits) - 1))])
        tenths = groups.sums(np.concatenate([dh, *back[2:]]), own)
        self.t += 1
        rate = float(self.rate * np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t))
        adam(*self.rest, small({name: grads[name] for name in self.w if name != "e"}), rate)
        adam(w, m, v, tenths, rate)
        for r, changed in zip(rows, (w, m, v)):
            put_rows(self.table, r, changed)
        self.met[groups.rows] += groups.sizes.astype(np.int32)


def adam(w: np.ndarray, m: np.ndarray, v: np.ndarray, tenth: np.ndarray, rate: float) -> None:
    """One step in place by a tenth of the gradient; all arrays are changed."""
    m *= 0.9
    m += tenth
    v *= 0.99
    np.multiply(tenth, tenth, out=tenth)
    v += tenth
    root = np.sqrt(v, out=tenth)
    root += 1e-8
    np.divide(m, root, out=root)
    root *= rate
    w -= root


def counted_words(docs: DataFrame) -> DataFrame:
    """``(_name, _n)``: the 64-bit name of every word of all texts, and how often it stands there."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "_text", 4_000_000):
            raw = [b or b"" for b in part.column(0).cast(pa.binary()).to_pylist()]
            names, times = np.unique(word_names(raw)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(times)], names=["_name", "_n"])

    counted = docs.select(F.col("text").alias("_text")).mapInArrow(count, "_name long, _n long")
    return materialise(counted.groupBy("_name").agg(F.sum("_n").alias("_n")))


def own_words(counted: DataFrame, least: int = MIN_COUNT) -> np.ndarray:
    """64-bit names of all words that stand ``least`` times or more, most frequent first."""
    rows = counted.where(F.col("_n") >= least).toArrow()
    names, times = (rows[c].to_numpy() for c in ("_name", "_n"))
    return names[np.lexsort((names, -times))].view(np.uint64)


def bucket_counts(rare: DataFrame, names: np.ndarray) -> np.ndarray:
    """How often the words of each bucket stand in the corpus."""
    words = Vocabulary(names)
    hashed = words.hashed

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(hashed, dtype=np.int64)
        for batch in batches:
            name, times = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            np.add.at(total, (name.view(np.uint64) % np.uint64(hashed)).astype(np.int64), times)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(hashed)), pa.array(total)], names=["_bucket", "_n"])

    out = np.zeros(hashed, dtype=np.int64)
    sums = rare.select("_name", "_n").mapInArrow(add, "_bucket long, _n long").groupBy("_bucket").agg(F.sum("_n").alias("_n"))
    rows = sums.toArrow()
    out[rows["_bucket"].to_numpy()] = rows["_n"].to_numpy()
    return out


def rare_shares(docs: DataFrame, rare: DataFrame, names: np.ndarray) -> DataFrame:
    """``(_hit, _mean)``: of each text with rare words, by its hash, the mean logarithm of their counts in the corpus."""
    sent = docs.sparkSession.sparkContext.broadcast(names)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.sort(sent.value)
        for part in chunks(batches, "_text", CHUNK):
            texts = [b or b"" for b in part.column(1).cast(pa.binary()).to_pylist()]
            found, first = word_names(texts)
            text_of = np.repeat(np.arange(len(texts)), np.diff(first))
            if len(own):
                at = np.minimum(np.searchsorted(own, found), len(own) - 1)
                other = own[at] != found
                found, text_of = found[other], text_of[other]
            keys = part.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[text_of]), pa.array(found.view(np.int64))], names=["_hit", "_word"]
            )

    tokens = docs.select(F.xxhash64("text").alias("_hit"), F.col("text").alias("_text")).mapInArrow(
        find, "_hit long, _word long"
    )
    return (
        tokens.join(rare, F.col("_word") == F.col("_name"))
        .groupBy("_hit")
        .agg(F.avg(F.log(F.col("_n").cast("double"))).alias("_mean"))
    )


def changes(before: dict[str, np.ndarray], after: dict[str, np.ndarray], met: np.ndarray, seen: int) -> Iterator[tuple]:
    """``(block, rows, weights, changes)``: changes of the small weights (block -1), and of table rows that were met."""
    yield -1, np.zeros(1, np.uint16), np.array([seen], np.float32), small(after) - small(before)
    for block in range(-(-len(met) // BLOCK)):
        a = block * BLOCK
        rows = np.flatnonzero(met[a : a + BLOCK])
        if len(rows):
            change = after["e"][a + rows] - before["e"][a + rows]  # in single precision
            yield block, gaps(rows), met[a + rows].astype(np.float32), change.astype(np.float16)


def mean_changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The weighted mean of all changes of each block."""
    total: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for change in zip(*batch.columns):
            block, at, weight, part = unpacked(*(c.as_py() for c in change))
            if block not in total:
                total[block] = np.zeros(1 if block < 0 else BLOCK), np.zeros((1 if block < 0 else BLOCK, part.shape[1]), np.float32)
            total[block][0][at] += weight
            total[block][1][at] += part * weight[:, None]
    for block, (weight, part) in total.items():
        rows = np.flatnonzero(weight)
        mean = (part[rows] / weight[rows, None]).astype(np.float32 if block < 0 else np.float16)
        yield as_batch((block, gaps(rows), weight[rows].astype(np.float32), mean))


def gaps(rows: np.ndarray) -> np.ndarray:
    """Steps from row to row, mostly ones, which shuffles compress."""
    return np.diff(rows, prepend=0).astype(np.uint16)


def unpacked(block: int, rows: bytes, weight: bytes, change: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    at = np.cumsum(np.frombuffer(rows, np.uint16), dtype=np.int64)
    part = np.frombuffer(change, np.float32 if block < 0 else np.float16).reshape(len(at), -1)
    return block, at, np.frombuffer(weight, np.float32), part.astype(np.float32)


def as_batch(change: tuple) -> pa.RecordBatch:
    block, *arrays = change
    return pa.RecordBatch.from_arrays(
        [pa.array([block], pa.int64()), *[pa.array([a.tobytes()], pa.binary()) for a in arrays]],
        names=["_block", "_rows", "_weight", "_change"],
    )


def trained_on(docs: DataFrame) -> DataFrame:
    """All texts in at most ``PER_CORE`` tasks a core: every task sends the rows that it met, most of the table if it is long."""
    return docs.select(F.col("text").alias("_text")).coalesce(PER_CORE * docs.sparkSession.sparkContext.defaultParallelism)


def train(docs: DataFrame, names: np.ndarray, rounds: int = ROUNDS, seed: int = SEED) -> dict[str, np.ndarray]:
    """The weights after ``rounds`` averaged passes over all words of all texts."""
    spark = docs.sparkSession
    words = Vocabulary(names).words
    weights = fresh(seed, words)
    for round_ in range(rounds):
        sent = spark.sparkContext.broadcast((names, halved(weights) if round_ else None))

        def learn(batches: Iterator[pa.RecordBatch], sent=sent, round_=round_) -> Iterator[pa.RecordBatch]:
            own, before = sent.value
            before = before or fresh(seed, words)
            vocabulary, trainer, seen = Vocabulary(own), Trainer(before), 0
            for part in chunks(batches, "_text", CHUNK):
                texts = [b or b"" for b in part.column(0).cast(pa.binary()).to_pylist()]
                flat, place, _ = vocabulary.laid_out(texts)
                at = place[np.random.default_rng(seed + round_).permutation(len(place))]
                for i in range(0, len(at), BATCH):
                    here = at[i : i + BATCH]
                    trainer.step(context(flat, here, words), flat[here])
                seen += len(at)
            if seen:
                for change in changes(before, trainer.w, trainer.met, seen):
                    yield as_batch(change)

        kind = "_block long, _rows binary, _weight binary, _change binary"
        local = trained_on(docs).mapInArrow(learn, kind)
        found = local.repartition(ADDERS, "_block").mapInArrow(mean_changes, kind).toLocalIterator()  # each block once
        for r in found:
            block, at, _, mean = unpacked(r["_block"], r["_rows"], r["_weight"], r["_change"])
            if block >= 0:
                weights["e"][block * BLOCK + at] += mean
                continue
            weights = like(weights, weights["e"], small(weights) + mean[0])
        weights = opened(halved(weights))
        sent.destroy()
    return weights


def pseudo_likelihood(docs: DataFrame, rounds: int = ROUNDS, seed: int = SEED, least: int = MIN_COUNT) -> DataFrame:
    """``(doc_id, n_words, log_probability, per_word)`` of every row of ``docs``, by a model of all its texts."""
    counted = counted_words(docs)
    names, rare = own_words(counted, least), counted.where(F.col("_n") < least)
    weights = train(docs, names, rounds, seed)
    in_bucket = bucket_counts(rare, names)
    sent = docs.sparkSession.sparkContext.broadcast((names, halved(weights), in_bucket))

    def make():
        own, w, in_bucket = sent.value
        words, w = Vocabulary(own), opened(w)
        whole = np.zeros(words.words)
        whole[words.own : -1] = np.log(np.maximum(in_bucket, 1))

        def score(texts: list[bytes]) -> list:
            flat, place, text_of = words.laid_out(texts)
            n = np.bincount(text_of, minlength=len(texts))
            total = log_probabilities(w, flat, place) - whole[flat[place]]
            n_rare = np.bincount(text_of, flat[place] >= words.own, minlength=len(texts))
            return [pa.array(n.astype(np.int64)), np.bincount(text_of, total, minlength=len(texts)), pa.array(n_rare.astype(np.int64))]

        return score

    scored = materialise(per_chunk(
        docs.select("doc_id", "text", F.xxhash64("text").alias("_key")), ["doc_id", "_key"], "text",
        [("n_words", "long"), ("log_probability", "double"), ("_rare", "long")], make, chars=CHUNK,
    ))
    # a text with rare words has fewer than ``least`` rows, so the look-up has no large key
    full = scored.where("_rare > 0").join(rare_shares(docs, rare, names), F.col("_key") == F.col("_hit"), "left").select(
        "doc_id", "n_words", (F.col("log_probability") + F.col("_rare") * F.col("_mean")).alias("log_probability")
    )
    whole = full.unionAll(scored.where("_rare = 0").select("doc_id", "n_words", "log_probability"))
    return whole.withColumn(
        "per_word", F.when(F.col("n_words") > 0, F.col("log_probability") / F.col("n_words"))
    )
