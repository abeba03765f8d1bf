"""Operator 4, language-model scores by masked pseudo-likelihood.

A network predicts every token from the one before and the one behind it: both have vectors of
their own for either side, a hidden layer joins them, and a softmax in two steps (a class of
tokens, then the token in it) gives the probability of each token of the vocabulary. A document's
score is the sum of the logarithms over all its tokens.

Texts are encoded once. What the network learns from is the table of all windows of three tokens
with their counts over the whole corpus; that table grows with the corpus, is made by a shuffle and stays on the executors.
Training runs in numpy where the windows are: in each round every task takes its share of a slice of the table, starting
from the same network, and sends back how the vectors moved; these moves are averaged by
the number of tokens behind them. The slices of all rounds make up the table; a task takes its windows in blocks of bounded
size, each block a few times, which is the same for corpora of all sizes. Classes and the
network before the first round come from the tokens' counts, so it starts as a model of frequencies alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, text_or_empty
from .tokens import Tokens, encoding

HIDDEN = 24
#: A class is closed when it holds this share of all tokens, or so many different ones.
SHARE, MEMBERS = 1 / 128, 512
#: Windows of a training step, steps of a block, and how often each block is taken, whatever the corpus's size.
STEP, BLOCK, PASSES = 8192, 32, 3
ROUNDS = 4
RATE = 0.15
#: Different windows that a task holds; tokens whose windows it counts at once, or scores, twice as many; rows handed over at once; contexts whose classes are weighed at once.
FLUSH, GROUP, ROWS, CONTEXTS = 1 << 21, 1 << 19, 1 << 16, 1 << 13


@dataclass(frozen=True)
class Model:
    """rank: place of each id by frequency, the edge's last. bounds: first place of each class, and the end.

    net: rows of a vector and a bias for, in order, tokens on the left, tokens on the right (both by place), tokens
    to predict, classes, and the hidden layer.
    """

    rank: np.ndarray
    bounds: np.ndarray
    net: np.ndarray

    @property
    def parts(self) -> tuple[np.ndarray, ...]:
        v, k = len(self.rank) - 1, len(self.bounds) - 1
        return tuple(np.split(self.net, np.cumsum([v + 1, v + 1, v, k])))

    @property
    def class_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


@lru_cache(maxsize=2)
def vocabulary(path: str) -> int:
    return encoding(path).max_token_value + 1


def packed(ids: np.ndarray, edge: int) -> np.ndarray:
    """left << 40 | right << 20 | token of every token; the edge stands beyond a text's ends."""
    wide = np.concatenate([[edge], ids.astype(np.int64), [edge]])
    return wide[:-2] << 40 | wide[2:] << 20 | wide[1:-1]


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    tokens = Tokens(path)
    for batch in batches:
        ids = [tokens.encode(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in ids], pa.binary())], ["doc_id", "ids"])


def encoded(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and ids, the tokens as little-endian unsigned 32-bit numbers."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(lambda b: _encode(b, tokenizer), f"doc_id {kind}, ids binary")


def _held(batches: Iterator[pa.RecordBatch], column: int, edge: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[pa.Array]]]:
    """Windows of the texts of some rows, how many each of these has, and the parts of their first column.

    A group of rows is closed when it holds most tokens.
    """
    windows, sizes, firsts, n = [], [], [], 0
    for batch in batches:
        start = 0
        for i, data in enumerate(batch.column(column)):
            ids = np.frombuffer(data.as_buffer(), "<u4")
            windows.append(packed(ids, edge))
            sizes.append(len(ids))
            n += len(ids)
            if n >= most:
                windows = np.concatenate(windows)  # the parts go
                yield windows, np.array(sizes, np.int64), [*firsts, batch.column(0).slice(start, i + 1 - start)]
                windows, sizes, firsts, n, start = [], [], [], 0, i + 1
        firsts.append(batch.column(0).slice(start))
    if sizes:
        yield np.concatenate(windows), np.array(sizes, np.int64), firsts


def _counts(batches: Iterator[pa.RecordBatch], edge: int) -> Iterator[pa.RecordBatch]:
    keys, n = np.empty(0, np.int64), np.empty(0, np.int64)

    def out() -> Iterator[pa.RecordBatch]:  # few rows at once, as Spark holds a whole batch beside its heap
        for i in range(0, len(keys), ROWS):
            own = keys[i : i + ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(own >> 20), pa.array((own & 0xFFFFF).astype(np.int32)), pa.array(n[i : i + ROWS])], ["context", "token", "n"])

    for windows, _, _ in _held(batches, 1, edge, min(GROUP, FLUSH)):
        new, count = np.unique(windows, return_counts=True)
        at = np.searchsorted(keys, new)
        known = np.zeros(len(new), bool)
        known[at < len(keys)] = keys[at[at < len(keys)]] == new[at < len(keys)]
        n[at[known]] += count[known]
        keys, n = np.insert(keys, at[~known], new[~known]), np.insert(n, at[~known], count[~known])
        if len(keys) >= FLUSH:
            yield from out()
            keys, n = np.empty(0, np.int64), np.empty(0, np.int64)
    yield from out()


def window_counts(ids: DataFrame, edge: int) -> DataFrame:
    """context (left << 20 | right), token and n for every window of the corpus. Contexts are dealt by a hash, so all tokens of one are together."""
    parts = ids.mapInArrow(lambda b: _counts(b, edge), "context long, token int, n long")
    tasks = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Of a window that any number of documents share, each task sends one row for FLUSH different ones.
    sums = parts.repartition(tasks, "context").groupBy("context", "token").agg(F.sum("n").alias("n"))
    # Training goes along this order: one that is no order of tokens, and does not depend on which task was done first.
    return sums.sortWithinPartitions(F.xxhash64("context"), "context", "token")


def classes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """rank and bounds from the counts of all ids: frequent tokens are classes of their own, rare ones share one."""
    order = np.lexsort((np.arange(len(counts)), -counts))
    rank = np.empty(len(counts) + 1, np.int64)
    rank[order], rank[-1] = np.arange(len(counts)), len(counts)
    bounds, mass, limit = [0], 0, max(float(counts.sum()) * SHARE, 1.0)
    for place, n in enumerate(counts[order].tolist()):
        mass += n
        if mass >= limit or place + 1 - bounds[-1] >= MEMBERS:
            bounds.append(place + 1)
            mass = 0
    return rank, np.array(bounds if bounds[-1] == len(counts) else [*bounds, len(counts)])


def fresh(counts: np.ndarray, hidden: int = HIDDEN, seed: int = 4) -> Model:
    """A network that knows the tokens' counts (by id; one is added to each) only."""
    rank, bounds = classes(counts)
    rng = np.random.default_rng(seed)
    net = rng.normal(0, 0.1, (3 * len(counts) + 2 + len(bounds), hidden + 1)).astype(np.float32)
    model = Model(rank, bounds, net)
    left, right, member, top, layer = model.parts
    left[:, -1] = right[:, -1] = layer[:] = 0
    by_place = np.empty(len(counts))
    by_place[rank[:-1]] = counts + 1.0
    sums = np.add.reduceat(by_place, bounds[:-1])
    member[:, -1] = np.log(by_place / sums[model.class_of])
    top[:, -1] = np.log(sums / sums.sum())
    return model


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(1, keepdims=True)
    return x - np.log(np.exp(x).sum(1, keepdims=True))


def _hidden(model: Model, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hidden layer for each context (left << 20 | right), and the places of its tokens."""
    left, right, _, _, layer = model.parts
    a, b = model.rank[contexts >> 20], model.rank[contexts & 0xFFFFF]
    return np.tanh(left[a, :-1] + right[b, :-1] + layer[0, :-1]), a, b


def _by_class(model: Model, place: np.ndarray) -> Iterator[tuple[np.ndarray, int, int]]:
    """Rows of place that fall into a class of several tokens, and that class's bounds."""
    kind = model.class_of[place]
    order = np.argsort(kind, kind="stable")
    cuts = np.flatnonzero(np.diff(kind[order])) + 1
    for rows in np.split(order, cuts):
        if len(rows):
            lo, hi = model.bounds[kind[rows[0]]], model.bounds[kind[rows[0]] + 1]
            if hi - lo > 1:
                yield rows, int(lo), int(hi)


def log_probabilities(model: Model, contexts: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """The logarithm of each token's probability in its context; contexts must be sorted."""
    _, _, member, top, _ = model.parts
    out = np.empty(len(tokens), np.float64)
    class_of = model.class_of
    for i in range(0, len(tokens), 1 << 16):
        own, place = contexts[i : i + (1 << 16)], model.rank[tokens[i : i + (1 << 16)]]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        which = np.cumsum(np.diff(own, prepend=-1) != 0) - 1
        h = _hidden(model, own[first])[0]
        found = np.empty(len(own), np.float64)
        for j in range(0, len(h), CONTEXTS):
            rows = slice(*np.searchsorted(which, [j, j + CONTEXTS]))
            found[rows] = _log_softmax(h[j : j + CONTEXTS] @ top[:, :-1].T + top[:, -1])[which[rows] - j, class_of[place[rows]]]
        for rows, lo, hi in _by_class(model, place):
            inner = _log_softmax(h[which[rows]] @ member[lo:hi, :-1].T + member[lo:hi, -1])
            found[rows] += inner[np.arange(len(rows)), place[rows] - lo]
        out[i : i + (1 << 16)] = found
    return out


def gradient(model: Model, contexts: np.ndarray, tokens: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The mean loss of windows (sorted by context) with their counts, its gradient by row of the network, and the tokens behind each row."""
    left, right, member, top, layer = model.parts
    out, mass = np.zeros_like(model.net), np.zeros(len(model.net))
    d_left, d_right, d_member, d_top, d_layer = Model(model.rank, model.bounds, out).parts
    edges = np.cumsum([0, len(left), len(right), len(member), len(top)])
    total = float(n.sum())
    weight = (n / total).astype(np.float32)
    place = model.rank[tokens]
    kind = model.class_of[place]
    step = np.diff(contexts, prepend=-1) != 0
    first, which = np.flatnonzero(step), np.cumsum(step) - 1
    h, a, b = _hidden(model, contexts[first])
    log = _log_softmax(h @ top[:, :-1].T + top[:, -1])
    loss = -float((weight * log[which, kind]).sum())
    each = np.add.reduceat(weight, first)
    error = np.exp(log) * each[:, None]
    np.subtract.at(error, (which, kind), weight)
    d_top[:, :-1], d_top[:, -1] = error.T @ h, error.sum(0)
    d_h = error @ top[:, :-1]
    mass[edges[3] : edges[4]] = total
    back = np.zeros((len(place), h.shape[1]), np.float32)
    for rows, lo, hi in _by_class(model, place):
        own = h[which[rows]]
        inner = _log_softmax(own @ member[lo:hi, :-1].T + member[lo:hi, -1])
        at = np.arange(len(rows)), place[rows] - lo
        loss -= float((weight[rows] * inner[at]).sum())
        wrong = np.exp(inner) * weight[rows, None]
        wrong[at] -= weight[rows]
        d_member[lo:hi, :-1], d_member[lo:hi, -1] = wrong.T @ own, wrong.sum(0)
        back[rows] = wrong @ member[lo:hi, :-1]
        mass[edges[2] + lo : edges[2] + hi] = n[rows].sum()
    d_h += np.add.reduceat(back, first)
    d_x = d_h * (1 - h * h)
    d_layer[0, :-1] = d_x.sum(0)
    mass[edges[4]] = total
    seen = np.add.reduceat(n, first)
    for which_side, places, start in ((d_left, a, edges[0]), (d_right, b, edges[1])):
        order = np.argsort(places, kind="stable")
        begin = np.flatnonzero(np.diff(places[order], prepend=-1))
        which_side[places[order][begin], :-1] = np.add.reduceat(d_x[order], begin)
        mass[start + places[order][begin]] = np.add.reduceat(seen[order], begin)
    return loss, out, mass


class Descent:
    """Steps downhill, shorter for rows that have moved much already."""

    def __init__(self, model: Model):
        self.model = Model(model.rank, model.bounds, model.net.copy())
        self.square, self.mass = np.zeros_like(model.net), np.zeros(len(model.net))

    def step(self, contexts: np.ndarray, tokens: np.ndarray, n: np.ndarray, rate: float) -> float:
        loss, found, mass = gradient(self.model, contexts, tokens, n)
        rows = np.flatnonzero(mass)
        g = found[rows]
        self.square[rows] += g * g
        self.model.net[rows] -= rate * g / (np.sqrt(self.square[rows]) + 1e-6)
        self.mass += mass
        return loss


def _moves(batches: Iterator[pa.RecordBatch], model: Model, passes: int, rate: float) -> Iterator[pa.RecordBatch]:
    """row, mass and move for each row of the network that this task's windows touch."""
    run, block, held, size = Descent(model), [], [], 0

    def gathered() -> tuple[np.ndarray, ...]:
        context, token, n = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(context, kind="stable")
        return context[order], token[order], n[order].astype(np.float64)

    def settle() -> None:
        for _ in range(passes):
            for context, token, n in block:
                run.step(context, token, n, rate)
        block.clear()

    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, STEP - size)
            held.append(tuple(c.to_numpy(zero_copy_only=False) for c in part.columns))
            at += part.num_rows
            size += part.num_rows
            if size == STEP:
                block.append(gathered())
                held, size = [], 0
                if len(block) == BLOCK:
                    settle()
    if held:
        block.append(gathered())
    settle()
    rows = np.flatnonzero(run.mass)
    moved = (run.model.net[rows] - model.net[rows]).astype("<f4")
    for i in range(0, len(rows), 10_000):
        data = [x.tobytes() for x in moved[i : i + 10_000]]
        yield pa.RecordBatch.from_arrays([pa.array(rows[i : i + 10_000]), pa.array(run.mass[rows[i : i + 10_000]]), pa.array(data, pa.binary())], ["row", "mass", "move"])


def _averaged(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The mean move of each row, weighted by mass. All moves of a row come to one task, which holds their sum only."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for row, mass, move in zip(*(c.to_pylist() for c in batch.columns)):
            own = sums.setdefault(row, np.zeros(width + 1))
            own[:-1] += mass * np.frombuffer(move, "<f4")
            own[-1] += mass
    if sums:
        means = [(x[:-1] / x[-1]).astype("<f4").tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(means, pa.binary())], ["row", "move"])


def train(windows: DataFrame, model: Model, rounds: int = ROUNDS, passes: int | None = None, rate: float = RATE) -> Model:
    """The network after so many rounds over slices of the windows (context, token, n) that together are all of them.

    Each block of a task's windows is taken passes (None: PASSES) times. What comes to the driver is the network's moves.
    """
    spark, passes = windows.sparkSession, passes or PASSES
    slice_ = F.pmod(F.xxhash64("context", F.lit(4)), F.lit(rounds))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for k in range(rounds):
        shared = spark.sparkContext.broadcast(model)
        own = windows.filter(slice_ == k).select("context", "token", "n")
        moves = own.mapInArrow(lambda b, m=shared: _moves(b, m.value, passes, rate), "row long, mass double, move binary")
        mean = moves.repartition(tasks, "row").mapInArrow(lambda b, w=model.net.shape[1]: _averaged(b, w), "row long, move binary")
        found = mean.toArrow()  # a row for each of the network's, at most
        net = model.net.copy()
        if found.num_rows:
            net[found["row"].to_numpy()] += np.frombuffer(b"".join(found["move"].to_pylist()), "<f4").reshape(found.num_rows, -1)
        model = Model(model.rank, model.bounds, net)
        shared.unpersist()
    return model


def fit(ids: DataFrame, size: int) -> Model:
    """The network for encoded documents and a vocabulary of that size."""
    windows = cut(window_counts(ids, size))
    counts = np.zeros(size, np.int64)
    found = windows.groupBy("token").agg(F.sum("n").alias("n")).toPandas()  # a row for each token, at most
    counts[found["token"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return train(windows, fresh(counts))


def likelihoods(model: Model, windows: np.ndarray, sizes: Sequence[int]) -> np.ndarray:
    """The log-likelihood of each text, given all their windows and how many each has. Equal windows are looked up once."""
    keys, which = np.unique(windows, return_inverse=True)
    each = log_probabilities(model, keys >> 20, keys & 0xFFFFF) if len(keys) else np.empty(0)
    return np.bincount(np.repeat(np.arange(len(sizes)), sizes), each[which], len(sizes))


def _scores(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for windows, n, ids in _held(batches, 1, len(model.rank) - 1, min(2 * GROUP, FLUSH)):
        total = likelihoods(model, windows, n)
        at = 0
        for part in ids:
            some, sums = n[at : at + len(part)], total[at : at + len(part)]
            at += len(part)
            yield pa.RecordBatch.from_arrays([part, pa.array(some), pa.array(sums), pa.array(np.exp(-sums / np.maximum(some, 1)))], ["doc_id", "n_tokens", "log_likelihood", "perplexity"])


def score(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, log_likelihood and perplexity of each document under a network trained on all of them.

    docs: doc_id and text; other columns are not read. A null or empty text has no tokens, the log-likelihood 0 and the perplexity 1.
    A very long text is scored whole. Repeated rows and null ids get rows of their own; repeats count as often as they stand there. No rows: none.
    """
    ids = cut(encoded(docs, tokenizer))
    shared = docs.sparkSession.sparkContext.broadcast(fit(ids, vocabulary(tokenizer)))  # 15 MB at any size of corpus
    kind = docs.schema["doc_id"].dataType.simpleString()
    return ids.mapInArrow(lambda b: _scores(b, shared.value), f"doc_id {kind}, n_tokens long, log_likelihood double, perplexity double")
