"""Operator 6, toxicity by a bidirectional gated recurrent network with attention pooling.

A text is read as windows of words that overlap. A word's input is a vector of its own, if it was
frequent enough in the sample to have one, the log-odds of its presence in toxic texts of the sample, and the
mean of vectors of its character trigrams. Two gated recurrent layers read the window in either
direction, attention pools their states, and a text's score is that of its most toxic window,
calibrated on the sample.

The network is trained in numpy on a sample of labelled texts whose size is a parameter; scoring
is one pass over all texts without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = re.compile(r"[^\W_]+")
#: Words of a window, and words from a window's start to the next one's.
WINDOW, STEP = 32, 24
#: Windows of a text that are scored at once.
SEGMENT = 2048
HIDDEN, OWN, CHARS, BUCKETS = 8, 8, 8, 1 << 12
#: Labelled texts of each class that the sample holds at most, and words with a vector of their own.
SAMPLE, VOCABULARY = 2000, 20_000
#: Characters of a text in the sample, at most. Any text is scored whole.
LONGEST = 1 << 16
#: Texts of the sample in which a word must occur to get a vector of its own.
FREQUENT = 5
#: A score from which a text counts as toxic.
LIMIT = 0.7
#: One of so many labelled texts stands apart for calibration; the least and the largest slope of that.
APART, SLOPES = 3, (0.2, 2.0)
#: The power of a label's likelihood that weights a text in calibration.
TRUST = 0.7
GATES = 3 * HIDDEN
#: Texts whose windows are scored at once in training.
SCORED = 256
INPUT = OWN + 1 + CHARS


@dataclass
class Model:
    """words: number of each known word, from 1; 0 stands for others. odds: by that number. net: arrays by name."""

    words: dict[str, int]
    odds: np.ndarray
    net: dict[str, np.ndarray]
    slope: float = 1.0
    offset: float = 0.0


def words_of(text: str) -> list[str]:
    """Lower-case words; a text without any has one empty word."""
    return WORDS.findall(text.lower()) or [""]


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character trigrams of words between blanks, one after another, and where each word's start."""
    codes = np.frombuffer("".join(f" {w} \0" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 3
    ends = np.cumsum(sizes)
    h = codes[:-2] * np.uint64(0x9E3779B1) + codes[1:-1] * np.uint64(0x85EBCA77) + codes[2:] * np.uint64(0xC2B2AE3D)
    h ^= h >> np.uint64(15)
    buckets = (h * np.uint64(0x27D4EB2F) >> np.uint64(20)) % np.uint64(BUCKETS)
    inner = np.ones(len(codes), bool)
    inner[ends - 1] = inner[ends - 2] = inner[ends - 3] = False  # these reach over a word's end
    inner[ends[sizes == 3] - 3] = True  # but the empty word has one
    counts = np.maximum(sizes - 3, 1)
    inner = inner[: len(buckets)]
    return buckets[inner].astype(np.int64), np.cumsum(counts) - counts


def windows(n: int) -> np.ndarray:
    """Starts of the windows that cover n words."""
    return np.arange(0, max(n - WINDOW + STEP, 1), STEP)


def fresh(words: dict[str, int], odds: np.ndarray, seed: int) -> Model:
    rng = np.random.default_rng(seed)
    new = lambda *shape, scale=0.2: rng.normal(0, scale, shape).astype(np.float32)
    net = {"own": new(len(words) + 1, OWN, scale=0.05), "chars": new(BUCKETS, CHARS, scale=0.1), "attend": new(2 * HIDDEN), "out": new(2 * HIDDEN, scale=0.5), "out_bias": np.zeros(1, np.float32)}
    for way in ("fore", "back"):
        net |= {f"{way}_in": new(INPUT, GATES), f"{way}_state": new(HIDDEN, GATES), f"{way}_bias": np.zeros(GATES, np.float32)}
    net["own"][0] = 0
    return Model(words, odds.astype(np.float32), net)


def inputs(model: Model, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The input vectors of words; their numbers, trigram buckets and where each word's buckets start."""
    known = model.words.get
    numbers = np.array([known(w, 0) for w in words], np.int64)
    buckets, starts = trigrams(words)
    sizes = np.diff(np.append(starts, len(buckets)))
    chars = np.add.reduceat(model.net["chars"][buckets], starts) / sizes[:, None]
    return np.concatenate([model.net["own"][numbers], model.odds[numbers, None], chars], 1).astype(np.float32), numbers, buckets, starts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _run(net: dict[str, np.ndarray], way: str, projected: np.ndarray, grid: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States (steps, windows, HIDDEN) over the words of grid (steps, windows), and what the way back needs."""
    state, states, kept = np.zeros((grid.shape[1], HIDDEN), np.float32), np.empty((*grid.shape, HIDDEN), np.float32), []
    recur = net[f"{way}_state"]
    order = range(len(grid)) if way == "fore" else range(len(grid) - 1, -1, -1)
    for t in order:
        x = projected[grid[t]]
        gates = _sigmoid(x[:, : 2 * HIDDEN] + state @ recur[:, : 2 * HIDDEN])
        update, reset = gates[:, :HIDDEN], gates[:, HIDDEN:]
        new = np.tanh(x[:, 2 * HIDDEN :] + (reset * state) @ recur[:, 2 * HIDDEN :])
        if keep:
            kept.append((t, state, update, reset, new))
        state = state + update * (new - state)
        states[t] = state
    return states, kept


def _pool(net: dict[str, np.ndarray], states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    weight = np.where(mask, states @ net["attend"], -1e9)
    weight = np.exp(weight - weight.max(0))
    weight /= weight.sum(0)
    pooled = np.einsum("tb,tbh->bh", weight, states)
    return pooled @ net["out"] + net["out_bias"], pooled, weight


def logits(model: Model, vectors: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """The logit of each window of grid (steps, windows): rows of vectors, -1 where a window has ended."""
    net, out = model.net, []
    both = {way: np.vstack([vectors @ net[f"{way}_in"] + net[f"{way}_bias"], np.zeros((1, GATES), np.float32)]) for way in ("fore", "back")}
    for part in np.array_split(grid, max(1, grid.shape[1] // 1024), axis=1):
        states = np.concatenate([_run(net, way, both[way], part, False)[0] for way in ("fore", "back")], 2)
        out.append(_pool(net, states, part >= 0)[0])
    return np.concatenate(out)


def layout(texts: list[list[str]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, the grid of all texts' windows, and the text of each window."""
    number: dict[str, int] = {}
    add, found = number.setdefault, []
    for words in texts:
        found += [add(w, len(number)) for w in words]
    flat = np.array(found, np.int64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.cumsum(sizes) - sizes
    starts = [windows(n) for n in sizes.tolist()]
    text = np.repeat(np.arange(len(texts)), [len(s) for s in starts])
    at = np.concatenate(starts)
    grid = at + np.arange(WINDOW)[:, None]
    inside = grid < sizes[text]
    return list(number), np.where(inside, flat[np.minimum(grid + begins[text], len(flat) - 1)], -1), text


def segments(words: list[str], windows_each: int = SEGMENT) -> list[list[str]]:
    """Parts of a text whose windows together are the text's."""
    size = windows_each * STEP
    last = max(len(words) - (WINDOW - STEP), 1)
    return [words[i : i + size + WINDOW - STEP] for i in range(0, last, size)]


def highest(model: Model, texts: list[list[str]]) -> np.ndarray:
    """The logit of each text's most toxic window. Long texts are taken in parts, so that memory is bounded."""
    out, held, owner, size = np.full(len(texts), -np.inf), [], [], 0

    def settle() -> None:
        words, grid, part = layout(held)
        found = np.maximum.reduceat(logits(model, inputs(model, words)[0], grid), np.flatnonzero(np.diff(part, prepend=-1)))
        np.maximum.at(out, owner, found)

    for i, text in enumerate(texts):
        for segment in segments(text):
            held.append(segment)
            owner.append(i)
            size += len(segment)
            if size > 4 * SEGMENT * STEP:
                settle()
                held, owner, size = [], [], 0
    if held:
        settle()
    return out


def gradients(model: Model, words: list[str], grid: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """The mean cross-entropy of the windows and its gradients, by backpropagation through time."""
    net = model.net
    vectors, numbers, buckets, starts = inputs(model, words)
    both = {way: np.vstack([vectors @ net[f"{way}_in"] + net[f"{way}_bias"], np.zeros((1, GATES), np.float32)]) for way in ("fore", "back")}
    ran = {way: _run(net, way, both[way], grid, True) for way in both}
    states = np.concatenate([ran["fore"][0], ran["back"][0]], 2)
    logit, pooled, weight = _pool(net, states, grid >= 0)
    p = _sigmoid(logit)
    loss = -np.mean(np.where(labels > 0, np.log(p + 1e-7), np.log(1 - p + 1e-7)))
    d_logit = ((p - labels) / len(labels)).astype(np.float32)
    grad = {"out": pooled.T @ d_logit, "out_bias": d_logit.sum(keepdims=True)}
    d_pooled = d_logit[:, None] * net["out"]
    d_weight = np.einsum("bh,tbh->tb", d_pooled, states)
    d_attend = weight * (d_weight - (weight * d_weight).sum(0))
    grad["attend"] = np.einsum("tb,tbh->h", d_attend, states)
    d_states = weight[:, :, None] * d_pooled + d_attend[:, :, None] * net["attend"]
    d_vectors = np.zeros_like(vectors)
    for k, way in enumerate(both):
        recur, d_recur = net[f"{way}_state"], np.zeros_like(net[f"{way}_state"])
        d_projected, carry = np.zeros_like(both[way]), np.zeros((grid.shape[1], HIDDEN), np.float32)
        for t, state, update, reset, new in reversed(ran[way][1]):
            d = carry + d_states[t, :, k * HIDDEN : (k + 1) * HIDDEN]
            d_new = d * update * (1 - new * new)
            d_reset_state = d_new @ recur[:, 2 * HIDDEN :].T
            d_gates = np.concatenate([d * (new - state) * update * (1 - update), d_reset_state * state * reset * (1 - reset)], 1)
            d_recur[:, 2 * HIDDEN :] += (reset * state).T @ d_new
            d_recur[:, : 2 * HIDDEN] += state.T @ d_gates
            carry = d * (1 - update) + d_reset_state * reset + d_gates @ recur[:, : 2 * HIDDEN].T
            np.add.at(d_projected, grid[t], np.concatenate([d_gates, d_new], 1))
        d_projected = d_projected[:-1]  # the last row stands for what is behind a window's end
        grad |= {f"{way}_in": vectors.T @ d_projected, f"{way}_state": d_recur, f"{way}_bias": d_projected.sum(0)}
        d_vectors += d_projected @ net[f"{way}_in"].T
    grad["own"] = np.zeros_like(net["own"])
    np.add.at(grad["own"], numbers, d_vectors[:, :OWN])
    grad["own"][0] = 0
    sizes = np.diff(np.append(starts, len(buckets)))
    grad["chars"] = np.zeros_like(net["chars"])
    np.add.at(grad["chars"], buckets, np.repeat(d_vectors[:, OWN + 1 :] / sizes[:, None], sizes, 0))
    return float(loss), grad


def _pick(model: Model, texts: list[list[str]], labels: np.ndarray, rng: np.random.Generator) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The most toxic window of each text by now, and any other one of each text that is not toxic."""
    words, grid, text = layout(texts)
    score = np.concatenate([logits(model, inputs(model, some)[0], there) for some, there, _ in (layout(texts[i : i + SCORED]) for i in range(0, len(texts), SCORED))])
    first = np.flatnonzero(np.diff(text, prepend=-1))
    order = np.lexsort((-score, text))
    best = order[first]
    sizes = np.diff(np.append(first, len(text)))
    other = first + rng.integers(0, sizes)
    chosen = np.concatenate([best, other[labels == 0]])
    return words, grid[:, chosen], np.concatenate([labels, np.zeros(int((labels == 0).sum()))])


def train(texts: list[str], labels: list[int], seed: int = 6, apart: int = APART, **how: float) -> Model:
    """A model of labelled texts. Scores are calibrated as if as many texts were toxic as not.

    Every apart-th text of each class stands apart from a first model, and its scores there calibrate the last one, which is
    trained on all texts: on texts that it has seen, a network is surer than elsewhere. With less than two of a class apart, scores are left as they are.
    """
    one: dict[str, str] = {}  # a word is held once, however often it occurs
    split, y = [[one.setdefault(w, w) for w in words_of(t)] for t in texts], np.array(labels, np.float32)
    place = np.zeros(len(y), int)
    for k in (0, 1):
        place[y == k] = np.arange((y == k).sum())
    out = place % apart == apart - 1
    model = learnt(split, y, seed, **how)
    if not (y == 0).any() or not (y == 1).any():
        model.slope, model.offset = 0.0, float(np.log(((y == 1).sum() + 0.5) / ((y == 0).sum() + 0.5)))
    elif min((y[out] == 0).sum(), (y[out] == 1).sum()) > 1:
        first = learnt([w for w, o in zip(split, out) if not o], y[~out], seed, **how)
        model.slope, model.offset = calibrated(highest(first, [w for w, o in zip(split, out) if o]), y[out])
    else:
        model.slope, model.offset = 1.0, 0.0
    return model


def learnt(split: list[list[str]], y: np.ndarray, seed: int = 6, passes: int = 2, epochs: int = 3, batch: int = 128, rate: float = 0.01, steps: int = 150, decay: float = 1e-3) -> Model:
    """A network trained on texts, as words, and their labels.

    A pass takes that many epochs over its windows, or as many as make up steps; decay draws words' own vectors to zero.
    """
    seen = {k: Counter(w for words, x in zip(split, y) if x == k for w in set(words)) for k in (0, 1)}
    totals = {k: int((y == k).sum()) for k in (0, 1)}
    rank = sorted((w for w in seen[0] | seen[1] if seen[0][w] + seen[1][w] >= FREQUENT and w), key=lambda w: (-seen[0][w] - seen[1][w], w))[:VOCABULARY]
    number = {w: i + 1 for i, w in enumerate(rank)}
    chance = lambda w, k: (seen[k][w] + 0.5) / (totals[k] + 1)
    odds = np.array([0.0, *(np.log(chance(w, 1)) - np.log(chance(w, 0)) for w in rank)])
    model, rng = fresh(number, np.clip(odds, -6, 6) / 3, seed), np.random.default_rng(seed)
    if not totals[0] or not totals[1]:
        return model
    # At first a window is as toxic as its words' odds.
    model.net["fore_in"][OWN, 2 * HIDDEN :] = 1.0
    model.net["out"][:HIDDEN] = np.abs(model.net["out"][:HIDDEN])
    mean, square = ({k: np.zeros_like(v) for k, v in model.net.items()} for _ in range(2))
    step = 0
    for _ in range(passes):
        words, grid, target = _pick(model, split, y, rng)
        for _ in range(max(epochs, -(-steps * batch // len(target)))):
            for part in np.array_split(rng.permutation(len(target)), max(1, len(target) // batch)):
                step += 1
                used, local = np.unique(grid[:, part], return_inverse=True)
                local = local.reshape(WINDOW, -1)
                if used[0] < 0:
                    used, local = used[1:], local - 1
                for k, g in gradients(model, [words[i] for i in used], local, target[part])[1].items():
                    if k in ("own", "chars"):
                        g += decay * model.net[k]
                    mean[k] += 0.1 * (g - mean[k])
                    square[k] += 0.01 * (g * g - square[k])
                    model.net[k] -= (rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return model


def calibrated(score: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through the scores, with both kinds of texts weighing the same; by Newton steps.

    Labels are drawn a little to the middle, as for one more text of either kind, and the slope stays within SLOPES, so that scores neither tie nor turn.
    A text counts the less, the less likely its label is by the curve so far: a few texts whose words tell nothing of their label would flatten the curve for all others.
    """
    toxic = labels > 0
    weight = np.where(toxic, 0.5 / max(toxic.mean(), 1e-9), 0.5 / max((~toxic).mean(), 1e-9))
    aim = np.where(toxic, (toxic.sum() + 1) / (toxic.sum() + 2), 1 / ((~toxic).sum() + 2))
    x, beta = np.stack([score, np.ones_like(score)], 1).astype(np.float64), np.array([0.5, 0.0])
    for _ in range(200):
        p = np.exp(-np.logaddexp(0, -(x @ beta)))
        trusted = weight * np.where(toxic, p, 1 - p) ** TRUST
        gradient = x.T @ (trusted * (p - aim)) + 1e-3 * beta
        curve = (x * (trusted * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        beta -= np.clip(np.linalg.solve(curve, gradient), -0.5, 0.5)
        beta[0] = min(max(beta[0], SLOPES[0]), SLOPES[1])
    return float(beta[0]), float(beta[1])


def held_out(doc_id: Column) -> Column:
    """Whether a document's labels may not be learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, longest: int = LONGEST) -> tuple[list[str], list[int], float]:
    """Texts and labels of at most so many documents of each class, and the share of toxic ones among all labels that are not held out.

    Labels are chosen by a hash of their doc_id among those that have such a text, and none that is held out. Their texts of more than longest characters take no part, so that what
    comes to the driver is at most 2 * rows * longest characters. A doc_id with several texts gives the first of them, however often it
    stands there; one with both labels is an item of each class.
    """
    short = docs.select("doc_id", "text").filter(F.char_length("text") <= longest)
    open_ = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    n = {r["toxic"]: r["count"] for r in open_.groupBy("toxic").count().collect()}
    order = F.xxhash64("doc_id", F.lit(6))
    met = open_.join(short.select("doc_id"), "doc_id", "left_semi")  # ids alone are shuffled
    some = [met.filter(F.col("toxic") == k).orderBy(order, "doc_id").limit(rows) for k in (0, 1)]
    chosen = F.broadcast(some[0].union(some[1]))  # 2 * rows ids
    texts = short.join(chosen, "doc_id")
    one = texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).limit(2 * rows)
    found = one.toPandas().sort_values(["doc_id", "toxic"])
    return found["text"].tolist(), found["toxic"].tolist(), n.get(1, 0) / max(sum(n.values()), 1)


def _scored(batches: Iterator[pa.RecordBatch], model: Model, text: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of the batches with their rows' scores; text is the column's place. The number of windows at once is bounded."""
    for batch in batches:
        for i in range(0, batch.num_rows, 128):
            part = batch.slice(i, 128)
            top = highest(model, [words_of(t or "") for t in part.column(text).to_pylist()]).astype(np.float64)
            yield part, np.exp(-np.logaddexp(0, -(model.slope * top + model.offset)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each document.

    A null text is an empty one, and has a score, too. A text of any length is scored whole, part by part. Repeated rows and null
    ids get rows of their own; other columns are not read. No rows: none.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as large as the vocabulary allows, 3 MB

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _scored(batches, shared.value, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found)], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(task, f"doc_id {kind}, score double")


def keep_clean(docs: DataFrame, model: Model, limit: float = LIMIT) -> DataFrame:
    """docs, with all its columns in their order, less the rows that score the limit or more.

    Rows are judged one by one by their text alone: null texts as empty ones, repeated rows alike, null ids like others, long texts
    whole. No rows: none.
    """
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _scored(batches, shared.value, at):
            yield part.filter(pa.array(found < limit))

    return docs.mapInArrow(task, docs.schema)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Model:
    return train(*sample(docs, labels, rows)[:2])


def judged(docs: DataFrame, labels: DataFrame, limit: float = LIMIT) -> DataFrame:
    """doc_id, held_out, score and predicted for each document.

    docs: doc_id and text; labels: doc_id and toxic. Labels that are null, or of no document, are not
    used; without labels of both classes all scores are equal. Repeated rows get rows of their own; a
    null doc_id is not held out. No documents: no rows.
    """
    found = score(docs, fit(docs, labels))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))
