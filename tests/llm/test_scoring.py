"""The token network against counting, a plain forward pass, numeric slopes, and count models on held-out texts."""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from flowlaw.llm import scoring, tokens

from .fixtures import empty, frame, rows

PATH = tokens.byte_bpe_50k()
EDGE = scoring.vocabulary(PATH)


def plain_probability(model, left, right, token):
    """One token's probability, by the definition."""
    a, b, member, top, layer = model.parts
    h = np.tanh(a[model.rank[left], :-1].astype(float) + b[model.rank[right], :-1] + layer[0, :-1])
    share = lambda rows: (lambda e: e / e.sum())(np.exp(rows[:, :-1] @ h + rows[:, -1]))
    place = int(model.rank[token])
    k = int(np.searchsorted(model.bounds, place, side="right")) - 1
    lo, hi = model.bounds[k], model.bounds[k + 1]
    return share(top.astype(float))[k] * share(member[lo:hi].astype(float))[place - lo]


def small_model(seed=0, size=40):
    rng = np.random.default_rng(seed)
    scoring_counts = np.sort(rng.integers(0, 200, size))[::-1].copy()
    model = scoring.fresh(scoring_counts, 5)
    net = model.net.astype(np.float64) + rng.normal(0, 0.5, model.net.shape)
    return scoring.Model(model.rank, model.bounds, net)


def test_counts_and_scores(spark, monkeypatch):
    docs = frame(spark).cache()
    monkeypatch.setattr(scoring, "PASSES", 2)
    ids = scoring.encoded(docs, PATH)
    own = tokens.Tokens(PATH)
    texts = [own.encode(r[1] or "").tolist() for r in rows()]
    want = Counter()
    for t in texts:
        wide = [EDGE, *t, EDGE]
        want.update(((wide[i - 1] << 20 | wide[i + 1]), wide[i]) for i in range(1, len(wide) - 1))
    assert {(r.context, r.token): r.n for r in scoring.window_counts(ids, EDGE).collect()} == want
    model = scoring.fit(ids, EDGE)
    found = [x for b in scoring._scores(ids.toArrow().to_batches(), model) for x in zip(*(c.to_pylist() for c in b.columns[:3]))]
    assert len(found) == len(rows())
    by_text = {r[0]: t for r, t in zip(rows(), texts)}
    for doc, n, total in found:
        if doc is not None:
            t = by_text[doc]
            assert n == len(t)
            if n < 500:  # the plain pass is slow
                want = sum(np.log(plain_probability(model, *key)) for key in zip([EDGE, *t], [*t[1:], EDGE], t))
                assert abs(total - want) < 1e-3 * max(1, abs(want))
    scored = scoring.score(docs, PATH)
    assert scored.columns == ["doc_id", "n_tokens", "log_likelihood", "perplexity"] and scored.count() == len(rows())
    assert {(r.log_likelihood, r.perplexity) for r in scored.filter("n_tokens = 0").collect()} == {(0.0, 1.0)}
    assert scoring.score(empty(spark), PATH).count() == 0


def test_blocks_do_not_matter(spark, monkeypatch):
    """Texts are grouped by their tokens; where groups end changes nothing."""
    ids = scoring.encoded(frame(spark), PATH).toArrow().to_batches()
    model = scoring.fresh(np.ones(EDGE, np.int64))
    out = []
    for flush in (1, 50, 1 << 21):
        monkeypatch.setattr(scoring, "FLUSH", flush)
        out.append([x for b in scoring._scores(iter(ids), model) for x in zip(*(c.to_pylist() for c in b.columns))])
    assert len(out[0]) == len(rows()) and [x[:2] for x in out[0]] == [x[:2] for x in out[1]] == [x[:2] for x in out[2]]
    assert np.allclose([x[2] for x in out[0]], [x[2] for x in out[2]], rtol=1e-5)


def test_counts_are_handed_over_in_small_batches():
    """Windows of a million tokens: all counted, few rows at once, and little memory beside those that are held."""
    ids = np.random.default_rng(3).integers(0, EDGE, 1_200_000).astype("<u4")
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([ids.tobytes(), ids.tobytes()], pa.binary())], ["doc_id", "ids"])
    found = list(scoring._counts(iter([batch]), EDGE))
    assert max(b.num_rows for b in found) <= 1 << 16
    keys, n = (np.concatenate(x) for x in zip(*[(b.column(0).to_numpy() << 20 | b.column(1).to_numpy(), b.column(2).to_numpy()) for b in found]))
    want, counts = np.unique(scoring.packed(ids, EDGE), return_counts=True)
    assert (keys == want).all() and (n == 2 * counts).all()


def test_training_in_blocks(spark, monkeypatch):
    """Each block of windows is taken equally often, however the windows arrive, and two runs make the same network."""
    ids = scoring.encoded(frame(spark), PATH).cache()
    windows = scoring.window_counts(ids, EDGE).toArrow()
    model, taken = scoring.fresh(np.ones(EDGE, np.int64)), []
    monkeypatch.setattr(scoring, "STEP", 64)
    monkeypatch.setattr(scoring, "BLOCK", 3)
    step = scoring.Descent.step

    def counted(self, contexts, tokens, n, rate):
        taken.append((len(tokens), hash(contexts.tobytes() + tokens.tobytes())))
        return step(self, contexts, tokens, n, rate)

    monkeypatch.setattr(scoring.Descent, "step", counted)
    moved = []
    for size in (50, 64, 1000):
        taken.clear()
        out = list(scoring._moves(iter(windows.to_batches(max_chunksize=size)), model, 3, 0.1))
        assert set(Counter(taken).values()) == {3} and sum(n for n, _ in taken) == 3 * windows.num_rows
        assert [x for x, _ in taken[:9]] == [x for x, _ in taken[:3]] * 3
        moved.append(b"".join(b"".join(b.column(2).to_pylist()) for b in out))
    assert moved[0] == moved[1] == moved[2]
    nets = [scoring.fit(ids, EDGE).net for _ in range(2)]
    assert np.allclose(*nets, atol=1e-5)


def test_probabilities_sum_to_one():
    model = small_model()
    for left, right in ((3, 7), (40, 40), (0, 12)):
        got = np.exp(scoring.log_probabilities(model, np.full(40, left << 20 | right), np.arange(40)))
        assert abs(got.sum() - 1) < 1e-6
        assert np.allclose(got, [plain_probability(model, left, right, t) for t in range(40)], atol=1e-6)


def test_gradient():
    model, rng = small_model(1), np.random.default_rng(1)
    contexts = np.sort(rng.integers(0, 41, 60) << 20 | rng.integers(0, 41, 60) % 3)
    token, n = rng.integers(0, 40, 60), rng.integers(1, 9, 60).astype(float)
    _, found, mass = scoring.gradient(model, contexts, token, n)
    assert not found[mass == 0].any()
    for row, column in [(int(r), int(c)) for r, c in zip(rng.choice(np.flatnonzero(mass), 80), rng.integers(0, 6, 80))]:
        kept, losses = model.net[row, column], []
        for step in (1e-4, -1e-4):
            model.net[row, column] = kept + step
            losses.append(scoring.gradient(model, contexts, token, n)[0])
        model.net[row, column] = kept
        assert abs((losses[0] - losses[1]) / 2e-4 - found[row, column]) < 1e-4


def test_both_sides_beat_counts(spark):
    """Held-out perplexity: below that of the tokens' counts, and of pairs of tokens smoothed by them."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    fit_on, held = (scoring.encoded(table.filter(F.expr(f"doc_id % 10 {sign} 0")), PATH) for sign in ("<>", "="))
    model = scoring.fit(fit_on, EDGE)
    windows = lambda df: np.concatenate([scoring.packed(np.frombuffer(r.ids, "<u4"), EDGE) for r in df.collect()])
    seen, test = windows(fit_on), windows(held)
    count = np.bincount(seen & 0xFFFFF, minlength=EDGE) + 1.0
    unigram = count / count.sum()
    pairs, n = np.unique(seen >> 40 << 20 | seen & 0xFFFFF, return_counts=True)
    before = np.bincount(seen >> 40, minlength=EDGE + 1)
    key = test >> 40 << 20 | test & 0xFFFFF
    at = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
    bigram = (np.where(pairs[at] == key, n[at], 0) + 50 * unigram[test & 0xFFFFF]) / (before[test >> 40] + 50)
    ours = -scoring.likelihoods(model, test, [len(test)])[0] / len(test)
    assert ours < -np.log(bigram).mean() - 0.5 and ours < -np.log(unigram[test & 0xFFFFF]).mean() - 2
