"""The language model: all rows train, scores equal a plain loop over tokens, probabilities sum to one, gradients are
those of the loss."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyspark.sql.functions as F

from tracequarry.llm import lm_score

from . import brute


def test_every_row_trains(spark, monkeypatch):
    texts = spark.createDataFrame([(i if i < 30 else None, f"a{i} b c " * 5) for i in range(40)], "doc_id long, text string").repartition(3)
    trained, settle = [], lm_score.settle

    def seen(df):
        out = settle(df)
        if df.columns == ["tokens", "weights"]:
            trained.append(sum(r.tokens for r in out.collect()))
        return out

    monkeypatch.setattr(lm_score, "settle", seen)
    lm_score.scored(texts, train=F.lit(True), fit_tokens=64).count()
    assert len(trained) == len(lm_score.RATES) and sum(trained) == 40 * 16  # dealt over the rounds


def made():
    r = random.Random(41)
    words = ["the", "of", "to"] * 20 + [f"{a}{b}" for a in ("run", "sing", "old", "wa") for b in ("ing", "er", "s", "ed", "")] + ["été", "X"]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.randrange(1, 90)))) for i in range(120)]
    docs += [(None, "the old runner"), (None, "the old runner"), (7, "of 12 unseen things"), (500, None), (501, ""), (502, "\n\t"), (503, "the " * 5000), (10**12, "a b c d zz")]
    return docs


def plain_scores(docs, classes, p, state):
    """Token by token, in plain numbers: counts from the rows themselves, the unit's equations one step at a time."""
    tokens = [[*brute.raw(t).lower().split(), lm_score.END] for _, t in docs]
    trains = [d is None or zlib.crc32(str(d).encode()) % 10 != 0 for d, _ in docs]
    counts = Counter(w for t, yes in zip(tokens, trains, strict=True) if yes for w in t)
    others = Counter()
    for w, c in counts.items():
        cls, place = classes.of_word(w)
        if place == 0:
            others[cls] += c + 0.1
    sizes, first = classes.sizes, np.r_[0, np.cumsum(classes.sizes)]
    soft = lambda y: np.exp(y - y.max()) / np.exp(y - y.max()).sum()
    sigmoid = lambda y: 1 / (1 + np.exp(-y))
    p = {k: w.astype(float) for k, w in p.items()}
    out = []
    for t in tokens:
        h, before, total = np.zeros(state), classes.size, 0.0
        for w in t:
            gate = sigmoid(p["g"][:, before] + p["u"] @ h)
            z, r = gate[:state], gate[state:]
            h = (1 - z) * h + z * np.tanh(p["i"][:, before] + p["c"] @ (r * h))
            c, k = classes.of_word(w)
            total += math.log10(soft(p["o"] @ h + p["b"])[c])
            if sizes[c] > 1:
                cut = slice(first[c], first[c + 1])
                total += math.log10(soft(p["w"][cut] @ h + p["d"][cut])[k])
            if k == 0 and c != classes.end and w not in classes.own:
                total += math.log10((counts[w] + 0.1) / (others[c] + 0.1))
            before = c
        out.append(total)
    return out


def test_scores_equal_a_plain_loop(spark, monkeypatch):
    docs = made()
    kept = []
    one_round = lm_score._round

    def keep(texts_, classes, weights, *rest):
        out = one_round(texts_, classes, weights, *rest)
        kept.append((classes, out))
        return out

    monkeypatch.setattr(lm_score, "_round", keep)
    monkeypatch.setattr(lm_score, "OWN_CLASSES", 2)
    monkeypatch.setattr(lm_score, "END_CLASSES", 3)
    monkeypatch.setattr(lm_score, "MEMBERS", 3)
    for head in (5, 1000):
        df = spark.createDataFrame([(d, t, "a", 1, 2.0, True) for d, t in docs], "doc_id long, text string, word string, n int, score double, held_out boolean").repartition(2)
        got = {}
        for r in lm_score.scored(df, head_words=head, fit_tokens=2000).collect():
            got.setdefault((r.doc_id, r.n_tokens), []).append(r.score)
        want = {}
        for (d, t), s in zip(docs, plain_scores(docs, *kept[-1], lm_score.STATE), strict=True):
            want.setdefault((d, len(brute.raw(t).split()) + 1), []).append(s)
        assert got.keys() == want.keys()
        assert all(np.allclose(sorted(got[k]), sorted(want[k]), rtol=2e-4, atol=2e-4) for k in want)


def test_probabilities_sum_to_one():
    words = [b"the", b"of", b"singing", b"running", b"ring", b"old", b"cold", b"x", b"yy"]
    counts = {w: 20 - i for i, w in enumerate(words)}
    classes = lm_score.ClassMap(words[:1], [lm_score.ending(b"ng"), lm_score.ending(b"ld")], words, most=2)
    assert classes.sizes == [1, 3, 3, 3, 1] and classes.of_word(b"ring") == (1, 0) and classes.of_word(b"new") == (3, 0) == (classes.rest, 0)
    g = lm_score.Gru(classes.sizes, 4)
    g.p["w"] += 0.3
    s = np.random.default_rng(1).standard_normal((4, 1)).astype(np.float32)
    of_class = g.class_probability(s)[:, 0]
    total = of_class[classes.end]
    for w in {*words, *(b"new" + bytes([c]) for c in b"abc")}:
        c, k = classes.of_word(w)
        inner = g.member_probability(c, s)[:, 0] if classes.sizes[c] > 1 else np.ones(1)
        others = [v for v, n in counts.items() if classes.of_word(v) == (c, 0)]
        share = 1.0 if k or c == 0 else (counts[w] + 0.1) / (sum(counts[v] + 0.1 for v in others) + 0.1) if w in counts else 0.0
        total += of_class[c] * inner[k] * share
    for c in (1, 2, 3):  # what is left in each class for words never seen
        others = [v for v in words if classes.of_word(v) == (c, 0)]
        total += of_class[c] * g.member_probability(c, s)[0, 0] * 0.1 / (sum(counts[v] + 0.1 for v in others) + 0.1)
    assert math.isclose(total, 1, rel_tol=1e-5)


def test_windows_and_learning():
    g = lm_score.Gru([1, 3, 1, 2, 1], 5)
    r = np.random.default_rng(4)
    texts = [np.stack([c := r.integers(0, 5, n), r.integers(0, np.array([1, 3, 1, 2, 1])[c])]) for n in (9, 1, 40, 200)]
    assert np.allclose(g.score(texts, window=4), g.score(texts, window=64), rtol=1e-4)
    assert np.allclose(g.score(texts, width=1), [g.score([t])[0] for t in texts], rtol=1e-4)
    before = g.score(texts).sum()
    g.fit([t.astype(np.int16) for t in texts] * 20, batch=4, epochs=5)
    assert g.score(texts).sum() > before


def test_gradients():
    """Against differences of the loss, with texts that begin inside the window."""
    r = np.random.default_rng(5)
    sizes = np.array([1, 3, 4, 1])
    g = lm_score.Gru(sizes.tolist(), 5)
    g.p = {k: w.astype(float) + 0.2 * r.standard_normal(w.shape) for k, w in g.p.items()}
    y = r.integers(0, 4, (6, 7))
    k, x = (r.random((6, 7)) * sizes[y]).astype(int), r.integers(0, 5, (6, 7))
    valid, h = (r.random((6, 7)) < 0.8).astype(float), 0.1 * r.standard_normal((5, 7))
    found, _ = g.gradients(x, y, k, valid, h)

    def loss():
        return -(g.log_likelihood(g.forward(x, h)[0], y, k) * valid).sum() / valid.sum()

    for name, w in g.p.items():
        for _ in range(10):
            at = tuple(int(r.integers(0, n)) for n in w.shape)
            old, e = w[at], 1e-5
            w[at] = old + e
            up = loss()
            w[at] = old - e
            down = loss()
            w[at] = old
            assert abs((up - down) / (2 * e) - found[name][at]) < 1e-7, name


def test_no_rows_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    out = {r.doc_id: r for r in lm_score.scored(df, train=F.lit(False)).collect()}
    assert out[1].n_known == 0 and out[1].train_tokens == 0 and out[2].n_tokens == 1 and all(math.isfinite(r.score) for r in out.values())


def test_one_long_text_makes_no_padding():
    """Windows hold the streams that go on: what is computed grows with tokens, not with streams times the longest text."""
    gru, seen = lm_score.Gru([1, 3], 4), []
    plain = gru.gradients

    def watched(x, y, k, valid, h):
        seen.append((x.size, int(valid.sum())))
        return plain(x, y, k, valid, h)

    gru.gradients = watched
    r = np.random.default_rng(5)
    texts = [np.stack([c := r.integers(0, 2, n), c * r.integers(0, 3, n)]) for n in [5000] + [20] * 50]
    gru.fit(texts, batch=32, window=16)
    tokens = sum(t.shape[1] for t in texts)
    assert sum(v for _, v in seen) == tokens
    assert sum(n for n, _ in seen) <= tokens + 32 * 16


def test_scores_do_not_depend_on_what_waits(spark):
    docs = spark.createDataFrame(made(), "doc_id long, text string").coalesce(1)
    one, many = ([tuple(r) for r in lm_score.scored(docs, score_tokens=n).orderBy("doc_id", "score").collect()] for n in (1, 10**6))
    assert len(one) == len(made())
    for a, b in zip(one, many, strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], abs_tol=1e-6) and math.isclose(a[6], b[6], rel_tol=1e-4)


def test_few_steps_of_the_class_softmax_are_held(monkeypatch):
    """Blocks of steps give what a whole window gives, and no more of them are held at once."""
    r = np.random.default_rng(3)
    sizes = [1, 4, 3]
    texts_ = [np.array([c := r.integers(0, 3, n), [r.integers(0, sizes[x]) for x in c]], np.int16) for n in (70, 33, 5, 1)]
    steps, whole = [], lm_score.Gru._class_weights
    monkeypatch.setattr(lm_score.Gru, "_class_weights", lambda self, s: (steps.append(len(s)), whole(self, s))[1])

    def outcome():
        g = lm_score.Gru(sizes, 4)
        g.fit(texts_, batch=3)
        return np.concatenate([w.ravel() for w in g.p.values()]), g.score(texts_)

    weights, scores = outcome()
    assert max(steps) <= 4
    monkeypatch.setattr(lm_score, "BLOCK", 10**6)
    again = outcome()
    assert np.allclose(weights, again[0], atol=1e-5) and np.allclose(scores, again[1], atol=1e-4)
