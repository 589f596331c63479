"""The folded tables of the classifiers against explicit kernels and plain loops, and rows and labels out of the usual."""

import itertools
import math
import random

import numpy as np

from tracequarry.llm import quality, toxicity
from tracequarry.llm.wordhash import Words

from .test_operators import labelled


def kernel(a: bytes, b: bytes) -> float:
    """Byte triples in order within five bytes, weighted by 2 ** (3 - span), over both words' norms."""

    def triples(w):
        out = {}
        kinds = [int(toxicity._KIND[c]) for c in w]
        for i, j, k in itertools.combinations(range(len(w)), 3):
            if k - i < 5:
                t = (kinds[i], kinds[j], kinds[k])
                out.setdefault(t, []).append(0.5 ** (k - i - 2))
        return out

    norm = lambda x: math.sqrt(sum(v * v for vs in x.values() for v in vs))
    x, y = triples(a), triples(b)
    total = sum(sum(x[t]) * sum(y[t]) for t in x if t in y)
    return total / (norm(x) * norm(y)) if x and y else 0.0


def training():
    docs, _, labels = labelled_rows()
    text = dict(docs)
    return [text[d].encode() for d, _, _ in labels], np.array([t for _, _, t in labels], bool)


def labelled_rows():
    class NoFrame:
        def createDataFrame(self, rows, schema):  # noqa: N802
            return Rows(rows)

    class Rows(list):
        def repartition(self, n):
            return self

    return labelled(NoFrame())


def bags(texts):
    data, off = np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])]
    return toxicity.word_counts(data, off)


def test_table_is_the_nystrom_machine():
    texts, toxic = training()
    model = toxicity.fit(bags(texts), toxic, landmarks=40)
    k = np.array([[kernel(a, b) for b in model.marks] for a in model.marks])
    value, vector = np.linalg.eigh(k)
    good = value > 1e-6 * value.max()
    root = (vector[:, good] / np.sqrt(value[good])) @ vector[:, good].T
    r = random.Random(61)
    words = ["".join(r.choice("abgkoprxz-.1é") for _ in range(r.randrange(1, 14))).encode() for _ in range(200)] + [b"zapgrok", b"z-a-p-grok", b"blixvod", b"to", b"\xff\xfe\xfd"]
    joined = b" ".join(words)
    found = toxicity.decisions(Words(np.frombuffer(joined, np.uint8), np.array([0, len(joined)])), model.table, model.bias)
    want = [float(np.array([kernel(w, m) for m in model.marks]) @ root @ model.weights) + model.bias for w in words]
    assert np.allclose(found, want, atol=2e-3)


def test_score_is_the_curve_of_the_pool():
    texts, toxic = training()
    model = toxicity.fit(bags(texts), toxic)
    cases = [*texts[:20], b"", b" \n", b"zapgrok", b"zapgrok zapgrok to to to", b"plain " * 4000 + b"blixvod"]
    off = np.r_[0, np.cumsum([len(t) for t in cases])]
    found = model.score(np.frombuffer(b"".join(cases), np.uint8), off)
    for t, s in zip(cases, found, strict=True):
        f = [float(toxicity.decisions(Words(np.frombuffer(w, np.uint8), np.array([0, len(w)])), model.table, model.bias)[0]) for w in t.lower().split()]
        n = len(f)
        hit0, hit1 = sum(x > 0 for x in f), sum(x > 0.7 for x in f)
        pool = [min(2, max(-2, max(f))), math.log1p(hit0), math.log1p(hit1), math.sqrt(hit0 / n), math.sqrt(hit1 / n), math.log1p(n) / 5] if n else [-2, 0, 0, 0, 0, 0]
        assert math.isclose(s, 1 / (1 + math.exp(-(sum(a * b for a, b in zip(pool, model.curve, strict=False)) + model.curve[-1]))), rel_tol=1e-4, abs_tol=1e-6)


def test_additive_scores_are_table_sums():
    texts, _ = training()
    off = np.r_[0, np.cumsum([len(t) for t in texts])]
    x = quality.text_features(np.frombuffer(b"".join(texts), np.uint8), off)
    y = np.array([d % 3 > 0 for d in range(len(texts))], float)
    model = quality.fit(x, y, rounds=30)
    assert len(model.pairs) == quality.PAIRS and any(t.any() for _, _, t in model.pairs)
    found = model.score(x)
    for row, s in zip(x, found, strict=True):
        bins = [sum(c <= v for c in cuts) for v, cuts in zip(row, model.cuts, strict=True)]
        raw = model.base + sum(t[b] for t, b in zip(model.single, bins, strict=True))
        coarse = [b * quality.PAIR_BINS // (len(c) + 1) for b, c in zip(bins, model.cuts, strict=True)]
        raw += sum(t[coarse[i], coarse[j]] for i, j, t in model.pairs)
        assert math.isclose(s, 1 / (1 + math.exp(-raw)), rel_tol=1e-9)


def test_rows_and_labels(spark):
    """Null and repeated ids, repeated and conflicting labels, columns named as the results are, empty tables."""
    docs, _, _ = labelled_rows()
    docs = [*docs, (None, "zapgrok blixvod zapgrok"), (None, docs[1][1]), (3, docs[0][1]), (3, docs[3][1]), (7, "word " * 60_000)] + [docs[5]] * 3
    df = spark.createDataFrame([(d, t, 0.5, 1, True) for d, t in docs], "doc_id long, text string, score double, predicted int, held_out boolean").repartition(3)
    marks = [(i, int(i % 3 > 0), int(i % 4 == 0)) for i in range(240)] + [(8, None, 0), (8, 2, None), (None, 1, 1), (16, 0, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    for op in (toxicity.scored, quality.scored):
        out = op(df, labels).collect()
        by_text = {}
        for r in op(df, labels.distinct()).collect():
            by_text.setdefault(r.doc_id, set()).add(round(r.score, 9))
        assert len(out) == len(docs) and all({round(r.score, 9)} <= by_text[r.doc_id] for r in out)
        assert not any(r.held_out for r in out if r.doc_id is None) and len(by_text[None]) == 2 and len(by_text[5]) == 1
        assert op(df.where("false"), labels).count() == 0
        none = {r.score for r in op(df, labels.where("false")).collect()}
        assert len(none) == 1
    kept = toxicity.scored(df, labels, carry=True).select("row.*")
    assert kept.columns == df.columns and kept.exceptAll(df).count() == 0 and kept.count() == len(docs)


def test_sample_is_bounded(spark):
    """A limit of labelled rows holds however often an id repeats."""
    df = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, "a"), (3, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, toxic int")
    import pyspark.sql.functions as F

    assert toxicity.labelled_sample(df, labels, "toxic", F.lit(True), 10).count() == 10
    assert toxicity.labelled_sample(df, labels, "toxic", F.lit(True), 100).count() == 52
