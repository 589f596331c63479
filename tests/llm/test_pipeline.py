"""The corpus pipeline against brute force over its stages, and the loss bound of its near-duplicate stage."""

import hashlib
import random
import tempfile
from collections import defaultdict
from math import comb

import pytest

import corpus_pipeline
from tracequarry.llm import near_dedup, toxicity

from . import brute
from .test_operators import labelled, tokenizer  # noqa: F401


def near_copies(r):
    """Texts of 100 words: copies with two words changed (similarity 0.81) and with three (0.73)."""
    out = []
    for g in range(12):
        w = [f"q{r.randrange(10**6)}" for _ in range(100)]
        copy = list(w)
        for at in (30, 60) if g % 2 else (20, 50, 80):
            copy[at] = f"y{r.randrange(10**6)}"
        out += [" ".join(w), " ".join(copy)]
    return out


def corpus():
    r = random.Random(11)
    docs, _, _ = labelled_texts()
    for t in near_copies(r):
        docs.append((1000 + len(docs), t))
    shared = "A line that many rows share, word for word, and long enough."
    for i in range(6):
        docs.append((2000 + i, f"{' '.join(f'l{r.randrange(10**6)}' for _ in range(30))}\n{shared}"))
    passage = " ".join(f"b{i}" for i in range(40))
    docs.append((3000, f"some words before {passage} and after"))
    return docs, [(1, passage), (2, "nothing of this is anywhere")]


def labelled_texts():
    class NoFrame:
        def createDataFrame(self, rows, schema):  # noqa: N802
            return Kept(rows)

    class Kept(list):
        def repartition(self, n):
            return self

    docs, frame, labels = labelled(NoFrame())
    return list(docs), frame, labels


def kept_lines(docs, min_rows=5, min_chars=40):
    key = lambda x: x.strip(brute.WHITE).lower()
    holders = defaultdict(set)
    for d, t in docs:
        for x in brute.raw(t).split(b"\n"):
            if len(key(x).decode()) >= min_chars:
                holders[key(x)].add(d)
    keep = lambda d, x: len(holders.get(key(x), ())) < min_rows or max(holders[key(x)]) == d
    return [(d, t if t is None else b"\n".join(x for x in brute.raw(t).split(b"\n") if keep(d, x)).decode()) for d, t in docs]


def test_pipeline(spark, tokenizer):  # noqa: F811
    docs, items = corpus()
    _, _, labels = labelled_texts()
    made = tempfile.mkdtemp(prefix="spark-")
    df = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    marks = spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int")
    for name, x in (("documents", df), ("labels", marks), ("benchmark", spark.createDataFrame(items, "item_id long, text string"))):
        x.write.parquet(f"{made}/{name}.parquet")
    toxic = {r.doc_id for r in toxicity.scored(df, marks).where("predicted = 1").select("doc_id").collect()}
    left = kept_lines([x for x in docs if x[0] not in toxic])
    near = brute.near_dedup(left, 80)
    assert {d for d in near if not near[d][2]} != {d for d, v in brute.near_dedup(left, 85).items() if not v[2]}
    left = [x for x in left if near[x[0]][2]]
    hit = {x[0] for x in brute.overlaps([x for x in left if x[0] >= 900], items)}
    assert hit == {3000}
    want = {}
    for d, t in left:
        if d not in hit:
            ids = tokenizer[2].encode_ordinary(t or "")
            want[d] = (len(ids), ids, hashlib.sha256(brute.raw(t)).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids, r.decoded_sha256) for r in corpus_pipeline.run(spark, made).collect()}
    assert got == want


@pytest.mark.parametrize("percent", [40, 60, 75, 80, 85, 95, 100])
def test_loss_of_links(percent):
    """Fewer agreeing coordinates than asked for are rarer than one in a million at every similarity."""
    m, n, p = near_dedup.matches_of(percent), near_dedup.COORDINATES, percent / 100
    below = lambda k: sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k))
    assert below(m) < 1e-6 and (m == n or below(m + 1) >= 1e-6)
    assert percent != 85 or m == 16


def test_no_bound_no_result():
    with pytest.raises(ValueError):
        near_dedup.matches_of(20)
