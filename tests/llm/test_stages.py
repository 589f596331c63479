"""Each stage of the pipeline by itself: null, repeated and shared ids, null, empty and long texts, ties, repeated rows,
empty tables, and columns named as the operators' own."""

import random
import tempfile
from collections import Counter

import pytest

import corpus_pipeline
from tracequarry.llm import near_dedup, toxicity

from . import brute
from .test_byte_bpe import tokenizer  # noqa: F401
from .test_classifiers import labelled_rows

CLASHES = ["predicted", "score", "held_out", "n_lines", "n_dropped", "kept_text", "key", "tag", "row", "marks", "contaminated", "first_id", "n_overlaps", "component_id"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)
STAGES = dict(corpus_pipeline.STAGES)
LINE = "A line that many rows share, word for word, and long enough."


@pytest.fixture(scope="module")
def folder(spark):
    _, _, labels = labelled_rows()
    made = tempfile.mkdtemp(prefix="spark-")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{made}/labels.parquet")
    r = random.Random(71)
    passage = " ".join(f"b{r.randrange(400)}" for _ in range(40))
    spark.createDataFrame([(1, passage), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{made}/benchmark.parquet")
    return made, passage


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), *CLASHES) for d, t in docs], SCHEMA).repartition(3)


def seen(df):
    assert df.columns == [x.split()[0] for x in SCHEMA.split(", ")]
    out = Counter()
    for r in df.collect():
        assert tuple(r[5:]) == tuple(CLASHES)
        out[r.doc_id, r.text, r.n_chars] += 1
    return out


def rows(docs):
    return Counter((d, t, len(t or "")) for d, t in docs)


def plain():
    r = random.Random(72)
    say = lambda n: " ".join(f"p{r.randrange(10**6)}" for _ in range(n))
    return [(None, None), (None, ""), (None, say(30)), (None, say(31)), (4, None), (4, ""), (4, say(20)), (4, say(21)), (9, say(50_000)), (2**40, "one")], say


@pytest.mark.parametrize("name", list(STAGES))
def test_empty_table(spark, folder, tokenizer, name):  # noqa: F811
    out = STAGES[name](spark, frame(spark, []), folder[0])
    assert out.count() == 0 and (name == "byte_bpe" or out.columns == [x.split()[0] for x in SCHEMA.split(", ")])


def test_toxicity(spark, folder):
    docs, _ = plain()
    learned, _, _ = labelled_rows()
    bad, good = learned[0][1], learned[1][1]
    docs += [*learned, (None, bad), (None, good), (5, bad), (5, good), (5, bad)]
    marks = spark.read.parquet(f"{folder[0]}/labels.parquet")
    toxic = {r.row.text for r in toxicity.scored(frame(spark, docs), marks, carry=True).where("predicted = 1").collect()}
    assert bad in toxic and good not in toxic
    assert seen(STAGES["toxicity"](spark, frame(spark, docs), folder[0])) == rows([x for x in docs if x[1] not in toxic])


def test_line_dedup(spark, folder):
    docs, say = plain()
    shared = [(d, f"{say(3)}\n {LINE.upper()} \n{LINE}") for d in (None, None, 4, 4, 5, 6, 6)] + [(3, f"{LINE[:-1]}!")] * 4
    docs += shared
    holders = [d for d, _ in shared[:7]]
    keeper = max(d for d in holders if d is not None)
    want = rows(x for x in docs if x not in shared[:7])
    for d, t in shared[:7]:
        left = t if d == keeper else t.split("\n")[0]
        want[d, left, len(left)] += 1
    assert seen(STAGES["line_dedup"](spark, frame(spark, docs), folder[0])) == want


def test_near_dedup(spark, folder):
    docs, say = plain()
    base = say(100).split()
    vary = lambda k: " ".join(f"x{i}" if i < k else w for i, w in enumerate(base))
    near = [(None, vary(1)), (None, vary(2)), (4, vary(0)), (4, vary(0)), (4, vary(3)), (77, vary(8))]
    lone = say(60)
    docs += [*near, (50, lone), (50, lone), (51, lone), (8, "few words"), (8, "Few words")]
    assert {c for _, c, _ in brute.near_dedup([(i, t) for i, (_, t) in enumerate(near)], 80).values()} == {0}
    got = seen(STAGES["near_dedup"](spark, frame(spark, docs), folder[0]))
    assert sum(got[d, t, len(t)] for d, t in set(near)) == 1 and got.total() == len(docs) - 5 - 2 - 1
    assert got[None, vary(1), len(vary(1))] + got[None, vary(2), len(vary(2))] == 1  # a null id sorts first
    assert got[50, lone, len(lone)] == 1 and not got[51, lone, len(lone)]
    assert rows(plain()[0]) <= got


def test_near_dedup_loses_nothing_else(spark, folder):
    r = random.Random(73)
    docs = []
    for i in range(40):
        w = [f"n{r.randrange(10**6)}" for _ in range(80)]
        docs.append((r.choice([None, 1, 2, i]), " ".join(w)))
        for _ in range(r.randrange(3)):
            w[r.randrange(80)] = f"y{r.randrange(10**6)}"
            docs.append((r.choice([None, 1, 2, i]), " ".join(w)))
    groups = {c for _, c, _ in brute.near_dedup([(i, t) for i, (_, t) in enumerate(docs)], 80).values()}
    assert STAGES["near_dedup"](spark, frame(spark, docs), folder[0]).count() == len(groups)


def test_decontaminate(spark, folder):
    docs, say = plain()
    bad = [(None, f"{say(2)} {folder[1]}"), (4, folder[1]), (4, f"x {folder[1]} y"), (5, folder[1]), (5, folder[1])]
    assert seen(STAGES["decontaminate"](spark, frame(spark, docs + bad), folder[0])) == rows(docs)


def test_tokens(spark, folder, tokenizer):  # noqa: F811
    docs, _ = plain()
    out = STAGES["byte_bpe"](spark, frame(spark, docs), folder[0]).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in out) == Counter((d, tuple(tokenizer[2].encode_ordinary(t or ""))) for d, t in docs)


def test_threshold_of_the_stage():
    assert near_dedup.matches_of(80) == 13
