"""Passages of rows that share an id or have none, and of very long texts, against brute force."""

import random
from collections import Counter

import pytest
import xxhash

from tracequarry.llm import substring_dedup

from . import brute

NULL = -(2**63)


def place(doc, text):
    tag = xxhash.xxh64_intdigest(brute.raw(text), seed=42)
    return (NULL if doc is None else doc, tag - 2**64 if tag >= 2**63 else tag)


def expected(docs, window=20):
    """Rows by (id, hash of the text); what agrees in both is one document."""
    words = {place(d, t): brute.raw(t).split() for d, t in docs}
    first = {}
    for k in sorted(words):
        for i in range(len(words[k]) - window + 1):
            first.setdefault(tuple(words[k][i : i + window]), (k, i))
    out = Counter()
    for d, t in docs:
        k, w, gone = place(d, t), brute.raw(t).split(), set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] != (k, i):
                gone.update(range(i, i + window))
        out[d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()] += 1
    return out


def corpus():
    r = random.Random(21)
    say = lambda n: " ".join(f"w{r.randrange(500)}" for _ in range(n))
    w, x, passage = say(30), say(30), say(60)
    docs = [(1, w), (5, w), (5, x), (5, x), (None, say(25)), (None, say(400)), (None, say(31)), (None, f"{say(10)} {passage} {say(40)}"), (None, f"{passage} {say(5)}"), (None, None), (None, "")]
    docs += [(7, f"{say(3)} {passage}"), (7, f"{passage} {say(9)}"), (8, f"{passage} {passage}"), (8, ""), (9, say(80_000)), (10, "same " * 3000), (11, "same " * 40)]
    docs += [(20 + i, f"{say(i % 4)} {passage}") for i in range(60)] + [(3, w)] * 4
    return docs


@pytest.mark.parametrize("bits", [None, 64])
def test_shared_and_missing_ids(spark, bits):
    docs = corpus()
    df = spark.createDataFrame([(d, t, "a", 1, b"x") for d, t in docs], "doc_id long, text string, runs string, tag int, kept_text binary").repartition(3)
    out = substring_dedup.removed_passages(df, filter_bits=bits)
    assert Counter(map(tuple, out.select("doc_id", "n_words", "n_removed", "kept_text").collect())) == expected(docs)
