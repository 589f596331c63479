"""Links of rows that share an id or have none, a large group, and the share of links found, against brute force."""

import random
from collections import Counter

import pytest

from tracequarry.llm import near_dedup

from . import brute

NULL = -(2**63)


def expected(docs, percent=85):
    """Components over row numbers, named by the smallest id, nulls first."""
    numbered = [(i, t) for i, (_, t) in enumerate(docs)]
    found = brute.near_dedup(numbered, percent)
    value = lambda i: NULL if docs[i][0] is None else docs[i][0]
    least: dict[int, int] = {}
    for i, (_, c, _) in found.items():
        least[c] = min(least.get(c, value(i)), value(i))
    out = Counter()
    for i, (n, c, _) in found.items():
        name = value(i) if not n else least[c]
        out[docs[i][0], n, None if name == NULL else name, value(i) == name] += 1
    return out


def check(spark, docs, percent=85):
    df = spark.createDataFrame([(d, t, 1, b"s", 2) for d, t in docs], "doc_id long, text string, node int, sig binary, component_id int").repartition(3)
    out = near_dedup.near_duplicates(df, percent=percent)
    assert Counter(map(tuple, out.select("doc_id", "n_shingles", "component_id", "kept").collect())) == expected(docs, percent)


def vary(r, words, k):
    w = list(words)
    for _ in range(k):
        w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
    return " ".join(w)


def test_shared_and_missing_ids(spark):
    r = random.Random(31)
    a, b, c, d = ([f"{k}{r.randrange(10**5)}" for _ in range(150)] for k in "abcd")
    docs = [(5, " ".join(a)), (5, " ".join(b)), (8, vary(r, a, 1)), (9, vary(r, b, 1))]
    docs += [(None, vary(r, c, i % 4)) for i in range(6)] + [(12, vary(r, c, 1)), (None, None), (None, ""), (None, " \n"), (13, ""), (None, "two words"), (14, "Two  words")]
    docs += [(20, " ".join(d))] * 3 + [(20, vary(r, d, 1))] * 2 + [(19, vary(r, d, 2)), (None, " ".join(a)), (2**62, "x y z"), (-7, "x y z"), (15, " ".join(f"l{r.randrange(10**6)}" for _ in range(60_000)))]
    check(spark, docs)


def test_one_row_of_a_component(spark):
    """With keys of their own, exactly one row of each component is its first."""
    docs = [(1, "same text here for all of them"), (1, "same text here for all of them"), (None, "same text here for all of them"), (2, ""), (2, "")]
    rows = spark.createDataFrame([(NULL if d is None else d, i, t) for i, (d, t) in enumerate(docs)], "doc_id long, tag long, text string")
    got = {r.tag: (r.first_id, r.first_tag) for r in near_dedup.row_components(rows).collect()}
    assert got == {0: (NULL, 2), 1: (NULL, 2), 2: (NULL, 2), 3: (2, 3), 4: (2, 4)}


def test_links_found(spark):
    """Pairs just above and below the wanted similarity: none is lost or added."""
    r = random.Random(33)
    docs = []
    for i in range(400):
        w = [f"v{r.randrange(10**6)}" for _ in range(r.randrange(60, 200))]
        docs += [(2 * i, " ".join(w)), (2 * i + 1, vary(r, w, r.choice((1, 1, 2, 2, 3))))]
    check(spark, docs)


@pytest.mark.parametrize("parts", [2000, 7])
def test_large_group(spark, monkeypatch, parts):
    """Thousands of near copies around several centres that share a passage, and hot shingles split into parts."""
    monkeypatch.setattr(near_dedup, "PART", parts)
    r = random.Random(35)
    base = [f"v{r.randrange(10**5)}" for _ in range(100)]
    docs = [(i, vary(r, base, i % 6)) for i in range(700)]
    docs += [(1000 + i, " ".join(base[:60] + [f"t{i % 9}_{k}" for k in range(60)] + [f"u{r.randrange(40)}"])) for i in range(120)]
    check(spark, docs)
