"""Benchmark overlaps of rows that share an id or have none, and of texts that repeat themselves, against brute force."""

import random
from collections import Counter

from tracequarry.llm import decontaminate

from . import brute


def corpus():
    r = random.Random(51)
    say = lambda n: " ".join(f"w{r.randrange(300)}" for _ in range(n))
    passage = say(20)
    changed = passage.split()
    changed[3] = "other"
    items = [(1, passage), (2, "a " * 30), (3, "x y"), (None, say(14)), (5, None), (6, ""), (1, "b " * 15)]
    docs = [(5, say(30)), (5, f"{say(4)} {passage}"), (None, say(15)), (None, f"{passage} tail"), (None, None), (7, "a " * 400), (8, ""), (9, "A, b. a! " * 9), (9, "b b b b b b b b b b b b"), (11, f"{say(20_000)} x-y")]
    docs += [(20 + i, " ".join(changed)) for i in range(30)] + [(20, say(3))] + [(5, f"{say(2)} x y")] * 2
    return docs, items


def test_rows(spark):
    docs, items = corpus()
    df = spark.createDataFrame([(d, t, b"x", "n", 1) for d, t in docs], "doc_id long, text string, words binary, key string, tag int").repartition(3)
    bench = spark.createDataFrame([(i, t, "c") for i, t in items], "item_id long, text string, key string")
    got = decontaminate.contaminated(df, bench).select("doc_id", "contaminated", "n_overlaps", "item_ids", "best_equal", "first_position").collect()
    want = Counter()
    for d, t in docs:
        places = {}
        for k, (i, x) in enumerate(items):
            for _, at, _, _, _, same in brute.overlaps([(0, t)], [(k, x)]):
                places[i, at] = max(places.get((i, at), 0), same)
        found = sorted({i for i, _ in places if i is not None})
        want[d, bool(places), len(places), tuple(found), max(places.values(), default=0), min((at for _, at in places), default=None)] += 1
    assert Counter((*r[:3], tuple(r[3]), *r[4:]) for r in got) == want
