"""Demonstrations against the plain greedy choice over all evidence."""

import random

from tracequarry.operators import induction


def plain(rows, n):
    out = {}
    for action in {r[0] for r in rows}:
        left, outcomes, episodes, chosen = [r for r in rows if r[0] == action], set(), set(), []
        while left and len(chosen) < n:
            best = min(left, key=lambda r: (r[2] in outcomes, r[3] in episodes, -r[4], r[1]))
            left.remove(best)
            outcomes.add(best[2])
            episodes.add(best[3])
            chosen.append(best[1])
        out |= {(action, i + 1): x for i, x in enumerate(chosen)}
    return out


def test_greedy_choice(spark):
    rng = random.Random(12)
    for n in (1, 3, 5):
        rows = [(rng.choice("abc"), f"e{i:04d}", rng.choice(["ok", "ok", "bad", "odd"]), f"p{rng.randrange(rng.choice((2, 9, 200)))}", rng.choice((0.2, 0.5, 0.9))) for i in range(400)] + [("lone", "x", "ok", "p", 0.1)]
        df = spark.createDataFrame(rows, "action_type string, id string, outcome string, episode_id string, confidence double").repartition(3)
        assert {(r.action_type, r.position): r.id for r in induction.select_demonstrations(df, n).collect()} == plain(rows, n)
