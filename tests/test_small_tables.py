"""Queries and readers that SQL can't check, against brute force on small tables."""

import random
import re
import tempfile

from tracequarry.plans import base, hygiene
from tracequarry.sources import trajectories


def test_same_screen_query(spark):
    r = random.Random(81)
    words = [f"Token{i}.x" for i in range(400)]
    docs = []
    for i in range(40):
        own = r.sample(words, 60)
        docs.append((3 * i, " ".join(own), r.choice(("en", "de"))))
        docs.append((3 * i + 1, " ".join(r.sample(own, 60)), docs[-1][2]))  # equal sets
        docs.append((3 * i + 2, " ".join(own[: r.choice((40, 50, 58))] + ["Another.one"]), docs[-1][2]))
    docs += [(500, "", "en"), (501, None, "en"), (502, "x", "en")]
    made = tempfile.mkdtemp(prefix="spark-")
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{made}/documents.parquet")
    classes: dict = {}
    for d, t, lang in docs:
        items = frozenset(re.findall(base.TOKENS, t or ""))
        if items:
            classes.setdefault((lang, items), []).append(d)
    want = set()
    for (la, a), x in classes.items():
        for (lb, b), y in classes.items():
            if la == lb and min(x) < min(y) and len(a & b) >= 0.8 * len(a | b):
                want.add((min(x), min(y), len(x), len(y)))
    got = {(r.left_id, r.right_id, r.n_left, r.n_right) for r in hygiene.e6_same_screen(spark, made).collect()}
    assert want and got == want


def test_chains_of_any_length(spark):
    """A chain of 150 files, one without an end, two on a circle and one behind it."""
    rows = [(f"/d/{i}.json", "/d", f"{i + 1}.json" if i < 149 else None) for i in range(150)] + [("/d/x.json", "/d", "gone.json"), ("/e/a.json", "/e", "b.json"), ("/e/b.json", "/e", "a.json"), ("/e/c.json", "/e", "../e/a.json"), ("/f/1.json", "/f", None)]
    found = trajectories.splice_continuations(spark.createDataFrame(rows, "path string, folder string, continued_trajectory_ref string").repartition(2))
    got = {r.path: (r.root, r.part) for r in found.collect()}
    assert len(got) == len(rows) and all(got[f"/d/{i}.json"] == ("/d/0.json", i) for i in range(150))
    assert got["/d/x.json"] == ("/d/x.json", 0) and got["/f/1.json"] == ("/f/1.json", 0)
    assert got["/e/b.json"] == ("/e/b.json", 0) and got["/e/a.json"][1] in (0, 1)


def events(spark):
    """A small event log, and its events by user in order: (type, k)."""
    import datetime

    r = random.Random(82)
    begin = datetime.datetime(2024, 1, 1)
    rows, by_user = [], {}
    for i in range(400):
        user, kind, k = r.randrange(6), r.choice(("click", "view", "purchase", "error", "signup")), r.randrange(1, 30)
        rows.append((i, begin + datetime.timedelta(seconds=i), user, kind, float(k), f'{{"k": {k}}}'))
        by_user.setdefault(user, []).append((kind, k))
    made = tempfile.mkdtemp(prefix="spark-")
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{made}/events.parquet")
    return made, by_user


def test_tracked_state(spark):
    """The state after every turn of a counter: clicks add, purchases take what is there, views must read 0."""
    import json

    from tracequarry.operators import replay
    from tracequarry.plans import evaluation

    made, by_user = events(spark)
    x = replay.track_state(evaluation._counter_turns(spark, made), evaluation.COUNTER_RULES, '{"world": {"n": 0}}')
    got = {(r.trajectory_id, r.turn): (r.route, json.loads(r.state)["world"]["n"]) for r in x.collect()}
    want = {}
    for user, log in by_user.items():
        n = 0
        for i, (kind, k) in enumerate(log, 1):
            n += k if kind == "click" else -k if kind == "purchase" and n >= k else 0
            explained = kind in ("click", "purchase") or kind == "view" and n == 0
            want[str(user), i] = ("rule" if explained else "model", n)
    assert got == want
    counts = {r.trajectory_id: (r.n, r.unknown) for r in evaluation.m5_track_state(spark, made).collect()}
    assert counts == {str(u): (len(log), sum(kind in ("signup", "error") for kind, _ in log)) for u, log in by_user.items()}
    cases = {r.case_id: (r.attempted, sorted(r.rule_ids)) for r in evaluation.m4_replay_cases(spark, made).collect()}
    for user, log in by_user.items():
        n, used = 0, set()
        steps = [x for x in log if x[0] in ("click", "purchase", "view")]
        for kind, k in steps:
            used.add({"click": "add", "view": "read"}.get(kind) or ("take" if n >= k else "refuse"))
            n += k if kind == "click" else -k if kind == "purchase" and n >= k else 0
        assert cases[str(user)] == (len(steps), sorted(used))
