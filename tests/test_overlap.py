"""Overlap of tasks and screens against all pairs."""

import random

from tracequarry.operators import overlap

TASK = "env int, task int, tokens array<string>, records array<string>, calls array<string>, sequence string, database string"


def made(rng, n, first):
    out = []
    for i in range(n):
        base = rng.randrange(6)
        pick = lambda k, m: [f"{base if rng.random() < 0.7 else 'x'}{rng.randrange(m)}" for _ in range(rng.randrange(k))]
        out.append((i % 2, first + i, ["the", *pick(9, 8)] if rng.random() < 0.9 else [], pick(6, 5), pick(5, 4), rng.choice(["s1", "s2", "s3", None]), rng.choice([None, None, "d1", f"d{i}"])))
    return out


def measures(b, r):
    j = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y)) if x or y else 0.0
    calls = len(set(b[4]) & set(r[4])) / len(set(b[4])) if b[4] else 0.0
    return j(b[2], r[2]), j(b[3], r[3]), calls, b[5] is not None and b[5] == r[5], b[6] is not None and b[6] == r[6]


def test_tasks(spark):
    rng = random.Random(9)
    bench, reserve = made(rng, 40, 0), made(rng, 70, 1000) + [(0, 2000 + i, ["the"], [], [], "s1", "d1") for i in range(40)]
    b, r = (spark.createDataFrame(x, TASK).repartition(3) for x in (bench, reserve))
    pairs = {(x[1], y[1]): measures(x, y) for x in bench for y in reserve if x[0] == y[0]}
    for least in (0.3, 0.6, 1.0):
        got = {(x.bench_task, x.reserve_task) for x in overlap.overlap_at(b, r, least).collect()}
        assert got == {k for k, m in pairs.items() if max(m[:3]) >= least}
    whole = {(x.bench_task, x.reserve_task): (x.instruction, x.records, x.calls, bool(x.same_sequence), x.same_database) for x in overlap.task_overlap(b, r).collect()}
    assert whole == {k: m for k, m in pairs.items() if max(m[:3]) > 0 or m[3] or m[4]}
    for falling in ((0.3, 0.1, 0.0), (0.0,)):
        rows = overlap.task_overlap_summary(b, r, falling=falling).collect()
        assert len(rows) == len(bench)
        for x in rows:
            mine = {k[1]: m for k, m in pairs.items() if k[0] == x.bench_task and (max(m[:3]) > 0 or m[3] or m[4])}
            best = [max((m[i] for m in mine.values()), default=0.0) for i in range(3)]
            assert [x.max_instruction, x.max_records, x.max_calls] == best
            assert x.same_database == any(m[4] for m in mine.values()) and x.same_sequence == any(m[3] for m in mine.values()) and x.flagged == (max(best) >= 0.6 or x.same_database)
            assert (x.closest or []) == [t for t, _ in sorted(mine.items(), key=lambda kv: (-max(kv[1][:3]), not kv[1][3], kv[0]))[:3]]


def test_screens(spark):
    """Random sets with items that most of them hold, and equal sets: all pairs, of one table and of two."""
    rng = random.Random(4)
    rows = []
    for i in range(150):
        base = [f"c{j}" for j in range(rng.randrange(1, 12))] if rng.random() < 0.6 else [f"u{i}-{j}" for j in range(rng.randrange(4))]
        rows.append((i, rng.choice("xy"), rng.randrange(3), rng.choice([None, "s1", f"t{i % 20}"]), ["hot", *base, *rng.sample([f"o{j}" for j in range(9)], rng.randrange(3))] if rng.random() < 0.9 else []))
    df = spark.createDataFrame(rows, "id int, app string, fold int, state string, items array<string>").repartition(4)
    same = lambda a, b, least: (a[3] is not None and a[3] == b[3]) or (a[1] == b[1] and a[4] and b[4] and len(set(a[4]) & set(b[4])) >= least * len(set(a[4]) | set(b[4])))
    for least in (0.5, 0.8, 1.0):
        want = sorted((a[0], b[0]) for a in rows for b in rows if same(a, b, least))
        assert sorted(map(tuple, overlap.same_screen(df, df, least).collect())) == want
        assert sorted(map(tuple, overlap.same_screen(df, df.where("true"), least).collect())) == want
    got = {r.row_id: (r.app_covered, r.screen_covered) for r in overlap.row_strata(df.withColumnRenamed("id", "row_id"), df).collect()}
    assert got == {a[0]: (any(b[1] == a[1] and b[2] != a[2] for b in rows), any(b[2] != a[2] and same(a, b, 0.8) for b in rows)) for a in rows}
