"""Pairs made block by block: the same as by inverted lists, and no shuffle of pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tests.test_overlap import TASK, made, measures
from tracequarry.operators import applicability, blocks, overlap


@pytest.fixture(params=["lists", "blocks"])
def plan(request, monkeypatch):
    monkeypatch.setattr(overlap, "CROWDED", 0 if request.param == "lists" else 1 << 40)
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 16)
    return request.param


def tables(spark):
    rng = random.Random(19)
    bench, reserve = made(rng, 50, 0), made(rng, 80, 1000) + [(0, 2000 + i, ["the"], [], [], "s1", "d1") for i in range(20)]
    bench += [(0, 90, None, None, None, None, None), (1, 91, ["the", None, "the"], ["x"], ["x"], None, "d1"), (7, 92, ["the"], ["x"], ["x"], None, "d1"), (None, 93, ["the"], ["x"], ["x"], None, "d1"), (1, None, ["the"], [], [], None, None)]
    reserve += [(0, 3000, None, None, ["00"], "s1", None), (1, 3001, ["the", None], ["x", "x"], [], "s1", "d1")]
    return bench, reserve, *(spark.createDataFrame(x, TASK).repartition(3) for x in (bench, reserve))


def all_pairs(bench, reserve):
    sets = lambda x: (x[0], x[1], *(y or [] for y in x[2:5]), *x[5:])
    return {(x[1], y[1]): measures(x, y) for x in map(sets, bench) for y in map(sets, reserve) if x[0] == y[0] and None not in (x[0], x[1])}


def unshuffled(df):
    """Nothing is joined or shuffled above the pairs."""
    above, found, _ = df._jdf.queryExecution().optimizedPlan().toString().partition("MapInArrow")
    return bool(found) and "Join" not in above and "Aggregate" not in above


def test_pairs_at(spark, plan):
    bench, reserve, b, r = tables(spark)
    pairs = all_pairs(bench, reserve)
    for least in (0.3, 0.6, 1.0):
        df = overlap.overlap_at(b, r, least)
        got = sorted((x.bench_task, x.reserve_task, x.instruction, x.records, x.calls) for x in df.collect())
        assert got == sorted((*k, *m[:3]) for k, m in pairs.items() if max(m[:3]) >= least)
        assert unshuffled(df) == (plan == "blocks")


def test_all_pairs(spark, plan):
    bench, reserve, b, r = tables(spark)
    want = {k: m for k, m in all_pairs(bench, reserve).items() if max(m[:3]) > 0 or m[3] or m[4]}
    df = overlap.task_overlap(b, r)
    assert unshuffled(df) == (plan == "blocks")
    rows = df.collect()
    assert len(rows) == len(want) and {(x.bench_task, x.reserve_task): (x.instruction, x.records, x.calls, x.same_sequence, x.same_database) for x in rows} == want
    assert all(x.flagged == (max(x.instruction, x.records, x.calls) >= 0.6 or x.same_database) for x in rows)


def test_summary(spark, plan):
    """Also where some rows come twice."""
    bench, reserve, *_ = tables(spark)
    b, r = (spark.createDataFrame(x, TASK).repartition(3) for x in (bench, reserve + reserve[:30]))
    pairs = all_pairs(bench, reserve)
    rows = overlap.task_overlap_summary(b, r).collect()
    assert len(rows) == len(bench)
    for x in rows:
        mine = {k[1]: m for k, m in pairs.items() if k[0] == x.bench_task and x.env is not None and (max(m[:3]) > 0 or m[3] or m[4])}
        assert [x.max_instruction, x.max_records, x.max_calls] == [max((m[i] for m in mine.values()), default=0.0) for i in range(3)]
        assert (x.same_sequence, x.same_database) == tuple(any(m[i] for m in mine.values()) for i in (3, 4))
        assert (x.closest or []) == [t for t, _ in sorted(mine.items(), key=lambda kv: (-max(kv[1][:3]), not kv[1][3], kv[0]))[:3]]


def test_a_summary_of_a_crowd_has_no_rounds(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(0, i, rng.sample([f"t{j}" for j in range(20)], 12), ["r"], [], None, None) for i in range(60)]
    monkeypatch.setattr(overlap, "_measured", None)
    t = spark.createDataFrame(rows, TASK)
    got = overlap.task_overlap_summary(t.where("task % 2 = 0"), t.where("task % 2 = 1")).collect()
    assert len(got) == 30 and all(x.max_records == 1.0 and x.closest == [1, 3, 5] for x in got)


def test_a_crowd_is_paired_in_blocks(spark, monkeypatch):
    """As tables are that have most of their items in common."""
    monkeypatch.setattr(overlap, "CROWDED", 2)
    rng = random.Random(3)
    rows = [(i % 2, i, rng.sample([f"t{j}" for j in range(20)], 12), ["r"], [], None, None) for i in range(60)]
    far = [(2, 100 + i, [f"u{i}-{j}" for j in range(9)], [f"v{i}"], [], None, None) for i in range(60)]
    b, r = (spark.createDataFrame(x, TASK) for x in (rows + far, rows + far))
    df = overlap.overlap_at(b, r, 0.5)
    assert unshuffled(overlap.overlap_at(b.where("env < 2"), r, 0.5))
    assert [x.env for x in overlap._crowded(b, r, 0.5).orderBy("env").collect()] == [0, 1]
    assert {(x.bench_task, x.reserve_task) for x in df.collect()} == {k for k, m in all_pairs(rows + far, rows + far).items() if max(m[:3]) >= 0.5}


def test_shared_items(monkeypatch):
    rng = random.Random(5)
    lists = lambda n: [rng.choice([None, []]) if rng.random() < 0.2 else [rng.choice([*"abcdefg", None, f"x{rng.randrange(50)}"]) for _ in range(rng.randrange(12))] for _ in range(n)]
    for na, nb in ((30, 41), (1, 1), (7, 0)):
        a, b = lists(na), lists(nb)
        want = [[len(set(x or []) & set(y or [])) for y in b] for x in a]
        for dense, columns, hits in ((256, 1024, 1 << 21), (0, 4, 3), (1, 2, 50), (4, 3, 1)):
            for k, v in (("DENSE", dense), ("COLUMNS", columns), ("HITS", hits)):
                monkeypatch.setattr(blocks, k, v)
            n_a, n_b, both = blocks.shared(*(pa.chunked_array([pa.array(x, pa.list_(pa.string()))]) for x in (a, b)))
            assert n_a.tolist() == [len(set(x or [])) for x in a] and n_b.tolist() == [len(set(x or [])) for x in b]
            assert np.array_equal(both, np.array(want).reshape(na, nb))


def test_screens_in_blocks(spark, monkeypatch):
    """Classes of more rows than a block, pairs that are equal in several ways, ids of several rows: each pair once,
    and where ids are unique nothing is dropped after the pairs are made."""
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 7)
    rng = random.Random(6)
    row = lambda i: (i, rng.choice([None, "s1", f"s{i % 9}"]), rng.choice(["x", "y", None]), rng.choice([None, [], ["p"], ["p", "q"], ["p", "q", None], ["r"]]), rng.choice([None, "o1", "o2"]))
    same = lambda a, b: None not in (a[1], b[1]) and a[1] == b[1] or None not in (a[4], b[4]) and a[4] == b[4] or a[2] is not None and a[2] == b[2] and a[3] and b[3] and len({*a[3]} & {*b[3]}) >= 0.8 * len({*a[3]} | {*b[3]})
    kind = "id int, state string, app string, items array<string>, opens string"
    for left, right in (([row(i) for i in range(40)], [row(i) for i in range(60)]), ([row(i % 33) for i in range(40)], [row(i % 50) for i in range(60)])):
        a, b = (spark.createDataFrame(x, kind).repartition(3) for x in (left, right))
        for x, y, most in ((a, b, right), (a, a, left)):
            got = [tuple(r) for r in applicability.screen_match(x, y).collect()]
            assert len(got) == len(set(got)) and set(got) == {(m[0], n[0]) for m in left for n in most if same(m, n)}
    plan = applicability.screen_match(*(spark.createDataFrame([row(i) for i in range(9)], kind).where("size(items) = 0") for _ in "ab"))._jdf.queryExecution().optimizedPlan().toString()
    assert not plan.startswith(("Distinct", "Aggregate"))


def test_only_first_items_are_shuffled(spark, monkeypatch):
    """A fifth of each set and one more at 0.8, however its items are counted; the same pairs, of one table and of two."""
    rng = random.Random(8)
    rows = []
    for i in range(80):
        base = rng.sample([f"w{j}" for j in range(300)], 50) if i % 4 == 0 else list(rows[-1][2])
        rows.append((i, rng.choice("xy") if i % 4 == 0 else rows[-1][1], [*base[rng.randrange(4) :], f"own{i}", "hot"]))
    df = spark.createDataFrame(rows, "id int, app string, items array<string>").repartition(3)
    want = {(a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and len({*a[2]} & {*b[2]}) >= 0.8 * len({*a[2]} | {*b[2]})}
    assert len(want) > 150
    for groups in (1, 16, 1 << 20):
        monkeypatch.setattr(overlap, "GROUPS", groups)
        h = df.selectExpr("0 AS side", "id", "app", "transform(items, i -> xxhash64(i)) AS h")
        first = overlap._first_items(h, "app", 0.8).groupBy("id", "n").count().collect()
        assert len(first) == 80 and all(r["count"] <= r.n // 5 + 1 for r in first)
    for other in (df, df.where("true")):
        got = [(r.left_id, r.right_id) for r in overlap.set_jaccard_pairs(df, other, "app", 0.8).collect()]
        assert len(got) == len(set(got)) and set(got) == want
