"""Distributed ranks, running sums, packing and sweeps against plain loops."""

import random

import numpy as np
import pyspark.sql.functions as F

from tracequarry.operators import ranks, segment
from tracequarry.sources.trajectories import shard_by_trajectory

EVENT = "episode_id string, event_id string, pos int, actor string, kind string, content string, call_id string, tool_call_id string, parent_event_id string, batch_size int"


def test_ranked(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "b", "hot", "hot", "hot"]), rng.randrange(50), i) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, v int, i int").repartition(6)
    got = sorted((r["rank"], r.k, r.v) for r in ranks.ranked(df, ["k", "v"]).collect())
    key = lambda r: (r[0] is not None, r[0] or "", r[1])
    assert [x[0] for x in got] == list(range(900)) and [x[1:] for x in got] == [r[:2] for r in sorted(rows, key=key)]
    inside = ranks.ranked_in(df, "k", ["v", "i"]).collect()
    for k in (None, "a", "b", "hot"):
        mine = sorted((r.place, r.v, r.i) for r in inside if r.k == k)
        assert [(v, i) for _, v, i in mine] == sorted(r[1:] for r in rows if r[0] == k) and [p for p, _, _ in mine] == list(range(len(mine)))
    assert ranks.ranked(df.limit(0), ["k"]).count() == 0


def test_shards(spark):
    df = spark.createDataFrame([(f"t{i % 40:02d}", i) for i in range(300)], "t string, i int")
    assert {(r.t, r.shard) for r in shard_by_trajectory(df, "t", 7, exact=True).collect()} == {(f"t{i:02d}", i % 7) for i in range(40)}


def test_running(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.randrange(400), rng.randrange(5)) for _ in range(500)]
    got = ranks.running(spark.createDataFrame(rows, "k string, at long, v long"), ["k"], "at", ["v"], block=32).collect()
    assert len(got) == 500
    for r in got:
        assert r.v_before == sum(v for k, at, v in rows if k == r.k and at < r.at) and r.v_upto == sum(v for k, at, v in rows if k == r.k and at <= r.at)


def packed(rows, max_count, max_bytes):
    out, batch, n, total = {}, 0, 0, 0
    for i, size in sorted(rows):
        if size > max_bytes:
            out[i] = None
            continue
        if n == max_count or total + size > max_bytes:
            batch, n, total = batch + 1, 0, 0
        n, total = n + 1, total + size
        out[i] = batch
    return out


def test_packing(spark):
    rng = random.Random(3)
    rows = {None: 70, "a": 1, "hot": 3000, "zero": 300}
    data = [(k, i, 0 if k == "zero" else rng.choice((0, 1, 5, 30, 101))) for k, n in rows.items() for i in range(n)]
    df = spark.createDataFrame([(k, i, "x" * s if s or i % 2 else None) for k, i, s in data], "k string, i int, text string").repartition(5)
    for max_count, max_bytes, block in ((4, 100, 16), (1, 100, 16), (7, 31, 1 << 16), (1000, 100, 16)):
        got = {(r.k, r.i): r.batch for r in ranks.pack_batches(df, "k", ["i"], "text", max_count, max_bytes, block).collect()}
        want = {(k, i): b for k in rows for i, b in packed([(i, s) for x, i, s in data if x == k], max_count, max_bytes).items()}
        assert got == want
    assert ranks.pack_batches(df.limit(0), "k", ["i"], "text", 3, 9).collect() == []


def test_long_source(spark):
    """A million records of one key: no task sorts or cuts more than a block and what stands behind it."""
    n = 1_000_000
    df = spark.range(n).select(F.lit("one").alias("k"), F.col("id").alias("i"), F.repeat(F.lit("x"), (F.col("id") * 7919 % 13).cast("int")).alias("text"))
    got = ranks.pack_batches(df, "k", ["i"], "text", 8, 40).groupBy("batch").agg(F.min("i").alias("a"), F.count("*").alias("n")).orderBy("batch").toPandas()
    size = np.arange(n) * 7919 % 13
    cut, at, begins = ranks._cuts(size, 8, 40), 0, []
    while at < n:
        begins.append(at)
        at = int(cut[at])
    assert got["a"].tolist() == begins and got["n"].sum() == n


def events_of(rng, n, e):
    out = []
    for p in range(n):
        act = rng.random() < 0.6
        call = rng.choice(["", None, *(f"c{rng.randrange(12)}" for _ in range(6))])
        out.append((e, f"{e}-{p}", p, "agent" if act else "tool", "action" if act else "observation", "x", call if act else None, None if act else call, rng.choice([None, "m1", "m2"]), 1))
    return out


def test_sweep_counts_pairs(spark):
    rng = random.Random(5)
    rows = [r for e in range(6) for r in events_of(rng, 60, f"e{e}")]
    df = spark.createDataFrame(rows, EVENT).repartition(3)
    ids = {r.action_id: len(r.concurrent_ids) for r in segment.concurrent_actions(df).collect()}
    got = {r.action_id: r.n_concurrent for r in segment.concurrency_counts(df).collect()}
    assert set(ids) <= set(got) and got == {a: ids.get(a, 0) for a in got} and any(got.values())


def test_all_open(spark):
    """100,000 unanswered calls of one episode and one message: a row each, with counts instead of five billion pairs."""
    n = 100_000
    e = spark.range(n).select(F.lit("e").alias("episode_id"), F.col("id").cast("string").alias("event_id"), F.col("id").cast("int").alias("pos"), F.lit("agent").alias("actor"), F.lit("action").alias("kind"), F.lit("").alias("content"),
                              F.concat(F.lit("c"), "id").alias("call_id"), F.lit(None).cast("string").alias("tool_call_id"), F.lit("m").alias("parent_event_id"), F.lit(1).alias("batch_size"))
    x = segment.concurrency_counts(e)
    assert x.agg(F.count("*"), F.sum("n_open"), F.sum("n_siblings"), F.min("n_concurrent")).first()[:] == (n, n * (n - 1) // 2, n * (n - 1) // 2, n - 1)


def test_transitions_with_ids_and_counts(spark):
    """Both forms agree, and an id that thousands of calls and replies share is no product."""
    rng = random.Random(11)
    rows = [r for e in range(4) for r in events_of(rng, 50, f"e{e}")]
    rows += [("hot", f"h{i}", i, "agent" if i % 2 else "tool", "action" if i % 2 else "observation", "x", "same" if i % 2 else None, None if i % 2 else "same", None, 1) for i in range(4000)]
    df = spark.createDataFrame(rows, EVENT).repartition(3)
    assert segment.call_replies(df).where("episode_id = 'hot'").agg(F.sum(F.size("replies")), F.count("last_reply")).first()[:] == (0, 1999)
    few = df.where("episode_id <> 'hot'")
    cols = ["transition_id", "episode_id", "pos", "n_concurrent", "ambiguities", "alignment"]
    a, b = (sorted(map(str, segment.segment_transitions(few, ids=ids).select(*cols).collect())) for ids in (True, False))
    assert a == b
