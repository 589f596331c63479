"""Ledger: deposits, withdrawals that need cover, balance reads; batch and stream."""

import json

import pyspark.sql.functions as F

from tracequarry.operators import induction, replay, retrieval, stats
from tracequarry.streaming.tracking import folded, track_stream

RULES = [
    {"id": "deposit", "action_type": "deposit", "priority": 1, "confidence": 1.0, "conditions": [], "effects": [{"op": "increment", "path": "world.balance", "value": "{action.arguments.amount}"}], "outcome": "success", "template": "balance {state.world.balance}"},
    {"id": "pay", "action_type": "withdraw", "priority": 1, "confidence": 1.0, "conditions": [{"left": {"path": "world.balance"}, "op": "gte", "right": {"action_arg": "amount"}}], "effects": [{"op": "decrement", "path": "world.balance", "value": "{action.arguments.amount}"}], "outcome": "success", "template": "balance {state.world.balance}"},
    {"id": "refuse", "action_type": "withdraw", "priority": 1, "confidence": 1.0, "conditions": [{"left": {"path": "world.balance"}, "op": "lt", "right": {"action_arg": "amount"}}], "effects": [], "outcome": "failure", "template": "refused"},
    {"id": "read", "action_type": "balance", "priority": 1, "confidence": 1.0, "conditions": [], "effects": [], "outcome": "success", "template": "balance {state.world.balance}"},
]


def act(kind, amount=None):
    return {"type": kind, "arguments": {} if amount is None else {"amount": amount}}


STEPS = [
    {"action": act("balance"), "expected_observation": "balance 100.0", "expected_state": {"world.balance": 100.0}},
    {"action": act("deposit", 5), "expected_observation": "balance 105.0", "expected_state": {"world.balance": 105.0}},
    {"action": act("withdraw", 25), "expected_observation": "balance 80.0", "expected_outcome": "success"},
    {"action": act("withdraw", 500), "expected_observation": "refused", "expected_outcome": "failure", "expected_state": {"world.balance": 80.0}},
]


def cases(spark, steps):
    return spark.createDataFrame([("c", "g", '{"world": {"balance": 100.0}}', json.dumps(steps))], "case_id string, trajectory_group string, initial_state string, steps string")


def test_ledger(spark):
    (r,) = replay.replay_cases(cases(spark, STEPS), RULES).collect()
    assert r.passed and r.attempted == 4 and r.rule_ids == ["deposit", "pay", "read", "refuse"]
    wrong = [*STEPS[:1], {"action": act("deposit", 1), "expected_observation": "x"}]
    (r,) = replay.replay_cases(cases(spark, wrong), RULES).collect()
    assert r.errors == ["step 2: observation mismatch"]
    ids = spark.createDataFrame([(x["id"],) for x in RULES], "rule_id string")
    rep = replay.replay_report(replay.replay_cases(cases(spark, STEPS), RULES), ids).first()
    assert rep.promotable and rep.uncovered_rules == []


def test_ambiguous_rules_and_delays(spark):
    twin = RULES + [{**RULES[3], "id": "read2", "template": "other"}]
    (r,) = replay.replay_cases(cases(spark, STEPS[:1]), twin).collect()
    assert not r.passed and "Ambiguous" in r.errors[0]
    later = [{"id": "l", "action_type": "wait", "effects": [{"op": "schedule", "path": "world.done", "value": True, "delay_steps": 1}], "conditions": []}, {"id": "n", "action_type": "noop", "effects": [], "conditions": []}]
    steps = [{"action": act("wait"), "expected_state": {}}, {"action": act("noop"), "expected_state": {"world.done": True}}]
    assert replay.replay_cases(cases(spark, steps), later).first().passed


TURNS = [("t", 1, act("deposit", 5), "balance 105.0"), ("t", 2, act("withdraw", 5), "surprise"), ("t", 3, act("balance"), "balance 105.0")]


def test_tracking_batch_and_fold(spark):
    df = spark.createDataFrame([(a, b, json.dumps(c), d) for a, b, c, d in TURNS], "trajectory_id string, turn int, action string, observation string")
    x = replay.track_state(df, RULES, '{"world": {"balance": 100.0}}').orderBy("turn").collect()
    assert [r.route for r in x] == ["rule", "model", "rule"]
    start = {"state": {"world": {"balance": 100.0}}, "pending": [], "next": 1, "waiting": {}}
    rows = [(b, json.dumps(c), d) for _, b, c, d in TURNS]
    mid, first = folded(start, [rows[2], rows[0]], RULES)  # the third comes early and waits
    _, rest = folded(json.loads(json.dumps(mid)), [rows[1], rows[0]], RULES)
    assert [r[0] for r in first] == [1] and [r[0] for r in rest] == [2, 3]
    assert [r[1] for r in first + rest] == [r.route for r in x]


def test_tracking_stream(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    schema = "trajectory_id string, turn int, action string, observation string"

    def feed(n, rows):
        (source / f"{n}.json").write_text("\n".join(json.dumps(dict(trajectory_id=a, turn=b, action=json.dumps(c), observation=d)) for a, b, c, d in rows))
        q = track_stream(spark.readStream.schema(schema).json(str(source)), RULES, '{"world": {"balance": 100.0}}').writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        done = q.awaitTermination(60)
        q.stop()
        assert done

    feed(1, [TURNS[2], TURNS[0]])
    feed(2, [TURNS[1]])
    got = spark.read.parquet(out).orderBy("turn").collect()
    assert [(r.turn, r.route) for r in got] == [(1, "rule"), (2, "model"), (3, "rule")]


def test_statistics(spark):
    rows = [("a", f"t{i}", i, 10.0 + i % 3) for i in range(30)] + [("b", f"t{i}", i, 10.0) for i in range(30)]
    df = spark.createDataFrame(rows, "system string, id string, turn_idx int, score double")
    p = stats.pairs(df, "a", "b", ["id", "turn_idx"], "id")
    d = stats.paired_diff(p).first()
    assert (d.n, d.wins, d.ties, d.losses, d.mean_diff) == (30, 20, 10, 0, 1.0)
    ci = {r.estimand: r for r in stats.cluster_bootstrap(p, "id", 400).collect()}
    assert 0.5 < ci["row_mean"].low < 1.0 < ci["row_mean"].high < 1.5
    assert stats.sign_flip_test(p, "id", 500).first().p < 0.02
    poisson = stats.bootstrap_draws(p, "id", 100).agg(F.avg("row_mean")).first()[0]
    assert 0.9 < poisson < 1.1


def test_demonstrations_and_views(spark):
    e = spark.createDataFrame([("act", f"e{i}", "failure" if i == 3 else "success", f"ep{i % 2}", 0.9 - i / 10) for i in range(4)], "action_type string, id string, outcome string, episode_id string, confidence double")
    ids = [r.id for r in induction.select_demonstrations(e).orderBy("position").collect()]
    assert len(ids) == 3 and "e3" in ids and ids[0] == "e0"
    m = spark.createDataFrame([(["p1", "p2"], ["r1"], 2)], "p array<string>, r array<string>, t int").select(retrieval.chat_messages(F.col("p"), F.col("r"), F.col("t"), F.lit("sys"), F.lit("now")).alias("m")).first().m
    assert [(x.role, x.content) for x in m] == [("system", "sys"), ("user", "p1"), ("assistant", "r1"), ("user", "now")]
