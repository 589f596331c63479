"""Queries over scoring, paired statistics, profiles and replay."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from ..functions.parsers import DIMENSIONS
from ..operators import profiles, replay, scoring, stats
from .base import SCORES, TURNS, query, scores, table, turns


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("int")
    return li.select(F.col("l_returnflag").alias("task"), *(((q + i) % 6).alias(d) for i, d in enumerate(DIMENSIONS)), (q % 5 + 1).cast("double").alias("total_score"), F.when(F.col("l_linenumber") == 1, 1.0).when(F.col("l_linenumber") < 7, 0.0).alias("failed"))


_J = """j AS (SELECT l_returnflag AS task, CAST(l_quantity AS INTEGER) AS q, l_linenumber BETWEEN 2 AND 6 AS ok FROM lineitem)"""


@query(f"""WITH {_J} SELECT task, count(*) AS total, count(*) FILTER (ok) AS valid, count(*) FILTER (NOT ok) AS failed, """ + ", ".join(f"round(avg(((q + {i}) % 6 - 1) / 4 * 100) FILTER (ok AND (q + {i}) % 6 <> 0), 6) AS {d}" for i, d in enumerate(DIMENSIONS)) + """,
 round(avg((q % 5) / 4 * 100) FILTER (ok), 6) AS overall FROM j GROUP BY ROLLUP (task)""")
def j1_aggregate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = scoring.aggregate_scores(_judged(spark, sf_dir))
    return x.select("task", "total", "valid", "failed", *(F.round(c, 6).alias(c) for c in (*DIMENSIONS, "overall")))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir)
    m = F.col("k") % 3 == 0
    return t.select(F.concat(F.lit("e"), "env").alias("env"), F.when(F.col("tool") == "view", "data").when(F.col("tool") == "error", "error").otherwise("message").alias("kind"), F.when(F.col("k") > 70, "p").alias("probe"), (F.col("k") > 50).alias("generated"),
                    F.lit(True).alias("predicted"), (F.col("k") % 7 != 0).alias("parsed"), (m | (F.col("k") % 5 == 0)).alias("outcome_match"), m.alias("match"), (F.col("k") % 6 == 0).alias("match_strict"), (F.col("k") % 12 == 0).alias("text_match"))


_RATES = "count(*) AS n_rows, count(*) FILTER (k > 50) AS generated, 100.0 AS predicted, round(100 * avg(CAST(k % 7 <> 0 AS INTEGER)), 2) AS parsed, round(100 * avg(CAST(k % 3 = 0 OR k % 5 = 0 AS INTEGER)), 2) AS outcome_match, round(100 * avg(CAST(k % 3 = 0 AS INTEGER)), 2) AS match, round(100 * avg(CAST(k % 6 = 0 AS INTEGER)), 2) AS match_strict, round(100 * avg(CAST(k % 12 = 0 AS INTEGER)), 2) AS text_match"


@query(f"""WITH {TURNS}, s AS (SELECT 'e' || env AS env, CASE tool WHEN 'view' THEN 'data' WHEN 'error' THEN 'error' ELSE 'message' END AS kind, CASE WHEN k > 70 THEN 'probe' ELSE 'recorded' END AS "set", k FROM tu)
 SELECT env, kind, "set", false AS reads_excluded, {_RATES} FROM s GROUP BY GROUPING SETS ((), (env), (kind), ("set"), (env, "set"), ("set", kind))
 UNION ALL SELECT env, NULL, "set", true, {_RATES} FROM s WHERE kind <> 'data' GROUP BY GROUPING SETS ((), (env), ("set"))""")
def j6_aggregate_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.aggregate_exact(_scored(spark, sf_dir))


@query("""WITH x AS (SELECT CASE WHEN l.quality = 1 THEN 'match' WHEN l.toxic = 1 THEN 'outcome only' ELSE 'wrong outcome' END AS verdict, 100.0 * (d.n_chars % 5) / 4 AS score FROM labels l JOIN documents d USING (doc_id))
 SELECT verdict, count(*) AS n, round(avg(score), 6) AS mean, min(score) AS least, max(score) AS most, count(*) FILTER (score = 100) AS at_100, count(*) FILTER (verdict = 'match' AND score < 100) AS marked_down FROM x GROUP BY ALL""")
def j7_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("match"), (F.col("toxic") == 1).alias("outcome_match"))
    j = table(spark, sf_dir, "documents").select("doc_id", (100.0 * (F.col("n_chars") % 5) / 4).alias("score"))
    return scoring.verdicts(e, j, ["doc_id"]).withColumn("mean", F.round("mean", 6))


@query("""WITH c AS (SELECT source, count(*) FILTER (quality = 1) AS s, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL), p AS (SELECT source, n, s / n AS p, 1.96 * 1.96 AS z2 FROM c)
 SELECT source, n, round((p + z2 / (2 * n)) / (1 + z2 / n) - 1.96 * sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n), 6) AS low, round((p + z2 / (2 * n)) / (1 + z2 / n) + 1.96 * sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n), 6) AS high FROM p""")
def j8_wilson_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("s"), F.count("*").alias("n"))
    w = scoring.wilson_interval(F.col("s"), F.col("n"))
    return x.select("source", "n", F.round(w["low"], 6).alias("low"), F.round(w["high"], 6).alias("high"))


@query("""WITH r AS (SELECT o_custkey AS task, o_orderstatus = 'F' AS ok, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders), a AS (SELECT * FROM r WHERE r <= 4)
 SELECT CAST(k AS INTEGER) AS k, count(DISTINCT task) AS tasks, round(count(DISTINCT task) FILTER (ok AND r <= k) / count(DISTINCT task), 6) AS pass_rate, round(count(*) FILTER (ok AND r <= k) / (k * count(DISTINCT task)), 6) AS attempt_rate FROM a, range(1, 5) x(k) GROUP BY k""")
def j9_pass_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("task"), F.col("o_orderkey").alias("attempt"), (F.col("o_orderstatus") == "F").alias("success"))
    return scoring.pass_at_k(a, 4).select("k", "tasks", F.round("pass_rate", 6).alias("pass_rate"), F.round("attempt_rate", 6).alias("attempt_rate"))


@query("""WITH s AS (SELECT c_custkey AS task, c_acctbal > 0 AS r, c_nationkey % 2 = 0 AS s, c_custkey % 3 = 0 AS c FROM customer) SELECT count(*) AS n, round(avg(CAST(r AS INTEGER)), 6) AS real, round(avg(CAST(s AS INTEGER)), 6) AS simulated, round(avg(CAST(c AS INTEGER)), 6) AS carried, round(avg(CAST(c AS INTEGER)) / avg(CAST(r AS INTEGER)), 6) AS consistency FROM s""")
def j10_consistency_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    side = lambda e: c.select(F.col("c_custkey").alias("task"), e.alias("success"))
    x = scoring.consistency_ratio(side(F.col("c_acctbal") > 0), side(F.col("c_nationkey") % 2 == 0), side(F.col("c_custkey") % 3 == 0))
    return x.select("n", *(F.round(k, 6).alias(k) for k in ("real", "simulated", "carried", "consistency")))


@query(f"""WITH {TURNS}, b AS (SELECT episode, tool AS path, max_by(answer, turn) AS v FROM tu WHERE turn <= 30 GROUP BY ALL), a AS (SELECT episode, tool AS path, max_by(answer, turn) AS v FROM tu WHERE turn > 20 GROUP BY ALL)
 SELECT coalesce(b.episode, a.episode) AS episode, coalesce(b.path, a.path) AS path, CASE WHEN b.v IS NULL THEN 'added' WHEN a.v IS NULL THEN 'removed' ELSE 'changed' END AS change, b.v AS old, a.v AS new
 FROM b FULL JOIN a ON a.episode = b.episode AND a.path = b.path WHERE b.v IS DISTINCT FROM a.v""")
def j11_leaf_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir)
    leaves = lambda x: x.groupBy("episode", F.col("tool").alias("path")).agg(F.max_by("answer", "turn").alias("value"))
    return scoring.leaf_diff(leaves(t.where("turn <= 30")), leaves(t.where("turn > 20")), ["episode"])


@query()
def j4_exact_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's properties as the truth, and as predictions that agree, differ or are no value."""
    e = table(spark, sf_dir, "events")
    truth = F.to_json(F.struct(F.lit(True).alias("success"), F.col("props").alias("data"), F.col("value")))
    gen = F.when(F.col("event_id") % 3 == 0, truth).when(F.col("event_id") % 3 == 1, F.to_json(F.struct(F.lit(False).alias("success")))).otherwise(F.lit("no value"))
    x = e.select(scoring.exact_score(truth, F.concat(F.lit("<predicted_observation>"), gen, F.lit("</predicted_observation>")), F.lit(""), F.lit(None).cast("array<string>")).alias("s"))
    return x.groupBy("s.kind", "s.parsed", "s.match", "s.outcome_match").agg(F.count("*").alias("n"))


_PAIR = SCORES + """, pr AS (SELECT a.trajectory, a.turn_idx, a.score AS a, b.score AS b, a.score - b.score AS diff FROM sc a JOIN sc b ON a.trajectory = b.trajectory AND a.turn_idx = b.turn_idx WHERE a.system = 'click' AND b.system = 'view')"""
_DIFF = "count(*) AS n, count(*) FILTER (diff > 1e-9) AS wins, count(*) FILTER (abs(diff) <= 1e-9) AS ties, count(*) FILTER (diff < -1e-9) AS losses, round(avg(diff), 6) AS mean_diff, round(stddev_pop(diff) / sqrt(count(*)), 6) AS se"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.pairs(scores(spark, sf_dir), "click", "view", ["trajectory", "turn_idx"], "trajectory")


def _rounded(x: DataFrame) -> DataFrame:
    return x.withColumns({c: F.round(c, 6) for c in ("mean_diff", "se") if c in x.columns})


@query(f"WITH {SCORES} SELECT system, count(*) AS n_rows, count(*) AS valid, 0 AS failed, round(avg(score), 6) AS score FROM sc GROUP BY ALL")
def k1_system_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scores(spark, sf_dir).withColumn("failed", F.lit(None).cast("double"))
    return stats.system_table(s, dimensions=()).withColumn("score", F.round("score", 6))


@query(f"WITH {_PAIR} SELECT {_DIFF} FROM pr")
def k2_paired_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.paired_diff(_pairs(spark, sf_dir)))


@query(f"WITH {_PAIR}, c AS (SELECT trajectory, avg(diff) AS diff FROM pr GROUP BY ALL) SELECT count(*) AS clusters, count(*) FILTER (diff > 1e-9) AS wins, count(*) FILTER (abs(diff) <= 1e-9) AS ties, count(*) FILTER (diff < -1e-9) AS losses FROM c")
def k5_cluster_wtl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.cluster_wtl(_pairs(spark, sf_dir), "trajectory")


@query()
def k3_cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.cluster_bootstrap(_pairs(spark, sf_dir), "trajectory", 2000)


@query()
def k4_sign_flip_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.sign_flip_test(_pairs(spark, sf_dir), "trajectory", 4000)


@query(f"""WITH {_PAIR}, s AS (SELECT diff, unnest([{{'stratum': 'third', 'value': CAST(turn_idx % 3 AS VARCHAR)}}, {{'stratum': 'style', 'value': CASE WHEN trajectory % 2 = 0 THEN 'even' ELSE 'odd' END}}], recursive := true) FROM pr) SELECT stratum, "value", {_DIFF} FROM s GROUP BY ALL""")
def k6_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir).withColumn("third", F.col("turn_idx") % 3).withColumn("style", F.when(F.col("trajectory") % 2 == 0, "even").otherwise("odd"))
    return _rounded(stats.breakdown(p, ["third", "style"]))


@query(f"""WITH {_PAIR} SELECT 'all' AS subset, {_DIFF} FROM pr UNION ALL SELECT 'late', {_DIFF} FROM pr WHERE turn_idx > 50 UNION ALL SELECT 'clean', {_DIFF} FROM pr WHERE trajectory % 10 <> 0""")
def k7_subset_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.subset_reports(_pairs(spark, sf_dir), {"all": F.lit(True), "late": F.col("turn_idx") > 50, "clean": F.col("trajectory") % 10 != 0}))


@query(f"""WITH {SCORES}, w AS (SELECT trajectory, turn_idx, first(score) FILTER (system = 'view') AS "view", first(score) FILTER (system = 'click') AS click, first(score) FILTER (system = 'purchase') AS purchase FROM sc GROUP BY ALL)
 SELECT *, purchase - "view" AS gap FROM w WHERE purchase >= 20 AND "view" <= 10 AND "view" <= click AND click <= purchase ORDER BY gap DESC, trajectory, turn_idx LIMIT 20""")
def k9_case_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.case_screen(scores(spark, sf_dir), ["view", "click", "purchase"], ["trajectory", "turn_idx"], "ladder", 20, 10, 20)


@query(f"""WITH {_PAIR}, b AS (SELECT trajectory % 3 AS backbone, * FROM pr), c AS (SELECT backbone, trajectory, avg(diff) AS diff FROM b GROUP BY ALL), w AS (SELECT backbone, count(*) AS clusters, count(*) FILTER (diff > 1e-9) AS cluster_wins, count(*) FILTER (diff < -1e-9) AS cluster_losses FROM c GROUP BY ALL)
 SELECT * FROM (SELECT backbone, {_DIFF} FROM b GROUP BY ALL) JOIN w USING (backbone)""")
def k10_backbone_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scores(spark, sf_dir).withColumn("backbone", F.col("trajectory") % 3)
    return _rounded(stats.backbone_transfer(s, "click", "view", ["trajectory", "turn_idx"], "trajectory"))


def _call_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    p, c = F.col("l_extendedprice").cast("long"), F.col("l_quantity").cast("long")
    return li.select(F.col("l_returnflag").alias("role"), (F.col("l_linestatus") == "F").alias("cache_hit"), F.when(F.col("l_linenumber") == 7, "timeout").alias("error"), p.alias("prompt_tokens"), c.alias("cached_tokens"), (c * 10).alias("completion_tokens"), F.col("l_quantity").alias("elapsed_s"), (F.col("l_extendedprice") * F.col("l_discount")).alias("cost"))


@query("""SELECT l_returnflag AS role, count(*) AS calls, count(*) FILTER (l_linestatus = 'F') AS cache_hits, count(*) FILTER (l_linenumber = 7) AS errors, CAST(sum(CAST(trunc(l_extendedprice) AS BIGINT)) AS BIGINT) AS prompt_tokens, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS cached_tokens,
 CAST(sum(CAST(l_quantity AS BIGINT) * 10) AS BIGINT) AS completion_tokens, sum(l_quantity) AS seconds, round(sum((trunc(l_extendedprice) - l_quantity) * 2e-6 + l_quantity * 2e-7 + l_quantity * 10 * 1e-5), 6) AS cost FROM lineitem GROUP BY ROLLUP (l_returnflag)""")
def l1_call_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = spark.range(1).select(F.lit(2e-6).alias("prompt"), F.lit(1e-5).alias("completion"), F.lit(2e-7).alias("cached"))
    return profiles.call_costs(_call_log(spark, sf_dir).drop("cost"), prices).withColumn("cost", F.round("cost", 6))


@query("""SELECT l_returnflag AS role, count(*) AS calls, count(*) FILTER (l_linestatus <> 'F') AS fresh_calls, round(avg(l_extendedprice * l_discount) FILTER (l_linestatus <> 'F') * count(*) / 100, 6) AS cost_per_row, round(avg(l_quantity) FILTER (l_linestatus <> 'F') * count(*) / 100, 6) AS seconds_per_row,
 round(avg(trunc(l_extendedprice)) FILTER (l_linestatus <> 'F'), 6) AS prompt_mean, CAST(max(trunc(l_extendedprice)) FILTER (l_linestatus <> 'F') AS BIGINT) AS prompt_max FROM lineitem GROUP BY ALL""")
def l2_fresh_equivalent(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = profiles.fresh_equivalent(_call_log(spark, sf_dir), 100)
    return x.withColumns({c: F.round(c, 6) for c in ("cost_per_row", "seconds_per_row", "prompt_mean")})


@query(f"""WITH {TURNS}, a AS (SELECT env, tool, answer, count(*) AS c FROM tu GROUP BY ALL) SELECT env, tool, CAST(sum(c) AS BIGINT) AS calls, count(*) AS answers, round(max(c) / sum(c), 6) AS top_share FROM a GROUP BY ALL""")
def l4_collection_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir).withColumn("kind", F.lit("data")).withColumn("changed", F.lit(False))
    return profiles.collection_profile(t, ["env"]).select("env", "tool", "calls", "answers", F.round("top_share", 6).alias("top_share"))


@query("SELECT event_type, count(*) AS n, round(median(value), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS most FROM events GROUP BY ALL")
def l4_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = profiles.quantiles(table(spark, sf_dir, "events"), ["event_type"], "value")
    return x.select("event_type", "n", F.round("median", 6).alias("median"), F.round("p95", 6).alias("p95"), "most")


@query(f"""WITH {TURNS}, p AS (SELECT *, lag(answer) OVER (PARTITION BY episode, call ORDER BY turn) AS repeat_last FROM tu), e AS (SELECT DISTINCT episode, tool FROM tu), t AS (SELECT tool, answer, count(*) AS t FROM tu GROUP BY ALL), o AS (SELECT episode, tool, answer, count(*) AS o FROM tu GROUP BY ALL),
 l AS (SELECT e.episode, e.tool, t.answer, t - coalesce(o, 0) AS n FROM e JOIN t USING (tool) LEFT JOIN o ON o.episode = e.episode AND o.tool = e.tool AND o.answer = t.answer), m AS (SELECT episode, tool, answer FROM (SELECT *, row_number() OVER (PARTITION BY episode, tool ORDER BY n DESC, answer) AS r FROM l WHERE n > 0) WHERE r = 1)
 SELECT p.tool, count(*) AS n, count(*) FILTER (p.answer = repeat_last) AS repeated, count(*) FILTER (p.answer = m.answer) AS majority FROM p LEFT JOIN m ON m.episode = p.episode AND m.tool = p.tool GROUP BY ALL""")
def l8_know_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = profiles.know_nothing_predictors(turns(spark, sf_dir))
    return x.groupBy("tool").agg(F.count("*").alias("n"), F.count_if(F.col("answer") == F.col("repeat_last")).alias("repeated"), F.count_if(F.col("answer") == F.col("majority")).alias("majority"))


@query(f"""WITH {TURNS} SELECT count(DISTINCT episode) AS trajectories, CAST(sum(turn) AS BIGINT) AS turn, CAST(sum(k) AS BIGINT) AS k FROM (SELECT episode, max(turn) AS turn, max_by(k, turn) AS k FROM tu GROUP BY ALL)""")
def l10_latest_tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.latest_tracking(turns(spark, sf_dir), "episode", "turn", ["turn", "k"])


_RULES = [("r1", "click", 1, 0.9, "gt", "50"), ("r2", "click", 1, 0.8, "gt", "80"), ("r3", "view", 2, 0.7, "lte", "30"), ("r4", "error", 1, 0.6, "exists", None), ("r5", "signup", 1, 0.5, "not_exists", None)]


def _rule_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    values = ", ".join(f"('{r}', '{a}', {p}, {c}D, '{o}', {'NULL' if v is None else repr(v)})" for r, a, p, c, o, v in _RULES)
    x = spark.sql(f"SELECT * FROM VALUES {values} AS t(rule_id, action_type, priority, confidence, op, right_literal)")
    none = F.lit(None).cast("string")
    return x.select("rule_id", "action_type", "priority", "confidence", F.col("rule_id").alias("plan")), x.select("rule_id", F.lit(1).alias("n"), none.alias("left_path"), F.lit("k").alias("left_arg"), "op", none.alias("right_path"), none.alias("right_arg"), "right_literal")


_MATCH = TURNS + """, ma AS (SELECT episode, turn, CASE WHEN tool = 'click' AND k > 80 THEN NULL WHEN tool = 'click' AND k > 50 THEN 'r1' WHEN tool = 'view' AND k <= 30 THEN 'r3' WHEN tool = 'error' THEN 'r4' END AS rule_id, tool = 'click' AND k > 80 AS ambiguous FROM tu)"""


@query(f"WITH {_MATCH} SELECT episode AS case_id, turn AS step, rule_id, ambiguous FROM ma WHERE rule_id IS NOT NULL OR ambiguous")
def m1_match_and_select_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = turns(spark, sf_dir).select(F.col("episode").alias("case_id"), F.col("turn").alias("step"), F.col("tool").alias("action_type"), F.to_json(F.struct("k")).alias("arguments"))
    rules, conditions = _rule_tables(spark)
    state = steps.select("case_id", "step", F.lit("world.k").alias("path"), F.lit("1").alias("value"))
    return replay.select_rule(replay.match_rules(steps, rules, conditions, state))


@query(f"""WITH {TURNS}, l AS (SELECT episode AS trajectory_id, concat('world.k', k) AS path, max_by(tool, turn) AS tool, max_by(answer, turn) AS "value" FROM tu GROUP BY ALL) SELECT trajectory_id, path, "value" FROM l WHERE tool <> 'error'""")
def m2_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir)
    return replay.latest_state(t.select(F.col("episode").alias("trajectory_id"), F.col("turn").alias("step"), F.lit(0).alias("seq"), F.when(F.col("tool") == "error", "delete").otherwise("set").alias("op"), F.concat(F.lit("world.k"), "k").alias("path"), F.col("answer").alias("value")))


@query(f"""WITH {TURNS} SELECT episode AS case_id, turn AS step, 'positive' AS invariant, 'error' AS severity FROM tu WHERE k <= 10 UNION ALL SELECT episode, turn, 'small', 'warning' FROM tu WHERE k > 90""")
def m6_check_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = turns(spark, sf_dir).select(F.col("episode").alias("case_id"), F.col("turn").alias("step"), F.lit("world.k").alias("path"), F.col("k").cast("string").alias("value"))
    invariants = spark.sql("SELECT * FROM VALUES ('positive', 'world.k', 'gt', '10', 'error'), ('small', 'world.k', 'lte', '90', 'warning') AS t(id, path, op, literal, severity)")
    return replay.check_invariants(states, invariants)


@query(f"""WITH {TURNS}, p AS (SELECT episode, event_id AS id, turn + k % 7 + 1 AS due FROM tu WHERE tool = 'click'), s AS (SELECT episode, turn FROM tu WHERE tool = 'view'),
 d AS (SELECT p.episode, p.id, p.due, min(s.turn) AS step FROM p JOIN s ON s.episode = p.episode AND s.turn >= p.due GROUP BY ALL)
 SELECT episode AS case_id, step, id, due AS due_step, row_number() OVER (PARTITION BY episode, step ORDER BY due, id) AS position FROM d""")
def m7_due_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir)
    pending = t.where("tool = 'click'").select(F.col("episode").alias("case_id"), F.col("event_id").alias("id"), (F.col("turn") + F.col("k") % 7 + 1).alias("due_step"))
    return replay.due_events(pending, t.where("tool = 'view'").select(F.col("episode").alias("case_id"), F.col("turn").alias("step")))


#: A counter that clicks raise by k, purchases lower and views read.
COUNTER_RULES = [
    {"id": "add", "action_type": "click", "priority": 1, "confidence": 0.9, "conditions": [], "effects": [{"op": "increment", "path": "world.n", "value": "{action.arguments.k}"}], "outcome": "success"},
    {"id": "take", "action_type": "purchase", "priority": 1, "confidence": 0.9, "conditions": [{"left": {"path": "world.n"}, "op": "gte", "right": {"action_arg": "k"}}], "effects": [{"op": "decrement", "path": "world.n", "value": "{action.arguments.k}"}], "outcome": "success"},
    {"id": "refuse", "action_type": "purchase", "priority": 1, "confidence": 0.9, "conditions": [{"left": {"path": "world.n"}, "op": "lt", "right": {"action_arg": "k"}}], "effects": [], "outcome": "failure"},
    {"id": "read", "action_type": "view", "priority": 1, "confidence": 0.9, "conditions": [], "effects": [], "outcome": "success", "template": "{state.world.n}"},
]


def _counter_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir)
    action = F.to_json(F.struct(F.col("tool").alias("type"), F.struct("k").alias("arguments")))
    return t.select(F.col("episode").cast("string").alias("trajectory_id"), F.col("turn").cast("int").alias("turn"), action.alias("action"), F.lit("0").alias("observation"))


@query()
def m4_replay_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's calls as a replay case of a counter."""
    t = _counter_turns(spark, sf_dir).where("get_json_object(action, '$.type') IN ('click', 'purchase', 'view')")
    step = F.struct(F.from_json("action", "struct<type:string,arguments:struct<k:int>>").alias("action"))
    cases = t.groupBy(F.col("trajectory_id").alias("case_id")).agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("turn", step.alias("s")))), lambda x: x["s"])).alias("steps"))
    return replay.replay_cases(cases.select("case_id", F.col("case_id").alias("trajectory_group"), F.lit('{"world": {"n": 0}}').alias("initial_state"), "steps"), COUNTER_RULES)


@query(f"""WITH {TURNS} SELECT CAST(episode AS VARCHAR) AS trajectory_id, count(*) AS n, count(*) FILTER (tool IN ('signup', 'error')) AS unknown FROM tu GROUP BY ALL""")
def m5_track_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = replay.track_state(_counter_turns(spark, sf_dir), COUNTER_RULES, '{"world": {"n": 0}}')
    return x.groupBy("trajectory_id").agg(F.count("*").alias("n"), F.count_if(F.col("issue") == "no rule applies").alias("unknown"))
