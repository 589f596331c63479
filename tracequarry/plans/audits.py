"""Queries over splits, leakage audits, evidence, search results, scores, profiles and replay that stand beside those of
the other plans."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from ..operators import applicability, identity, induction, overlap, profiles, replay, retrieval, scoring, stats
from .base import TURNS, query, table, turns


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(f"""WITH {TURNS} SELECT event_id AS row_id, episode + k % 3 AS hit, CASE WHEN k % 3 = 0 THEN 'own row' WHEN NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = episode + k % 3) THEN 'unknown' WHEN k % 3 = 1 THEN 'other style' ELSE 'same fold' END AS error FROM tu
 WHERE k % 3 < 2 OR NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = episode + 2) OR (episode // 4) % 2 = ((episode + 2) // 4) % 2""")
def d8_check_cross_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event hits its own user, the next or the one after; styles alternate, folds change every fourth user."""
    t = turns(spark, sf_dir)
    users = t.select(F.col("episode").alias("group"), (F.col("episode") % 2).alias("style"), (F.floor(F.col("episode") / 4) % 2).alias("fold")).distinct()
    return identity.check_cross_fit(t.select(F.col("event_id").alias("row_id"), F.col("episode").alias("group"), F.array(F.col("episode") + F.col("k") % 3).alias("hits")), users)


@query("SELECT DISTINCT p_size % 2 AS style, p_brand AS brand, true AS even FROM part")
def d6_spread_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as trajectories, some of one task or one first screen, over five folds: do a brand's groups lie evenly over
    them?"""
    p = table(spark, sf_dir, "part")
    key, none = F.col("p_partkey"), F.lit(None).cast("string")
    t = p.select((F.col("p_size") % 2).alias("style"), F.col("p_brand").alias("brand"), F.col("p_size").alias("turns"), key.alias("trajectory"), F.when(key % 3 == 0, F.concat_ws("|", "p_name", "p_size")).otherwise(none).alias("task_hash"), F.when(key % 3 == 1, F.concat_ws("|", "p_type", "p_size")).otherwise(none).alias("first_screen"))
    x = identity.assign_folds(identity.task_groups(t), 5, spread=["brand"])
    brands = t.select("style", "brand").distinct()
    each = x.groupBy("style", "brand").pivot("fold", [0, 1, 2, 3, 4]).count().na.fill(0)
    even = F.greatest(*(F.col(str(i)) for i in range(5))) - F.least(*(F.col(str(i)) for i in range(5))) <= 2
    return brands.join(each, ["style", "brand"], "left").select("style", "brand", F.coalesce(even, F.lit(True)).alias("even"))


@query(f"""WITH {TURNS} SELECT episode AS task, turn, CASE WHEN k % 7 = 6 THEN 'no row' ELSE concat_ws(',', CASE WHEN k % 7 = 1 THEN 'action' END, CASE WHEN k % 7 = 2 THEN 'history length' END, CASE WHEN k % 7 = 3 THEN 'history' END, CASE WHEN k % 7 = 4 THEN 'target' END) END AS errors FROM tu""")
def d15_curated_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir).select(F.col("episode").alias("task"), "turn", F.col("k") % 7, F.col("tool").alias("action"), F.array("tool", "answer").alias("history"), F.col("answer").alias("target")).toDF("task", "turn", "m", "action", "history", "target")
    changed = lambda at, c, other: F.when(F.col("m") == at, other).otherwise(F.col(c))
    history = F.when(F.col("m") == 2, F.array("action")).when(F.col("m") == 3, F.array("action", F.lit("x"))).otherwise(F.col("history"))
    rows = t.where("m <> 6").select("task", "turn", changed(1, "action", F.lit("x")).alias("action"), history.alias("history"), changed(4, "target", F.lit("x")).alias("target"))
    targets = t.select("task", "turn", F.when(F.col("m") != 6, F.col("target")).alias("target"))
    return identity.curated_join(t.select("task", "turn", "action", "history"), targets, rows).select("task", "turn", F.array_join("errors", ",").alias("errors"))


@query("""SELECT CASE WHEN p_size < 40 THEN 'rule' ELSE 'note' END AS kind, CAST(p_partkey AS VARCHAR) AS id, CAST(p_partkey // 2 IN (SELECT p_partkey FROM part WHERE p_size < 40) AS BIGINT) AS n_rules, 0 AS n_provenance FROM part WHERE p_size < 40 OR p_size >= 45""")
def d18_package_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as artefacts of three kinds that cite the part of half their key; one kind is left out."""
    p = table(spark, sf_dir, "part")
    kind = F.when(F.col("p_size") < 40, "rule").when(F.col("p_size") < 45, "evidence").otherwise("note")
    a = p.select(kind.alias("kind"), F.col("p_partkey").cast("string").alias("id"), F.array(F.lit("src")).alias("provenance"), F.array(F.floor(F.col("p_partkey") / 2).cast("string")).alias("rule_ids"))
    return identity.package_tiers(a, ["rule", "note"]).select("kind", "id", F.size("rule_ids").cast("long").alias("n_rules"), F.size("provenance").alias("n_provenance"))


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as tasks: tools as instruction words, values of k as records, calls, their order."""
    t = turns(spark, sf_dir)
    g = t.groupBy("env", F.col("episode").alias("task")).agg(F.collect_set(F.concat("tool", (F.col("k") % 10))).alias("tokens"), F.collect_set(F.col("k").cast("string")).alias("records"), F.collect_set("call").alias("calls"), F.min("tool").alias("sequence"))
    return g.withColumn("database", F.when(F.col("task") % 4 == 0, (F.col("task") % 8).cast("string")))


_TASKS = TURNS + """, ta AS (SELECT env, episode AS task, list(DISTINCT concat(tool, k % 10)) AS tokens, list(DISTINCT CAST(k AS VARCHAR)) AS records, list(DISTINCT call) AS calls, min(tool) AS sequence,
 CASE WHEN episode % 4 = 0 THEN CAST(episode % 8 AS VARCHAR) END AS database FROM tu GROUP BY ALL),
 ov AS (SELECT b.env, b.task AS bench_task, r.task AS reserve_task, len(list_intersect(b.tokens, r.tokens)) / len(list_distinct(list_concat(b.tokens, r.tokens))) AS instruction, len(list_intersect(b.records, r.records)) / len(list_distinct(list_concat(b.records, r.records))) AS records,
 len(list_intersect(b.calls, r.calls)) / len(b.calls) AS calls, b.sequence = r.sequence AS same_sequence, coalesce(b.database = r.database, false) AS same_database FROM ta b JOIN ta r ON r.env = b.env AND b.task % 2 = 0 AND r.task % 2 = 1),
 ok AS (SELECT *, instruction >= 0.6 OR records >= 0.6 OR calls >= 0.6 OR same_database AS flagged, greatest(instruction, records, calls) AS most FROM ov WHERE instruction > 0 OR records > 0 OR calls > 0 OR same_sequence OR same_database)"""


@query(f"WITH {_TASKS} SELECT env, bench_task, reserve_task, round(instruction, 9) AS instruction, round(records, 9) AS records, round(calls, 9) AS calls, same_sequence, same_database, flagged FROM ok")
def e3_task_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tasks(spark, sf_dir)
    x = overlap.task_overlap(t.where("task % 2 = 0"), t.where("task % 2 = 1"))
    return x.select("env", "bench_task", "reserve_task", *(F.round(c, 9).alias(c) for c in ("instruction", "records", "calls")), "same_sequence", "same_database", "flagged")


@query(f"WITH {_TASKS} SELECT env, bench_task, reserve_task, round(most, 9) AS most FROM ok WHERE most >= 0.5")
def e3_overlap_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tasks(spark, sf_dir)
    x = overlap.overlap_at(t.where("task % 2 = 0"), t.where("task % 2 = 1"), 0.5)
    return x.select("env", "bench_task", "reserve_task", F.round(F.greatest("instruction", "records", "calls"), 9).alias("most"))


@query(f"""WITH {_TASKS}, r AS (SELECT *, row_number() OVER (PARTITION BY bench_task ORDER BY most DESC, same_sequence DESC, reserve_task) AS r FROM ok),
 g AS (SELECT bench_task, max(instruction) AS i, max(records) AS rec, max(calls) AS c, bool_or(flagged) AS f, string_agg(CAST(reserve_task AS VARCHAR), ',' ORDER BY r) FILTER (r <= 3) AS closest FROM r GROUP BY ALL)
 SELECT env, task AS bench_task, round(coalesce(i, 0), 9) AS max_instruction, round(coalesce(rec, 0), 9) AS max_records, round(coalesce(c, 0), 9) AS max_calls, coalesce(f, false) AS flagged, closest FROM ta LEFT JOIN g ON g.bench_task = task WHERE task % 2 = 0""")
def e3_task_overlap_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tasks(spark, sf_dir)
    bench = t.where("task % 2 = 0")
    x = overlap.task_overlap_summary(bench, t.where("task % 2 = 1"))
    return x.select("env", "bench_task", *(F.round(f"max_{c}", 9).alias(f"max_{c}") for c in ("instruction", "records", "calls")), "flagged", F.array_join("closest", ",").alias("closest"))


@query("""WITH p AS (SELECT p_partkey AS id, p_brand AS app, p_size % 3 AS fold, concat(p_type, p_container_) AS state FROM (SELECT *, p_size % 2 AS p_container_ FROM part))
 SELECT a.id AS row_id, a.app, a.fold, EXISTS (SELECT 1 FROM p b WHERE b.app = a.app AND b.fold <> a.fold) AS app_covered, EXISTS (SELECT 1 FROM p b WHERE b.state = a.state AND b.fold <> a.fold) AS screen_covered FROM p a""")
def e5_row_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("app"), (F.col("p_size") % 3).alias("fold"), F.concat("p_type", F.col("p_size") % 2).alias("state"), F.array().cast("array<string>").alias("items"))
    return overlap.row_strata(p.withColumnRenamed("id", "row_id"), p)


@query("""SELECT doc_id AS key, doc_id % 4 <> 1 AS system_once, CASE WHEN doc_id % 4 = 2 THEN 1 ELSE 0 END AS messages_missing, doc_id % 4 = 3 AND length(text) >= 40 AS target_leaked FROM documents""")
def e9_target_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests in which, by id, the system text comes twice, a repeated message is missing once, or the target leaks."""
    d = _docs(spark, sf_dir)
    i = F.col("doc_id") % 4
    system = F.concat(F.lit("<<system of "), "doc_id", F.lit(">>"))
    message = F.lit("[[say it again]]")
    user = F.concat(F.when(i == 1, system).otherwise(F.lit("")), message, F.when(i == 2, F.lit("")).otherwise(message), F.when(i == 3, F.col("text")).otherwise(F.lit("")))
    requests = d.select(F.col("doc_id").alias("key"), system.alias("system"), user.alias("user"))
    rows = d.select(F.col("doc_id").alias("key"), system.alias("system_str"), F.array(message, message).alias("messages"), F.col("text").alias("target"), F.array(F.lit("h")).alias("history"))
    return overlap.target_leak(requests, rows).select("key", "system_once", "messages_missing", "target_leaked")


@query(f"""WITH {TURNS} SELECT CASE WHEN k % 4 = 0 THEN NULL WHEN k % 4 = 1 THEN 'uncertain' ELSE 'supporting' END AS label, CASE WHEN k % 2 = 0 THEN 'sanitized' ELSE 'shown' END AS disposition, count(*) AS n, count(*) FILTER (k % 4 = 0) AS undecided,
 count(*) FILTER (k % 2 = 0 AND tool = 'view') AS raw_values, count(*) FILTER (k % 4 >= 2 AND tool <> 'click') AS unsupported FROM tu GROUP BY ALL""")
def e10_shown_item_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir)
    k = F.col("k")
    items = t.select(F.col("event_id").alias("item_id"), "episode", F.when(k % 4 == 1, "uncertain").when(k % 4 > 1, "supporting").alias("label"), F.when(k % 2 == 0, "sanitized").otherwise("shown").alias("disposition"), F.when(F.col("tool") == "view", "see 10.0.0.1").otherwise("see it").alias("text"), F.array("call").alias("names"))
    shown = t.where("tool = 'click'").select("episode", F.col("call").alias("name"))
    return overlap.shown_item_audit(items, shown)


@query(f"""WITH {TURNS} SELECT 'answer fields' AS "check", count(*) FILTER (k % 10 = 0) AS violations FROM tu UNION ALL SELECT 'hidden sections', count(*) FILTER (k % 10 = 1) FROM tu UNION ALL SELECT 'targets that differ', count(*) FILTER (k % 10 = 2) FROM tu""")
def e11_answer_key_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir)
    k = F.col("k") % 10
    shown = F.when(k == 0, "the state_after is here").when(k == 1, "Does it.\n  Returns: a thing").otherwise("plain")
    rows = t.select(F.col("episode").alias("id"), "turn", shown.alias("text"), F.when(k == 2, "changed").otherwise(F.col("answer")).alias("target"))
    return overlap.answer_key_checks(rows, t.select(F.col("episode").alias("id"), "turn", F.col("answer").alias("observation")))


@query(f"""WITH {TURNS} SELECT event_id AS id, CASE WHEN k % 5 = 4 THEN 0.0 WHEN k % 3 = 0 THEN 0.5 ELSE 0.9 END AS confidence, CASE WHEN k % 2 = 0 THEN 1 ELSE 2 END AS n_events, CASE WHEN k % 3 = 0 THEN 0 ELSE 1 END AS n_mutations, CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS dropped_citations, k % 5 = 4 AS refused FROM tu""")
def g1_guard_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir)
    k, e = F.col("k"), F.col("event_id").cast("string")
    none = F.array().cast("array<string>")
    evidence = t.select(F.col("event_id").alias("id"), e.alias("transition_id"), F.array(F.when(k % 2 == 0, "elsewhere").otherwise(e), F.concat(F.lit("o"), e)).alias("event_ids"), F.array(F.lit("m")).alias("mutations"), F.lit(0.9).cast("double").alias("confidence"), F.when(k % 5 == 4, "refused").otherwise("success").alias("outcome"))
    transitions = t.select(e.alias("transition_id"), F.array(e).alias("action_ids"), F.array(F.concat(F.lit("o"), e)).alias("observation_ids"), none.alias("history_ids"), F.when(k % 6 == 0, "ambiguous").otherwise("sequential").alias("alignment"), F.when(k % 6 == 3, F.array(F.lit("c"))).otherwise(none).alias("concurrent_ids"))
    return induction.guard_evidence(evidence, transitions).select("id", "confidence", F.size("event_ids").alias("n_events"), F.size("mutations").alias("n_mutations"), "dropped_citations", "refused")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS rule_id, concat_ws(',', CASE WHEN p_size % 6 = 3 THEN 'immutable path world.fixed' END, CASE WHEN p_size % 6 = 0 THEN 'unknown action none' END, CASE WHEN p_size % 6 = 2 THEN 'unknown path other.x' WHEN p_size % 6 = 4 THEN 'unknown path world.fixed.z' END, CASE WHEN p_size % 5 = 0 THEN 'unknown renderer r0' END) AS reasons FROM part WHERE p_size % 6 IN (0, 2, 3, 4) OR p_size % 5 = 0""")
def g12_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as rules; by size, an action, a path, a renderer is unknown or a path must not be written."""
    p = table(spark, sf_dir, "part")
    m = F.col("p_size") % 6
    rules = p.select(F.col("p_partkey").cast("string").alias("rule_id"), F.when(m == 0, "none").otherwise("act").alias("action_type"), F.when(F.col("p_size") % 5 == 0, "r0").when(F.col("p_size") % 5 == 1, "r1").alias("renderer"))
    paths = p.select(F.col("p_partkey").cast("string").alias("rule_id"), F.when(m == 2, "other.x").when(m == 3, "world.fixed").when(m == 4, "world.fixed.z").otherwise("world.open.y").alias("path"), F.when(m == 3, "write").otherwise("read").alias("use"))
    declared = spark.sql("SELECT * FROM VALUES ('world.open', 'object', true), ('world.fixed', 'string', false) AS t(path, type, mutable)")
    return induction.quarantine(rules, paths, spark.sql("SELECT 'act' AS name"), declared, spark.sql("SELECT 'r1' AS id"))[1].select("rule_id", F.array_join("reasons", ",").alias("reasons"))


@query("""SELECT 'rule' AS kind, CAST(p_partkey AS VARCHAR) AS ref_id, p_type AS action_type, p_name AS text FROM part UNION ALL SELECT 'note', CAST(c_custkey AS VARCHAR), NULL, c_name FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'action', n_name, n_name, '' FROM nation
 UNION ALL SELECT 'demonstration', CAST(s_suppkey AS VARCHAR), 'a', s_name FROM supplier UNION ALL SELECT 'evidence', CAST(o_orderkey AS VARCHAR), o_orderpriority, o_orderstatus FROM orders""")
def g15_knowledge_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    return induction.knowledge_catalog(
        t("nation").select(F.col("n_name").alias("name"), F.lit(None).cast("string").alias("description")), t("part").select(F.col("p_partkey").alias("rule_id"), F.col("p_type").alias("action_type"), F.col("p_name").alias("text")),
        t("customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_mktsegment") == "BUILDING", "supported").otherwise("tentative").alias("status"), F.col("c_name").alias("text")),
        t("supplier").select(F.col("s_suppkey").alias("id"), F.lit("a").alias("action_type"), F.col("s_name").alias("text")), t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("action_type"), F.col("o_orderstatus").alias("observation_text")),
    )


@query("""WITH c AS (SELECT concat('t', c_mktsegment) AS collection, min(c_custkey) AS first_order FROM customer GROUP BY ALL) SELECT collection, unnest(['name', 'n']) AS field, first_order FROM c""")
def g18_domain_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer as a state of one collection with one record."""
    c = table(spark, sf_dir, "customer")
    state = F.concat(F.lit('{"t'), "c_mktsegment", F.lit('": {"r'), "c_custkey", F.lit('": {"name": "x", "n": 1}}}'))
    return induction.domain_layout(c.select(F.col("c_custkey").alias("order"), state.alias("state"))).select("collection", "field", F.col("first.order").alias("first_order"))


@query(f"""WITH {TURNS}, h AS (SELECT episode AS query_id, event_id AS id, k AS score, k // 2 AS grp FROM tu WHERE tool IN ('view', 'click')), o AS (SELECT *, row_number() OVER (PARTITION BY query_id, grp ORDER BY score DESC, id) AS r FROM h),
 f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM o WHERE r = 1) SELECT query_id, id, rank FROM f WHERE rank <= 5""")
def h4_catalog_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir)
    catalog = t.select(F.col("event_id").alias("ref_id"), F.col("tool").alias("kind"), F.floor(F.col("k") / 2).alias("evidence_id"))
    return retrieval.catalog_search(t.select(F.col("episode").alias("query_id"), F.col("event_id").alias("id"), F.col("k").alias("score")), catalog, ["view", "click"], 5).select("query_id", "id", "rank")


@query(f"""WITH {TURNS} SELECT episode AS session, turn, event_id AS entry, row_number() OVER (PARTITION BY episode, turn % 7 ORDER BY CASE tool WHEN 'view' THEN 0 ELSE 1 END, event_id) AS position, turn % 7 AS asked FROM tu WHERE turn % 7 = 3""")
def h5_turn_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of one turn of each session, where every seventh event belongs to it."""
    t = turns(spark, sf_dir)
    entries = t.select(F.col("episode").alias("session"), (F.col("turn") % 7).alias("turn"), F.when(F.col("tool") == "view", "observed").otherwise("predicted").alias("origin"), F.col("event_id").alias("entry"), F.col("turn").alias("at"))
    wanted = t.select(F.col("episode").alias("session"), F.lit(3).alias("turn")).distinct()
    return retrieval.turn_memory(entries, wanted).select("session", F.col("at").alias("turn"), "entry", "position", F.col("turn").alias("asked"))


@query(f"""WITH {TURNS} SELECT DISTINCT episode, unnest([call, concat('f', k), concat('l', k)]) AS name FROM tu""")
def i1_episode_inventories(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir)
    return applicability.episode_inventories(t.select("episode", F.array("call").alias("operands"), F.array(F.concat(F.lit("f"), "k"), F.lit("")).alias("fact_paths"), F.array(F.concat(F.lit("l"), "k")).alias("listing_names")))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN concat('/srv/', p_size, '/x.csv') ELSE concat('/srv/', p_size, '/x.csv,y', p_size) END AS signals FROM part")
def i3_distinct_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(F.concat(F.lit("/srv/"), "p_size", F.lit("/x.csv")), F.lit("x.csv"), F.concat(F.lit("/srv/"), "p_size"), F.when(F.col("p_size") % 2 == 1, F.concat(F.lit("y"), "p_size")).otherwise(F.lit("srv")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(applicability.distinct_signals(names), ",").alias("signals"))


@query("""SELECT a.p_partkey AS left_id, b.p_partkey AS right_id FROM part a JOIN part b ON (a.p_size % 7 = 0 AND b.p_size % 7 = 0 AND a.p_name = b.p_name AND a.p_brand = b.p_brand) OR (a.p_size % 7 = 1 AND b.p_size % 7 = 1 AND a.p_type = b.p_type AND a.p_brand = b.p_brand)""")
def i6_screen_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as screens: of one kind the state is known, of another the app that they open."""
    m = F.col("p_size") % 7
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(m == 0, F.concat_ws("|", "p_name", "p_brand")).alias("state"), F.col("p_brand").alias("app"), F.array().cast("array<string>").alias("items"), F.when(m == 1, F.concat_ws("|", "p_type", "p_brand")).alias("opens"))
    return applicability.screen_match(p, p)


@query(f"""WITH {TURNS} SELECT n.note_id, event_id AS episode, CASE WHEN (k % 2 = 0) = n.negated THEN 'contradicted' ELSE 'consistent' END AS status FROM tu, (VALUES ('n1', false), ('n2', true)) n(note_id, negated) WHERE k % 3 = 0""")
def i7_note_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two notes about one convention against every event as a transcript; a third of them could show it."""
    t = turns(spark, sf_dir)
    notes = spark.sql("SELECT note_id, array('command not found') AS claims, negated FROM VALUES ('n1', false), ('n2', true) AS t(note_id, negated)")
    shows = F.when(F.col("k") % 2 == 0, "x: command not found").otherwise("fine")
    tested = F.when(F.col("k") % 3 == 0, F.array(F.lit("command not found"))).otherwise(F.array().cast("array<string>"))
    return applicability.note_check(notes, t.select(F.col("event_id").alias("episode"), shows.alias("text"), tested.alias("tested")))


@query("""WITH d AS (SELECT doc_id, coalesce(text, '') || CASE doc_id % 3 WHEN 0 THEN 'tool_x() gives Output: y' WHEN 1 THEN 'tool_x() gives nothing' ELSE 'Output: y' END AS t FROM documents)
 SELECT doc_id, instr(t, 'tool_x') > 0 AND regexp_matches(substr(t, greatest(1, instr(t, 'tool_x')), 4006), '(?i)observation|output|returns') AS documented FROM d""")
def i9_documented_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).withColumn("text", F.coalesce("text", F.lit("")))
    tail = F.when(F.col("doc_id") % 3 == 0, "tool_x() gives Output: y").when(F.col("doc_id") % 3 == 1, "tool_x() gives nothing").otherwise("Output: y")
    return d.select("doc_id", applicability.documented_format(F.concat("text", tail), F.lit("tool_x")).alias("documented"))


@query(f"""WITH {TURNS}, s AS (SELECT call FROM tu GROUP BY call HAVING count(DISTINCT episode) <= 2) SELECT event_id AS row_id, CASE WHEN k % 2 = 0 AND (k % 3 > 0 OR tu.call NOT IN (SELECT call FROM s)) THEN 'uncertain' WHEN k % 2 = 0 THEN 'supporting' ELSE 'contradicted' END AS label, k % 3 = 0 AND tu.call IN (SELECT call FROM s) AS anchored FROM tu""")
def i10_verify_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's anchor is its call; a third of the transcripts have it, and calls of two users at most are specific."""
    t = turns(spark, sf_dir)
    specific = applicability.specific_names(t.select("episode", F.col("call").alias("name")), t.select("episode", F.col("episode").alias("task")).distinct(), 2)
    verdicts = t.select(F.col("event_id").alias("row_id"), F.lit(1).alias("item_id"), F.col("event_id").alias("episode"), F.when(F.col("k") % 2 == 0, "supporting").otherwise("contradicted").alias("label"), F.lit("uncertain").alias("rule_label"), F.array("call").alias("anchors"))
    seen = t.select(F.col("event_id").alias("episode"), F.when(F.col("k") % 3 == 0, F.concat(F.lit("ran "), "call", F.lit(" now"))).otherwise("nothing").alias("text"))
    return applicability.verify_anchors(verdicts, seen, specific).select("row_id", "label", "anchored")


@query("""WITH t AS (SELECT l_orderkey AS id, l_linenumber AS attempt, max(l_returnflag) <> 'A' AS ok, min(CAST(l_quantity AS INTEGER)) % 5 + 1 AS g FROM lineitem GROUP BY ALL), b AS (SELECT id, arg_min(g, attempt) AS g FROM t WHERE ok GROUP BY ALL)
 SELECT o_orderkey AS id, CASE WHEN g IS NOT NULL AND o_orderstatus <> 'F' THEN 0.0 ELSE 1.0 END AS failed, CASE WHEN g IS NOT NULL AND o_orderstatus <> 'F' THEN g ELSE 0 END AS total_score FROM orders LEFT JOIN b ON b.id = o_orderkey""")
def j2_merge_judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as tries of an order's judge; orders of one status have no generation."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("l_returnflag"), F.min(F.col("l_quantity").cast("int")).alias("q"))
    g = F.col("q") % 5 + 1
    tries = li.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("attempt"), (F.col("l_returnflag") != "A").alias("success"), *(g.alias(d) for d in scoring.DIMENSIONS), g.cast("double").alias("total"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") != "F", "text").alias("gen"))
    return scoring.merge_judgements(rows, tries, ["id"]).select("id", "failed", "total_score")


@query(f"""WITH {TURNS} SELECT 'route' AS part, tool AS name, count(*) AS n FROM tu GROUP BY ALL UNION ALL SELECT 'counter', 'k', CAST(sum(k) AS BIGINT) FROM tu UNION ALL SELECT 'counter', 'rows', count(*) FROM tu""")
def j3_route_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir).select(F.col("tool").alias("route"), F.create_map(F.lit("k"), F.col("k").cast("long"), F.lit("rows"), F.lit(1).cast("long")).alias("tracking"))
    routes, counters = scoring.route_diagnostics(t)
    return routes.select(F.lit("route").alias("part"), F.col("route").alias("name"), "n").unionByName(counters.select(F.lit("counter").alias("part"), F.col("counter").alias("name"), F.col("total").alias("n")))


def _uuid(seed: F.Column) -> F.Column:
    x = F.md5(seed.cast("string"))
    return F.concat_ws("-", F.substring(x, 1, 8), F.substring(x, 9, 4), F.substring(x, 13, 4), F.substring(x, 17, 4), F.substring(x, 21, 12))


_UUID = "concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), substr(h, 13, 4), substr(h, 17, 4), substr(h, 21, 12))"


@query(f"""WITH o AS (SELECT *, md5(CAST(o_orderkey AS VARCHAR)) AS h FROM orders) SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 3 > 0 THEN concat('uuid=', {_UUID}) END, CASE WHEN o_orderkey % 5 > 0 THEN concat('date=', strftime(o_orderdate, '%Y-%m-%d')) END) AS generated FROM o""")
def j5_generated_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's answer holds an id and a date; a third of the contexts hold the id, a fifth of the environments draw
    no dates."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    truth = F.concat(F.lit("{'id': '"), _uuid(key), F.lit("', 'due': '"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("'}"))
    shapes = F.when(key % 5 == 0, F.array(F.lit("uuid"))).otherwise(F.lit(None).cast("array<string>"))
    found = scoring.generated_tokens(truth, F.when(key % 3 == 0, _uuid(key)).otherwise(""), shapes)
    return o.select("o_orderkey", F.array_join(F.transform(found, lambda x: F.concat(x["kind"], F.lit("="), x["value"])), ",").alias("generated"))


@query("""SELECT o_orderkey, o_orderkey % 4 <> 3 AS "match", o_orderkey % 4 IN (0, 2) AS match_strict, o_orderkey % 4 = 0 AS text_match, true AS outcome_match FROM orders""")
def j4_exact_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's answer with another new id: as it is, its list reversed, as JSON, with another number."""
    key = F.col("o_orderkey")
    i = key % 4
    body = lambda uuid, tags, n: F.concat(F.lit("{'success': True, 'id': '"), uuid, F.lit("', 'tags': ["), tags, F.lit("], 'n': "), n, F.lit("}"))
    truth = body(_uuid(key), F.lit("'a', 'b'"), key.cast("string"))
    given = body(_uuid(key + 1), F.when(i == 1, "'b', 'a'").otherwise("'a', 'b'"), F.when(i == 3, key + 1).otherwise(key).cast("string"))
    given = F.when(i == 2, F.replace(F.replace(given, F.lit("'"), F.lit('"')), F.lit("True"), F.lit("true"))).otherwise(given)
    s = table(spark, sf_dir, "orders").select("o_orderkey", scoring.exact_score(truth, given, F.lit("shown before"), F.lit(None).cast("array<string>")).alias("s"))
    return s.select("o_orderkey", "s.match", "s.match_strict", "s.text_match", "s.outcome_match")


@query(f"WITH {TURNS} SELECT tool AS part, CASE WHEN k % 3 = 0 THEN 'identical' WHEN k % 3 = 1 THEN 'identical up to generated values' ELSE 'differs' END AS status, count(*) AS n FROM tu GROUP BY ALL")
def j12_replay_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k") % 3
    return scoring.replay_comparison(turns(spark, sf_dir).select(F.col("tool").alias("part"), F.col("answer").alias("recorded"), F.when(k == 0, F.col("answer")).otherwise("x").alias("rerun"), F.lit("c").alias("recorded_canonical"), F.when(k == 2, "d").otherwise("c").alias("rerun_canonical")))


@query("SELECT rule, (SELECT count(*) FROM supplier) AS n, 0 AS violations FROM (SELECT unnest(['identity', 'fenced', 'json', 'reversed_keys', 'pretty_printed', 'fresh_generated_id', 'reversed_scalars', 'reordered_group_in_string', 'changed_string', 'changed_number', 'changed_known_id', 'reused_context_id', 'merged_generated_ids', 'split_generated_id', 'reversed_records', 'dropped_key', 'extra_key', 'flipped_success', 'bool_as_int', 'prose', 'empty']) AS rule) UNION ALL SELECT 'shifted_clock', (SELECT count(*) FROM supplier WHERE s_suppkey % 2 = 1), 0 UNION ALL SELECT 'changed_computed_clock', (SELECT count(*) FROM supplier WHERE s_suppkey % 2 = 0), 0")
def j13_scorer_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's answer changed by every rule whose verdict is known; half of the environments read no clock."""
    o = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    known, first, second = _uuid(key), _uuid(-key - 1), _uuid(F.concat(F.lit("s"), key))
    truth = F.concat(
        F.lit("{'success': True, 'message': \"Order "), first, F.lit(" has ['b', 'a'].\", 'order_id': '"), first, F.lit("', 'other_id': '"), second, F.lit("', 'of': '"), known, F.lit("', 'n': "), key.cast("string"),
        F.lit(", 'tags': ['x', 'y'], 'lines': [{'l': 1}, {'l': 2}], 'at': '"), F.date_add(F.lit("2024-01-01").cast("date"), (key % 365).cast("int")).cast("string"), F.lit("T10:20:30'}"),
    )
    shapes = F.when(key % 2 == 0, F.array(F.lit("uuid"))).otherwise(F.array(F.lit("uuid"), F.lit("stamp")))
    return scoring.scorer_mutations(o.select(truth.alias("truth"), F.concat(F.lit("order "), known).alias("context"), shapes.alias("shapes")))


@query(f"""WITH {TURNS}, s AS (SELECT env AS package, avg(value) AS score, count(*) AS n_rows, count(*) FILTER (tool = 'click') AS clicks FROM tu GROUP BY ALL) SELECT package, package * 10 AS traces, clicks, round(score, 6) AS score, n_rows, round(score - (SELECT score FROM s WHERE package = 0), 6) AS gain FROM s""")
def k8_scaling_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir)
    packages = t.select(F.col("env").alias("package")).distinct().withColumn("traces", F.col("package") * 10)
    counts = t.groupBy(F.col("env").alias("package"), F.col("tool").alias("kind")).agg(F.count("*").alias("n"))
    x = stats.scaling_curve(packages, counts, packages.select("package", F.lit(1.0).alias("cost")), t.select(F.col("env").alias("package"), F.col("value").cast("double").alias("score")))
    score = F.round("score", 6)
    return x.select("package", "traces", F.col("counts")["click"].alias("clicks"), score.alias("score"), "n_rows", F.round("gain", 6).alias("gain"))


@query(f"""WITH {TURNS} SELECT env, count(*) AS n_rows, round(avg(CASE WHEN k % 2 = 0 THEN 2 ELSE 9 END), 6) AS calls, count(*) FILTER (k % 2 = 1) AS at_budget, round(avg(k), 6) AS latency_mean, median(k) AS latency_median, count(*) FILTER (k % 3 = 0) AS citations, CAST(sum(k) AS BIGINT) AS tokens, CAST(sum(k) AS DOUBLE) AS estimated_tokens FROM tu GROUP BY ALL""")
def l3_row_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    rows = turns(spark, sf_dir).select("env", F.concat(F.array_repeat(F.lit("t"), F.when(k % 2 == 0, 2).otherwise(9)), F.array(F.lit("_usage"))).alias("tools"), k.cast("double").alias("latency"), F.when(k % 3 == 0, F.array(F.lit("rule"))).otherwise(F.array().cast("array<string>")).alias("citations"), k.cast("long").alias("tokens"), (k * 4).cast("long").alias("chars"))
    x = profiles.row_resources(rows, "env")
    return x.select("env", "n_rows", F.round("calls", 6).alias("calls"), "at_budget", F.round("latency_mean", 6).alias("latency_mean"), "latency_median", "citations", "tokens", F.round("estimated_tokens", 6).alias("estimated_tokens"))


@query(f"""WITH {TURNS}, r AS (SELECT DISTINCT env, call FROM tu WHERE turn % 2 = 0) SELECT event_id AS id, CASE WHEN k % 5 = 0 THEN 'empty' WHEN EXISTS (SELECT 1 FROM r WHERE r.env = tu.env AND r.call = tu.call) THEN 'copy' ELSE 'computed' END AS data_class FROM tu""")
def l5_data_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir)
    items = F.when(F.col("k") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("call"))
    return profiles.data_class(t.select(F.col("event_id").alias("id"), "env", items.alias("items")), t.where("turn % 2 = 0").select("env", F.col("call").alias("record")))


@query(f"""WITH {TURNS}, x AS (SELECT *, row_number() OVER (PARTITION BY episode, call ORDER BY turn) > 1 AS seen, coalesce(bool_or(tool = 'purchase') OVER (PARTITION BY episode ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS after_write FROM tu)
 SELECT episode, turn, call AS signature, CASE WHEN tool = 'click' THEN 'docstring' WHEN tool = 'view' THEN 'example' WHEN seen THEN 'earlier in the episode' WHEN tool = 'error' THEN 'construction' ELSE 'none' END AS origin, after_write FROM x""")
def l6_outcome_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir)
    shown = t.where("tool IN ('click', 'view')").select(F.when(F.col("tool") == "click", "docstring").otherwise("example").alias("source"), F.col("call").alias("signature")).distinct()
    return profiles.outcome_taxonomy(t.select("episode", "turn", F.col("call").alias("signature"), (F.col("tool") == "purchase").alias("changed")), shown, t.where("tool = 'error'").select(F.col("call").alias("signature")).distinct())


@query(f"""WITH {TURNS}, b AS (SELECT DISTINCT tool, k // 10 AS branch FROM tu UNION SELECT DISTINCT tool, 99 FROM tu) SELECT b.tool, b.branch, coalesce((SELECT string_agg(DISTINCT CAST(env AS VARCHAR), ',' ORDER BY CAST(env AS VARCHAR)) FROM tu WHERE tu.tool = b.tool AND k // 10 = b.branch), '') AS sources FROM b""")
def l7_branch_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir)
    ten = F.floor(F.col("k") / 10)
    branches = t.select("tool", ten.alias("branch")).union(t.select("tool", F.lit(99).cast("long"))).distinct().withColumn("template", F.concat(F.lit("^code "), "branch", F.lit("\\.\\d$")))
    x = profiles.branch_coverage(branches, t.select("tool", F.col("env").cast("string").alias("source"), F.concat(F.lit("code "), ten, F.lit("."), F.col("k") % 10).alias("text")))
    return x.select("tool", "branch", F.array_join("sources", ",").alias("sources"))


@query(f"WITH {TURNS} SELECT count(*) AS n, round(avg(CAST(answer = '3' AS INTEGER)), 9) AS constant, round(avg(CAST(k % 2 = 0 AS INTEGER)), 9) AS recorded FROM tu")
def l9_constant_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = profiles.constant_baselines(turns(spark, sf_dir).select("answer", F.when(F.col("k") % 2 == 0, F.col("answer")).alias("recorded")), "3")
    return x.select("n", F.round("constant", 9).alias("constant"), F.round("recorded", 9).alias("recorded"))


@query(f"""WITH {TURNS}, c AS (SELECT episode AS case_id, k AS step, event_id AS rule_id, turn % 3 AS priority, value AS confidence, tool AS plan FROM tu), t AS (SELECT *, max(priority) OVER (PARTITION BY case_id, step) AS p FROM c)
 SELECT case_id, step, CASE WHEN count(DISTINCT plan) = 1 THEN arg_max(rule_id, (confidence, rule_id)) END AS rule_id, count(DISTINCT plan) > 1 AS ambiguous FROM t WHERE priority = p GROUP BY ALL""")
def m3_select_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.select_rule(turns(spark, sf_dir).select(F.col("episode").alias("case_id"), F.col("k").alias("step"), F.col("event_id").alias("rule_id"), (F.col("turn") % 3).alias("priority"), F.col("value").alias("confidence"), F.col("tool").alias("plan")))


@query(f"""WITH {TURNS} SELECT count(*) AS cases, count(*) FILTER (k % 9 > 0) AS passed, CAST(sum(k) AS BIGINT) AS steps, count(DISTINCT env) AS groups, (SELECT count(DISTINCT tool) FROM tu) AS covered_rules, 'unused' AS uncovered_rules, count(*) FILTER (k % 9 = 0 AND turn % 2 = 0) AS regressions, false AS promotable FROM tu""")
def m8_replay_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir)
    results = t.select(F.col("event_id").alias("case_id"), F.col("env").alias("trajectory_group"), (F.col("k") % 9 > 0).alias("passed"), F.col("k").alias("attempted"), F.array("tool").alias("rule_ids"))
    rules = t.select(F.col("tool").alias("rule_id")).distinct().union(spark.sql("SELECT 'unused'"))
    x = replay.replay_report(results, rules, t.select(F.col("event_id").alias("case_id"), (F.col("turn") % 2 == 0).alias("passed")))
    return x.withColumn("uncovered_rules", F.array_join("uncovered_rules", ","))


@query(f"""WITH {TURNS} SELECT event_id, CASE WHEN k % 4 < 3 THEN concat('k is ', k, ' of {{"k": ', k, '}} by ', tool) END AS text FROM tu""")
def m9_render_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    template = F.when(F.col("k") % 4 < 3, "k is {action.arguments.k} of {action.arguments} by {action.type}").otherwise("{action.arguments.none}")
    context = F.to_json(F.struct(F.struct(F.col("tool").alias("type"), F.struct("k").alias("arguments")).alias("action")))
    return turns(spark, sf_dir).select("event_id", replay.render_template(template, context).alias("text"))


@query(f"""WITH {TURNS}, v AS (SELECT event_id, unnest(CASE WHEN k = 0 THEN [('negative', 'n', '-1')] ELSE [('zero', 'n', '0'), ('negative', 'n', '-1')] END) AS x FROM tu UNION ALL SELECT event_id, unnest([('flipped', 'b', 'true'), ('other_record', 'id', 'r2'), ('missing_record', 'id', 'r901'), ('empty', 'id', '')]) FROM tu)
 SELECT event_id AS key, x[1] AS operator, x[2] AS argument, x[3] AS "value" FROM v""")
def m10_perturb_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.lit('{"t": {"r1": {"s": "a"}, "r2": {"s": "b"}}}')
    x = replay.perturb_calls(turns(spark, sf_dir).select(F.col("event_id").alias("key"), "tool", F.to_json(F.struct(F.col("k").alias("n"), F.lit(False).alias("b"), F.lit("r1").alias("id"))).alias("arguments"), state.alias("state")))
    value = F.from_json("arguments", "map<string,string>")[F.col("argument")]
    return x.select("key", "operator", "argument", value.alias("value"))


@query(f"""WITH {TURNS}, f AS (SELECT *, row_number() OVER (PARTITION BY episode, turn % 5, call ORDER BY turn) AS r FROM tu) SELECT env, count(*) AS chosen, max(n) AS most FROM (SELECT env, episode, least(2, count(*)) AS n FROM f WHERE r = 1 GROUP BY ALL) t, range(n) GROUP BY ALL""")
def m11_coverage_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many candidates each environment gets: two of each user, whatever the order of choice."""
    t = turns(spark, sf_dir)
    c = t.select("env", F.col("episode").alias("trajectory"), (F.col("turn") % 5).alias("turn"), F.col("call").alias("signature"), F.col("tool").alias("label"), F.lit("zero").alias("operator"), F.col("turn").alias("key"))
    x = replay.coverage_greedy(c, 2)
    per = x.groupBy("env", "trajectory").agg(F.count("*").alias("n"))
    return per.groupBy("env").agg(F.sum("n").alias("chosen"), F.max("n").alias("most"))
