"""Queries over identity, splits, sampling, overlap and leakage."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from ..functions.lineage import settled
from ..operators import identity, overlap
from .base import CONVERSATIONS, TOKENS, TURNS, conversation_events, query, table, turns


@query(f"""WITH {CONVERSATIONS}, s AS (SELECT episode_id, string_agg(concat(actor, '|', kind, '|', content), chr(1) ORDER BY pos) AS sig FROM ev GROUP BY ALL),
 d AS (SELECT episode_id, min(episode_id) OVER (PARTITION BY sig) AS duplicate_of FROM s) SELECT episode_id, duplicate_of, episode_id = duplicate_of AS kept FROM d""")
def d1_dedup_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.dedup_episodes(conversation_events(spark, sf_dir))


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r = 1")
def d2_longest_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.longest_records(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], "turn", ["role"])


@query("SELECT CAST(conv_id AS VARCHAR) AS id, CAST(conv_id AS VARCHAR) AS cluster_id, max(turn) + 1 AS last_order FROM conversations GROUP BY ALL")
def d3_prefix_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prefix of a conversation as a row: all belong to one trajectory."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("t"))
    rows = c.select(F.lit("chat").alias("task"), F.col("conv_id").alias("id"), "t", F.explode(F.sequence(F.lit(1), F.size("t"))).alias("order"))
    rows = rows.select("task", "id", "order", F.slice("t", F.lit(1), F.col("order")).alias("prompt"), F.slice("t", F.lit(1), F.col("order") - 1).alias("response"))
    return identity.cluster_prefix_trajectories(rows).groupBy("id", "cluster_id").agg(F.max("order").alias("last_order"))


_SPLIT = "CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'validation' ELSE 'test' END"


@query(f"SELECT {_SPLIT} AS split, count(*) AS n, sum(c_acctbal) AS balance FROM (SELECT *, ('0x' || substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 8))::BIGINT % 100 AS b FROM customer) GROUP BY ALL")
def d4_stable_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy(identity.stable_split(F.col("c_custkey")).alias("split")).agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("balance"))


@query(f"""WITH s AS (SELECT DISTINCT user_id % 50 AS source_id, user_id % 20 AS trajectory_group, {_SPLIT} AS split FROM (SELECT user_id, ('0x' || substr(sha256(CAST(user_id AS VARCHAR)), 1, 8))::BIGINT % 100 AS b FROM events))
 SELECT 'trajectory_group' AS kind, CAST(trajectory_group AS VARCHAR) AS key, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM s GROUP BY trajectory_group HAVING count(DISTINCT split) > 1
 UNION ALL SELECT 'source_id', CAST(source_id AS VARCHAR), string_agg(DISTINCT split, ',' ORDER BY split) FROM s GROUP BY source_id HAVING count(DISTINCT split) > 1""")
def d5_check_group_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("source_id"), (F.col("user_id") % 20).alias("trajectory_group"), identity.stable_split(F.col("user_id")).alias("split"))
    return identity.check_group_splits(e.distinct()).withColumn("splits", F.array_join("splits", ","))


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("source").alias("group"), F.col("lang").alias("style"), F.col("n_chars").alias("turns"))


_FOLDS = """g AS (SELECT lang AS style, source AS "group", sum(n_chars) AS turns, count(*) AS n FROM documents GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY style ORDER BY turns DESC) - 1 AS r FROM g),
 fo AS (SELECT style, "group", turns, n, CAST(CASE WHEN (r // 5) % 2 = 0 THEN r % 5 ELSE 4 - r % 5 END AS INTEGER) AS fold FROM r)"""


@query(f"WITH {_FOLDS} SELECT * FROM fo")
def d6_assign_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.assign_folds(_groups(spark, sf_dir), 5)


@query(f"""WITH {_FOLDS}, t AS (SELECT style, count(*) AS n, sum(turns) AS t FROM fo GROUP BY ALL), o AS (SELECT style, fold, count(*) AS n, sum(turns) AS t FROM fo GROUP BY ALL)
 SELECT t.style, CAST(f AS INTEGER) AS fold, t.n - coalesce(o.n, 0) AS n_groups, t.t - coalesce(o.t, 0) AS turns FROM t CROSS JOIN range(5) x(f) LEFT JOIN o ON o.style = t.style AND o.fold = f""")
def d7_cross_fit_corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.cross_fit_corpora(identity.assign_folds(_groups(spark, sf_dir), 5), 5)


@query(f"""WITH {TURNS}, a AS (SELECT *, row_number() OVER (PARTITION BY env, episode, call ORDER BY turn DESC, episode DESC) AS r FROM tu),
 b AS (SELECT *, CASE WHEN r = 1 THEN row_number() OVER (PARTITION BY r = 1, env, call, answer ORDER BY turn DESC, episode DESC) END AS r2 FROM a),
 c AS (SELECT *, CASE WHEN r2 = 1 THEN row_number() OVER (PARTITION BY coalesce(r2 = 1, false), env, tool, answer ORDER BY turn DESC, episode DESC) END AS r3 FROM b)
 SELECT CASE WHEN r > 1 THEN 'repeated in episode' WHEN r2 > 1 THEN 'same call and answer' WHEN r3 > 1 THEN 'same tool and answer' ELSE 'kept' END AS reason, count(*) AS n, sum(event_id) AS ids FROM c GROUP BY ALL""")
def d9_unique_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = identity.unique_turns(turns(spark, sf_dir).withColumn("artifact", F.lit(False)))
    return x.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("""WITH e AS (SELECT conv_id AS episode, count(*) AS total FROM conversations GROUP BY ALL) SELECT DISTINCT episode, CAST(greatest(1, round_even(i * total / 3.0, 0)) AS INTEGER) AS turn FROM e, range(1, 4) x(i)""")
def d10_evenly_spaced_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.evenly_spaced_turns(table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("episode")).agg(F.count("*").alias("total")), 3)


@query("""WITH p AS (SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)), q AS (SELECT lang, round_even(count(*) * 100.0 / (SELECT count(*) FROM p), 0) AS q FROM p GROUP BY lang)
 SELECT doc_id, p.lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha256(concat_ws('|', CAST(doc_id AS VARCHAR), '7')), doc_id) AS r FROM p) p JOIN q ON q.lang = p.lang WHERE r <= q""")
def d11_stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return identity.stratified_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), ["doc_id"], "lang", 100, 7, bad)


@query("""WITH t AS (SELECT lang AS service, source AS family, doc_id % 200 AS task, doc_id AS run, n_chars > 1000 AS solved FROM documents),
 o AS (SELECT *, row_number() OVER (PARTITION BY service, task ORDER BY solved DESC, run) AS r FROM t), s AS (SELECT * EXCLUDE (r), count(*) OVER (PARTITION BY service, family) = 1 AS single_family FROM o WHERE r = 1)
 SELECT service, task, run, single_family FROM (SELECT *, row_number() OVER (PARTITION BY service ORDER BY sha256(concat_ws('|', CAST(task AS VARCHAR), '3')), task) AS r FROM s) WHERE r <= 10""")
def d12_quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    pool = d.select(F.col("lang").alias("service"), F.col("source").alias("family"), (F.col("doc_id") % 200).alias("task"), F.col("doc_id").alias("run"), (F.col("n_chars") > 1000).alias("solved"))
    quotas = d.select(F.col("lang").alias("service")).distinct().withColumn("quota", F.lit(10))
    return identity.quota_sample(pool, quotas, 3).select("service", "task", "run", "single_family")


@query("""WITH o AS (SELECT c_custkey AS task, c_nationkey + 1 AS turns, row_number() OVER (ORDER BY sha256(concat_ws('|', CAST(c_custkey AS VARCHAR), '5')), c_custkey) AS rank FROM customer),
 c AS (SELECT *, sum(turns) OVER (ORDER BY rank) AS cumulative_turns FROM o) SELECT CAST(s AS INTEGER) AS size, task, rank, cumulative_turns FROM c, (VALUES (1), (5), (10), (20)) v(s) WHERE rank <= s""")
def d13_nested_prefix_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.nested_prefix_sets(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task"), (F.col("c_nationkey") + 1).alias("turns")), [1, 5, 10, 20], 5)


@query("SELECT event_type AS action, count(*) AS n FROM events WHERE event_type IN ('click', 'purchase') GROUP BY ALL UNION ALL SELECT 'refund', 0")
def d14_select_rows_by_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.range(3).select(F.element_at(F.array(F.lit("click"), F.lit("purchase"), F.lit("refund")), (F.col("id") + 1).cast("int")).alias("action"))
    rows, absent = identity.select_rows_by_action(table(spark, sf_dir, "events").withColumnRenamed("event_type", "action"), wanted)
    return rows.groupBy("action").agg(F.count("*").alias("n")).unionByName(absent.select("action", F.lit(0).cast("long").alias("n")))


@query("""SELECT count(*) AS n, 0 AS duplicates, count(*) FILTER (o_orderkey % 10 = 0) AS extra, 0 AS missing, count(*) FILTER (o_orderstatus = 'F') AS successes, count(*) FILTER (o_orderstatus = 'P') AS errors, 1 AS settings FROM orders""")
def d16_merge_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("success"), F.when(F.col("o_orderstatus") == "P", F.lit("pending")).alias("error"), F.lit("s").alias("settings"))
    parts = [o.where(F.col("id") % 3 == i) for i in range(3)]
    return identity.merge_slices(parts, o.where(F.col("id") % 10 != 0).select("id"))[1]


@query("""WITH f AS (SELECT event_type AS tool, min(event_id) AS "order" FROM events WHERE event_id % 2 = 0 GROUP BY ALL), o AS (SELECT *, row_number() OVER (ORDER BY tool) - 1 AS i, count(*) OVER () AS n FROM f)
 SELECT tool, "order" FROM o WHERE n <= 2 OR i = 0 OR i * 2 // n <> (i - 1) * 2 // n""")
def d17_few_shot_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    calls = e.select(F.col("event_type").alias("tool"), F.col("event_id").alias("order"), F.when(F.col("event_id") % 2 == 0, "train").otherwise("test").alias("split"), F.col("props").alias("call"), F.col("value").alias("answer"))
    definitions = e.select(F.col("event_type").alias("tool")).distinct().withColumn("position", F.lit(0))
    return identity.few_shot_examples(calls, definitions, 2).select("tool", "order")


@query("""WITH g AS (SELECT o_custkey AS task, min(o_orderkey) AS trial FROM orders WHERE o_orderstatus = 'F' AND o_totalprice < 100000 AND o_custkey % 7 <> 0 GROUP BY ALL) SELECT * FROM g""")
def d19_eligible_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("task"), F.col("o_orderkey").alias("trial"), (F.col("o_orderstatus") == "F").alias("finished"), F.lit(None).cast("string").alias("exception"), (F.col("o_totalprice") < 100000).cast("int").alias("reward"))
    strong = table(spark, sf_dir, "customer").where("c_custkey % 7 = 0").select(F.col("c_custkey").alias("task"))
    return identity.eligible_trials(t, strong).select("task", "trial")


def _tok(key: str, name: str) -> str:
    return f"SELECT DISTINCT {key} AS id, unnest(regexp_extract_all(text, '{TOKENS}')) AS token FROM {name}"


@query(f"""WITH l AS ({_tok('doc_id', 'documents')}), r AS ({_tok('item_id', 'benchmark')}), lr AS (SELECT token FROM l GROUP BY ALL HAVING count(*) <= 2), rr AS (SELECT token FROM r GROUP BY ALL HAVING count(*) <= 3),
 p AS (SELECT l.id AS left_id, r.id AS right_id, token FROM l JOIN lr USING (token) JOIN r USING (token) JOIN rr USING (token)),
 s AS (SELECT left_id, right_id, count(*) AS n_shared, count(*) FILTER (regexp_matches(token, '\\.[A-Za-z0-9]{{1,4}}$')) AS n_files FROM p GROUP BY ALL)
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY n_shared DESC, right_id) AS rank FROM s) WHERE rank <= 2""")
def e1_rare_token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = overlap.rare_token_overlap(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), id_left="doc_id", id_right="item_id")
    return x.drop("files")


@query(f"""WITH c AS ({_tok('doc_id', 'documents')}), q AS ({_tok('item_id', 'benchmark')}), d AS (SELECT token, ln((SELECT count(*) FROM documents) / count(*)) AS idf FROM c GROUP BY ALL HAVING count(*) <= 6),
 s AS (SELECT q.id AS query_id, c.id AS corpus_id, sum(idf) AS score, count(*) AS n_shared FROM q JOIN d USING (token) JOIN c USING (token) GROUP BY ALL)
 SELECT query_id, corpus_id, round(score, 6) AS score, n_shared, rank, score >= 30 AS strong FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, corpus_id) AS rank FROM s) WHERE rank <= 2""")
def e2_idf_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = overlap.idf_match(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text"), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    return x.withColumn("score", F.round("score", 6))


@query(f"""WITH t AS ({_tok('doc_id', 'documents')}), e AS (SELECT id AS "group", token AS path, lang AS style, id % 5 AS fold FROM t JOIN documents ON doc_id = id),
 r AS (SELECT style, path FROM e GROUP BY ALL HAVING count(*) BETWEEN 2 AND 3), k AS (SELECT e.* FROM e JOIN r USING (style, path)),
 s AS (SELECT a."group", b."group" AS other, count(*) AS n FROM k a JOIN k b USING (style, path) WHERE a.fold <> b.fold GROUP BY ALL), m AS (SELECT "group", max(n) AS n FROM s GROUP BY ALL)
 SELECT doc_id AS "group", coalesce(n, 0) AS max_shared, coalesce(n, 0) >= 5 AS repo_shared FROM documents LEFT JOIN m ON m."group" = doc_id""")
def e4_shared_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    rows = d.select(F.col("doc_id").alias("group"), F.regexp_extract_all("text", F.lit(TOKENS), F.lit(0)).alias("paths"))
    return overlap.shared_paths(rows, d.select(F.col("doc_id").alias("group"), F.col("lang").alias("style"), (F.col("doc_id") % 5).alias("fold")))


@query("SELECT doc_id AS row_id, d.source AS app, doc_id % 3 AS fold, (SELECT count(*) FROM documents o WHERE o.source = d.source AND o.lang = d.lang) < (SELECT count(*) FROM documents o WHERE o.source = d.source) AS app_covered FROM documents d")
def e5_app_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = overlap.app_coverage(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), F.col("source").alias("app"), F.col("lang").alias("fold")))
    return x.select("row_id", "app", (F.col("row_id") % 3).alias("fold"), "app_covered")


@query(f"""WITH d AS (SELECT doc_id AS id, lang AS app, list_sort(list_distinct(regexp_extract_all(text, '{TOKENS}'))) AS items FROM documents), c AS (SELECT app, items, min(id) AS id, count(*) AS n FROM d WHERE len(items) > 0 GROUP BY ALL)
 SELECT a.id AS left_id, b.id AS right_id, a.n AS n_left, b.n AS n_right FROM c a JOIN c b ON a.app = b.app AND a.id < b.id AND len(a.items) >= 0.8 * len(b.items) AND len(b.items) >= 0.8 * len(a.items)
 WHERE len(list_intersect(a.items, b.items)) >= 0.8 * (len(a.items) + len(b.items) - len(list_intersect(a.items, b.items)))""")
def e6_same_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one language whose whole texts have nearly the same words: pairs of classes of equal word sets, each
    named by its smallest id, and how many documents either class has."""
    items = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(TOKENS), F.lit(0))))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("app"), items.alias("items")).where(F.size("items") > 0)
    named = d.withColumn("print", F.sha2(F.array_join("items", "\n"), 256))
    classes = settled(named.groupBy("app", "print").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("items").alias("items")).drop("print").withColumn("state", F.lit(None).cast("string")))
    found = overlap.same_screen(classes, classes).where("left_id < right_id")
    size = lambda name, n: classes.select(F.col("id").alias(name), F.col("n").alias(n))
    return found.join(size("left_id", "n_left"), "left_id").join(size("right_id", "n_right"), "right_id").select("left_id", "right_id", "n_left", "n_right")


@query("""SELECT stratum, band, count(*) AS n FROM (SELECT CASE WHEN l.toxic = 1 THEN 'exact task' WHEN l.quality = 1 THEN 'same template' WHEN l.doc_id IS NOT NULL THEN 'template only' ELSE 'unlinked' END AS stratum,
 CASE WHEN (d.doc_id % 10 + 1) / 10 <= 1 / 3 THEN 'early' WHEN (d.doc_id % 10 + 1) / 10 <= 2 / 3 THEN 'middle' ELSE 'late' END AS band FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) GROUP BY ALL""")
def e7_strata_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("task"), (F.col("doc_id") % 10 + 1).alias("turn"), F.lit(10).alias("total_turns"))
    links = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("task"), F.when(F.col("toxic") == 1, "exact task").when(F.col("quality") == 1, "same template").otherwise("template only").alias("link"))
    return overlap.strata_join(rows, links).groupBy("stratum", "band").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT DISTINCT 'p' || c_mktsegment AS package, c_custkey AS task FROM customer WHERE c_custkey % 9 = 0) SELECT package, count(*) AS n FROM (SELECT DISTINCT package FROM p) CROSS JOIN orders o
 WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.package = package AND q.task = o.o_custkey AND 1 = 0) AND (package, o.o_custkey) NOT IN (SELECT (package, task) FROM p) GROUP BY ALL
 UNION ALL SELECT 'all', count(*) FROM orders WHERE o_custkey NOT IN (SELECT task FROM p)""")
def e8_leave_out_contaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = table(spark, sf_dir, "customer").where("c_custkey % 9 = 0").select(F.concat(F.lit("p"), "c_mktsegment").alias("package"), F.col("c_custkey").alias("task"))
    own, common = overlap.leave_out_contaminated(table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "task"), tasks)
    return own.groupBy("package").agg(F.count("*").alias("n")).unionByName(common.agg(F.count("*").alias("n")).select(F.lit("all").alias("package"), "n"))


@query("""SELECT count(*) FILTER (o_orderkey % 11 = 0) AS only_a, 0 AS only_b, count(*) FILTER (o_orderkey % 11 <> 0 AND o_orderkey % 13 = 0) AS texts_differ, round(avg(o_totalprice), 4) AS mean_a, round(avg(o_totalprice) FILTER (o_orderkey % 11 <> 0), 4) AS mean_b FROM orders""")
def e12_reconcile_row_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("t"), F.col("o_totalprice").alias("s"))
    b = a.where("o_orderkey % 11 <> 0").withColumn("t", F.when(F.col("o_orderkey") % 13 == 0, "changed").otherwise(F.col("t")))
    x = overlap.reconcile_row_sets(a, b, ["o_orderkey"], "t", "s")
    return x.select("only_a", "only_b", "texts_differ", F.round("mean_a", 4).alias("mean_a"), F.round("mean_b", 4).alias("mean_b"))


@query("SELECT user_id FROM events GROUP BY ALL HAVING count(DISTINCT event_type) = 5")
def f1_common_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.common_keys(table(spark, sf_dir, "events"), ["user_id"], "event_type", 5)


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def f2_missing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.missing_keys(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"])


@query("SELECT doc_id FROM labels WHERE toxic = 1 UNION SELECT doc_id FROM labels WHERE quality = 0 UNION SELECT doc_id FROM documents WHERE lang = 'es'")
def f3_union_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return overlap.union_keys([labels.where("toxic = 1"), labels.where("quality = 0"), table(spark, sf_dir, "documents").where("lang = 'es'")], ["doc_id"])


@query("""WITH a AS (SELECT user_id, props->>'$.k' AS k, bool_or(event_type = 'click') AS c, bool_or(event_type = 'view') AS v FROM events GROUP BY ALL) SELECT user_id, count(*) FILTER (c <> v) AS n FROM a GROUP BY ALL""")
def f4_symmetric_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir).groupBy("episode").agg(F.collect_set(F.when(F.col("tool") == "click", F.col("k"))).alias("a"), F.collect_set(F.when(F.col("tool") == "view", F.col("k"))).alias("b"))
    return t.select(F.col("episode").alias("user_id"), F.size(overlap.symmetric_difference(F.col("a"), F.col("b"))).cast("long").alias("n"))
