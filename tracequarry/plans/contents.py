"""Queries over exports, digests, transcripts, screens, pages and annotations: written, read back, and compared by
content."""

from __future__ import annotations

import uuid

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from ..functions import parsers, text
from ..functions.lineage import shared_folder
from ..operators import identity, retrieval, search, segment
from ..sources import traces, trajectories
from .base import TURNS, query, table, turns


def _place(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


@query("""SELECT 'chat' AS task, CAST(conv_id AS VARCHAR) AS id, count(*) AS n, string_agg(text, chr(1) ORDER BY turn) AS prompts, max(turn) AS turn_idx FROM conversations GROUP BY ALL""")
def a6_bench_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as benchmark rows in JSONL files, read from their folder."""
    c = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("prompt"), F.max("turn").alias("turn_idx"))
    place = _place(spark)
    c.select(F.lit("chat").alias("task"), "id", "prompt", "turn_idx").write.json(place)
    x = trajectories.read_bench_rows(spark, [place], "*.json")
    return x.select("task", "id", F.size("prompt").cast("long").alias("n"), F.array_join("prompt", "\1").alias("prompts"), "turn_idx")


_SPLIT = "CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'validation' ELSE 'test' END"
_SPLITS = f"sp AS (SELECT user_id, {_SPLIT} AS split FROM (SELECT DISTINCT user_id, ('0x' || substr(sha256(CAST(user_id AS VARCHAR)), 1, 8))::BIGINT % 100 AS b FROM events))"


def _exported(spark: SparkSession, sf_dir: str, place: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("episode_id"), "event_id", "event_type", "value")
    splits = e.select("episode_id").distinct().withColumn("split", identity.stable_split(F.col("episode_id")))
    return trajectories.export_episodes(e, splits, place)


@query(f"WITH {_SPLITS} SELECT split, count(DISTINCT user_id) AS episodes, count(*) AS turns FROM events JOIN sp USING (user_id) GROUP BY ALL")
def a20_export_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log by split, written, and counted in the files."""
    return _exported(spark, sf_dir, _place(spark))


@query("SELECT event_type AS action_type, CAST(user_id AS VARCHAR) AS rule_id, count(*) AS support, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def a21_write_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule for each user and event type, written as JSON by action type, read back with its type from the folder."""
    e = table(spark, sf_dir, "events")
    rules = e.groupBy(F.col("event_type").alias("action_type"), F.col("user_id").cast("string").alias("rule_id")).agg(F.count("*").alias("support"), F.round(F.sum("value"), 4).alias("total"))
    place = _place(spark)
    trajectories.write_catalog(rules, {"notes": e.groupBy("user_id").agg(F.max("value").alias("most"))}, place)
    return spark.read.schema("rule_id string, support long, total double, action_type string").json(f"{place}/rules").select("action_type", "rule_id", "support", "total")


@query(f"""WITH {_SPLITS}, s AS (SELECT DISTINCT split FROM sp) SELECT concat('split=', split) AS folder, status, n FROM s, (VALUES ('verified', 1), ('mismatched', 1), ('missing', 1)) AS v(status, n)""")
def a22_file_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export's files against its manifest, to which each folder has a file that isn't there and one with another
    digest added: whether there are verified, mismatched and missing ones."""
    place = _place(spark)
    _exported(spark, sf_dir, place)
    manifest = spark.read.parquet(f"{place}/{trajectories.MANIFEST}").select("path", "folder", "sha256")
    first = manifest.groupBy("folder").agg(F.min("path").alias("path"))
    gone = first.select(F.concat("folder", F.lit("/gone")).alias("path"), "folder", F.lit("0").alias("sha256"))
    altered = first.select("path", "folder", F.lit("1").alias("sha256"))
    verified = trajectories.verify_export(spark, place)
    other = trajectories.verify_digests(trajectories.file_digests(spark, place).join(altered.select("path"), "path", "left_semi"), gone.unionByName(altered))
    folder = F.regexp_extract("folder", r"split=\w+$", 0).alias("folder")
    return verified.unionByName(other).select(folder, "status", F.lit(1).alias("n")).distinct()


@query(f"""WITH {TURNS}, l AS (SELECT event_id, unnest([concat('/srv/in', k, '.csv'), concat('in', k, '.csv'), concat('job', k), concat('/data/call', k, '.json'), concat('call', k, '.json')]) AS name FROM tu) SELECT DISTINCT event_id, name FROM l""")
def b19_transcript_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A terminal's transcript an event: a typed command, a listing with generic and short names, a JSON call, and output
    that names files of its own."""
    k = F.col("k").cast("string")
    said = F.concat(
        F.lit("root@box:/srv# cat /srv/in"), k, F.lit(".csv\nsee /other/out.csv\ntotal 8\n-rw-r--r-- 1 root root 12 Oct 31 2025 job"), k, F.lit("\n-rw-r--r-- 1 root root 4 Oct 31 2025 abc\n-rw-r--r-- 1 root root 4 Oct 31 10:20 README.md\n"),
        F.lit('```json\n{"name": "open", "arguments": {"path": "/data/call'), k, F.lit('.json", "content": "/no/where.txt"}}\n```'),
    )
    return text.transcript_names(turns(spark, sf_dir).select("event_id", said.alias("said")), "event_id", "said")


@query(f"""WITH {TURNS} SELECT event_id, concat('s', k) AS state, 'com.shop' AS app, concat('com.shop:id/a,com.shop:id/b', k, ',com.shop:id/c') AS items FROM tu""")
def b21_screen_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k").cast("string")
    said = F.concat(F.lit("state_id: s"), k, F.lit(" com.shop:id/c com.shop:id/b"), k, F.lit(" android:id/x org.other:id/y com.shop:id/a com.shop:id/c"))
    s = text.screen_signature(said)
    return turns(spark, sf_dir).select("event_id", s["state"].alias("state"), s["app"].alias("app"), F.array_join(s["items"], ",").alias("items"))


@query(f"""WITH {TURNS} SELECT event_id, concat('<host>:/srv# ls -l', chr(10), 'total <n>', chr(10), '-rw-r--r-- 1 root root <n> <date> ', CASE WHEN k % 2 = 0 THEN concat('plan', k) ELSE '<name>' END, chr(10), CASE WHEN k % 2 = 0 THEN concat('plan', k) ELSE '<name>' END, ' <file.csv> <path> <ip>') AS text, CASE WHEN k % 2 = 0 THEN 7 ELSE 9 END AS masked FROM tu""")
def b22_mask_foreign_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing of another run: its size, name, date, host and files are hidden, unless the row's own episode has shown
    the name. Both inventories come from the tables, by joins."""
    t = turns(spark, sf_dir)
    name = F.concat(F.lit("plan"), F.col("k").cast("string"))
    said = F.concat(F.lit("root@06e31eef63ee:/srv# ls -l\ntotal 24\n-rw-r--r-- 1 root root "), (F.col("k") + 1000).cast("string"), F.lit(" Oct 31 2025 "), name, F.lit("\n"), name, F.lit(" data.csv /other/x 10.0.0."), (F.col("k") % 200).cast("string"))
    shown = t.where("k % 2 = 0").groupBy("event_id").agg(F.collect_set(name).alias("known"))
    found = t.groupBy("event_id").agg(F.collect_set(name).alias("foreign"))
    x = t.join(shown, "event_id", "left").join(found, "event_id")
    m = parsers.mask_foreign_values(said, F.col("known"), F.col("foreign"))
    return x.select("event_id", m.alias("m")).select("event_id", "m.text", "m.masked")


@query(f"""WITH {TURNS} SELECT event_id, concat('u@h:/srv# cd d', k, chr(10), 'u@h:/srv/d', k, '# cat > f <<EOF', chr(10), '> ', answer, chr(10), '> EOF', chr(10), 'u@h:/srv/d', k, '# cd ..', chr(10), 'u@h:/srv# cd', chr(10), 'u@h:~# ls') AS echoed FROM tu""")
def b26_transcript_scaffold(spark: SparkSession, sf_dir: str) -> DataFrame:
    commands = F.array(F.concat(F.lit("cd d"), "k"), F.lit("cat > f <<EOF"), F.col("answer"), F.lit("EOF"), F.lit("cd .."), F.lit("cd"), F.lit("ls"))
    echoed = parsers.transcript_scaffold(commands, F.lit("u"), F.lit("h"), F.lit("/srv"), F.lit("#"))
    return turns(spark, sf_dir).select("event_id", F.array_join(echoed, "\n").alias("echoed"))


@query(f"""WITH {TURNS} SELECT event_id, concat('Does ', tool, '.', chr(10), chr(10), 'Notes: ', k) AS description FROM tu""")
def b27_clean_tool_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("Does "), "tool", F.lit(".\nReturns: a value of "), "k", F.lit("\n  and more\n\nNotes: "), "k")
    return turns(spark, sf_dir).select("event_id", text.clean_tool_description(said).alias("description"))


@query("""WITH p AS (SELECT conv_id, turn, text, greatest(1, instr(lower(text), w) - 10) AS start FROM (SELECT *, regexp_extract(lower(text), '^[^\\p{L}\\p{N}]*(?:[\\p{L}\\p{N}]+[^\\p{L}\\p{N}]+){2}([\\p{L}\\p{N}]+)', 1) AS w FROM conversations) WHERE w <> '')
 SELECT conv_id, turn, substr(text, CAST(start AS BIGINT), 40) AS snippet FROM p""")
def b29_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn asked for its own third word: the window around the word's first place."""
    c = table(spark, sf_dir, "conversations").withColumn("id", F.concat_ws(":", "conv_id", "turn")).withColumn("w", F.get(search.terms(F.col("text")), F.lit(2))).where("w IS NOT NULL")
    hits = c.select(F.col("id").alias("query_id"), "id", "conv_id", "turn")
    x = retrieval.with_snippets(hits, c.select(F.col("id").alias("query_id"), F.col("w").alias("text")), c.select("id", "text"), 40)
    return x.select("conv_id", "turn", "snippet")


@query("""WITH c AS (SELECT conv_id AS episode, turn, role AS action_type, text FROM conversations) SELECT episode, turn, length(text) AS total_chars, substr(text, turn * 7 + 1, 30) AS text, CASE WHEN turn * 7 + 30 < length(text) THEN turn * 7 + 30 END AS next_offset,
 coalesce((SELECT string_agg(concat(n.turn, n.action_type), ',' ORDER BY n.turn) FROM c n WHERE n.episode = c.episode AND abs(n.turn - c.turn) = 1), '') AS neighbours FROM c""")
def b30_read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("episode"), "turn", F.col("role").alias("action_type"), F.col("text").alias("observation"))
    x = retrieval.read_pages(c.select("episode", "turn", (F.col("turn") * 7).alias("offset"), F.lit(30).alias("length")), c)
    return x.select("episode", "turn", F.col("total_chars").cast("long").alias("total_chars"), "text", F.col("next_offset").cast("long").alias("next_offset"), F.array_join(F.transform("neighbours", lambda n: F.concat(n["turn"], n["action_type"])), ",").alias("neighbours"))


@query("""SELECT event_id, CASE WHEN event_id % 3 < 2 THEN epoch_us(ts) END AS micros, CASE WHEN event_id % 3 = 2 THEN concat('late ', event_id) END AS raw FROM events""")
def b35_parse_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as ISO text, with and without a zone, and texts that are none."""
    e = table(spark, sf_dir, "events")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    said = F.when(F.col("event_id") % 3 == 0, iso).when(F.col("event_id") % 3 == 1, F.concat(iso, F.lit("Z"))).otherwise(F.concat(F.lit("late "), "event_id"))
    ts, raw = traces.parse_timestamp(said)
    return e.select("event_id", F.unix_micros(ts.cast("timestamp")).alias("micros"), raw.alias("raw"))


@query("""WITH p AS (SELECT doc_id, lang, text, length(text) AS n FROM documents WHERE length(text) > 0), s AS (SELECT doc_id, 3 AS a, least(n, 9) AS z, 'agent' AS actor FROM p WHERE n > 3 UNION ALL SELECT doc_id, 12, least(n, 20), 'tool' FROM p WHERE n > 12),
 cut AS (SELECT doc_id, 0 AS a, least(n, 3) AS z, 'message' AS kind FROM p UNION ALL SELECT doc_id, 3, least(n, 9), 'agent' FROM p WHERE n > 3 UNION ALL SELECT doc_id, 9, least(n, 12), 'message' FROM p WHERE n > 9 UNION ALL SELECT doc_id, 12, least(n, 20), 'tool' FROM p WHERE n > 12 UNION ALL SELECT doc_id, 20, n, 'message' FROM p WHERE n > 20)
 SELECT CAST(doc_id AS VARCHAR) AS episode_id, row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS pos, kind, substr(text, a + 1, z - a) AS content FROM cut JOIN p USING (doc_id)""")
def c7_apply_span_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two marked spans in every document; documents come apart into spans and what lies between them."""
    d = table(spark, sf_dir, "documents").where(F.length("text") > 0)
    doc = F.col("doc_id").cast("string")
    events = d.select(doc.alias("episode_id"), doc.alias("event_id"), F.lit(0).alias("pos"), F.lit("x").alias("actor"), F.lit("message").alias("kind"), F.col("text").alias("content"))
    span = lambda a, z, name: d.where(F.length("text") > a).select(doc.alias("event_id"), F.lit(a).alias("start"), F.least(F.length("text"), F.lit(z)).alias("end"), F.lit(name).alias("actor"), F.lit(name).alias("kind"))
    out, _ = segment.apply_span_annotations(events, span(3, 9, "agent").unionByName(span(12, 20, "tool")))
    return out.select("episode_id", F.col("pos").cast("long").alias("pos"), "kind", "content")
