"""Queries over sources, text functions and segmentation."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from ..functions import actions, parsers, text
from ..operators import identity, segment
from ..sources import traces, trajectories
from .base import CALLS, CONVERSATIONS, TURNS, call_events, conversation_events, query, table, turns

_SEQ = CONVERSATIONS + """, isl AS (SELECT *, count(*) FILTER (kind = 'action') OVER (PARTITION BY episode_id ORDER BY pos) AS island FROM ev),
 seq AS (SELECT episode_id, min(event_id) FILTER (kind = 'action') AS action_id, min(pos) FILTER (kind = 'action') AS pos,
 coalesce(string_agg(event_id, ',' ORDER BY pos) FILTER (kind = 'observation'), '') AS observation_ids, count(*) FILTER (kind = 'observation') AS n
 FROM isl WHERE island > 0 GROUP BY episode_id, island)"""


@query(f"WITH {_SEQ} SELECT episode_id, action_id, pos, observation_ids FROM seq")
def c1_segment_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.segment_sequential(conversation_events(spark, sf_dir)).withColumn("observation_ids", F.array_join("observation_ids", ","))


_CALLS = CALLS + """, calls AS (SELECT *, count(*) OVER (PARTITION BY episode_id, call_id) > 1 AS repeated FROM ce WHERE kind = 'action' AND call_id IS NOT NULL),
 rep AS (SELECT c.episode_id, c.event_id AS action_id, c.pos, c.repeated, r.event_id AS rid, r.pos AS rpos FROM calls c LEFT JOIN ce r
 ON r.episode_id = c.episode_id AND r.tool_call_id = c.call_id AND r.kind = 'observation' AND r.pos > c.pos)"""


@query(f"WITH {_CALLS} SELECT episode_id, action_id, pos, repeated, CASE WHEN repeated THEN '' ELSE coalesce(string_agg(rid, ',' ORDER BY rpos), '') END AS observation_ids FROM rep GROUP BY episode_id, action_id, pos, repeated")
def c2_segment_correlated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.segment_correlated(call_events(spark, sf_dir)).withColumn("observation_ids", F.array_join("observation_ids", ","))


_CONCURRENT = _CALLS + """, span AS (SELECT episode_id, action_id, pos, CASE WHEN repeated THEN pos ELSE coalesce(max(rpos), pos) END AS last, coalesce(max(rpos), 2147483647) AS until
 FROM rep GROUP BY episode_id, action_id, pos, repeated),
 con AS (SELECT DISTINCT s.episode_id, s.action_id, a.event_id AS other, a.pos AS opos FROM span s JOIN ce a ON a.episode_id = s.episode_id AND a.kind = 'action' AND a.pos > s.pos AND a.pos < s.last
 UNION SELECT s.episode_id, s.action_id, p.action_id, p.pos FROM span s JOIN span p ON p.episode_id = s.episode_id AND p.pos < s.pos AND p.until > s.pos)"""


@query(f"WITH {_CONCURRENT} SELECT episode_id, action_id, string_agg(other, ',' ORDER BY opos, other) AS concurrent_ids FROM con GROUP BY ALL")
def c3_concurrent_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.concurrent_actions(call_events(spark, sf_dir)).withColumn("concurrent_ids", F.array_join("concurrent_ids", ","))


@query(f"""WITH {_CONCURRENT} SELECT s.episode_id, s.action_id, count(*) FILTER (c.opos > s.pos) AS n_inside, count(*) FILTER (c.opos < s.pos) AS n_open, count(c.other) AS n_concurrent
 FROM span s LEFT JOIN con c ON c.episode_id = s.episode_id AND c.action_id = s.action_id GROUP BY ALL""")
def c3_concurrency_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.concurrency_counts(call_events(spark, sf_dir)).select("episode_id", "action_id", "n_inside", "n_open", "n_concurrent")


@query(f"WITH {CONVERSATIONS} SELECT event_id, coalesce(string_agg(event_id, ',') OVER (PARTITION BY episode_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS history_ids FROM ev")
def c4_history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.history_window(conversation_events(spark, sf_dir), 3).select("event_id", F.array_join("history_ids", ",").alias("history_ids"))


@query(f"""WITH {_CONCURRENT}, nx AS (SELECT episode_id, event_id, pos, call_id, lead(pos) OVER (PARTITION BY episode_id ORDER BY pos) AS next_action FROM ce WHERE kind = 'action'),
 isl AS (SELECT *, count(*) FILTER (kind = 'action') OVER (PARTITION BY episode_id ORDER BY pos) AS island FROM ce),
 free AS (SELECT episode_id, island, count(*) AS n FROM isl WHERE kind = 'error' GROUP BY ALL), act AS (SELECT episode_id, island, event_id FROM isl WHERE kind = 'action'),
 ans AS (SELECT r.episode_id, r.action_id, count(rid) FILTER (NOT repeated) AS n, count(rid) FILTER (NOT repeated AND rpos >= next_action) AS late FROM rep r JOIN nx ON nx.event_id = r.action_id GROUP BY ALL),
 cc AS (SELECT action_id, count(*) AS n FROM con GROUP BY ALL)
 SELECT nx.episode_id, nx.pos, CASE WHEN coalesce(CASE WHEN call_id IS NULL THEN free.n ELSE ans.n END, 0) = 0 THEN 'ambiguous' WHEN call_id IS NULL THEN 'sequential' ELSE 'correlated' END AS alignment,
 CAST(coalesce(CASE WHEN call_id IS NULL THEN free.n ELSE ans.n END, 0) AS INTEGER) AS n_observations, CAST(coalesce(ans.late, 0) AS INTEGER) AS n_delayed, CAST(coalesce(cc.n, 0) AS INTEGER) AS n_concurrent
 FROM nx JOIN act ON act.event_id = nx.event_id LEFT JOIN free ON free.episode_id = act.episode_id AND free.island = act.island LEFT JOIN ans ON ans.action_id = nx.event_id LEFT JOIN cc ON cc.action_id = nx.event_id""")
def c6_segment_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = segment.segment_transitions(call_events(spark, sf_dir), ids=False)
    return t.select("episode_id", "pos", "alignment", F.size("observation_ids").alias("n_observations"), F.size("delayed_ids").alias("n_delayed"), F.col("n_concurrent").cast("int").alias("n_concurrent"))


@query(f"""WITH {_SEQ} SELECT seq.episode_id, seq.pos, length(a.content) AS action_chars, coalesce((SELECT sum(length(o.content) + 1) - 1 FROM isl o JOIN isl m ON m.event_id = seq.action_id
 WHERE o.episode_id = m.episode_id AND o.island = m.island AND o.kind = 'observation'), 0) AS observation_chars FROM seq JOIN ev a ON a.event_id = seq.action_id""")
def c8_transition_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = conversation_events(spark, sf_dir)
    t = segment.segment_transitions(e)
    x = segment.transition_text(e, t).join(t.select("transition_id", "episode_id", "pos"), "transition_id")
    return x.select("episode_id", "pos", F.length("action_text").cast("long").alias("action_chars"), F.length("observation_text").cast("long").alias("observation_chars"))


@query(f"""WITH {CONVERSATIONS} SELECT episode_id, count(*) AS n_events, count(*) FILTER (kind = 'action') AS n_actions, count(*) FILTER (kind = 'observation') AS n_observations,
 NOT bool_or(kind = 'action') OR NOT bool_or(kind = 'observation') AS unparsed FROM ev GROUP BY ALL""")
def c9_episode_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.episode_stats(conversation_events(spark, sf_dir))


@query(f"""WITH {_SEQ}, sp AS (SELECT *, ('0x' || substr(sha256(episode_id), 1, 8))::BIGINT % 100 AS b FROM seq)
 SELECT CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'validation' ELSE 'test' END AS split, count(DISTINCT episode_id) AS episodes, count(*) AS transitions, count(*) FILTER (n = 0) AS ambiguous,
 sum(n) AS observations FROM sp GROUP BY ALL""")
def trace_etl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations to transitions by split: the whole first workload."""
    t = segment.segment_transitions(conversation_events(spark, sf_dir))
    n = F.size("observation_ids")
    return t.groupBy(identity.stable_split(F.col("episode_id")).alias("split")).agg(F.count_distinct("episode_id").alias("episodes"), F.count("*").alias("transitions"), F.count_if(n == 0).alias("ambiguous"), F.sum(n).alias("observations"))


def _text_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    line = F.concat(F.when(F.col("role") == "assistant", "Action").when(F.col("role") == "user", "Observation").otherwise("System"), F.lit(": "), F.replace("text", F.lit("\r"), F.lit("")))
    return c.groupBy(F.col("conv_id").cast("string").alias("source_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))


@query("""SELECT CAST(conv_id AS VARCHAR) AS source_id, count(*) AS n_events, count(*) FILTER (role = 'assistant') AS n_actions, count(*) FILTER (role = 'user') AS n_observations FROM conversations GROUP BY ALL""")
def a3_text_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as role-prefixed text and parsed back."""
    e = traces.text_traces(_text_logs(spark, sf_dir))
    return e.groupBy("source_id").agg(F.count("*").alias("n_events"), F.count_if(F.col("kind") == "action").alias("n_actions"), F.count_if(F.col("kind") == "observation").alias("n_observations"))


@query("""SELECT conv_id, count(*) AS n_events, count(*) FILTER (role = 'assistant') AS n_actions, sum(length(text)) AS chars FROM conversations GROUP BY ALL""")
def a1_json_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as one JSON episode each, assistant turns as tool calls, parsed back."""
    c = table(spark, sf_dir, "conversations")
    item = F.struct(F.col("role"), F.when(F.col("role") == "assistant", "tool_call").when(F.col("role") == "user", "tool_result").alias("kind"), F.col("text").alias("content"))
    files = c.groupBy(F.col("conv_id").cast("string").alias("source_id")).agg(F.to_json(F.struct(F.transform(F.sort_array(F.collect_list(F.struct("turn", item.alias("i")))), lambda x: x["i"]).alias("messages"))).alias("text"))
    e = traces.json_traces(files)
    return e.groupBy(F.col("source_id").cast("long").alias("conv_id")).agg(F.count("*").alias("n_events"), F.count_if(F.col("kind") == "action").alias("n_actions"), F.sum(F.length("content")).alias("chars"))


@query("""SELECT user_id, count(*) AS n_events, count(*) FILTER (event_type = 'click') AS n_actions, count(DISTINCT props->>'$.k') FILTER (event_type = 'click') AS call_ids FROM events GROUP BY ALL""")
def a2_jsonl_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as one JSONL file per user, an event a line, parsed back."""
    e = table(spark, sf_dir, "events")
    click = F.col("event_type") == "click"
    line = F.to_json(F.struct(F.col("user_id").cast("string").alias("episode_id"), F.when(click, "tool_call").otherwise("message").alias("kind"), F.when(click, F.get_json_object("props", "$.k")).alias("call_id"), F.col("ts").cast("string").alias("timestamp"), F.col("value").cast("string").alias("content")))
    files = e.groupBy(F.col("user_id").cast("string").alias("source_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    x = traces.jsonl_traces(files)
    return x.groupBy(F.col("source_id").cast("long").alias("user_id")).agg(F.count("*").alias("n_events"), F.count_if(F.col("kind") == "action").alias("n_actions"), F.count_distinct("call_id").alias("call_ids"))


@query(f"""WITH {TURNS}, c AS (SELECT * FROM tu WHERE tool = 'click'), o AS (SELECT episode, k, min_by(answer, turn) AS output FROM tu WHERE tool = 'view' GROUP BY ALL),
 p AS (SELECT *, coalesce(sum(CASE tool WHEN 'click' THEN 1 WHEN 'view' THEN -1 ELSE 0 END) OVER (PARTITION BY episode ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pending FROM tu),
 b AS (SELECT *, count(*) FILTER (tool = 'click' AND pending <= 0) OVER (PARTITION BY episode ORDER BY turn) AS batch FROM p)
 SELECT b.episode AS log_id, row_number() OVER (PARTITION BY b.episode ORDER BY b.turn) AS turn, b.batch, count(*) OVER (PARTITION BY b.episode, b.batch) AS batch_size, o.output FROM b JOIN o ON o.episode = b.episode AND o.k = b.k WHERE b.tool = 'click'""")
def a12_mcp_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir)
    kind = F.when(F.col("tool") == "click", "function_call").when(F.col("tool") == "view", "function_call_output").otherwise("message")
    none = F.lit(None).cast("string")
    m = F.struct(kind.alias("type"), F.lit("user").alias("role"), F.col("k").cast("string").alias("call_id"), F.col("tool").alias("name"), F.lit("{}").alias("arguments"), F.col("answer").alias("output"), none.alias("content"), none.alias("text"))
    logs = t.groupBy(F.col("episode").alias("log_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", m.alias("m")))), lambda x: x["m"]).alias("messages"))
    return trajectories.mcp_turns(logs).select("log_id", "turn", "batch", "batch_size", "output")


@query(f"""WITH {TURNS}, i AS (SELECT *, count(*) FILTER (tool <> 'view') OVER (PARTITION BY episode ORDER BY turn) AS island FROM tu)
 SELECT episode AS log_id, island AS turn, min_by(tool, turn) AS name, coalesce(max_by(answer, turn) FILTER (tool = 'view'), min_by(answer, turn)) AS observation, count(*) FILTER (tool = 'view') AS n_folded FROM i WHERE island > 0 GROUP BY ALL""")
def a15_fold_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir).select(F.col("episode").alias("log_id"), F.col("turn").alias("pos"), F.col("tool").alias("name"), F.col("call").alias("arguments"), F.col("event_id").cast("string").alias("call_id"), F.col("answer").alias("output"))
    return trajectories.fold_snapshots(t, "view").select("log_id", "turn", "name", "observation", F.size("folded").cast("long").alias("n_folded"))


@query("""WITH k AS (SELECT user_id, (row_number() OVER (ORDER BY user_id) - 1) % 7 AS shard FROM (SELECT DISTINCT user_id FROM events))
 SELECT user_id, shard, count(*) AS n_rows FROM events JOIN k USING (user_id) GROUP BY ALL""")
def a23_shard_by_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = trajectories.shard_by_trajectory(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", 7, exact=True)
    return x.groupBy("user_id", F.col("shard").cast("long").alias("shard")).agg(F.count("*").alias("n_rows"))


@query(r"""SELECT page_id, lower(regexp_extract(p, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1)) || substr(p, length(regexp_extract(p, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1)) + 1) AS page
 FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '([?&])proxy=[^&]*&?', '\1', 'g'), '[?&/]+$', '') AS p FROM pages)""")
def b20_normalize_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.normalize_page(F.col("url")).alias("page"))


@query(r"SELECT count(*) AS n_pages, count(*) FILTER (regexp_matches(html, '&(?:[a-zA-Z]{2,8}|#\d{2,5}|#x[0-9a-fA-F]{2,5});')) AS with_entities FROM pages")
def b33_html_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").agg(F.count("*").alias("n_pages"), F.count_if(text.has_html_entities(F.col("html"))).alias("with_entities"))


@query("""SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE concat(substr(text, 1, 100), chr(10), '...[', length(text) - 200, ' characters omitted]...', chr(10), right(text, 100)) END AS clipped FROM documents""")
def b8_clip_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.clip_text(F.col("text"), 200).alias("clipped"))


@query(r"""WITH t AS (SELECT conv_id, turn, list_filter(regexp_extract_all(lower(regexp_replace(regexp_replace(text, '(^|\s)--?[A-Za-z][\w-]*', ' ', 'g'), '["''`]', ' ', 'g')), '[\w./@:-]{2,}'), lambda x: regexp_matches(x, '\w')) AS w FROM conversations),
 u AS (SELECT conv_id, turn, x, min(i) AS i FROM (SELECT conv_id, turn, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM t) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS n FROM u)
 SELECT c.conv_id, c.turn, coalesce(string_agg(x, ' ' ORDER BY n) FILTER (n <= 12), '') AS tokens FROM conversations c LEFT JOIN r ON r.conv_id = c.conv_id AND r.turn = c.turn GROUP BY ALL""")
def b28_query_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(text.query_tokens(F.col("text")), " ").alias("tokens"))


@query("SELECT event_type AS type, CAST(len(json_keys(props)) AS INTEGER) AS n_arguments, count(*) AS n FROM events GROUP BY ALL")
def b4_normalize_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a JSON call, normalised: events by type and number of arguments."""
    e = table(spark, sf_dir, "events").select(F.to_json(F.struct(F.col("event_type").alias("name"), F.col("props").alias("arguments"))).alias("body"))
    x = e.select(actions.normalize_action(F.lit("shop"), F.col("body")).alias("a"))
    return x.groupBy(F.col("a.type").alias("type"), F.size(F.from_json("a.arguments", "map<string,string>")).alias("n_arguments")).agg(F.count("*").alias("n"))


@query()
def b6_command_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First words of every document's lines as programs."""
    x = table(spark, sf_dir, "documents").select("doc_id", actions.command_programs(F.col("text")).alias("programs"))
    return x.select("doc_id", F.size("programs").alias("n_programs"), F.size(F.array_distinct("programs")).alias("n_distinct"))


@query(f"""WITH {TURNS} SELECT event_id, CASE tool WHEN 'click' THEN concat('grep', k, ',ls') WHEN 'view' THEN concat('cat,python', k) WHEN 'purchase' THEN '' WHEN 'error' THEN 'echo' ELSE concat('X=', k) END AS programs FROM tu""")
def b6_programs_by_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event's command lines: with assignments, folders, comments, keys, a here-document and open quotes."""
    tool, k = F.col("tool"), F.col("k").cast("string")
    said = (
        F.when(tool == "click", F.concat(F.lit("A=1 /usr/bin/grep"), k, F.lit(" 'x y' f\n# note\n\nTab\nls -l"))).when(tool == "view", F.concat(F.lit("cat > f <<'EOF'\nrm -rf x\nEOF\npython"), k, F.lit(" f")))
        .when(tool == "purchase", F.lit("C-c")).when(tool == "error", F.lit("echo 'open")).otherwise(F.concat(F.lit("X="), k))
    )
    return turns(spark, sf_dir).select("event_id", F.array_join(actions.command_programs(said), ",").alias("programs"))


@query("""SELECT doc_id, replace(text, chr(10), ' ') AS value FROM documents""")
def b10_model_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents inside a generation with thinking and two tagged blocks, read back."""
    body = F.replace("text", F.lit("\n"), F.lit(" "))
    gen = F.concat(F.lit("<think>a</think>b<predicted_observation>x</predicted_observation><think>c</think><predicted_observation> "), body, F.lit(" </predicted_observation>"))
    return table(spark, sf_dir, "documents").select("doc_id", parsers.parse_model_output(gen).alias("value"))
