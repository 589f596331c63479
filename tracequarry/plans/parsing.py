"""Queries over readers and text functions: the driver tables written in a trace format and read back."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from ..functions import actions, parsers, text
from ..operators import retrieval
from ..sources import traces, trajectories
from .base import TURNS, query, table, turns


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as items: clicks are actions of the agent, purchases carry two tool calls, views are tool output,
    errors say their kind, signups are words of the user."""
    t = turns(spark, sf_dir)
    tool = F.col("tool")
    content = F.col("answer")
    two = F.array(F.to_json(F.struct(F.concat("call", F.lit("#0")).alias("id"), F.lit("a").alias("name"))), F.to_json(F.struct(F.concat("call", F.lit("#1")).alias("id"), F.lit("b").alias("name"))))
    item = (
        F.when(tool == "click", F.to_json(F.struct(F.lit("assistant").alias("role"), F.lit("function_call").alias("kind"), content.alias("content"), F.col("k").cast("string").alias("call_id"))))
        .when(tool == "purchase", F.concat(F.lit('{"role":"assistant","content":"'), content, F.lit('","tool_calls":['), F.array_join(two, ","), F.lit("]}")))
        .when(tool == "view", F.to_json(F.struct(F.lit("tool").alias("role"), content.alias("text"), F.col("k").cast("string").alias("tool_call_id"))))
        .when(tool == "error", F.to_json(F.struct(F.lit("error").alias("kind"), content.alias("content"))))
        .otherwise(F.to_json(F.struct(F.lit("human").alias("actor"), content.alias("value"))))
    )
    return t.select(F.lit("s").alias("source_id"), F.col("episode").cast("string").alias("episode_id"), F.col("turn").alias("pos"), item.alias("item"))


_ACTOR = "CASE tool WHEN 'click' THEN 'agent' WHEN 'purchase' THEN 'agent' WHEN 'view' THEN 'tool' WHEN 'error' THEN 'unknown' ELSE 'user' END"


@query(f"""WITH {TURNS} SELECT CAST(episode AS VARCHAR) AS episode_id, turn AS pos, {_ACTOR} AS actor, CASE tool WHEN 'click' THEN 'action' WHEN 'purchase' THEN 'message' WHEN 'view' THEN 'observation' WHEN 'error' THEN 'error' ELSE 'message' END AS kind,
 answer AS content, CASE WHEN tool = 'click' THEN CAST(k AS VARCHAR) END AS call_id, CASE WHEN tool = 'view' THEN CAST(k AS VARCHAR) END AS tool_call_id FROM tu""".replace("'purchase' THEN 'message'", "'purchase' THEN 'action'").replace("answer AS content", "CASE WHEN tool = 'purchase' THEN NULL ELSE answer END AS content"))
def a4_classify_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = traces.classify_events(_items(spark, sf_dir))
    body = F.when(F.col("tool_calls").isNull(), F.col("content"))  # with calls it is the whole item
    return x.select("episode_id", "pos", "actor", "kind", body.alias("content"), "call_id", "tool_call_id")


@query(f"""WITH {TURNS}, e AS (SELECT episode, turn, tool, call, 0 AS i FROM tu UNION ALL SELECT episode, turn, tool, call, 1 FROM tu WHERE tool = 'purchase')
 SELECT CAST(episode AS VARCHAR) AS episode_id, row_number() OVER (PARTITION BY episode ORDER BY turn, i) - 1 AS pos, CASE WHEN tool = 'purchase' THEN concat(call, '#', i) END AS purchase_id, CASE WHEN tool = 'purchase' THEN 2 ELSE 1 END AS batch_size FROM e""")
def a5_explode_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = traces.explode_tool_calls(traces.classify_events(_items(spark, sf_dir)))
    return x.select("episode_id", "pos", F.when(F.col("parent_event_id").isNotNull(), F.col("call_id")).alias("purchase_id"), "batch_size")


def _atif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as terminal trajectories of one file each: users' turns are context, assistants' type one line."""
    c = table(spark, sf_dir, "conversations")
    agent = F.col("role") == "assistant"
    call = F.struct(F.lit("c").alias("tool_call_id"), F.lit("bash_command").alias("function_name"), F.struct(F.concat("text", F.lit("\n")).alias("keystrokes"), F.col("turn").cast("double").alias("duration")).alias("arguments"))
    step = F.struct(
        F.col("turn").cast("int").alias("step_id"), F.lit(None).cast("string").alias("timestamp"), F.when(agent, "agent").otherwise("user").alias("source"), F.concat(F.lit("Task Description: "), "text", F.lit(" Current terminal state: idle")).alias("message"),
        (F.col("turn") % 7 == 6).alias("is_copied_context"), F.when(agent, F.array(call)).alias("tool_calls"), F.struct(F.array(F.struct(F.lit("c").alias("source_call_id"), F.concat(F.lit("Terminal Output:\n"), "text").alias("content"))).alias("results")).alias("observation"),
        F.struct(F.length("text").cast("long").alias("prompt_tokens"), F.col("turn").cast("long").alias("completion_tokens"), F.lit(1).cast("long").alias("cached_tokens"), F.lit(0.5).alias("cost_usd")).alias("metrics"),
    )
    g = c.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", step.alias("s")))), lambda x: x["s"]).alias("steps"))
    path = F.concat(F.lit("/t"), "conv_id", F.lit("/agent/run.json"))
    return g.select(path.alias("path"), F.concat(F.lit("/t"), "conv_id", F.lit("/agent")).alias("folder"), F.lit(None).cast("string").alias("continued_trajectory_ref"), "steps")


_OWN = "own AS (SELECT conv_id, concat('/t', conv_id, '/agent/run.json') AS trajectory, turn, role, text FROM conversations WHERE turn % 7 <> 6)"


@query(f"""WITH {_OWN} SELECT trajectory, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn, length(text) AS chars, sha256(concat(text, chr(10))) AS typed, false AS completion_only FROM own WHERE role = 'assistant'""")
def a7_atif_to_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = trajectories.atif_to_turns(_atif(spark, sf_dir))
    typed = F.from_json("keystrokes", "array<struct<keystrokes:string>>")[0]["keystrokes"]
    return x.select("trajectory", "turn", F.length("observation").alias("chars"), F.sha2(typed, 256).alias("typed"), "completion_only")


@query(f"""WITH {_OWN} SELECT trajectory, trim(min_by(text, turn), ' ' || chr(10)) AS instruction, 'idle' AS screen FROM own WHERE role <> 'assistant' GROUP BY ALL""")
def a9_initial_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectories.initial_context(_atif(spark, sf_dir))


@query(f"""WITH {_OWN} SELECT trajectory, count(*) AS steps, count(*) FILTER (role = 'assistant') AS agent_steps, CAST(sum(length(text)) AS BIGINT) AS prompt_tokens, CAST(sum(turn) AS BIGINT) AS completion_tokens, count(*) AS cached_tokens, count(*) * 0.5 AS cost_usd FROM own GROUP BY ALL""")
def a10_trajectory_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectories.trajectory_usage(_atif(spark, sf_dir))


@query(f"""WITH {_OWN} SELECT DISTINCT trajectory, CASE WHEN conv_id % 3 <> 0 THEN conv_id % 2 END AS reward FROM own""")
def a11_attach_trial_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    results = c.where("conv_id % 3 <> 0").select(F.concat(F.lit("/t"), "conv_id").alias("folder"), (F.col("conv_id") % 2).alias("reward"), F.lit(None).cast("string").alias("exception"))
    return trajectories.attach_trial_outcome(c.select(F.concat(F.lit("/t"), "conv_id", F.lit("/agent/run.json")).alias("trajectory")), results).select("trajectory", "reward")


@query("SELECT doc_id, trim(text, chr(10)) AS screen FROM documents")
def a8_strip_screen_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrapped = F.concat(F.lit("Previous response had warnings:\n- x\n\nNew Terminal Output:\n"), "text")
    return table(spark, sf_dir, "documents").select("doc_id", text.strip_screen_wrapper(wrapped).alias("screen"))


def _chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as chats: clicks and purchases call, views answer the clicks of the same k."""
    t = turns(spark, sf_dir)
    name = F.when(F.col("tool") == "click", "web_pages_open").otherwise("manage_context")
    call = F.struct(F.col("k").cast("string").alias("id"), F.lit("function").alias("type"), F.struct(name.alias("name"), F.to_json(F.struct("k")).alias("arguments")).alias("function"))
    role = F.when(F.col("tool").isin("click", "purchase"), "assistant").when(F.col("tool") == "view", "tool").otherwise("user")
    m = F.struct(role.alias("role"), F.col("answer").alias("content"), F.when(role == "tool", F.col("k").cast("string")).alias("tool_call_id"), F.when(role == "assistant", F.array(call)).alias("tool_calls"))
    return t.groupBy(F.col("episode").alias("log_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", m.alias("m")))), lambda x: x["m"]).alias("messages"))


@query(f"""WITH {TURNS}, o AS (SELECT episode, k, min_by(answer, turn) AS output FROM tu WHERE tool = 'view' GROUP BY ALL)
 SELECT c.episode AS log_id, row_number() OVER (PARTITION BY c.episode ORDER BY c.turn) AS turn, CASE WHEN c.episode % 2 = 0 THEN 'web-pages-open' ELSE 'web-pages_open' END AS tool, c.answer AS said, o.output FROM tu c JOIN o ON o.episode = c.episode AND o.k = c.k WHERE c.tool = 'click'""")
def a13_chat_tool_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = _chats(spark, sf_dir)
    servers = logs.select("log_id", F.explode(F.when(F.col("log_id") % 2 == 0, F.array(F.lit("web"), F.lit("web-pages"))).otherwise(F.array(F.lit("web"), F.lit("shop")))).alias("server"))
    return trajectories.chat_tool_turns(logs, servers).select("log_id", "turn", "tool", "said", "output")


@query("SELECT DISTINCT p_brand AS task, p_type AS tool FROM part")
def a14_tool_definition_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = table(spark, sf_dir, "part").select(F.col("p_brand").alias("task"), F.to_json(F.array(F.struct(F.struct(F.col("p_type").alias("name"), F.lit("d").alias("description")).alias("function")))).alias("tools"))
    return trajectories.tool_definition_table(logs).select("task", "tool")


@query(r"""WITH t AS (SELECT page_id, '__SHOP__/' || page_id || CASE WHEN page_id % 2 = 0 THEN ' |AND| ' ELSE ' |OR| ' END || url AS u FROM pages)
 SELECT page_id AS task, array_to_string(list_transform(string_split_regex(u, '\s*\|(?:AND|OR)\|\s*'), lambda x: replace(x, '__SHOP__', 'http://shop')), ' ') AS urls FROM t""")
def a16_resolve_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = table(spark, sf_dir, "pages").select(F.col("page_id").alias("task"), F.concat(F.lit("__SHOP__/"), "page_id", F.when(F.col("page_id") % 2 == 0, " |AND| ").otherwise(" |OR| "), "url").alias("start_url"))
    return trajectories.resolve_urls(tasks, {"__SHOP__": "http://shop"}).select("task", F.array_join("urls", " ").alias("urls"))


@query(f"WITH {TURNS} SELECT event_id, CASE tool WHEN 'click' THEN 'answer' WHEN 'view' THEN 'done' END AS kind, CASE tool WHEN 'click' THEN answer WHEN 'view' THEN concat('DONE ', answer) END AS text FROM tu")
def a17_final_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir)
    said = F.when(F.col("tool") == "click", F.concat(F.lit("so\n  FINAL ANSWER: "), "answer", F.lit("\nDONE"))).when(F.col("tool") == "view", F.concat(F.lit("DONE "), "answer")).otherwise("thinking of it")
    a = text.final_answer(said)
    return t.select("event_id", a["kind"].alias("kind"), a["text"].alias("text"))


def _rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as simulator rollouts: signups talk to the user, errors fail, the parsed copy of k above 90 is stale."""
    t = turns(spark, sf_dir)
    seen = F.concat(F.lit("{'success': True, 'n': "), "answer", F.lit("}"))
    copy_ = F.when(F.col("k") > 90, F.lit('{"success": true, "n": -1}')).otherwise(F.concat(F.lit('{"n": '), "answer", F.lit(', "success": true}')))
    name = F.when(F.col("tool") == "signup", "chat_with_user").otherwise(F.col("tool"))
    outcome = F.when(F.col("tool") == "error", "rejected").when(F.col("tool") == "view", "noop").when(F.col("tool") == "click", "effect").otherwise("?")
    none = F.lit(None).cast("string")
    s = F.struct(
        F.col("turn").cast("int").alias("step"), F.struct(name.alias("name"), F.lit("{}").alias("arguments")).alias("action"), seen.alias("observation"), copy_.alias("observation_raw"), F.when(F.col("tool") == "error", F.concat(F.lit("Traceback\n  x\nE"), "k", F.lit("\n"))).alias("error"),
        none.alias("state_before"), F.col("answer").alias("state_after"), none.alias("state_diff"), F.lit(0).alias("n_delta"), F.lit(True).alias("obs_success"), outcome.alias("sigma_t"),
    )
    g = t.groupBy("env", "episode").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", s.alias("s")))), lambda x: x["s"]).alias("trajectory"))
    return g.select(F.col("env").cast("string").alias("env_id"), F.col("episode").cast("string").alias("task_id"), none.alias("init_state"), none.alias("final_state"), "trajectory")


_OWN_CALLS = TURNS + ", oc AS (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY turn) AS n FROM tu WHERE tool <> 'signup')"


@query(f"WITH {_OWN_CALLS} SELECT CAST(env AS VARCHAR) AS env_id, CAST(episode AS VARCHAR) AS task_id, n AS turn, tool, CASE WHEN tool = 'error' THEN concat('E', k) END AS loader_error, k > 90 AS stale FROM oc")
def a18_rollout_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectories.rollout_turns(_rollouts(spark, sf_dir)).select("env_id", "task_id", "turn", "tool", "loader_error", "stale")


@query(f"WITH {_OWN_CALLS} SELECT CAST(episode AS VARCHAR) AS task_id, n AS turn, CASE tool WHEN 'error' THEN 'failure' WHEN 'view' THEN 'success' WHEN 'click' THEN 'success' ELSE 'unknown' END AS outcome, answer AS state_after FROM oc")
def a19_rollout_ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectories.rollout_ground_truth(_rollouts(spark, sf_dir)).select("task_id", "turn", "outcome", "state_after")


@query("""WITH t AS (SELECT conv_id, turn, text FROM conversations), p AS (SELECT conv_id AS id, 2 * row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, text FROM t)
 SELECT id, pos, 'agent' AS actor, 'action' AS kind, length(text) AS chars FROM p UNION ALL SELECT id, pos + 1, 'environment', 'observation', length(text) + 1 FROM p UNION ALL SELECT DISTINCT conv_id, 0, 'user', 'message', 2 FROM t""")
def a24_bench_rows_to_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("prompt"))
    rows = c.select("id", F.lit("do").alias("instruction"), F.lit(None).cast("string").alias("initial_state"), "prompt", F.transform("prompt", lambda p: F.concat(p, F.lit("!"))).alias("response"))
    return trajectories.bench_rows_to_events(rows).select("id", "pos", "actor", "kind", F.length("content").alias("chars"))


@query("""WITH t AS (SELECT p_brand AS env_id, list(DISTINCT p_type ORDER BY p_type) AS tools FROM part WHERE p_size > 3 GROUP BY ALL) SELECT p_brand AS env_id, len(tools) AS n_tools, count(DISTINCT p_partkey) FILTER (p_size = 7) AS n_tasks FROM part LEFT JOIN t ON env_id = p_brand GROUP BY ALL""")
def a25_environment_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    tools = p.where("p_size > 3").groupBy(F.col("p_brand").alias("env_id")).agg(F.to_json(F.collect_set("p_type")).alias("tools"))
    metadata = p.select(F.col("p_brand").alias("env_id")).distinct().join(tools, "env_id", "left").select("env_id", F.lit("s").alias("summary"), "tools")
    scenarios = p.where("p_size = 7").select(F.col("p_brand").alias("env_id"), F.col("p_partkey").cast("string").alias("task_id"), F.col("p_name").alias("task"))
    return trajectories.environment_definitions(metadata, scenarios).select("env_id", F.size("tools").alias("n_tools"), F.size("tasks").alias("n_tasks"))


def _prompt(turn: Column, state: Column, body: Column) -> Column:
    return F.concat(F.lit("### Turn "), turn.cast("string"), F.lit("\n**Current State:**\n"), state, F.lit("\n**Action:**\n```json\n"), body, F.lit("\n```\n"))


@query(f"WITH {TURNS} SELECT event_id, turn, tool AS state, concat('{{\"k\": ', k, '}}') AS body, 'json' AS language FROM tu")
def b1_prompt_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _prompt(F.col("turn"), F.col("tool"), F.concat(F.lit('{"k": '), "k", F.lit("}")))
    s, a = text.prompt_sections(p), text.action_block(p)
    return turns(spark, sf_dir).select("event_id", s["turn"].alias("turn"), s["current_state"].alias("state"), a["body"].alias("body"), a["language"].alias("language"))


@query(r"SELECT doc_id, trim(replace(text, '**Environment Observation:**', ''), ' ' || chr(9) || chr(10) || chr(13)) AS cleaned FROM documents")
def b3_clean_response_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.clean_response_marker(F.concat(F.lit("**Environment Observation:**\n "), "text")).alias("cleaned"))


@query(f"""WITH {TURNS} SELECT event_id, CASE tool WHEN 'click' THEN 'touch' WHEN 'view' THEN 'scroll' WHEN 'purchase' THEN 'shop.buy' WHEN 'error' THEN 'page.open' ELSE 'set_text' END AS type, CASE tool WHEN 'click' THEN 'button' WHEN 'signup' THEN 'input' END AS element,
 CASE WHEN tool <> 'view' THEN CAST(k AS VARCHAR) END AS id, CASE tool WHEN 'signup' THEN answer END AS input, CASE tool WHEN 'view' THEN 'down' END AS direction FROM tu""")
def b4_screen_and_call_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as action text of several kinds, read back."""
    k, tool = F.col("k").cast("string"), F.col("tool")
    body = (
        F.when(tool == "click", F.concat(F.lit("touch <button id="), k, F.lit(" name='a b'>Go</button>"))).when(tool == "view", F.lit("scroll down"))
        .when(tool == "purchase", F.concat(F.lit("shop.buy(id='"), k, F.lit("')"))).when(tool == "error", F.concat(F.lit('<invoke name="page"><parameter name="action">open</parameter><parameter name="id">"'), k, F.lit('"</parameter></invoke>')))
        .otherwise(F.concat(F.lit("set_text <input id="), k, F.lit(">old</input> "), F.col("answer")))
    )
    a = turns(spark, sf_dir).select("event_id", actions.normalize_action(F.lit("android"), body).alias("a"))
    get = lambda name: F.get_json_object("a.arguments", f"$.{name}").alias(name)
    return a.select("event_id", F.col("a.type").alias("type"), *map(get, ("element", "id", "input", "direction")))


@query(f"""WITH {TURNS} SELECT event_id, CASE tool WHEN 'click' THEN 'grep' WHEN 'view' THEN 'shell' WHEN 'purchase' THEN 'keys' WHEN 'error' THEN 'wait' ELSE 'shell' END AS type,
 CASE tool WHEN 'click' THEN 1 END AS n_args, CASE tool WHEN 'view' THEN 'cat,wc' WHEN 'signup' THEN 'ls' END AS programs FROM tu""")
def b5_terminal_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    tool = F.col("tool")
    key = lambda *parts: F.to_json(F.array(*(F.struct(p.alias("keystrokes"), F.lit(1.0).alias("duration")) for p in parts)))
    batch = F.when(tool == "click", key(F.concat(F.lit("A=1 /bin/grep 'x "), "k", F.lit("'\n")))).when(tool == "view", key(F.lit("cat <<E\nrm\nE\n"), F.lit("wc -l f\n"))).when(tool == "purchase", key(F.lit("q"))).when(tool == "error", key(F.lit(""))).otherwise(key(F.lit("C-c"), F.lit("ls\n")))
    a = turns(spark, sf_dir).select("event_id", actions.terminal_action(batch).alias("a"))
    size = F.when(F.col("a.type") == "grep", F.size(F.from_json(F.get_json_object("a.arguments", "$.argv"), "array<string>")))
    return a.select("event_id", F.col("a.type").alias("type"), size.alias("n_args"), F.array_join(F.from_json(F.get_json_object("a.arguments", "$.programs"), "array<string>"), ",").alias("programs"))


@query("SELECT item_id, CASE item_id % 4 WHEN 0 THEN '{}' WHEN 1 THEN concat('{\"n\": ', item_id, '}') WHEN 2 THEN concat('{\"value\":', item_id, '}') ELSE concat('{\"raw\":\"no json ', item_id, '\"}') END AS arguments FROM benchmark")
def b7_mcp_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("item_id")
    given = F.when(i % 4 == 0, "").when(i % 4 == 1, F.concat(F.lit('{"n": '), i, F.lit("}"))).when(i % 4 == 2, i.cast("string")).otherwise(F.concat(F.lit("no json "), i))
    return table(spark, sf_dir, "benchmark").select("item_id", text.mcp_arguments(given).alias("arguments"))


@query(f"""WITH {TURNS} SELECT event_id, tool AS kind, k > 50 AS clipped, CASE WHEN k > 50 THEN 40 ELSE k END AS shown, 1 AS n_metadata FROM tu""")
def b9_event_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents of k characters, clipped beyond 50 to 10 and a mark of 30; of two metadata keys one stays."""
    t = turns(spark, sf_dir)
    body = F.to_json(F.struct(F.lit("typed").alias("raw"), F.struct(F.expr("repeat('x', k)").alias("t")).alias("arguments")))
    events = t.select("event_id", F.lit("agent").alias("actor"), F.col("tool").alias("kind"), body.alias("content"), F.lit(None).cast("timestamp").alias("ts"), F.create_map(F.lit("raw_action"), F.lit("a"), F.lit("page"), F.col("answer")).alias("metadata"))
    v = parsers.event_view(events, 50)
    shown = F.get_json_object("content", "$.arguments.t")
    hidden = F.get_json_object("content", "$.raw").isNull()
    mark = F.when(F.col("clipped"), F.length(F.regexp_replace(shown, "[^x]", "")) - 10).otherwise(F.length(shown))
    return v.where(hidden).select("event_id", "kind", "clipped", mark.cast("int").alias("shown"), F.size("metadata").alias("n_metadata"))


@query(f"""WITH {TURNS} SELECT event_id, k % 10 < 8 AS success, CASE WHEN k % 10 < 8 THEN (k % 5 + 1 + 5) / 2.0 ELSE 0.0 END AS total, CASE WHEN k % 10 < 8 THEN k % 5 + 1 ELSE 0 END AS format, CASE k % 10 WHEN 8 THEN 'no JSON object' WHEN 9 THEN 'empty output' END AS error FROM tu""")
def b11_parse_judge_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    body = F.concat(F.lit('{"scores": {"format": '), k % 5 + 1, F.lit(', "factuality": "5/5", "consistency": 0,}, "strengths": ["s"]}'))
    said = F.when(k % 10 == 8, "I can't judge this").when(k % 10 == 9, "<think>a</think>").when(k % 2 == 0, F.concat(F.lit("<think>{}</think>```json\n"), body, F.lit("\n```"))).otherwise(F.concat(F.lit("See {x}. <evaluation>"), body, F.lit("</evaluation>")))
    j = turns(spark, sf_dir).select("event_id", parsers.parse_judge_output(said).alias("j"))
    return j.select("event_id", "j.success", "j.total", "j.format", "j.error")


@query(f"""WITH {TURNS} SELECT event_id, tool <> 'error' AS parsed, CASE tool WHEN 'click' THEN concat('{{"a": [', k, ', null], "b": true}}') WHEN 'view' THEN concat('{{"n": ', k, '}}') WHEN 'purchase' THEN concat('"', answer, '"') WHEN 'signup' THEN CAST(k AS VARCHAR) END AS value FROM tu""")
def b13_parse_observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    tool, k = F.col("tool"), F.col("k").cast("string")
    said = F.when(tool == "click", F.concat(F.lit("{'b': True, 'a': ["), k, F.lit(", None]}"))).when(tool == "view", F.concat(F.lit('```json\n{"n": '), k, F.lit("}\n```"))).when(tool == "purchase", F.concat(F.lit("'"), "answer", F.lit("'"))).when(tool == "signup", k).otherwise("no value at all")
    o = turns(spark, sf_dir).select("event_id", parsers.parse_observation(said).alias("o"))
    return o.select("event_id", "o.parsed", "o.value")


@query("SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'error' WHEN 'N' THEN 'data' ELSE 'message' END AS kind, round((l_linenumber - 1) / 4 * 100, 6) AS score FROM lineitem")
def b14_response_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("l_returnflag") == "A", '{"success": false, "error": "x"}').when(F.col("l_returnflag") == "N", '{"success": true, "data": []}').otherwise('{"message": "m"}')
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.response_kind(value).alias("kind"), F.round(text.normalize_score(F.col("l_linenumber")), 6).alias("score"))


@query(f"""WITH {TURNS} SELECT event_id, tool, CASE WHEN tool = 'error' THEN 'error' WHEN tool = 'view' THEN 'data' ELSE 'message' END AS kind, CASE WHEN tool = 'view' THEN '' ELSE 'Order {{}} is {{}}.' END AS wording FROM tu""")
def b15_outcome_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    tool = F.col("tool")
    number = F.concat(F.lit("N-"), "k")
    said = F.when(tool == "error", F.concat(F.lit("{'success': False, 'error': \"Order "), number, F.lit(" is 'late'.\"}"))).when(tool == "view", F.lit("{'success': True, 'data': [1]}")).otherwise(F.concat(F.lit("{'success': True, 'message': \"Order "), number, F.lit(" is ['a', 'b'].\"}")))
    s = turns(spark, sf_dir).select("event_id", parsers.outcome_signature(said, tool, F.to_json(F.struct(number.alias("order"))), F.array().cast("array<string>")).alias("s"))
    return s.select("event_id", "s.tool", "s.kind", "s.wording")


@query(f"""WITH {TURNS} SELECT concat('[["a", "[1, 2, ', k % 3 + 3, ']"], ["id", "\\"<uuid>\\""]]') AS canonical, count(*) AS n FROM tu GROUP BY ALL""")
def b16_canonical_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.md5(F.col("event_id").cast("string"))
    uuid = F.concat_ws("-", F.substring(x, 1, 8), F.substring(x, 9, 4), F.substring(x, 13, 4), F.substring(x, 17, 4), F.substring(x, 21, 12))
    value = F.concat(F.lit('{"id": "'), uuid, F.lit('", "a": [2, '), F.col("k") % 3 + 3, F.lit(", 1]}"))
    return turns(spark, sf_dir).groupBy(parsers.canonical_value(value).alias("canonical")).agg(F.count("*").alias("n"))


@query(f"""WITH {TURNS} SELECT event_id, concat('/srv/d', k, '/f', k, '.csv,f', k, '.csv') AS names, concat('/srv/in', k, ',in', k) AS operands FROM tu""".replace(",in', k)", "')"))
def b17_specific_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k").cast("string")
    names = text.specific_tokens(F.concat(F.lit("cat /srv/d"), k, F.lit("/f"), k, F.lit(".csv, v1.2.3 and http://x/y.csv")))
    operands = text.action_operands(F.to_json(F.struct(F.concat(F.lit("cp /srv/in"), k, F.lit(" x\nmore /z/none")).alias("command"), F.lit("/a/b.csv").alias("content"))))
    return turns(spark, sf_dir).select("event_id", F.array_join(names, ",").alias("names"), F.array_join(operands, ",").alias("operands"))


@query(f"""WITH {TURNS}, s AS (SELECT episode, concat('u', k % 3) AS u, concat('/d', max_by(k, turn)) AS cwd, count(*) AS n FROM tu GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY n DESC, u) AS r FROM s) SELECT episode, u AS "user", 'h' AS host, cwd, n FROM r WHERE r = 1""")
def b24_prompt_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a prompt line of one of three users; the line before it is output."""
    t = turns(spark, sf_dir)
    shown = F.concat(F.lit("out: x\nu"), F.col("k") % 3, F.lit("@h:/d"), "k", F.lit("$ ls -l"))
    lines = text.shell_prompt_lines(t.select("episode", F.col("turn").alias("pos"), shown.alias("text")), ["episode", "pos"], "text")
    return text.prompt_signature(lines, ["episode"]).select("episode", "user", "host", "cwd", "n")


@query(f"""WITH {TURNS} SELECT event_id, CASE k % 3 WHEN 0 THEN 'idle_prompt' WHEN 1 THEN 'command_typed_no_output_yet' ELSE 'program_output_in_progress' END AS state, CASE k % 3 WHEN 1 THEN 'make all' END AS command, 1 + CAST(k % 2 = 0 AS INTEGER) + CAST(turn >= 20 AS INTEGER) AS n_tags FROM tu""")
def b25_wait_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    last = F.when(k % 3 == 0, "a@h:/srv# ").when(k % 3 == 1, "a@h:/srv# make all").otherwise("compiling 3 of 9")
    s = text.wait_state(F.concat(F.lit("first\n"), last, F.lit("\n\n")))
    seen = F.when(k % 2 == 0, "no such file").otherwise("fine")
    tags = text.turn_tags(F.lit("cat out.txt"), F.array(F.lit("echo 1 > out.txt")), F.col("turn"), seen)
    return turns(spark, sf_dir).select("event_id", s["state"].alias("state"), s["command"].alias("command"), F.size(tags).alias("n_tags"))


@query(f"WITH {TURNS} SELECT event_id, CASE k % 5 WHEN 0 THEN 'wait' WHEN 1 THEN 'single' WHEN 2 THEN 'batch' WHEN 3 THEN 'keys' ELSE 'unparsed' END AS kind FROM tu")
def b31_action_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    typed = F.when(k % 5 == 0, "").when(k % 5 == 1, "ls\n").when(k % 5 == 2, "ls\npwd\n").otherwise("q")
    body = F.when(k % 5 == 4, "no keys").otherwise(F.to_json(F.array(F.struct(typed.alias("keystrokes"), F.lit(1.0).alias("duration")))))
    return turns(spark, sf_dir).select("event_id", text.action_kind(_prompt(F.col("turn"), F.lit("s"), body)).alias("kind"))


@query("SELECT page_id, CASE WHEN contains(url, 'example.com') THEN 'com' WHEN contains(url, 'example.net') THEN 'net' ELSE 'other' END AS site, CASE WHEN page_id % 4 = 0 THEN 'edit' WHEN page_id % 4 = 1 THEN 'bash' ELSE 'other' END AS scaffold FROM pages")
def b34_site_and_scaffold(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id") % 4
    tools = F.when(i == 0, F.array(F.lit("str_replace"), F.lit("view"), F.lit("run"))).when(i == 1, F.array(F.lit("run"))).otherwise(F.array(F.lit("browse")))
    return table(spark, sf_dir, "pages").select("page_id", text.site_of(F.col("url"), {"example.com": "com", "example.net": "net"}).alias("site"), text.scaffold_of(tools, {"edit": ["str_replace", "view"], "bash": ["run"]}).alias("scaffold"))


@query(f"""WITH {TURNS} SELECT CAST(episode AS VARCHAR) AS query_id, count(*) AS n, sum(length(answer) + length(call) + length(CAST(event_id AS VARCHAR)) + 25) + 2 * count(*) - 2 AS chars FROM tu WHERE turn <= 5 GROUP BY ALL""")
def h6_rag_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir).where("turn <= 5").withColumn("id", F.col("event_id"))
    x = retrieval.rag_block(t.select(F.col("episode").cast("string").alias("query_id"), "id", F.col("turn").alias("rank")), t.select("id", F.col("call").alias("action_text"), F.col("answer").alias("observation")), 1000)
    return x.select("query_id", F.size("ids").cast("long").alias("n"), F.length("block").cast("long").alias("chars"))


@query("""WITH c AS (SELECT conv_id, count(*) AS n, sum(length(text)) AS chars FROM conversations GROUP BY ALL) SELECT conv_id, 2 * n AS n_messages, CAST(2 * chars - length(l.text) + 4 AS BIGINT) AS chars FROM c JOIN conversations l USING (conv_id) WHERE l.turn = (SELECT max(turn) FROM conversations m WHERE m.conv_id = c.conv_id)""")
def h7_chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("t"))
    m = retrieval.chat_messages(F.col("t"), F.col("t"), F.size("t"), F.lit("sys!"), F.element_at("t", -1))
    return c.select("conv_id", m.alias("m")).select("conv_id", F.size("m").cast("long").alias("n_messages"), F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + F.length(x["content"])).alias("chars"))
