"""Golden fixtures for readers, segmentation and trajectories."""

import json

import pyspark.sql.functions as F

from tracequarry.operators import segment
from tracequarry.sources import traces, trajectories


def files(spark, *texts):
    return spark.createDataFrame([(f"src_{i}", t) for i, t in enumerate(texts)], "source_id string, text string")


LEDGER = """User: pay 5
Action: {"type": "deposit", "arguments": {"amount": 5}}
Observation: balance 105
and a second line
Action: {"type": "withdraw", "arguments": {"amount": 25}}
Observation: balance 80
User: thanks"""


def test_text_traces(spark):
    e = traces.text_traces(files(spark, LEDGER))
    rows = e.orderBy("pos").collect()
    assert [r.kind for r in rows] == ["message", "action", "observation", "action", "observation", "message"]
    assert rows[2].content == "balance 105\nand a second line"
    t = segment.segment_transitions(e).orderBy("pos").collect()
    assert [(x.alignment, len(x.observation_ids)) for x in t] == [("sequential", 1), ("sequential", 1)]


def test_text_without_labels_is_one_message(spark):
    (r,) = traces.text_traces(files(spark, "just\nwords")).collect()
    assert (r.kind, r.content) == ("message", "just\nwords")


def test_jsonl_events_by_episode(spark):
    lines = [{"episode_id": "a", "actor": "agent", "kind": "action", "content": "x"}, {"episode_id": "a", "role": "tool", "content": "1"}, {"episode_id": "b", "actor": "agent", "kind": "action", "content": "y"}, {"episode_id": "b", "role": "tool", "content": "2"}]
    e = traces.jsonl_traces(files(spark, "\n".join(map(json.dumps, lines))))
    assert e.select("episode_id").distinct().count() == 2
    assert [r.kind for r in e.orderBy("episode_id", "pos").collect()] == ["action", "observation"] * 2
    assert segment.segment_transitions(e).where("alignment = 'sequential'").count() == 2


def test_json_layouts(spark):
    pair = json.dumps({"action": "go", "observation": "there"})
    several = json.dumps({"episodes": [{"events": [{"kind": "action", "content": "a"}]}, {"messages": [{"role": "user", "content": "b"}]}]})
    listed = json.dumps([{"trajectory": [{"kind": "action", "content": "a"}, {"kind": "error", "content": "no"}]}])
    e = traces.json_traces(files(spark, pair, several, listed))
    got = {r.source_id: (r.e, r.n) for r in e.groupBy("source_id").agg(F.count_distinct("episode_id").alias("e"), F.count("*").alias("n")).collect()}
    assert got == {"src_0": (1, 2), "src_1": (2, 2), "src_2": (1, 2)}


def messages(spark, *ms):
    return traces.json_traces(files(spark, json.dumps({"messages": list(ms)})))


def call(*ids):
    return {"role": "assistant", "content": "", "tool_calls": [{"id": i, "type": "function", "function": {"name": "f", "arguments": "{}"}} for i in ids]}


def reply(i, text):
    return {"role": "tool", "tool_call_id": i, "content": text}


def test_replies_out_of_order(spark):
    e = messages(spark, call("a", "b"), reply("b", "B"), reply("a", "A"))
    t = segment.segment_transitions(e)
    x = segment.transition_text(e, t).join(t, "transition_id").orderBy("pos").collect()
    assert [r.observation_text for r in x] == ["A", "B"]
    assert all(r.concurrent_ids for r in x) and x[0].delayed_ids and x[0].alignment == "correlated"


def test_foreign_reply_and_duplicate_ids(spark):
    t = segment.segment_transitions(messages(spark, call("a"), reply("z", "Z"))).collect()
    assert [(r.alignment, r.observation_ids) for r in t] == [("ambiguous", [])]
    t = segment.segment_transitions(messages(spark, call("a"), call("a"), reply("a", "A"))).collect()
    assert all(r.alignment == "ambiguous" and segment.DUPLICATE in r.ambiguities for r in t)


def test_overlapping_calls(spark):
    t = segment.segment_transitions(messages(spark, call("a"), call("b"), reply("a", "A"), reply("b", "B"))).collect()
    assert all(len(r.concurrent_ids) == 1 and segment.OVERLAP in r.ambiguities for r in t)


def test_spans(spark):
    e = spark.createDataFrame([("e1", "ep", 0, "user", "message", "say: go! seen: ok")], "event_id string, episode_id string, pos int, actor string, kind string, content string")
    spans = spark.createDataFrame([("e1", 5, 8, "agent", "action"), ("e1", 15, 17, "environment", "observation"), ("x", 0, 1, "agent", "action")], "event_id string, start int, end int, actor string, kind string")
    out, errors = segment.apply_span_annotations(e, spans)
    assert [(r.kind, r.content) for r in out.orderBy("pos").collect()] == [("message", "say: "), ("action", "go!"), ("message", " seen: "), ("observation", "ok")]
    assert [(r.event_id, r.error) for r in errors.collect()] == [("x", "unknown event")]


def test_atif(spark, tmp_path):
    step = lambda i, source, **k: {"step_id": i, "source": source, "message": "m", **k}
    keys = lambda k: [{"tool_call_id": "c", "function_name": "bash_command", "arguments": {"keystrokes": k, "duration": 0.1}}]
    seen = lambda t: {"results": [{"content": t}]}
    first = {"continued_trajectory_ref": "b.json", "steps": [step(1, "user"), step(2, "agent", tool_calls=keys("ls\n"), observation=seen("New Terminal Output:\na\n"), metrics={"prompt_tokens": 5, "completion_tokens": 1})]}
    second = {"steps": [step(1, "agent", is_copied_context=True, tool_calls=keys("ls\n"), metrics={"prompt_tokens": 5, "completion_tokens": 1}), step(2, "agent"), step(3, "agent", tool_calls=keys("pwd\n"), observation=seen("/"), metrics={"prompt_tokens": 7, "completion_tokens": 2}), step(4, "agent", tool_calls=[{"tool_call_id": "d", "function_name": "mark_task_complete"}])]}
    (tmp_path / "a.json").write_text(json.dumps(first))
    (tmp_path / "b.json").write_text(json.dumps(second))
    x = trajectories.read_atif(spark, str(tmp_path))
    t = trajectories.atif_to_turns(x).orderBy("turn").collect()
    assert [(json.loads(r.keystrokes)[0]["keystrokes"] if not r.completion_only else None, r.observation) for r in t] == [("ls\n", "a"), ("pwd\n", "/"), (None, "")]
    (u,) = trajectories.trajectory_usage(x).collect()
    assert (u.prompt_tokens, u.completion_tokens) == (12, 3)


def test_mcp_and_chat_logs(spark):
    item = lambda **k: {"type": None, "role": None, "call_id": None, "name": None, "arguments": None, "output": None, "content": None, "text": None} | k
    log = [item(type="message", role="assistant", text="hi"), item(type="function_call", call_id="1", name="f", arguments="{}"), item(type="function_call", call_id="2", name="g"), item(type="function_call_output", call_id="2", output="two"), item(type="function_call_output", call_id="1", output="one"), item(type="function_call", call_id="3", name="h")]
    df = spark.createDataFrame([("l", log)], "log_id string, messages array<struct<type:string,role:string,call_id:string,name:string,arguments:string,output:string,content:string,text:string>>")
    t = trajectories.mcp_turns(df).orderBy("turn").collect()
    assert [(r.name, r.output, r.batch_size, r.said) for r in t] == [("f", "one", 2, "hi"), ("g", "two", 2, "hi")]
    chat = [{"role": "assistant", "content": "x", "tool_call_id": None, "tool_calls": [{"id": "1", "type": "function", "function": {"name": "google_cloud_bigquery_list_datasets", "arguments": "{}"}}, {"id": "2", "type": "function", "function": {"name": "local-history", "arguments": "{}"}}]}, {"role": "tool", "content": "r", "tool_call_id": "1", "tool_calls": None}]
    df = spark.createDataFrame([("l", chat)], "log_id string, messages array<struct<role:string,content:string,tool_call_id:string,tool_calls:array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>>>")
    servers = spark.createDataFrame([("l", "google-cloud"), ("l", "google")], "log_id string, server string")
    (r,) = trajectories.chat_tool_turns(df, servers).collect()
    assert (r.tool, r.output) == ("google-cloud-bigquery_list_datasets", "r")


def test_fold_snapshots(spark):
    rows = [("l", 0, "browser_snapshot", "", "c0", "s0"), ("l", 1, "click", "{}", "c1", "o1"), ("l", 2, "browser_snapshot", "", "c2", "s1"), ("l", 3, "browser_snapshot", "", "c3", "s2"), ("l", 4, "type", "{}", "c4", "o4")]
    df = spark.createDataFrame(rows, "log_id string, pos int, name string, arguments string, call_id string, output string")
    t = trajectories.fold_snapshots(df).orderBy("turn").collect()
    assert [(r.name, r.observation, r.folded) for r in t] == [("click", "s2", ["c2", "c3"]), ("type", "o4", [])]


def test_rollouts(spark):
    s = lambda i, name, obs, raw=None, error=None, sigma="noop": {"step": i, "action": {"name": name, "arguments": "{}"}, "observation": obs, "observation_raw": raw, "error": error, "state_before": "{}", "state_after": "{}", "state_diff": "{}", "n_delta": 0, "obs_success": True, "sigma_t": sigma}
    steps = [s(0, "read", "{'a': 1}", '{"a": 2}'), s(1, "write", "{'a': 1}", '{"a": 1}', sigma="effect"), s(2, "write", "{'success': False}", sigma="rejected"), s(3, "x", "", error="Traceback\nKeyError: x"), s(4, "chat_with_user", "bye")]
    from tracequarry.schemas import ROLLOUT

    df = spark.createDataFrame([("e", "t", 1.0, None, 1, 1, True, False, "{}", "{}", steps)], ROLLOUT)
    t = trajectories.rollout_turns(df).orderBy("turn").collect()
    assert [(r.tool, r.stale, r.loader_error) for r in t] == [("read", True, None), ("write", False, None), ("write", False, None), ("x", False, "KeyError: x")]
    assert [r.outcome for r in trajectories.rollout_ground_truth(df).orderBy("turn").collect()] == ["success", "success", "failure", "success"]


def test_digests_and_shards(spark, tmp_path):
    (tmp_path / "a").write_text("x")
    found = trajectories.file_digests(spark, str(tmp_path))
    manifest = found.select("path", "folder", "sha256").union(spark.createDataFrame([("gone", "d", "0")], "path string, folder string, sha256 string"))
    assert {r.status: r.n for r in trajectories.verify_digests(found, manifest).collect()} == {"verified": 1, "missing": 1}
    out = trajectories.bench_rows_to_events(spark.createDataFrame([("i", "do", None, ["p1", "p2"], ["r1", "r2"])], "id string, instruction string, initial_state string, prompt array<string>, response array<string>"))
    assert [r.content for r in out.orderBy("pos").collect()] == ["do", "p1", "r1", "p2", "r2"]
