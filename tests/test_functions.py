import json

import pyspark.sql.functions as F

from tracequarry.functions import actions, parsers, text
from tracequarry.operators import identity, replay, scoring


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("x")).first().x


PROMPT = "### Turn 3\n**Current State:**\nidle\n**Action:**\n```json\n[{\"keystrokes\": \"ls\\n\"}]\n```\n"


def test_prompt_parts(spark):
    s = one(spark, PROMPT, text.prompt_sections)
    assert (s.turn, s.current_state, s.task_instruction) == (3, "idle", None)
    b = one(spark, PROMPT, text.action_block)
    assert (b.language, json.loads(b.body)) == ("json", [{"keystrokes": "ls\n"}])
    assert one(spark, PROMPT, text.action_kind) == "single"


def test_small_columns(spark):
    assert one(spark, "x" * 10, lambda c: text.clip_text(c, 4)) == "xx\n...[6 characters omitted]...\nxx"
    assert one(spark, "HTTP://Shop.Example.com/Cart/?proxy=a&b=1#top", text.normalize_page) == "http://shop.example.com/Cart/?b=1"
    assert [one(spark, v, text.response_kind) for v in ('{"success": false}', '{"data": []}', '{"message": "x"}', "[1]")] == ["error", "data", "message", "other"]
    assert [json.loads(one(spark, v, text.mcp_arguments)) for v in ("", '{"a": 1}', "3", "no json")] == [{}, {"a": 1}, {"value": 3}, {"raw": "no json"}]
    assert one(spark, "cat /srv/data/report.csv and v1.2.3", text.specific_tokens) == ["/srv/data/report.csv", "report.csv"]
    assert one(spark, "a@h:/srv# ls\nout\na@h:/tmp# ", text.transcript_cwd) == "/tmp"
    assert one(spark, "a@h:/srv# ", text.wait_state).state == "idle_prompt"
    assert one(spark, "FINAL ANSWER: 42", text.final_answer).text == "42"
    assert one(spark, "Does x.\nReturns: a thing\n  more\n\nNotes: y", text.clean_tool_description) == "Does x.\n\nNotes: y"
    sig = one(spark, "state_id: s1 com.shop:id/a com.shop:id/b com.shop:id/c android:id/x", text.screen_signature)
    assert (sig.state, sig.app, sig["items"]) == ("s1", "com.shop", ["com.shop:id/a", "com.shop:id/b", "com.shop:id/c"])


def test_calls():
    call = actions.call
    assert call("shop", '{"name": "buy", "arguments": {"n": 1}}') == call("shop", '[{"name": "buy", "arguments": "{\\"n\\": 1}"}]') == ("buy", {"n": 1})
    assert call("shop", '{"name": "buy", "arguments": "all"}') == ("buy", {"raw": "all"}) and call("shop", '{"name": "buy", "arguments": 3}') == ("buy", {"value": 3})
    assert call("android", '{"action_type": "click", "x": 3}') == ("click", {"x": 3}) and call("android", '{"action": "wait"}') == ("wait", {})
    assert call("shop", 'so <invoke name="buy"><parameter name="n"> 2 </parameter><parameter name="s">null</parameter><parameter name="t">a b</parameter></invoke>') == ("buy", {"n": 2, "s": None, "t": "a b"})
    assert call("shop", '<invoke  name="page"><parameter name="action">open</parameter></invoke>') == ("page.open", {})
    assert call("shop", "shop.buy(3, [1, x], kind='x')") == ("shop.buy", {"kind": "x", "args": [3, "[1, x]"]})
    assert call("swe", "a = 1\nrun(a)\nos.remove('f')") == ("code", {"language": "python", "source": "a = 1\nrun(a)\nos.remove('f')", "calls": ["run", "os.remove"]})
    assert call("web", "nothing of this kind") == ("web.action", {"text": "nothing of this kind"}) and call("web", "") == ("web.action", {})
    assert call("web", "[1, 2]") == ("web.action", {"text": "[1, 2]"}) and call("terminal", "[]") == ("wait", {"duration": 0.0, "keystrokes": []})


def test_screen_commands():
    call = lambda body: actions.call("android", body)
    assert call("touch <button id=3 bound_box=0,1,2,3 name='a b'>Sign in</button>") == ("touch", {"element": "button", "id": "3", "bound_box": "0,1,2,3", "name": "a b", "text": "Sign in"})
    assert call("set_text <input id=7>old</input> new text") == ("set_text", {"element": "input", "id": "7", "text": "old", "input": "new text"})
    assert call("scroll up <scrollbar id=1></scrollbar>") == ("scroll", {"direction": "up", "element": "scrollbar", "id": "1"})
    assert call("long_touch <p id=2></p> now") == ("long_touch", {"element": "p", "id": "2", "trailing": "now"})
    assert call("intent am start com.shop/.Main") == ("intent", {"command": "am start com.shop/.Main"})
    assert call("kill_app com.shop") == ("kill_app", {"text": "com.shop"}) and call("unselect") == ("unselect", {})
    assert call("touching x")[0] == "android.action"


def test_key_batches():
    keys = lambda *k, **more: actions.key_batch([{"keystrokes": x} | more for x in k])
    assert keys("A=1 /bin/grep -n 'x y' f\n") == ("grep", {"program": "grep", "command": "A=1 /bin/grep -n 'x y' f", "argv": ["-n", "x y", "f"], "keystrokes": [{"keystrokes": "A=1 /bin/grep -n 'x y' f\n"}]})
    assert keys("A=1\n")[0] == "A=1" and keys("it's\n")[1]["argv"] == []
    name, given = keys("C-c", "ls\n")
    assert (name, given["commands"], given["programs"]) == ("shell", ["C-c", "ls"], ["ls"])
    assert keys("C-c")[:1] == ("keys",) and keys("C-c\n")[0] == keys("a | b\n")[0] == keys("cd x; ls\n")[0] == keys("a\nb\n")[0] == "shell"
    assert keys(" \n", "", duration=1.5)[1]["duration"] == 3.0 and keys("q")[1]["keys"] == "q"
    assert actions.programs(["cat > f << 'EOF'", "ls", "EOF", "# no", "", "Tab", "X=1 python3 f", "echo 'open"]) == ["cat", "python3", "echo"]


def test_outputs():
    tag = parsers.RESPONSE_TAG
    assert parsers.model_output(f"<think>a</think>b<{tag}>x</{tag}>c<{tag}>y") == "y"
    assert parsers.model_output("late</think> answer") == "answer"
    assert parsers.model_output(f"<think>never closed <{tag}>z</{tag}>") == "z"
    assert parsers.model_output("") == "No output"
    good = parsers.judgement('text ```json\n{"scores": {"format": 5, "factuality": "4/5", "consistency": 9, "realism": 0,},}\n```')
    assert good["success"] and [good[d] for d in parsers.DIMENSIONS] == [5, 4, 5, 0, 0] and abs(good["total"] - 14 / 3) < 1e-9
    assert not parsers.judgement("nothing")["success"]
    assert parsers.judgement('{"x": oops!, "scores": {"format": 3}}')["format"] == 3
    assert parsers.observed("{'a': None}") == {"a": None} and parsers.observed("free text") is parsers.UNPARSED
    assert parsers.scaffold(["cd sub", "ls"], "a", "h", "/srv", "#") == ["a@h:/srv# cd sub", "a@h:/srv/sub# ls"]
    assert parsers.masked("root@box: see 10.0.0.1 and /x/y 12345", set(), set()) == ("<host>: see <ip> and <path> <n>", 4)


ID, OTHER = "01234567-89ab-cdef-0123-456789abcdef", "fedcba98-7654-3210-fedc-ba9876543210"


def test_exact_scores():
    e = lambda t, g, context="", kinds=None: scoring.exact(json.dumps(t) if not isinstance(t, str) else t, json.dumps(g) if not isinstance(g, str) else g, context, kinds)
    assert e({"a": 1, "b": 2}, {"b": 2, "a": 1})["match_strict"]
    assert not e({"a": 1}, {"a": True})["match"]
    x = e({"l": [1, 2]}, {"l": [2, 1]})
    assert x["match"] and not x["match_strict"]
    assert not e({"l": [{"a": 1}, {"a": 2}]}, {"l": [{"a": 2}, {"a": 1}]})["match"]
    assert e({"id": ID, "again": ID}, {"id": OTHER, "again": OTHER})["match_strict"]
    assert not e({"id": ID, "again": ID}, {"id": OTHER, "again": ID})["match"]
    assert not e({"id": ID}, {"id": OTHER}, context=OTHER)["match"]
    assert not e({"id": ID}, {"id": OTHER}, context=ID)["match"]
    assert not e({"id": ID}, {"id": OTHER}, kinds={"date"})["match"]
    assert e({"by": {ID: {"n": 1}}}, {"by": {OTHER: {"n": 1}}})["match"]
    assert e({"at": "2026-01-02T03:04:05"}, {"at": "2027-01-02T03:04:06"})["match"]
    assert e({"m": "pick [b, a]"}, {"m": "pick [a, b]"})["match"] and not e({"m": "pick [b, a]"}, {"m": "pick [a, b]"})["match_strict"]
    x = e({"success": False, "error": "x"}, {"success": False, "error": "y"})
    assert x["outcome_match"] and not x["match"] and x["kind"] == "error"
    assert e("plain  text", "plain text")["text_match"] and not e({"a": 1}, "")["predicted"]


def test_state_paths_and_mutations():
    s = {"world": {"files": {"/app/x.txt": {"content": "a"}}}}
    assert replay.read_path(s, 'world.files["/app/x.txt"].content') == "a"
    replay.write_path(s, "world.files./app/x.txt.content", "b")
    replay.write_path(s, "world.files./app/y.txt", {"content": "c"})
    assert s["world"]["files"] == {"/app/x.txt": {"content": "b"}, "/app/y.txt": {"content": "c"}}
    replay.delete_path(s, "world.files./app/y.txt")
    assert list(s["world"]["files"]) == ["/app/x.txt"]
    s, pending = {"world": {}}, []
    replay.mutate(s, [{"op": "append", "path": "world.l", "value": 1}, {"op": "append", "path": "world.l", "value": 2}, {"op": "merge", "path": "world.o", "value": {"a": 1}}, {"op": "remove", "path": "world.o", "value": "a"}, {"op": "remove", "path": "world.none", "value": "a"}, {"op": "schedule", "path": "world.d", "value": 1, "delay_steps": 2}], {}, 1, pending)
    assert s == {"world": {"l": [1, 2], "o": {}}} and pending[0]["due_step"] == 3
    try:
        replay.mutate(s, [{"op": "increment", "path": "world.n", "value": 1}], {}, 1, [])
        raise AssertionError
    except ValueError:
        pass


def test_prefix_clusters(spark):
    rows = [("t", "i", 0, ["p"], []), ("t", "i", 1, ["p", "q"], ["r"]), ("t", "i", 2, ["other"], []), ("t", "i", 3, ["p", "q", "s"], ["r", "u"])]
    x = identity.cluster_prefix_trajectories(spark.createDataFrame(rows, "task string, id string, order long, prompt array<string>, response array<string>"))
    assert [r.cluster_id for r in x.orderBy("order").collect()] == ["i", "i", "i~2", "i"]


def test_pass_at_k(spark):
    a = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("b", 1, False), ("b", 2, False)], "task string, attempt int, success boolean")
    assert [(r.k, r.pass_rate, r.attempt_rate) for r in scoring.pass_at_k(a, 2).orderBy("k").collect()] == [(1, 0.0, 0.0), (2, 0.5, 0.25)]
    assert [r.task for r in scoring.short_tasks(a, 3).orderBy("task").collect()] == ["a", "b"]
