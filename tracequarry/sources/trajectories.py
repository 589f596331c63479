"""Readers for benchmark rows, terminal and browser trajectories, tool-call logs and simulator rollouts; exporters."""

from __future__ import annotations

from functools import reduce

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession, Window

from .. import schemas
from ..functions.lineage import cut
from ..functions.text import strip_screen_wrapper
from ..operators.ranks import ranked


def read_bench_rows(spark: SparkSession, paths: list[str], names: str = "*.jsonl") -> DataFrame:
    """JSONL files, or the files of folders that have such names."""
    return spark.read.schema(schemas.BENCH_ROWS).option("pathGlobFilter", names).json(paths)


def read_atif(spark: SparkSession, path: str) -> DataFrame:
    """One row per trajectory file: file name, folder and fields."""
    return spark.read.schema(schemas.ATIF).json(path, multiLine=True).withColumn("path", F.col("_metadata.file_path")).withColumn("file", F.col("_metadata.file_name")).withColumn("folder", F.regexp_replace(F.col("path"), r"/[^/]*$", ""))


def splice_continuations(files: DataFrame) -> DataFrame:
    """(path, root, part): each file's first file and its place in the chain. Pointers jump by doubling, so the longest
    chain of n files takes log n joins; files on a cycle, and those behind one, keep themselves as root."""
    nodes = files.select("path", F.concat("folder", F.lit("/"), F.element_at(F.split("continued_trajectory_ref", "/"), -1)).alias("next"))
    before = nodes.where("next IS NOT NULL").join(nodes.select(F.col("path").alias("next")), "next", "left_semi").groupBy(F.col("next").alias("path")).agg(F.min("path").alias("up"))
    hops = nodes.select("path").join(before, "path", "left").select("path", F.coalesce("up", "path").alias("root"), F.when(F.col("up").isNull(), 0).otherwise(1).alias("part"))
    if before.isEmpty():
        return hops
    first = cut(hops.where("part = 0").select(F.col("path").alias("root"), F.lit(True).alias("first")))
    hops, left = cut(hops), None
    while True:
        open_ = hops.join(first, "root", "left_anti").count()
        if not open_ or open_ == left:  # what is left after a whole round goes round in circles
            break
        left = open_
        up = hops.select(F.col("path").alias("root"), F.col("root").alias("r2"), F.col("part").alias("p2"))
        hops = cut(hops.join(up, "root").select("path", F.col("r2").alias("root"), (F.col("part") + F.col("p2")).alias("part")))
    x = hops.join(first, "root", "left")
    return x.select("path", F.when(F.col("first"), F.col("root")).otherwise(F.col("path")).alias("root"), F.when(F.col("first"), F.col("part")).otherwise(0).alias("part"))


def atif_steps(files: DataFrame) -> DataFrame:
    """(trajectory, part, pos, step): the steps of spliced trajectories without copied context."""
    chain = splice_continuations(files)
    x = files.join(chain, "path").select(F.col("root").alias("trajectory"), "part", F.posexplode("steps").alias("pos", "step"))
    return x.where(~F.coalesce(F.col("step.is_copied_context"), F.lit(False)))


def atif_to_turns(files: DataFrame) -> DataFrame:
    """(trajectory, turn, keystrokes JSON, observation, completion_only): agent steps with key batches, in order."""
    step = F.col("step")
    calls = F.filter(step["tool_calls"], lambda c: c["function_name"] == "bash_command")
    done = F.exists(F.coalesce(step["tool_calls"], F.array().cast("array<struct<tool_call_id:string,function_name:string,arguments:struct<keystrokes:string,duration:double>>>")), lambda c: c["function_name"] == "mark_task_complete")
    text = F.array_join(F.transform(step["observation"]["results"], lambda r: F.coalesce(r["content"], F.lit(""))), "\n")
    x = atif_steps(files).where(step["source"] == "agent").select("trajectory", "part", "pos", F.to_json(F.transform(calls, lambda c: c["arguments"])).alias("keystrokes"), F.size(calls).alias("n"), done.alias("done"), strip_screen_wrapper(F.coalesce(text, F.lit(""))).alias("observation"))
    x = x.where((F.col("n") > 0) | F.col("done"))
    return x.select("trajectory", F.row_number().over(Window.partitionBy("trajectory").orderBy("part", "pos")).alias("turn"), "keystrokes", "observation", (F.col("n") <= 0).alias("completion_only"))


#: The headers that part the first message of a terminal task.
INSTRUCTION_HEADER, SCREEN_HEADER = "Task Description:", "Current terminal state:"


def initial_context(files: DataFrame) -> DataFrame:
    """(trajectory, instruction, screen) of the first user step."""
    first = atif_steps(files).where(F.col("step.source") == "user").groupBy("trajectory").agg(F.min_by(F.col("step.message"), F.struct("part", "pos")).alias("m"))
    body = F.when(F.col("m").contains(INSTRUCTION_HEADER), F.element_at(F.split("m", INSTRUCTION_HEADER, 2), -1)).otherwise(F.col("m"))
    return first.select("trajectory", F.trim(F.substring_index(body, SCREEN_HEADER, 1), F.lit(" \n")).alias("instruction"), F.when(F.col("m").contains(SCREEN_HEADER), F.trim(F.element_at(F.split("m", SCREEN_HEADER), -1), F.lit(" \n"))).alias("screen"))


def trajectory_usage(files: DataFrame) -> DataFrame:
    """Steps, tokens and cost; copied context was paid for once and is left out."""
    m = F.col("step.metrics")
    return atif_steps(files).groupBy("trajectory").agg(F.count("*").alias("steps"), F.count_if(F.col("step.source") == "agent").alias("agent_steps"), *(F.sum(F.coalesce(m[c], F.lit(0))).alias(c) for c in ("prompt_tokens", "completion_tokens", "cached_tokens", "cost_usd")))


def attach_trial_outcome(trajectories: DataFrame, results: DataFrame) -> DataFrame:
    """trajectories (trajectory path), results (folder, reward, exception): joined by the trial's folder."""
    folder = F.regexp_replace("trajectory", r"/(?:agent/)?[^/]*$", "")
    return trajectories.withColumn("folder", folder).join(results, "folder", "left")


def mcp_turns(logs: DataFrame) -> DataFrame:
    """logs (log_id, messages array of items): calls with their outputs by call id; the assistant text before them; a
    batch number that grows whenever nothing is pending; the batch's size. Unanswered calls are dropped."""
    x = logs.select("log_id", F.posexplode("messages").alias("pos", "m"))
    w = Window.partitionBy("log_id").orderBy("pos")
    is_call, is_out = F.col("m.type") == "function_call", F.col("m.type") == "function_call_output"
    text = F.when((F.col("m.type") == "message") & (F.col("m.role") == "assistant"), F.coalesce("m.text", "m.content"))
    x = x.withColumn("said", F.last(text, ignorenulls=True).over(w)).withColumn("pending", F.coalesce(F.sum(F.when(is_call, 1).when(is_out, -1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    x = x.withColumn("batch", F.count(F.when(is_call & (F.col("pending") <= 0), 1)).over(w))
    calls = x.where(is_call).select("log_id", "pos", "said", "batch", F.col("m.call_id").alias("call_id"), F.col("m.name").alias("name"), F.col("m.arguments").alias("arguments"))
    outs = x.where(is_out).groupBy("log_id", F.col("m.call_id").alias("call_id")).agg(F.min_by("m.output", "pos").alias("output"))
    y = calls.join(outs, ["log_id", "call_id"])
    return y.withColumn("turn", F.row_number().over(Window.partitionBy("log_id").orderBy("pos"))).withColumn("batch_size", F.count("*").over(Window.partitionBy("log_id", "batch")))


#: Tools that only manage the agent's own context.
CONTEXT_TOOLS = ("local-", "manage_context", "history_", "claim_done")


def chat_tool_turns(logs: DataFrame, servers: DataFrame) -> DataFrame:
    """logs (log_id, messages array of chat messages), servers (log_id, server): assistant tool calls with their replies;
    <server>_<tool> becomes <server>-<tool> by the longest server whose name, with - as _, begins it."""
    x = logs.select("log_id", F.posexplode("messages").alias("pos", "m"))
    calls = x.where(F.col("m.role") == "assistant").select("log_id", "pos", F.col("m.content").alias("said"), F.posexplode("m.tool_calls").alias("i", "c"))
    managed = F.lit(False)
    for p in CONTEXT_TOOLS:
        managed |= F.col("name").startswith(p)
    calls = calls.select("log_id", "pos", "i", "said", F.col("c.id").alias("call_id"), F.col("c.function.name").alias("name"), F.col("c.function.arguments").alias("arguments")).where(~managed)
    replies = x.where(F.col("m.role") == "tool").groupBy("log_id", F.col("m.tool_call_id").alias("call_id")).agg(F.min_by("m.content", "pos").alias("output"))
    y = calls.join(replies, ["log_id", "call_id"])
    named = servers.groupBy("log_id").agg(F.collect_set("server").alias("servers"))
    y = y.join(named, "log_id", "left")
    flat = lambda s: F.concat(F.replace(s, F.lit("-"), F.lit("_")), F.lit("_"))
    fit = F.filter("servers", lambda s: F.replace(F.col("name"), F.lit("-"), F.lit("_")).startswith(flat(s)))
    best = F.array_max(F.transform(fit, lambda s: F.struct(F.length(s).alias("n"), s.alias("s"))))["s"]
    name = F.when(best.isNotNull(), F.concat(best, F.lit("-"), F.substr("name", F.length(best) + 2))).otherwise(F.col("name"))
    return y.withColumn("tool", name).withColumn("turn", F.row_number().over(Window.partitionBy("log_id").orderBy("pos", "i"))).drop("servers", "i")


def tool_definition_table(logs: DataFrame) -> DataFrame:
    """logs (task, tools JSON list of functions) -> distinct (task, tool, definition)."""
    each = logs.select("task", F.explode(F.from_json("tools", "array<string>")).alias("t"))
    f = F.coalesce(F.get_json_object("t", "$.function"), F.col("t"))
    return each.select("task", F.get_json_object(f, "$.name").alias("tool"), f.alias("definition")).distinct()


def fold_snapshots(turns: DataFrame, snapshot: str = "browser_snapshot") -> DataFrame:
    """turns (log_id, pos, name, arguments, call_id, output): a snapshot's output replaces the observation of the action
    before it (the last one wins); leading snapshots are dropped; turns are numbered anew."""
    w = Window.partitionBy("log_id").orderBy("pos")
    shot = F.col("name") == snapshot
    x = turns.withColumn("island", F.count(F.when(~shot, 1)).over(w)).where("island > 0")
    g = x.groupBy("log_id", "island").agg(F.min_by(F.struct("name", "arguments", "call_id", "output"), "pos").alias("a"), F.max_by(F.when(shot, F.col("output")), F.when(shot, F.col("pos"))).alias("shot"), F.sort_array(F.collect_list(F.when(shot, F.struct("pos", "call_id")))).alias("f"))
    return g.select("log_id", F.col("island").alias("turn"), F.col("a.name").alias("name"), F.col("a.arguments").alias("arguments"), F.col("a.call_id").alias("call_id"), F.coalesce("shot", "a.output").alias("observation"), F.transform("f", lambda y: y["call_id"]).alias("folded"))


def resolve_urls(tasks: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """tasks (task, start_url): placeholders replaced in each of the urls that ` |AND| ` or ` |OR| ` part."""
    urls = F.split("start_url", r"\s*\|(?:AND|OR)\|\s*")
    return tasks.withColumn("urls", F.transform(urls, lambda u: reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), mapping.items(), u)))


def select_tasks(tasks: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The wanted tasks, and wanted ids that don't exist."""
    return tasks.join(wanted, "task", "left_semi"), wanted.join(tasks, "task", "left_anti")


#: The agent's own tools in simulator rollouts.
AGENT_TOOLS = ("chat_with_user", "finish", "complete_task")


def rollout_turns(rollouts: DataFrame) -> DataFrame:
    """Environment calls in order, with the verbatim observation, the last line of a loader error, and `stale` where the
    parsed copy differs from the observation as a value."""
    from ..functions.parsers import parse_observation

    x = rollouts.select("env_id", "task_id", F.posexplode("trajectory").alias("pos", "s")).where(~F.col("s.action.name").isin(*AGENT_TOOLS))
    error = F.col("s.error")
    x = x.select("env_id", "task_id", F.row_number().over(Window.partitionBy("env_id", "task_id").orderBy("pos")).alias("turn"), F.col("s.action.name").alias("tool"), F.col("s.action.arguments").alias("arguments"), F.col("s.observation").alias("observation"), F.col("s.observation_raw").alias("raw"), F.when(F.length(F.trim(error)) > 0, F.element_at(F.split(F.rtrim(error, F.lit(" \r\n")), "\n"), -1)).alias("loader_error"), F.col("s.step").alias("step"))
    parsed, copy = parse_observation(F.coalesce("observation", F.lit(""))), parse_observation(F.coalesce("raw", F.lit("")))
    return x.withColumn("_a", parsed).withColumn("_b", copy).withColumn("stale", F.col("_b.parsed") & F.coalesce(F.col("_a.value") != F.col("_b.value"), ~F.col("_a.parsed"))).drop("_a", "_b", "raw")


#: Outcome labels of simulator steps.
OUTCOMES = {"effect": "success", "noop": "success", "rejected": "failure"}


def rollout_ground_truth(rollouts: DataFrame) -> DataFrame:
    """The evaluation-only table of the same turns: outcome, states, difference."""
    x = rollouts.select("env_id", "task_id", "init_state", "final_state", F.posexplode("trajectory").alias("pos", "s")).where(~F.col("s.action.name").isin(*AGENT_TOOLS))
    table = F.create_map(*(F.lit(v) for kv in OUTCOMES.items() for v in kv))
    return x.select("env_id", "task_id", F.row_number().over(Window.partitionBy("env_id", "task_id").orderBy("pos")).alias("turn"), F.coalesce(table[F.col("s.sigma_t")], F.lit("unknown")).alias("outcome"), F.col("s.state_before").alias("state_before"), F.col("s.state_after").alias("state_after"), F.col("s.state_diff").alias("state_diff"), F.col("s.error").alias("error"))


def environment_definitions(metadata: DataFrame, scenarios: DataFrame) -> DataFrame:
    """metadata (env_id, summary, tools JSON), scenarios (env_id, task_id, task): one row per environment with its tool
    definitions and task texts (empty where absent)."""
    t = metadata.select("env_id", F.explode_outer(F.from_json("tools", "array<string>")).alias("t")).groupBy("env_id").agg(F.array_sort(F.collect_list("t")).alias("tools"))
    s = scenarios.groupBy("env_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("task_id", "task")))).alias("tasks"))
    return metadata.select("env_id", "summary").join(t, "env_id", "left").join(s, "env_id", "left").select("env_id", "summary", F.coalesce("tools", F.array().cast("array<string>")).alias("tools"), F.coalesce("tasks", F.create_map().cast("map<string,string>")).alias("tasks"))


RECORDS_PER_FILE = 1_000_000  # so that a file can be read as one value to digest it


def export_episodes(turns: DataFrame, splits: DataFrame, path: str) -> DataFrame:
    """Write turns by split with a manifest (write_manifest); returns the summary (split, episodes, turns) of what the
    files hold. A task that two episodes claim is an error."""
    twice = splits.groupBy("episode_id").count().where("count > 1")
    if not twice.isEmpty():
        raise ValueError("an episode is in the split table more than once")
    turns.join(splits, "episode_id").repartition("split", "episode_id").write.option("maxRecordsPerFile", RECORDS_PER_FILE).partitionBy("split").parquet(f"{path}/episodes")
    write_manifest(turns.sparkSession, path)
    return turns.sparkSession.read.parquet(f"{path}/episodes").groupBy("split").agg(F.count_distinct("episode_id").alias("episodes"), F.count("*").alias("turns"))


def trial_summary(turns: DataFrame, usage: DataFrame) -> DataFrame:
    return turns.groupBy("trajectory").agg(F.count("*").alias("turns"), F.sum(F.length("observation")).alias("chars")).join(usage, "trajectory", "left")


def write_catalog(rules: DataFrame, tables: dict[str, DataFrame], path: str) -> None:
    """Rules as JSON by action type, typed artefact tables as Parquet, and the manifest of both."""
    rules.write.option("maxRecordsPerFile", RECORDS_PER_FILE).partitionBy("action_type").json(f"{path}/rules")
    for name, df in tables.items():
        df.write.option("maxRecordsPerFile", RECORDS_PER_FILE).parquet(f"{path}/{name}")
    write_manifest(rules.sparkSession, path)


MANIFEST = "_manifest"  # Spark's readers pass names with an underscore over


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, folder, length, sha256) of all files below a folder, each read once by the task that digests it."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return x.select("path", F.regexp_replace("path", r"/[^/]*$", "").alias("folder"), "length", F.sha2("content", 256).alias("sha256"))


def write_manifest(spark: SparkSession, path: str) -> None:
    """The digests of a folder's files, beside them."""
    file_digests(spark, path).write.parquet(f"{path}/{MANIFEST}")


def verify_digests(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """manifest (path, folder, sha256): per folder, files that are verified, mismatched, missing, or unlisted (found, but
    in no manifest)."""
    x = manifest.select("path", "folder", F.col("sha256").alias("want")).join(found.select("path", F.col("folder").alias("seen_in"), "sha256"), "path", "full")
    status = F.when(F.col("want").isNull(), "unlisted").when(F.col("sha256").isNull(), "missing").when(F.col("sha256") != F.col("want"), "mismatched").otherwise("verified")
    return x.groupBy(F.coalesce("folder", "seen_in").alias("folder"), status.alias("status")).agg(F.count("*").alias("n"))


def verify_export(spark: SparkSession, path: str) -> DataFrame:
    """verify_digests of a written folder against the manifest beside its files."""
    return verify_digests(file_digests(spark, path), spark.read.parquet(f"{path}/{MANIFEST}"))


def shard_by_trajectory(rows: DataFrame, key: str, n: int, exact: bool = False) -> DataFrame:
    """Rows of a key in one shard: by hash, or (exact) dealt in order of the distinct keys, which are sorted by ranges."""
    if not exact:
        return rows.withColumn("shard", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(n)).cast("int"))
    place = ranked(rows.select(key).distinct(), [key]).select(key, (F.col("rank") % n).cast("int").alias("shard"))
    return rows.join(place, key)


def bench_rows_to_events(rows: DataFrame) -> DataFrame:
    """rows (id, instruction, initial_state, prompt, response): instruction, state, then action and observation of each
    turn as events."""
    turns = rows.select("id", F.posexplode(F.arrays_zip("prompt", "response")).alias("i", "t"))
    pair = turns.select("id", (F.col("i") * 2 + 2).alias("pos"), F.expr("stack(2, 0, 'agent', 'action', t.prompt, 1, 'environment', 'observation', t.response) AS (k, actor, kind, content)")).withColumn("pos", F.col("pos") + F.col("k")).drop("k").where("content IS NOT NULL")
    head = rows.select("id", F.expr("stack(2, 0, 'user', 'message', instruction, 1, 'environment', 'state', initial_state) AS (pos, actor, kind, content)")).where("content IS NOT NULL")
    return head.unionByName(pair)


def observed_turns(rows: DataFrame) -> DataFrame:
    """(id, turn, prompt, response) of the turns before the evaluated one."""
    n = F.greatest(F.col("turn_idx") - 1, F.lit(0))
    x = rows.select("id", F.posexplode(F.arrays_zip(F.slice("prompt", F.lit(1), n).alias("prompt"), F.slice("response", F.lit(1), n).alias("response"))).alias("i", "t"))
    return x.select("id", (F.col("i") + 1).alias("turn"), "t.prompt", "t.response")
