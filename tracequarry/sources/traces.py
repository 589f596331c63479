"""Raw trace files to typed events: JSON, JSONL and role-prefixed text.

One file is one source (sha256 of its bytes). Order inside a file is position, never a timestamp.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession, Window

#: Role names and the actors that they stand for.
ROLES = {"human": "user", "user": "user", "assistant": "agent", "agent": "agent", "environment": "environment", "observation": "environment", "tool": "tool", "system": "system"}
#: Event kinds and their aliases.
KINDS = ("action", "observation", "message", "error", "state")
ACTION_KINDS = ("tool_call", "function_call", "command", "input", "request")
OBSERVATION_KINDS = ("tool_result", "function_result", "output", "response", "result")
#: Labels that begin an event in plain text, keys that hold a file's items.
LABELS = ("user", "human", "assistant", "agent", "action", "observation", "environment", "tool", "system", "error")
ITEM_KEYS = ("events", "messages", "trajectory", "trace")
PAIR_KEYS = ("observation", "tool_result", "environment_response")


def get(json: Column | str, key: str) -> Column:
    return F.get_json_object(json, f"$.{key}")


def stable_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.to_json(F.struct(*(p.alias(f"p{i}") for i, p in enumerate(parts)))), 256), 1, 16))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, source_id, text) of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", F.concat(F.lit("src_"), F.sha2("content", 256)).alias("source_id"), F.decode("content", "UTF-8").alias("text"))


def actor_of(role: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv))
    return F.coalesce(table[F.lower(role)], F.lit("unknown"))


def parse_timestamp(value: Column) -> tuple[Column, Column]:
    """(timestamp, raw value where it can't be parsed). No event is rejected for its time."""
    ts = F.try_to_timestamp(value)
    return ts, F.when(ts.isNull(), value)


def classify_events(items: DataFrame) -> DataFrame:
    """items: (source_id, episode_id, pos, item JSON text) -> actor, kind, content, ids and time of each item."""
    item = F.col("item")
    role = F.coalesce(get(item, "role"), get(item, "actor"), get(item, "source"), F.lit("unknown"))
    explicit = F.lower(F.coalesce(get(item, "kind"), get(item, "type"), F.lit("")))
    content = F.coalesce(get(item, "content"), get(item, "text"), get(item, "value"), item)
    calls = get(item, "tool_calls")
    has_calls = calls.isNotNull() & ~calls.isin("[]", "", "null")
    named = items.withColumn("actor", actor_of(role)).withColumn("explicit", explicit).withColumn("body", content)
    is_object = F.col("body").startswith("{")
    keys = [get(F.col("body"), k).isNotNull() for k in ("action", "tool", "command", "arguments")]
    looks_like_call = is_object & (keys[0] | keys[1] | keys[2] | keys[3]) | ~is_object & F.col("body").rlike(r"(?i)^\s*(action|tool|command)\s*:")
    by_item = has_calls | get(item, "action").isNotNull()
    kind = (
        F.when(F.col("explicit").isin(*KINDS), F.col("explicit"))
        .when(F.col("explicit").isin(*ACTION_KINDS), "action")
        .when(F.col("explicit").isin(*OBSERVATION_KINDS), "observation")
        .when(F.col("actor").isin("tool", "environment"), "observation")
        .when(by_item, "action")
        .when((F.col("actor") == "agent") & looks_like_call, "action")
        .otherwise("message")
    )
    untyped = ~F.col("explicit").isin(*KINDS, *ACTION_KINDS, *OBSERVATION_KINDS) & ~F.col("actor").isin("tool", "environment")
    ts, raw_ts = parse_timestamp(get(item, "timestamp"))
    return named.select(
        stable_id("evt", F.col("episode_id"), F.col("pos"), item).alias("event_id"),
        "episode_id",
        "source_id",
        F.col("pos").cast("int").alias("pos"),
        "actor",
        kind.alias("kind"),
        F.when(untyped & by_item, F.coalesce(get(item, "action"), item)).otherwise(F.col("body")).alias("content"),
        F.col("body").rlike(r"^\s*[\[{]").alias("content_is_json"),
        ts.alias("ts"),
        raw_ts.alias("raw_timestamp"),
        get(item, "call_id").alias("call_id"),
        get(item, "tool_call_id").alias("tool_call_id"),
        F.lit(None).cast("string").alias("parent_event_id"),
        F.lit(1).alias("batch_size"),
        get(item, "name").alias("name"),
        F.when(has_calls, calls).alias("tool_calls"),
    )


def explode_tool_calls(events: DataFrame) -> DataFrame:
    """An event with N tool calls becomes N action events with call id, parent event and batch size; positions stay
    ordered because a call's position is (pos, index), renumbered."""
    calls = F.from_json("tool_calls", "array<string>")
    rows = events.withColumn("call", F.explode_outer(F.when(F.col("tool_calls").isNotNull(), F.arrays_zip(calls.alias("c"), F.sequence(F.lit(0), F.size(calls) - 1).alias("i")))))
    is_call = F.col("call").isNotNull()
    out = rows.select(
        F.when(is_call, F.concat("event_id", F.lit("_call_"), F.col("call.i").cast("string"))).otherwise(F.col("event_id")).alias("event_id"),
        "episode_id",
        "source_id",
        "pos",
        F.coalesce(F.col("call.i"), F.lit(0)).alias("sub"),
        F.when(is_call, F.lit("agent")).otherwise(F.col("actor")).alias("actor"),
        F.when(is_call, F.lit("action")).otherwise(F.col("kind")).alias("kind"),
        F.when(is_call, F.col("call.c")).otherwise(F.col("content")).alias("content"),
        (F.col("content_is_json") | is_call).alias("content_is_json"),
        "ts",
        "raw_timestamp",
        F.when(is_call, get(F.col("call.c"), "id")).otherwise(F.col("call_id")).alias("call_id"),
        "tool_call_id",
        F.when(is_call, F.col("event_id")).alias("parent_event_id"),
        F.when(is_call, F.size(calls)).otherwise(F.col("batch_size")).alias("batch_size"),
        "name",
    )
    order = Window.partitionBy("episode_id").orderBy("pos", "sub")
    return out.withColumn("pos", F.row_number().over(order) - 1).drop("sub")


def _items(episode: Column) -> Column:
    """JSON array of an episode object's items."""
    pair = None
    for key in PAIR_KEYS:
        both = F.when(get(episode, "action").isNotNull() & get(episode, key).isNotNull(), F.to_json(F.array(
            F.struct(F.lit("agent").alias("actor"), F.lit("action").alias("kind"), get(episode, "action").alias("content")),
            F.struct(F.lit("environment").alias("actor"), F.lit("observation").alias("kind"), get(episode, key).alias("content")),
        )))
        pair = both if pair is None else F.coalesce(pair, both)
    return F.when(episode.startswith("["), episode).otherwise(F.coalesce(*(get(episode, k) for k in ITEM_KEYS), pair, F.concat(F.lit("["), episode, F.lit("]"))))


def _to_events(episodes: DataFrame) -> DataFrame:
    """episodes: (source_id, ordinal, episode JSON text)."""
    keyed = episodes.withColumn("episode_id", stable_id("ep", F.col("source_id"), F.col("ordinal"), F.coalesce(get("episode", "id"), F.lit(""))))
    items = keyed.select("source_id", "episode_id", F.posexplode(F.from_json(_items(F.trim("episode")), "array<string>")).alias("pos", "item"))
    return explode_tool_calls(classify_events(items))


def read_json_traces(spark: SparkSession, path: str) -> DataFrame:
    """.json files: {"episodes": [...]}, a list of episode objects, or one object."""
    return json_traces(read_files(spark, path))


def json_traces(files: DataFrame) -> DataFrame:
    text = F.trim(F.col("text"))
    several = F.coalesce(get(text, "episodes"), F.when(text.startswith("[") & (F.coalesce(*(F.get_json_object(text, f"$[0].{k}") for k in (*ITEM_KEYS, "action"))).isNotNull()), text), F.concat(F.lit("["), text, F.lit("]")))
    episodes = files.select("source_id", F.posexplode(F.from_json(several, "array<string>")).alias("ordinal", "episode"))
    return _to_events(episodes)


def read_jsonl_traces(spark: SparkSession, path: str) -> DataFrame:
    """.jsonl files: one episode per line, or events grouped by episode_id / trajectory_id."""
    return jsonl_traces(read_files(spark, path))


def jsonl_traces(files: DataFrame) -> DataFrame:
    lines = files.select("source_id", F.posexplode(F.split("text", r"\r?\n")).alias("line", "episode")).where(F.trim("episode") != "")
    has_items = F.coalesce(*(get("episode", k) for k in ITEM_KEYS)).isNotNull()
    layout = lines.groupBy("source_id").agg(F.bool_or(has_items).alias("per_line"))
    rows = lines.join(layout, "source_id")
    whole = _to_events(rows.where("per_line").select("source_id", F.col("line").alias("ordinal"), "episode"))
    group = F.coalesce(get("episode", "episode_id"), get("episode", "trajectory_id"), F.lit("episode-0"))
    events = rows.where(~F.col("per_line")).select("source_id", "line", F.col("episode").alias("item"), group.alias("g"))
    keyed = events.withColumn("episode_id", stable_id("ep", F.col("source_id"), F.col("g"))).withColumn("pos", F.row_number().over(Window.partitionBy("episode_id").orderBy("line")) - 1)
    return whole.unionByName(explode_tool_calls(classify_events(keyed.select("source_id", "episode_id", "pos", "item"))))


def read_text_traces(spark: SparkSession, path: str) -> DataFrame:
    return text_traces(read_files(spark, path))


def text_traces(files: DataFrame) -> DataFrame:
    """Lines `label: ...` begin an event and others continue it; a file without any event is one message."""
    pattern = r"(?i)^(" + "|".join(LABELS) + r")\s*:\s*(.*)$"
    lines = files.select("source_id", "text", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("line", "value"))
    labelled = lines.withColumn("label", F.nullif(F.lower(F.regexp_extract("value", pattern, 1)), F.lit("")))
    island = F.count("label").over(Window.partitionBy("source_id").orderBy("line"))
    parts = labelled.withColumn("island", island).withColumn("body", F.when(F.col("label").isNotNull(), F.regexp_extract("value", pattern, 2)).otherwise(F.col("value")))
    joined = parts.groupBy("source_id", "island").agg(
        F.max("label").alias("label"), F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "body"))), lambda x: x["body"]), "\n"), F.lit(" \t\r\n")).alias("content")
    ).where(F.col("content") != "")
    empty = files.join(joined.select("source_id").distinct(), "source_id", "left_anti").select("source_id", F.lit(0).alias("island"), F.lit(None).cast("string").alias("label"), F.col("text").alias("content"))
    rows = joined.unionByName(empty)
    label = F.coalesce("label", F.lit("unknown"))
    kind = F.when(label == "action", "action").when(label.isin("observation", "environment", "tool"), "observation").when(label == "error", "error").otherwise("message")
    order = Window.partitionBy("source_id").orderBy("island")
    none = F.lit(None).cast("string")
    return (
        rows.withColumn("pos", F.row_number().over(order) - 1)
        .withColumn("episode_id", stable_id("ep", F.col("source_id"), F.lit(0)))
        .select(
            stable_id("evt", F.col("episode_id"), F.col("pos"), label, F.col("content")).alias("event_id"), "episode_id", "source_id", "pos",
            F.when(label == "action", "agent").otherwise(actor_of(label)).alias("actor"), kind.alias("kind"), "content",
            F.col("content").rlike(r"^\s*[\[{]").alias("content_is_json"), F.lit(None).cast("timestamp").alias("ts"), none.alias("raw_timestamp"),
            none.alias("call_id"), none.alias("tool_call_id"), none.alias("parent_event_id"), F.lit(1).alias("batch_size"), none.alias("name"),
        )
    )
