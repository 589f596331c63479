"""Registry of queries and the driver tables as trace tables."""

from __future__ import annotations

from collections.abc import Callable

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession, Window

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as events: assistant turns act, user turns are what the environment answers."""
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("event_id"), F.col("conv_id").cast("string").alias("episode_id"), F.col("turn").cast("int").alias("pos"),
        F.when(F.col("role") == "assistant", "agent").when(F.col("role") == "user", "environment").otherwise("system").alias("actor"),
        F.when(F.col("role") == "assistant", "action").when(F.col("role") == "user", "observation").otherwise("message").alias("kind"),
        F.col("text").alias("content"), none.alias("call_id"), none.alias("tool_call_id"), none.alias("parent_event_id"), F.lit(1).alias("batch_size"),
    )


CONVERSATIONS = """ev AS (SELECT concat(conv_id, ':', turn) AS event_id, CAST(conv_id AS VARCHAR) AS episode_id, CAST(turn AS INTEGER) AS pos,
 CASE role WHEN 'assistant' THEN 'agent' WHEN 'user' THEN 'environment' ELSE 'system' END AS actor,
 CASE role WHEN 'assistant' THEN 'action' WHEN 'user' THEN 'observation' ELSE 'message' END AS kind, text AS content FROM conversations)"""


def call_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as calls and replies: a click calls, a view replies to the click with its k, an error is an
    observation without id, a purchase acts without id."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    t = F.col("event_type")
    return e.select(
        F.col("event_id").cast("string").alias("event_id"), F.col("user_id").cast("string").alias("episode_id"), (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("pos"),
        F.when(t.isin("click", "purchase"), "agent").when(t == "view", "tool").when(t == "error", "environment").otherwise("user").alias("actor"),
        F.when(t.isin("click", "purchase"), "action").when(t.isin("view"), "observation").when(t == "error", "error").otherwise("message").alias("kind"),
        F.format_string("%.2f", "value").alias("content"), F.when(t == "click", k).alias("call_id"), F.when(t == "view", k).alias("tool_call_id"),
        F.lit(None).cast("string").alias("parent_event_id"), F.lit(1).alias("batch_size"),
    )


CALLS = """ce AS (SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS episode_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
 CASE WHEN event_type IN ('click', 'purchase') THEN 'action' WHEN event_type = 'view' THEN 'observation' WHEN event_type = 'error' THEN 'error' ELSE 'message' END AS kind,
 CASE WHEN event_type = 'click' THEN props->>'$.k' END AS call_id, CASE WHEN event_type = 'view' THEN props->>'$.k' END AS tool_call_id FROM events)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as tool calls: episode, turn, tool, call, answer, k, value."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    return e.select(
        F.col("user_id").alias("episode"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("turn"), F.col("event_type").alias("tool"), F.concat_ws("|", "event_type", k).alias("call"),
        F.floor(F.col("value") / 20).cast("string").alias("answer"), k.cast("int").alias("k"), "value", "event_id", (F.col("user_id") % 5).alias("env"),
    )


TURNS = """tu AS (SELECT user_id AS episode, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn, event_type AS tool, concat(event_type, '|', props->>'$.k') AS call,
 CAST(CAST(floor(value / 20) AS BIGINT) AS VARCHAR) AS answer, CAST(props->>'$.k' AS INTEGER) AS k, value, event_id, user_id % 5 AS env FROM events)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean value per system (event type), user and k, as scores of paired rows."""
    t = turns(spark, sf_dir)
    return t.groupBy(F.col("tool").alias("system"), F.col("episode").alias("trajectory"), F.col("k").alias("turn_idx")).agg(F.round(F.avg("value"), 4).alias("score"))


SCORES = TURNS + """, sc AS (SELECT tool AS system, episode AS trajectory, k AS turn_idx, round(avg(value), 4) AS score FROM tu GROUP BY ALL)"""

TOKENS = r"[A-Za-z][\w.\-]{5,}"
