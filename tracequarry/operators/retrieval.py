"""The turn corpus, memories of sessions, and what prompts are made of."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from ..functions.text import clip_text, observation_snippet, page_text
from .search import lexical_topk, terms

def build_turn_corpus(transitions: DataFrame, texts: DataFrame, sources: DataFrame) -> DataFrame:
    """(turn_id, episode_id, label, turn, action_text, observation): turns in order; the label is the file stem up to
    `__`, the whole stem where several files share that part. sources: (episode_id, stem)."""
    short = F.substring_index("stem", "__", 1)
    shared = sources.groupBy(short.alias("short")).agg(F.count_distinct("stem").alias("n"))
    labels = sources.withColumn("short", short).join(shared, "short").select("episode_id", F.when(F.col("n") > 1, F.col("stem")).otherwise(F.col("short")).alias("label"))
    turn = F.row_number().over(Window.partitionBy("episode_id").orderBy("pos"))
    x = transitions.select("transition_id", "episode_id", "pos").withColumn("turn", turn).join(texts, "transition_id").join(labels, "episode_id", "left")
    return x.select(F.concat_ws(":", F.lit("trace"), "episode_id", F.col("turn").cast("string")).alias("turn_id"), "episode_id", "label", "turn", "action_text", F.col("observation_text").alias("observation"))


def catalog_search(hits: DataFrame, catalog: DataFrame, kinds: list[str] | None, k: int) -> DataFrame:
    """Hits (query_id, id, score) of some kinds; an evidence and its demonstration count once, by the better score."""
    x = hits.join(catalog.select(F.col("ref_id").alias("id"), "kind", F.coalesce("evidence_id", "ref_id").alias("group")), "id")
    if kinds:
        x = x.where(F.col("kind").isin(kinds))
    once = x.withColumn("_r", F.row_number().over(Window.partitionBy("query_id", "group").orderBy(F.desc("score"), "id"))).where("_r = 1").drop("_r")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def recent_memory(entries: DataFrame, n: int) -> DataFrame:
    """The last n turns of each session; of a turn, observed entries before predicted ones."""
    w = Window.partitionBy("session").orderBy(F.desc("turn"))
    last = entries.withColumn("_r", F.dense_rank().over(w)).where(F.col("_r") <= n).drop("_r")
    order = Window.partitionBy("session").orderBy("turn", F.when(F.col("origin") == "observed", 0).otherwise(1), "entry")
    return last.withColumn("position", F.row_number().over(order))


def turn_memory(entries: DataFrame, turns: DataFrame) -> DataFrame:
    """The entries of the wanted (session, turn), observed before predicted."""
    order = Window.partitionBy("session", "turn").orderBy(F.when(F.col("origin") == "observed", 0).otherwise(1), "entry")
    return entries.join(turns, ["session", "turn"], "left_semi").withColumn("position", F.row_number().over(order))


def session_search(queries: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    """lexical_topk of queries (query_id, session, text) over the entries (entry, session, text) of their own session."""
    return lexical_topk(queries, entries, k, id_col="entry", same=["session"])


def rag_block(hits: DataFrame, corpus: DataFrame, n_chars: int) -> DataFrame:
    """(query_id, block, ids): the retrieved turns in order of rank, each clipped."""
    x = hits.join(corpus.select("id", "action_text", "observation"), "id")
    part = F.format_string("[%s]\nACTION: %s\nOBSERVATION: %s", F.col("id").cast("string"), clip_text(F.col("action_text"), n_chars), clip_text(F.col("observation"), n_chars))
    g = x.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", part.alias("p"), F.col("id").cast("string").alias("i")))).alias("a"))
    return g.select("query_id", F.array_join(F.transform("a", lambda r: r["p"]), "\n\n").alias("block"), F.transform("a", lambda r: r["i"]).alias("ids"))


def package_view(rows: DataFrame, rules: DataFrame, demonstrations: DataFrame, notes: DataFrame, n_rules: int = 12, n_demonstrations: int = 4) -> DataFrame:
    """Per row the rules of its action (priority, confidence, id), demonstrations and notes, as text and ids."""
    def ranked(df: DataFrame, order: list, n: int, name: str) -> DataFrame:
        x = df.withColumn("_r", F.row_number().over(Window.partitionBy("action_type").orderBy(*order))).where(F.col("_r") <= n)
        g = x.groupBy("action_type").agg(F.sort_array(F.collect_list(F.struct("_r", "id", "text"))).alias("a"))
        return g.select("action_type", F.transform("a", lambda r: r["id"]).alias(f"{name}_ids"), F.array_join(F.transform("a", lambda r: r["text"]), "\n").alias(name))

    r = ranked(rules, [F.desc("priority"), F.desc("confidence"), F.desc("id")], n_rules, "rules")
    d = ranked(demonstrations, ["position", "id"], n_demonstrations, "demonstrations")
    n = notes.where("status = 'supported'").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("notes"))
    return rows.join(r, "action_type", "left").join(d, "action_type", "left").join(F.broadcast(n))  # one row of notes


def chat_messages(prompt: Column, response: Column, turn: Column, system: Column, current: Column) -> Column:
    """System, the turns before in turn, the current prompt."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    before = F.zip_with(F.slice(prompt, F.lit(1), turn - 1), F.slice(response, F.lit(1), turn - 1), lambda p, r: F.array(message("user", p), message("assistant", r)))
    return F.concat(F.array(message("system", system)), F.flatten(before), F.array(message("user", current)))


def judge_context(prompt: Column, response: Column, turn: Column) -> Column:
    before = F.zip_with(F.slice(prompt, F.lit(1), turn - 1), F.slice(response, F.lit(1), turn - 1), lambda p, r: F.concat(p, F.lit("\n"), r))
    return F.array_join(before, "\n\n")


def bench_rows(turns: DataFrame, evaluated: DataFrame, suffix: str) -> DataFrame:
    """turns (episode, turn, prompt, response), evaluated (episode, turn): prefix arrays of each evaluated turn, the
    suffix on its last prompt. Prefixes are made by a join that keeps only evaluated turns."""
    want = evaluated.select("episode", F.col("turn").alias("turn_idx"))
    x = turns.join(want, "episode").where(F.col("turn") <= F.col("turn_idx"))
    total = turns.groupBy("episode").agg(F.count("*").alias("total_turns"))
    g = x.groupBy("episode", "turn_idx").agg(F.sort_array(F.collect_list(F.struct("turn", "prompt", "response"))).alias("a")).join(total, "episode")
    prompts = F.transform("a", lambda r: r["prompt"])
    last = F.concat(F.element_at(prompts, -1), F.lit(suffix))
    return g.select("episode", "turn_idx", "total_turns", F.concat(F.slice(prompts, F.lit(1), F.size(prompts) - 1), F.array(last)).alias("prompt"), F.transform("a", lambda r: r["response"]).alias("response"), last.alias("current_prompt"))


def read_pages(asked: DataFrame, corpus: DataFrame) -> DataFrame:
    """asked (episode, turn, offset, length), corpus (episode, turn, action_type, observation): an exact span of each
    asked turn's observation (an offset below 0 is 0, a length below 1 is 1), where the next begins, and the actions of
    the turns beside it as neighbours (turn, action_type). Turns that aren't there have no rows."""
    beside = corpus.select("episode", F.col("turn").alias("other"), "action_type")
    want = asked.select("episode", "turn", F.greatest("offset", F.lit(0)).alias("offset"), F.greatest("length", F.lit(1)).alias("length"))
    near = want.select("episode", "turn", F.explode(F.array(F.col("turn") - 1, F.col("turn") + 1)).alias("other")).distinct().join(beside, ["episode", "other"])
    near = near.groupBy("episode", "turn").agg(F.sort_array(F.collect_list(F.struct(F.col("other").alias("turn"), "action_type"))).alias("neighbours"))
    page = page_text(F.col("observation"), F.col("offset"), F.col("length"))
    x = want.join(corpus, ["episode", "turn"]).select("episode", "turn", "action_type", F.length("observation").alias("total_chars"), "offset", page.alias("p")).join(near, ["episode", "turn"], "left")
    none = F.array().cast(near.schema["neighbours"].dataType)
    return x.select("episode", "turn", "action_type", "total_chars", "offset", F.col("p.part").alias("text"), F.col("p.next_offset").alias("next_offset"), F.coalesce("neighbours", none).alias("neighbours"))


def with_snippets(hits: DataFrame, queries: DataFrame, corpus: DataFrame, width: int = 200) -> DataFrame:
    x = hits.join(queries.select("query_id", terms(F.col("text")).alias("_t")), "query_id").join(corpus.select("id", F.col("text").alias("_b")), "id")
    return x.withColumn("snippet", observation_snippet(F.col("_b"), F.col("_t"), width)).drop("_t", "_b")
