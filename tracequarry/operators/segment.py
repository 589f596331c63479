"""Actions and their observations: by call id where there is one, else by position."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from ..functions.lineage import settled
from ..sources.traces import stable_id
from .ranks import running

#: Why a transition is uncertain.
DUPLICATE = "Duplicate call ID prevents unambiguous result matching."
OVERLAP = "Overlapping calls: result attribution does not establish mutation order."
UNASSIGNED = "Concurrent calls have no correlation IDs; outputs remain unassigned."
MISSING = "No unambiguous observation is available for this action."


def is_observation() -> Column:
    return F.col("kind").isin("observation", "error", "state") | F.col("actor").isin("environment", "tool")


def is_action() -> Column:
    return F.col("kind") == "action"


def reply_id() -> Column:
    return F.nullif(F.coalesce("tool_call_id", "call_id"), F.lit(""))


def _ordered() -> Window:
    return Window.partitionBy("episode_id").orderBy("pos")


def segment_sequential(events: DataFrame) -> DataFrame:
    """Actions without call id and not in a batch, with the observations without any call id before the next action:
    episode_id, action_id, pos, observation_ids."""
    island = F.count(F.when(is_action(), 1)).over(_ordered())
    rows = events.withColumn("island", island).where("island > 0")
    free = is_observation() & ~is_action() & reply_id().isNull()
    grouped = rows.groupBy("episode_id", "island").agg(
        F.min_by(F.struct("event_id", "pos", "call_id", "batch_size"), "pos").alias("a"),
        F.sort_array(F.collect_list(F.when(free, F.struct("pos", "event_id")))).alias("o"),
    )
    return grouped.where(F.nullif(F.col("a.call_id"), F.lit("")).isNull() & (F.coalesce("a.batch_size", F.lit(1)) <= 1)).select(
        "episode_id", F.col("a.event_id").alias("action_id"), F.col("a.pos").alias("pos"), F.transform("o", lambda x: x["event_id"]).alias("observation_ids")
    )


def call_replies(events: DataFrame) -> DataFrame:
    """Actions with a call id, one row each: `repeated` marks call ids that several actions of the episode have; replies,
    its later replies as (pos, id) in order (none for a repeated id, whose replies belong to no single action);
    last_reply, the position of the last later reply either way. Replies are gathered once an id, so an id with many
    actions and many replies is no product of both."""
    calls = events.where(is_action() & F.nullif("call_id", F.lit("")).isNotNull()).select("episode_id", "call_id", "event_id", "pos", "parent_event_id")
    calls = calls.withColumn("repeated", F.count("*").over(Window.partitionBy("episode_id", "call_id")) > 1)
    replies = events.where(is_observation()).select("episode_id", reply_id().alias("call_id"), F.col("pos").alias("rpos"), F.col("event_id").alias("rid")).where("call_id IS NOT NULL")
    last = replies.groupBy("episode_id", "call_id").agg(F.max("rpos").alias("last"))
    single = calls.where("NOT repeated").select("episode_id", "call_id", "pos")
    own = replies.join(single, ["episode_id", "call_id"]).where(F.col("rpos") > F.col("pos")).groupBy("episode_id", "call_id").agg(F.sort_array(F.collect_list(F.struct("rpos", "rid"))).alias("replies"))
    x = calls.join(last, ["episode_id", "call_id"], "left").join(own, ["episode_id", "call_id"], "left")
    none = F.array().cast(own.schema["replies"].dataType.simpleString())
    return x.select("episode_id", "call_id", "event_id", "pos", "parent_event_id", "repeated", F.coalesce(F.when(~F.col("repeated"), F.col("replies")), none).alias("replies"), F.when(F.col("last") > F.col("pos"), F.col("last")).alias("last_reply"))


def segment_correlated(events: DataFrame) -> DataFrame:
    """Actions with call id and the ids of their replies; none where the call id is repeated."""
    return call_replies(events).select(
        "episode_id", F.col("event_id").alias("action_id"), "pos", F.when(F.col("repeated"), F.array().cast("array<string>")).otherwise(F.transform("replies", lambda x: x["rid"])).alias("observation_ids"), "repeated"
    )


def concurrent_actions(events: DataFrame) -> DataFrame:
    """(episode_id, action_id, concurrent_ids) of actions with call id: actions between it and its last reply, calls
    still unanswered when it begins, and calls of the same message. Calls of an episode meet on the episode and on
    blocks of positions, so a long episode is not one product."""
    calls = call_replies(events)
    last = F.when(F.col("repeated") | F.col("last_reply").isNull(), F.col("pos")).otherwise(F.col("last_reply"))
    open_until = F.coalesce("last_reply", F.lit(2**31 - 1))
    block = 256
    spans = calls.select("episode_id", F.col("event_id").alias("action_id"), "pos", last.alias("last"), open_until.alias("until"), "parent_event_id")
    actions = events.where(is_action()).select("episode_id", F.col("event_id").alias("other"), F.col("pos").alias("opos"))
    by_block = spans.where(F.col("last") > F.col("pos")).withColumn("block", F.explode(F.sequence(F.floor(F.col("pos") / block), F.floor(F.col("last") / block))))
    inside = by_block.join(actions.withColumn("block", F.floor(F.col("opos") / block)), ["episode_id", "block"]).where((F.col("opos") > F.col("pos")) & (F.col("opos") < F.col("last")))
    end = events.groupBy("episode_id").agg(F.max("pos").alias("end"))
    pending = spans.join(end, "episode_id").withColumn("block", F.explode(F.sequence(F.floor(F.col("pos") / block), F.floor(F.least("until", "end") / block))))
    pending = pending.select("episode_id", "block", F.col("action_id").alias("other"), F.col("pos").alias("opos"), F.col("until").alias("open_until"))
    earlier = spans.withColumn("block", F.floor(F.col("pos") / block)).join(pending, ["episode_id", "block"]).where((F.col("opos") < F.col("pos")) & (F.col("open_until") > F.col("pos")))
    siblings = spans.where("parent_event_id IS NOT NULL").join(
        events.where(is_action() & F.col("parent_event_id").isNotNull()).select("episode_id", "parent_event_id", F.col("event_id").alias("other"), F.col("pos").alias("opos")), ["episode_id", "parent_event_id"]
    ).where(F.col("other") != F.col("action_id"))
    parts = [x.select("episode_id", "action_id", "other", "opos") for x in (inside, earlier, siblings)]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()
    return both.groupBy("episode_id", "action_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("opos", "other"))), lambda x: x["other"]).alias("concurrent_ids"))


def concurrency_counts(events: DataFrame) -> DataFrame:
    """(episode_id, action_id, pos, n_inside, n_open, n_siblings, n_concurrent) of actions with call id: how many actions
    begin before its last reply, how many calls are unanswered when it begins, and how many actions of its message are
    neither. The sizes of concurrent_actions, without its pairs: begin and end points of all calls are swept in order of
    position, with running sums that go over blocks of positions, so the calls of an episode may all be open at once."""
    call_id = F.nullif("call_id", F.lit(""))
    act = events.where(is_action()).select("episode_id", F.col("event_id").alias("action_id"), F.col("pos").cast("long").alias("pos"), "parent_event_id", call_id.alias("id"))
    calls = act.where("id IS NOT NULL").groupBy("episode_id", "id").agg(F.count("*").alias("calls"))
    replies = events.where(is_observation()).select("episode_id", reply_id().alias("id"), "pos").groupBy("episode_id", "id").agg(F.max("pos").cast("long").alias("reply"))
    x = act.join(calls, ["episode_id", "id"], "left").join(replies, ["episode_id", "id"], "left")
    until = F.when(F.col("id").isNotNull() & (F.col("reply") > F.col("pos")), F.col("reply"))
    x = settled(x.select("episode_id", "action_id", "pos", "parent_event_id", F.col("id").isNotNull().alias("called"), until.alias("until"), F.when(F.col("calls") == 1, until).alias("last")))

    def point(at: str, mark: str) -> Column:
        n = lambda c: c.cast("long")
        begins = F.lit(mark == "begin")
        return F.when(F.col(at).isNotNull(), F.struct(F.col(at).alias("at"), F.lit(mark).alias("mark"), n(begins).alias("act"), n(begins & F.col("called")).alias("begin"), n(F.lit(mark == "end")).alias("end")))

    def swept(keys: list[str]) -> DataFrame:
        """(keys, action_id, pos, n_inside, n_open) of the calls, among the actions that share the keys."""
        points = F.array_compact(F.array(point("pos", "begin"), point("last", "last"), point("until", "end")))
        each = x.dropna(subset=keys).select(*keys, "action_id", "pos", "called", F.explode(points).alias("p")).select(*keys, "action_id", "pos", "called", "p.*")
        asked = running(each, keys, "at", ["act", "begin", "end"]).where("called AND mark <> 'end'")
        at_begin, at_last = (lambda c: F.max(F.when(F.col("mark") == "begin", F.expr(c)))), F.max(F.when(F.col("mark") == "last", F.col("act_before")))
        inside = F.coalesce(at_last - at_begin("act_upto"), F.lit(0))
        return asked.groupBy(*keys, "action_id", "pos").agg(F.greatest(inside, F.lit(0)).alias("n_inside"), at_begin("begin_before - end_upto").alias("n_open"))

    whole = swept(["episode_id"])
    family = swept(["episode_id", "parent_event_id"])
    size = x.where("parent_event_id IS NOT NULL").groupBy("episode_id", "parent_event_id").agg(F.count("*").alias("size"))
    other = family.join(size, ["episode_id", "parent_event_id"]).select("episode_id", "action_id", "pos", (F.col("size") - 1 - F.col("n_inside") - F.col("n_open")).alias("n_siblings"))
    out = whole.join(other, ["episode_id", "action_id", "pos"], "left").withColumn("n_siblings", F.coalesce("n_siblings", F.lit(0)))
    return out.withColumn("n_concurrent", F.col("n_inside") + F.col("n_open") + F.col("n_siblings"))


def history_window(events: DataFrame, n: int = 20) -> DataFrame:
    """Ids of the n events before each event."""
    return events.withColumn("history_ids", F.collect_list("event_id").over(_ordered().rowsBetween(-n, -1)))


def segment_transitions(events: DataFrame, max_history_events: int = 20, ids: bool = True) -> DataFrame:
    """One row per action: history, observations, delayed and concurrent ids with their number, alignment, ambiguities,
    stable id. Calls of one episode that are all open at once have as many concurrent ids as there are pairs of them;
    without ids, only their number is given (concurrency_counts)."""
    rows = history_window(events, max_history_events).where(is_action())
    rows = rows.withColumn("next_action", F.lead("pos").over(_ordered()))
    replies = call_replies(events).select("episode_id", F.col("event_id").alias("rid_"), "repeated", "replies")
    seq = segment_sequential(events).select("episode_id", F.col("action_id").alias("sid_"), F.col("observation_ids").alias("seq_ids"))
    if ids:
        con = concurrent_actions(events).select("episode_id", F.col("action_id").alias("cid_"), "concurrent_ids", F.size("concurrent_ids").cast("long").alias("n_concurrent"))
    else:
        con = concurrency_counts(events).select("episode_id", F.col("action_id").alias("cid_"), F.lit(None).cast("array<string>").alias("concurrent_ids"), "n_concurrent")
    e = "episode_id"
    joined = (
        rows.join(replies.withColumnRenamed(e, "e1"), (F.col(e) == F.col("e1")) & (F.col("event_id") == F.col("rid_")), "left")
        .join(seq.withColumnRenamed(e, "e2"), (F.col(e) == F.col("e2")) & (F.col("event_id") == F.col("sid_")), "left")
        .join(con.withColumnRenamed(e, "e3"), (F.col(e) == F.col("e3")) & (F.col("event_id") == F.col("cid_")), "left")
    )
    none = F.array().cast("array<string>")
    called = F.nullif("call_id", F.lit("")).isNotNull()
    good = F.when(~F.col("repeated"), F.col("replies"))
    found = F.coalesce(F.when(called, F.transform(good, lambda x: x["rid"])).otherwise(F.col("seq_ids")), none)
    late = F.coalesce(F.transform(F.filter(good, lambda x: x["rpos"] >= F.col("next_action")), lambda x: x["rid"]), none)
    concurrent = F.coalesce("concurrent_ids", none) if ids else F.col("concurrent_ids")
    n = F.when(called, F.coalesce("n_concurrent", F.lit(0).cast("long"))).otherwise(0)
    batch = ~called & (F.coalesce("batch_size", F.lit(1)) > 1)
    notes = F.array_compact(F.array(
        F.when(called & F.col("repeated"), F.lit(DUPLICATE)), F.when(n > 0, F.lit(OVERLAP)),
        F.when(batch, F.lit(UNASSIGNED)), F.when(F.size(found) == 0, F.lit(MISSING)),
    ))
    return joined.select(
        stable_id("tr", F.col(e), F.col("event_id"), found).alias("transition_id"), e, "pos", "history_ids", F.array("event_id").alias("action_ids"),
        found.alias("observation_ids"), F.when(called, late).otherwise(none).alias("delayed_ids"), F.when(called, concurrent).otherwise(none).alias("concurrent_ids"), n.alias("n_concurrent"),
        F.when(F.size(found) == 0, "ambiguous").when(called, "correlated").otherwise("sequential").alias("alignment"), notes.alias("ambiguities"),
    )


def transition_text(events: DataFrame, transitions: DataFrame) -> DataFrame:
    """(transition_id, action_text, observation_text): contents joined by newlines."""
    text = events.select("event_id", "content")

    def side(ids: str, name: str) -> DataFrame:
        rows = transitions.select("transition_id", F.posexplode(ids).alias("i", "event_id")).join(text, "event_id")
        return rows.groupBy("transition_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "content"))), lambda x: x["content"]), "\n").alias(name))

    out = transitions.select("transition_id").join(side("action_ids", "action_text"), "transition_id", "left").join(side("observation_ids", "observation_text"), "transition_id", "left")
    return out.select("transition_id", F.coalesce("action_text", F.lit("")).alias("action_text"), F.coalesce("observation_text", F.lit("")).alias("observation_text"))


def apply_span_annotations(events: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cut text events at spans (event_id, start, end, actor, kind); text between spans stays a message. Returns the
    new events and the errors (event_id, error): unknown id, out of range, overlap."""
    s = spans.join(events.select("event_id", F.length("content").alias("size")), "event_id", "left")
    w = Window.partitionBy("event_id").orderBy("start", "end")
    checked = s.withColumn("before", F.lag("end").over(w)).withColumn(
        "error",
        F.when(F.col("size").isNull(), "unknown event").when((F.col("start") < 0) | (F.col("end") <= F.col("start")) | (F.col("end") > F.col("size")), "out of range").when(F.col("before") > F.col("start"), "overlap"),
    )
    errors = checked.where("error IS NOT NULL").select("event_id", "error")
    good = checked.join(errors.select("event_id").distinct(), "event_id", "left_anti")
    by_event = good.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "actor", "kind"))).alias("spans"))
    rows = events.join(by_event, "event_id", "left")
    gap = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), F.lit(None).cast("string").alias("actor"), F.lit("message").alias("kind"))
    typed = F.transform("spans", lambda x: F.struct(x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end"), x["actor"].alias("actor"), x["kind"].alias("kind")))
    n = F.size("spans")
    gaps = F.transform(F.sequence(F.lit(0), n), lambda i: gap(F.coalesce(F.get(F.col("spans.end"), i - 1), F.lit(0)), F.coalesce(F.get(F.col("spans.start"), i), F.length("content"))))
    cut = F.array_sort(F.filter(F.concat(typed, gaps), lambda x: x["end"] > x["start"]))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length("content").alias("end"), F.col("actor").alias("actor"), F.col("kind").alias("kind")))
    parts = rows.withColumn("part", F.explode(F.when(F.col("spans").isNull(), whole).otherwise(cut)))
    body = F.when(F.col("spans").isNull(), F.col("content")).otherwise(F.substr("content", F.col("part.start") + 1, F.col("part.end") - F.col("part.start")))
    order = Window.partitionBy("episode_id").orderBy("pos", F.col("part.start"))
    out = parts.select(
        "episode_id", F.when(F.col("spans").isNull(), F.col("event_id")).otherwise(F.concat("event_id", F.lit(":"), F.col("part.start").cast("string"))).alias("event_id"),
        (F.row_number().over(order) - 1).alias("pos"), F.coalesce("part.actor", "actor").alias("actor"), F.col("part.kind").alias("kind"), body.alias("content"),
    )
    return out, errors


def episode_stats(events: DataFrame) -> DataFrame:
    """Events, actions and observations of each episode; `unparsed` without an action or without an observation."""
    seen = is_observation()
    return events.groupBy("episode_id").agg(
        F.count("*").alias("n_events"), F.count_if(is_action()).alias("n_actions"), F.count_if(seen & ~is_action()).alias("n_observations"), (~F.bool_or(is_action()) | ~F.bool_or(seen)).alias("unparsed")
    )
