"""Evidence bookkeeping around rule induction: guards, schema completion, contrasts, demonstrations, provenance."""

from __future__ import annotations

from functools import reduce

import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

STATE_ROOTS = ("world", "session", "surface", "epistemic")


def json_type(value: Column) -> Column:
    """object, array, string, boolean, integer, number or null of a JSON text."""
    v = F.trim(value)
    return (
        F.when(v.startswith("{"), "object").when(v.startswith("["), "array").when(v.startswith('"'), "string").when(v.isin("true", "false"), "boolean")
        .when(v == "null", "null").when(v.rlike(r"^-?\d+$"), "integer").when(v.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), "number").otherwise("string")
    )


def guard_evidence(evidence: DataFrame, transitions: DataFrame) -> DataFrame:
    """Evidence held to its transition: mutations go and confidence is at most 0.5 where the transition is ambiguous or
    concurrent; citations outside it go and are counted; without any left, its own events are cited; refused records get
    confidence 0. Adds dropped_citations, capped, refused."""
    t = transitions.select("transition_id", F.concat("action_ids", "observation_ids", "history_ids").alias("allowed"), F.concat("action_ids", "observation_ids").alias("own"), ((F.col("alignment") == "ambiguous") | (F.size("concurrent_ids") > 0)).alias("unsure"))
    x = evidence.join(t, "transition_id")
    good = F.filter("event_ids", lambda e: F.array_contains("allowed", e))
    refused = F.coalesce(F.col("outcome").isin("refused", "invalid"), F.lit(True))
    return x.select(
        *[c for c in evidence.columns if c not in ("event_ids", "confidence", "mutations")],
        F.when(F.size(good) > 0, good).otherwise(F.col("own")).alias("event_ids"),
        F.when(F.col("unsure"), F.array().cast(evidence.schema["mutations"].dataType)).otherwise(F.col("mutations")).alias("mutations"),
        F.when(refused, 0.0).when(F.col("unsure"), F.least("confidence", F.lit(0.5))).otherwise(F.col("confidence")).alias("confidence"),
        (F.size("event_ids") - F.size(good)).alias("dropped_citations"), F.col("unsure").alias("capped"), refused.alias("refused"),
    )


def path_prefixes(path: Column) -> Column:
    """All dotted beginnings of a path, shortest first."""
    parts = F.split(path, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))


def canonical_actions(rows: DataFrame, aliases: DataFrame, column: str) -> DataFrame:
    """Action names through their aliases (alias, name): a table of the schema's size."""
    a = aliases.select(F.col("alias").alias(column), F.col("name").alias("_name"))
    return rows.join(a, column, "left").withColumn(column, F.coalesce("_name", column)).drop("_name")


def canonical_paths(rows: DataFrame, aliases: DataFrame, key: str, column: str = "path") -> DataFrame:
    """(key, path, canonical): the longest aliased beginning of a path replaced."""
    named = rows.select(key, F.col(column).alias("path")).distinct()
    each = named.withColumn("alias", F.explode(path_prefixes(F.col("path")))).join(aliases.select("alias", "name"), "alias")
    best = each.groupBy(key, "path").agg(F.max_by(F.struct("alias", "name"), F.length("alias")).alias("b"))
    x = named.join(best, [key, "path"], "left")
    return x.select(key, "path", F.when(F.col("b").isNull(), F.col("path")).otherwise(F.concat("b.name", F.substr("path", F.length("b.alias") + 1))).alias("canonical"))


def check_aliases(schema: DataFrame) -> tuple[DataFrame, DataFrame]:
    """schema (name, aliases) -> (alias, name) that hold, and (alias, reason) of those dropped: equal to a declared
    name, claimed by several, repeated."""
    claims = schema.select("name", F.explode("aliases").alias("alias"))
    names = schema.select(F.col("name").alias("alias"), F.lit(True).alias("declared")).distinct()
    c = claims.groupBy("alias").agg(F.count_distinct("name").alias("owners"), F.count("*").alias("n"), F.min("name").alias("name")).join(names, "alias", "left")
    reason = F.when(F.col("declared"), "declared name").when(F.col("owners") > 1, "claimed twice").when(F.col("n") > 1, "redundant")
    x = c.withColumn("reason", reason)
    return x.where("reason IS NULL OR reason = 'redundant'").select("alias", "name"), x.where("reason IS NOT NULL").select("alias", "reason")


def observed_actions(evidence: DataFrame, declared: DataFrame, records: int = 5, citations: int = 10) -> DataFrame:
    """Undeclared action types: transitions, and the first citations of their first records."""
    x = evidence.join(declared.select(F.col("name").alias("action_type")), "action_type", "left_anti")
    n = x.groupBy("action_type").agg(F.count_distinct("transition_id").alias("transitions"))
    first = x.withColumn("_r", F.row_number().over(Window.partitionBy("action_type").orderBy("id"))).where(F.col("_r") <= records)
    cited = first.groupBy("action_type").agg(F.slice(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_r", "event_ids"))), lambda r: r["event_ids"])), 1, citations).alias("citations"))
    return n.join(cited, "action_type")


def observed_arguments(evidence: DataFrame) -> DataFrame:
    """(action_type, argument, type): the JSON type seen, `any` if it varies; integers and numbers are numbers."""
    kinds = F.from_json("arguments", "map<string,variant>")
    each = evidence.select("action_type", F.explode(kinds).alias("argument", "v")).select("action_type", "argument", json_type(F.to_json("v")).alias("t")).where("t <> 'null'")
    return each.groupBy("action_type", "argument").agg(F.collect_set("t").alias("s")).select("action_type", "argument", F.when(F.size("s") == 1, F.get("s", F.lit(0))).when(F.size(F.array_except("s", F.array(F.lit("integer"), F.lit("number")))) == 0, "number").otherwise("any").alias("type"))


def observed_paths(values: DataFrame, declared: DataFrame) -> DataFrame:
    """values (path, value), declared (path, type): undeclared paths that no declared object, array or any covers."""
    each = values.select("path", F.explode(path_prefixes(F.col("path"))).alias("prefix")).distinct()
    covering = declared.select(F.col("path").alias("prefix"), "type")
    covered = each.join(covering, "prefix").where((F.col("prefix") == F.col("path")) | F.col("type").isin("object", "array", "any")).select("path").distinct()
    free = values.join(covered, "path", "left_anti")
    return free.groupBy("path").agg(F.collect_set(json_type(F.col("value"))).alias("s"), F.count("*").alias("n")).select("path", F.when(F.size("s") == 1, F.get("s", F.lit(0))).otherwise("any").alias("type"), "n")


def matched_contrasts(evidence: DataFrame, limit: int = 32) -> DataFrame:
    """evidence (id, group, action_type, arguments, scope, outcome, confidence, preconditions MAP). Each success with the
    first failure of another group for the same action, arguments and scope; at most `limit` per key, the most
    confident successes first. Of the failures of a key only the best two groups are needed, so no success meets all."""
    key = F.sha2(F.to_json(F.struct("action_type", "arguments", "scope")), 256)
    x = evidence.withColumn("key", key)
    fails = x.where("outcome = 'failure'")
    order = [F.desc("confidence"), "id"]
    best = fails.withColumn("_r", F.row_number().over(Window.partitionBy("key", "group").orderBy(*order))).where("_r = 1")
    two = best.withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy(*order))).where("_r <= 2")
    other = two.select("key", F.col("_r").alias("fr"), F.col("id").alias("failure_id"), F.col("group").alias("fg"), F.col("preconditions").alias("fp"))
    good = x.where("outcome = 'success'").withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(*order)))
    pairs = good.join(other, "key").where(F.col("group") != F.col("fg"))
    w = Window.partitionBy("key", "id").orderBy("fr")
    one = pairs.withColumn("_p", F.row_number().over(w)).where("_p = 1").withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("rank"))).where(F.col("n") <= limit)
    both = F.array_intersect(F.map_keys("preconditions"), F.map_keys("fp"))
    same = lambda k: F.element_at("preconditions", k).eqNullSafe(F.element_at("fp", k))
    return one.select(
        "action_type", F.col("id").alias("success_id"), "failure_id", F.array_sort(F.filter(both, same)).alias("shared"), F.array_sort(F.filter(both, lambda k: ~same(k))).alias("differing"),
        F.array_sort(F.array_union(F.array_except(F.map_keys("preconditions"), F.map_keys("fp")), F.array_except(F.map_keys("fp"), F.map_keys("preconditions")))).alias("unmatched"),
    )


def action_cohorts(evidence: DataFrame) -> DataFrame:
    """Evidence numbered by id inside its action type, with the cohort's size."""
    return evidence.withColumn("position", F.row_number().over(Window.partitionBy("action_type").orderBy("id"))).withColumn("cohort", F.count("*").over(Window.partitionBy("action_type")))


def select_demonstrations(evidence: DataFrame, per_action: int = 3) -> DataFrame:
    """(action_type, id, position): greedily a new outcome first, then a new episode, then confidence, then id. Only the
    best `per_action` of each (action, outcome, episode) and, of those, of each (action, outcome) can be chosen, so a
    window trims a hot action before the greedy step."""
    order = [F.desc("confidence"), "id"]
    a = evidence.select("action_type", "id", "outcome", "episode_id", "confidence")
    a = a.withColumn("_r", F.row_number().over(Window.partitionBy("action_type", "outcome", "episode_id").orderBy(*order))).where(F.col("_r") <= per_action)
    a = a.withColumn("_q", F.row_number().over(Window.partitionBy("action_type", "outcome").orderBy("_r", *order))).where(F.col("_q") <= 2 * per_action)

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        left = pdf.to_dict("records")
        seen: set = set()
        out = []
        while left and len(out) < per_action:
            best = min(left, key=lambda r: (("o", r["outcome"]) in seen, ("e", r["episode_id"]) in seen, -r["confidence"], r["id"]))
            left.remove(best)
            seen |= {("o", best["outcome"]), ("e", best["episode_id"])}
            out.append(best["id"])
        return pd.DataFrame({"action_type": pdf["action_type"].iloc[0], "id": out, "position": range(1, len(out) + 1)})

    return a.drop("_r", "_q").groupBy("action_type").applyInPandas(greedy, "action_type string, id string, position int")


def repair_provenance(refs: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """refs (owner_kind, owner_id, episode_id, event_ids) anchored to the episodes that hold their events; unknown ids
    are dropped and listed."""
    each = refs.select("owner_kind", "owner_id", F.explode("event_ids").alias("event_id"))
    known = events.select("event_id", "episode_id", "source_id", "pos")
    found = each.join(known, "event_id")
    whole = found.groupBy("owner_kind", "owner_id", "source_id", "episode_id").agg(F.transform(F.sort_array(F.collect_set(F.struct("pos", "event_id"))), lambda x: x["event_id"]).alias("event_ids"))
    return whole, each.join(known.select("event_id"), "event_id", "left_anti").distinct()


def rule_support(rules: DataFrame, citations: DataFrame, transitions: DataFrame) -> DataFrame:
    """rules (rule_id, action_type, status), citations (rule_id, event_id), transitions (action_type, alignment,
    concurrent_ids, observation_ids): a supported rule that cites no observation of a clear transition of its action is
    tentative."""
    clear = transitions.where((F.col("alignment") != "ambiguous") & (F.size("concurrent_ids") == 0)).select("action_type", F.explode("observation_ids").alias("event_id"))
    backed = citations.join(rules.select("rule_id", "action_type"), "rule_id").join(clear, ["action_type", "event_id"], "left_semi").select("rule_id").distinct().withColumn("_ok", F.lit(True))
    return rules.join(backed, "rule_id", "left").withColumn("status", F.when((F.col("status") == "supported") & F.col("_ok").isNull(), "tentative").otherwise(F.col("status"))).drop("_ok")


def quarantine(rules: DataFrame, paths: DataFrame, actions: DataFrame, declared: DataFrame, renderers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rules (rule_id, action_type, renderer), paths (rule_id, path, use read|write), actions (name), declared (path,
    type, mutable), renderers (id): rules whose references all exist, and the others with their reasons."""
    unknown_action = rules.join(actions.select(F.col("name").alias("action_type")), "action_type", "left_anti").select("rule_id", F.concat(F.lit("unknown action "), "action_type").alias("reason"))
    unknown_renderer = rules.where("renderer IS NOT NULL").join(renderers.select(F.col("id").alias("renderer")), "renderer", "left_anti").select("rule_id", F.concat(F.lit("unknown renderer "), "renderer").alias("reason"))
    each = paths.select("rule_id", "path", "use", F.explode(path_prefixes(F.col("path"))).alias("prefix")).join(declared.select(F.col("path").alias("prefix"), "type", "mutable"), "prefix")
    fits = each.where((F.col("prefix") == F.col("path")) | F.col("type").isin("object", "array", "any"))
    unknown_path = paths.join(fits.select("rule_id", "path").distinct(), ["rule_id", "path"], "left_anti").select("rule_id", F.concat(F.lit("unknown path "), "path").alias("reason"))
    fixed = fits.where("use = 'write'").groupBy("rule_id", "path").agg(F.max_by("mutable", F.length("prefix")).alias("m")).where("NOT m").select("rule_id", F.concat(F.lit("immutable path "), "path").alias("reason"))
    reasons = reduce(DataFrame.unionByName, [unknown_action, unknown_renderer, unknown_path, fixed]).groupBy("rule_id").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    return rules.join(reasons, "rule_id", "left_anti"), rules.join(reasons, "rule_id")


def broken_references(child: DataFrame, key: str, parent: DataFrame, parent_key: str, kind: str) -> DataFrame:
    """(kind, key): references without a target."""
    return child.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key")).distinct().join(parent.select(F.col(parent_key).cast("string").alias("key")).distinct(), "key", "left_anti").select(F.lit(kind).alias("kind"), "key")


def repeated_ids(table: DataFrame, key: str, kind: str) -> DataFrame:
    return table.groupBy(F.col(key).cast("string").alias("key")).count().where("count > 1").select(F.lit(kind).alias("kind"), "key")


def validate_artifacts(events: DataFrame, episodes: DataFrame, transitions: DataFrame, evidence: DataFrame) -> DataFrame:
    """(kind, key) of repeated ids and broken references."""
    refs = transitions.select(F.explode(F.concat("action_ids", "observation_ids")).alias("event_id"))
    parts = [
        repeated_ids(events, "event_id", "repeated event"), repeated_ids(episodes, "episode_id", "repeated episode"), repeated_ids(transitions, "transition_id", "repeated transition"), repeated_ids(evidence, "id", "repeated evidence"),
        broken_references(events, "episode_id", episodes, "episode_id", "event without episode"), broken_references(refs, "event_id", events, "event_id", "transition without event"),
        broken_references(evidence, "transition_id", transitions, "transition_id", "evidence without transition"),
    ]
    return reduce(DataFrame.unionByName, parts)


def eligible_rules(rules: DataFrame, context: dict[str, str], least: float) -> DataFrame:
    """Supported rules of enough confidence whose scope (MAP) agrees with the context in every key."""
    known = F.create_map(*(F.lit(x) for kv in context.items() for x in kv)) if context else F.create_map().cast("map<string,string>")
    return rules.where((F.col("status") == "supported") & (F.col("confidence") >= least) & F.forall(F.map_entries(F.coalesce("scope", F.create_map().cast("map<string,string>"))), lambda e: F.element_at(known, e["key"]).eqNullSafe(e["value"])))


def knowledge_catalog(actions: DataFrame, rules: DataFrame, notes: DataFrame, demonstrations: DataFrame, evidence: DataFrame) -> DataFrame:
    """(kind, ref_id, action_type, text) of all artefacts; of notes only the supported ones."""
    row = lambda df, kind, ref, action, text: df.select(F.lit(kind).alias("kind"), F.col(ref).cast("string").alias("ref_id"), (F.col(action) if action else F.lit(None)).cast("string").alias("action_type"), F.coalesce(text, F.lit("")).alias("text"))
    parts = [row(actions, "action", "name", "name", F.col("description")), row(rules, "rule", "rule_id", "action_type", F.col("text")), row(notes.where("status = 'supported'"), "note", "id", None, F.col("text")), row(demonstrations, "demonstration", "id", "action_type", F.col("text")), row(evidence, "evidence", "id", "action_type", F.col("observation_text"))]
    return reduce(DataFrame.unionByName, parts)


def apply_edits(table: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """table (collection, key, value), edits (collection, key, op add|replace|remove, new). Errors are edits of a key that
    is edited twice, adds of a present key, and other edits of an absent one; the rest is applied."""
    k = ["collection", "key"]
    e = edits.withColumn("_n", F.count("*").over(Window.partitionBy(*k)))
    x = e.join(table.select(*k, F.lit(True).alias("_here")), k, "left")
    error = F.when(F.col("_n") > 1, "edited twice").when((F.col("op") == "add") & F.col("_here"), "already there").when((F.col("op") != "add") & F.col("_here").isNull(), "not there")
    checked = x.withColumn("error", error)
    good = checked.where("error IS NULL").select(*k, "op", "new")
    out = table.join(good, k, "full").where(F.coalesce(F.col("op") != "remove", F.lit(True))).select(*k, F.when(F.col("op").isNotNull(), F.col("new")).otherwise(F.col("value")).alias("value"))
    return out, checked.where("error IS NOT NULL").select(*k, "op", "error")


def domain_layout(states: DataFrame) -> DataFrame:
    """states (order, state JSON) -> (collection, field, first): collections and the fields of their records in the
    order of first sight."""
    top = states.select("order", F.posexplode(F.json_object_keys("state")).alias("i", "collection"), "state")
    records = top.select("order", "i", "collection", F.from_json(F.call_function("get_json_object", F.col("state"), F.concat(F.lit("$."), "collection")), "map<string,string>").alias("records"))
    fields = records.select("order", "i", "collection", F.explode(F.map_values("records")).alias("record")).select("order", "i", "collection", F.posexplode(F.json_object_keys("record")).alias("j", "field"))
    return fields.groupBy("collection", "field").agg(F.min(F.struct("order", "i", "j")).alias("first"))
