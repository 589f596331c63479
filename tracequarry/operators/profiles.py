"""Costs, usage and dataset profiles."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from ..functions.lineage import settled


def call_costs(log: DataFrame, prices: DataFrame, role: str = "role", by: str = "model") -> DataFrame:
    """Per role and in total (role null): calls, cache hits, errors, tokens, seconds, cost. prices (model, prompt,
    completion, cached), of a few models."""
    x = log.join(F.broadcast(prices), by, "left") if by in log.columns else log.join(F.broadcast(prices))
    cost = (F.col("prompt_tokens") - F.col("cached_tokens")) * F.col("prompt") + F.col("cached_tokens") * F.col("cached") + F.col("completion_tokens") * F.col("completion")
    return x.rollup(role).agg(
        F.count("*").alias("calls"), F.count_if("cache_hit").alias("cache_hits"), F.count("error").alias("errors"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("cached_tokens").alias("cached_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"), F.sum("elapsed_s").alias("seconds"), F.sum(cost).alias("cost"),
    )


def fresh_equivalent(log: DataFrame, n_rows: int, role: str = "role", without_errors: bool = False) -> DataFrame:
    """Per role: what a row would cost without cache hits (mean of fresh calls times calls per row), prompt mean and
    maximum. log has `cost`."""
    fresh = ~F.col("cache_hit") & (F.col("error").isNull() if without_errors else F.lit(True))
    mean = lambda c: F.avg(F.when(fresh, F.col(c)))
    return log.groupBy(role).agg(
        F.count("*").alias("calls"), F.count_if(fresh).alias("fresh_calls"), (mean("cost") * F.count("*") / n_rows).alias("cost_per_row"), (mean("elapsed_s") * F.count("*") / n_rows).alias("seconds_per_row"),
        mean("prompt_tokens").alias("prompt_mean"), F.max(F.when(fresh, F.col("prompt_tokens"))).alias("prompt_max"),
    )


def row_resources(rows: DataFrame, by: str, budget: int = 8) -> DataFrame:
    """rows (tools ARRAY, latency, citations ARRAY of kinds, tokens, chars): calls per row without `_usage`, rows at the
    budget, latency, tokens and what characters make of them."""
    calls = F.size(F.filter("tools", lambda t: t != "_usage"))
    return rows.groupBy(by).agg(
        F.count("*").alias("n_rows"), F.avg(calls).alias("calls"), F.count_if(calls >= budget).alias("at_budget"), F.avg("latency").alias("latency_mean"), F.percentile("latency", F.lit(0.5)).alias("latency_median"),
        F.sum(F.size("citations")).alias("citations"), F.sum("tokens").alias("tokens"), (F.sum("chars") * (F.sum("tokens") / F.sum(F.when(F.col("tokens").isNotNull(), F.col("chars"))))).alias("estimated_tokens"),
    )


def collection_profile(turns: DataFrame, by: list[str]) -> DataFrame:
    """turns (tool, kind, outcome, answer, changed): per group and tool calls, kinds, state-changing calls, distinct
    answers and the share of the most frequent one. Answers are grouped by hash before they are counted."""
    each = turns.withColumn("h", F.xxhash64("answer")).groupBy(*by, "tool", "h").agg(F.count("*").alias("c"), F.count_if(F.col("kind") == "error").alias("e"), F.count_if("changed").alias("w"))
    return each.groupBy(*by, "tool").agg(F.sum("c").alias("calls"), F.sum("e").alias("errors"), F.sum("w").alias("changing"), F.count("*").alias("answers"), (F.max("c") / F.sum("c")).alias("top_share"))


FEW_GROUPS = 100_000  # bounds of so many groups go to each executor; more are joined


def exact_quantiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float], accuracy: int = 10_000) -> DataFrame:
    """(by, n, one column a share): the percentiles of a numeric column, exact with linear interpolation, nulls left out.

    A mergeable sketch of bounded size gives two values of each group between which a percentile lies; a second pass
    counts what is smaller and, value by value, what lies between them: a few of `accuracy` parts of a group's rows."""
    names = list(shares)
    margins = (6 / accuracy, 0.01, 1.0)  # the first is wide enough from `accuracy` rows on, the next from 400, the last always
    edges = F.array(*(F.lit(min(1.0, max(0.0, q + d))) for q in shares.values() for m in margins for d in (-m, m)))
    x = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v"))
    bounds = settled(x.groupBy(*by).agg(F.count("*").alias("n"), F.percentile_approx("v", edges, F.lit(accuracy)).alias("edges")))
    width = F.when(F.col("n") >= accuracy, 0).when(F.col("n") >= 400, 2).otherwise(4)
    share = F.array(*(F.struct(F.lit(name).alias("share"), F.lit(q).alias("q"), F.get("edges", width + 6 * i).alias("low"), F.get("edges", width + 6 * i + 1).alias("high")) for i, (name, q) in enumerate(shares.items())))
    wanted = bounds.select(*by, "n", F.explode(share).alias("s")).select(*by, "n", "s.*")
    if bounds.count() <= FEW_GROUPS:
        wanted = F.broadcast(wanted)
    on = [x[c].eqNullSafe(wanted[c]) for c in by] or [F.lit(True)]
    near = x.join(wanted, on).where(x["v"] <= F.col("high")).select(*(wanted[c] for c in by), "share", "q", "n", F.when(F.col("v") >= F.col("low"), F.col("v")).alias("v"))
    counted = near.groupBy(*by, "share", "q", "n", "v").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*by, "share").orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, 0))
    place = F.col("q") * (F.col("n") - 1)
    at = lambda p: F.min(F.when(F.col("upto") > p, F.col("v")))
    both = counted.withColumn("upto", upto).where("v IS NOT NULL").groupBy(*by, "share", "q", "n").agg(at(F.floor(place)).alias("a"), at(F.ceil(place)).alias("b"))
    found = both.select(*by, "n", "share", (F.col("a") + (F.col("b") - F.col("a")) * (place - F.floor(place))).alias("x"))
    return found.groupBy(*by, "n").pivot("share", names).agg(F.first("x"))


def quantiles(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, median, 95th percentile and maximum; nulls are counted only."""
    whole = rows.groupBy(*by).agg(F.count("*").alias("n"), F.max(value).alias("most"))
    found = exact_quantiles(rows, by, value, {"median": 0.5, "p95": 0.95}).drop("n")
    return whole.join(found, [whole[c].eqNullSafe(found[c]) for c in by], "left").select(*(whole[c] for c in by), "n", "median", "p95", "most")


def data_class(answers: DataFrame, records: DataFrame) -> DataFrame:
    """answers (id, env, items ARRAY of canonical JSON), records (env, record): copy (every item is a record), empty or
    computed."""
    items = answers.select("id", "env", F.explode("items").alias("record"))
    known = records.select("env", "record").distinct().withColumn("_k", F.lit(True))
    found = items.join(known, ["env", "record"], "left").groupBy("id").agg(F.bool_and(F.col("_k").isNotNull()).alias("all_known"))
    return answers.select("id").join(found, "id", "left").select("id", F.when(F.col("all_known").isNull(), "empty").when(F.col("all_known"), "copy").otherwise("computed").alias("data_class"))


def outcome_taxonomy(turns: DataFrame, shown: DataFrame, construction: DataFrame) -> DataFrame:
    """turns (episode, turn, signature, changed), shown (source, signature), construction (signature): where each
    turn's wording could come from, the first that applies, and whether state was written before."""
    before = Window.partitionBy("episode").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    first = Window.partitionBy("episode", "signature").orderBy("turn")
    sources = shown.groupBy("signature").agg(F.bool_or(F.col("source") == "docstring").alias("doc"), F.bool_or(F.col("source") == "example").alias("example"))
    x = turns.withColumn("seen", F.row_number().over(first) > 1).withColumn("after_write", F.coalesce(F.max(F.col("changed").cast("int")).over(before), F.lit(0)) == 1)
    x = x.join(sources, "signature", "left").join(construction.select("signature", F.lit(True).alias("con")).distinct(), "signature", "left")
    origin = F.when(F.coalesce("doc", F.lit(False)), "docstring").when(F.coalesce("example", F.lit(False)), "example").when(F.col("seen"), "earlier in the episode").when(F.col("con"), "construction").otherwise("none")
    return x.select("episode", "turn", "signature", origin.alias("origin"), "after_write")


def branch_coverage(branches: DataFrame, errors: DataFrame) -> DataFrame:
    """branches (tool, branch, template as regex), errors (tool, source, text): per branch the sources that reach it.
    Texts are made distinct first; the regex join stays inside a tool."""
    texts = errors.select("tool", "source", "text").distinct()
    hit = branches.join(texts, "tool").where(F.rlike(F.col("text"), F.col("template"))).groupBy("tool", "branch").agg(F.sort_array(F.collect_set("source")).alias("sources"))
    return branches.select("tool", "branch").join(hit, ["tool", "branch"], "left").select("tool", "branch", F.coalesce("sources", F.array().cast("array<string>")).alias("sources"))


def know_nothing_predictors(calls: DataFrame) -> DataFrame:
    """calls (episode, turn, tool, call, answer): what a predictor without knowledge would say. repeat_last: the answer
    to the same call before in the episode; majority: the tool's most frequent answer outside the own episode (ties
    by text), as the tool's counts minus the episode's."""
    w = Window.partitionBy("episode", "call").orderBy("turn")
    x = calls.withColumn("repeat_last", F.lag("answer").over(w))
    total = calls.groupBy("tool", "answer").agg(F.count("*").alias("t"))
    own = calls.groupBy("episode", "tool", "answer").agg(F.count("*").alias("o"))
    # An episode changes only the counts of its own answers: the best of the others is the first in the tool's order
    # that the episode didn't give, and only its own answers need new counts.
    order = Window.partitionBy("tool").orderBy(F.desc("t"), "answer")
    ranked = total.withColumn("rank", F.row_number().over(order))
    mine = own.join(ranked, ["tool", "answer"])
    per = mine.groupBy("episode", "tool").agg(F.sort_array(F.collect_list("rank")).alias("ranks"), F.max(F.struct((F.col("t") - F.col("o")).alias("n"), (-F.col("rank")).alias("r"), "answer")).alias("best_own"))
    # The smallest rank that is not among the episode's own.
    gaps = F.filter(F.transform(F.sequence(F.lit(1), F.size("ranks")), lambda i: F.when(F.get(F.col("ranks"), i - 1) != i, i)), lambda i: i.isNotNull())
    free = F.coalesce(F.get(gaps, F.lit(0)), F.size("ranks") + 1)
    per = per.withColumn("rank", free).join(ranked.select("tool", "rank", F.col("answer").alias("other"), F.col("t").alias("other_n")), ["tool", "rank"], "left")
    own_n = F.col("best_own.n")
    pick = F.when((own_n > 0) & ((own_n > F.coalesce("other_n", F.lit(0))) | ((own_n == F.col("other_n")) & (F.col("best_own.answer") < F.col("other")))), F.col("best_own.answer")).otherwise(F.col("other"))
    return x.join(per.select("episode", "tool", pick.alias("majority")), ["episode", "tool"]).select("episode", "turn", "tool", "call", "answer", "repeat_last", "majority")


def constant_baselines(rows: DataFrame, constant: str) -> DataFrame:
    """Shares of rows that a constant answer and the recorded call's answer would get right."""
    return rows.agg(F.count("*").alias("n"), F.avg((F.col("answer") == constant).cast("int")).alias("constant"), F.avg(F.col("answer").eqNullSafe(F.col("recorded")).cast("int")).alias("recorded"))


def latest_tracking(rows: DataFrame, key: str, turn: str, counters: list[str]) -> DataFrame:
    """Sums of the counters of each trajectory's last row."""
    last = rows.groupBy(key).agg(F.max_by(F.struct(*counters), turn).alias("x"))
    return last.agg(F.count("*").alias("trajectories"), *(F.sum(f"x.{c}").alias(c) for c in counters))


def package_counts(artifacts: DataFrame) -> DataFrame:
    """Artefacts by package and kind, with those that are supported and those that have a template."""
    return artifacts.groupBy("package", "kind").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "supported").alias("supported"), F.count("template").alias("templated"))
