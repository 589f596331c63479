"""Dedup, identity, splits and sampling of trajectories and rows. Every order is total and every seed explicit."""

from __future__ import annotations

import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window


def dedup_episodes(events: DataFrame, group: str | None = None) -> DataFrame:
    """(episode_id, duplicate_of, kept): episodes with the same ordered (actor, kind, content) of one group; the smallest
    id stays. Signatures are hashes, so an episode's text is not shuffled again."""
    line = F.sha2(F.to_json(F.struct("actor", "kind", "content")), 256)
    keys = ["episode_id"] + ([group] if group else [])
    signed = events.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", line.alias("h")))), lambda x: x["h"]), ""), 256).alias("signature"))
    first = signed.groupBy("signature", *keys[1:]).agg(F.min("episode_id").alias("duplicate_of"))
    return signed.join(first, ["signature", *keys[1:]]).select("episode_id", "duplicate_of", (F.col("episode_id") == F.col("duplicate_of")).alias("kept"))


def longest_records(rows: DataFrame, keys: list[str], turn: str, order: list[str]) -> DataFrame:
    """The row with the largest turn of each key, the first of equal ones."""
    w = Window.partitionBy(*keys).orderBy(F.desc(turn), *order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def cluster_prefix_trajectories(rows: DataFrame) -> DataFrame:
    """rows (task, id, order, prompt, response, ...) -> (task, id, order, cluster_id). Rows of one id whose prompts and
    responses are prefixes of each other form a trajectory; the last prompt may itself be a text prefix either way.
    Clusters are numbered by their earliest row: id, id~2, id~3. Only hashes of texts are compared, but for the last."""

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("order")
        clusters: list[tuple[list, list, str]] = []
        out = []
        for p, r, last in zip(pdf["prompts"], pdf["responses"], pdf["last"], strict=True):
            p, r = list(p), list(r)
            for i, (q, s, tail) in enumerate(clusters):
                short, long = ((p, r, last), (q, s, tail)) if len(p) <= len(q) else ((q, s, tail), (p, r, last))
                n, m = len(short[0]), len(short[1])
                same = long[0][: n - 1] == short[0][:-1] and long[1][:m] == short[1] if n else True
                if same and (n == 0 or n < len(long[0]) and long[0][n - 1] == short[0][-1] or n == len(long[0]) and (long[2].startswith(short[2]) or short[2].startswith(long[2]))):
                    out.append(i)
                    if len(p) >= len(q):
                        clusters[i] = (p, r, last)
                    break
            else:
                out.append(len(clusters))
                clusters.append((p, r, last))
        ids = [x if c == 0 else f"{x}~{c + 1}" for x, c in zip(pdf["id"], out, strict=True)]
        return pd.DataFrame({"task": pdf["task"], "id": pdf["id"], "order": pdf["order"], "cluster_id": ids})

    slim = rows.select("task", F.col("id").cast("string").alias("id"), F.col("order").cast("long").alias("order"), F.transform("prompt", lambda x: F.sha2(x, 256)).alias("prompts"), F.transform("response", lambda x: F.sha2(x, 256)).alias("responses"), F.coalesce(F.element_at("prompt", -1), F.lit("")).alias("last"))
    return slim.groupBy("task", "id").applyInPandas(cluster, "task string, id string, order long, cluster_id string")


def split_bucket(key: Column) -> Column:
    """0..99 from the first 32 bits of sha256 of the key's text."""
    return (F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("long") % 100).cast("int")


def stable_split(key: Column) -> Column:
    """train / validation / test as 80 / 10 / 10, by key alone."""
    b = split_bucket(key)
    return F.when(b < 80, "train").when(b < 90, "validation").otherwise("test")


def split_rows(rows: DataFrame, key: str, split: str) -> DataFrame:
    return rows.where(stable_split(F.col(key)) == split)


def check_group_splits(splits: DataFrame) -> DataFrame:
    """Errors of (source_id, split, trajectory_group): groups and sources in more than one split."""
    kinds = [splits.groupBy(F.col(c).cast("string").alias("key")).agg(F.sort_array(F.collect_set("split")).alias("splits")).where(F.size("splits") > 1).select(F.lit(c).alias("kind"), "key", "splits") for c in ("trajectory_group", "source_id")]
    return kinds[0].unionByName(kinds[1])


def task_groups(trajectories: DataFrame) -> DataFrame:
    """trajectories (.., task_hash, first_screen, trajectory) with `group`: what may not be parted over folds. It is the
    task's hash, else the first screen's, else the trajectory itself."""
    named = lambda kind, c: F.when(F.length(c) > 0, F.concat(F.lit(f"{kind}:"), F.sha2(F.col(c).cast("string"), 256)))
    return trajectories.withColumn("group", F.coalesce(named("task", "task_hash"), named("screen", "first_screen"), F.concat(F.lit("own:"), F.col("trajectory").cast("string"))))


def assign_folds(trajectories: DataFrame, k: int, seed: int = 0, spread: list[str] | None = None) -> DataFrame:
    """trajectories (group, style, turns) -> (style, group, fold). Groups stay whole; inside a style, groups in order of
    size (turns, then a seeded hash) are dealt there and back over the folds, so sizes balance without a driver loop.
    spread: columns such as a sub-source and an app whose values are dealt one after another, so that each value's
    groups lie evenly over the folds; a group has the value that most of its trajectories have."""
    spread = spread or []
    most = [F.mode(c, True).alias(c) for c in spread]
    groups = trajectories.groupBy("style", "group").agg(F.sum("turns").alias("turns"), F.count("*").alias("n"), *most)
    w = Window.partitionBy("style").orderBy(*spread, F.desc("turns"), F.xxhash64(F.col("group").cast("string"), F.lit(seed)), "group")
    r = F.row_number().over(w) - 1
    lap = F.floor(r / k)
    return groups.withColumn("fold", F.when(lap % 2 == 0, r % k).otherwise(k - 1 - r % k).cast("int")).select("style", "group", "turns", "n", "fold", *spread)


def cross_fit_corpora(folds: DataFrame, k: int) -> DataFrame:
    """(style, fold, n_groups, turns): what lies outside each fold of a style, as totals minus the fold's own."""
    own = folds.groupBy("style", "fold").agg(F.count("*").alias("n"), F.sum("turns").alias("t"))
    total = folds.groupBy("style").agg(F.count("*").alias("all_n"), F.sum("turns").alias("all_t"))
    all_folds = total.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return all_folds.join(own, ["style", "fold"], "left").select("style", "fold", (F.col("all_n") - F.coalesce("n", F.lit(0))).alias("n_groups"), (F.col("all_t") - F.coalesce("t", F.lit(0))).alias("turns"))


def cross_fit_members(folds: DataFrame, k: int) -> DataFrame:
    """(style, fold, group) for every group outside a fold of its style: k - 1 rows a group."""
    return folds.withColumn("outside", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).where(F.col("outside") != F.col("fold")).select("style", F.col("outside").alias("fold"), "group")


def check_cross_fit(predictions: DataFrame, folds: DataFrame) -> DataFrame:
    """predictions (row_id, group, hits ARRAY of groups) -> violations (row_id, hit, error)."""
    f = folds.select(F.col("group"), "style", "fold")
    hits = predictions.join(f, "group").select("row_id", "group", "style", "fold", F.explode("hits").alias("hit"))
    other = f.select(F.col("group").alias("hit"), F.col("style").alias("hit_style"), F.col("fold").alias("hit_fold"))
    x = hits.join(other, "hit", "left")
    error = F.when(F.col("hit") == F.col("group"), "own row").when(F.col("hit_style").isNull(), "unknown").when(F.col("hit_style") != F.col("style"), "other style").when(F.col("hit_fold") == F.col("fold"), "same fold")
    return x.withColumn("error", error).where("error IS NOT NULL").select("row_id", "hit", "error")


def unique_turns(turns: DataFrame, with_answer: bool = False) -> DataFrame:
    """turns (env, episode, turn, tool, call, answer, artifact) with a reason per row; `kept` rows have none. In order:
    loader artifacts, all but the last occurrence of a call (or of call and answer) in the episode, then one row per
    (call, answer) in the environment, then one per (tool, answer). Texts are compared by hash."""
    h = turns.withColumn("_c", F.sha2("call", 256)).withColumn("_a", F.sha2(F.coalesce("answer", F.lit("")), 256))
    art = F.coalesce("artifact", F.lit(False))
    keys = ["env", "episode", "_c"] + (["_a"] if with_answer else [])

    def rank(*by):
        return F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("turn"), F.desc("episode")))

    x = h.withColumn("reason", F.when(art, "artifact"))
    for keys_, name in ((keys, "repeated in episode"), (["env", "_c", "_a"], "same call and answer"), (["env", "tool", "_a"], "same tool and answer")):
        free = F.when(F.col("reason").isNull(), 1)
        x = x.withColumn("_f", free).withColumn("_r", rank("_f", *keys_)).withColumn("reason", F.when(F.col("_f").isNotNull() & (F.col("_r") > 1), name).otherwise(F.col("reason")))
    return x.withColumn("kept", F.col("reason").isNull()).drop("_c", "_a", "_f", "_r")


def evenly_spaced_turns(episodes: DataFrame, n: int) -> DataFrame:
    """episodes (episode, total) -> (episode, turn): max(1, round(i * total / n)), half to even, distinct."""
    i = F.explode(F.sequence(F.lit(1), F.lit(n)))
    return episodes.withColumn("i", i).select("episode", F.greatest(F.lit(1), F.bround(F.col("i") * F.col("total") / F.lit(n), 0).cast("int")).alias("turn")).distinct()


def seeded_rank(keys: list[str], seed: int, *by: str) -> Column:
    """Rank inside `by` by a seeded hash of the keys."""
    text = F.concat_ws("|", *(F.col(k).cast("string") for k in keys), F.lit(str(seed)))
    return F.row_number().over(Window.partitionBy(*by).orderBy(F.sha2(text, 256), *keys))


def stratified_sample(rows: DataFrame, keys: list[str], stratum: str, n: int, seed: int, exclude: DataFrame | None = None) -> DataFrame:
    """n rows in proportion to the strata (rounded half to even), seeded; `exclude` holds keys that may not be drawn."""
    pool = rows.join(exclude, exclude.columns, "left_anti") if exclude is not None else rows
    counts = pool.groupBy(stratum).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_t"))
    quota = counts.join(F.broadcast(total)).select(stratum, F.bround(F.col("_n") * n / F.col("_t"), 0).alias("_q"))  # one row of total
    return pool.withColumn("_r", seeded_rank(keys, seed, stratum)).join(quota, stratum).where("_r <= _q").drop("_r", "_q")


def quota_sample(pool: DataFrame, quotas: DataFrame, seed: int, exclude: DataFrame | None = None) -> DataFrame:
    """pool (service, family, task, run, solved); quotas (service, quota). One run per task (solved first, then the lowest
    run), then a seeded choice of tasks per service; `single_family` marks tasks that are alone in their family."""
    pool = pool.join(exclude, exclude.columns, "left_anti") if exclude is not None else pool
    one = pool.withColumn("_r", F.row_number().over(Window.partitionBy("service", "task").orderBy(F.desc("solved"), "run"))).where("_r = 1").drop("_r")
    one = one.withColumn("single_family", F.count("*").over(Window.partitionBy("service", "family")) == 1)
    return one.withColumn("_r", seeded_rank(["task"], seed, "service")).join(quotas, "service").where("_r <= quota").drop("_r", "quota")


def nested_prefix_sets(tasks: DataFrame, sizes: list[int], seed: int) -> DataFrame:
    """tasks (task, turns) -> (size, task, rank, cumulative_turns): sets of a seeded order, each holding the smaller ones.
    Only the largest size is ranked in full."""
    order = F.sha2(F.concat_ws("|", F.col("task").cast("string"), F.lit(str(seed))), 256)
    top = tasks.select("task", "turns", order.alias("_h")).orderBy("_h", "task").limit(max(sizes))
    w = Window.orderBy("_h", "task")
    ranked = top.withColumn("rank", F.row_number().over(w)).withColumn("cumulative_turns", F.sum("turns").over(w))
    return ranked.withColumn("size", F.explode(F.array(*(F.lit(s) for s in sizes)))).where("rank <= size").select("size", "task", "rank", "cumulative_turns")


def select_rows_by_action(rows: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose action is asked for, and the actions that have no row."""
    return rows.join(actions, "action", "left_semi"), actions.join(rows, "action", "left_anti")


def curated_join(inputs: DataFrame, targets: DataFrame, rows: DataFrame) -> DataFrame:
    """By (task, turn): which of action, history length, history and target differ. One row per input, `errors` empty
    when all agree."""
    k = ["task", "turn"]
    i = inputs.select(*k, F.col("action").alias("i_action"), F.col("history").alias("i_history"))
    t = targets.select(*k, F.col("target").alias("t_target"))
    r = rows.select(*k, F.col("action").alias("r_action"), F.col("history").alias("r_history"), F.col("target").alias("r_target"))
    x = i.join(t, k, "left").join(r, k, "left")
    differ = F.exists(F.arrays_zip("i_history", "r_history"), lambda z: ~z["i_history"].eqNullSafe(z["r_history"]))
    checks = [("no row", F.col("r_action").isNull()), ("action", F.col("i_action") != F.col("r_action")), ("history length", F.size("i_history") != F.size("r_history")), ("history", (F.size("i_history") == F.size("r_history")) & differ), ("target", ~F.col("t_target").eqNullSafe(F.col("r_target")))]
    return x.select(*k, F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in checks))).alias("errors"))


def merge_slices(parts: list[DataFrame], expected: DataFrame, retry: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Parts (id, success, error, settings) put together, retried rows replacing their originals; and a report row:
    n, duplicates, missing, extra, successes, errors, settings."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    if retry is not None:
        names = [c for c in rows.columns if c != "id"]
        again = retry.select("id", *(F.col(c).alias(f"_{c}") for c in names), F.lit(True).alias("_again"))
        rows = rows.join(again, "id", "left").select("id", *(F.when(F.col("_again"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in names))
    per_id = rows.groupBy("id").agg(F.count("*").alias("n"))
    cover = per_id.join(expected.select("id", F.lit(1).alias("wanted")), "id", "full")
    a = cover.agg(F.count_if(F.col("n") > 1).alias("duplicates"), F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("wanted").isNull()).alias("extra"))
    b = rows.agg(F.count("*").alias("n"), F.count_if("success").alias("successes"), F.count("error").alias("errors"), F.count_distinct("settings").alias("settings"))
    return rows, b.join(F.broadcast(a))  # one row each


def few_shot_examples(calls: DataFrame, definitions: DataFrame, limit: int) -> DataFrame:
    """calls (tool, order, split, call, answer) of train episodes: the first of each tool, in the definitions' order
    (tool, position), and of these `limit` evenly spaced ones."""
    first = calls.where("split = 'train'").groupBy("tool").agg(F.min_by(F.struct("call", "answer", "order"), "order").alias("x"))
    ordered = first.join(definitions, "tool").select("tool", "position", "x.*")
    n = ordered.agg(F.count("*").alias("_n"))
    i = F.row_number().over(Window.orderBy("position", "tool")) - 1  # a row per tool
    x = ordered.withColumn("_i", i).join(F.broadcast(n))
    slot = lambda c: F.floor(c * limit / F.col("_n"))
    return x.where((F.col("_n") <= limit) | (F.col("_i") == 0) | (slot(F.col("_i")) != slot(F.col("_i") - 1))).drop("_i", "_n")


def package_tiers(artifacts: DataFrame, keep: list[str]) -> DataFrame:
    """Artifacts (kind, id, provenance, rule_ids) of some kinds, without provenance and without ids of rules left out."""
    kept = artifacts.where(F.col("kind").isin(keep))
    rules = kept.where("kind = 'rule'").select(F.col("id").alias("r"))
    links = kept.select("kind", "id", F.explode("rule_ids").alias("r")).join(rules, "r", "left_semi").groupBy("kind", "id").agg(F.sort_array(F.collect_list("r")).alias("rule_ids"))
    none = F.array().cast("array<string>")
    return kept.drop("rule_ids").join(links, ["kind", "id"], "left").withColumn("rule_ids", F.coalesce("rule_ids", none)).withColumn("provenance", none)


def eligible_trials(trials: DataFrame, strong: DataFrame) -> DataFrame:
    """Finished trials without exception and with reward 1, one per task (the lowest trial), of tasks without strong
    overlap with the benchmark."""
    good = trials.where("finished AND exception IS NULL AND reward = 1").join(strong, "task", "left_anti")
    return good.withColumn("_r", F.row_number().over(Window.partitionBy("task").orderBy("trial"))).where("_r = 1").drop("_r")
