"""Which evidence of other episodes applies to an evaluated row."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from ..functions.text import normalize_page
from .overlap import screen_pairs


def episode_inventories(evidence: DataFrame) -> DataFrame:
    """evidence (episode, operands, fact_paths, listing_names) -> distinct (episode, name)."""
    return evidence.select("episode", F.explode(F.concat("operands", "fact_paths", "listing_names")).alias("name")).where(F.length("name") > 0).distinct()


def specific_names(inventory: DataFrame, tasks: DataFrame, most: int = 1) -> DataFrame:
    """Names that at most `most` tasks own: (name, tasks)."""
    return inventory.join(tasks, "episode").groupBy("name").agg(F.count_distinct("task").alias("tasks")).where(F.col("tasks") <= most)


def distinct_signals(names: Column) -> Column:
    """Names without those that are a component or the end of another."""
    return F.filter(names, lambda n: ~F.exists(names, lambda m: (m != n) & (m.endswith(F.concat(F.lit("/"), n)) | m.contains(F.concat(F.lit("/"), n, F.lit("/"))) | m.startswith(F.concat(n, F.lit("/"))))))


def applicability(rows: DataFrame, inventory: DataFrame, specific: DataFrame, conflicts: DataFrame | None = None) -> DataFrame:
    """rows (row_id, operands, files), inventory (episode, name): shared specific operands plus up to three shared
    files. Two signals, with an operand or two files and without a directory conflict, make an episode supporting; one
    makes it uncertain; episodes that share nothing are format only and have no row."""
    names = rows.select("row_id", F.explode(F.array_union("operands", "files")).alias("name"), F.col("operands").alias("_o"))
    known = inventory.join(specific.select("name"), "name", "left_semi")
    hit = names.join(known, "name").withColumn("op", F.array_contains("_o", F.col("name")))
    s = hit.groupBy("row_id", "episode").agg(F.count_if("op").alias("operands"), F.count_if(~F.col("op")).alias("files"))
    s = s.withColumn("signals", F.col("operands") + F.least("files", F.lit(3)))
    clash = F.lit(False)
    if conflicts is not None:
        s = s.join(conflicts.select("row_id", "episode", F.lit(True).alias("_c")).distinct(), ["row_id", "episode"], "left")
        clash = F.coalesce("_c", F.lit(False))
    strong = (F.col("signals") >= 2) & ((F.col("operands") >= 1) | (F.col("files") >= 2)) & ~clash
    label = F.when(strong, "supporting").otherwise("uncertain")
    return s.select("row_id", "episode", "operands", "files", "signals", label.alias("label"), F.when(strong, "shown").otherwise("sanitized").alias("disposition"))


def with_previous(turns: DataFrame, column: str, name: str) -> DataFrame:
    """The last non-null value of a column before each turn."""
    w = Window.partitionBy("episode").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn(name, F.last(column, ignorenulls=True).over(w))


def page_match(rows: DataFrame, evidence: DataFrame) -> DataFrame:
    """rows (row_id, page, target), evidence (evidence_id, before, after): evidence whose page before is the row's page,
    or whose page after is where the row goes."""
    r = rows.select("row_id", F.explode(F.array_compact(F.array(F.struct(F.lit("before").alias("side"), normalize_page(F.col("page")).alias("url")), F.struct(F.lit("after").alias("side"), normalize_page(F.col("target")).alias("url"))))).alias("x")).select("row_id", "x.*").where("url IS NOT NULL AND url <> ''")
    e = evidence.select("evidence_id", F.explode(F.array(F.struct(F.lit("before").alias("side"), normalize_page(F.col("before")).alias("url")), F.struct(F.lit("after").alias("side"), normalize_page(F.col("after")).alias("url")))).alias("x")).select("evidence_id", "x.*").where("url IS NOT NULL AND url <> ''")
    return r.join(e, ["side", "url"]).groupBy("row_id", "evidence_id").agg(F.array_sort(F.collect_set("side")).alias("sides"))


def screen_match(rows: DataFrame, evidence: DataFrame) -> DataFrame:
    """rows and evidence (id, state, app, items, opens): equal screens, or the same app opened."""
    return screen_pairs(rows, evidence, 0.8, ("state", "opens"))


#: Conventions that notes claim and transcripts show.
CONVENTIONS = {"continuation": r"(?m)^> ", "command not found": r"command not found", "long listing": r"(?m)^[dl-][rwx-]{9}"}


def note_check(notes: DataFrame, transcripts: DataFrame) -> DataFrame:
    """notes (note_id, claims ARRAY, negated), transcripts (episode, text, tested ARRAY of conventions it could show):
    consistent, contradicted or untested per note and episode. Conventions are looked up once per transcript."""
    shows = F.array_compact(F.array(*(F.when(F.col("text").rlike(p), F.lit(n)) for n, p in CONVENTIONS.items())))
    t = transcripts.select("episode", shows.alias("shows"), "tested")
    x = notes.select("note_id", F.explode("claims").alias("claim"), "negated")
    each = t.select("episode", "shows", F.explode("tested").alias("claim")).join(x, "claim")
    seen = F.array_contains("shows", F.col("claim"))
    return each.groupBy("note_id", "episode").agg(F.bool_or(seen == F.col("negated")).alias("_bad")).select("note_id", "episode", F.when(F.col("_bad"), "contradicted").otherwise("consistent").alias("status"))


def gate_summary(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("label", "disposition").agg(F.count("*").alias("n"), F.count_distinct("row_id").alias("n_rows"), F.sum(F.coalesce("masked", F.lit(0))).alias("masked"), F.count_if("page").alias("pages"), F.count_if("screen").alias("screens"))


def documented_format(system: Column, action: Column) -> Column:
    """Does the prompt show this action and, within 4000 characters, an observation?"""
    at = F.instr(system, action)
    return (at > 0) & F.substr(system, at, F.length(action) + 4000).rlike(r"(?i)observation|output|returns")


def verify_anchors(verdicts: DataFrame, transcripts: DataFrame, specific: DataFrame) -> DataFrame:
    """verdicts (row_id, item_id, episode, label, rule_label, anchors): a supporting verdict stands if one anchor occurs
    in the episode's transcript and is specific; else the rule's label stands, and a contradicted one stays."""
    a = verdicts.select("row_id", "item_id", "episode", F.explode("anchors").alias("name")).join(specific.select("name"), "name", "left_semi")
    good = a.join(transcripts.select("episode", "text"), "episode").where(F.col("text").contains(F.col("name"))).select("row_id", "item_id").distinct().withColumn("_ok", F.lit(True))
    x = verdicts.join(good, ["row_id", "item_id"], "left")
    return x.select("row_id", "item_id", F.when((F.col("label") == "supporting") & F.col("_ok").isNull(), F.col("rule_label")).otherwise(F.coalesce("label", "rule_label")).alias("label"), F.coalesce("_ok", F.lit(False)).alias("anchored"))
