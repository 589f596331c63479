"""Overlap and leakage audits between construction and evaluation data: inverted-index joins on rare keys, never a
product of trajectories."""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from . import blocks
from ..functions.lineage import settled

RARE_TOKEN = r"[A-Za-z][\w.\-]{5,}"


def rare_tokens(docs: DataFrame, id_col: str, text_col: str, max_df: int, pattern: str = RARE_TOKEN) -> DataFrame:
    """(id, token) for tokens in max_df rows at most."""
    tokens = docs.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(F.regexp_extract_all(text_col, F.lit(pattern), F.lit(0)))).alias("token")).distinct()
    rare = tokens.groupBy("token").agg(F.count("*").alias("df")).where(F.col("df") <= max_df)
    return tokens.join(rare, "token").select("id", "token")


def shared_tokens(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id, token) of equal tokens. Both sides' document frequencies are bounded, so postings are short."""
    return left.select(F.col("id").alias("left_id"), "token").join(right.select(F.col("id").alias("right_id"), "token"), "token")


def rare_token_overlap(left: DataFrame, right: DataFrame, max_left: int = 2, max_right: int = 3, top: int = 2, id_left: str = "id", id_right: str = "id", text: str = "text") -> DataFrame:
    """The `top` matches of each left row by shared rare tokens: left_id, right_id, n_shared, n_files, files (5), rank."""
    pairs = shared_tokens(rare_tokens(left, id_left, text, max_left), rare_tokens(right, id_right, text, max_right))
    is_file = F.col("token").rlike(r"\.[A-Za-z0-9]{1,4}$")
    scored = pairs.groupBy("left_id", "right_id").agg(F.count("*").alias("n_shared"), F.count_if(is_file).alias("n_files"), F.slice(F.sort_array(F.collect_list(F.when(is_file, F.col("token")))), 1, 5).alias("files"))
    w = Window.partitionBy("left_id").orderBy(F.desc("n_shared"), "right_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def idf_match(queries: DataFrame, corpus: DataFrame, max_df: int = 6, pattern: str = RARE_TOKEN, strong: float = 30.0) -> DataFrame:
    """Best and second corpus row of each query by the sum of ln(N / df) over shared tokens with df <= max_df."""
    n = corpus.agg(F.count("*").alias("_n"))
    tokens = corpus.select(F.col("id").alias("corpus_id"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))).alias("token"))
    df = tokens.groupBy("token").agg(F.count("*").alias("df")).where(F.col("df") <= max_df).join(F.broadcast(n)).select("token", F.log(F.col("_n") / F.col("df")).alias("idf"))
    asked = queries.select(F.col("id").alias("query_id"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))).alias("token"))
    scored = asked.join(df, "token").join(tokens, "token").groupBy("query_id", "corpus_id").agg(F.sum("idf").alias("score"), F.count("*").alias("n_shared"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "corpus_id")
    return scored.withColumn("rank", F.row_number().over(w)).where("rank <= 2").withColumn("strong", F.col("score") >= strong)


def excluded_matches(matches: DataFrame, confirmed: DataFrame | None = None) -> DataFrame:
    """Corpus ids that a query may not learn from: its best match where strong or confirmed, both where it is weak."""
    best = matches.where("rank = 1").select("query_id", F.col("strong").alias("sure"))
    if confirmed is not None:
        best = best.join(confirmed.select("query_id", F.lit(True).alias("_c")).distinct(), "query_id", "left").select("query_id", (F.col("sure") | F.coalesce("_c", F.lit(False))).alias("sure"))
    return matches.join(best, "query_id").where((F.col("rank") == 1) | ~F.col("sure")).select("query_id", "corpus_id").distinct()


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays taken as sets; 0 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


#: Items are counted in so many groups of equal hashes modulo that. One array of counts goes to all tasks.
GROUPS = 1 << 20


def _first_items(sets: DataFrame, key: str, least: float) -> DataFrame:
    """sets (side, id, key, h) -> (side, id, key, item, n, r): the items of each row, in the order from rare to frequent,
    that a set of Jaccard `least` or more must share one of; without those that only one row has. How frequent an item is
    is what its group counts: never less than its rows, and the same for all rows, so that any order by it is right."""
    group = F.pmod("item", F.lit(GROUPS))
    counted = sets.select(F.explode("h").alias("item")).groupBy(group.cast("int").alias("g")).agg(F.least(F.count("*"), F.lit(2**31 - 1)).cast("int").alias("n")).toArrow()
    frequent = np.zeros(GROUPS, np.int32)
    frequent[counted["g"].to_numpy()] = counted["n"].to_numpy()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            h = x.column("h")
            row, item = pc.list_parent_indices(h).to_numpy(zero_copy_only=False).astype(np.int64), h.flatten().to_numpy(zero_copy_only=False)
            n = np.bincount(row, minlength=len(x))
            df = frequent[item % len(frequent)]
            by = np.lexsort((item, df, row))
            row, item, df = row[by], item[by], df[by]
            r = np.arange(len(row)) - (np.cumsum(n) - n)[row] + 1
            keep = (r <= n[row] - np.ceil(n * least)[row] + 1) & (df > 1)
            rest = [x.column(c).take(pa.array(row[keep])) for c in ("side", "id", key)]
            yield from pa.table([*rest, item[keep], n[row[keep]].astype(np.int32), r[keep].astype(np.int32)], names=["side", "id", key, "item", "n", "r"]).combine_chunks().to_batches()

    return sets.mapInArrow(first, f"side int, id {_kind(sets, 'id')}, {key} {_kind(sets, key)}, item bigint, n int, r int")


def set_jaccard_pairs(left: DataFrame, right: DataFrame, key: str, least: float, apart: tuple[str, ...] = ()) -> DataFrame:
    """left and right (id, key, items): pairs of one key with Jaccard >= least (> 0). Items are read from rare to frequent,
    by hash; two sets that reach it share one of the first (1 - least) n + 1 items of each, and only these are shuffled. A
    pair is made only if the sizes, and what is left behind the shared item, allow it, and confirmed on the items
    themselves. The same DataFrame on both sides is ordered once. apart: columns of which a pair has no equal value."""
    hashed = lambda df, side: df.select(F.lit(side).alias("side"), "id", key, F.array_distinct(F.transform("items", lambda i: F.xxhash64(i))).alias("h")).where(F.size("h") > 0)
    alone = left is right
    first = settled(_first_items(hashed(left, 0) if alone else hashed(left, 0).unionByName(hashed(right, 1)), key, least))
    a = first.where("side = 0").select(key, "item", F.col("id").alias("left_id"), F.col("n").alias("na"), F.col("r").alias("ra"))
    b = first.where(F.col("side") == (0 if alone else 1)).select(key, "item", F.col("id").alias("right_id"), F.col("n").alias("nb"), F.col("r").alias("rb"))
    possible = 1 + F.least(F.col("na") - F.col("ra"), F.col("nb") - F.col("rb"))
    wanted = (F.col("na") + F.col("nb")) * (least / (1 + least)) - 1e-9
    met = a.join(b, [key, "item"]).where((F.col("na") >= F.col("nb") * least - 1e-9) & (F.col("nb") >= F.col("na") * least - 1e-9)).withColumn("possible", possible)
    met = met.where("left_id < right_id") if alone else met
    # what is shared besides lies behind the first items of the set whose first items end earlier
    behind = F.greatest(*(F.ceil(F.col(n) * least) - 1 for n in ("na", "nb")))
    pairs = met.groupBy(key, "left_id", "right_id", "na", "nb").agg(F.count("*").alias("met"), F.max("possible").alias("possible")).where((F.col("possible") >= wanted) & (F.col("met") + behind >= wanted)).select(key, "left_id", "right_id")
    sets = lambda df, side, c: df.select(F.col("id").alias(f"{side}_id"), key, F.col("items").alias(c), *(F.col(x).alias(f"{side}_{x}") for x in apart))
    found = pairs.join(sets(left, "left", "a"), ["left_id", key]).join(sets(right, "right", "b"), ["right_id", key]).where(_unequal(apart))
    found = found.withColumn("jaccard", jaccard(F.col("a"), F.col("b"))).where(F.col("jaccard") >= least).select(key, "left_id", "right_id", "jaccard")
    if not alone:
        return found
    both = F.explode(F.array(F.struct("left_id", "right_id"), F.struct(F.col("right_id").alias("left_id"), F.col("left_id").alias("right_id"))))
    own = left.where((F.size("items") > 0) & F.col("id").isNotNull() & F.col(key).isNotNull())
    for c in apart:
        own = own.where(F.col(c).isNull())
    return found.select(key, both.alias("p"), "jaccard").select(key, "p.*", "jaccard").unionByName(own.select(key, F.col("id").alias("left_id"), F.col("id").alias("right_id"), F.lit(1.0).alias("jaccard")))


OVERLAP_MEASURES = ("instruction", "records", "calls")
_SETS = dict(zip(OVERLAP_MEASURES, ("tokens", "records", "calls"), strict=True))
TOP_OF_CLASS = 8


def _task_items(bench: DataFrame, reserve: DataFrame) -> DataFrame:
    """(env, measure, item, side, task, n, r): the items of each task's sets, by hash, and their place r (from 1) in the
    order from rare to frequent in which all sets of an environment are read."""
    def side(df: DataFrame, name: str) -> DataFrame:
        sets = F.array(*(F.struct(F.lit(m).alias("measure"), F.array_distinct(F.transform(c, lambda x: F.xxhash64(x))).alias("items")) for m, c in _SETS.items()))
        each = df.select("env", "task", F.explode(sets).alias("s")).select("env", "task", "s.*")
        return each.select("env", "measure", F.lit(name).alias("side"), "task", F.size("items").alias("n"), F.explode("items").alias("item"))

    items = settled(side(bench, "bench").unionByName(side(reserve, "reserve")))
    df = items.groupBy("env", "measure", "item").agg(F.count("*").alias("df"))
    w = Window.partitionBy("env", "measure", "side", "task").orderBy("df", "item")
    return settled(items.join(df, ["env", "measure", "item"]).withColumn("r", F.row_number().over(w)).drop("df"))


def _reaching(items: DataFrame, least: float, open_: DataFrame | None = None) -> DataFrame:
    """(env, bench_task, reserve_task): pairs that may have a measure of `least` or more, of the (env, measure, task) in
    open_ only. They share an item among the first of each set (of calls, of which only the benchmark's count, among the
    first of the benchmark's), sets whose sizes differ too much can't reach it, nor can those of which too little is left
    behind the first shared item."""
    first = F.col("n") - F.ceil(F.col("n") * least) + 1
    left = items.where(F.col("side") == "bench")
    if open_ is not None:
        left = left.join(open_, ["env", "measure", "task"], "left_semi")
    a = left.where(F.col("r") <= first).select("env", "measure", "item", F.col("task").alias("bench_task"), F.col("n").alias("na"), F.col("r").alias("ra"))
    b = items.where((F.col("side") == "reserve") & ((F.col("measure") == "calls") | (F.col("r") <= first))).select("env", "measure", "item", F.col("task").alias("reserve_task"), F.col("n").alias("nb"), F.col("r").alias("rb"))
    share = F.when(F.col("measure") == "calls", F.col("na") * least).otherwise((F.col("na") + F.col("nb")) * (least / (1 + least)))
    possible = 1 + F.least(F.col("na") - F.col("ra"), F.col("nb") - F.col("rb"))
    return a.join(b, ["env", "measure", "item"]).where(possible >= share - 1e-9).select("env", "bench_task", "reserve_task").distinct()


def _measured(pairs: DataFrame, bench: DataFrame, reserve: DataFrame) -> DataFrame:
    """pairs with their exact measures, same_sequence and same_database."""
    side = lambda df, name, p: df.select("env", F.col("task").alias(name), *(F.col(c).alias(f"{p}_{c}") for c in ("tokens", "records", "calls", "sequence", "database")))
    x = pairs.join(side(bench, "bench_task", "b"), ["env", "bench_task"]).join(side(reserve, "reserve_task", "r"), ["env", "reserve_task"])
    return x.select(
        "env", "bench_task", "reserve_task", jaccard(F.col("b_tokens"), F.col("r_tokens")).alias("instruction"), jaccard(F.col("b_records"), F.col("r_records")).alias("records"),
        F.when(F.size("b_calls") > 0, F.size(F.array_intersect("b_calls", "r_calls")) / F.size(F.array_distinct("b_calls"))).otherwise(0.0).alias("calls"),
        F.coalesce(F.col("b_sequence") == F.col("r_sequence"), F.lit(False)).alias("same_sequence"), F.coalesce(F.col("b_database") == F.col("r_database"), F.lit(False)).alias("same_database"),
    )


#: An environment is crowded if its sets share so many items that one of so many pairs or more would come up as a candidate, as
#: often as it shares one. Pairs of blocks are cheaper there.
CROWDED = 64


def _crowded(bench: DataFrame, reserve: DataFrame, least: float, equal: bool = False) -> DataFrame:
    """(env): where candidates that may reach `least` (equal: or have the sequence or the database in common) would be
    many for the number of pairs. Items are counted by how many sets have them, in powers of two, from rare ones on up to
    the share of all items that _reaching looks at. This picks a plan; no result depends on it."""
    def side(df: DataFrame, own: int) -> DataFrame:
        sets = [F.struct(F.lit(m).alias("measure"), F.array_distinct(F.transform(c, lambda x: F.xxhash64(x))).alias("items")) for m, c in _SETS.items()]
        sets += [F.struct(F.lit(c).alias("measure"), F.array_compact(F.array(F.when(F.col(c).isNotNull(), F.xxhash64(c)))).alias("items")) for c in ("sequence", "database") if equal]
        each = df.select("env", F.explode(F.array(*sets)).alias("s")).select("env", "s.measure", F.explode("s.items").alias("item"))
        return each.withColumn("b", F.lit(1 - own)).withColumn("r", F.lit(own))

    count = lambda df, name: df.groupBy("env").agg(F.count("*").cast("double").alias(name))
    df = side(bench, 0).unionByName(side(reserve, 1)).groupBy("env", "measure", "item").agg(F.sum("b").cast("double").alias("b"), F.sum("r").cast("double").alias("r"))
    held = df.groupBy("env", "measure", F.floor(F.log2(F.col("b") + F.col("r"))).alias("size")).agg(F.sum(F.col("b") + F.col("r")).alias("items"), F.sum(F.col("b") * F.col("r")).alias("pairs"))
    w = Window.partitionBy("env", "measure")
    rarer = F.coalesce(F.sum("items").over(w.orderBy("size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    first = held.withColumn("rarer", rarer).withColumn("all", F.sum("items").over(w)).where(F.col("rarer") <= F.col("all") * (1 - least))
    pairs = first.groupBy("env").agg(F.sum("pairs").alias("pairs")).join(count(bench, "b"), "env").join(count(reserve, "r"), "env")
    return settled(pairs.where(F.col("pairs") * CROWDED >= F.col("b") * F.col("r")).select("env"))


def _sides(bench: DataFrame, reserve: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with their columns only, made once; a set that is null has no items."""
    own = lambda df: settled(df.select("env", "task", *(F.coalesce(c, F.array().cast(df.schema[c].dataType)).alias(c) for c in _SETS.values()), "sequence", "database"))
    return own(bench), own(reserve)


def _tiles(a: pa.Table, b: pa.Table) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """For some rows of a at a time, from which on, and their measures with all rows of b, same_sequence, same_database."""
    counts = {m: blocks.shared(a[c], b[c]) for m, c in _SETS.items()}
    equal = {f"same_{c}": blocks.codes(a[c], b[c]) for c in ("sequence", "database")}
    step = max(1, blocks.TILE // max(1, len(b)))
    for at in range(0, len(a), step):
        some = slice(at, at + step)
        out = {}
        for m, (na, nb, both) in counts.items():
            both = both[some].astype(np.float64)
            of = np.broadcast_to(na[some, None], both.shape) if m == "calls" else na[some, None] + nb[None, :] - both
            out[m] = np.divide(both, of, out=np.zeros_like(both), where=of > 0)
        yield at, out | {c: x[some, None] == y[None, :] for c, (x, y) in equal.items()}


def _kind(df: DataFrame, c: str) -> str:
    return df.schema[c].dataType.simpleString()


def _block_pairs(bench: DataFrame, reserve: DataFrame, least: float | None) -> DataFrame:
    """As _measured, of all pairs of an environment that have a measure of `least`, or, without it, share anything."""
    def found(a: pa.Table, b: pa.Table) -> Iterator[pa.RecordBatch]:
        for at, x in _tiles(a, b):
            most = np.maximum.reduce([x[m] for m in OVERLAP_MEASURES])
            i, j = np.nonzero((most > 0) | x["same_sequence"] | x["same_database"] if least is None else most >= least)
            if len(i):
                keys = [a["env"].take(i + at), a["task"].take(i + at), b["task"].take(j)]
                t = pa.table([*keys, *(x[c][i, j] for c in (*OVERLAP_MEASURES, "same_sequence", "same_database"))], names=names)
                yield from t.combine_chunks().to_batches()

    names = ["env", "bench_task", "reserve_task", *OVERLAP_MEASURES, "same_sequence", "same_database"]
    schema = f"env {_kind(bench, 'env')}, bench_task {_kind(bench, 'task')}, reserve_task {_kind(reserve, 'task')}, " + ", ".join(f"{m} double" for m in OVERLAP_MEASURES) + ", same_sequence boolean, same_database boolean"
    return _in_cells(bench, reserve, found, schema)


def _in_cells(bench: DataFrame, reserve: DataFrame, f, schema: str) -> DataFrame:
    return blocks.in_cells(bench.where("task IS NOT NULL"), reserve.where("task IS NOT NULL"), ["env"], f, schema, "task")


def _by_plan(bench: DataFrame, reserve: DataFrame, crowded: DataFrame, sparse, dense) -> DataFrame:
    """What dense gives for the crowded environments, and sparse for the others."""
    if crowded.isEmpty():
        return sparse(bench, reserve)
    rest = bench.join(crowded, "env", "left_anti")
    some = dense(*(x.join(crowded, "env", "left_semi") for x in (bench, reserve)))
    return some if rest.isEmpty() else some.unionByName(sparse(rest, reserve.join(crowded, "env", "left_anti")))


def task_overlap(bench: DataFrame, reserve: DataFrame, flag_at: float = 0.6) -> DataFrame:
    """bench, reserve (env, task, tokens, records, calls, sequence, database). Pairs of one environment that share a
    token, a record, a call, the sequence or the database: Jaccards, share of the benchmark's calls, equal sequence,
    equal database, flag. Pairs that share nothing have all zeros and no row. As many rows as there are such pairs:
    overlap_at and task_overlap_summary need fewer."""
    keys = F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), F.xxhash64(F.lit(c), F.col(c))) for c in ("sequence", "database"))))
    equal = lambda side, name: side.select("env", F.col("task").alias(name), F.explode(keys).alias("k"))

    def sparse(bench: DataFrame, reserve: DataFrame) -> DataFrame:
        same = equal(bench, "bench_task").join(equal(reserve, "reserve_task"), ["env", "k"]).select("env", "bench_task", "reserve_task")
        return _measured(_reaching(_task_items(bench, reserve), 0.0).unionByName(same).distinct(), bench, reserve)

    bench, reserve = _sides(bench, reserve)
    x = _by_plan(bench, reserve, _crowded(bench, reserve, 0.0, equal=True), sparse, lambda b, r: _block_pairs(b, r, None))
    return x.withColumn("flagged", (F.greatest(*OVERLAP_MEASURES) >= flag_at) | F.col("same_database"))


def overlap_at(bench: DataFrame, reserve: DataFrame, least: float = 0.6) -> DataFrame:
    """The pairs of task_overlap of which some measure is `least` or more (> 0)."""
    def sparse(bench: DataFrame, reserve: DataFrame) -> DataFrame:
        return _measured(_reaching(_task_items(bench, reserve), least), bench, reserve).where(F.greatest(*OVERLAP_MEASURES) >= least)

    bench, reserve = _sides(bench, reserve)
    return _by_plan(bench, reserve, _crowded(bench, reserve, least), sparse, lambda b, r: _block_pairs(b, r, least))


def _block_summary(bench: DataFrame, reserve: DataFrame, top: int) -> DataFrame:
    """(env, bench_task, max_instruction, max_records, max_calls, same_sequence, same_database, closest) over all pairs of
    an environment. A cell gives a row for each of its benchmark tasks, with the best of its reserve tasks."""
    def found(a: pa.Table, b: pa.Table) -> Iterator[pa.RecordBatch]:
        b = b.take(pc.sort_indices(b, [("task", "ascending")])).combine_chunks()  # the first of equals is the first task
        times = pc.max(b["task"].value_counts().field("counts")).as_py() or 0 if len(b) else 0
        for at, x in _tiles(a, b):
            n = len(x["same_database"])
            most = np.maximum.reduce([x[m] for m in OVERLAP_MEASURES])
            ahead = np.where((most > 0) | x["same_sequence"] | x["same_database"], most, -1.0)
            row, picked = np.arange(n), []
            for _ in range(min(top * times, len(b))):  # rows of one task may be the same
                best = ahead == ahead.max(axis=1, keepdims=True)
                first = best & x["same_sequence"]
                j = np.where(first.any(axis=1), first.argmax(axis=1), best.argmax(axis=1))
                picked.append(np.where(ahead[row, j] >= 0, j, -1))
                ahead[row, j] = -1
            i, j = np.divmod(np.flatnonzero(np.array(picked).reshape(-1, n).T.reshape(-1) >= 0), max(1, len(picked)))
            j = np.array(picked).reshape(-1, n).T[i, j]
            near = pa.StructArray.from_arrays([pa.array(-most[i, j]), pa.array(~x["same_sequence"][i, j]), b["task"].take(j).combine_chunks(), *(pa.array(x[m][i, j]) for m in OVERLAP_MEASURES), pa.array(x["same_database"][i, j])], names=["far", "other", "task", *OVERLAP_MEASURES, "same_database"])
            ends = np.concatenate([[0], np.cumsum(np.bincount(i, minlength=n))]).astype(np.int32)
            keys = [a[c].slice(at, n).combine_chunks() for c in ("env", "task")]
            largest = [x[m].max(axis=1, initial=0.0) for m in OVERLAP_MEASURES] + [x[c].any(axis=1) for c in ("same_sequence", "same_database")]
            t = pa.table([*keys, *largest, pa.ListArray.from_arrays(ends, _plain(near))], names=names)
            yield from t.combine_chunks().to_batches()

    names = ["env", "bench_task", *(f"max_{m}" for m in OVERLAP_MEASURES), "same_sequence", "same_database", "near"]
    near = f"array<struct<far: double, other: boolean, task: {_kind(reserve, 'task')}, " + ", ".join(f"{m}: double" for m in OVERLAP_MEASURES) + ", same_database: boolean>>"
    schema = f"env {_kind(bench, 'env')}, bench_task {_kind(bench, 'task')}, " + ", ".join(f"max_{m} double" for m in OVERLAP_MEASURES) + f", same_sequence boolean, same_database boolean, near {near}"
    each = _in_cells(bench, reserve, found, schema)
    closest = F.transform(F.slice(F.array_distinct(F.sort_array(F.flatten(F.collect_list("near")))), 1, top), lambda y: y["task"])
    return each.groupBy("env", "bench_task").agg(*(F.max(c).alias(c) for c in names[2:5]), *(F.bool_or(c).alias(c) for c in names[5:7]), closest.alias("closest"))


def _plain(x: pa.Array | pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x


def task_overlap_summary(bench: DataFrame, reserve: DataFrame, flag_at: float = 0.6, top: int = 3, falling: tuple[float, ...] = (0.3, 0.1, 0.0)) -> DataFrame:
    """One row per benchmark task: the maxima of the measures over all reserve tasks of its environment (zeros where
    nothing is shared), whether it has an equal sequence, an equal database, a flag, and the `top` reserve tasks by the
    largest measure (then equal sequence, then task; such as share nothing don't count).

    Rounds of overlap_at with falling bounds: a maximum that reaches a round's bound is exact, and so are the closest
    tasks once `top` of them reach it; only tasks and measures that are still open go on to the next. So pairs that share
    little are looked at for those tasks only that have nothing closer. In an environment where a round would meet too
    many pairs, the tasks that are still open are compared with all others block by block instead."""
    bench, reserve = _sides(bench, reserve)
    task = bench.select("env", F.col("task").alias("bench_task"))
    ahead, items, found, open_, summed = bench, None, None, None, None
    for least in (flag_at, *falling):
        crowded = _crowded(ahead, reserve, least)
        if not crowded.isEmpty():
            new = settled(_block_summary(*(x.join(crowded, "env", "left_semi") for x in (ahead, reserve)), top))
            summed = new if summed is None else summed.unionByName(new)
            ahead = ahead.join(crowded, "env", "left_anti")
            open_ = None if open_ is None else open_.join(crowded, "env", "left_anti")
            if ahead.isEmpty():
                break
        if items is None:
            reserve = settled(reserve.distinct())  # a row that comes twice counts once
            items = _task_items(ahead, reserve)
        new = _measured(_reaching(items, least, open_), bench, reserve)
        new = new.withColumn("most", F.greatest(*OVERLAP_MEASURES)).where("most > 0")
        found = settled(new if found is None else found.unionByName(new).distinct())
        if least == falling[-1]:
            break
        at = found.groupBy("env", "bench_task").agg(*(F.max(m).alias(m) for m in OVERLAP_MEASURES), F.count_if(F.col("most") >= least).alias("near"))
        is_open = F.array_compact(F.array(*(F.when(~F.coalesce((F.col(m) >= least) & (F.col("near") >= top), F.lit(False)), F.lit(m)) for m in OVERLAP_MEASURES)))
        open_ = settled(ahead.select("env", F.col("task").alias("bench_task")).join(at, ["env", "bench_task"], "left").select("env", F.col("bench_task").alias("task"), F.explode(is_open).alias("measure")))
        if open_.isEmpty():
            break
        ahead = ahead.join(open_, ["env", "task"], "left_semi")

    best = summed
    if found is not None:
        rest = bench if summed is None else bench.join(summed.select("env", F.col("bench_task").alias("task")), ["env", "task"], "left_anti")
        rounds = _rounds_summary(found if summed is None else found.join(summed, ["env", "bench_task"], "left_anti"), rest, bench, reserve, top)
        best = rounds if summed is None else summed.unionByName(rounds)
    x = task.join(best, ["env", "bench_task"], "left")
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    x = x.select("env", "bench_task", *(F.coalesce(f"max_{m}", F.lit(0.0)).alias(f"max_{m}") for m in OVERLAP_MEASURES), no("same_sequence"), no("same_database"), "closest")
    return x.withColumn("flagged", (F.greatest(*(f"max_{m}" for m in OVERLAP_MEASURES)) >= flag_at) | F.col("same_database"))


def _rounds_summary(found: DataFrame, rest: DataFrame, bench: DataFrame, reserve: DataFrame, top: int) -> DataFrame:
    """As _block_summary, from the pairs that rounds have found for the tasks `rest` and those of equal sequence or
    database."""
    def equal(c: str) -> DataFrame:
        """The first reserve tasks of each equal sequence or database: enough for those that share nothing else."""
        w = Window.partitionBy("env", c).orderBy("task")
        few = reserve.where(F.col(c).isNotNull()).select("env", c, "task").withColumn("r", F.row_number().over(w)).where(F.col("r") <= top + TOP_OF_CLASS)
        return rest.where(F.col(c).isNotNull()).select("env", F.col("task").alias("bench_task"), c).join(few.select("env", c, F.col("task").alias("reserve_task")), ["env", c]).select("env", "bench_task", "reserve_task")

    same = {c: settled(equal(c)) for c in ("sequence", "database")}
    more = _measured(same["sequence"].unionByName(same["database"]).distinct(), bench, reserve).withColumn("most", F.greatest(*OVERLAP_MEASURES))
    every = found.unionByName(more).distinct()
    w = Window.partitionBy("env", "bench_task").orderBy(F.desc("most"), F.desc("same_sequence"), "reserve_task")
    return every.withColumn("r", F.row_number().over(w)).groupBy("env", "bench_task").agg(
        *(F.max(m).alias(f"max_{m}") for m in OVERLAP_MEASURES), F.bool_or("same_sequence").alias("same_sequence"), F.bool_or("same_database").alias("same_database"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("r") <= top, F.struct("r", "reserve_task")))), lambda y: y["reserve_task"]).alias("closest"),
    )


def shared_paths(rows: DataFrame, folds: DataFrame, max_df: int = 3, shared_at: int = 5) -> DataFrame:
    """rows (group, paths), folds (group, style, fold): the most rare paths shared with one group of the style outside
    the fold; repo_shared from `shared_at` on."""
    each = rows.select("group", F.explode(F.array_distinct("paths")).alias("path")).join(folds, "group")
    rare = each.groupBy("style", "path").agg(F.count("*").alias("df")).where(F.col("df").between(2, max_df))
    kept = each.join(rare, ["style", "path"])
    other = kept.select("style", "path", F.col("group").alias("other"), F.col("fold").alias("other_fold"))
    shared = kept.join(other, ["style", "path"]).where(F.col("fold") != F.col("other_fold")).groupBy("group", "other").agg(F.count("*").alias("n"))
    most = shared.groupBy("group").agg(F.max("n").alias("max_shared"))
    return rows.select("group").distinct().join(most, "group", "left").select("group", F.coalesce("max_shared", F.lit(0)).alias("max_shared"), (F.coalesce("max_shared", F.lit(0)) >= shared_at).alias("repo_shared"))


def app_coverage(rows: DataFrame) -> DataFrame:
    """rows (row_id, app, fold): is the app seen in another fold? Counts minus the own fold's count."""
    total = rows.groupBy("app").agg(F.count("*").alias("t"))
    own = rows.groupBy("app", "fold").agg(F.count("*").alias("o"))
    return rows.join(total, "app").join(own, ["app", "fold"]).select("row_id", "app", "fold", (F.col("t") > F.col("o")).alias("app_covered"))


def row_strata(rows: DataFrame, screens: DataFrame, least: float = 0.8) -> DataFrame:
    """rows (row_id, app, fold, state, items) and screens (id, app, fold, state, items): app_coverage of each row, and
    screen_covered: does its screen match one of another fold (as in same_screen)? Equal states are counted by fold, not
    paired."""
    folds = lambda by: screens.where("state IS NOT NULL").groupBy(*by).agg(F.count("*").alias("n_" + by[-1]))
    by_state = rows.where("state IS NOT NULL").join(folds(["state"]), "state").join(folds(["state", "fold"]), ["state", "fold"], "left").where(F.col("n_state") > F.coalesce("n_fold", F.lit(0))).select("row_id")
    a = rows.where(F.size("items") > 0).select(F.col("row_id").alias("id"), "app", "items")
    hit = set_jaccard_pairs(a, screens.where(F.size("items") > 0).select("id", "app", "items"), "app", least)
    fold = lambda df, key, name: df.select(F.col(key).alias(name), F.col("fold").alias(f"{name}_fold"))
    by_items = hit.join(fold(rows, "row_id", "left_id"), "left_id").join(fold(screens, "id", "right_id"), "right_id").where("left_id_fold <> right_id_fold").select(F.col("left_id").alias("row_id"))
    covered = by_state.unionByName(by_items).distinct().withColumn("_c", F.lit(True))
    return app_coverage(rows).join(covered, "row_id", "left").select("row_id", "app", "fold", "app_covered", F.coalesce("_c", F.lit(False)).alias("screen_covered"))


def same_screen(a: DataFrame, b: DataFrame, least: float = 0.8) -> DataFrame:
    """a, b (id, state, app, items): pairs with an equal state id, or of one app with Jaccard >= least. As many rows as
    there are such pairs; row_strata needs fewer."""
    return screen_pairs(a, b, least)


def screen_pairs(a: DataFrame, b: DataFrame, least: float, equal: tuple[str, ...] = ("state",)) -> DataFrame:
    """a, b (id, app, items and the columns `equal`): pairs that have an equal value in one of these, or are of one app with
    Jaccard >= least. Pairs are told apart as they are made (by the first of the equal columns, then by their items), so
    none are shuffled to drop repeated ones, except those of ids that several rows of a side have."""
    ids = lambda df: settled(df.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"))
    many_a = ids(a)
    many_b = many_a if a is b else ids(b)
    none_a, none_b = many_a.isEmpty(), many_b.isEmpty()
    of = lambda df, many, how: df.alias("x").join(many.alias("y"), F.col("x.id").eqNullSafe(F.col("y.id")), how)
    one_a = a if none_a else of(a, many_a, "left_anti")
    one_b = one_a if a is b else b if none_b else of(b, many_b, "left_anti")
    out = _pairs_apart(one_a, one_b, least, equal)
    if not none_a:
        out = out.unionByName(_pairs_apart(of(a, many_a, "left_semi"), b, least, equal).distinct())
    return out if none_b else out.unionByName(_pairs_apart(one_a, of(b, many_b, "left_semi"), least, equal).distinct())


def _pairs_apart(a: DataFrame, b: DataFrame, least: float, equal: tuple[str, ...]) -> DataFrame:
    """screen_pairs, each pair of rows once."""
    out = None
    for k, c in enumerate(equal):
        side = lambda df, name: df.where(F.col(c).isNotNull()).select(F.col(c).alias("_key"), *(F.col(y).alias(f"{name}_{y}") for y in ("id", *equal[:k])), F.col("id").alias("_by"))  # noqa: E731, B023
        left, right = (x.drop("_by") for x in blocks.dealt(side(a, "left"), side(b, "right"), ["_key"], "_by"))
        pairs = left.join(right, ["_key", "i", "j"]).where(_unequal(equal[:k])).select("left_id", "right_id")
        out = pairs if out is None else out.unionByName(pairs)
    some = lambda x: x.where(F.size("items") > 0).select("id", "app", "items", *equal)
    left = some(a)
    return out.unionByName(set_jaccard_pairs(left, left if a is b else some(b), "app", least, equal).select("left_id", "right_id"))


def _unequal(columns: tuple[str, ...]) -> Column:
    """None of left_ and right_ of these columns are equal; nulls equal nothing."""
    same = [F.coalesce(F.col(f"left_{c}") == F.col(f"right_{c}"), F.lit(False)) for c in columns]
    return ~functools.reduce(operator.or_, same, F.lit(False))


def strata_join(rows: DataFrame, links: DataFrame, key: str = "task") -> DataFrame:
    """Stratum of each row by its link (exact task, same template, template only) or unlinked, and a turn band."""
    best = links.groupBy(key).agg(F.min(F.struct(F.when(F.col("link") == "exact task", 0).when(F.col("link") == "same template", 1).otherwise(2).alias("o"), "link"))["link"].alias("stratum"))
    share = F.col("turn") / F.col("total_turns")
    return rows.join(best, key, "left").withColumn("stratum", F.coalesce("stratum", F.lit("unlinked"))).withColumn("band", F.when(share <= 1 / 3, "early").when(share <= 2 / 3, "middle").otherwise("late"))


def leave_out_contaminated(rows: DataFrame, package_tasks: DataFrame, key: str = "task") -> tuple[DataFrame, DataFrame]:
    """(package, rows clean for that package) and rows clean for all packages."""
    packages = package_tasks.agg(F.collect_set("package").alias("_all"))  # one row, as long as a row's own result may be
    barred = package_tasks.groupBy(key).agg(F.collect_set("package").alias("_barred"))
    free = F.array_except("_all", F.coalesce("_barred", F.array().cast(barred.schema["_barred"].dataType)))
    own = rows.join(barred, key, "left").join(F.broadcast(packages)).select(*rows.columns, F.explode(free).alias("package"))
    return own, rows.join(package_tasks.select(key).distinct(), key, "left_anti")


def count_of(text: Column, part: Column) -> Column:
    """How often a part occurs, without overlaps."""
    return F.when(F.length(part) > 0, ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int")).otherwise(0)


def target_leak(requests: DataFrame, rows: DataFrame, least: int = 40) -> DataFrame:
    """requests (key, system, user), rows (key, system_str, messages ARRAY, target, history ARRAY). Per request: system
    text exactly once, each distinct message as often as it should, and the target (of `least` characters, not itself in
    the history) nowhere."""
    x = requests.join(rows, "key")
    whole = F.concat_ws("\n", "system", "user")
    expected = F.transform(F.array_distinct("messages"), lambda m: F.struct(m.alias("m"), F.size(F.filter("messages", lambda y: y == m)).alias("n")))
    wrong = F.size(F.filter(expected, lambda e: count_of(F.col("user"), e["m"]) < e["n"]))
    testable = (F.length("target") >= least) & ~F.exists("history", lambda h: h.contains(F.col("target")))
    return x.select("key", (count_of(whole, F.col("system_str")) == 1).alias("system_once"), wrong.alias("messages_missing"), (testable & whole.contains(F.col("target"))).alias("target_leaked"), F.length(whole).alias("chars"))


def shown_item_audit(items: DataFrame, inventory: DataFrame) -> DataFrame:
    """items (item_id, episode, label, disposition, text, names): counts by label and disposition of items without a
    decision, of sanitised texts with raw values, and of supporting items that name nothing the episode showed."""
    raw = F.col("text").rlike(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|\b\d{1,3}(?:\.\d{1,3}){3}\b|\b[\w-]+@[\w-]+:")
    named = items.select("item_id", "episode", F.explode("names").alias("name")).join(inventory.select("episode", "name").distinct(), ["episode", "name"], "left_semi").select("item_id").distinct().withColumn("_named", F.lit(True))
    x = items.join(named, "item_id", "left")
    return x.groupBy("label", "disposition").agg(
        F.count("*").alias("n"), F.count_if(F.col("label").isNull() | F.col("disposition").isNull()).alias("undecided"), F.count_if((F.col("disposition") == "sanitized") & raw).alias("raw_values"),
        F.count_if((F.col("label") == "supporting") & F.col("_named").isNull()).alias("unsupported"),
    )


#: Fields that only the answer key has.
ANSWER_FIELDS = ("state_before", "state_after", "state_diff", "n_delta", "sigma_t", "final_state", "init_state", "obs_success")


def answer_key_checks(rows: DataFrame, raw_turns: DataFrame) -> DataFrame:
    """rows (id, turn, text, target), raw_turns (id, turn, observation) -> (check, violations)."""
    field = F.col("text").rlike(r"\b(" + "|".join(ANSWER_FIELDS) + r")\b")
    section = F.col("text").rlike(r"(?im)^\s*(returns|constraints)\s*:")
    a = rows.agg(F.count_if(field).alias("answer fields"), F.count_if(section).alias("hidden sections"))
    pair = rows.select("id", "turn", F.col("target").alias("observation"))
    b = pair.exceptAll(raw_turns.select("id", "turn", "observation")).agg(F.count("*").alias("targets that differ"))
    one = a.join(F.broadcast(b))  # one row each
    return one.select(F.expr("stack(3, 'answer fields', `answer fields`, 'hidden sections', `hidden sections`, 'targets that differ', `targets that differ`) AS (check, violations)"))


def reconcile_row_sets(a: DataFrame, b: DataFrame, keys: list[str], text: str, score: str, tolerance: float = 1e-6) -> DataFrame:
    """One row: keys only in a, only in b, texts that differ, both means and whether they agree."""
    side = lambda df, p: df.select(*keys, F.col(text).alias(f"{p}t"), F.col(score).alias(f"{p}s"), F.lit(1).alias(p))
    x = side(a, "a").join(side(b, "b"), keys, "full")
    return x.agg(
        F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull() & ~F.col("at").eqNullSafe(F.col("bt"))).alias("texts_differ"),
        F.avg("as").alias("mean_a"), F.avg("bs").alias("mean_b"),
    ).withColumn("means_agree", F.abs(F.col("mean_a") - F.col("mean_b")) <= tolerance)


# Set operations on keys.
def common_keys(rows: DataFrame, keys: list[str], system: str, n: int) -> DataFrame:
    """Keys that all n systems have."""
    return rows.groupBy(*keys).agg(F.count_distinct(system).alias("_n")).where(F.col("_n") == n).drop("_n")


def missing_keys(wanted: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.select(*keys).distinct().join(found.select(*keys).distinct(), keys, "left_anti")


def union_keys(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    out = parts[0].select(*keys)
    for p in parts[1:]:
        out = out.unionByName(p.select(*keys))
    return out.distinct()


def symmetric_difference(a: Column, b: Column) -> Column:
    return F.array_union(F.array_except(a, b), F.array_except(b, a))
