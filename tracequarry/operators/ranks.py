"""Places in a total order, running sums and packing, each found by many tasks however large one key is."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from ..functions.lineage import settled

_LOW = 33  # bits of monotonically_increasing_id that count rows inside a partition


def ranked(rows: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """rows with their place (from 0) in the order of some columns. Rows are sorted by range partitions, and a partition's
    places begin behind the sizes of those before it; equal rows are dealt in any order, also over several partitions."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(n, *order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
    dealt = settled(dealt.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", _LOW).alias("_part")
    sizes = dealt.groupBy(part).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("_part", before.alias("_before")))  # as many rows as a shuffle has partitions
    out = dealt.withColumn("_part", part).join(starts, "_part")
    return out.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << _LOW) - 1))).drop("_part", "_before", "_at")


def ranked_in(rows: DataFrame, key: str, order: list[str], name: str = "place", group: str = "group") -> DataFrame:
    """ranked() inside each value of key (null is one): name, and group, a number for the value."""
    whole = ranked(rows, [key, *order], "_rank")
    firsts = whole.groupBy(F.col(key).alias("_key")).agg(F.min("_rank").alias(group))
    return whole.join(firsts, F.col(key).eqNullSafe(F.col("_key"))).withColumn(name, F.col("_rank") - F.col(group)).drop("_rank", "_key")


def running(points: DataFrame, keys: list[str], at: str, values: list[str], block: int = 4096) -> DataFrame:
    """points with the sums of values over the rows of the same keys at smaller positions (`<value>_before`) and at
    smaller or equal ones (`<value>_upto`). Positions are cut into blocks, whose totals are summed first, so that rows of
    one key are sorted in as many tasks as they have blocks."""
    dealt = points.withColumn("_block", F.floor(F.col(at) / block))
    totals = dealt.groupBy(*keys, "_block").agg(*(F.sum(v).alias(f"_{v}") for v in values))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_block", *(F.coalesce(F.sum(f"_{v}").over(earlier), F.lit(0)).alias(f"_{v}") for v in values))
    inside = Window.partitionBy(*keys, "_block").orderBy(at)
    smaller, upto = inside.rangeBetween(Window.unboundedPreceding, -1), inside.rangeBetween(Window.unboundedPreceding, 0)
    out = dealt.join(totals, [*keys, "_block"])
    for v in values:
        out = out.withColumn(f"{v}_before", F.col(f"_{v}") + F.coalesce(F.sum(v).over(smaller), F.lit(0))).withColumn(f"{v}_upto", F.col(f"_{v}") + F.sum(v).over(upto))
    return out.drop("_block", *(f"_{v}" for v in values))


def _cuts(size: np.ndarray, max_count: int, max_bytes: int) -> np.ndarray:
    """For each record the one at which a batch that begins with it is cut: the first that would take it over the count
    or the bytes, found in the running sum of sizes."""
    total = np.concatenate([[0], np.cumsum(size)])
    return np.minimum(np.arange(len(size)) + max_count, np.searchsorted(total, total[:-1] + max_bytes, "right") - 1)


def pack_batches(records: DataFrame, key: str, order: list[str], text: str, max_count: int, max_bytes: int, block: int = 1 << 16) -> DataFrame:
    """(key, order, batch): the records of each key in order, cut before the count or the bytes of a batch would go over;
    a record larger than max_bytes has batch null and stands outside. A null text has no bytes.

    Places are cut into blocks, each with the max_count records behind it. Where a batch leaves a block depends only on
    the record at which the block is entered, one of its first max_count: a table of these jumps is doubled until it
    spans all blocks of the longest key, which gives every block its entry and the number of batches before it. Only
    sizes are held, a block in a task."""
    slim = records.select(key, *order, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("size"))
    span = max(block, 64 * max_count)
    placed = settled(ranked_in(slim.where(F.col("size") <= max_bytes), key, order))
    own = F.floor(F.col("place") / span)
    ahead = (F.col("place") % span < max_count) & (own > 0)
    dealt = placed.withColumn("b", F.explode(F.when(ahead, F.array(own, own - 1)).otherwise(F.array(own))))

    def jumps(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        b = int(pdf["b"].iloc[0])
        n = int((pdf["place"] // span == b).sum())
        cut = _cuts(pdf["size"].to_numpy(), max_count, max_bytes)
        at = np.arange(min(max_count, n) if b else 1)
        count = np.zeros(len(at), np.int64)
        entry = at.copy()
        while (inside := at < n).any():
            at[inside] = cut[at[inside]]
            count += inside
        return pd.DataFrame({"group": pdf["group"].iloc[0], "b": b, "entry": entry, "exit": at - n, "n": count})

    jump = settled(dealt.select("group", "b", "place", "size").groupBy("group", "b").applyInPandas(jumps, "group long, b long, entry long, exit long, n long"))
    last = jump.agg(F.max("b").alias("b")).first()["b"] or 0
    known = jump.where("b = 0").select("group", "b", "entry", F.lit(0).cast("long").alias("batches"))
    stride = 1
    while stride <= last:
        step = known.join(jump, ["group", "b", "entry"]).select("group", (F.col("b") + stride).alias("b"), F.col("exit").alias("entry"), (F.col("batches") + F.col("n")).alias("batches"))
        known = settled(known.unionByName(step))
        if 2 * stride <= last:
            then = jump.select("group", (F.col("b") - stride).alias("b"), F.col("entry").alias("exit"), F.col("exit").alias("exit2"), F.col("n").alias("n2"))
            jump = settled(jump.join(then, ["group", "b", "exit"]).select("group", "b", "entry", F.col("exit2").alias("exit"), (F.col("n") + F.col("n2")).alias("n")))
        stride *= 2

    names = [key, *order]

    def numbered(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        b, at, batches = (int(pdf[c].iloc[0]) for c in ("b", "entry", "batches"))
        n = int((pdf["place"] // span == b).sum())
        cut = _cuts(pdf["size"].to_numpy(), max_count, max_bytes)
        begins = []
        while at < n:
            begins.append(at)
            at = int(cut[at])
        batch = batches - 1 + np.searchsorted(begins, np.arange(n), "right")
        return pdf[names].iloc[:n].assign(batch=batch.astype(np.int32))

    kinds = ", ".join(f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in names)
    packed = dealt.join(known, ["group", "b"]).groupBy("group", "b").applyInPandas(numbered, f"{kinds}, batch int")
    return packed.unionByName(slim.where(F.col("size") > max_bytes).select(*names, F.lit(None).cast("int").alias("batch")))
