"""Paired and clustered statistics of systems over the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from ..functions.parsers import DIMENSIONS


def mix(x: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit values (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def system_table(judged: DataFrame, by: list[str] | None = None, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """Rows, valid, failed and means per system; a row without `failed` is valid here."""
    ok = ~F.coalesce(F.col("failed") != 0, F.lit(False))
    return judged.groupBy(*(by or ["system"])).agg(F.count("*").alias("n_rows"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("failed"), *(F.avg(F.when(ok & (F.col(d) > 0), F.col(d))).alias(d) for d in dimensions), F.avg(F.when(ok, F.col("score"))).alias("score"))


def pairs(rows: DataFrame, a: str, b: str, keys: list[str], cluster: str, score: str = "score", by: list[str] | None = None) -> DataFrame:
    """Rows that systems a and b both have: keys, cluster, (by), a, b, diff. Only keys and scores are joined."""
    by = by or []
    side = lambda s, n: rows.where((F.col("system") == s) & F.col(score).isNotNull()).select(*dict.fromkeys([*by, *keys, cluster]), F.col(score).alias(n))
    on = list(dict.fromkeys([*by, *keys]))
    right = side(b, "b").drop(*([cluster] if cluster not in on else []))
    return side(a, "a").join(right, on).withColumn("diff", F.col("a") - F.col("b"))


def paired_diff(pairs_: DataFrame, by: list[str] | None = None, tolerance: float = 1e-9) -> DataFrame:
    """Rows, wins, ties, losses, mean difference and its standard error (population deviation over root n)."""
    d = F.col("diff")
    return pairs_.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), F.count_if(d > tolerance).alias("wins"), F.count_if(F.abs(d) <= tolerance).alias("ties"), F.count_if(d < -tolerance).alias("losses"),
        F.avg(d).alias("mean_diff"), (F.stddev_pop(d) / F.sqrt(F.count("*"))).alias("se"),
    )


def cluster_wtl(pairs_: DataFrame, cluster: str, by: list[str] | None = None, tolerance: float = 1e-9) -> DataFrame:
    """Clusters whose mean difference is above, at and below zero."""
    means = pairs_.groupBy(*(by or []), cluster).agg(F.avg("diff").alias("diff"))
    return paired_diff(means, by, tolerance).select(*(by or []), F.col("n").alias("clusters"), "wins", "ties", "losses")


#: Cumulated probabilities of a Poisson(1) count.
_POISSON = np.cumsum(np.exp(-1) / np.cumprod(np.r_[1.0, np.arange(1, 20)]))


def bootstrap_draws(pairs_: DataFrame, cluster: str, resamples: int = 10_000, seed: int = 20260921) -> DataFrame:
    """(replicate, row_mean, cluster_mean): in each replicate a cluster counts as often as a Poisson(1) number, drawn from
    a hash of cluster, replicate and seed. Clusters stay in their partitions, whatever their number."""
    key = F.xxhash64(F.col(cluster).cast("string"), F.lit(seed)).alias("k")
    clusters = pairs_.groupBy(cluster).agg(F.sum("diff").cast("double").alias("s"), F.count("*").cast("double").alias("c"))

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Weighted sums of a partition's clusters in each replicate."""
        total = np.zeros((4, resamples))
        for batch in batches:
            keys, sums, counts = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for at in range(0, len(keys), 256):
                k, s, c = keys[at : at + 256].view(np.uint64), sums[at : at + 256], counts[at : at + 256]
                values = np.stack([s, c, s / c, np.ones(len(s))])
                for lo in range(0, resamples, 1024):
                    r = np.arange(lo, min(lo + 1024, resamples), dtype=np.uint64)
                    u = mix(mix(k)[:, None] + r) / 2.0**64
                    total[:, lo : lo + len(r)] += values @ np.searchsorted(_POISSON, u, "right")
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(resamples)), *map(pa.array, total)], ["replicate", "s", "c", "m", "w"])

    sums = clusters.select(key, "s", "c").mapInArrow(drawn, "replicate long, s double, c double, m double, w double").groupBy("replicate").agg(*(F.sum(x).alias(x) for x in "scmw"))
    return sums.where("w > 0").select("replicate", (F.col("s") / F.col("c")).alias("row_mean"), (F.col("m") / F.col("w")).alias("cluster_mean"))


def percentile_interval(draws: DataFrame, column: str) -> DataFrame:
    """(low, high) at sorted positions int(.025 n) and min(n - 1, int(.975 n)) of the replicates."""
    sorted_ = F.sort_array(F.collect_list(column))
    n = F.count(column)
    return draws.agg(sorted_.alias("x"), n.alias("n")).select(F.element_at("x", (F.floor(F.col("n") * 0.025) + 1).cast("int")).alias("low"), F.element_at("x", (F.least(F.col("n") - 1, F.floor(F.col("n") * 0.975)) + 1).cast("int")).alias("high"))


def cluster_bootstrap(pairs_: DataFrame, cluster: str, resamples: int = 10_000, seed: int = 20260921) -> DataFrame:
    """estimand (row_mean, cluster_mean), low, high."""
    d = bootstrap_draws(pairs_, cluster, resamples, seed)
    return percentile_interval(d, "row_mean").select(F.lit("row_mean").alias("estimand"), "*").unionByName(percentile_interval(d, "cluster_mean").select(F.lit("cluster_mean").alias("estimand"), "*"))


def sign_flip_test(pairs_: DataFrame, cluster: str, flips: int = 20_000, seed: int = 20260921) -> DataFrame:
    """Two-sided p of the mean difference when the signs of whole clusters are flipped: (extreme + 1) / (flips + 1).
    Clusters stay in their partitions, whatever their number."""

    clusters = pairs_.groupBy(cluster).agg(F.sum("diff").alias("s"), F.count("*").alias("c"))
    key = F.xxhash64(F.col(cluster).cast("string"), F.lit(seed)).alias("key")
    blocks = -(-flips // 64)

    def flipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of a partition's clusters in each replicate; a hash of (cluster, block) holds the signs of 64."""
        total, bit = np.zeros((blocks, 64)), np.arange(64, dtype=np.uint64)
        for batch in batches:
            keys, sums = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for at in range(0, len(keys), 1024):
                k, x = keys[at : at + 1024].view(np.uint64), sums[at : at + 1024]
                for b in range(blocks):
                    signs = mix(mix(k + np.uint64(b)) + np.uint64(b))
                    total[b] += x @ (((signs[:, None] >> bit) & np.uint64(1)).astype(float) * 2 - 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(flips)), pa.array(total.ravel()[:flips])], ["replicate", "s"])

    sums = clusters.select(key, "s").mapInArrow(flipped, "replicate long, s double").groupBy("replicate").agg(F.sum("s").alias("s"))
    whole = clusters.agg(F.sum("s").alias("all_s"), F.sum("c").alias("all_c"))  # one row
    extreme = F.abs("s") / F.col("all_c") >= F.abs("all_s") / F.col("all_c") - 1e-12
    return sums.join(F.broadcast(whole)).agg(((F.count_if(extreme) + 1) / F.lit(flips + 1)).alias("p"))


def breakdown(pairs_: DataFrame, strata: list[str]) -> DataFrame:
    """paired_diff by each stratum column, in one pass: stratum, value, ..."""
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("stratum"), F.col(s).cast("string").alias("value")) for s in strata)))
    return paired_diff(pairs_.select("diff", each.alias("x")).select("diff", "x.*"), ["stratum", "value"])


def subset_reports(pairs_: DataFrame, subsets: dict[str, Column]) -> DataFrame:
    """paired_diff of named subsets, which may overlap, in one pass."""
    tags = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in subsets.items())))
    return paired_diff(pairs_.withColumn("subset", F.explode(tags)), ["subset"])


def scaling_curve(packages: DataFrame, counts: DataFrame, costs: DataFrame, scores: DataFrame) -> DataFrame:
    """One row per package: size, artefact counts by kind, construction cost, mean score and difference to the smallest."""
    wide = counts.groupBy("package").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "n")))).alias("counts"))
    mean = scores.groupBy("package").agg(F.avg("score").alias("score"), F.count("*").alias("n_rows"))
    x = packages.join(wide, "package", "left").join(costs, "package", "left").join(mean, "package", "left")
    first = x.agg(F.min_by("score", "traces").alias("base"))
    return x.join(F.broadcast(first)).withColumn("gain", F.col("score") - F.col("base")).drop("base")  # one row


def case_screen(rows: DataFrame, systems: list[str], keys: list[str], pattern: str, high: float, low: float, limit: int) -> DataFrame:
    """Rows with the systems' scores side by side: `ladder` (each system at least as good as the one before, and the
    last high where the first is low) or `failure` (all low), the widest gap first."""
    wide = rows.groupBy(*keys).pivot("system", systems).agg(F.first("score"))
    cols = [F.col(f"`{s}`") for s in systems]
    gap = cols[-1] - cols[0]
    if pattern == "ladder":
        test = (cols[-1] >= high) & (cols[0] <= low)
        for x, y in zip(cols, cols[1:], strict=False):
            test &= x <= y
    else:
        test = F.greatest(*cols) <= low if len(cols) > 1 else cols[0] <= low
    return wide.where(test).withColumn("gap", gap).orderBy(F.desc("gap"), *keys).limit(limit)


def backbone_transfer(rows: DataFrame, a: str, b: str, keys: list[str], cluster: str) -> DataFrame:
    """Gain of system a over b under each backbone, by rows and by clusters."""
    p = pairs(rows, a, b, keys, cluster, by=["backbone"])
    w = cluster_wtl(p, cluster, ["backbone"]).select("backbone", "clusters", F.col("wins").alias("cluster_wins"), F.col("losses").alias("cluster_losses"))
    return paired_diff(p, ["backbone"]).join(w, "backbone")
