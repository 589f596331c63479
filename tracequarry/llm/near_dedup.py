"""Near-duplicate components by an inverted join over MinHash coordinates.

1. Each row gets the set of its distinct word shingles and `COORDINATES` MinHash values. Rows with equal sets are one
   node; its first row (smallest id, then tag) stands for it, and nodes are numbered in the order of these.
2. Nodes are posted under (coordinate, value). Two signatures that agree in `matches` coordinates must share one of
   the COORDINATES - matches + 1 rarest of each (the prefix), so only those are posted, rarest first by a sketch of
   fixed size.
3. Posting lists of up to `SHORT` nodes are merged: they give their pairs. Longer lists are skipped in merging: all
   their nodes meet one centre, the node whose coordinates are most common. For each pair the collisions over all
   coordinates are counted, pairs with fewer than `matches` go, and the rest is confirmed on whole sets.
4. Nodes of skipped lists that the centres left in different components meet again under the rarest shingles of their
   sets: two sets of the wanted similarity share one of the (1 - similarity) * n + 1 rarest of each. Only nodes
   outside a list's largest component are paired, so a large group of near copies costs a row per copy; hot shingles
   are split into parts of `PART` nodes. These pairs pass the same count and the same confirmation.
5. Components of the confirmed links, named by their first row.

`matches` follows the wanted similarity: two rows that have it agree in fewer coordinates with a probability below
`LOSS`, one in a million (16 of 32 at 0.85, 13 at 0.80); nothing else can lose a link.

Defined results: a text with fewer words than a shingle is one shingle; a null or empty text, or one without words, is
linked with nothing. Ids are labels only: rows of one id with different texts are different rows and keep all their
links. Null ids sort before all others, and a component with one is named null (kept is then true for its rows with a
null id, as for any id). Repeated rows are equal sets. An empty table gives an empty table; other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .common import Scratch, components, power_of_two, real_id, settle, sketch, slot, tagged
from .wordhash import U, Words, ids, mix, slices, text_buffers

COORDINATES, LOSS = 32, 1e-6
SHORT = 16
PART = 2000
#: Bounds of the sketches: bytes that are broadcast.
LEAST_SLOTS, MOST_SLOTS = 1 << 18, 1 << 25

_rng = np.random.default_rng(512)
_MULTIPLY = _rng.integers(0, 2**62, COORDINATES, dtype=np.int64).astype(U) * U(2) + U(1)
_ADD = _rng.integers(0, 2**62, COORDINATES, dtype=np.int64).astype(U)


def matches_of(percent: int) -> int:
    """The most coordinates that all but a share LOSS of the pairs of this similarity agree in."""
    p, lost = percent / 100, 0.0
    for m in range(COORDINATES + 1):
        lost += comb(COORDINATES, m) * p**m * (1 - p) ** (COORDINATES - m)  # m coordinates or fewer agree
        if lost >= LOSS:
            break
    if not m or percent > 100:
        raise ValueError(f"{COORDINATES} coordinates can't find pairs of {percent} percent")
    return m


def shingle_sets(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all rows, one row after another and sorted in each, and where each row begins."""
    words = Words(data, off, lower=True)
    n_rows = len(off) - 1
    h = words.windows(size)
    whole = np.flatnonzero(words.room()[: len(h)] >= size)
    row, h = words.row[whole], h[whole]
    short = np.flatnonzero((words.count > 0) & (words.count < size))
    if len(short):  # the whole sequence is the one shingle
        one = np.zeros(len(short), U)
        for k in range(size - 1):
            has = words.count[short] > k
            one[has] = mix(one[has] + words.hash[words.first[short[has]] + k] + U(k + 1))
        row, h = np.concatenate([row, short]), np.concatenate([h, mix(one + U(77))])
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    if len(h):
        new = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])]
        row, h = row[new], h[new]
    return h, np.searchsorted(row, np.arange(n_rows + 1))


def _minhash(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(rows, COORDINATES) of uint32; rows without shingles are all ones."""
    n = np.diff(first)
    out = np.full((len(n), COORDINATES), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(n)
    if len(full):
        begin = first[full]
        for k in range(COORDINATES):
            out[full, k] = np.minimum.reduceat(((h * _MULTIPLY[k] + _ADD[k]) >> U(32)).astype(np.uint32), begin)
    return out


def _coordinate_keys(sig: np.ndarray) -> np.ndarray:
    return sig.astype(np.int64) | np.arange(COORDINATES, dtype=np.int64)[None, :] << 32


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDINATES)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest id reachable), kept (doc_id = component_id).
    Linked are rows with 100 * intersection >= percent * union of their shingle sets."""
    found = row_components(tagged(docs, id_col, text_col), shingle, percent)
    return found.select(real_id(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), real_id(F.col("first_id")).alias("component_id"), (F.col("doc_id") == F.col("first_id")).alias("kept"))


def row_components(rows: DataFrame, shingle: int = 5, percent: int = 85) -> DataFrame:
    """rows: doc_id (no nulls), tag, text, where (doc_id, tag) tells rows apart. One settled row per input row: doc_id,
    tag, n (shingles), first_id and first_tag (of the first row of the component: the row itself if it has no words)."""
    spark = rows.sparkSession
    with Scratch(spark) as scratch:
        return settle(_components(rows, shingle, percent, scratch))


def _components(rows: DataFrame, shingle: int, percent: int, scratch: Scratch) -> DataFrame:
    matches = matches_of(percent)
    spark, settle = rows.sparkSession, scratch.settle

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_buffers(batch.column(2))
            for lo, hi in slices(off):
                h, first = shingle_sets(data, off[lo : hi + 1], shingle)
                n = np.diff(first)
                sums = [np.r_[U(0), np.cumsum(mix(h + U(k)))] for k in (1, 2)]
                f1, f2 = (mix(s[first[1:]] - s[first[:-1]] + n.astype(U)).view(np.int64) for s in sums)
                sig = _minhash(h, first)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(2)), pa.array(n.astype(np.int64)), pa.array(f1), pa.array(f2), pa.array([s.tobytes() for s in sig], pa.binary())], ["doc_id", "tag", "n", "f1", "f2", "sig"])

    signed = settle(rows.select("doc_id", "tag", "text").mapInArrow(sign, "doc_id long, tag long, n long, f1 long, f2 long, sig binary"))
    equal = signed.where("n > 0").groupBy("f1", "f2", "n").agg(F.min(F.struct("doc_id", "tag")).alias("row"), F.first("sig").alias("sig"))
    # Numbered in the order of rows, so that the smallest number of a component is its first row.
    nodes = settle(equal.select("f1", "f2", "n", "row.doc_id", "row.tag", "sig").orderBy("doc_id", "tag").withColumn("node", F.monotonically_increasing_id()))
    n_nodes = nodes.count()
    slots = power_of_two(32 * n_nodes, LEAST_SLOTS, MOST_SLOTS)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(_coordinate_keys(_signatures(batch.column(0))).ravel())], ["key"])

    common = spark.sparkContext.broadcast(sketch(nodes.select("sig").mapInArrow(keys, "key long"), slots, most=65535))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            key = _coordinate_keys(_signatures(batch.column(1)))
            n = common.value[slot(key, slots)]
            rank = np.argsort(n.astype(np.int64) << 32 | (mix(key.view(U)) >> U(32)).astype(np.int64), axis=1)[:, : COORDINATES - matches + 1]
            key, seen = np.take_along_axis(key, rank, 1), np.take_along_axis(n, rank, 1)
            at, which = np.nonzero(seen > 1)  # a key that was counted once is in no other node
            common_ = n.sum(1, dtype=np.int64)
            node = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(key[at, which]), pa.array(node[at]), pa.array(common_[at])], ["key", "node", "common"])

    posted = settle(nodes.select("node", "sig").mapInArrow(post, "key long, node long, common long"))
    lists = posted.groupBy("key").agg(F.count("*").alias("size"), F.max_by("node", F.struct("common", -F.col("node"))).alias("centre")).where("size > 1")
    members = settle(posted.join(lists, "key").select("key", "node", "size", "centre"))
    short = members.where(F.col("size") <= SHORT).groupBy("key").agg(F.sort_array(F.collect_list("node")).alias("m"))

    def all_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of lists of SHORT nodes at most."""
        for batch in batches:
            a: list[np.ndarray] = [np.zeros(0, np.int64)]
            b: list[np.ndarray] = [np.zeros(0, np.int64)]
            for m in batch.column(0).to_pylist():
                i, j = np.triu_indices(len(m), 1)
                x = np.array(m, np.int64)
                a.append(x[i])
                b.append(x[j])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    stars = members.where((F.col("size") > SHORT) & (F.col("node") != F.col("centre"))).select(F.col("centre").alias("a"), F.col("node").alias("b"))
    pairs = settle(_matching(short.select("m").mapInArrow(all_pairs, "a long, b long").union(stars).distinct(), nodes, matches))
    hot = settle(members.where(F.col("size") > SHORT).select("node").distinct())

    # Whole sets of the nodes in question alone; a filter of fixed size keeps other texts from being shuffled.
    row_key = F.xxhash64("doc_id", "tag").alias("k")
    wanted_nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(hot).distinct()
    filter_slots = power_of_two(16 * n_nodes, LEAST_SLOTS, MOST_SLOTS)
    wanted = spark.sparkContext.broadcast(np.packbits(sketch(nodes.join(wanted_nodes, "node", "left_semi").select(row_key), filter_slots) > 0))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for batch in batches:
            k = batch.column(0).to_numpy()
            at = slot(k, filter_slots)
            take = np.flatnonzero((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1)
            take = take[np.unique(k[take], return_index=True)[1]]  # of rows that were read twice, one
            if not len(take):
                continue
            doc, tag, text = (batch.column(i).take(pa.array(take)) for i in (1, 2, 3))
            data, off = text_buffers(text)
            for lo, hi in slices(off):
                h, first = shingle_sets(data, off[lo : hi + 1], shingle)
                yield pa.RecordBatch.from_arrays([doc.slice(lo, hi - lo), tag.slice(lo, hi - lo), pa.array([h[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())], ["doc_id", "tag", "items"])

    found_sets = rows.select(row_key, "doc_id", "tag", "text").mapInArrow(sets_of, "doc_id long, tag long, items binary")
    sets = settle(found_sets.join(nodes.select("doc_id", "tag", "node"), ["doc_id", "tag"]).select("node", "items").dropDuplicates(["node"]))
    links = settle(_confirmed(pairs, sets, percent))

    # Long lists: what the centres left apart. A label is the smallest centre that a node is linked with or is.
    starred = links.join(stars.distinct(), ["a", "b"], "left_semi")
    near_centre = starred.select(F.col("b").alias("node"), F.col("a").alias("centre")).union(starred.select("a", "a")).groupBy("node").agg(F.min("centre").alias("label"))
    labelled = hot.join(near_centre, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    hot_sets = sets.join(hot, "node", "left_semi")

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64))], ["key"])

    item_slots = power_of_two(64 * n_nodes, LEAST_SLOTS, MOST_SLOTS)
    frequent = spark.sparkContext.broadcast(sketch(hot_sets.select("items").mapInArrow(items, "key long"), item_slots, most=65535))

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for node, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = np.frombuffer(raw, np.int64)
                n = frequent.value[slot(h, item_slots)]
                some = np.argsort(n.astype(np.int64) << 32 | (mix(h.view(U)) >> U(32)).astype(np.int64), kind="stable")[: len(h) - -(-percent * len(h) // 100) + 1]
                place = np.flatnonzero(n[some] > 1)  # a shingle that was counted once is in no other set
                out.append((h[some[place]], np.full(len(place), node, np.int64), np.full(len(place), len(h), np.int64), len(h) - place))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["key", "node", "n", "left"])

    rare = hot_sets.select("node", "items").mapInArrow(rarest, "key long, node long, n long, left long").join(labelled, "node")
    rare = settle(rare.select("key", "node", "n", "left", "label"))
    by_label = rare.groupBy("key", "label").agg(F.count("*").alias("c"))
    mixed = by_label.groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("largest"), F.count("*").alias("labels"), F.ceil(F.sum("c") / PART).cast("int").alias("parts")).where("labels > 1")
    apart = rare.join(settle(mixed), "key")
    left = apart.where(F.col("label") != F.col("largest")).select("key", F.pmod(F.hash("node"), "parts").alias("part"), F.col("node").alias("x"), F.col("label").alias("lx"), F.col("n").alias("nx"), F.col("left").alias("rx"))
    right = apart.select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("node").alias("y"), F.col("label").alias("ly"), F.col("n").alias("ny"), F.col("left").alias("ry"), (F.col("label") == F.col("largest")).alias("main"))
    # Rarest first, a set shares with another at most what is left of it from their first common shingle on.
    enough = F.least("rx", "ry") * (100 + percent) >= percent * (F.col("nx") + F.col("ny"))
    close = (F.col("lx") != F.col("ly")) & (F.col("main") | (F.col("x") < F.col("y"))) & (100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny")) & enough
    more = left.join(right, ["key", "part"]).where(close).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    more = settle(_matching(more, nodes, matches))
    links = links.union(_confirmed(more, sets, percent))

    # A component's smallest node is its first row; nodes without links, nearly all, stand for themselves.
    firsts = nodes.select(F.col("node").alias("component"), F.struct("doc_id", "tag").alias("first"))
    named = components(links, settle=settle).join(firsts, "component").select("node", "first")
    labels = nodes.select("f1", "f2", "n", "node", F.struct("doc_id", "tag").alias("own")).join(named, "node", "left").select("f1", "f2", "n", F.coalesce("first", "own").alias("first"))
    worded = signed.where("n > 0").join(labels, ["f1", "f2", "n"]).select("doc_id", "tag", "n", "first.*")
    wordless = signed.where("n = 0").select("doc_id", "tag", "n", F.col("doc_id").alias("first_id"), F.col("tag").alias("first_tag"))
    return worded.toDF(*wordless.columns).union(wordless)


def _matching(pairs: DataFrame, nodes: DataFrame, matches: int) -> DataFrame:
    """Pairs whose signatures agree in `matches` coordinates at least."""

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ok = (_signatures(batch.column(2)) == _signatures(batch.column(3))).sum(1) >= matches
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok))

    sig = lambda name: nodes.select(F.col("node").alias(name), F.col("sig").alias(f"s{name}"))
    return pairs.join(sig("a"), "a").join(sig("b"), "b").select("a", "b", "sa", "sb").mapInArrow(agree, "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose whole sets have the wanted similarity."""

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
                    ok.append(False)
                    continue
                both = np.concatenate([p, q])
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                ok.append(100 * same >= percent * (len(both) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    items = lambda name: sets.select(F.col("node").alias(name), F.col("items").alias(f"i{name}"))
    return pairs.join(items("a"), "a").join(items("b"), "b").select("a", "b", "ia", "ib").mapInArrow(similar, "a long, b long")
