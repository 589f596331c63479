"""Benchmark passages in training texts, found by spaced seeds that ignore chosen token positions.

Two stretches of `SPAN` words are an overlap if at most `TOLERANCE` aligned words differ (substitutions, no shifts).
The span is four blocks of three words, and each of the six masks reads two blocks and ignores two: two
substitutions leave two blocks whole, so no overlap is missed. Seeds of both sides are joined on the hash of the
read positions, and each hit is verified word by word. Items shorter than the span count where they occur whole.

Words are runs of bytes other than ASCII white space and punctuation, A-Z in lower case. Training seeds pass a
filter made of the benchmark's before they are shuffled, so the work follows the hits; a fuller filter only lets more
through, and a benchmark of any size works. Equal stretches of a chunk of rows travel as one, with the list of their
places, and those of an item as one too: a passage that many rows share, or a text that repeats a word, costs one
comparison a chunk and never the product of its places.

Defined results: null texts have no words; items without words match nothing. Rows of one id with different texts are
judged each by its own text, and so are rows with a null id; rows that agree in id and text get the same answer. An item
with a null id counts, and is left out of the list of ids. Empty tables give no overlaps; other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .common import power_of_two, real_id, settle, sketch, slot, tagged, texts
from .wordhash import U, Words, ids, mix, slices, text_buffers

BLOCK, BLOCKS, TOLERANCE = 3, 4, 2
SPAN = BLOCK * BLOCKS
MASKS = tuple(combinations(range(BLOCKS), BLOCKS - TOLERANCE))
LEAST_SLOTS, MOST_SLOTS = 1 << 20, 1 << 26

#: Bytes as they count here: punctuation and control characters part words.
_PLAIN = np.array([b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)], np.uint8)


def _words(data: np.ndarray, off: np.ndarray) -> Words:
    return Words(_PLAIN[data[off[0] : off[-1]]], off - off[0], lower=True)


def _seeds(words: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(mask, word indices, hashes) of every whole span."""
    block = words.windows(BLOCK)
    n = len(words.hash) - SPAN + 1
    if n <= 0:
        return
    at = np.flatnonzero(words.room()[:n] >= SPAN)
    for m, (a, b) in enumerate(MASKS):
        yield m, at, mix(block[at + BLOCK * a] + mix(block[at + BLOCK * b] + U(m + 1)))


def _whole(words: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    h = words.windows(length)
    at = np.flatnonzero(words.room()[: len(h)] >= length)
    return at, mix(h[at] + U(1000 + length))


def _cut(at: np.ndarray, length: int, words: Words) -> list[bytes]:
    """The hashes of the words of each stretch."""
    return [x.tobytes() for x in words.hash[at[:, None] + np.arange(length)[None, :]]]


def _places(doc: np.ndarray, tag: np.ndarray, position: np.ndarray) -> bytes:
    return np.stack([doc, tag, position.astype(np.int64)]).tobytes()


_MATCHES = "places binary, item_id long, item_places array<long>, n_words long, n_equal long"


def _matches(rows: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    """Verified overlaps: places (of rows), item_id, item_places, n_words, n_equal; the same one may come again under
    another mask."""
    items = texts(benchmark, item_col, item_text_col).withColumnRenamed("doc_id", "item_id")
    spark = rows.sparkSession

    def item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "item_id", "item_position", "item_words"]
        for batch in batches:
            owner = ids(batch.column(0))
            data, off = text_buffers(batch.column(1))
            for lo, hi in slices(off, 1 << 17):
                words = _words(data, off[lo : hi + 1])
                found = [(SPAN, at, key) for _, at, key in _seeds(words)]
                for length in np.unique(words.count[(words.count > 0) & (words.count < SPAN)]).tolist():
                    at, key = _whole(words, length)
                    only = words.count[words.row[at]] == length
                    found.append((length, at[only], key[only]))
                for length, at, key in found:
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(owner[lo + words.row[at]]), pa.array(words.position[at]), pa.array(_cut(at, length, words), pa.binary())], names)

    each = items.mapInArrow(item_seeds, "key long, item_id long, item_position long, item_words binary")
    seeds = settle(each.groupBy("key", "item_id", "item_words").agg(F.sort_array(F.collect_list("item_position")).alias("item_places")))  # of one item
    lengths = sorted(r["n"] for r in seeds.select((F.length("item_words") / 8).cast("int").alias("n")).distinct().collect() if r["n"] < SPAN)  # 11 at most
    slots = power_of_two(256 * seeds.count(), LEAST_SLOTS, MOST_SLOTS)
    shared = spark.sparkContext.broadcast(np.packbits(sketch(seeds.select("key"), slots) > 0))

    def doc_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value

        def known(key):
            at = slot(key.view(np.int64), slots)
            return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)

        for batch in batches:
            doc, tag = ids(batch.column(0)), ids(batch.column(1))
            data, off = text_buffers(batch.column(2))
            for lo, hi in slices(off):
                words = _words(data, off[lo : hi + 1])
                found = [(SPAN, at, key) for _, at, key in _seeds(words)] + [(n, *_whole(words, n)) for n in lengths]
                for length, at, key in found:
                    hit = np.flatnonzero(known(key)) if len(key) else []
                    if not len(hit):
                        continue
                    at, key = at[hit], key[hit]
                    order = np.lexsort((at, words.windows(length)[at], key))  # equal stretches side by side
                    at, key, same = at[order], key[order], words.windows(length)[at[order]]
                    first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (same[1:] != same[:-1])])
                    own = lo + words.row[at]
                    places = [_places(doc[own[a:b]], tag[own[a:b]], words.position[at[a:b]]) for a, b in zip(first, np.r_[first[1:], len(at)], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(key[first].view(np.int64)), pa.array(_cut(at[first], length, words), pa.binary()), pa.array(places, pa.binary())], ["key", "words", "places"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, same = [], []
            for x, y in zip(batch.column(3), batch.column(4), strict=True):
                p, q = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                n.append(len(p))
                same.append(int((p == q).sum()) if len(p) == len(q) else -1)
            out = pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), pa.array(same, pa.int64())], ["places", "item_id", "item_places", "n_words", "n_equal"])
            yield out.filter(pa.array([s >= (k - TOLERANCE if k == SPAN else k) for k, s in zip(n, same, strict=True)], pa.bool_()))

    # Hot keys are split by the adaptive skew join: rows are the large side, each of them a chunk's places.
    hits = rows.select("doc_id", "tag", "text").mapInArrow(doc_seeds, "key long, words binary, places binary").join(seeds, "key")
    return hits.select("places", "item_id", "item_places", "words", "item_words").mapInArrow(verified, _MATCHES)


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Verified overlaps: doc_id, position (word), item_id, item_position, n_words, n_equal. Null ids as NULL_ID."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                doc, _, position = np.frombuffer(batch.column(0)[i].as_buffer(), np.int64).reshape(3, -1)
                where = np.array(batch.column(2)[i].as_py(), np.int64)
                n = len(doc) * len(where)
                rest = [pa.array(np.full(n, batch.column(k)[i].as_py(), np.int64)) for k in (1, 3, 4)]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(doc, len(where))), pa.array(np.repeat(position, len(where))), rest[0], pa.array(np.tile(where, len(doc))), *rest[1:]], ["doc_id", "position", "item_id", "item_position", "n_words", "n_equal"])

    found = _matches(tagged(docs, id_col, text_col), benchmark, item_col, item_text_col)
    return found.mapInArrow(spread, "doc_id long, position long, item_id long, item_position long, n_words long, n_equal long").distinct()


def contaminated_rows(rows: DataFrame, benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """rows: doc_id (no nulls), tag, text, where (doc_id, tag) tells rows apart. One row for each that holds an overlap:
    doc_id, tag, n_overlaps, item_ids, best_equal, first_position."""

    def by_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each place and item."""
        for batch in batches:
            if not batch.num_rows:
                continue
            places = [np.frombuffer(x.as_buffer(), np.int64).reshape(3, -1) for x in batch.column(0)]
            n = [x.shape[1] for x in places]
            doc, tag, position = np.concatenate(places, 1)
            item, equal = (np.repeat(batch.column(k).to_numpy(), n) for k in (1, 4))
            order = np.lexsort((-equal, position, item, tag, doc))
            cols = [x[order] for x in (doc, tag, item, position)]
            new = np.r_[True, np.any([c[1:] != c[:-1] for c in cols], 0)]
            yield pa.RecordBatch.from_arrays([pa.array(c[new]) for c in (*cols, equal[order])], ["doc_id", "tag", "item_id", "position", "n_equal"])

    found = _matches(rows, benchmark, item_col, item_text_col).mapInArrow(by_place, "doc_id long, tag long, item_id long, position long, n_equal long")
    each = found.groupBy("doc_id", "tag", "item_id", "position").agg(F.max("n_equal").alias("best"))
    per_item = each.groupBy("doc_id", "tag", "item_id").agg(F.count("*").alias("n"), F.max("best").alias("best"), F.min("position").alias("first"))
    return per_item.groupBy("doc_id", "tag").agg(F.sum("n").alias("n_overlaps"), F.sort_array(F.collect_list(real_id(F.col("item_id")))).alias("item_ids"), F.max("best").alias("best_equal"), F.min("first").alias("first_position"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **columns: str) -> DataFrame:
    """One row per input row: doc_id, contaminated, n_overlaps (places where an overlap with an item begins), item_ids
    (sorted, of the items found), best_equal (aligned equal words of the best overlap), first_position (word; null
    without overlap)."""
    rows = tagged(docs, id_col, text_col)
    found = contaminated_rows(rows, benchmark, **columns)
    none = F.array().cast("array<long>")
    return rows.select("doc_id", "tag").join(found, ["doc_id", "tag"], "left").select(
        real_id(F.col("doc_id")).alias("doc_id"), F.col("n_overlaps").isNotNull().alias("contaminated"), F.coalesce("n_overlaps", F.lit(0)).alias("n_overlaps"), F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("best_equal", F.lit(0)).alias("best_equal"), "first_position"
    )
