"""Removal of word passages that occur earlier in the corpus, found through difference-cover anchors.

Every window of `window` words whose word sequence also starts earlier (smaller id, or earlier in the same row) is
a repeat, and all words that a repeat covers go. The cover {0, 1, 3, 9} modulo 13 holds, for any two positions, a
common shift below 13 that brings both onto it, so two equal windows always share an aligned anchor of
window - 12 words:

1. anchors are hashed at cover positions only (4 of 13), dealt by hash, and those seen twice go into a filter;
2. around anchors in the filter, matches are extended to whole windows; each chunk of rows marks its own repeats
   and passes on only the first place of each window, so a passage in a third of all rows costs a chunk one entry;
3. the first place over all chunks is found by bucket, and marks (runs of positions) go back to their rows by a join.

The filter follows the input up to a bound; a fuller one means that more windows are compared, and the result stays the
same.

Defined results: a null or empty text has no words and loses none. Null ids sort first. Rows of one id with different
texts are different documents, in the order of a hash of their texts: of a passage that they share, the first keeps
it. Rows that agree in id and text are one document read twice: neither is earlier than the other, and each gets
that document's result. An empty table gives an empty table; other columns take no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .common import buckets_of, power_of_two, real_id, row_hash, tagged, with_marks
from .wordhash import U, Words, ids, join_blobs, mix, slices, split_blobs, text_buffers

PERIOD = 13
COVER = (0, 1, 3, 9)
#: Bounds of the filter for anchors seen twice, in bits.
LEAST_BITS, MOST_BITS = 1 << 22, 1 << 30
CHUNK = 1 << 20
_ON_COVER = np.isin(np.arange(PERIOD), COVER)


def _anchors(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    size = window - PERIOD + 1
    h = words.windows(size)
    n = len(h)
    good = _ON_COVER[words.position[:n] % PERIOD] & (words.room()[:n] >= size) & (words.count[words.row[:n]] >= window)
    at = np.flatnonzero(good)
    return at, h[at]


def _some(h: np.ndarray) -> np.ndarray:
    """Sorted, each value twice at most."""
    h = np.sort(h)
    return h[np.r_[np.ones(min(2, len(h)), bool), h[2:] != h[:-2]]]


def _runs(doc: np.ndarray, tag: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, ...]:
    """Places as runs of neighbours in a row: doc, tag, first, last."""
    order = np.lexsort((pos, tag, doc))
    doc, tag, pos = doc[order], tag[order], pos[order].astype(np.int64)
    new = np.r_[True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (np.diff(pos) > 1)] if len(doc) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(doc)][: len(first)] - 1
    return doc[first], tag[first], pos[first].astype(np.int32), pos[last].astype(np.int32)


def _late(h: np.ndarray, g: np.ndarray, doc: np.ndarray, tag: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the places by window, the first of each window, and which are later than the first of theirs."""
    order = np.lexsort((pos, tag, doc, g, h))
    h, g, doc, tag, pos = h[order], g[order], doc[order], tag[order], pos[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])] if len(h) else np.zeros(0, bool)
    at = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0)) if len(h) else np.zeros(0, np.int64)
    return order, new, (doc != doc[at]) | (tag != tag[at]) | (pos != pos[at])


def _bits(h: np.ndarray, segments: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment and two bits in it."""
    a = mix(h + U(0x51))
    return (h % U(segments)).astype(np.int64), (a % U(bits)).astype(np.int64), ((a >> U(32)) % U(bits)).astype(np.int64)


def removed_passages(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", filter_bits: int | None = None) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_text (kept words joined by one space). filter_bits: by
    default a bit for four bytes of text, within LEAST_BITS and MOST_BITS."""
    if window < PERIOD:
        raise ValueError(f"window must be {PERIOD} words at least")
    rows = tagged(docs, id_col, text_col)
    spark = rows.sparkSession
    buckets = buckets_of(spark)
    if filter_bits is None:
        filter_bits = power_of_two((rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0) // 4, LEAST_BITS, MOST_BITS)
    segment_bits = max(64, filter_bits // buckets)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush():
            out = split_blobs(h := _some(np.concatenate(held)), buckets, h)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["bucket", "blob"])

        for batch in batches:
            data, off = text_buffers(batch.column(0))
            for lo, hi in slices(off):
                held.append(_anchors(Words(data, off[lo : hi + 1]), window)[1])
                if sum(map(len, held)) > CHUNK:
                    yield flush()
        if held:
            yield flush()

    def repeated(key: tuple, table: pa.Table) -> pa.Table:
        (h,) = join_blobs(table.column("blob").to_pylist(), np.uint64)
        h = np.sort(h)
        h = h[1:][h[1:] == h[:-1]]
        seen = np.zeros(segment_bits, bool)
        _, a, b = _bits(h, buckets, segment_bits)
        seen[a] = seen[b] = True
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(seen).tobytes()], pa.binary())})

    found = rows.select("text").mapInArrow(hashes, "bucket int, blob binary").groupBy("bucket").applyInArrow(repeated, "bucket int, bits binary")
    width = (segment_bits + 7) // 8
    filled = np.zeros((buckets, width), np.uint8)
    for r in found.toLocalIterator():  # of filter_bits together, whatever the corpus
        filled[r["bucket"]] = np.frombuffer(r["bits"], np.uint8)
    shared = spark.sparkContext.broadcast(filled.tobytes())

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.frombuffer(shared.value, np.uint8)
        held: list[tuple[np.ndarray, ...]] = []

        def known(h):
            s, a, b = _bits(h, buckets, segment_bits)
            s *= width
            return ((seen[s + (a >> 3)] >> (7 - (a & 7))) & (seen[s + (b >> 3)] >> (7 - (b & 7))) & 1).astype(bool)

        def flush():
            places = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            order, new, late = _late(*places)
            h, g, doc, tag, pos = (x[order] for x in places)
            out = [(0, *x) for x in split_blobs(h[new], buckets, h[new], g[new], doc[new], tag[new], pos[new])]
            runs = _runs(doc[late], tag[late], pos[late])
            out += [(1, *x) for x in split_blobs(row_hash(*runs[:2]), buckets, *runs)]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["kind", "bucket", "blob"])

        for batch in batches:
            doc_ids, tags = ids(batch.column(0)), ids(batch.column(1))
            data, off = text_buffers(batch.column(2))
            for lo, hi in slices(off):
                words = Words(data, off[lo : hi + 1])
                at, h = _anchors(words, window)
                at = at[known(h)] if len(h) else at
                if not len(at):
                    continue
                n = len(words.hash)
                cover = np.zeros(n + 1, np.int64)
                row = words.row[at]
                begin, end = np.maximum(at - PERIOD + 1, words.first[row]), np.minimum(at, words.first[row + 1] - window)
                ok = begin <= end
                np.add.at(cover, begin[ok], 1)
                np.add.at(cover, end[ok] + 1, -1)
                at = np.flatnonzero(np.cumsum(cover[:n]) > 0)
                own = lo + words.row[at]
                held.append((words.windows(window)[at], (words.windows(window, 2)[at] >> U(32)).astype(np.uint32), doc_ids[own], tags[own], words.position[at].astype(np.int32)))
                if sum(len(x[0]) for x in held) > CHUNK:
                    yield flush()
        if held:
            yield flush()

    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Bucket after bucket of a sorted partition; marks leave together, dealt by row, so that their number of rows
        stays that of the partitions and not of the buckets."""
        blobs: list[bytes] = []
        found: list[tuple[np.ndarray, ...]] = []
        now = None

        def close():
            if blobs:
                places = join_blobs(blobs, np.uint64, np.uint32, np.int64, np.int64, np.int32)
                blobs.clear()
                order, _, late = _late(*places)
                found.append(_runs(*(x[order][late] for x in places[2:])))

        def flush():
            runs = [np.concatenate(x) for x in zip(*found, strict=True)]
            found.clear()
            out = split_blobs(row_hash(*runs[:2]), buckets, *runs)
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["bucket", "blob"])

        for batch in batches:
            kinds, where = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, (kind, bucket) in enumerate(zip(kinds, where, strict=True)):
                if kind == 0:
                    if bucket != now:
                        close()
                        now = bucket
                        if sum(len(x[0]) for x in found) > 4 * CHUNK:
                            yield flush()
                    blobs.append(batch.column(2)[i].as_py())
            passed = batch.filter(pa.array([k == 1 for k in kinds]))
            if passed.num_rows:
                yield passed.select(["bucket", "blob"])
        close()
        if found:
            yield flush()

    def of_rows(key: tuple, table: pa.Table) -> pa.Table:
        """One row for each marked row of a bucket."""
        doc, tag, first, last = join_blobs(table.column("blob").to_pylist(), np.int64, np.int64, np.int32, np.int32)
        order = np.lexsort((first, tag, doc))
        doc, tag, runs = doc[order], tag[order], np.stack([first[order], last[order]], 1)
        begin = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])][: len(doc)])
        return pa.table({"doc_id": doc[begin], "tag": tag[begin], "mark": pa.array([runs[a:b].tobytes() for a, b in zip(begin, np.r_[begin[1:], len(doc)], strict=True)], pa.binary())})

    sorted_ = rows.mapInArrow(candidates, "kind int, bucket int, blob binary").repartition("kind", "bucket").sortWithinPartitions("kind", "bucket")
    marks = sorted_.mapInArrow(later, "bucket int, blob binary").groupBy("bucket").applyInArrow(of_rows, "doc_id long, tag long, mark binary")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_buffers(batch.column(1))
            n_words, n_removed, texts_ = [], [], []
            for i, runs in enumerate(batch.column(2).to_pylist()):
                words = data[off[i] : off[i + 1]].tobytes().split()
                n = len(words)
                gone = 0
                if runs:
                    edge = np.zeros(n + 1, np.int64)
                    run = np.frombuffer(b"".join(runs), np.int32).reshape(-1, 2)
                    np.add.at(edge, run[:, 0], 1)
                    np.add.at(edge, run[:, 1] + window, -1)
                    keep = np.cumsum(edge[:n]) == 0
                    gone = n - int(keep.sum())
                    words = list(compress(words, keep.tolist()))
                n_words.append(n)
                n_removed.append(gone)
                texts_.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(texts_, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    out = with_marks(rows, marks).select("doc_id", "text", "marks").mapInArrow(kept, "doc_id long, n_words long, n_removed long, kept_text string")
    return out.select(real_id(F.col("doc_id")).alias("doc_id"), "n_words", "n_removed", "kept_text")
