"""Removal of lines that many rows share, with two Bloom filters in front of the exact count.

Keys are lines without ASCII white space at their ends, A-Z in lower case. A first pass sets each row's distinct
keys of at least `min_chars` code points in a once-seen filter, and what it finds there already in a twice-seen one.
Only keys that the twice-seen filter holds are shuffled, as 128-bit hashes, for the exact count of rows and the
largest id. Keys in `min_rows` rows or more lose all their lines but those in the row of the largest id.

The filters have a size bound (`max_bits`); beyond it more keys are shuffled and the result stays the same. Keys to
drop go back to their rows by a join.

Defined results: a null or empty text is one empty line. Null ids take part in the counts and never hold a key's last
copy, unless all its ids are null. Repeated rows count one by one; all rows of a keeper's id keep the line. An empty
table gives an empty table; other columns take no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import xxhash
from pyspark.sql import DataFrame

from .common import real_id, settle, tagged, with_marks
from .wordhash import ids, text_buffers

MAX_BITS = 1 << 28
SEGMENTS = 64
CHUNK = 1 << 18
FLUSH = 1 << 16


def line_keys(text: bytes, min_chars: int) -> list[bytes | None]:
    """The key of each line; None where it is too short to count."""
    out: list[bytes | None] = []
    for line in text.split(b"\n"):
        key = line.strip()
        if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
            out.append(None)
        else:
            out.append(key.lower())
    return out


def _hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def shared_lines_removed(docs: DataFrame, min_rows: int = 5, min_chars: int = 40, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, carry: bool = False) -> DataFrame:
    """One row per input row: doc_id (with carry: the whole row as the struct `row`), n_lines (before), n_dropped,
    kept_text."""
    rows = tagged(docs, id_col, text_col)
    spark = rows.sparkSession
    bits = min(max_bits, max(1 << 20, 1 << (64 * docs.count()).bit_length()))
    width = bits // SEGMENTS

    def places(digests: list[bytes]) -> np.ndarray:
        """Two bits of each key."""
        h = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2) % np.uint64(bits)
        return h.astype(np.int64)

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests: list[bytes] = []

        def flush():
            at = np.sort(places(digests).ravel()).astype(np.uint32)
            digests.clear()
            new = np.r_[True, at[1:] != at[:-1]]
            again = np.unique(at[~new])
            once = at[new]
            out = []
            for kind, x in ((0, once), (1, again)):
                seg = (x // width).astype(np.int64)
                cuts = np.searchsorted(seg, np.arange(SEGMENTS + 1))
                out += [(s, kind, x[cuts[s] : cuts[s + 1]].tobytes()) for s in range(SEGMENTS) if cuts[s] < cuts[s + 1]]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["segment", "kind", "places"])

        for batch in batches:
            data, off = text_buffers(batch.column(0))
            raw = data.tobytes()
            for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                keys = set(line_keys(raw[a:b], min_chars))
                keys.discard(None)
                digests.extend(map(_hash, keys))
                if len(digests) > CHUNK:
                    yield flush()
        if digests:
            yield flush()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Once and twice of a segment: what once holds already goes to twice."""
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for s, kind, x in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                once, twice = held.setdefault(s, (np.zeros(width, bool), np.zeros(width, bool)))
                at = np.frombuffer(x, np.uint32).astype(np.int64) - s * width
                if kind:
                    twice[at] = True
                else:
                    twice[at[once[at]]] = True
                    once[at] = True
        for s, (_, twice) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([np.packbits(twice).tobytes()], pa.binary())], ["segment", "bits"])

    filled = np.zeros((SEGMENTS, width // 8), np.uint8)
    for r in rows.select("text").mapInArrow(first_pass, "segment int, kind int, places binary").repartition(SEGMENTS, "segment").mapInArrow(merged, "segment int, bits binary").toLocalIterator():
        filled[r["segment"]] = np.frombuffer(r["bits"], np.uint8)
    twice_seen = spark.sparkContext.broadcast(filled.tobytes())

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.frombuffer(twice_seen.value, np.uint8)
        for batch in batches:
            data, off = text_buffers(batch.column(2))
            raw = data.tobytes()
            digests: list[bytes] = []
            owner: list[int] = []

            def flush():
                at = places(digests)
                hit = ((seen[at >> 3] >> (7 - (at & 7))) & 1).all(1)
                key = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)[hit]
                own = pa.array(np.array(owner, np.int64)[hit])
                digests.clear()
                owner.clear()
                return pa.RecordBatch.from_arrays([pa.array(key[:, 0]), pa.array(key[:, 1]), batch.column(0).take(own), batch.column(1).take(own)], ["k1", "k2", "doc_id", "tag"])

            for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
                keys = set(line_keys(raw[a:b], min_chars))
                keys.discard(None)
                digests.extend(map(_hash, keys))
                owner.extend([i] * len(keys))
                if len(digests) > FLUSH:
                    yield flush()
            if digests:
                yield flush()

    suspected = settle(rows.mapInArrow(suspects, "k1 long, k2 long, doc_id long, tag long"))
    drop = suspected.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_rows).select("k1", "k2", "keeper")
    mine = suspected.join(drop, ["k1", "k2"]).where(F.col("doc_id") != F.col("keeper")).select("doc_id", "tag", "k1", "k2")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The keys of a row side by side, as far as they come together."""
        for batch in batches:
            if not batch.num_rows:
                continue
            doc, tag, k1, k2 = (c.to_numpy() for c in batch.columns)
            order = np.lexsort((tag, doc))
            doc, tag, key = doc[order], tag[order], np.stack([k1, k2], 1)[order]
            begin = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])])
            blobs = [key[a:b].tobytes() for a, b in zip(begin, np.r_[begin[1:], len(doc)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(doc[begin]), pa.array(tag[begin]), pa.array(blobs, pa.binary())], ["doc_id", "tag", "mark"])

    marks = settle(mine.distinct().mapInArrow(packed, "doc_id long, tag long, mark binary"))

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column(1)
            data, off = text_buffers(given.field(text_col) if carry else given)
            raw = data.tobytes()
            n_lines, n_dropped, kept = [], [], []
            for a, b, own in zip(off[:-1].tolist(), off[1:].tolist(), batch.column(2).to_pylist(), strict=True):
                text = raw[a:b]
                lines = text.split(b"\n")
                n_lines.append(len(lines))
                gone: list[bool] = []
                if own:
                    x = b"".join(own)
                    dropped = {x[j : j + 16] for j in range(0, len(x), 16)}
                    gone = [k is not None and _hash(k) in dropped for k in line_keys(text, min_chars)]
                n_dropped.append(sum(gone))
                kept.append(b"\n".join([x for x, g in zip(lines, gone, strict=True) if not g]) if n_dropped[-1] else text)
            first = given if carry else batch.column(0)
            yield pa.RecordBatch.from_arrays([first, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["row" if carry else "doc_id", "n_lines", "n_dropped", "kept_text"])

    whole = tagged(docs, id_col, text_col, whole=True) if carry else rows
    payload = "row" if carry else "text"
    kind = f"row {whole.schema['row'].dataType.simpleString()}" if carry else "doc_id long"
    out = with_marks(whole, marks).select("doc_id", payload, "marks").mapInArrow(cleaned, f"{kind}, n_lines long, n_dropped long, kept_text string")
    return out if carry else out.withColumn("doc_id", real_id(F.col("doc_id")))
