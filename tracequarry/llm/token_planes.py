"""Token ids of a corpus in binary files of bit planes.

A file holds the ids of a range of documents, in ascending order of their ids. Ids lie in blocks of 65,536; a block is
transposed, so that bit 0 of all its ids stands together, then bit 1, and so on (or byte 0, byte 1, ...), and each plane
is compressed with zstandard for itself. Document ids and lengths lie in blocks of the same kind. Records of a file:

    block, newline, block, newline, ..., index, newline

where the index is JSON, {"file", "planes", "docs", "ids", "blocks": [[kind, offset, count, [bytes of each plane]], ...]}
(kinds: `ids`, `doc`, `size`), followed by its length as 8 little-endian bytes and `TQPLANES`. A block of ids begins at
the id whose number is the sum of the counts before it, so any range of ids can be read by its blocks alone.

Spark's own writer writes the files (a record is a row, the newline its separator), so they come under its commit
protocol, a lost executor leaves no half file, and any store that Spark writes to will do. They are read through
`binaryFile`.

A byte-level tokenizer encodes the pieces that its pattern cuts from a text one by one. The texts of a slice are cut by
Arrow, each distinct piece is encoded once by the library's model and remembered by the worker; texts with characters
or white space for which Arrow's expressions differ from the library's go to the library in larger parts.
"""

from __future__ import annotations

import functools
import json
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.functions as F
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window

from .common import bounded_batches, buckets_of, real_id, settle, shared_dir, tagged
from .wordhash import ids as id_values
from .wordhash import slices, text_buffers

BLOCK = 1 << 16
MAGIC = b"TQPLANES"
FILE_BYTES = 1 << 28  # text a file holds on average, at most
REMEMBERED = 500_000  # pieces of either generation
FEW_FILES = 1 << 20  # file totals of 16 bytes that go to each executor; more are joined
#: Letters, digits and ASCII signs, for which the tokenizer's classes are plain; and its pattern for these.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
PLAIN = rf"[ \n!-~{LETTERS}]"
PIECES = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{LETTERS}]+| ?[0-9]+| ?[^\s0-9{LETTERS}]+|\s+(?!\S)|\s+")
ALL_PLAIN = re.compile(f"{PLAIN}+")
#: The same for whole columns of plain characters where no white space stands beside another, so that nothing has to
#: look ahead; and what keeps a text from being one of these.
MARKED = rf"'(?:s|t|re|ve|m|ll|d)| ?[{LETTERS}]+| ?[0-9]+| ?[^\s0-9{LETTERS}]+|\s"
NOT_PLAIN = rf"[^ \n!-~{LETTERS}]|[ \n][ \n]"
MARK = "\0"
#: White space in any sense, so that no cut is made where a library might see a run of it.
BLANK = r"\s\x1c-\x1f\x85᠎"
INNER_SPACE = re.compile(rf"(?<=[^{BLANK}]) (?=[^{BLANK}])")


def _shown() -> dict[int, str]:
    """Byte-level vocabularies show a byte as the character of its number, or, where that has no shape, as the next one
    from 256 on. As a table from the plain characters to their bytes."""
    shapeless = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b != 173)]
    byte = {b: chr(256 + shapeless.index(b)) if b in shapeless else chr(b) for b in range(256)}
    return {c: "".join(byte[b] for b in chr(c).encode()) for c in range(0x250)}


class Encoder:
    """Ids of texts by a tokenizer file. For byte-level BPE without normaliser and post-processor, by pieces that are
    remembered; for any other, by whole texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        made = json.loads(self.tokenizer.to_str())
        cut = made["pre_tokenizer"] or {}
        self.by_piece = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True) and made["model"]["type"] == "BPE" and not made["normalizer"] and not made["post_processor"]
        self.model, self.shown = self.tokenizer.model, _shown()
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        found = self.known.get(piece)
        if found is None:
            found = self.before.get(piece)
            if found is None:
                found = array("I", [t.id for t in self.model.tokenize(piece.translate(self.shown))]).tobytes()
            if len(self.known) >= REMEMBERED:
                self.known, self.before = {}, self.known
            self.known[piece] = found
        return found

    def _text(self, text: str) -> bytes:
        """Cut at single spaces between visible characters, where the tokenizer always begins a new piece."""
        first, *later = INNER_SPACE.split(text)
        return b"".join(map(self._unit, [first, *(f" {x}" for x in later)]))

    def _unit(self, unit: str) -> bytes:
        if ALL_PLAIN.fullmatch(unit):
            return b"".join(map(self._piece, PIECES.findall(unit)))
        return array("I", self.tokenizer.encode(unit, add_special_tokens=False).ids).tobytes()

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, ids of each row)."""
        if not self.by_piece:
            found = [x.ids for x in self.tokenizer.encode_batch(column.to_pylist(), add_special_tokens=False)]
            return np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64)
        other = pc.match_substring_regex(column, NOT_PLAIN)
        words = pc.split_pattern(pc.replace_substring_regex(pc.if_else(other, "", column), MARKED, rf"{MARK}\0"), MARK)
        pieces = words.flatten().dictionary_encode()
        blobs = list(map(self._piece, pieces.dictionary.to_pylist()))
        code = pieces.indices.to_numpy(zero_copy_only=False)
        size = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        begin = np.cumsum(size) - size
        odd = np.flatnonzero(other.to_numpy(zero_copy_only=False))
        if len(odd):
            code = code.copy()
            code[begin[odd]] = len(blobs) + np.arange(len(odd), dtype=code.dtype)  # such a row is one empty piece so far
            blobs += map(self._text, column.take(pa.array(odd)).to_pylist())
        found = pa.array(blobs, pa.large_binary()).take(pa.array(code))
        data, ends = text_buffers(found)
        return data.view(np.uint32), np.diff(ends[np.append(begin, len(code))]) // 4


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def to_planes(values: np.ndarray, planes: str = "bit") -> list[bytes]:
    """Unsigned values as planes, lowest first, as many as the largest value needs; each compressed."""
    raw = values.astype(values.dtype.newbyteorder("<")).view(np.uint8).reshape(len(values), values.itemsize)
    bits = int(values.max()).bit_length() if len(values) else 0
    raw = raw[:, : -(-bits // 8)]
    if planes == "bit":
        raw = np.packbits(np.ascontiguousarray(np.unpackbits(raw, axis=1, bitorder="little")[:, :bits].T), axis=1)
    else:
        raw = raw.T
    pack = zstandard.ZstdCompressor(level=3)
    return [pack.compress(np.ascontiguousarray(x)) for x in raw]


def from_planes(blobs: list[bytes], n: int, dtype: type, planes: str = "bit") -> np.ndarray:
    unpack = zstandard.ZstdDecompressor()
    width = np.dtype(dtype).itemsize
    raw = np.zeros((n, width), np.uint8)
    rows = [np.frombuffer(unpack.decompress(x), np.uint8) for x in blobs]
    if rows and planes == "bit":
        bits = np.unpackbits(np.stack(rows), axis=1, count=n)
        for at in range(0, len(bits), 8):
            raw[:, at // 8] = np.bitwise_or.reduce([x << i for i, x in enumerate(bits[at : at + 8])])
    elif rows:
        raw[:, : len(rows)] = np.stack(rows, axis=1)
    return raw.reshape(-1).view(np.dtype(dtype).newbyteorder("<"))


class _File:
    """Records of one file, in the order in which they are written."""

    def __init__(self, number: int, planes: str):
        self.number, self.planes, self.at, self.blocks = number, planes, 0, []
        self.pending: list[np.ndarray] = []
        self.waiting = self.docs = self.ids = 0
        self.doc: list[np.ndarray] = []
        self.size: list[np.ndarray] = []

    def _block(self, kind: str, values: np.ndarray) -> bytes:
        parts = to_planes(values, self.planes)
        self.blocks.append([kind, self.at, len(values), [len(x) for x in parts]])
        record = b"".join(parts)
        self.at += len(record) + 1
        return record

    def add(self, doc: np.ndarray, size: np.ndarray, ids: np.ndarray) -> Iterator[bytes]:
        self.doc.append(doc)
        self.size.append(size)
        self.docs += len(doc)
        self.ids += len(ids)
        self.pending.append(ids)
        self.waiting += len(ids)
        if self.waiting >= BLOCK:
            whole = np.concatenate(self.pending)
            last = len(whole) - len(whole) % BLOCK
            for a in range(0, last, BLOCK):
                yield self._block("ids", whole[a : a + BLOCK])
            self.pending, self.waiting = [whole[last:]], len(whole) - last
        if sum(map(len, self.doc)) >= BLOCK:
            yield from self._table()

    def _table(self) -> Iterator[bytes]:
        doc, size = np.concatenate(self.doc), np.concatenate(self.size)
        for a in range(0, len(doc), BLOCK):
            yield self._block("doc", doc[a : a + BLOCK].view(np.uint64))
            yield self._block("size", size[a : a + BLOCK].view(np.uint64))
        self.doc, self.size = [], []

    def end(self) -> Iterator[bytes]:
        if self.waiting:
            yield self._block("ids", np.concatenate(self.pending))
        if self.doc:
            yield from self._table()
        index = json.dumps({"file": self.number, "planes": self.planes, "docs": self.docs, "ids": self.ids, "blocks": self.blocks}).encode()
        yield index + len(index).to_bytes(8, "little") + MAGIC


def index_of(content: memoryview) -> dict:
    """The index of a file; an error if the file isn't whole."""
    tail = bytes(content[-17:])
    if tail[8:16] != MAGIC:
        raise ValueError("not a whole file of token planes")
    n = int.from_bytes(tail[:8], "little")
    return json.loads(bytes(content[-17 - n : -17]))


def written(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", planes: str = "bit") -> None:
    """Write the ids of all whole texts (null: empty) into files under path, each document's followed by end_id. Files
    and documents in them ascend by document id; rows of one id follow a hash of their text, equal rows their place in
    the input; null ids come first. tokenizer is a file of the tokenizers library that workers can read."""
    rows = tagged(docs, id_col, text_col).select("doc_id", "tag", F.monotonically_increasing_id().alias("place"), F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n_files = max(buckets_of(docs.sparkSession, 1), -(-total // FILE_BYTES))
    order = ["doc_id", "tag", "place"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, encode = _File(TaskContext.get().partitionId(), planes), encoder(tokenizer).encode
        for batch in batches:
            doc, (_, off) = id_values(batch.column(0)), text_buffers(batch.column(1))
            for lo, hi in slices(off, 1 << 23):
                ids, size = encode(batch.column(1).slice(lo, hi - lo))
                ids = np.insert(ids, np.cumsum(size), np.uint32(end_id))
                for record in out.add(doc[lo:hi], size + 1, ids):
                    yield pa.RecordBatch.from_arrays([pa.array([record], pa.binary())], ["record"])
        if out.docs:
            for record in out.end():
                yield pa.RecordBatch.from_arrays([pa.array([record], pa.binary())], ["record"])

    dealt = rows.repartitionByRange(n_files, *order).sortWithinPartitions(*order).select("doc_id", "text")
    dealt.mapInArrow(write, "record binary").select(F.col("record").cast("string").alias("value")).write.text(path)


def chunk_index(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of ids of all files: file, name, block, first (number of its first id in the file), n_ids, offset and
    n_bytes in the file. An empty folder has no rows."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                index = index_of(memoryview(content.as_buffer()))
                blocks = [x for x in index["blocks"] if x[0] == "ids"]
                n = [x[2] for x in blocks]
                yield pa.RecordBatch.from_pydict({
                    "file": pa.array([index["file"]] * len(n), pa.int32()), "name": pa.array([name] * len(n), pa.string()), "block": pa.array(range(len(n)), pa.int32()), "first": pa.array(np.cumsum([0, *n])[: len(n)], pa.int64()),
                    "n_ids": pa.array(n, pa.int64()), "offset": pa.array([x[1] for x in blocks], pa.int64()), "n_bytes": pa.array([sum(x[3]) for x in blocks], pa.int64()),
                })

    return _files(spark, path).select("path", "content").mapInArrow(read, "file int, name string, block int, first long, n_ids long, offset long, n_bytes long")


def _files(spark: SparkSession, path: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.format("binaryFile").load(path).where("length > 0")


def file_starts(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, n_files): ids of all files before each. Files stand in blocks of the root of their number, so that
    neither level of the running sum puts all of them in one task."""
    totals = settle(chunk_index(spark, path).groupBy("file").agg(F.sum("n_ids").alias("n_ids")))
    n = totals.count()
    side = max(1, int(n**0.5))
    dealt = totals.withColumn("block", F.floor(F.col("file") / side))
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = dealt.groupBy("block").agg(F.sum("n_ids").alias("n_ids"))
    blocks = blocks.select("block", before(Window.orderBy("block")).alias("earlier"))
    inside = dealt.select("file", "block", before(Window.partitionBy("block").orderBy("file")).alias("inside"))
    return inside.join(F.broadcast(blocks), "block").select("file", (F.col("earlier") + F.col("inside")).alias("start"), F.lit(n).alias("n_files"))


def documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Documents read back from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of its
    ids as little-endian 32-bit integers), and with_ids the ids. A damaged file is an error."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                view = memoryview(content.as_buffer())
                index = index_of(view)
                blocks: dict[str, list] = {"ids": [], "doc": [], "size": []}
                for kind, at, n, parts in index["blocks"]:
                    blocks[kind].append((at, n, parts))

                def values(block, dtype, view=view, planes=index["planes"]):
                    at, n, parts = block
                    ends = at + np.cumsum([0, *parts])
                    return from_planes([bytes(view[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], n, dtype, planes)

                held, held_at, todo = np.zeros(0, np.uint32), 0, iter(blocks["ids"])
                at = 0
                for d, s in zip(blocks["doc"], blocks["size"], strict=True):
                    doc, size = values(d, np.uint64).view(np.int64), values(s, np.uint64).view(np.int64)
                    start = at + np.cumsum(size) - size
                    for lo in range(0, len(doc), 1000):
                        crc, ids = [], []
                        for a, n in zip(start[lo : lo + 1000].tolist(), size[lo : lo + 1000].tolist(), strict=True):
                            if a + n > held_at + len(held):
                                parts, have = [held[a - held_at :]], held_at + len(held) - a
                                while have < n:
                                    parts.append(values(next(todo), np.uint32))
                                    have += len(parts[-1])
                                held, held_at = np.concatenate(parts), a
                            mine = held[a - held_at : a - held_at + n]
                            crc.append(zlib.crc32(mine.tobytes()))
                            if with_ids:
                                ids.append(mine.astype(np.int32))
                        out = [pa.array([index["file"]] * len(crc), pa.int32()), pa.array(doc[lo : lo + 1000]), pa.array(start[lo : lo + 1000]), pa.array(size[lo : lo + 1000]), pa.array(crc, pa.int64())]
                        yield pa.RecordBatch.from_arrays([*out, *([pa.array(ids, pa.list_(pa.int32()))] if with_ids else [])], names)
                    at += int(size.sum())

    names = ["file", "doc_id", "inside", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
    schema = "file int, doc_id long, inside long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    starts = settle(file_starts(spark, path))
    head = starts.select("n_files").first()
    starts = starts.select("file", "start")
    if head is None or head["n_files"] <= FEW_FILES:
        starts = F.broadcast(starts)
    out = _files(spark, path).select("content").mapInArrow(read, schema).join(starts, "file")
    return out.select(real_id(F.col("doc_id")).alias("doc_id"), (F.col("start") + F.col("inside")).alias("start"), *names[3:])


def stored(docs: DataFrame, tokenizer: str, **how) -> tuple[DataFrame, str]:
    """written() into a new place in the shared folder, and documents() of it: (documents, place). Rows with null, empty
    or repeated ids or texts are documents like any others; an empty table has no files and no rows. Other columns of
    docs may have any names."""
    path = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    written(docs, tokenizer, path, **how)
    return documents(docs.sparkSession, path), path
