"""What the corpus operators share: shared folders, bucket counts, broadcast checks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Observation, SparkSession

from .wordhash import NULL_ID, U, ids, mix

SEGMENTS = 64


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Only in local mode, where all of Spark is
    one process, one of our own if that is unset; on a cluster a missing setting is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: its lineage ends there, and lost executors cost nothing."""
    return _written(df)[0]


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


class Scratch:
    """Settled steps of one run, all removed at the end of a with block: what is returned from it must be settled
    outside."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def settle(self, df: DataFrame) -> DataFrame:
        out, path = _written(df)
        self.paths.append(path)
        return out

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for x in self.paths:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(x)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def buckets_of(spark: SparkSession, factor: int = 4) -> int:
    """Buckets for packed exchanges, a multiple of the partitions that the cluster gives a shuffle."""
    return factor * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def bounded_batches(spark: SparkSession) -> None:
    """Batches of 1,000 rows to Python where the session keeps Spark's 10,000: whole texts make large batches, and a
    worker holds several copies of one."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just id and text under fixed names, so that other columns can clash with nothing."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def tagged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """doc_id (null: NULL_ID), tag (a hash of the text), and the text, or with whole the row as a struct, so that what is
    added can clash with none of its columns. Rows of one id are told apart by the tag; rows that agree in both are one
    row read twice, and whatever is found for one holds for the other."""
    bounded_batches(docs.sparkSession)
    text = F.col(text_col).cast("string")
    payload = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row") if whole else text.alias("text")
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("tag"), payload)


def real_id(column: Column) -> Column:
    """NULL_ID as null again."""
    return F.when(column != NULL_ID, column)


def keyed(docs: DataFrame) -> DataFrame:
    """(key, row), settled: a key of its own for each row, and the whole row as a struct."""
    bounded_batches(docs.sparkSession)
    return settle(docs.select(F.monotonically_increasing_id().alias("key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")))


def crc_mod(column: Column, n: int) -> Column:
    return F.crc32(column.cast("string").cast("binary")) % n


def power_of_two(n: int, least: int, most: int) -> int:
    """The first power of two from n on, within bounds that are powers of two."""
    return min(most, max(least, 1 << max(0, n - 1).bit_length()))


def sketch(keys: DataFrame, slots: int, most: int = 255) -> np.ndarray:
    """Counts of a long column by slot(key), each up to most. slots bounds what reaches the driver."""
    width = slots // SEGMENTS
    kind = np.uint8 if most < 256 else np.uint16

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush():
            at, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            n = np.minimum(n, most).astype(kind)
            cuts = np.searchsorted(at // width, np.arange(SEGMENTS + 1))
            out = [(s, (at[a:b] - s * width).astype(np.uint32).tobytes(), n[a:b].tobytes()) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())], ["segment", "places", "counts"])

        for batch in batches:
            held.append(slot(batch.column(0).to_numpy(zero_copy_only=False), slots))
            if sum(map(len, held)) > 1 << 20:
                yield flush()
        if held:
            yield flush()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, at, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                t = total.setdefault(s, np.zeros(width, np.int64))
                at = np.frombuffer(at, np.uint32)
                t[at] = np.minimum(t[at] + np.frombuffer(n, kind), most)
        for s, t in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([t.astype(kind).tobytes()], pa.binary())], ["segment", "counts"])

    out = np.zeros((SEGMENTS, width), kind)
    for r in keys.mapInArrow(partial, "segment int, places binary, counts binary").repartition(SEGMENTS, "segment").mapInArrow(merged, "segment int, counts binary").toLocalIterator():
        out[r["segment"]] = np.frombuffer(r["counts"], kind)
    return out.ravel()


def slot(keys: np.ndarray, slots: int) -> np.ndarray:
    return (mix(keys.astype(np.int64).view(U) + U(0x5107)) % U(slots)).astype(np.int64)


def row_hash(doc: np.ndarray, tag: np.ndarray) -> np.ndarray:
    return mix(doc.view(U) + mix(tag.view(U)))


def with_marks(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """rows (doc_id, tag, more) with a column `marks`: the array of what marks (doc_id, tag, mark binary) holds for each,
    null for none. Spark takes marks to the rows while they are few, and sorts both sides by row beyond that; either
    way no group is larger than a row's own marks."""
    per_row = marks.groupBy("doc_id", "tag").agg(F.collect_list("mark").alias("marks"))
    return rows.join(per_row, ["doc_id", "tag"], "left").select(*rows.columns, "marks")


def components(edges: DataFrame, a: str = "a", b: str = "b", settle: Callable[[DataFrame], DataFrame] = settle) -> DataFrame:
    """(node, component): the smallest node that each node of an edge reaches. Labels spread along edges and jump
    to their own label's label, so the rounds grow with the logarithm of the longest path."""
    both = settle(edges.select(F.col(a).alias("node"), F.col(b).alias("other")).union(edges.select(b, a)).distinct())
    labels = settle(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), F.col("component").alias("c")), "other").groupBy("node").agg(F.min("c").alias("c"))
        step = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "c").alias("c"))
        jump = labels.select(F.col("node").alias("c"), F.col("component").alias("further"))
        seen = Observation()
        found = step.join(jump, "c").select("node", "old", F.least("c", "further").alias("component"))
        labels = settle(found.observe(seen, F.count_if(F.col("old") != F.col("component")).alias("changed")).select("node", "component"))
        if not seen.get["changed"]:
            return labels
