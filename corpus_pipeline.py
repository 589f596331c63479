"""A training-corpus pipeline over `documents`: five operators one after another, each stage written and read again.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last keep the columns of `documents`, and any
other column beside them. A stage decides on rows, not on ids: rows of one id, or without an id, are judged each by its
own text, and no row goes because of another that shares its id. Repeated rows are near copies of each other, so one of
them stays. Null and empty texts are never toxic, never near copies and never contaminated; they stay to the end.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from tracequarry.llm import byte_bpe, decontaminate, line_dedup, near_dedup, toxicity
from tracequarry.llm.common import NULL_ID, keyed, settle, tagged
from tracequarry.llm.queries import tokenizer


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.scored(docs, labels, carry=True).where("predicted = 0").select("row.*")


def without_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five rows or more share stay in one; n_chars follows the text."""
    out = line_dedup.shared_lines_removed(docs, carry=True)
    text = F.when(F.col("row.text").isNotNull(), F.col("kept_text"))
    row = F.col("row").withField("text", text)
    if "n_chars" in docs.columns:
        n = F.when(F.col("n_dropped") > 0, F.length(text)).otherwise(F.col("row.n_chars"))
        row = row.withField("n_chars", n.cast(docs.schema["n_chars"].dataType))
    return out.select(row.alias("row")).select("row.*")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near-duplicates (word shingles, similarity of 0.8 or more) stays: the first."""
    rows = keyed(docs)
    found = near_dedup.row_components(rows.select(F.coalesce(F.col("row.doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col("key").alias("tag"), F.col("row.text").alias("text")), percent=80)
    later = found.where((F.col("doc_id") != F.col("first_id")) | (F.col("tag") != F.col("first_tag"))).select(F.col("tag").alias("key"))
    return rows.join(later, "key", "left_anti").select("row.*")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold benchmark passages go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contaminated_rows(tagged(docs), benchmark).select("doc_id", "tag")
    return tagged(docs, whole=True).join(found, ["doc_id", "tag"], "left_anti").select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left."""
    return byte_bpe.encoded(docs, *tokenizer()).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [("toxicity", without_toxic), ("line_dedup", without_shared_lines), ("near_dedup", without_near_copies), ("decontaminate", without_benchmark), ("byte_bpe", tokens)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = settle(docs)
    return docs
