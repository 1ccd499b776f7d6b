"""From documents to packed batches: toxicity, near duplicates, benchmark passages, personal data, packing.

Every stage takes what its predecessor kept, with all columns of documents, and each but the last returns these
columns. Rows with null texts or ids pass through the first four stages unless their duplicates class says otherwise;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm.common import read_table, written
from ledgerlake.llm.decontaminate import decontaminate
from ledgerlake.llm.near_dedup import keep_one_of_each
from ledgerlake.llm.packing import pack
from ledgerlake.llm.pii import redact
from ledgerlake.llm.toxicity import learned, scorer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5; the model learns from the labelled documents that aren't held out."""
    toxic = scorer(spark, learned(spark, sf_dir))(F.col("text"))
    return docs.where(toxic < 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    return keep_one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages: passages are cut out, and documents that are mostly passages go."""
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind in brackets."""
    return redact(docs)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, text and its place: n_tokens, bucket, bucket_tokens, batch, place."""
    return pack(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("pii", mask_personal_data),
    ("packing", pack_batches),
]
#: The stages learn models and link by hashes, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
