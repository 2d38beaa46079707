"""Corpus pipeline: quality rules, toxicity, near-duplicates, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fablework.llm import byte_bpe, mixing, near_dedup, quality_rules, toxicity
from fablework.llm.common import materialise, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SHINGLE_WORDS = 5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality rules reject; failed lines leave the others, n_chars follows."""
    kept = quality_rules.clean(docs.select(COLUMNS))
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(COLUMNS)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents scored toxic by the classifier learned on this stage's labelled documents."""
    scored = toxicity.classify(docs.select(COLUMNS), table(spark, sf_dir, "labels"))
    return scored.where("score < 0.5").select(COLUMNS)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near-duplicates: the one with the smallest doc_id, nulls above all others.

    Rows are numbered for the while, so rows that repeat a doc_id are judged each by its own text.
    """
    docs = materialise(docs.select(COLUMNS).withColumn("__row", F.monotonically_increasing_id()), "rows")
    found = near_dedup.near_duplicates(docs, SHINGLE_WORDS, id_col="__row").select(F.col("doc_id").alias("__row"), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")).alias("first")
    kept = materialise(found.join(docs.select("__row", "doc_id"), "__row").groupBy("component_id").agg(first).select("first.__row"), "kept")
    return docs.join(kept, "__row", "left_semi").select(COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents so that each source comes near its target weight."""
    return mixing.mixed(docs.select(COLUMNS))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with their digests and the offsets for decoding."""
    import public_tokenizers

    return byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [
    ("quality_rules", quality),
    ("toxicity", toxic),
    ("near_dedup", near_duplicate),
    ("mixing", mixed),
    ("byte_bpe", encoded),
]

#: The classifier, the components and the rounding are no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
