"""A training-data pipeline over ``documents``: toxicity, line dedup, near-dedup, decontamination, tokens.

Each stage gets what its predecessor kept, written as Parquet and read again; all but the last return the columns of
``documents``. SQL can't express the stages' models and searches, so ORACLE_SQL is None and tests compare with
brute-force versions.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitlens.llm import bpe, decontam, linedup, simhash, toxicity
from visitlens.llm.shared import discard, small_batches, write_table

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5 stay; null and empty texts score as texts without words, each row by itself."""
    small_batches(spark)
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_toxicity(docs, model).where("predicted = 0").select(docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Common lines go from all documents but the latest; n_chars follows; documents that had text and have none left go."""
    small_batches(spark)
    kept = linedup.line_dedup(docs, stored=True)
    changed = kept.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return changed.where("n_dropped = 0 or text <> ''").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group stays (five-word shingles, similarity 0.8)."""
    small_batches(spark)
    return simhash.near_dedup(docs, width=5, similarity=0.8, stored=True)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks stay; null and empty texts and repeated rows stay as they are."""
    small_batches(spark)
    return decontam.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token count and digests of every document that is left; a null or empty text has no tokens."""
    small_batches(spark)
    return bpe.encode_texts(docs, ranks_path=public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("byte-level BPE encoding and decoding", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        kept = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            kept = write_table(kept, f"stage-{i}")
            if i:  # never the given table
                discard(docs)
        docs = kept
    return docs
