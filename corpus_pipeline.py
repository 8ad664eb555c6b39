"""A corpus from documents to packed sequences: quality, near duplicates, secrets, mixture, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept; run() writes each one's result as
Parquet into the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skeinrank.llm import minhash_dedup, mixing, packing, quality, secrets
from skeinrank.llm._common import materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays: that with the smallest id."""
    return minhash_dedup.keep_first(docs, percent=80)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars follows the text."""
    from pyspark.sql import functions as F

    clean = secrets.redact(docs, secrets.fit(secrets.labelled_values()))
    return clean.withColumn("n_chars", F.when(F.col("text").contains("[SECRET]"), F.length("text").cast(clean.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the fitted mixture says: clean ones at least once, toxic and junk ones seldom."""
    mixture, _ = mixing.fit_mixture(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mixing.apply_mixture(docs, mixture)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in sequences of 1024 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("secret scans", secrets_stage),
    ("mixing to target weights", mixing_stage),
    ("packing", packing_stage),
]

#: The models and the packing cannot be written as SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs, _ = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
