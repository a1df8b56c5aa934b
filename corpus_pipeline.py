"""The corpus pipeline: from raw documents to sampled token ids.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns a DataFrame that is written as Parquet and read again as the docs of
the next. All but the last return the columns of documents.

Each stage judges rows, whatever ids they share or lack; null texts pass or fail by
the rules that the operators state; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import decontaminate, quality_rules, sampling, simhash
from docketry.llm.common import ready, table
from docketry.llm.queries import GOOD_ENOUGH, PIECES, quality_model_of, tokenizer_path
from docketry.session import work_folder


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    ready(spark)
    model = quality_model_of(spark, docs, sf_dir)
    return docs.where(model.score(docs, F.col("text")) >= GOOD_ENOUGH)


def keep_regular(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without lines above the limits."""
    ready(spark)
    cleaned = quality_rules.clean_documents(docs)
    return cleaned.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of the smallest id."""
    ready(spark)
    return simhash.drop_near_duplicates(docs)


def keep_unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with benchmark items."""
    ready(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every document, with the check of decoding them.

    The samples are stored before they are decoded: in one stage, each task would hold a
    Python worker for either, beside a heap that the stages before have filled.
    """
    ready(spark)
    path, samples = tokenizer_path(PIECES), work_folder(spark, "pipeline-samples")
    sampling.encode(docs, path, samples=2).write.parquet(samples)
    encoded = spark.read.parquet(samples)
    return encoded.withColumn(
        "decoded_crc32", F.crc32(sampling.decode(spark, F.col("ids"), path))
    )


STAGES = [
    ("quality_classifier", keep_good),
    ("quality_rules", keep_regular),
    ("simhash_near_dedup", keep_one_of_each),
    ("benchmark_decontamination", keep_unseen),
    ("sentencepiece", encode),
]

# A trained network and a sampler have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents."""
    ready(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = work_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
