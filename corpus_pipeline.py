"""A corpus cleaned and packed for training, in five stages.

Each stage works on all rows its predecessor kept and all but the last return the columns of
``documents``. Stages hand over Parquet tables on shared storage, so a lost executor costs
no more than the stage's own tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagecorpus.llm import decontaminate, exact_stream, language, packing, simhash
from pagecorpus.llm.common import is_remainder
from pagecorpus.session import freeze

#: A text in which the best language holds less than this share of the n-grams is in none
#: of the learned languages.
LEAST_FIT = 0.2

#: The stages learn from scans, joins and models, which SQL can't say.
ORACLE_SQL = None

#: Documents per batch between an executor and its Python workers. They are whole texts, so
#: the default of 10,000 holds tens of megabytes several times over in both.
BATCH_ROWS = 500


def _batches(spark: SparkSession) -> None:
    """Set when a stage is planned and left so: its rows are computed after it has returned."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in none of the learned languages, go."""
    _batches(spark)
    filters = language.learn(docs.where(~is_remainder("doc_id", 4, 2)))
    found = language.identify(spark, filters, F.col("text"))
    named = docs.withColumn("_found", found)
    fits = (F.col("_found.lang") != language.UNDETERMINED) & (F.col("_found.fit") >= LEAST_FIT)
    return named.where(fits).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest identifier stays."""
    return exact_stream.drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (0.8 of the five-word shingles) the smallest identifier stays."""
    _batches(spark)
    return simhash.drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    _batches(spark)
    return decontaminate.drop_leaking(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents that are left, in sequences."""
    _batches(spark)
    # The workers also serve the other stages, so they give the encoder's memory back.
    return packing.pack(packing.tokenised(docs, strings=60_000, retain=False))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the packed pieces."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = freeze(docs)
    return docs
