"""The corpus pipeline: from raw documents to packed token windows.

Every stage reads what its predecessor kept, written as Parquet; all but the last return the columns
of documents. ``STAGES`` lists them in order, ``run`` applies them to the table documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import line_dedup, minhash, packing, quality_rules, surrogates
from tesserae.llm.session import cut, hashed_semi

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SURROGATE_KEY = "corpus-pipeline"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules reject go."""
    rejected = cut(quality_rules.judge(docs, keep_columns=["doc_id"]).where("NOT kept").select("doc_id").distinct())
    maybe, sure = hashed_semi(docs, "doc_id", rejected, "doc_id")
    return sure.unionByName(maybe.join(rejected, "doc_id", "left_anti").select(docs.columns)).select(COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fuzzy repeated lines go, but for one occurrence each."""
    return line_dedup.deduplicate(docs).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    gone = cut(minhash.near_duplicates(docs).where("NOT kept").select("doc_id"))
    maybe, sure = hashed_semi(docs, "doc_id", gone, "doc_id")
    return sure.unionByName(maybe.join(gone, "doc_id", "left_anti").select(docs.columns)).select(COLUMNS)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by surrogates."""
    return surrogates.replace(docs, SURROGATE_KEY).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows of near-equal fill."""
    return packing.windows(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("minhash", near), ("surrogates", private), ("packing", pack)]

#: Connected components, keyed ciphers and token packing can't be written in SQL; tests/llm/test_operators.py runs all stages but packing on a small fixture.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
