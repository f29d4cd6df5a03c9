"""A training corpus from raw documents, in stages.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet
in the shared folder and read again as the next one's ``docs``. All but the last
return the columns of ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from msgtriage.llm import dart_minhash, exact_dedup, language_id, packing, quality
from msgtriage.llm.common import fresh, materialize

#: Documents whose language is less certain than this go.
LEAST_CERTAIN = 0.4
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by importance resampling towards the labelled good ones."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network can tell."""
    model = language_id.LanguageModel.fit(docs)
    found = fresh(docs, "found")
    told = docs.withColumn(found, model.column(F.col("text")))
    sure = (F.col(f"{found}.lang_pred") != language_id.UNDETERMINED) & (F.col(f"{found}.score") >= LEAST_CERTAIN)
    return told.where(sure).select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the largest id."""
    return exact_dedup.drop_exact_copies(docs, keep="largest")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return dart_minhash.keep_one_of_each(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096 ids."""
    with open(TOKENIZER, encoding="utf-8") as file:
        tokens = packing.Tokens(file.read())
    return packing.pack(docs, tokens)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("language_id", language),
    ("exact_dedup", exact_copies),
    ("minhash_near_dedup", near_copies),
    ("packing", packed),
]

#: The stages learn models and sketch texts, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
