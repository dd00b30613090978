"""The corpus pipeline: STAGES over documents, each calling one operator of corpuscle.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read
again as the next one's docs. All but the last return the columns of their docs; a
stage's learning and statistics use the documents that it gets.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpuscle.llm import bpe, langid, mixing, ngram_join, toxicity
from corpuscle.llm.common import scratch_path
from corpuscle.llm.queries import MIX_WEIGHTS, mix_levels

#: Documents whose language is less certain than this are rejected.
LEAST_LANGUAGE_SCORE = 0.5
#: The share of the remaining words that the mixture takes.
MIX_SHARE = (9, 10)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language."""
    vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    return langid.keep_known(docs, langid.fit(docs, vocabulary), vocabulary, LEAST_LANGUAGE_SCORE)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id."""
    return ngram_join.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents of the mixture of domains, languages and sources, none repeated."""
    return mixing.keep_mixed(docs, mix_levels(), MIX_WEIGHTS, MIX_SHARE)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and round-trip digests of the documents that remain."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_languages),
    ("ngram_jaccard_join", drop_near_copies),
    ("source_mix", mix),
    ("byte_bpe", encode),
]

#: The stages train models, which SQL cannot express; tests hold the pipeline against its parts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written to the shared folder and read again; the folder's tables go when the driver ends."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
