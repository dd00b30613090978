"""The queries opN_<name> of the training-data operators, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, common, ego_join, langid, mixing, ngram_join, oracles, packing, quality, term_search, token_counts, toxicity, urls, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents: five-word shingles, Jaccard similarity of 0.8 or more."""
    return ngram_join.ngram_jaccard_join(_table(spark, sf_dir, "documents"))


def op2_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the distribution-divergence verdict of all documents."""
    return quality.quality_rules(_table(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -7 whose texts hold control strings, formatted and read back.

    The table holds plain texts, so no attachment comes of it; the operator's other parts are tested on their own.
    """
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    turns = turns.unionByName(probe).select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))
    read = chat.format_conversations(turns).withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("attachments").cast("long").alias("n_attachments"), F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("expanded_tokens"),
    )


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from those that are not held out."""
    docs, vocabulary = _table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")
    found = langid.identify(docs, langid.fit(docs, vocabulary), vocabulary)
    return found.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def mix_levels() -> dict[str, Column]:
    """The mixture's tree: domains are groups of sources by the first hex digit of their names' MD5."""
    digit = F.substring(F.md5("source"), 1, 1)
    domain = F.when(digit < "6", "web").when(digit < "b", "books").otherwise("code")
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


MIX_WEIGHTS = {"web": 50, "books": 30, "code": 20} | {f"{d}/{lang}": w for d in ("web", "books", "code") for lang, w in (("en", 40), ("de", 25), ("fr", 20), ("es", 15))}


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three fifths of all words, mixed by domain, language and source, a source repeated three times at most."""
    docs = _table(spark, sf_dir, "documents")
    return mixing.mix_sources(docs, mix_levels(), MIX_WEIGHTS, (3, 5), 3)


def op6_ego_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all embeddings of equal label: cosine of 0.98 or more."""
    return ego_join.ego_join(_table(spark, sf_dir, "embeddings"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded by the multilingual byte-level ranks, and decoded."""
    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from labels that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))
    return found.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


URL_RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules, then the character models, for the URLs of all pages."""
    return urls.url_filter(_table(spark, sf_dir, "pages"), URL_RULES)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact token counts of all documents, and the prefix that a budget of 1,024 tokens allows."""
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 16 leading whitened components of all embeddings."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op12_term_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest-scoring documents of each benchmark item."""
    return term_search.term_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as word-level ids, packed into sequences of 2,048 ids."""
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join, op2_quality_divergence, op3_chat_format, op4_language_id, op5_source_mix,
        op6_ego_join, op7_byte_bpe, op8_toxicity, op9_url_filter, op10_token_counts,
        op11_whitening, op12_term_search, op13_best_fit_packing,
    )
}
ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": oracles.NGRAM_JOIN,
    "op3_chat_format": oracles.CHAT_FORMAT,
    "op5_source_mix": oracles.source_mix(MIX_WEIGHTS, (3, 5), 3, 7),
    "op6_ego_join": oracles.EGO_JOIN,
    "op12_term_search": oracles.TERM_SEARCH,
}
