"""Citations: do quotes stand in their sources, and do sources support claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

SUPPORTED, PARTLY, UNSUPPORTED = "supported", "partially_supported", "unsupported"
TAU_HIGH, TAU_LOW = 0.6, 0.25
WEIGHT = {SUPPORTED: 1.0, PARTLY: 0.5, UNSUPPORTED: 0.0}
LEAST_QUOTE, FUZZY, FUZZY_CONFIDENCE = 8, 0.88, 0.7


def tokenised(rows: DataFrame, text: str, prefix: str) -> DataFrame:
    """Adds prefix_norm, prefix_tokens (between blanks) and prefix_gates of a text column, made once a row.

    They come out of a generator, behind which Spark doesn't repeat an expression: in a
    function over array elements a text would otherwise be split anew for every element.
    """
    norm = T.simple_normalise(F.col(text))
    made = F.struct(norm.alias("norm"), T.blank_tokens(norm).alias("tokens"), T.gate_tokens(norm).alias("gates"))
    out = rows.withColumn("_made", F.explode(F.array(made)))
    return out.select(*rows.columns, *[F.col(f"_made.{c}").alias(f"{prefix}_{c}") for c in ("norm", "tokens", "gates")])


def shingle_keys(tokens: Column, n: int) -> Column:
    """Hashes of the different runs of n tokens; none of a shorter list."""
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(tokens, i, n), " "))))


def run_keys(tokens: Column, n: int) -> Column:
    """Hashes of the different runs of n tokens, made token by token without joining them; of a shorter list that isn't empty, its own as a whole."""
    starts = F.when(F.size(tokens) > 0, F.sequence(F.lit(0), F.greatest(F.size(tokens) - n, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(*[F.get(tokens, i + k) for k in range(n)])))


def nearest_pairs(claims: DataFrame, chunks: DataFrame, n: int = 5) -> DataFrame:
    """(claim_id, chunk_id): the chunk that shares most runs of n tokens with each claim (claim_id, claim_tokens), the smallest of equals; no row if none does.

    chunks (chunk_id, span_tokens). A claim of fewer tokens is one run, and its chunk the smallest that holds it whole. Runs of all lengths meet
    in one equi-join on hashes, so claims are read once, a claim meets no chunk with which it shares nothing, and a shorter claim one chunk
    at most. Only ids and hashes are shuffled.
    """
    size = F.size("claim_tokens")
    held = lambda k: chunks.where(F.size("span_tokens") >= k).select(F.lit(k).alias("size"), F.explode(run_keys(F.col("span_tokens"), k)).alias("key"), "chunk_id")
    index = held(n)
    for k in range(1, n):
        index = index.unionByName(held(k).groupBy("size", "key").agg(F.min("chunk_id").alias("chunk_id")))
    keys = claims.select("claim_id", F.least(size, F.lit(n)).alias("size"), F.explode_outer(run_keys(F.col("claim_tokens"), n)).alias("key"))  # outer: else Spark makes the runs a second time, in a filter
    shared = keys.join(index, ["size", "key"]).groupBy("claim_id", "chunk_id").agg(F.count("*").alias("n"))
    return shared.groupBy("claim_id").agg(F.max_by("chunk_id", F.struct("n", -F.col("chunk_id"))).alias("chunk_id"))


def nearest_chunk(claims: DataFrame, chunks: DataFrame, n: int = 5) -> DataFrame:
    """Adds to tokenised claims (claim_id, claim_tokens, ...) the chunk_id of nearest_pairs(); null if there is none."""
    return claims.join(nearest_pairs(claims, chunks, n), "claim_id", "left")


def with_sources(claims: DataFrame, text: str, chunks: DataFrame, materialize) -> DataFrame:
    """Claims (claim_id, text) with their nearest chunk_id, tokenised. The pairs are written first, so that a claim's text is split once to look for its chunk, and once more only if it has one to be held against; without one its tokens are empty."""
    claims = claims.withColumn("_text", F.col(text))
    norm = F.explode(F.array(T.simple_normalise(F.col("_text")))).alias("_norm")
    words = claims.select("claim_id", norm).select("claim_id", F.explode(F.array(T.blank_tokens(F.col("_norm")))).alias("claim_tokens"))
    pairs = materialize(nearest_pairs(words, chunks))
    cited = claims.join(pairs, "claim_id", "left").withColumn("_text", F.when(F.col("chunk_id").isNotNull(), F.col("_text")).otherwise(""))
    return tokenised(cited, "_text", "claim").drop("_text")


def audit(evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """Tokenised evidence (claim_id, chunk_id, confidence, claim_norm, claim_tokens: the quote's) with `found` (unresolved, short, verbatim, fuzzy, missing) and the confidence kept.

    chunks (chunk_id, span_norm, span_tokens). A quote of fewer than 8 characters proves nothing; one whose
    tokens are at least 88 % there is fuzzy and keeps a confidence of 0.7 at most.
    """
    e = evidence.join(chunks.select("chunk_id", "span_norm", "span_tokens"), "chunk_id", "left")
    overlap = F.coalesce(T.lexical_overlap(F.col("claim_tokens"), F.col("span_tokens")), F.lit(0.0))
    found = F.when(F.col("span_norm").isNull(), "unresolved").when(F.length("claim_norm") < LEAST_QUOTE, "short").when(F.contains("span_norm", "claim_norm"), "verbatim").when(F.col("overlap") >= FUZZY, "fuzzy").otherwise("missing")
    kept = F.when(F.col("found") == "verbatim", F.col("confidence")).when(F.col("found") == "fuzzy", F.least("confidence", F.lit(FUZZY_CONFIDENCE)))
    return e.withColumn("overlap", overlap).withColumn("found", found).withColumn("kept_confidence", kept).drop("span_norm", "span_tokens")


def prefilter(claims: DataFrame, chunks: DataFrame) -> DataFrame:
    """Tokenised claims (claim_id, kind, chunk_id, claim_tokens, claim_gates) with overlap, risk and `verdict`: decided by words alone, or null for a judge.

    chunks (chunk_id, span_tokens, span_gates). Unresolved chunks mean unsupported. Predictions always go to
    the judge; an extracted claim is supported if 60 % of its tokens are in the span and nothing
    hints at a contradiction.
    """
    c = claims.join(chunks.select("chunk_id", "span_tokens", "span_gates"), "chunk_id", "left")
    c = c.withColumn("overlap", F.coalesce(T.lexical_overlap(F.col("claim_tokens"), F.col("span_tokens")), F.lit(0.0))).withColumn("risk", T.contradiction(F.col("claim_gates"), F.col("span_gates")))
    verdict = F.when(F.col("span_tokens").isNull(), UNSUPPORTED).when((F.col("kind") != "predicted") & (F.col("overlap") >= TAU_HIGH) & F.col("risk").isNull(), SUPPORTED)
    return c.withColumn("verdict", verdict).drop("span_tokens", "span_gates")


def judged(claims: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Fills undecided verdicts from (claim_id, judged); a missing one is partial, and says so in `degraded`."""
    c = claims.join(verdicts, "claim_id", "left")
    degraded = F.col("verdict").isNull() & F.col("judged").isNull()
    return c.withColumn("degraded", degraded).withColumn("verdict", F.coalesce("verdict", "judged", F.lit(PARTLY))).drop("judged")


def weight_of(verdict: Column) -> Column:
    return F.when(verdict == SUPPORTED, 1.0).when(verdict == PARTLY, 0.5).otherwise(0.0)


def score(claims: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_claims, n_supported, grounding_score): the mean weight of the verdicts."""
    return claims.groupBy(*by).agg(F.count("*").alias("n_claims"), F.count_if(F.col("verdict") == SUPPORTED).alias("n_supported"), F.avg(weight_of(F.col("verdict"))).alias("grounding_score"))


def issue(kind: Column, verdict: Column) -> Column:
    """The issue code of a verdict, null if supported."""
    predicted = kind == "predicted"
    return F.when(verdict == UNSUPPORTED, F.when(predicted, "GROUNDING_MISFILED_PREDICTION").otherwise("GROUNDING_UNSUPPORTED_CLAIM")).when(
        verdict == PARTLY, F.when(predicted, "GROUNDING_LOOSELY_FILED_PREDICTION").otherwise("GROUNDING_PARTIALLY_SUPPORTED_CLAIM"))
