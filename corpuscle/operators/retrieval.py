"""Hybrid retrieval: a lexical ranking over an inverted index, a ranking by cosine, and their fusion by reciprocal rank.

Each ranking keeps its `depth` best of every query, which is what the fusion is defined over. Queries are a stated set: they are few against the
rows. Chunks of rows meet blocks of queries as two small matrices; a chunk sends on only what can be among a query's best.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

#: Saturation of repeated terms, weight of the length, and the constant of the fusion.
K1, B, RRF = 1.2, 0.75, 60
#: Queries that one block, and rows that one chunk holds on average.
BLOCK, CHUNK = 256, 2048
#: Scores are compared to nine places: those so far below a chunk's last best one may still equal it.
SLACK = 2e-9


def _best(scored: DataFrame, depth: int) -> DataFrame:
    """(query_id, id, rank): the depth best of each query by score to nine places, equal ones by id."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= depth).select("query_id", "id", "rank")


def _column(table: pa.Table, name: str) -> pa.Array:
    found = table[name].combine_chunks()
    return found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found


def _found(ids: pa.Array, queries: pa.Array, scores: np.ndarray, there: np.ndarray, depth: int) -> pa.Table:
    """(query_id, id, score) of a matrix with a row for each id and a column for each query: the depth best of each column, and any so close that rounding may put them there. NaN is the highest, as in Spark."""
    key = np.where(there, np.where(np.isnan(scores), np.inf, scores), -np.inf)
    if len(key) > depth:
        there = there & (key >= np.partition(key, len(key) - depth, axis=0)[len(key) - depth] - SLACK)
    row, column = np.nonzero(there)
    return pa.table({"query_id": queries.take(pa.array(column)), "id": ids.take(pa.array(row)), "score": pa.array(scores[row, column], from_pandas=False)})


def _met(rows: DataFrame, queries: DataFrame, n_rows: int, n_queries: int, score, depth: int) -> DataFrame:
    """The depth best by score(rows of a chunk, queries of a block) -> (query_id, id, score), for all chunks of rows (id, ...) and blocks of queries (query_id, ...)."""
    chunks, blocks = max(1, -(-n_rows // CHUNK)), max(1, -(-n_queries // BLOCK))
    dealt = lambda key, n, name: F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias(name)
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    left = rows.select("*", dealt("id", chunks, "chunk"), every(blocks, "block"))
    right = queries.select(*[F.col(c).alias(c) for c in queries.columns], dealt("query_id", blocks, "block"), every(chunks, "chunk"))
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, score double"
    kinds = pa.schema([("query_id", to_arrow_type(queries.schema["query_id"].dataType)), ("id", to_arrow_type(rows.schema["id"].dataType)), ("score", pa.float64())])

    def meet(chunk: pa.Table, block: pa.Table) -> pa.Table:
        return score(chunk, block).cast(kinds) if chunk.num_rows and block.num_rows else kinds.empty_table()

    return _best(left.groupBy("chunk", "block").cogroup(right.groupBy("chunk", "block")).applyInArrow(meet, schema), depth)


def lexical_ranks(documents: DataFrame, queries: DataFrame, depth: int = 100, materialize=lambda df: df) -> DataFrame:
    """(query_id, id, rank) by BM25 of documents (id, tokens) for queries (query_id, tokens); each different term of a query counts once.

    Only postings of the queries' terms are shuffled; materialize writes them, as they are read twice. Documents without tokens count in nothing; a query that no document shares a term with has no rows.
    """
    d = documents.where(F.size("tokens") > 0).select("id", F.size("tokens").alias("n"), "tokens")
    docs, mean = d.agg(F.count("*"), F.avg("n")).first()
    asked = queries.select("query_id", F.explode(F.array_distinct("tokens")).alias("term"))
    postings = materialize(d.select("id", "n", F.explode("tokens").alias("term")).join(asked.select("term").distinct(), "term", "left_semi").groupBy("id", "n", "term").agg(F.count("*").alias("tf")))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    w = df.select("term", F.log(1 + (docs - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    average = mean or 1.0

    def score(chunk: pa.Table, block: pa.Table) -> pa.Table:
        ids, asking = _column(chunk, "id").dictionary_encode(), _column(block, "query_id").dictionary_encode()
        terms = pc.unique(_column(block, "term"))
        weights = np.zeros((len(terms), len(asking.dictionary)))
        weights[pc.index_in(_column(block, "term"), terms).to_numpy(), asking.indices.to_numpy()] = _column(block, "idf").to_numpy()
        at = pc.index_in(_column(chunk, "term"), terms).to_numpy(zero_copy_only=False)
        known = ~np.isnan(at) if at.dtype.kind == "f" else np.ones(len(at), bool)
        tf, n = (_column(chunk, c).to_numpy().astype(float)[known] for c in ("tf", "n"))
        part = np.zeros((len(ids.dictionary), len(terms)))
        np.add.at(part, (ids.indices.to_numpy()[known], at[known].astype(int)), tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / average)))
        scores = part @ weights
        return _found(ids.dictionary, asking.dictionary, scores, scores > 0, depth)

    return _met(postings, asked.join(w, "term"), docs, queries.count(), score, depth)


def _vectors(table: pa.Table, key: str, value: str) -> dict[int, tuple[pa.Array, np.ndarray]]:
    """{length: (keys, matrix)} of the lists of doubles without null entries; null lists are left out."""
    table = table.filter(pc.is_valid(table[value]))
    keys, lists = _column(table, key), _column(table, value)
    sizes, flat = pc.list_value_length(lists).to_numpy(), lists.flatten()
    starts = np.concatenate([[0], np.cumsum(sizes)])
    holes = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
    whole, numbers = holes[starts[1:]] == holes[starts[:-1]], flat.to_numpy(zero_copy_only=False)
    out = {}
    for n in np.unique(sizes[whole]):
        place = np.nonzero(whole & (sizes == n))[0]
        out[int(n)] = keys.take(pa.array(place)), numbers[starts[place][:, None] + np.arange(n)]
    return out


def vector_ranks(vectors: DataFrame, queries: DataFrame, depth: int = 100) -> DataFrame:
    """(query_id, id, rank) by cosine, in double precision, of vectors (id, v: array<double>) with queries (query_id, v); pairs with a zero vector, a null entry or unequal lengths have no cosine and no rank."""

    def score(chunk: pa.Table, block: pa.Table) -> pa.Table:
        rows, asking, parts = _vectors(chunk, "id", "v"), _vectors(block, "query_id", "v"), []
        for n in rows.keys() & asking.keys():
            (ids, a), (queries_, b) = rows[n], asking[n]
            with np.errstate(all="ignore"):
                size = np.sqrt(np.einsum("ij,ij->i", a, a))[:, None] * np.sqrt(np.einsum("ij,ij->i", b, b))[None, :]
                parts.append(_found(ids, queries_, (a @ b.T) / size, size != 0, depth))
        return pa.concat_tables(parts) if parts else pa.table({"query_id": _column(block, "query_id")[:0], "id": _column(chunk, "id")[:0], "score": pa.array([], pa.float64())})

    return _met(vectors.select("id", "v"), queries.select("query_id", "v"), vectors.count(), queries.count(), score, depth)


def fused(rankings: list[DataFrame], top: int = 10) -> DataFrame:
    """(query_id, id, score, rank): the `top` best by the sum of 1 / (60 + rank) over the rankings (query_id, id, rank), equal ones by id."""
    every = rankings[0]
    for r in rankings[1:]:
        every = every.unionByName(r)
    s = every.groupBy("query_id", "id").agg(F.sum(F.lit(1.0) / (RRF + F.col("rank"))).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "id"))
    return s.withColumn("rank", rank).where(F.col("rank") <= top)
