"""Dense retrieval: exact top-k by cosine, for array vectors and for hashed text vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..functions.vectors import hashed_vector
from .blocks import PASS_ROWS, sparse_topk, vector_topk
from .lexical import top_k


def dense_topk(queries: DataFrame, corpus: DataFrame, k: int = 10, query_rows: int = PASS_ROWS) -> DataFrame:
    """Exact cosine top-k. queries(query_id, embedding), corpus(vec_id, embedding).

    Rows with a null id or vector, or with a null in the vector, take no part. Any number of queries takes
    the same plan: blocks of at most `query_rows` of them against blocks of vectors, the product inside the
    task.
    """
    one = F.when(F.lit(True), F.lit("")).alias("source")
    q = queries.select(F.col("query_id").cast("long").alias("query_id"), one, F.col("embedding").alias("vector"))
    c = corpus.select(F.col("vec_id").alias("chunk_id"), one, F.col("embedding").alias("vector"))
    hits = vector_topk(c, q, k, query_rows=query_rows).select("query_id", F.col("chunk_id").alias("vec_id"), "score")
    return top_k(hits, k, ["query_id"], ["vec_id"])


def vector_search(queries: DataFrame, vectors: DataFrame, k: int = 10, all_source: str | None = None) -> DataFrame:
    """Exact cosine top-k per query and source. queries(query_id, vector[, source]); vectors(source, chunk_id, vector).

    A query that names no source searches each source by itself, and all together if `all_source` is given.
    """
    return top_k(vector_topk(vectors, in_sources(queries, vectors, all_source), k, all_source), k, ["query_id", "source"])


def in_sources(queries: DataFrame, rows: DataFrame, all_source: str | None) -> DataFrame:
    """The queries with a source: their own, or once for every source of the rows."""
    if "source" in queries.columns:
        return queries
    known = rows.select("source").distinct()
    if all_source is not None:
        known = known.unionByName(known.limit(1).select(F.lit(all_source).alias("source")))
    # as many rows as there are sources, in one array
    listed = known.agg(F.collect_set("source").alias("_s"))
    return queries.withColumn("source", F.explode(listed.scalar()))


def text_vectors(rows: DataFrame, keep: list[str], text: Column | None = None) -> DataFrame:
    """(keep..., dims, weights): hashed bag-of-words vector of the text."""
    vec = hashed_vector(tokens(F.col("text") if text is None else text))
    return rows.select(*keep, vec.alias("_v")).select(*keep, F.col("_v.dim").alias("dims"), F.col("_v.w").alias("weights"))


def _as_is(weights: np.ndarray, norms: np.ndarray, norm: float) -> np.ndarray:
    return weights


def text_search(queries: DataFrame, vectors: DataFrame, k: int = 10, all_source: str | None = None) -> DataFrame:
    """Exact cosine top-k over hashed text vectors; only texts that share a word with the query are hits.

    queries(query_id, text[, source]); vectors(source, chunk_id, dims, weights), as `lexical.term_rows` makes
    them. Scored in blocks inside the tasks (`blocks.sparse_topk`).
    """
    keep = [c for c in ("query_id", "source") if c in queries.columns]
    q = in_sources(text_vectors(queries, keep), vectors, all_source).select("query_id", "source", F.lit(1.0).alias("norm"), F.col("dims").alias("terms"), "weights")
    rows = vectors.select("source", "chunk_id", F.lit(1.0).alias("norm"), F.col("dims").alias("terms"), F.col("weights").alias("values"))
    return top_k(sparse_topk(rows, q, k, _as_is, all_source), k, ["query_id", "source"])
