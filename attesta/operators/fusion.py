"""Fusing ranked lists: weighted score fusion and reciprocal rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def _ranked(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def weighted_fusion(
    dense: DataFrame, lexical: DataFrame, by: list[str], key: str = "chunk_id",
    dense_weight: float = 0.7, lexical_weight: float = 0.3,
) -> DataFrame:
    """Min-max scaled scores of two lists, added with weights.

    Inputs have `by`, `key`, score, rank. Where one list is empty for a query, the other one is
    returned as it is. Everything after the first shuffle on `by` reuses its partitioning.
    """
    cols = [*by, key, "score", "rank"]
    both = dense.select(*cols, F.lit(0).alias("list_no")).unionByName(
        lexical.select(*cols, F.lit(1).alias("list_no"))
    )
    w = Window.partitionBy(*by)
    is_dense = F.col("list_no") == 0
    lists = both.select(
        "*",
        F.count(F.when(is_dense, 1)).over(w).alias("n_dense"),
        F.count(F.when(~is_dense, 1)).over(w).alias("n_lex"),
        F.when(is_dense, F.min(F.when(is_dense, F.col("score"))).over(w))
        .otherwise(F.min(F.when(~is_dense, F.col("score"))).over(w)).alias("lo"),
        F.when(is_dense, F.max(F.when(is_dense, F.col("score"))).over(w))
        .otherwise(F.max(F.when(~is_dense, F.col("score"))).over(w)).alias("hi"),
    ).withColumn("two", (F.col("n_dense") > 0) & (F.col("n_lex") > 0))
    spread = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(F.lit(1.0))
    unit = lists.withColumn("unit", (F.col("score") - F.col("lo")) / spread)

    # a key repeated in the dense list keeps its last place; lexical repeats add up
    per_key = unit.groupBy(*by, key).agg(
        F.max_by("unit", F.when(is_dense, F.col("rank"))).alias("dense_unit"),
        F.sum(F.when(~is_dense, F.col("unit"))).alias("lex_unit"),
        F.max_by("score", F.when(is_dense, F.col("rank"))).alias("dense_score"),
        F.max_by("score", F.when(~is_dense, F.col("rank"))).alias("lexical_score"),
        F.count(F.when(is_dense, 1)).alias("d"),
        F.count(F.when(~is_dense, 1)).alias("l"),
        F.min(F.struct("list_no", "rank")).alias("first"),
        F.first("two").alias("two"),
    )
    mixed = F.coalesce(F.col("dense_unit") * dense_weight, F.lit(0.0)) + F.coalesce(
        F.col("lex_unit") * lexical_weight, F.lit(0.0)
    )
    fused = per_key.select(
        *by, key, "dense_score", "lexical_score", "first",
        F.when(F.col("two"), F.round(mixed, 6)).otherwise(F.coalesce("dense_score", "lexical_score")).alias("score"),
        F.when((F.col("d") > 0) & (F.col("l") == 0), "dense")
        .when((F.col("d") == 0) & (F.col("l") < 2), "lexical")
        .otherwise("hybrid").alias("method"),
    )
    return _ranked(fused, by, [F.desc("score"), F.col("first")]).drop("first")


def rrf(lists: DataFrame, by: list[str], key: str = "chunk_id", k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of lists(by..., list_no, key, score, rank).

    A key repeated in one list counts each time. A query for which one list only was asked is returned
    unchanged: `n_lists` says how many were; without that column the lists that have rows count. The
    output has `one_list`.
    """
    w = Window.partitionBy(*by)
    single = F.col("n_lists") == 1 if "n_lists" in lists.columns else F.min("list_no").over(w) == F.max("list_no").over(w)
    counted = lists.withColumn("one_list", single)
    per_key = counted.groupBy(*by, key).agg(
        F.round(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))), 9).alias("rrf_score"),
        F.max("score").alias("original_score"),
        F.min(F.struct("list_no", "rank")).alias("first"),
        F.first("one_list").alias("one_list"),
    )
    fused = per_key.withColumn(
        "score", F.when(F.col("one_list"), F.col("original_score")).otherwise(F.col("rrf_score"))
    )
    order = [F.when(~F.col("one_list"), F.col("score")).desc(), F.col("first")]
    return _ranked(fused, by, order).drop("first")


def rrf_two_lists(dense: DataFrame, lexical: DataFrame, by: list[str], key: str = "chunk_id", k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of a dense and a lexical list."""
    cols = [*by, key, "score", "rank"]
    lists = dense.select(*cols, F.lit(0).alias("list_no")).unionByName(lexical.select(*cols, F.lit(1).alias("list_no")))
    # both lists exist for the query even if one has no rows: never treated as a single list
    w = [F.desc("score"), F.col("first")]
    per_key = lists.groupBy(*by, key).agg(
        F.round(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))), 9).alias("score"),
        F.max("score").alias("original_score"),
        F.min(F.struct("list_no", "rank")).alias("first"),
    )
    return _ranked(per_key, by, w).drop("first")


def hybrid_search(queries: DataFrame, dense_fn, lexical_fn, k: int = 10, method: str = "weighted", **weights) -> DataFrame:
    """Over-fetch 2k from both searches, fuse, keep k. The searches are callables (queries, k) -> hits."""
    dense, lexical = dense_fn(queries, 2 * k), lexical_fn(queries, 2 * k)
    fuse = rrf_two_lists if method == "rrf" else weighted_fusion
    return fuse(dense, lexical, ["query_id", "source"], **weights).filter(F.col("rank") <= k)


def score_filter(hits: DataFrame, by: list[str], k: int, threshold: float = 0.3) -> DataFrame:
    """Rows above the threshold; a query without any keeps its first 2k rows instead. Ranks start at 1.

    The threshold is one for similarities: rows of several fused lists (`one_list` false), whose scores
    are sums of inverse ranks, all stay.
    """
    w = Window.partitionBy(*by)
    fused = ~F.col("one_list") if "one_list" in hits.columns else F.lit(False)
    return (
        hits.withColumn("_best", F.max("score").over(w))
        .filter(
            fused | (F.col("score") > threshold)
            | (~F.coalesce(F.col("_best") > threshold, F.lit(False)) & (F.col("rank") <= 2 * k))
        )
        .drop("_best")
    )
