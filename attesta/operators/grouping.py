"""Near-duplicate removal, grouping by credit, choice of sections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.credits import section_priority
from ..functions.text import or_none
from ..functions.vectors import cosine
from .skew import first_per_key, join_to_unique

THRESHOLD = 0.97


def credit_section_key() -> Column:
    section = F.coalesce(F.col("section"), F.lit("unknown"))
    return F.when(
        or_none(F.col("credit_id")).isNotNull() & (section != ""),
        F.concat_ws("::", F.col("credit_id"), section),
    )


def doc_page_key() -> Column:
    return F.when(
        or_none(F.col("doc")).isNotNull() & F.col("page_start").isNotNull() & F.col("page_end").isNotNull(),
        F.concat(
            F.col("doc"), F.lit("::"), F.col("page_start").cast("string"), F.lit("-"), F.col("page_end").cast("string")
        ),
    )


def near_duplicates_in_lists(
    hits: DataFrame, by: list[str], vector: str | None = "vector",
    similarity: Callable[[Column, Column], Column] = cosine, threshold: float = THRESHOLD,
) -> DataFrame:
    """Near-duplicate removal inside ranked lists (a few rows per query).

    A row falls when it is close to the *first* row of its credit and section, even if that first
    row falls itself in the second step; then only the first row per document and pages stays.
    """
    base = hits.withColumn("_k1", credit_section_key()).withColumn("_k2", doc_page_key())
    w1 = Window.partitionBy(*by, "_k1").orderBy("rank")
    seen = base.withColumn("_n1", F.row_number().over(w1))
    if vector:
        seen = seen.withColumn("_rep", F.first(vector).over(w1))
        close = F.coalesce(similarity(F.col(vector), F.col("_rep")) >= threshold, F.lit(False))
    else:
        seen = seen.withColumn("_rep", F.lit(None))
        close = F.lit(True)
    kept = seen.filter(F.col("_k1").isNull() | (F.col("_n1") == 1) | ~close)
    w2 = Window.partitionBy(*by, "_k2").orderBy("rank")
    return (
        kept.withColumn("_n2", F.row_number().over(w2))
        .filter(F.col("_k2").isNull() | (F.col("_n2") == 1))
        .drop("_k1", "_k2", "_n1", "_n2", "_rep")
    )


def near_duplicates_in_table(
    rows: DataFrame, row_id: str, vector: str = "vector", threshold: float = THRESHOLD
) -> DataFrame:
    """The same rule over one whole table ordered by `row_id`, for keys of any size.

    First rows per key come from aggregates, and hot keys are spread, so no key is gathered in a task.
    """
    base = rows.withColumn("_k1", credit_section_key()).withColumn("_k2", doc_page_key())
    firsts = (
        base.filter(F.col("_k1").isNotNull())
        .groupBy("_k1")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.min(row_id).alias("_rep_id"),
            F.min_by(vector, row_id).alias("_rep"),
        )
    )
    with_rep = join_to_unique(base, firsts, "_k1", "_n", [row_id], how="left")
    close = cosine(F.col(vector), F.col("_rep")) >= threshold
    kept = with_rep.filter(
        F.col("_k1").isNull() | (F.col(row_id) == F.col("_rep_id")) | ~F.coalesce(close, F.lit(False))
    ).drop("_rep", "_rep_id", "_k1")
    unique = F.coalesce(F.col("_k2"), F.concat(F.lit("row "), F.col(row_id).cast("string")))
    return first_per_key(kept, [unique], [F.col(row_id)]).drop("_k2")


def credit_relevance(hits: DataFrame, by: list[str]) -> DataFrame:
    """Per query and credit: best score plus 0.01 for each of at most five chunks."""
    return hits.groupBy(*by, F.coalesce(or_none(F.col("credit_id")), F.lit("unknown")).alias("credit")).agg(
        F.max("score").alias("best_score"),
        F.count(F.lit(1)).alias("n_chunks"),
        F.round(F.max("score") + 0.01 * F.least(F.count(F.lit(1)), F.lit(5)), 9).alias("relevance"),
    )


def pick_sections(hits: DataFrame, by: list[str], per_credit: int = 3) -> DataFrame:
    """Best chunk of each section by section priority, remaining places by score (`pick` = 1, 2, …)."""
    w = Window.partitionBy(*by, "section").orderBy(F.desc("score"), "rank")
    firsts = hits.withColumn("_sec", F.row_number().over(w))
    lead = F.col("_sec") == 1
    final = Window.partitionBy(*by).orderBy(
        lead.desc(),
        F.when(lead, section_priority(F.col("section"))).desc_nulls_last(),
        F.desc("score"),
        "rank",
    )
    return firsts.withColumn("pick", F.row_number().over(final)).filter(F.col("pick") <= per_credit).drop("_sec")


def group_by_credit(
    hits: DataFrame, by: list[str], top_credits: int = 3, per_credit: int = 3
) -> DataFrame:
    """Best credits per query, best sections per credit, ranked again by score."""
    grouped = hits.withColumn("credit", F.coalesce(or_none(F.col("credit_id")), F.lit("unknown")))
    wc = Window.partitionBy(*by, "credit")
    scored = grouped.withColumn(
        "relevance",
        F.round(F.max("score").over(wc) + 0.01 * F.least(F.count(F.lit(1)).over(wc), F.lit(5)), 9),
    ).withColumn("_first", F.min("rank").over(wc))
    # credits with equal relevance stay in the order of their first hit
    wr = Window.partitionBy(*by).orderBy(F.desc("relevance"), "_first")
    best = scored.withColumn("credit_rank", F.dense_rank().over(wr)).filter(F.col("credit_rank") <= top_credits)
    picked = pick_sections(best, [*by, "credit"], per_credit)
    final = Window.partitionBy(*by).orderBy(F.desc("score"), "credit_rank", "pick")
    return picked.withColumn("rank", F.row_number().over(final)).drop("_first", "pick")


def dedupe_and_group(
    hits: DataFrame, by: list[str], top_credits: int = 3, per_credit: int = 3,
    vector: str | None = "vector", similarity=cosine, threshold: float = THRESHOLD,
) -> DataFrame:
    unique = near_duplicates_in_lists(hits, by, vector, similarity, threshold)
    return group_by_credit(unique, by, top_credits, per_credit)
