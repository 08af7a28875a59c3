"""The whole retrieval plan for many queries at once, and what is built on top of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_any, dot_sentences
from ..functions.vectors import cosine, sparse_dot
from ..operators.dense import text_search, vector_search
from ..operators.expansion import search_queries, with_domain_word, with_synonyms
from ..operators.fusion import rrf, rrf_two_lists, score_filter, weighted_fusion
from ..operators.grouping import dedupe_and_group
from ..operators.lexical import bm25_search
from ..operators.skew import join_to_unique
from ..session import written
from .index import SearchIndex

# ---- fixed values: words that mark recommendation and guidance sentences -----------------------
RECOMMEND_TEXT = ["recommend", "should", "consider"]
RECOMMEND_SENTENCE = ["recommend", "should", "consider", "implement"]
GUIDE_TEXT = ["requirement", "must", "prerequisite"]
GUIDE_SENTENCE = ["requirement", "must", "prerequisite", "comply"]
# ------------------------------------------------------------------------------------------------


def route_sources(queries: DataFrame, known: list[str]) -> DataFrame:
    """Adds `used_sources`: the requested sources that exist, else 'all' if known, else the first known."""
    fallback = "all" if "all" in known else known[0]
    wanted = F.array_intersect(
        F.coalesce(F.col("sources"), F.array().cast("array<string>")), F.array(*[F.lit(s) for s in known])
    )
    return queries.withColumn("used_sources", F.when(F.size(wanted) > 0, wanted).otherwise(F.array(F.lit(fallback))))


def hybrid_hits(
    subs: DataFrame, index: SearchIndex, k: int, method: str = "weighted",
    dense_weight: float = 0.7, lexical_weight: float = 0.3,
) -> DataFrame:
    """Fused hits of subs(query_id, text[, source][, vector]).

    The dense side sees the text with synonyms; in an index of given vectors it takes the queries' `vector`,
    or what the index's `embed` makes of that text. A query with a null vector has lexical hits only.
    """
    dense_text = with_synonyms(with_domain_word(F.col("text")))
    everywhere = index.lexical.all_source
    if index.vectors is None:
        dense = text_search(subs.withColumn("text", dense_text), index.lexical.rows, k, everywhere)
    else:
        if "vector" not in subs.columns:
            if index.embed is None:
                raise ValueError("queries of an index of given vectors need a column vector, or the index an embed function")
            subs = subs.withColumn("vector", index.embed(dense_text))
        dense = vector_search(subs.drop("text"), index.vectors, k, everywhere)
    lexical = bm25_search(subs, index.lexical, k)
    by = ["query_id", "source"]
    if method == "rrf":
        return rrf_two_lists(dense, lexical, by)
    return weighted_fusion(dense, lexical, by, dense_weight=dense_weight, lexical_weight=lexical_weight)


def candidates(
    queries: DataFrame, index: SearchIndex, k: int, expand: bool = True, max_subqueries: int = 6, depth: int | None = None, **fusion
) -> DataFrame:
    """Fused candidates over all sub-queries and sources: (query_id, source, chunk_id, score, rank, one_list).

    `depth` is the length of each list that is fused, 3k by default.
    """
    if expand:
        subs = search_queries(queries, max_subqueries=max_subqueries)
    else:
        subs = queries.withColumn("sub_no", F.lit(1)).withColumnRenamed("text", "sub_query")
    n_lists = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    asked = subs.withColumn("n_lists", n_lists).select(
        F.struct("query_id", "sub_no", "n_lists").alias("query_id"), F.col("sub_query").alias("text"),
        *([F.posexplode("used_sources").alias("src_no", "source")] if "used_sources" in subs.columns else []),
    )
    if "vector" in queries.columns:  # the sub-queries of a query share its vector
        own = queries.select(F.col("query_id").alias("_q"), "vector")
        asked = asked.join(own, F.col("query_id.query_id") == F.col("_q")).drop("_q")
    per_source = hybrid_hits(asked.drop("src_no"), index, depth or 3 * k, **fusion)
    if "src_no" in asked.columns:
        per_source = per_source.join(asked.select("query_id", "source", "src_no"), ["query_id", "source"])
    else:
        per_source = per_source.withColumn("src_no", F.lit(0))
    flat = per_source.select(
        F.col("query_id.query_id").alias("query_id"), F.col("query_id.sub_no").alias("list_no"), F.col("query_id.n_lists").alias("n_lists"),
        "source", "chunk_id", "score", "src_no", "rank",
    )
    # a sub-query's list is its sources one after the other
    place = Window.partitionBy("query_id", "list_no").orderBy("src_no", "rank")
    lists = flat.withColumn("rank", F.row_number().over(place)).withColumn(
        "hit", F.struct("source", "chunk_id")
    )
    fused = rrf(lists.select("query_id", "list_no", "n_lists", "hit", "score", "rank"), ["query_id"], "hit")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")
    return fused.select(
        "query_id", "hit.source", "hit.chunk_id", "score", F.row_number().over(order).alias("rank"), "one_list"
    )


def at_hits(hits: DataFrame, table: DataFrame, all_source: str | None, how: str = "inner") -> DataFrame:
    """hits(source, chunk_id, …) with the columns of table(source, chunk_id, …); hits of `all_source` find every source."""
    own = table.withColumnRenamed("source", "_source").withColumnRenamed("chunk_id", "_chunk")
    same = F.col("source").eqNullSafe(F.col("_source"))
    if all_source is not None:
        same = same | (F.col("source") == all_source)
    return hits.join(own, (F.col("chunk_id") == F.col("_chunk")) & same, how).drop("_source", "_chunk")


def search(
    queries: DataFrame, index: SearchIndex, k: int = 5, top_credits: int = 3, group: bool = True,
    threshold: float = 0.3, similarity: float = 0.97, **options,
) -> DataFrame:
    """queries(query_id, text[, used_sources][, vector]) -> ranked chunks with their metadata, at most k per query.

    The near-duplicate step compares the index's vectors; texts are fetched for the rows that remain only.
    """
    everywhere = index.lexical.all_source
    hits = candidates(queries, index, k, **options)
    kept = written(score_filter(hits, ["query_id"], k, threshold).drop("one_list"))
    columns = [c for c in index.chunks.columns if c not in ("text", "vector")]
    found = at_hits(kept, index.chunks.select(*columns), everywhere)
    if not group:
        w = Window.partitionBy("query_id").orderBy("rank")
        cut = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    else:
        if index.vectors is None:
            vector = F.transform(F.arrays_zip("dims", "weights"), lambda d: F.struct(d["dims"].alias("dim"), d["weights"].alias("w")))
            vectors, alike = index.lexical.rows.select("source", "chunk_id", vector.alias("vector")), sparse_dot
        else:
            vectors, alike = index.vectors, cosine
        # few rows are hits: the vectors of the others are not moved
        vectors = vectors.join(kept.select("chunk_id").distinct(), "chunk_id", "left_semi")
        grouped = dedupe_and_group(
            at_hits(found, vectors, everywhere, "left"), ["query_id"], top_credits, max(2, k // top_credits), "vector", alike, similarity
        )
        cut = grouped.filter(F.col("rank") <= k).drop("vector")
    return at_hits(cut, index.chunks.select("source", "chunk_id", "text"), everywhere)


def search_once(queries: DataFrame, index: SearchIndex, k: int = 5, **options) -> DataFrame:
    """`search`, with equal questions asked once: query ids whose rows are the same share the hits of one search.

    The work is distinct questions times rows, not query ids times rows; no hit depends on the id itself. All
    rows of an id are its question, as often as they come: ids may repeat or be null.
    """
    said = [c for c in ("text", "used_sources", "vector") if c in queries.columns]
    rows = queries.groupBy("query_id", *said).agg(F.count(F.lit(1)).alias("_times"))
    by_id = written(rows.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(*said, "_times"))).alias("question")))
    # written: the numbers stay as they are
    asked = written(by_id.groupBy("question").agg(F.count(F.lit(1)).alias("ids")).withColumn("no", F.monotonically_increasing_id()))
    numbered = join_to_unique(by_id, asked, "question", "ids", ["query_id"]).select("query_id", "no")
    each = asked.select("no", F.explode("question").alias("row"))
    again = F.explode(F.array_repeat(F.lit(0), F.col("row._times").cast("int")))
    hits = search(each.select(F.col("no").alias("query_id"), "row.*", again).select("query_id", *said), index, k, **options)
    return numbered.join(hits.withColumnRenamed("query_id", "no"), "no").select(*hits.columns)


def credit_queries(projects: DataFrame, pattern: str = "%s credit requirements for %s projects") -> DataFrame:
    """One query per project and target credit: projects(project_id, project_type, target_credits)."""
    return projects.select(
        "project_id", F.coalesce("project_type", F.lit("NC")).alias("project_type"),
        F.posexplode("target_credits").alias("target_no", "credit_code"),
    ).select(
        F.concat_ws("/", F.col("project_id").cast("string"), F.col("target_no").cast("string")).alias("query_id"),
        "project_id", "credit_code", F.format_string(pattern, "credit_code", "project_type").alias("text"),
    )


def analyze_projects(projects: DataFrame, index: SearchIndex, k: int = 3, **options) -> DataFrame:
    """Relevant chunks per project and target credit; the status always asks for a review.

    Projects of one type ask the same for the same credit: each such question is searched once.
    """
    asked = credit_queries(projects)
    hits = search_once(asked.select("query_id", "text"), index, k, **options)
    return asked.withColumnRenamed("text", "query").join(hits, "query_id", "left").withColumn(
        "compliance_status", F.lit("needs_review")
    )


def _top_sentences(texts: Column, in_text: list[str], in_sentence: list[str]) -> Column:
    """First three marked sentences over texts in rank order."""
    found = F.flatten(
        F.transform(
            F.filter(texts, lambda t: contains_any(t, in_text)),
            lambda t: F.filter(dot_sentences(t), lambda s: contains_any(s, in_sentence)),
        )
    )
    return F.slice(found, 1, 3)


def ranked_texts(hits: DataFrame, by: list[str]) -> DataFrame:
    """Texts of each query as one array in rank order (at most k rows per query)."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "text")))
    return hits.groupBy(*by).agg(F.transform(rows, lambda r: r["text"]).alias("texts"))


def guidance(hits: DataFrame, by: list[str]) -> DataFrame:
    """(by..., recommendations, guidance): up to three sentences each from the ranked hits."""
    return ranked_texts(hits, by).select(
        *by,
        _top_sentences(F.col("texts"), RECOMMEND_TEXT, RECOMMEND_SENTENCE).alias("recommendations"),
        _top_sentences(F.col("texts"), GUIDE_TEXT, GUIDE_SENTENCE).alias("guidance"),
    )


def merge_second_source(hits: DataFrame, other: DataFrame, k: int = 3, label: str = "Knowledge Base") -> DataFrame:
    """Corpus hits and rows of a second result table, first k of each kind per query.

    other(query_id, rank, title, text, source).
    """
    cols = ["query_id", "source_kind", "rank", "title", "text", "source"]
    a = hits.select(
        "query_id", F.lit(label).alias("source_kind"), "rank",
        F.coalesce("credit_name", F.lit("Information")).alias("title"), "text", "source",
    )
    b = other.withColumn("source_kind", F.lit("Web Search")).select(*cols)
    return a.unionByName(b).filter(F.col("rank") <= k)


def source_labels(merged: DataFrame) -> DataFrame:
    """Distinct source labels per query, sorted."""
    label = F.concat_ws(": ", "source_kind", F.nullif("source", F.lit("")))
    return merged.filter(F.coalesce("source", F.lit("")) != "").groupBy("query_id").agg(
        F.array_sort(F.collect_set(label)).alias("sources")
    )
