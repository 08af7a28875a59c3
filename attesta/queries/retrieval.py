"""Lexical, dense and fused retrieval queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..functions.vectors import cosine
from ..operators.dense import dense_topk, text_search
from ..operators.expansion import expand_queries, query_features, with_domain_word, with_synonyms
from ..operators.fusion import hybrid_search, rrf, rrf_two_lists, score_filter, weighted_fusion
from ..operators.grouping import credit_relevance, group_by_credit, near_duplicates_in_table, pick_sections
from ..operators.lexical import bm25_search, idf, lexical_index, term_rows
from ..session import BATCH_ROWS, table, written
from . import sqltext as q
from .inputs import (
    PASSAGES_SQL, TOPIC_QUERIES_SQL, WHOLE_DOCUMENTS_SQL, WINDOW_CHUNKS_SQL, passages, topic_queries,
    whole_documents, window_chunks,
)
from .registry import query

HIT_COLUMNS = ["query_id", "chunk_id", "score", "rank"]


@query("tokens_per_doc", f"SELECT doc_id, len({q.toks('text')}) AS n_tokens, len(list_distinct({q.toks('text')})) AS n_terms FROM documents")
def tokens_per_doc(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "documents").select("doc_id", tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_terms"))


@query(
    "bm25_term_stats",
    f"WITH {WHOLE_DOCUMENTS_SQL}, {PASSAGES_SQL}, {q.bm25(10)} "
    "SELECT term, df, round(CASE WHEN r < 0 THEN 0.25 * mean_idf ELSE r END, 6) AS idf FROM raw JOIN mi USING (source)",
)
def bm25_term_stats(spark, sf):
    index = lexical_index(whole_documents(spark, sf))
    return index.terms.join(index.stats, "source").select(
        "term", "df", F.round(idf(F.col("n_docs"), F.col("df"), F.col("mean_idf")), 6).alias("idf")
    )


@query(
    "bm25_topk",
    f"WITH {WHOLE_DOCUMENTS_SQL}, {PASSAGES_SQL}, {q.bm25(10)} SELECT query_id, chunk_id, score, rank FROM bmk",
)
def bm25_topk(spark, sf):
    return bm25_search(passages(spark, sf), lexical_index(whole_documents(spark, sf)), 10).select(HIT_COLUMNS)


@query(
    "bm25_topk_per_source",
    "WITH chunks AS (SELECT source, doc_id AS chunk_id, text FROM documents), "
    f"{PASSAGES_SQL}, {q.bm25(3)} SELECT query_id, source, chunk_id, score, rank FROM bmk",
)
def bm25_topk_per_source(spark, sf):
    index = lexical_index(whole_documents(spark, sf, F.col("source")))
    return bm25_search(passages(spark, sf), index, 3).select("source", *HIT_COLUMNS)


@query(
    "text_dense_topk",
    f"WITH {WHOLE_DOCUMENTS_SQL}, {PASSAGES_SQL}, dq AS (SELECT * FROM q), {q.text_dense(10)} "
    "SELECT query_id, chunk_id, score, rank FROM dek",
)
def text_dense_topk(spark, sf):
    return text_search(passages(spark, sf), written(term_rows(whole_documents(spark, sf)), BATCH_ROWS), 10).select(HIT_COLUMNS)


# one query vector per label: the mean of its vectors
def label_centroids(spark, sf):
    e = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    means = e.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    packed = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("v"))
    return packed.select(F.col("label").cast("long").alias("query_id"), F.transform("v", lambda s: s["m"]).alias("embedding"))


CENTROIDS_SQL = """ex AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
cm AS (SELECT label, pos, avg(x) AS m FROM ex GROUP BY ALL),
cent AS (SELECT label::BIGINT AS query_id, list(m ORDER BY pos) AS cv FROM cm GROUP BY ALL),
sims AS (SELECT query_id, vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], cv), 6) AS score FROM embeddings, cent)"""


def _dense(k: int) -> str:
    return f"""WITH {CENTROIDS_SQL}
SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM sims QUALIFY rank <= {k}"""


@query("dense_topk", _dense(10))
def dense_topk_broadcast(spark, sf):
    return dense_topk(label_centroids(spark, sf), table(spark, sf, "embeddings"), 10).select("query_id", "vec_id", "score", "rank")


@query("dense_topk_grid", _dense(10))
def dense_topk_grid(spark, sf):
    """The same search with many blocks of queries."""
    hits = dense_topk(label_centroids(spark, sf), table(spark, sf, "embeddings"), 10, query_rows=4)
    return hits.select("query_id", "vec_id", "score", "rank")


@query(
    "cosine_to_centroid",
    f"WITH {CENTROIDS_SQL} SELECT vec_id, score AS cosine FROM sims WHERE query_id = label",
)
def cosine_to_centroid(spark, sf):
    cents = label_centroids(spark, sf).withColumnRenamed("embedding", "cv")
    e = table(spark, sf, "embeddings")
    return e.join(cents, F.col("label") == F.col("query_id")).select(
        "vec_id", F.round(cosine(F.col("embedding"), F.col("cv")), 6).alias("cosine")
    )


HYBRID_CTES = (
    f"{WHOLE_DOCUMENTS_SQL}, {TOPIC_QUERIES_SQL}, dq AS (SELECT query_id, {q.with_synonyms('lt')} AS text "
    f"FROM (SELECT query_id, {q.with_domain('text')} AS lt FROM q)), {q.bm25(20)}, {q.text_dense(20)}"
)


def _two_lists(spark, sf, k=20):
    docs, queries = whole_documents(spark, sf), topic_queries(spark, sf)
    dense_text = with_synonyms(with_domain_word(F.col("text")))
    index = lexical_index(docs)
    return text_search(queries.withColumn("text", dense_text), index.rows, k), bm25_search(queries, index, k)


@query(
    "weighted_fusion",
    f"WITH {HYBRID_CTES}, {q.weighted('fused', 'dek', 'bmk')} "
    "SELECT query_id, chunk_id, score, method, rank FROM fused",
)
def weighted_fusion_query(spark, sf):
    dense, lexical = _two_lists(spark, sf)
    return weighted_fusion(dense, lexical, ["query_id", "source"]).select(*HIT_COLUMNS, "method")


RRF_SQL = """rl AS (SELECT query_id, chunk_id, score, rank, 0 AS list_no FROM dek UNION ALL SELECT query_id, chunk_id, score, rank, 1 FROM bmk),
rr AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, max(score) AS original_score, min(list_no * 1000000 + rank) AS f FROM rl GROUP BY ALL),
rrk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, f) AS rank FROM rr)"""


@query("rrf_fusion", f"WITH {HYBRID_CTES}, {RRF_SQL} SELECT query_id, chunk_id, score, original_score, rank FROM rrk")
def rrf_fusion(spark, sf):
    dense, lexical = _two_lists(spark, sf)
    return rrf_two_lists(dense, lexical, ["query_id", "source"]).select(*HIT_COLUMNS, "original_score")


@query(
    "hybrid_search_topk",
    f"WITH {HYBRID_CTES}, {q.weighted('fused', 'dek', 'bmk')} SELECT query_id, chunk_id, score, rank FROM fused WHERE rank <= 10",
)
def hybrid_search_topk(spark, sf):
    docs = whole_documents(spark, sf)
    index = lexical_index(docs)
    dense_text = with_synonyms(with_domain_word(F.col("text")))
    return hybrid_search(
        topic_queries(spark, sf),
        lambda qs, k: text_search(qs.withColumn("text", dense_text), index.rows, k),
        lambda qs, k: bm25_search(qs, index, k),
        10,
    ).select(HIT_COLUMNS)


@query(
    "score_filter_fallback",
    f"WITH {HYBRID_CTES}, {q.weighted('fused', 'dek', 'bmk')}, b AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM fused) "
    "SELECT query_id, chunk_id, score, rank FROM b WHERE score > 0.72 OR (best <= 0.72 AND rank <= 10)",
)
def score_filter_fallback(spark, sf):
    dense, lexical = _two_lists(spark, sf)
    fused = weighted_fusion(dense, lexical, ["query_id", "source"])
    return score_filter(fused, ["query_id"], 5, threshold=0.72).select(HIT_COLUMNS)


@query(
    "rrf_multi_query",
    f"""WITH {WHOLE_DOCUMENTS_SQL}, q0 AS (SELECT item_id, {', '.join(['unnest([1,2,3]) AS sub_no'])} FROM benchmark),
b AS (SELECT item_id, text FROM benchmark),
q AS (SELECT item_id * 10 + sub_no AS query_id, CASE sub_no WHEN 1 THEN text WHEN 2 THEN 'energy water ' || text ELSE 'the of ' || text END AS text FROM q0 JOIN b USING (item_id)),
{q.bm25(20)},
rl AS (SELECT query_id // 10 AS item_id, query_id % 10 AS list_no, chunk_id, score, rank FROM bmk),
rr AS (SELECT item_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, max(score) AS original_score, min(list_no * 1000000 + rank) AS f FROM rl GROUP BY ALL)
SELECT item_id, chunk_id, score, original_score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, f) AS rank FROM rr""",
)
def rrf_multi_query(spark, sf):
    text = F.col("text")
    forms = F.array(text, F.concat(F.lit("energy water "), text), F.concat(F.lit("the of "), text))
    subs = passages(spark, sf).select(F.col("query_id").alias("item_id"), F.posexplode(forms).alias("list_no", "text"))
    asked = subs.select(F.struct("item_id", "list_no").alias("query_id"), "text")
    hits = bm25_search(asked, lexical_index(whole_documents(spark, sf)), 20)
    lists = hits.select("query_id.item_id", "query_id.list_no", "chunk_id", "score", "rank")
    return rrf(lists, ["item_id"]).select("item_id", "chunk_id", "score", "original_score", "rank")


@query(
    "near_dup_two_keys",
    """WITH r AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, label::VARCHAR || '::' || (vec_id % 3)::VARCHAR AS k1,
   CASE WHEN vec_id % 5 = 0 THEN NULL ELSE 'doc' || (vec_id % 97)::VARCHAR || '::' || (vec_id % 2)::VARCHAR END AS k2 FROM embeddings),
f AS (SELECT *, first_value(v) OVER (PARTITION BY k1 ORDER BY vec_id) AS rep, row_number() OVER (PARTITION BY k1 ORDER BY vec_id) AS rn FROM r),
kept AS (SELECT * FROM f WHERE rn = 1 OR list_cosine_similarity(v, rep) < 0.3),
k AS (SELECT *, row_number() OVER (PARTITION BY k2 ORDER BY vec_id) AS n2 FROM kept)
SELECT vec_id, label FROM k WHERE k2 IS NULL OR n2 = 1""",
)
def near_dup_two_keys(spark, sf):
    v = F.col("vec_id")
    rows = table(spark, sf, "embeddings").select(
        "vec_id", "label", F.col("embedding").alias("vector"), F.col("label").cast("string").alias("credit_id"),
        (v % 3).cast("string").alias("section"),
        F.when(v % 5 != 0, F.concat(F.lit("doc"), (v % 97).cast("string"))).alias("doc"),
        (v % 2).alias("page_start"), (v % 2).alias("page_end"),
    )
    return near_duplicates_in_table(rows, "vec_id", threshold=0.3).select("vec_id", "label")


def _hits_with_meta(spark, sf):
    chunks = written(window_chunks(spark, sf))
    hits = bm25_search(topic_queries(spark, sf), lexical_index(chunks), 20)
    return chunks.drop("source", "pages").join(hits.drop("source"), "chunk_id")


META_CTES = f"{WINDOW_CHUNKS_SQL}, {TOPIC_QUERIES_SQL}, {q.bm25(20)}, mh AS MATERIALIZED (SELECT * FROM bmk JOIN meta USING (source, chunk_id, text)) "
META_CTES = META_CTES.replace("USING (source, chunk_id, text)", "USING (source, chunk_id)")


@query(
    "credit_relevance",
    f"WITH {META_CTES} SELECT query_id, credit_id AS credit, max(score) AS best_score, count(*) AS n_chunks, "
    "round(max(score) + 0.01::DOUBLE * least(count(*), 5), 9) AS relevance FROM mh GROUP BY ALL",
)
def credit_relevance_query(spark, sf):
    return credit_relevance(_hits_with_meta(spark, sf), ["query_id"])


PICK_SQL = """sp AS (SELECT *, row_number() OVER (PARTITION BY query_id, credit_id, section ORDER BY score DESC, rank) AS sec,
  CASE section WHEN 'requirements' THEN 10 WHEN 'intent' THEN 9 WHEN 'documentation' THEN 8 ELSE 5 END AS prio FROM {hits}),
pk AS (SELECT *, row_number() OVER (PARTITION BY query_id, credit_id ORDER BY (sec = 1) DESC,
  CASE WHEN sec = 1 THEN prio END DESC NULLS LAST, score DESC, rank) AS pick FROM sp QUALIFY pick <= {n})"""


@query(
    "section_pick",
    f"WITH {META_CTES}, {PICK_SQL.format(hits='mh', n=2)} SELECT query_id, credit_id, chunk_id, section, pick FROM pk",
)
def section_pick(spark, sf):
    return pick_sections(_hits_with_meta(spark, sf), ["query_id", "credit_id"], 2).select(
        "query_id", "credit_id", "chunk_id", "section", "pick"
    )


GROUP_SQL = """cr AS (SELECT *, round(max(score) OVER (PARTITION BY query_id, credit_id) + 0.01::DOUBLE * least(count(*) OVER (PARTITION BY query_id, credit_id), 5), 9) AS relevance,
  min(rank) OVER (PARTITION BY query_id, credit_id) AS fr FROM {hits}),
crk AS (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY relevance DESC, fr) AS credit_rank FROM cr QUALIFY credit_rank <= {top}),
"""
GROUP_END = """, grp AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id ORDER BY score DESC, credit_rank, pick) AS rank FROM pk)"""


@query(
    "grouped_search",
    f"WITH {META_CTES}, {GROUP_SQL.format(hits='mh', top=3)} {PICK_SQL.format(hits='crk', n=2)} {GROUP_END} "
    "SELECT query_id, credit_id, chunk_id, credit_rank, score, rank FROM grp",
)
def grouped_search(spark, sf):
    return group_by_credit(_hits_with_meta(spark, sf), ["query_id"], 3, 2).select(
        "query_id", "credit_id", "chunk_id", "credit_rank", "score", "rank"
    )


@query(
    "query_features",
    f"WITH {TOPIC_QUERIES_SQL}, {q.FEATURES} SELECT query_id, array_to_string(categories, ',') AS categories, array_to_string(codes, ',') AS codes, "
    "array_to_string(terms, ',') AS terms, has_requirements, has_thresholds, has_documentation FROM feat",
)
def query_features_query(spark, sf):
    f = query_features(topic_queries(spark, sf))
    return f.select(
        "query_id", *[F.array_join(c, ",").alias(c) for c in ("categories", "codes", "terms")],
        "has_requirements", "has_thresholds", "has_documentation",
    )


@query("query_expansion", f"WITH {TOPIC_QUERIES_SQL}, {q.EXPANSION} SELECT query_id, sub_no, sub_query FROM subs")
def query_expansion(spark, sf):
    return expand_queries(topic_queries(spark, sf))


@query(
    "synonym_expand",
    f"WITH {TOPIC_QUERIES_SQL}, lq AS (SELECT query_id, {q.with_domain('text')} AS lt FROM q) SELECT query_id, {q.with_synonyms('lt')} AS expanded FROM lq",
)
def synonym_expand(spark, sf):
    return topic_queries(spark, sf).select("query_id", with_synonyms(with_domain_word(F.col("text"))).alias("expanded"))
