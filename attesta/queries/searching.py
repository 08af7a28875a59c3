"""The full retrieval plan and what users call on top of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import result_key, tokens
from ..operators.lexical import bm25_search, lexical_index
from ..plans.evaluation import (
    SMOKE_QUERIES, evaluation_summary, query_relevance, retrieval_quality, smoke_queries, verdicts,
)
from ..plans.evidence import citation_blocks, citations, context_blocks, key_facts, prompts
from ..plans.index import StoredIndex, search_index
from ..plans.reports import credit_reports
from ..plans.search import (
    analyze_projects, credit_queries, guidance, merge_second_source, route_sources, search, source_labels,
)
from ..session import shared_folder, table, written
from . import sqltext as q
from .chunks import HTML_SQL, page_texts
from .inputs import PASSAGES_SQL, TOPIC_QUERIES_SQL, WINDOW_CHUNKS_SQL, passages, topic_queries, window_chunks
from .registry import query
from .retrieval import GROUP_END, GROUP_SQL, PICK_SQL


def search_sql(queries: str, k: int, top: int = 3, expand: bool = True, chunks: str = WINDOW_CHUNKS_SQL) -> str:
    """CTEs ending in found(query_id, source, chunk_id, text, credit_id, …, score, rank); `queries` defines q."""
    per = max(2, k // top)
    depth = 3 * k
    asked = (
        f"""{q.EXPANSION},
ns AS (SELECT query_id, count(*) AS n FROM subs GROUP BY ALL),
asked AS MATERIALIZED (SELECT query_id || '#' || sub_no AS query_id, sub_query AS text FROM subs JOIN ns USING (query_id) WHERE n > 1
   UNION ALL SELECT query_id || '#1', text FROM q LEFT JOIN ns USING (query_id) WHERE coalesce(n, 0) <= 1)"""
        if expand
        else "asked AS MATERIALIZED (SELECT query_id || '#1' AS query_id, text FROM q)"
    )
    return f"""{chunks}, {queries}, {asked},
dq AS (SELECT query_id, {q.with_synonyms('lt')} AS text FROM (SELECT query_id, {q.with_domain('text')} AS lt FROM asked)),
{q.bm25(depth, 'asked')}, {q.text_dense(depth)}, {q.weighted('fz', 'dek', 'bmk')},
lst AS (SELECT string_split(query_id, '#')[1] AS query_id, string_split(query_id, '#')[2]::INT AS list_no, source, chunk_id, score, rank FROM fz),
one AS (SELECT string_split(query_id, '#')[1] AS query_id, count(*) = 1 AS single FROM asked GROUP BY ALL),
rf AS (SELECT query_id, source, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rs, max(score) AS os, min(list_no * 1000000 + rank) AS f FROM lst GROUP BY ALL),
rg AS (SELECT query_id, source, chunk_id, single, CASE WHEN single THEN os ELSE rs END AS score,
   row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN single THEN NULL ELSE rs END DESC NULLS LAST, f) AS r0 FROM rf JOIN one USING (query_id)),
rh AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r0) AS rank, max(score) OVER (PARTITION BY query_id) AS best FROM rg),
kept AS MATERIALIZED (SELECT query_id, source, chunk_id, score, rank FROM rh WHERE NOT single OR score > 0.3 OR (best <= 0.3 AND rank <= {2 * k})),
km AS MATERIALIZED (SELECT * FROM kept JOIN meta USING (source, chunk_id)),
k1 AS (SELECT *, first_value(chunk_id) OVER w AS rep, row_number() OVER w AS n1 FROM km WINDOW w AS (PARTITION BY query_id, credit_id, section ORDER BY rank)),
cs AS (SELECT query_id, chunk_id, rep, sum(a.w * b.w) AS cos FROM (SELECT DISTINCT query_id, chunk_id, rep FROM k1 WHERE n1 > 1) p
   JOIN dv a USING (chunk_id) JOIN dv b ON b.chunk_id = rep AND a.dim = b.dim GROUP BY ALL),
k2 AS (SELECT k1.* FROM k1 LEFT JOIN cs USING (query_id, chunk_id, rep) WHERE n1 = 1 OR coalesce(cos, 0) < 0.97),
nd AS MATERIALIZED (SELECT * FROM k2 QUALIFY row_number() OVER (PARTITION BY query_id, doc, page ORDER BY rank) = 1),
{GROUP_SQL.format(hits='nd', top=top)} {PICK_SQL.format(hits='crk', n=per)} {GROUP_END},
found AS MATERIALIZED (SELECT * FROM grp WHERE rank <= {k})"""


def _index(spark, sf):
    return search_index(written(window_chunks(spark, sf)))


FULL = f"WITH {search_sql(TOPIC_QUERIES_SQL, 5)}"


@query("full_search", f"{FULL} SELECT query_id::BIGINT AS query_id, chunk_id, credit_id, section, score, rank FROM found")
def full_search(spark, sf):
    hits = search(topic_queries(spark, sf), _index(spark, sf), 5)
    return hits.select("query_id", "chunk_id", "credit_id", "section", "score", "rank")


@query(
    "full_search_plain",
    f"WITH {search_sql(TOPIC_QUERIES_SQL, 5, expand=False)} SELECT query_id::BIGINT AS query_id, chunk_id, rank, score FROM kept WHERE rank <= 5",
)
def full_search_plain(spark, sf):
    """Without expansion and grouping."""
    hits = search(topic_queries(spark, sf), _index(spark, sf), 5, group=False, expand=False)
    return hits.select("query_id", "chunk_id", "score", "rank")


ROUTE_SQL = """q0 AS (SELECT item_id AS query_id, text, CASE item_id % 4 WHEN 0 THEN ['src1', 'nowhere'] WHEN 1 THEN ['nowhere'] WHEN 2 THEN NULL ELSE ['src3', 'src2'] END AS sources FROM benchmark),
known AS (SELECT ['all', 'src1', 'src2', 'src3'] AS ks),
q1 AS (SELECT query_id, text, list_filter(coalesce(sources, []), lambda s: list_contains(ks, s)) AS good FROM q0, known),
routed AS (SELECT query_id, text, CASE WHEN len(good) > 0 THEN good ELSE ['all'] END AS used FROM q1)"""


def _requested(spark, sf):
    i = F.col("query_id") % 4
    asked = (
        F.when(i == 0, F.array(F.lit("src1"), F.lit("nowhere"))).when(i == 1, F.array(F.lit("nowhere")))
        .when(i == 3, F.array(F.lit("src3"), F.lit("src2")))
    )
    return route_sources(passages(spark, sf).withColumn("sources", asked), ["all", "src1", "src2", "src3"])


@query("source_routing", f"WITH {ROUTE_SQL} SELECT query_id, array_to_string(used, ',') AS used_sources FROM routed")
def source_routing(spark, sf):
    return _requested(spark, sf).select("query_id", F.array_join("used_sources", ",").alias("used_sources"))


@query(
    "routed_lexical_search",
    f"""WITH chunks AS (SELECT source, doc_id AS chunk_id, text FROM documents UNION ALL SELECT 'all', doc_id, text FROM documents), {ROUTE_SQL},
q AS (SELECT query_id, text FROM routed), {q.bm25(1000000)},
u AS (SELECT query_id, unnest(used) AS source FROM routed)
SELECT query_id, source, chunk_id, score, rank FROM bmk JOIN u USING (query_id, source) WHERE rank <= 5""",
)
def routed_lexical_search(spark, sf):
    docs = table(spark, sf, "documents").select("source", F.col("doc_id").alias("chunk_id"), "text")
    routed = _requested(spark, sf).select("query_id", "text", F.explode("used_sources").alias("source"))
    return bm25_search(routed, lexical_index(docs, all_source="all"), 5).select("query_id", "source", "chunk_id", "score", "rank")


PROJECTS_SQL = """proj AS (SELECT s_suppkey AS project_id, CASE s_nationkey % 5 WHEN 0 THEN 'NC' WHEN 1 THEN 'CS' WHEN 2 THEN 'Schools' ELSE 'NC' END AS project_type,
  CASE s_suppkey % 3 WHEN 0 THEN ['EA', 'WE'] WHEN 1 THEN ['MR'] ELSE ['SS', 'site'] END AS targets FROM supplier),
pq AS (SELECT project_id || '/' || (generate_subscripts(targets, 1) - 1) AS query_id, project_id, unnest(targets) AS credit_code, project_type FROM proj),
q AS (SELECT query_id, credit_code || ' credit requirements for ' || project_type || ' projects' AS text FROM pq)"""


def supplier_projects(spark, sf):
    k, r = F.col("s_suppkey"), F.col("s_nationkey") % 5
    return table(spark, sf, "supplier").select(
        k.alias("project_id"),
        F.when(r == 1, "CS").when(r == 2, "Schools").when(r == 0, "NC").alias("project_type"),
        F.when(k % 3 == 0, F.array(F.lit("EA"), F.lit("WE"))).when(k % 3 == 1, F.array(F.lit("MR")))
        .otherwise(F.array(F.lit("SS"), F.lit("site"))).alias("target_credits"),
    )


@query("target_queries", f"WITH {PROJECTS_SQL} SELECT query_id, project_id, credit_code, text FROM pq JOIN q USING (query_id)")
def target_queries(spark, sf):
    return credit_queries(supplier_projects(spark, sf))


# the document words that occur in the queries are few, so articles are renamed to query words
QUERY_WORDS = [(" the ", " requirements "), (" la ", " credit "), (" die ", " projects "), (" el ", " for ")]


def _worded(text):
    for a, b in QUERY_WORDS:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


WORDED_CHUNKS_SQL = WINDOW_CHUNKS_SQL.replace(
    "AS chunk_id, text, source AS credit_id",
    "AS chunk_id, replace(replace(replace(replace(text, ' the ', ' requirements '), ' la ', ' credit '), ' die ', ' projects '), ' el ', ' for ') AS text, source AS credit_id",
)


@query(
    "document_analyze",
    f"WITH {search_sql(PROJECTS_SQL, 3, chunks=WORDED_CHUNKS_SQL)} SELECT project_id, pq.credit_code, coalesce(chunk_id, '-') AS chunk_id, coalesce(score, 0) AS score, coalesce(rank, 0) AS rank, 'needs_review' AS compliance_status FROM pq LEFT JOIN found USING (query_id)",
)
def document_analyze(spark, sf):
    chunks = window_chunks(spark, sf).withColumn("text", _worded(F.col("text")))
    a = analyze_projects(supplier_projects(spark, sf), search_index(written(chunks.drop("credit_code"))), 3)
    return a.select(
        "project_id", "credit_code", F.coalesce("chunk_id", F.lit("-")).alias("chunk_id"), F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("rank", F.lit(0)).alias("rank"), "compliance_status",
    )


# search hits whose texts carry the words the text rules look for
MARKED = "replace(replace(replace(text, ' the ', ' must '), ' and ', ' should '), ' of ', ' requirement ')"


def marked(text):
    for a, b in [(" the ", " must "), (" and ", " should "), (" of ", " requirement ")]:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def _lexical_hits(spark, sf, k):
    """Top k windows per passage with metadata and marked texts."""
    chunks = written(window_chunks(spark, sf))
    hits = written(bm25_search(topic_queries(spark, sf), lexical_index(chunks), k))
    return chunks.join(hits, ["source", "chunk_id"]).withColumn("text", marked(F.col("text")))


def lexical_hits_sql(k: int) -> str:
    return f"""{WINDOW_CHUNKS_SQL}, {TOPIC_QUERIES_SQL}, {q.bm25(k)},
lh AS MATERIALIZED (SELECT query_id, bmk.chunk_id, bmk.source, score, rank, {MARKED} AS text, credit_id, credit_code, credit_name, category, section, doc, page FROM bmk JOIN meta USING (source, chunk_id))"""


def _top3(name: str, words: list[str], texts: list[str]) -> str:
    any_s = " OR ".join(f"contains(lower(s), '{w}')" for w in words)
    any_t = " OR ".join(f"contains(lower(text), '{w}')" for w in texts)
    return f"""{name}0 AS (SELECT query_id, rank, unnest(string_split(text, '.')) AS s, generate_subscripts(string_split(text, '.'), 1) AS i FROM lh WHERE {any_t}),
{name}1 AS (SELECT query_id, {q.strip('s')} AS s, row_number() OVER (PARTITION BY query_id ORDER BY rank, i) AS n FROM {name}0 WHERE {any_s}),
{name} AS (SELECT query_id, string_agg(s, ' ~ ' ORDER BY n) AS {name} FROM {name}1 WHERE n <= 3 GROUP BY ALL)"""


@query(
    "guidance_sentences",
    f"""WITH {lexical_hits_sql(3)}, {_top3('recommendations', ['recommend', 'should', 'consider', 'implement'], ['recommend', 'should', 'consider'])},
{_top3('guidance', ['requirement', 'must', 'prerequisite', 'comply'], ['requirement', 'must', 'prerequisite'])}
SELECT query_id, coalesce(recommendations, '') AS recommendations, coalesce(guidance, '') AS guidance FROM (SELECT DISTINCT query_id FROM lh) LEFT JOIN recommendations USING (query_id) LEFT JOIN guidance USING (query_id)""",
)
def guidance_sentences(spark, sf):
    g = guidance(_lexical_hits(spark, sf, 3), ["query_id"])
    return g.select(
        "query_id", F.array_join("recommendations", " ~ ").alias("recommendations"), F.array_join("guidance", " ~ ").alias("guidance")
    )


@query(
    "citations_block",
    f"""WITH {lexical_hits_sql(4)}, c AS (SELECT query_id, rank, credit_code AS label, page, {q.compact('text')} AS snippet FROM lh),
d AS (SELECT query_id, rank, rank || '. **' || label || '** — from all — (pages ' || page || ')' || CASE WHEN length(trim(snippet)) > 20 THEN chr(10) || '   "' || {q.compact('snippet', 150)} || '"' ELSE '' END || chr(10) AS line FROM c)
SELECT query_id, '**Reference Sources:**' || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY rank) AS citations FROM d GROUP BY ALL""",
)
def citations_block(spark, sf):
    return citation_blocks(citations(_lexical_hits(spark, sf, 4)))


@query(
    "report_prompts",
    f"""WITH {lexical_hits_sql(3)}, c AS (SELECT query_id, string_agg('Reference ' || rank || ' (Score: ' || printf('%.3f', score) || '):' || chr(10) || text || chr(10), chr(10) ORDER BY rank) AS context FROM lh GROUP BY ALL)
SELECT query_id, 'Write a certification report for the credit below from the references given.' || chr(10) || 'Credit: EA Unknown' || chr(10) || 'Type: Credit' || chr(10) || 'Points: 0-5' || chr(10) || chr(10)
 || 'Query: ' || text || chr(10) || chr(10) || 'References:' || chr(10) || coalesce(context, '') AS prompt FROM q LEFT JOIN c USING (query_id)""",
)
def report_prompts(spark, sf):
    none = F.lit(None).cast("string")
    asked = topic_queries(spark, sf).select(
        "query_id", "text", F.lit("EA").alias("credit_code"), none.alias("credit_name"), none.alias("credit_type"),
        F.lit(None).cast("int").alias("points_min"), F.lit(5).alias("points_max"),
    )
    return prompts(asked, context_blocks(_lexical_hits(spark, sf, 3)))


@query(
    "key_facts",
    f"""WITH {lexical_hits_sql(4)}, t AS (SELECT query_id, rank, text, credit_code FROM lh WHERE rank <= 3),
rl AS (SELECT query_id, rank, unnest(list_slice(list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: s <> '' AND (contains(lower(s), 'requirement') OR starts_with(s, '-'))), 1, 3)) AS s,
   unnest([1, 2, 3]) AS i FROM t WHERE contains(lower(text), 'requirement')),
rr AS (SELECT query_id, string_agg(s, ' ~ ' ORDER BY rank, i) AS requirements FROM rl WHERE s IS NOT NULL GROUP BY ALL),
ks AS (SELECT query_id, rank, unnest(list_slice(list_filter(list_transform(string_split(text, '.'), lambda s: trim(s)), lambda s: length(s) > 30), 1, 2)) AS s, unnest([1, 2]) AS i FROM t WHERE length(text) > 50),
kk AS (SELECT query_id, string_agg(s, ' ~ ' ORDER BY rank, i) AS key_points FROM ks WHERE s IS NOT NULL GROUP BY ALL),
p AS (SELECT query_id, credit_code AS primary_credit, category FROM lh WHERE rank = 1),
rc0 AS (SELECT query_id, credit_code, min(rank) AS r FROM lh JOIN p USING (query_id) WHERE rank > 1 AND credit_code <> primary_credit GROUP BY ALL),
rc AS (SELECT query_id, string_agg(credit_code, ',' ORDER BY r) AS related_credits FROM rc0 GROUP BY ALL)
SELECT query_id, primary_credit, category, coalesce(requirements, '') AS requirements, coalesce(key_points, '') AS key_points, coalesce(related_credits, '') AS related_credits
FROM p LEFT JOIN rr USING (query_id) LEFT JOIN kk USING (query_id) LEFT JOIN rc USING (query_id)""",
)
def key_facts_query(spark, sf):
    k = key_facts(_lexical_hits(spark, sf, 4))
    return k.select(
        "query_id", "primary_credit", "category", F.array_join("requirements", " ~ ").alias("requirements"),
        F.array_join("key_points", " ~ ").alias("key_points"), F.array_join("related_credits", ",").alias("related_credits"),
    )


@query(
    "result_keys",
    f"""WITH {lexical_hits_sql(10)} SELECT query_id, rank, CASE rank % 3 WHEN 0 THEN 'chunk_id:' || chunk_id WHEN 1 THEN 'credit:' || credit_id || '::section:' || section || '::pages:' || page || '-' || page
 ELSE 'text_hash:' || md5(text) END AS result_key FROM lh""",
)
def result_keys(spark, sf):
    r = F.col("rank") % 3
    key = result_key(
        F.when(r == 0, F.col("chunk_id")), F.when(r == 1, F.col("credit_id")), F.col("section"), F.col("page_start"),
        F.col("page_end"), F.col("text"), F.col("rank"), F.col("score"),
    )
    return _lexical_hits(spark, sf, 10).select("query_id", "rank", key.alias("result_key"))


def _with_topics(spark, sf):
    long_words = F.filter(F.array_distinct(tokens(F.col("text"))), lambda t: F.length(t) >= 7)
    return topic_queries(spark, sf).select("query_id", F.concat(long_words, F.array(F.lit("EN"))).alias("expected_topics"))


EVAL_SQL = f"""{lexical_hits_sql(5)}, tp AS (SELECT query_id, list_append(list_filter(list_distinct({q.toks('text')}), lambda t: length(t) >= 7), 'en') AS topics FROM q),
rel AS (SELECT query_id, rank, least(1.0::DOUBLE, len(list_filter(topics, lambda t: contains(lower(text), t)))::DOUBLE / len(topics)
   + CASE WHEN len(list_filter(topics, lambda t: contains(lower(credit_code), t))) > 0 THEN 0.2::DOUBLE ELSE 0 END
   + CASE WHEN len(list_filter(topics, lambda t: contains(lower(category), t))) > 0 THEN 0.1::DOUBLE ELSE 0 END) AS rel FROM lh JOIN tp USING (query_id)),
ev AS (SELECT query_id, count(rel) AS n_results, coalesce(round(avg(rel), 6), 0.0)::DOUBLE AS relevance FROM tp LEFT JOIN rel USING (query_id) GROUP BY ALL)"""


@query("eval_relevance", f"WITH {EVAL_SQL} SELECT query_id, n_results, relevance FROM ev")
def eval_relevance(spark, sf):
    return query_relevance(_with_topics(spark, sf), _lexical_hits(spark, sf, 5).drop("query_text"))


@query(
    "eval_summary",
    f"""WITH {EVAL_SQL}, rt AS (SELECT user_id AS query_id, avg(value) / 10 AS response_time FROM events GROUP BY ALL),
r AS (SELECT query_id, n_results > 0 AND relevance > 0.2 AS success, relevance, coalesce(response_time, 0) AS response_time FROM ev LEFT JOIN rt USING (query_id)),
s AS (SELECT count(*) AS total_queries, count(*) FILTER (success) AS successful_queries, round(count(*) FILTER (success) / count(*)::DOUBLE, 6) AS success_rate,
 round(coalesce(avg(relevance) FILTER (success), 0), 6) AS average_relevance, round(coalesce(avg(response_time) FILTER (success), 0), 6) AS average_response_time FROM r)
SELECT *, CASE WHEN average_response_time < 2.0 THEN 'met' ELSE 'not met: above two seconds' END AS time_verdict,
 CASE WHEN average_relevance > 0.6 THEN 'met' ELSE 'not met: at or below 0.6' END AS relevance_verdict,
 CASE WHEN success_rate > 0.8 THEN 'met' ELSE 'not met: at or below 0.8' END AS success_verdict FROM s""",
)
def eval_summary(spark, sf):
    """Response times come from the query log: mean event value per user, a user standing for a query."""
    times = table(spark, sf, "events").groupBy(F.col("user_id").alias("query_id")).agg((F.avg("value") / 10).alias("response_time"))
    rel = query_relevance(_with_topics(spark, sf), _lexical_hits(spark, sf, 5))
    results = rel.join(times, "query_id", "left").select(
        ((F.col("n_results") > 0) & (F.col("relevance") > 0.2)).alias("success"), "relevance",
        F.coalesce("response_time", F.lit(0.0)).alias("response_time"),
    )
    return verdicts(evaluation_summary(results))


@query(
    "retrieval_quality",
    f"""WITH {FULL[5:]}, tops AS (SELECT q.query_id, score FROM q LEFT JOIN found ON found.query_id = q.query_id::VARCHAR AND found.rank = 1)
SELECT count(*) AS total_queries, count(score) AS queries_with_results, round(coalesce(avg(score), 0), 6) AS average_top_score, count(*) FILTER (score > 0.7) AS high,
 count(*) FILTER (score > 0.5 AND score <= 0.7) AS medium, count(*) FILTER (score <= 0.5) AS low, (SELECT count(DISTINCT credit_code) FROM found) AS n_codes, (SELECT count(DISTINCT category) FROM found) AS n_categories FROM tops""",
)
def retrieval_quality_query(spark, sf):
    asked = topic_queries(spark, sf)
    return retrieval_quality(asked, written(search(asked, _index(spark, sf), 5)))


SMOKE_SQL = "q(query_id, text) AS (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(SMOKE_QUERIES)) + ")"


@query(
    "smoke_suite",
    f"WITH {search_sql(SMOKE_SQL, 3, chunks=WORDED_CHUNKS_SQL)} SELECT query_id::BIGINT AS query_id, chunk_id, score, rank FROM found",
)
def smoke_suite(spark, sf):
    """The fixed evaluation queries over all documents, three results each."""
    chunks = window_chunks(spark, sf).withColumn("text", _worded(F.col("text")))
    hits = search(smoke_queries(spark), search_index(written(chunks)), 3)
    return hits.select("query_id", "chunk_id", "score", "rank")


@query(
    "two_source_results",
    f"""WITH {lexical_hits_sql(3)}, {HTML_SQL}, wc AS (SELECT 'web' AS source, page_id AS chunk_id, text FROM ht), {q.bm25(3, 'q', 'wc', 'w_')}
SELECT query_id, 'Knowledge Base' AS source_kind, rank, credit_name AS title, md5(text) AS text_md5, source FROM lh
UNION ALL SELECT query_id, 'Web Search', rank, title, md5(text), url FROM w_bmk JOIN ht ON page_id = chunk_id""",
)
def two_source_results(spark, sf):
    m = _two_sources(spark, sf)
    return m.select("query_id", "source_kind", "rank", "title", F.md5("text").alias("text_md5"), "source")


def _two_sources(spark, sf):
    """Corpus hits next to hits in the web pages."""
    pages = page_texts(spark, sf)
    web = bm25_search(
        topic_queries(spark, sf), lexical_index(pages.select(F.lit("web").alias("source"), F.col("page_id").alias("chunk_id"), "text")), 3
    )
    other = pages.join(written(web.select("query_id", "rank", F.col("chunk_id").alias("page_id"))), "page_id").select(
        "query_id", "rank", "title", "text", F.col("url").alias("source")
    )
    return merge_second_source(_lexical_hits(spark, sf, 3), other, 3)


@query(
    "two_source_labels",
    f"""WITH {lexical_hits_sql(3)}, {HTML_SQL}, wc AS (SELECT 'web' AS source, page_id AS chunk_id, text FROM ht), {q.bm25(3, 'q', 'wc', 'w_')},
l AS (SELECT query_id, 'Knowledge Base: ' || source AS label FROM lh UNION SELECT query_id, 'Web Search: ' || url FROM w_bmk JOIN ht ON page_id = chunk_id)
SELECT query_id, string_agg(label, ' ~ ' ORDER BY label) AS sources FROM l GROUP BY ALL""",
)
def two_source_labels(spark, sf):
    return source_labels(_two_sources(spark, sf)).select("query_id", F.array_join("sources", " ~ ").alias("sources"))


VECTORS_SQL = f"""chunks AS (SELECT 'all' AS source, doc_id AS chunk_id, text FROM documents), {PASSAGES_SQL}, {q.bm25(15)},
cv AS (SELECT doc_id AS chunk_id, embedding::DOUBLE[] AS v FROM documents JOIN embeddings ON vec_id = doc_id),
qv AS (SELECT query_id, embedding::DOUBLE[] AS v FROM q JOIN embeddings ON vec_id = 3 * query_id WHERE query_id % 4 <> 0),
de AS (SELECT query_id, 'all' AS source, chunk_id, round(list_cosine_similarity(cv.v, qv.v), 6) AS score FROM cv, qv),
dek AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, chunk_id) AS rank FROM de QUALIFY rank <= 15),
{q.weighted('fz', 'dek', 'bmk')},
best AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM fz)"""


@query(
    "search_supplied_vectors",
    f"""WITH {VECTORS_SQL}
SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM best
WHERE score > 0.3 OR (best <= 0.3 AND rank <= 10) QUALIFY rank <= 5""",
)
def search_supplied_vectors(spark, sf):
    """The search over given vectors of chunks and queries; chunks and every fourth query without one are found by words only."""
    given = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    docs = table(spark, sf, "documents").select(F.lit("all").alias("source"), F.col("doc_id").alias("chunk_id"), "text")
    chunks = docs.join(given, docs["chunk_id"] == given["vec_id"], "left").drop("vec_id")
    asked = passages(spark, sf)
    wanted = F.when(asked["query_id"] % 4 != 0, 3 * asked["query_id"])
    queries = asked.join(given, wanted == given["vec_id"], "left").drop("vec_id")
    hits = search(queries, search_index(written(chunks), vector="vector"), 5, group=False, expand=False)
    return hits.select("query_id", "chunk_id", "score", "rank")


@query(
    "index_add_remove",
    f"""WITH chunks AS (SELECT source, doc_id AS chunk_id, text FROM documents WHERE doc_id % 5 <> 1 UNION ALL SELECT 'all', doc_id, text FROM documents WHERE doc_id % 5 <> 1),
{PASSAGES_SQL}, {q.bm25(5)} SELECT query_id, source, chunk_id, score, rank FROM bmk WHERE source IN ('all', 'src1')""",
)
def index_add_remove(spark, sf):
    """A stored index that grew in two steps and lost a fifth of its chunks, searched in two sources."""
    docs = table(spark, sf, "documents").select("source", F.col("doc_id").alias("chunk_id"), "text")
    index = StoredIndex(spark, shared_folder(spark), all_source="all")
    third = F.col("chunk_id") % 3 == 0
    index.add(docs.filter(third))
    index.add(docs.filter(~third))
    index.remove(docs.filter(F.col("chunk_id") % 5 == 1))
    asked = passages(spark, sf).withColumn("source", F.explode(F.array(F.lit("all"), F.lit("src1"))))
    return bm25_search(asked, index.read().lexical, 5).select("query_id", "source", "chunk_id", "score", "rank")


INTENT = "replace(text, ' that ', chr(10) || 'Intent: ')"


@query(
    "credit_intents",
    f"""WITH {lexical_hits_sql(3)}, t AS (SELECT query_id, rank, {INTENT} AS t FROM lh),
i AS (SELECT query_id, rank, nullif(trim(replace(string_split(substr(t, instr(lower(t), 'intent:')), chr(10))[1], 'Intent:', '')), '') AS intent FROM t WHERE instr(lower(t), 'intent:') > 0)
SELECT query_id, arg_min(intent, rank) FILTER (intent IS NOT NULL) AS intent FROM (SELECT DISTINCT query_id FROM lh) LEFT JOIN i USING (query_id) GROUP BY ALL""",
)
def credit_intents(spark, sf):
    """Intent lines of the best hits; a common word stands for the start of such a line."""
    hits = _lexical_hits(spark, sf, 3).withColumn("text", F.replace("text", F.lit(" that "), F.lit("\nIntent: ")))
    return key_facts(hits).select("query_id", "intent")


GUIDED_SQL = f"""{search_sql(TOPIC_QUERIES_SQL, 3)}, lh AS (SELECT query_id::BIGINT AS query_id, rank, {MARKED} AS text FROM found),
{_top3('recommendations', ['recommend', 'should', 'consider', 'implement'], ['recommend', 'should', 'consider'])},
{_top3('guidance', ['requirement', 'must', 'prerequisite', 'comply'], ['requirement', 'must', 'prerequisite'])}"""


def _guided(spark, sf):
    hits = search(topic_queries(spark, sf), _index(spark, sf), 3)
    return guidance(hits.withColumn("text", marked(F.col("text"))), ["query_id"])


@query(
    "guidance_search",
    f"""WITH {GUIDED_SQL} SELECT query_id, coalesce(recommendations, '') AS recommendations, coalesce(guidance, '') AS guidance
FROM (SELECT DISTINCT query_id FROM lh) LEFT JOIN recommendations USING (query_id) LEFT JOIN guidance USING (query_id)""",
)
def guidance_search(spark, sf):
    """Recommendations and guidance from the hits of the whole search."""
    return _guided(spark, sf).select(
        "query_id", F.array_join("recommendations", " ~ ").alias("recommendations"), F.array_join("guidance", " ~ ").alias("guidance")
    )


@query(
    "credit_reports",
    f"""WITH {GUIDED_SQL}, p AS (SELECT c_custkey AS project_id, c_name, c_mktsegment, c_custkey % 64 AS query_id, CASE WHEN c_custkey % 2 = 0 THEN 'EA' ELSE 'WE' END AS credit_code FROM customer)
SELECT project_id, credit_code, '# ' || credit_code || ' Credit Analysis Report' || chr(10) || '**Project:** ' || c_name || chr(10) || '**Project Type:** ' || c_mktsegment || chr(10)
 || coalesce(chr(10) || '### Recommendations' || chr(10) || '- ' || replace(recommendations, ' ~ ', chr(10) || '- ') || chr(10), '')
 || coalesce(chr(10) || '### Compliance Guidance' || chr(10) || '- ' || replace(guidance, ' ~ ', chr(10) || '- ') || chr(10), '') AS report
FROM p LEFT JOIN recommendations USING (query_id) LEFT JOIN guidance USING (query_id)""",
)
def credit_reports_query(spark, sf):
    """Customers as projects, each with a report on the topic it asks for."""
    k = F.col("c_custkey")
    projects = table(spark, sf, "customer").select(
        (k % 64).alias("query_id"), k.alias("project_id"), F.col("c_name").alias("project_name"), F.col("c_mktsegment").alias("project_type"),
        F.when(k % 2 == 0, "EA").otherwise("WE").alias("credit_code"),
    )
    return credit_reports(projects, written(_guided(spark, sf)))
