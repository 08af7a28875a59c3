"""Evidence analysis and reports on top of the whole search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.assistant import analyze_evidence
from ..operators.lexical import bm25_search, lexical_index
from ..plans.evaluation import DEPLOYMENT_QUERIES, EVALUATION_QUERIES, deployment_queries, evaluation_queries, query_relevance
from ..plans.index import read_index, search_index, write_index
from ..plans.reports import evaluation_report, search_reports
from ..plans.search import at_hits, route_sources, search
from ..session import shared_folder, table, written
from . import sqltext as q
from .inputs import TOPIC_QUERIES_SQL, topic_queries, window_chunks
from .registry import QUERIES, SQL, query
from .searching import FULL, WORDED_CHUNKS_SQL, _index, _worded, search_sql

DIM = "('0x' || substr(md5(term), 1, 5))::INT"


@query(
    "assistant_analysis",
    f"""WITH {search_sql(TOPIC_QUERIES_SQL, 4)},
ev AS (SELECT conv_id || '/' || turn AS evidence_id, conv_id % 50 AS query_id, CASE WHEN turn % 6 = 5 THEN ' ' ELSE text END AS text FROM conversations),
et AS (SELECT evidence_id, {DIM} AS dim, count(*)::DOUBLE AS n FROM (SELECT evidence_id, unnest({q.toks('text')}) AS term FROM ev) GROUP BY ALL),
evv AS (SELECT evidence_id, dim, n / sqrt(sum(n * n) OVER (PARTITION BY evidence_id)) AS w FROM et),
prs AS (SELECT evidence_id, f.chunk_id, f.rank, f.text AS ftext FROM ev JOIN found f ON ev.query_id = f.query_id::BIGINT),
sc AS (SELECT evidence_id, chunk_id, round(sum(evv.w * dv.w), 6) AS s FROM prs JOIN evv USING (evidence_id) JOIN dv USING (chunk_id, dim) GROUP BY ALL),
sa AS (SELECT p.evidence_id, p.rank, p.ftext, coalesce(s, 0.0) AS s FROM prs p LEFT JOIN sc USING (evidence_id, chunk_id)),
ag AS (SELECT evidence_id, max(s) AS top, sum(s) / count(*) AS avg, arg_max(ftext, s * 100 - rank / 1000000.0) AS best FROM sa GROUP BY ALL),
fa AS (SELECT query_id::BIGINT AS query_id, arg_min(credit_code, rank) AS primary_credit, count(*) AS n_references FROM found GROUP BY ALL),
ci AS (SELECT query_id::BIGINT AS query_id, rank, rank || '. **' || credit_code || '** — from all — (pages ' || page || ')'
  || CASE WHEN length(trim({q.compact('text')})) > 20 THEN chr(10) || '   "' || {q.compact(q.compact('text'), 150)} || '"' ELSE '' END || chr(10) AS line FROM found),
cb AS (SELECT query_id, '**Reference Sources:**' || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY rank) AS citations FROM ci GROUP BY ALL)
SELECT ev.evidence_id, ev.query_id, CASE WHEN trim(ev.text) = '' OR top IS NULL THEN 'unknown' WHEN top >= 0.42 OR avg >= 0.32 THEN 'supported' ELSE 'insufficient' END AS decision,
 CASE WHEN trim(ev.text) = '' OR top IS NULL THEN 0.0 ELSE round(greatest(top, avg), 6) END AS confidence,
 CASE WHEN trim(ev.text) = '' OR top IS NULL THEN '-' ELSE {q.compact('best', 180)} END AS top_chunk, coalesce(primary_credit, '-') AS primary_credit, coalesce(md5(citations), '-') AS citations_md5
FROM ev LEFT JOIN ag USING (evidence_id) LEFT JOIN fa USING (query_id) LEFT JOIN cb USING (query_id)""",
)
def assistant_analysis(spark, sf):
    """Conversation turns as evidence; the searched topics give references, decision and key facts."""
    ev = table(spark, sf, "conversations").select(
        F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("evidence_id"),
        (F.col("conv_id") % 50).alias("query_id"), F.when(F.col("turn") % 6 == 5, " ").otherwise(F.col("text")).alias("text"),
    )
    out = analyze_evidence(topic_queries(spark, sf), ev, _index(spark, sf), k=4)
    dash = F.lit("-")
    return out.select(
        "evidence_id", "query_id", "decision", "confidence", F.coalesce("top_chunk", dash).alias("top_chunk"),
        F.coalesce("primary_credit", dash).alias("primary_credit"), F.coalesce(F.md5("citations"), dash).alias("citations_md5"),
    )


@query(
    "search_reports",
    f"""WITH {search_sql(TOPIC_QUERIES_SQL, 4)}, rep AS (SELECT query_id, rank, '**' || row_number() OVER (PARTITION BY query_id ORDER BY rank) || '. ' || credit_name || '**' || chr(10) || {q.compact('text', 203)}
 || chr(10) || 'Relevance: ' || printf('%.3f', score + 1e-9) || chr(10) || 'Source: ' || source || chr(10) AS part FROM found)
SELECT query_id::BIGINT AS query_id, string_agg(part, chr(10) ORDER BY rank) AS report FROM rep GROUP BY ALL""",
)
def search_reports_query(spark, sf):
    hits = search(topic_queries(spark, sf), _index(spark, sf), 4)
    return search_reports(hits.withColumn("title", F.col("credit_name")))


@query(
    "evaluation_report",
    f"""WITH s AS ({SQL['eval_summary']}) SELECT '# Retrieval Evaluation Report' || chr(10) || chr(10) || '## Summary' || chr(10) || '- **Total Queries Tested**: ' || total_queries
 || chr(10) || '- **Success Rate**: ' || printf('%.1f', success_rate * 100) || '%' || chr(10) || '- **Average Relevance Score**: ' || printf('%.3f', average_relevance)
 || chr(10) || '- **Average Response Time**: ' || printf('%.2f', average_response_time) || 's' || chr(10) || chr(10) || '## Recommendations' || chr(10)
 || '1. **Response Time**: ' || time_verdict || chr(10) || '2. **Relevance**: ' || relevance_verdict || chr(10) || '3. **Success Rate**: ' || success_verdict AS report FROM s""",
)
def evaluation_report_query(spark, sf):
    return evaluation_report(QUERIES["eval_summary"](spark, sf))


def _values(rows: list[tuple]) -> str:
    text = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else "[" + ", ".join(map(text, v)) + "]" if isinstance(v, list) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows) + ")"


WORDED_DOCS_SQL = "replace(replace(replace(replace(text, ' the ', ' requirements '), ' la ', ' credit '), ' die ', ' projects '), ' el ', ' for ')"


@query(
    "deployment_questions",
    f"""WITH chunks AS (SELECT 'all' AS source, doc_id AS chunk_id, {WORDED_DOCS_SQL} AS text FROM documents),
q AS (SELECT * FROM {_values(list(enumerate(DEPLOYMENT_QUERIES)))} v(query_id, text)), {q.bm25(5)}
SELECT query_id::BIGINT AS query_id, chunk_id, score, rank FROM bmk""",
)
def deployment_questions(spark, sf):
    """The questions asked after deployment, over the documents with some articles renamed to query words."""
    docs = table(spark, sf, "documents").select(F.lit("all").alias("source"), F.col("doc_id").alias("chunk_id"), _worded(F.col("text")).alias("text"))
    return bm25_search(deployment_queries(spark), lexical_index(docs), 5).select("query_id", "chunk_id", "score", "rank")


@query(
    "topic_evaluation",
    f"""WITH docs AS (SELECT CASE WHEN lang = 'en' THEN 'credits' ELSE 'guides' END AS source, doc_id AS chunk_id, {WORDED_DOCS_SQL} AS text, upper(lang) AS credit_code, source AS category FROM documents),
chunks AS (SELECT source, chunk_id, text FROM docs UNION ALL SELECT 'all', chunk_id, text FROM docs),
tq AS (SELECT * FROM {_values([(i, *r) for i, r in enumerate(EVALUATION_QUERIES)])} v(query_id, text, topics, asked)),
q AS (SELECT query_id, text FROM tq), {q.bm25(1000000)},
lh AS (SELECT query_id, rank, docs.text, credit_code, category, topics FROM bmk JOIN tq USING (query_id) JOIN docs USING (chunk_id) WHERE bmk.source = asked AND rank <= 5),
lo AS (SELECT *, list_transform(topics, lambda t: lower(t)) AS lt FROM lh),
rel AS (SELECT query_id, least(1.0::DOUBLE, len(list_filter(lt, lambda t: contains(lower(text), t)))::DOUBLE / len(lt)
   + CASE WHEN len(list_filter(lt, lambda t: contains(lower(credit_code), t))) > 0 THEN 0.2::DOUBLE ELSE 0 END
   + CASE WHEN len(list_filter(lt, lambda t: contains(lower(category), t))) > 0 THEN 0.1::DOUBLE ELSE 0 END) AS rel FROM lo)
SELECT query_id::BIGINT AS query_id, count(rel) AS n_results, coalesce(round(avg(rel), 6), 0.0)::DOUBLE AS relevance FROM tq LEFT JOIN rel USING (query_id) GROUP BY ALL""",
)
def topic_evaluation(spark, sf):
    """The topic queries, each on the source it names: English documents stand for credits, the others for guides."""
    docs = table(spark, sf, "documents").select(
        F.when(F.col("lang") == "en", "credits").otherwise("guides").alias("source"), F.col("doc_id").alias("chunk_id"),
        _worded(F.col("text")).alias("text"), F.upper("lang").alias("credit_code"), F.col("source").alias("category"),
    )
    docs = written(docs)
    routed = route_sources(evaluation_queries(spark), ["all", "credits", "guides"])
    asked = routed.select("query_id", "text", F.explode("used_sources").alias("source"))
    hits = written(bm25_search(asked, lexical_index(docs, all_source="all"), 5))
    found = at_hits(hits, docs, "all")
    return query_relevance(routed.select("query_id", "expected_topics"), found).select("query_id", "n_results", "relevance")


@query("stored_index_search", f"{FULL} SELECT query_id::BIGINT AS query_id, chunk_id, credit_id, section, score, rank FROM found")
def stored_index_search(spark, sf):
    """The whole search on an index that was written and is read back."""
    out = shared_folder(spark)
    write_index(search_index(written(window_chunks(spark, sf))), out)
    hits = search(topic_queries(spark, sf), read_index(spark, out), 5)
    return hits.select("query_id", "chunk_id", "credit_id", "section", "score", "rank")


@query(
    "assistant_templates",
    f"""WITH {search_sql(TOPIC_QUERIES_SQL, 4)},
ev AS (SELECT conv_id || '/' || turn AS evidence_id, conv_id % 50 AS query_id FROM conversations),
fa AS (SELECT query_id::BIGINT AS query_id, arg_min(credit_code, rank) AS primary_credit FROM found GROUP BY ALL),
bk AS (SELECT CASE p_partkey % 3 WHEN 0 THEN 'EN' WHEN 1 THEN 'FR' ELSE 'DE' END AS code, arg_max({{'n': p_name, 'i': p_type, 'b': p_brand}}, p_partkey) AS c FROM part GROUP BY ALL)
SELECT evidence_id, coalesce(primary_credit, '-') AS primary_credit, CASE WHEN primary_credit IS NULL THEN '-' WHEN c IS NULL THEN 'default' ELSE 'exact' END AS how,
 CASE WHEN primary_credit IS NULL THEN '-' WHEN c IS NULL THEN 'LEED Credit – Unspecified' ELSE code || ' – ' || c.n END AS title,
 CASE WHEN primary_credit IS NULL THEN '-' WHEN c IS NULL THEN 'Document how the project meets the stated intent of this credit.' ELSE c.i END AS intent,
 CASE WHEN primary_credit IS NULL THEN '-' WHEN c IS NULL THEN 'List the quantitative and qualitative requirements for this credit.' ELSE c.b END AS requirements
FROM ev LEFT JOIN fa USING (query_id) LEFT JOIN bk ON bk.code = primary_credit""",
)
def assistant_templates(spark, sf):
    """The evidence of `assistant_analysis` with the template of its primary credit; parts stand for the catalogue."""
    ev = table(spark, sf, "conversations").select(
        F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("evidence_id"), (F.col("conv_id") % 50).alias("query_id"), "text"
    )
    k = F.col("p_partkey")
    catalogue = table(spark, sf, "part").select(
        k.alias("credit_no"), F.when(k % 3 == 0, "EN").when(k % 3 == 1, "FR").otherwise("DE").alias("credit_code"), F.col("p_name").alias("credit_name"),
        F.col("p_type").alias("intent"), F.array("p_brand").alias("requirements"), F.lit(None).cast("array<string>").alias("documentation"),
    )
    out = analyze_evidence(topic_queries(spark, sf), ev, _index(spark, sf), catalogue, ["credit_no"], k=4)
    t = lambda c: F.coalesce(F.col(f"template.{c}"), F.lit("-")).alias(c)
    return out.select(
        "evidence_id", F.coalesce("primary_credit", F.lit("-")).alias("primary_credit"), t("how"), t("title"), t("intent"),
        F.coalesce(F.array_join("template.requirements", " ~ "), F.lit("-")).alias("requirements"),
    )


@query(
    "deployment_search",
    f"""WITH {search_sql(f"q AS (SELECT query_id::VARCHAR AS query_id, text FROM {_values(list(enumerate(DEPLOYMENT_QUERIES)))} v(query_id, text))", 5, chunks=WORDED_CHUNKS_SQL)}
SELECT query_id::BIGINT AS query_id, chunk_id, credit_id, section, score, rank FROM found""",
)
def deployment_search(spark, sf):
    """The questions asked after deployment, through the whole search."""
    chunks = window_chunks(spark, sf).withColumn("text", _worded(F.col("text")))
    hits = search(deployment_queries(spark).withColumn("query_id", F.col("query_id").cast("string")), search_index(written(chunks)), 5)
    return hits.select(F.col("query_id").cast("bigint").alias("query_id"), "chunk_id", "credit_id", "section", "score", "rank")
