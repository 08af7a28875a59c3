"""Evidence decisions, templates and training rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import tokens
from ..functions.vectors import hashed_vector
from ..operators.lexical import bm25_search, lexical_index
from ..operators.matching import exact_templates, nearest_names, template_dictionary
from ..plans.evidence import decisions, templates, text_evidence
from ..plans.training import benchmark_summary, citation_rows, evidence_rows, qa_pairs, with_split
from ..session import table, written
from . import sqltext as q
from .credits import PART_SQL, part_credits
from .inputs import PASSAGES_SQL, WHOLE_DOCUMENTS_SQL, passages, whole_documents
from .registry import query
from .searching import marked

MARKED = "replace(replace(replace(text, ' the ', ' must '), ' and ', ' should '), ' of ', ' requirement ')"


@query(
    "evidence_decision",
    f"""WITH {WHOLE_DOCUMENTS_SQL}, {PASSAGES_SQL}, {q.bm25(4)},
ev AS (SELECT conv_id || '/' || turn AS evidence_id, conv_id % 50 AS query_id, CASE WHEN turn % 6 = 5 THEN ' ' ELSE text END AS text FROM conversations),
tk2 AS (SELECT evidence_id, ('0x' || substr(md5(term), 1, 5))::INT AS dim, count(*)::DOUBLE AS n FROM (SELECT evidence_id, unnest({q.toks('text')}) AS term FROM ev) GROUP BY ALL),
evv AS (SELECT evidence_id, dim, n / sqrt(sum(n * n) OVER (PARTITION BY evidence_id)) AS w FROM tk2),
ids AS (SELECT DISTINCT chunk_id FROM bmk),
dd0 AS (SELECT chunk_id, ('0x' || substr(md5(term), 1, 5))::INT AS dim, count(*)::DOUBLE AS n FROM (SELECT chunk_id, unnest(t) AS term FROM tk JOIN ids USING (chunk_id)) GROUP BY ALL),
dd AS (SELECT chunk_id, dim, n / sqrt(sum(n * n) OVER (PARTITION BY chunk_id)) AS w FROM dd0),
prs AS (SELECT evidence_id, ev.query_id, ev.text AS etext, chunk_id, rank FROM ev JOIN bmk USING (query_id)),
sc AS (SELECT evidence_id, chunk_id, round(sum(evv.w * dd.w), 6) AS s FROM prs JOIN evv USING (evidence_id) JOIN dd USING (chunk_id, dim) GROUP BY ALL),
sa AS (SELECT p.evidence_id, p.rank, p.chunk_id, coalesce(s, 0.0) AS s FROM prs p LEFT JOIN sc USING (evidence_id, chunk_id)),
ag AS (SELECT evidence_id, max(s) AS top, sum(s) / count(*) AS avg, arg_max(chunk_id, s * 100 - rank / 1000000.0) AS best FROM sa GROUP BY ALL)
SELECT ev.evidence_id, ev.query_id, CASE WHEN trim(ev.text) = '' OR top IS NULL THEN 'unknown' WHEN top >= 0.42 OR avg >= 0.32 THEN 'supported' ELSE 'insufficient' END AS decision,
 CASE WHEN trim(ev.text) = '' OR top IS NULL THEN 0.0 ELSE round(greatest(top, avg), 6) END AS confidence,
 CASE WHEN trim(ev.text) = '' OR top IS NULL THEN '-' ELSE {q.compact('chunks.text', 180)} END AS top_chunk
FROM ev LEFT JOIN ag USING (evidence_id) LEFT JOIN chunks ON chunk_id = best""",
)
def evidence_decision(spark, sf):
    """Conversation turns as evidence against the passages' best documents; some turns are blank."""
    docs = whole_documents(spark, sf)
    hits = written(bm25_search(passages(spark, sf), lexical_index(docs), 4))
    found = docs.join(hits, ["source", "chunk_id"]).withColumn("vector", hashed_vector(tokens(F.col("text"))))
    ev = table(spark, sf, "conversations").select(
        F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("evidence_id"),
        (F.col("conv_id") % 50).alias("query_id"), F.when(F.col("turn") % 6 == 5, " ").otherwise(F.col("text")).alias("text"),
    )
    d = decisions(text_evidence(ev), found)
    return d.select("evidence_id", "query_id", "decision", "confidence", F.coalesce("top_chunk", F.lit("-")).alias("top_chunk"))


IDENT_SQL = """ids AS (SELECT DISTINCT CASE p_size % 4 WHEN 0 THEN ' EA ' WHEN 1 THEN upper(p_name) || 's' WHEN 2 THEN p_name || ' Credit ' || p_size ELSE 'no such ' || p_type END AS identifier FROM part)"""
BOOK_SQL = f"""{PART_SQL},
bk AS MATERIALIZED (SELECT *, lower(coalesce(nullif(trim(credit_code), ''), nullif(trim(credit_name), ''))) AS key FROM pc
  WHERE key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key ORDER BY credit_no DESC) = 1)"""


def _identifiers(spark, sf):
    size = F.col("p_size")
    ident = (
        F.when(size % 4 == 0, F.lit(" EA ")).when(size % 4 == 1, F.concat(F.upper("p_name"), F.lit("s")))
        .when(size % 4 == 2, F.concat("p_name", F.lit(" Credit "), size.cast("string")))
        .otherwise(F.concat(F.lit("no such "), F.col("p_type")))
    )
    return table(spark, sf, "part").select(ident.alias("identifier")).distinct()


@query("template_match_exact", f"WITH {IDENT_SQL}, {BOOK_SQL} SELECT identifier, coalesce(credit_no, -1) AS credit_no FROM ids LEFT JOIN bk ON bk.key = lower(trim(identifier))")
def template_match_exact(spark, sf):
    book = template_dictionary(part_credits(spark, sf), ["credit_no"]).select("key", "credit_no")
    found = exact_templates(_identifiers(spark, sf), book)
    return found.select("identifier", F.coalesce("credit_no", F.lit(-1)).alias("credit_no"))


NEAR_SQL = f"""{IDENT_SQL}, {BOOK_SQL},
miss AS (SELECT DISTINCT lower(trim(identifier)) AS name FROM ids WHERE lower(trim(identifier)) NOT IN (SELECT key FROM bk)),
sim AS (SELECT name, key, round(1 - levenshtein(name, key)::DOUBLE / greatest(length(name), length(key)), 6) AS similarity FROM miss, bk),
near AS MATERIALIZED (SELECT name, key, similarity FROM sim WHERE similarity >= 0.6 QUALIFY row_number() OVER (PARTITION BY name ORDER BY similarity DESC, key) = 1)"""


@query("template_match_fuzzy", f"WITH {NEAR_SQL} SELECT name, key, similarity FROM near")
def template_match_fuzzy(spark, sf):
    """Names without an exact template and their most similar key by edit distance."""
    book = template_dictionary(part_credits(spark, sf), ["credit_no"]).select("key")
    asked = _identifiers(spark, sf).select(F.trim(F.lower("identifier")).alias("name")).distinct()
    return nearest_names(asked.join(book, asked.name == book.key, "left_anti"), book)


@query(
    "template_fill",
    f"""WITH {NEAR_SQL},
m AS (SELECT identifier, CASE WHEN b.key IS NOT NULL THEN 'exact' WHEN near.key IS NOT NULL THEN 'similar' ELSE 'default' END AS how, coalesce(b.key, near.key) AS k
  FROM ids LEFT JOIN bk b ON b.key = lower(trim(identifier)) LEFT JOIN near ON near.name = lower(trim(identifier)))
SELECT identifier, how, coalesce(credit_code, 'LEED Credit') || ' – ' || coalesce(credit_name, 'Unspecified') AS title,
 coalesce(nullif(intent, ''), 'Document how the project meets the stated intent of this credit.') AS intent,
 coalesce(array_to_string(requirements, ' ~ '), 'List the quantitative and qualitative requirements for this credit.') AS requirements,
 coalesce(array_to_string(documentation, ' ~ '), 'Attach narrative description, calculations, and any required forms.') AS documentation FROM m LEFT JOIN bk ON bk.key = k""",
)
def template_fill(spark, sf):
    t = templates(_identifiers(spark, sf), part_credits(spark, sf), ["credit_no"])
    return t.select(
        "identifier", "how", "title", "intent", F.array_join("requirements", " ~ ").alias("requirements"),
        F.array_join("documentation", " ~ ").alias("documentation"),
    )


def mention_pages(spark, sf):
    """Documents as pages; every second line is turned into a credit mention."""
    lines = F.transform(
        F.split("text", "\n"),
        lambda s, i: F.when(
            (i + F.col("doc_id")) % 2 == 0, F.concat(F.lit("EA Credit "), F.upper("lang"), F.lit(": "), s)
        ).otherwise(F.replace(s, F.lit(":"), F.lit(" "))),
    )
    return table(spark, sf, "documents").select(
        F.col("source").alias("source_file"), F.col("doc_id").alias("page"), F.array_join(lines, "\n").alias("text")
    )


QA_SQL = r"""ml AS (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
mp AS (SELECT source AS source_file, doc_id AS page, string_agg(CASE WHEN (i + doc_id) % 2 = 0 THEN 'EA Credit ' || upper(lang) || ': ' || s ELSE replace(s, ':', ' ') END, chr(10) ORDER BY i) AS text FROM ml GROUP BY ALL),
mm AS (SELECT source_file, page, regexp_extract_all(text, '(?i)([A-Z]{1,2})\s+(Credit|Prerequisite)\s+([^:]+):\s*(.+)', 1) AS a, regexp_extract_all(text, '(?i)([A-Z]{1,2})\s+(Credit|Prerequisite)\s+([^:]+):\s*(.+)', 2) AS b,
 regexp_extract_all(text, '(?i)([A-Z]{1,2})\s+(Credit|Prerequisite)\s+([^:]+):\s*(.+)', 3) AS c, regexp_extract_all(text, '(?i)([A-Z]{1,2})\s+(Credit|Prerequisite)\s+([^:]+):\s*(.+)', 4) AS d FROM mp),
mx AS (SELECT source_file, page, unnest(a) AS a, unnest(b) AS b, trim(unnest(c)) AS c, trim(unnest(d)) AS d FROM mm),
qa AS (SELECT source_file, page, a || ' ' || b || ': ' || c AS t, d, unnest(['What is ', 'What are the requirements for ', 'How do I achieve ', 'Tell me about ', '']) AS pre, unnest(['?', '?', '?', '', ' requirements']) AS suf FROM mx),
qb AS (SELECT source_file, page, pre || t || suf AS question, t || chr(10) || chr(10) || d AS answer FROM qa)"""


@query("qa_pairs", f"WITH {QA_SQL} SELECT source_file, page, question, md5(answer) AS answer_md5 FROM qb")
def qa_pairs_query(spark, sf):
    p = qa_pairs(mention_pages(spark, sf))
    return p.select("citation.source_file", "citation.page", "question", F.md5("answer").alias("answer_md5"))


SPLIT = "CASE WHEN ('0x' || substr(md5({k}), 1, 4))::INT % 10 < 8 THEN 'train' ELSE 'test' END"


@query(
    "md5_split",
    f"SELECT conv_id, turn, {SPLIT.format(k='text')} AS split FROM conversations",
)
def md5_split(spark, sf):
    return with_split(table(spark, sf, "conversations"), "text").select("conv_id", "turn", "split")


@query(
    "benchmark_summary",
    f"WITH {QA_SQL}, s AS (SELECT {SPLIT.format(k='question')} AS split FROM qb) SELECT 'LEED_RAG_Benchmark' AS name, '1.0' AS version, count(*) FILTER (split = 'train') AS train_size, count(*) FILTER (split = 'test') AS test_size FROM s",
)
def benchmark_summary_query(spark, sf):
    return benchmark_summary(with_split(qa_pairs(mention_pages(spark, sf))))


def marked_pages(spark, sf):
    return table(spark, sf, "documents").select(
        F.col("source").alias("source_file"), F.col("doc_id").alias("page"), marked(F.col("text")).alias("text")
    )


@query(
    "evidence_rows",
    f"""WITH p AS (SELECT source AS source_file, doc_id AS page, {MARKED} AS text FROM documents),
l0 AS (SELECT source_file, page, string_split(text, chr(10)) AS ls, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, {q.strip('unnest(string_split(text, chr(10)))')} AS evidence_text FROM p),
l AS (SELECT *, md5(array_to_string(ls[greatest(line_no, 1) : line_no + 2], chr(10))) AS context_md5 FROM l0)
SELECT source_file, page, line_no, evidence_text, context_md5, 'supported' AS label, 0.8::DOUBLE AS confidence FROM l
WHERE length(evidence_text) >= 20 AND regexp_matches(lower(evidence_text), 'must|shall|require|provide|demonstrate|achieve')""",
)
def evidence_rows_query(spark, sf):
    e = evidence_rows(marked_pages(spark, sf))
    return e.withColumn("context_md5", F.md5("credit_context")).drop("credit_context")


@query(
    "citation_rows",
    rf"""WITH s AS (SELECT source AS source_file, doc_id AS page, generate_subscripts(string_split_regex(text, '[.!?][\s\x0b\x{{85}}\p{{Z}}]+'), 1) - 1 AS sentence_no, trim(unnest(string_split_regex(text, '[.!?][\s\x0b\x{{85}}\p{{Z}}]+')), ' ' || chr(9) || chr(10) || chr(13)) AS statement FROM documents)
SELECT source_file, page, sentence_no, statement, '[' || source_file || ', p.' || page || ']' AS citation_format FROM s WHERE length(statement) BETWEEN 30 AND 300""",
)
def citation_rows_query(spark, sf):
    pages = table(spark, sf, "documents").select(F.col("source").alias("source_file"), F.col("doc_id").alias("page"), "text")
    return citation_rows(pages)
