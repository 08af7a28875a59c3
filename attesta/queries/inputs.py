"""The retrieval inputs that Spark derives from the given tables, with the same derivation in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import word_windows
from ..session import table
from .sqltext import words

# subject put in front of a benchmark passage, by passage number
TOPICS = [
    "energy efficiency requirements", "water efficiency LEED credits", "sustainable materials",
    "indoor air quality documentation", "site selection score", "EA and WE prerequisite thresholds",
    "regional priority", "MR evidence",
]


def topic_queries(spark: SparkSession, sf: str) -> DataFrame:
    topics = F.array(*[F.lit(t) for t in TOPICS])
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"),
        F.concat(F.get(topics, (F.col("item_id") % len(TOPICS)).cast("int")), F.lit(" "), F.col("text")).alias("text"),
    )


TOPICS_SQL = "[" + ", ".join(f"'{t}'" for t in TOPICS) + "]"
TOPIC_QUERIES_SQL = f"q AS (SELECT item_id AS query_id, {TOPICS_SQL}[item_id % {len(TOPICS)} + 1] || ' ' || text AS text FROM benchmark)"


def passages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


PASSAGES_SQL = "q AS (SELECT item_id AS query_id, text FROM benchmark)"


# a value of each row, not a constant: a join on a constant would be planned as a product
def _all() -> Column:
    return F.when(F.col("doc_id").isNotNull(), F.lit("all"))


def whole_documents(spark: SparkSession, sf: str, source: Column | None = None) -> DataFrame:
    return table(spark, sf, "documents").select(
        (_all() if source is None else source).alias("source"), F.col("doc_id").alias("chunk_id"), "text"
    )


WHOLE_DOCUMENTS_SQL = "chunks AS (SELECT 'all' AS source, doc_id AS chunk_id, text FROM documents)"

SECTIONS = {"en": "requirements", "fr": "intent", "de": "documentation"}


def _section(lang: Column) -> Column:
    out = F.when(F.lit(False), "")
    for k, v in SECTIONS.items():
        out = out.when(lang == k, v)
    return out.otherwise("definitions")


def window_chunks(spark: SparkSession, sf: str, source: Column | None = None) -> DataFrame:
    """Word windows of the documents: credit = source of the document, section by language."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", F.col("source").alias("credit_id"), "text")
    w = word_windows(docs, ["doc_id", "lang", "credit_id"])
    return w.select(
        (_all() if source is None else source).alias("source"),
        F.concat_ws("-", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"),
        "text", "credit_id", F.upper("lang").alias("credit_code"), F.concat(F.lit("Credit "), "credit_id").alias("credit_name"),
        F.col("lang").alias("category"), _section(F.col("lang")).alias("section"),
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("doc"),
        (F.col("chunk_index") + 1).alias("page_start"), (F.col("chunk_index") + 1).alias("page_end"),
        F.array(F.col("chunk_index") + 1).alias("pages"),
    )


# (doc_id, ..., i, s, e, text): windows with start and end word
WINDOWS_SQL = f"""
dw AS MATERIALIZED (SELECT doc_id, lang, source, {words('text')} AS ws FROM documents WHERE length(trim(text)) >= 100),
dn AS (SELECT *, len(ws) AS n FROM dw),
ds AS (SELECT *, unnest(generate_series(0, greatest(0, n - 51), 950)) AS s FROM dn),
dc0 AS (SELECT doc_id, lang, source, s AS start_word, least(s + 1000, n) AS end_word, array_to_string(ws[s + 1 : s + 1000], ' ') AS text FROM ds),
wins AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_word) - 1 AS chunk_index FROM dc0 WHERE length(text) >= 100)"""
WINDOW_CHUNKS_SQL = f"""{WINDOWS_SQL},
meta AS MATERIALIZED (SELECT 'all' AS source, doc_id::VARCHAR || '-' || chunk_index::VARCHAR AS chunk_id, text, source AS credit_id, upper(lang) AS credit_code,
  'Credit ' || source AS credit_name, lang AS category,
  CASE lang WHEN 'en' THEN 'requirements' WHEN 'fr' THEN 'intent' WHEN 'de' THEN 'documentation' ELSE 'definitions' END AS section,
  'doc' || doc_id AS doc, chunk_index + 1 AS page FROM wins),
chunks AS (SELECT source, chunk_id, text FROM meta)"""
