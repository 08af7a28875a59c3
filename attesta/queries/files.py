"""Files, corpora and the query log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.credits import source_category
from ..operators.matching import unprocessed_files, with_file_status
from ..plans.corpus import corpus, document_summary, processing_counters
from ..session import table
from ..sources.readers import decoded, good_lines, numbered_rows, parse_json_lines
from ..streaming.telemetry import session_counts, window_counts
from .registry import query

PATH_SQL = """'/data/' || source || CASE doc_id % 6 WHEN 0 THEN '/LEED Guide ' WHEN 1 THEN '/Sample Form ' WHEN 2 THEN '/calc ' WHEN 3 THEN '/Project ' WHEN 4 THEN '/proposal ' ELSE '/LEED ' END
 || doc_id || CASE doc_id % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.XLSX' WHEN 2 THEN '.json' WHEN 3 THEN '.png' ELSE '.txt' END"""
FILES_SQL = f"fl AS (SELECT doc_id, {PATH_SQL} AS path, n_chars FROM documents)"
DONE_SQL = "dn AS (SELECT path, CASE WHEN toxic = 1 THEN 'bad page' END AS error FROM fl JOIN labels USING (doc_id))"


def data_files(spark, sf):
    names = F.array(*[F.lit(n) for n in ("/LEED Guide ", "/Sample Form ", "/calc ", "/Project ", "/proposal ", "/LEED ")])
    ends = F.array(*[F.lit(n) for n in (".pdf", ".XLSX", ".json", ".png", ".txt")])
    d = F.col("doc_id")
    path = F.concat(
        F.lit("/data/"), F.col("source"), F.get(names, (d % 6).cast("int")), d.cast("string"), F.get(ends, (d % 5).cast("int"))
    )
    return table(spark, sf, "documents").select("doc_id", path.alias("path"), "n_chars")


def extracted_files(spark, sf):
    return data_files(spark, sf).join(table(spark, sf, "labels"), "doc_id").select(
        "path", F.when(F.col("toxic") == 1, F.lit("bad page")).alias("error")
    )


@query(
    "source_categories",
    f"""WITH {FILES_SQL}, c AS (SELECT CASE doc_id % 6 WHEN 0 THEN 'guide' WHEN 1 THEN 'forms' WHEN 2 THEN 'calculators' WHEN 3 THEN 'projects' WHEN 4 THEN 'research' ELSE 'credits' END AS category, n_chars FROM fl)
SELECT category, count(*) AS n_files, sum(n_chars)::BIGINT AS n_chars FROM c GROUP BY ALL""",
)
def source_categories(spark, sf):
    f = data_files(spark, sf).withColumn("category", source_category(F.col("path")))
    return f.groupBy("category").agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_chars").alias("n_chars"))


@query("unprocessed_files_anti", f"WITH {FILES_SQL}, {DONE_SQL} SELECT doc_id, path FROM fl WHERE path NOT IN (SELECT path FROM dn)")
def unprocessed_files_anti(spark, sf):
    return unprocessed_files(data_files(spark, sf), extracted_files(spark, sf)).select("doc_id", "path")


STATUS_SQL = f"""{FILES_SQL}, {DONE_SQL}, fs AS (SELECT fl.path, n_chars, CASE WHEN path LIKE '%.png' THEN 'skipped' WHEN dn.path IS NOT NULL AND error IS NULL THEN 'successful' ELSE 'failed' END AS status,
 CASE WHEN path LIKE '%.png' THEN 'Unsupported file type: .png' WHEN dn.path IS NOT NULL AND error IS NULL THEN '-' ELSE coalesce(error, 'Extractor returned None') END AS reason FROM fl LEFT JOIN dn USING (path))"""


@query("file_status", f"WITH {STATUS_SQL} SELECT path, status, reason FROM fs")
def file_status(spark, sf):
    s = with_file_status(data_files(spark, sf).select("path"), extracted_files(spark, sf))
    return s.select("path", "status", F.coalesce("reason", F.lit("-")).alias("reason"))


@query(
    "processing_counters",
    f"""WITH {STATUS_SQL} SELECT count(*) FILTER (status = 'successful') AS files_processed, count(*) FILTER (status = 'failed') AS files_failed, count(*) FILTER (status = 'skipped') AS files_skipped,
 sum(n_chars // 1000)::BIGINT AS pages_processed, count(*) FILTER (n_chars % 2 = 0) AS tables_extracted FROM fs""",
)
def processing_counters_query(spark, sf):
    s = with_file_status(data_files(spark, sf), extracted_files(spark, sf))
    return processing_counters(
        s.select("status", F.floor(F.col("n_chars") / 1000).alias("pages"), (F.col("n_chars") % 2 == 0).cast("int").alias("tables"))
    )


@query(
    "document_summary",
    """WITH b AS (SELECT source AS source_file, count(*) AS total_pages, sum(n_chars)::BIGINT AS total_text_chars FROM documents GROUP BY ALL),
i AS (SELECT source AS source_file, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY ALL),
t AS (SELECT source AS source_file, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY ALL)
SELECT source_file, total_pages, total_text_chars, coalesce(i.n, 0) AS total_images, coalesce(t.n, 0) AS total_tables FROM b LEFT JOIN i USING (source_file) LEFT JOIN t USING (source_file)""",
)
def document_summary_query(spark, sf):
    docs = table(spark, sf, "documents")
    pages = docs.select(F.col("source").alias("source_file"), F.col("n_chars").alias("total_chars"))
    marked = docs.join(table(spark, sf, "labels"), "doc_id").select(F.col("source").alias("source_file"), "quality", "toxic")
    return document_summary(pages, {"images": marked.filter("quality = 1"), "tables": marked.filter("toxic = 1")})


@query(
    "jsonl_scan",
    """SELECT conv_id, turn, text, 'v' || turn AS version FROM conversations WHERE (conv_id + turn) % 5 <> 0 AND (conv_id + turn) % 7 <> 0""",
)
def jsonl_scan(spark, sf):
    """Turns as JSON lines; every fifth line is broken, every seventh blank, and both are left out."""
    n = F.col("conv_id") + F.col("turn")
    good = F.to_json(
        F.struct("text", F.struct(F.concat(F.lit("v"), F.col("turn").cast("string")).alias("version")).alias("metadata"))
    )
    line = F.when(n % 5 == 0, F.concat(F.lit("{broken "), good)).when(n % 7 == 0, F.lit("  ")).otherwise(good)
    lines = table(spark, sf, "conversations").select("conv_id", "turn", line.alias("line"))
    parsed = good_lines(parse_json_lines(lines, "line", "text STRING, metadata STRUCT<version: STRING>"))
    return parsed.select("conv_id", "turn", "parsed.text", "parsed.metadata.version")


@query(
    "text_encoding_fallback",
    "SELECT doc_id, md5(text) AS text_md5, length(text) AS n FROM documents",
)
def text_encoding_fallback(spark, sf):
    """Bytes in UTF-8, or in Latin-1 where the text allows it and its bytes are not valid UTF-8."""
    latin = F.encode("text", "ISO-8859-1")
    usable = F.col("text").rlike(r"^[\x00-\xff]*$") & F.try_validate_utf8(latin.cast("string")).isNull()
    raw = table(spark, sf, "documents").select(
        "doc_id", F.when(usable, latin).otherwise(F.encode("text", "UTF-8")).alias("content")
    )
    return raw.select("doc_id", decoded(F.col("content")).alias("t")).select("doc_id", F.md5("t").alias("text_md5"), F.length("t").alias("n"))


@query(
    "corpus_union",
    """WITH u AS (SELECT 'documents' AS source, text FROM documents UNION ALL SELECT 'conversations', text FROM conversations UNION ALL SELECT 'benchmark', text FROM benchmark)
SELECT source, count(*) AS n, count(DISTINCT md5(text)) AS n_texts, sum(length(text))::BIGINT AS n_chars FROM u GROUP BY ALL""",
)
def corpus_union(spark, sf):
    parts = {n: table(spark, sf, n).select("text") for n in ("documents", "conversations", "benchmark")}
    return corpus(parts).groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(F.md5("text")).alias("n_texts"), F.sum(F.length("text")).alias("n_chars")
    )


@query(
    "sheet_rows",
    """WITH r AS (SELECT o_orderpriority AS sheet_name, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS row_index FROM orders)
SELECT sheet_name, o_orderkey, row_index::INT AS row_index FROM r""",
)
def sheet_rows(spark, sf):
    """All rows of every sheet, numbered; order priorities stand for sheets."""
    rows = table(spark, sf, "orders").select(
        F.lit("orders").alias("source_file"), F.col("o_orderpriority").alias("sheet_name"), "o_orderkey", F.col("o_orderkey").alias("_at")
    )
    return numbered_rows(rows).select("sheet_name", "o_orderkey", "row_index")


@query(
    "telemetry_tumbling",
    "SELECT strftime(time_bucket(INTERVAL 1 hour, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
)
def telemetry_tumbling(spark, sf):
    w = window_counts(table(spark, sf, "events"), "1 hour")
    return w.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "telemetry_sliding",
    """WITH e AS (SELECT ts, event_type, value, unnest([0, 1]) AS k FROM events)
SELECT strftime(time_bucket(INTERVAL 30 minutes, ts) - k * INTERVAL 30 minutes, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM e GROUP BY ALL""",
)
def telemetry_sliding(spark, sf):
    w = window_counts(table(spark, sf, "events"), "1 hour", "30 minutes")
    return w.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "telemetry_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 minutes THEN 0 ELSE 1 END AS is_new, event_id FROM events),
s AS (SELECT user_id, ts, sum(is_new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n FROM s GROUP BY user_id, sid""",
)
def telemetry_sessions(spark, sf):
    s = session_counts(table(spark, sf, "events"), "30 minutes")
    return s.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n")


@query(
    "latest_state",
    "SELECT user_id, count(*) AS n_updates, arg_max(value, event_id) AS latest FROM events GROUP BY ALL",
)
def latest_state(spark, sf):
    """Batch form of the running per-key state: last value per key."""
    return table(spark, sf, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_updates"), F.max_by("value", "event_id").alias("latest")
    )


@query(
    "source_set_operations",
    """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'),
u AS (SELECT k, 'union' AS op FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT k, 'minus' FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT k, 'common' FROM (SELECT k FROM a INTERSECT SELECT k FROM b))
SELECT op, count(*) AS n, sum(k)::BIGINT AS key_sum FROM u GROUP BY ALL""",
)
def source_set_operations(spark, sf):
    o = table(spark, sf, "orders")
    # one pass: membership flags per key instead of three set operations over the orders
    flags = o.groupBy(F.col("o_custkey").alias("k")).agg(
        F.max(F.col("o_orderstatus") == "F").alias("a"), F.max(F.col("o_orderpriority") == "1-URGENT").alias("b")
    )
    ops = F.array_compact(
        F.array(
            F.when(F.col("a") | F.col("b"), "union"), F.when(F.col("a") & ~F.col("b"), "minus"), F.when(F.col("a") & F.col("b"), "common")
        )
    )
    return flags.select("k", F.explode(ops).alias("op")).groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("key_sum"))
