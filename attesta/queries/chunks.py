"""Chunking queries over the whole documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import html_title, strip_html, words
from ..operators.chunking import (
    chunk_extractions, chunk_id_collisions, exact_duplicates, heading_chunks, json_chunks, json_text, malformed_json, metadata_chunks,
    page_chunks, sheet_chunks, summary_chunks, table_chunks, word_windows,
)
from ..sources.readers import split_page_marks
from ..session import table
from . import sqltext as q
from .inputs import WINDOWS_SQL
from .registry import query

WINDOW_COLUMNS = "chunk_index, start_word AS chunk_start_word, end_word AS chunk_end_word, text, substr(md5(text), 1, 8) AS chunk_hash"


@query("word_windows", f"WITH {WINDOWS_SQL} SELECT doc_id, {WINDOW_COLUMNS} FROM wins")
def word_windows_query(spark, sf):
    return word_windows(table(spark, sf, "documents"), ["doc_id"])


def small_windows_sql(src: str, key: str, size: int, overlap: int, chars: int, out: str = "wins") -> str:
    step = size - overlap
    return f"""
{out}_w AS (SELECT {key}, {q.words('text')} AS ws FROM {src} WHERE length(trim(text)) >= {chars}),
{out}_s AS (SELECT *, unnest(generate_series(0, greatest(0, len(ws) - {overlap} - 1), {step})) AS start_word FROM {out}_w),
{out}_c AS (SELECT {key}, start_word, least(start_word + {size}, len(ws)) AS end_word, array_to_string(ws[start_word + 1 : start_word + {size}], ' ') AS text FROM {out}_s),
{out} AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY start_word) - 1 AS chunk_index FROM {out}_c WHERE length(text) >= {chars})"""


@query(
    "word_windows_small",
    f"WITH {small_windows_sql('documents', 'doc_id', 120, 20, 60)} SELECT doc_id, {WINDOW_COLUMNS} FROM wins",
)
def word_windows_small(spark, sf):
    return word_windows(table(spark, sf, "documents"), ["doc_id"], max_words=120, overlap=20, min_chars=60)


# a heading line is put before some lines, by document and line number
MARKS = ["Intent", "", "Requirements:", "", "", "Submittals", "", "Points:", "", "Related Credits", "", "  Guidance: ", ""]


def headed_documents(spark, sf):
    marks = F.array(*[F.lit(m) for m in MARKS])
    lines = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.concat(
            F.get(marks, ((F.col("doc_id") + i) % len(MARKS)).cast("int")),
            F.when(F.get(marks, ((F.col("doc_id") + i) % len(MARKS)).cast("int")) == "", "").otherwise("\n"), line,
        ),
    )
    return table(spark, sf, "documents").select("doc_id", "source", F.array_join(lines, "\n").alias("text"))


MARKS_SQL = "[" + ", ".join(f"'{m}'" for m in MARKS) + "]"
HEADED_SQL = rf"""
hl0 AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
hl1 AS (SELECT *, {MARKS_SQL}[(doc_id + i) % {len(MARKS)} + 1] AS mark FROM hl0),
hl AS (SELECT doc_id, source, i * 2 AS pos, mark AS line FROM hl1 WHERE mark <> '' UNION ALL SELECT doc_id, source, i * 2 + 1, line FROM hl1),
hk AS MATERIALIZED (SELECT *, {q.strip('line')} AS sl, CASE
   WHEN regexp_matches({q.strip('line')}, '(?i)^Intent:?\s*$') THEN 'intent' WHEN regexp_matches({q.strip('line')}, '(?i)^Requirements?:?\s*$') THEN 'requirements'
   WHEN regexp_matches({q.strip('line')}, '(?i)^(Documentation|Submittals?):?\s*$') THEN 'documentation' WHEN regexp_matches({q.strip('line')}, '(?i)^Points:?\s*$') THEN 'thresholds'
   WHEN regexp_matches({q.strip('line')}, '(?i)^(Related Credits|Guidance|References|Tips):?\s*$') THEN 'definitions' END AS head FROM hl),
hs AS (SELECT *, count(head) OVER (PARTITION BY doc_id ORDER BY pos) AS section_index FROM hk),
hsec AS (SELECT doc_id, section_index, coalesce(max(head), 'general') AS section,
   {q.strip("string_agg(CASE WHEN head IS NULL THEN line ELSE sl END, chr(10) ORDER BY pos)")} AS text, any_value(source) AS source FROM hs GROUP BY doc_id, section_index),
hok AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY section_index) - 1 AS chunk_index FROM hsec WHERE length(text) >= 100),
htext AS (SELECT doc_id, source, string_agg(line, chr(10) ORDER BY pos) AS text FROM hl GROUP BY ALL),
hrest AS (SELECT * FROM htext ANTI JOIN hok USING (doc_id)),
{small_windows_sql('hrest', 'doc_id, source', 1000, 50, 100, 'hw')},
headed AS MATERIALIZED (SELECT doc_id, source, chunk_index, section, section_index, text FROM hok
  UNION ALL SELECT doc_id, source, chunk_index, NULL, NULL, text FROM hw)"""


@query(
    "heading_chunks",
    f"WITH {HEADED_SQL} SELECT doc_id, chunk_index, coalesce(section, 'window') AS section, coalesce(section_index, -1) AS section_index, "
    "text, substr(md5(text), 1, 8) AS chunk_hash FROM headed",
)
def heading_chunks_query(spark, sf):
    h = heading_chunks(headed_documents(spark, sf), ["doc_id"])
    return h.withColumns(
        {"section": F.coalesce("section", F.lit("window")), "section_index": F.coalesce("section_index", F.lit(-1))}
    )


@query(
    "page_flags_semi",
    f"""WITH {HEADED_SQL}, img AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id % 3 = 0), tab AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1)
SELECT doc_id::INT AS page, chunk_index, substr(md5(text), 1, 8) AS chunk_hash, img.doc_id IS NOT NULL AS has_images, tab.doc_id IS NOT NULL AS has_tables
FROM headed LEFT JOIN img USING (doc_id) LEFT JOIN tab USING (doc_id)""",
)
def page_flags_semi(spark, sf):
    page = F.col("doc_id").cast("int").alias("page")
    docs = headed_documents(spark, sf)
    # where each page lives; labels name pages by number only
    places = docs.select(F.col("source").alias("source_file"), page)
    images = places.filter("page % 3 = 0")
    toxic = table(spark, sf, "labels").filter("toxic = 1").select(page)
    tables = places.join(toxic, "page", "left_semi")
    pages = docs.select(F.col("source").alias("source_file"), page, "text")
    chunks = page_chunks(pages, {"has_images": images, "has_tables": tables})
    return chunks.select("page", "chunk_index", "chunk_hash", "has_images", "has_tables")


@query(
    "exact_dup_md5",
    "SELECT md5(text) AS text_md5, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY ALL",
)
def exact_dup_md5(spark, sf):
    return exact_duplicates(table(spark, sf, "documents"), "doc_id")


@query(
    "chunk_id_collisions",
    f"""WITH {WINDOWS_SQL}, c AS (SELECT source || '-' || lang || '-' || chunk_index AS chunk_id, text FROM wins)
SELECT chunk_id, count(*) AS n, count(DISTINCT md5(text)) AS n_texts FROM c GROUP BY ALL HAVING count(*) > 1""",
)
def chunk_id_collisions_query(spark, sf):
    w = word_windows(table(spark, sf, "documents"), ["source", "lang"])
    return chunk_id_collisions(w.withColumn("chunk_id", F.concat_ws("-", "source", "lang", F.col("chunk_index").cast("string"))))


HTML_SQL = rf"""
h1 AS (SELECT page_id, url, html, regexp_replace(html, '(?is)<!--.*?-->', ' ', 'g') AS s FROM pages),
h2 AS (SELECT page_id, url, html, regexp_replace(s, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g') AS s FROM h1),
h3 AS (SELECT page_id, url, html, regexp_replace(s, '(?s)<[^>]*>', ' ', 'g') AS s FROM h2),
h4 AS (SELECT page_id, url, html, replace(replace(replace(replace(replace(replace(s, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS s FROM h3),
ht AS MATERIALIZED (SELECT page_id, url, array_to_string({q.words('s')}, ' ') AS text, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM h4)"""


def page_texts(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", "url", strip_html(F.col("html")).alias("text"), html_title(F.col("html")).alias("title")
    )


@query("html_text", f"WITH {HTML_SQL} SELECT page_id, title, text FROM ht")
def html_text(spark, sf):
    return page_texts(spark, sf).select("page_id", "title", "text")


@query(
    "html_page_chunks",
    f"WITH {HTML_SQL}, {small_windows_sql('ht', 'page_id', 1000, 50, 100)} SELECT page_id, {WINDOW_COLUMNS} FROM wins",
)
def html_page_chunks(spark, sf):
    return word_windows(page_texts(spark, sf), ["page_id"])


JSON_SQL = """'event_id: ' || event_id || ' | detail: detail.type: ' || event_type || ' | detail.props: detail.props.k: ' || json_extract_string(props, '$.k')
  || ' | tags: ' || event_type || ' | tags[1].u: ' || user_id"""


def event_documents(spark, sf):
    """Events as JSON documents; of every fiftieth the last brackets are lost."""
    e = table(spark, sf, "events")
    doc = F.concat(
        F.lit('{"event_id": '), F.col("event_id").cast("string"), F.lit(', "detail": {"type": "'), F.col("event_type"),
        F.lit('", "props": '), F.col("props"), F.lit('}, "tags": ["'), F.col("event_type"), F.lit('", {"u": '),
        F.col("user_id").cast("string"), F.when(F.col("event_id") % 50 != 0, F.lit("}]}")).otherwise(F.lit("")),
    )
    return e.select("event_id", "event_type", doc.alias("data"))


@query("json_text_events", f"SELECT event_id, CASE WHEN event_id % 50 <> 0 THEN {JSON_SQL} END AS text FROM events")
def json_text_events(spark, sf):
    return event_documents(spark, sf).select("event_id", json_text("data").alias("text"))


@query("json_malformed", "SELECT event_type, count(*) AS n_documents, count(*) FILTER (event_id % 50 = 0) AS n_malformed FROM events GROUP BY ALL")
def json_malformed(spark, sf):
    return malformed_json(event_documents(spark, sf), ["event_type"])


@query(
    "json_chunks",
    f"""WITH j AS (SELECT doc_id, 'doc: ' || doc_id || ' | body: body.lang: ' || coalesce(lang, 'None') || ' | body.text: ' || {q.words('text')}[1:400].array_to_string(' ') AS text
  FROM documents WHERE doc_id % 7 <> 0),
{small_windows_sql('j', 'doc_id', 1000, 50, 100)} SELECT doc_id, {WINDOW_COLUMNS} FROM wins""",
)
def json_document_chunks(spark, sf):
    """Documents as JSON records, some of them cut off, in word windows of their flattened text."""
    d = table(spark, sf, "documents")
    body = F.array_join(F.slice(words(F.col("text")), 1, 400), " ")
    record = F.to_json(F.struct(F.col("doc_id").alias("doc"), F.struct("lang", body.alias("text")).alias("body")), {"ignoreNullFields": "false"})
    cut = F.when(F.col("doc_id") % 7 == 0, F.substr(record, F.lit(1), F.length(record) - 1)).otherwise(record)
    return json_chunks(d.select("doc_id", cut.alias("data")), ["doc_id"])


@query(
    "sheet_row_chunks",
    f"""WITH r AS (SELECT c_custkey, 'name: ' || c_name || CASE WHEN c_nationkey % 4 = 0 THEN '' ELSE ' | segment: ' || c_mktsegment END
   || ' | nation: ' || c_nationkey || ' | note: ' || repeat(c_mktsegment || ' ', 9) AS text FROM customer),
{small_windows_sql('r', 'c_custkey', 1000, 50, 100)} SELECT c_custkey AS row_index, chunk_index, text FROM wins""",
)
def sheet_row_chunks(spark, sf):
    cells = F.create_map(
        F.lit("name"), F.col("c_name"),
        F.lit("segment"), F.when(F.col("c_nationkey") % 4 == 0, F.lit(" ")).otherwise(F.col("c_mktsegment")),
        F.lit("nation"), F.col("c_nationkey").cast("string"),
        F.lit("note"), F.repeat(F.concat("c_mktsegment", F.lit(" ")), 9),
    )
    rows = table(spark, sf, "customer").select(
        F.lit("customers").alias("source_file"), F.lit("all").alias("sheet_name"), F.col("c_custkey").alias("row_index"), cells.alias("cells")
    )
    return sheet_chunks(rows).select("row_index", "chunk_index", "text")


@query(
    "table_text_chunks",
    """WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN [[]::VARCHAR[], ['total', o_orderpriority]] ELSE [['key', 'status', 'priority'], [o_orderkey::VARCHAR, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END, o_orderpriority]] END AS data FROM orders),
t AS (SELECT o_orderkey, 'Table from page ' || o_orderkey || ':' || chr(10) || 'Rows: 2, Columns: ' || len(data[2]) || chr(10) || chr(10)
  || array_to_string(list_filter(list_transform(data, lambda row, i: CASE WHEN len(row) > 0 THEN 'Row ' || i || ': ' || array_to_string(list_transform(row, lambda c: coalesce(c, '')), ' | ') || chr(10) END), lambda s: s IS NOT NULL), '') AS text FROM r)
SELECT 'doc_table_data_' || substr(md5(text), 1, 12) AS id, o_orderkey AS page, text, length(text) AS content_length FROM t""",
)
def table_text_chunks(spark, sf):
    key = F.col("o_orderkey")
    short = F.array(F.array().cast("array<string>"), F.array(F.lit("total"), F.col("o_orderpriority")))
    full = F.array(
        F.array(F.lit("key"), F.lit("status"), F.lit("priority")),
        F.array(key.cast("string"), F.when(key % 5 != 0, F.col("o_orderstatus")), F.col("o_orderpriority")),
    )
    data = F.when(key % 7 == 0, short).otherwise(full)
    t = table(spark, sf, "orders").select(
        F.lit("orders").alias("file_name"), key.alias("page"), F.lit(0).alias("table_index"), F.lit(2).alias("rows"),
        F.size(F.get(data, F.lit(1))).alias("columns"), data.alias("data"),
    )
    return table_chunks(t).select("id", "page", "text", "content_length")


@query(
    "document_summary_chunks",
    """WITH p AS (SELECT source AS file_name, count(*) AS pages, sum(n_chars) AS chars FROM documents GROUP BY ALL),
t AS (SELECT source AS file_name, count(*) AS tabs FROM documents JOIN labels USING (doc_id) GROUP BY ALL),
s AS (SELECT file_name, 'Document Summary for ' || file_name || ':' || chr(10) || 'Total Pages: ' || pages || chr(10) || 'Total Images: 0' || chr(10)
 || 'Total Tables: ' || coalesce(tabs, 0) || chr(10) || 'Total Drawings: 0' || chr(10) || 'Total Annotations: 0' || chr(10)
 || 'Total Text Characters: ' || chars || chr(10) AS text FROM p LEFT JOIN t USING (file_name))
SELECT 'doc_document_summary_' || substr(md5(text), 1, 12) AS id, file_name, text FROM s""",
)
def document_summary_chunks(spark, sf):
    docs = table(spark, sf, "documents")
    pages = docs.groupBy("source").agg(F.count(F.lit(1)).alias("total_pages"), F.sum("n_chars").alias("total_text_chars"))
    tables = docs.join(table(spark, sf, "labels"), "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("total_tables"))
    none = F.lit(0)
    totals = pages.join(tables, "source", "left").select(
        F.col("source").alias("file_name"), "total_pages", "total_text_chars", "total_tables",
        none.alias("total_images"), none.alias("total_drawings"), none.alias("total_annotations"),
    )
    return summary_chunks(totals).select("id", "file_name", "text")


@query(
    "document_metadata_chunks",
    f"""WITH {HTML_SQL}, m AS (SELECT page_id, 'Document Metadata for ' || url || ':' || chr(10) || 'Title: ' || coalesce(nullif(title, ''), 'N/A') || chr(10)
 || 'Author: N/A' || chr(10) || 'Subject: N/A' || chr(10) || 'Creator: N/A' || chr(10) || 'Producer: N/A' || chr(10) || 'Creation Date: N/A' || chr(10)
 || 'Modification Date: N/A' || chr(10) || 'Page Count: 0' || chr(10) || 'File Size: ' || length(text) || ' bytes' || chr(10) AS text FROM ht)
SELECT page_id, 'doc_document_metadata_' || substr(md5(text), 1, 12) AS id, text, length(text) AS content_length FROM m""",
)
def document_metadata_chunks(spark, sf):
    p = page_texts(spark, sf).select(
        "page_id", F.col("url").alias("file_name"), F.nullif("title", F.lit("")).alias("title"), F.length("text").alias("file_size")
    )
    return metadata_chunks(p).select("page_id", "id", "text", "content_length")


@query(
    "page_delimited_text",
    """WITH c AS (SELECT conv_id, string_agg('=== PAGE ' || (turn + 1) || ' ===' || chr(10) || text || chr(10), '' ORDER BY turn) AS content FROM conversations GROUP BY ALL),
p AS (SELECT conv_id, unnest(string_split(content, '=== PAGE')) AS piece, generate_subscripts(string_split(content, '=== PAGE'), 1) - 1 AS page FROM c)
SELECT conv_id, page, 'Page ' || page || ': ' || """
    + q.strip("piece")
    + " AS text FROM p WHERE page > 0 AND "
    + q.strip("piece")
    + " <> ''",
)
def page_delimited_text(spark, sf):
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t")
    )
    content = F.array_join(
        F.transform(
            "t",
            lambda r: F.concat(F.lit("=== PAGE "), (r["turn"] + 1).cast("string"), F.lit(" ===\n"), r["text"], F.lit("\n")),
        ),
        "",
    )
    pages = split_page_marks(turns.select("conv_id", content.alias("content")), ["conv_id"])
    return pages.select("conv_id", "page", F.concat(F.lit("Page "), F.col("page").cast("string"), F.lit(": "), "text").alias("text"))


@query(
    "extraction_router",
    f"""WITH {HEADED_SQL}, t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'json' WHEN 2 THEN 'text' ELSE 'image' END AS file_type, source FROM documents),
pdf AS (SELECT doc_id, chunk_index, substr(md5(text), 1, 8) AS chunk_hash FROM headed WHERE doc_id % 4 = 0),
rest AS (SELECT doc_id, text FROM htext WHERE doc_id % 4 IN (1, 2)),
{small_windows_sql('rest', 'doc_id', 1000, 50, 100, 'rw')}
SELECT doc_id, 'pdf' AS file_type, chunk_index, chunk_hash FROM pdf
UNION ALL SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN 'json' ELSE 'text' END, chunk_index, substr(md5(text), 1, 8) FROM rw""",
)
def extraction_router(spark, sf):
    kind = F.get(F.array(*[F.lit(k) for k in ("pdf", "json", "text", "image")]), (F.col("doc_id") % 4).cast("int"))
    docs = headed_documents(spark, sf).withColumn("file_type", kind)
    rec = docs.select(
        F.col("doc_id").cast("string").alias("source_file"), "file_type",
        F.when(F.col("file_type") == "pdf", F.array(F.struct(F.lit(1).alias("page"), F.col("text").alias("text")))).alias("text_content"),
        F.lit(None).cast("array<struct<name:string,rows:array<map<string,string>>>>").alias("sheets"),
        F.when(F.col("file_type") == "json", F.col("text")).alias("data_text"),
        F.when(F.col("file_type") == "text", F.col("text")).alias("content"),
    )
    return chunk_extractions(rec).select(
        F.col("source_file").cast("long").alias("doc_id"), "file_type", "chunk_index", "chunk_hash"
    )


@query(
    "corpus_counts_grouping_sets",
    f"""WITH {WINDOWS_SQL}, g AS (SELECT source, lang, CASE WHEN start_word = 0 THEN 'first' ELSE 'later' END AS chunk_type, count(*) AS n FROM wins
  GROUP BY GROUPING SETS ((source), (lang), (chunk_type)))
SELECT CASE WHEN source IS NOT NULL THEN 'source' WHEN lang IS NOT NULL THEN 'lang' ELSE 'chunk_type' END AS dimension, coalesce(source, lang, chunk_type) AS value, n FROM g""",
)
def corpus_counts_grouping_sets(spark, sf):
    from ..plans.corpus import corpus_counts

    w = word_windows(table(spark, sf, "documents"), ["source", "lang"]).withColumn(
        "chunk_type", F.when(F.col("chunk_start_word") == 0, "first").otherwise("later")
    )
    return corpus_counts(w, ["source", "lang", "chunk_type"])


@query("index_sizes", f"WITH {WINDOWS_SQL} SELECT source, count(*) AS n_chunks, sum(end_word - start_word) AS n_words FROM wins GROUP BY ALL")
def index_sizes(spark, sf):
    w = word_windows(table(spark, sf, "documents"), ["source"])
    return w.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.sum(F.col("chunk_end_word") - F.col("chunk_start_word")).alias("n_words")
    )


