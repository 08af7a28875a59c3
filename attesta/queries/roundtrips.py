"""Sinks and sources together: tables are written to the shared folder, read back and compared as a whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.training import benchmark_summary, qa_pairs, with_split
from ..session import ROCKSDB, shared_folder, table
from ..sources.readers import discover_files, read_credits, read_extractions, read_page_text, read_text_files
from ..sources.writers import write_chunks, write_training, write_xml
from ..streaming.ingest import current_scores, dedupe_stream, follow_scores, ingest_chunks, stream_documents
from .evidence import QA_SQL, SPLIT, mention_pages
from .registry import query
from .sqltext import strip


@query("chunk_store_files", "SELECT doc_id, source, md5(text) AS text_md5 FROM documents")
def chunk_store_files(spark, sf):
    """Chunk store partitioned by source."""
    out = shared_folder(spark)
    write_chunks(table(spark, sf, "documents").select("doc_id", "source", "text"), out)
    return spark.read.parquet(out).select("doc_id", F.col("source").cast("string").alias("source"), F.md5("text").alias("text_md5"))


@query("credit_files", "SELECT p_brand AS credit_code, p_name AS credit_name, p_size AS points_max, p_type || ' ~ ' || p_name AS requirements FROM part")
def credit_files(spark, sf):
    """Parts as credit records, a hundred to a JSON array file."""
    out = shared_folder(spark)
    record = F.to_json(
        F.struct(
            F.col("p_brand").alias("credit_code"), F.col("p_name").alias("credit_name"), F.col("p_size").cast("int").alias("points_max"),
            F.array("p_type", "p_name").alias("requirements"),
        )
    )
    blocks = table(spark, sf, "part").groupBy(F.floor(F.col("p_partkey") / 100).alias("block")).agg(F.collect_list(record).alias("r"))
    value = F.concat(F.lit("["), F.array_join("r", ","), F.lit("]")).alias("value")
    blocks.select("block", value).write.partitionBy("block").text(out)
    return read_credits(spark, out).select("credit_code", "credit_name", "points_max", F.array_join("requirements", " ~ ").alias("requirements"))


@query("extraction_files", "SELECT 'item ' || item_id AS source_file, 1 AS page, md5(text) AS text_md5 FROM benchmark")
def extraction_files(spark, sf):
    """Extraction records in a tree of folders, one JSON file each."""
    out = shared_folder(spark)
    pages = F.array(F.struct(F.lit(1).alias("page"), F.col("text"), F.length("text").alias("total_chars"), F.lit(False).alias("ocr_used")))
    records = table(spark, sf, "benchmark").select(
        "item_id", F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("source_file"), F.lit("pdf").alias("file_type"), pages.alias("text_content")
    )
    records.write.partitionBy("item_id").json(out)
    found = read_extractions(spark, out).select("source_file", F.explode("text_content").alias("t"))
    return found.select("source_file", F.col("t.page").alias("page"), F.md5("t.text").alias("text_md5"))


@query("text_file_tree", "SELECT source AS folder, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY ALL")
def text_file_tree(spark, sf):
    """Documents as text files, a folder per source, found by name and read by content."""
    out = shared_folder(spark)
    table(spark, sf, "documents").select("source", F.col("text").alias("value")).write.partitionBy("source").text(out)
    folder = F.regexp_extract("path", "/source=([^/]+)/", 1).alias("folder")
    found = discover_files(spark, out, "*.txt").select("path")
    lines = read_text_files(spark, out).join(found, "path").select(folder, F.explode(F.split(F.regexp_replace("content", "\n$", ""), "\n")).alias("line"))
    return lines.groupBy("folder").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


@query(
    "training_files",
    f"WITH {QA_SQL}, s AS (SELECT *, {SPLIT.format(k='question')} AS split FROM qb) SELECT 'qa' AS kind, split, count(*) AS n, count(DISTINCT md5(question || answer)) AS n_distinct FROM s GROUP BY ALL "
    f"UNION ALL SELECT 'benchmark', 'train', count(*) FILTER (split = 'train'), count(*) FILTER (split = 'test') FROM s",
)
def training_files(spark, sf):
    """Question pairs by split and their summary row, as JSON lines."""
    out = shared_folder(spark)
    qa = with_split(qa_pairs(mention_pages(spark, sf)))
    summary = benchmark_summary(qa)
    write_training(qa, table(spark, sf, "benchmark"), table(spark, sf, "conversations"), summary, out)
    pairs = spark.read.schema("question STRING, answer STRING, split STRING").json(f"{out}/qa_pairs").groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(F.md5(F.concat("question", "answer"))).alias("n_distinct")
    )
    total = spark.read.schema("train_size LONG, test_size LONG").json(f"{out}/benchmark")
    return pairs.select(F.lit("qa").alias("kind"), "split", "n", "n_distinct").union(total.select(F.lit("benchmark"), F.lit("train"), "train_size", "test_size"))


@query("xml_files", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def xml_files(spark, sf):
    out = shared_folder(spark)
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    write_xml(rows, out)
    kinds = {f.name: f.dataType for f in rows.schema}
    schema = "c_custkey LONG, c_name STRING, c_nationkey LONG"
    read = spark.read.format("xml").option("rowTag", "extraction").schema(schema).load(out)
    return read.select(*[F.col(c).cast(t).alias(c) for c, t in kinds.items()])


@query(
    "stream_ingest",
    "SELECT md5(text) AS text_md5, arg_min(doc_id, (doc_id % 2) * 1000000000000 + doc_id) AS doc_id FROM documents GROUP BY ALL",
)
def stream_ingest(spark, sf):
    """All documents arrive as a stream, the odd ones later; each text is stored once, under the least id of its first batch."""
    out = shared_folder(spark)
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    whole = lambda df: df.select("doc_id", "source", "text", F.lit(0).alias("chunk_index"), F.md5("text").alias("chunk_hash"))
    for part in (0, 1):
        docs.filter(F.col("doc_id") % 2 == part).write.mode("append").json(f"{out}/in")
        ingest_chunks(stream_documents(spark, f"{out}/in"), f"{out}/store", f"{out}/offsets", whole).awaitTermination()
    return spark.read.parquet(f"{out}/store").select("text_md5", "doc_id")


@query("stream_dedupe", "SELECT text_md5, count(*) AS n FROM (SELECT DISTINCT md5(event_type || '/' || user_id) AS text_md5 FROM events) GROUP BY ALL")
def stream_dedupe(spark, sf):
    """Events of a kind and user pass once: the watermark spans the whole log."""
    out = shared_folder(spark)
    text = F.concat("event_type", F.lit("/"), F.col("user_id").cast("string"))
    table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), text.alias("text")).write.parquet(f"{out}/in")
    stream = spark.readStream.schema("ts TIMESTAMP, text STRING").parquet(f"{out}/in")
    once = dedupe_stream(stream, lateness="3650 days").select(F.md5("text").alias("text_md5"))
    once.writeStream.option("checkpointLocation", f"{out}/offsets").trigger(availableNow=True).format("parquet").start(f"{out}/out").awaitTermination()
    return spark.read.schema("text_md5 STRING").parquet(f"{out}/out").groupBy("text_md5").agg(F.count(F.lit(1)).alias("n"))


@query(
    "latest_score_stream",
    """WITH u AS (SELECT o_custkey AS project_id, o_orderkey AS update_no, o_totalprice::DOUBLE AS points FROM orders)
SELECT project_id, count(*) + count(*) FILTER (update_no % 16 = 3) AS n_updates, arg_max(points, update_no) AS total_points FROM u GROUP BY ALL""",
)
def latest_score_stream(spark, sf):
    """Orders as score updates of their customers: four batches, later numbers partly first, some updates twice."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    out = shared_folder(spark)
    n = F.col("o_orderkey")
    updates = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("project_id"), n.alias("update_no"), F.col("o_totalprice").cast("double").alias("points"),
        ((n * 7) % 4).cast("int").alias("part"),
    )
    twice = updates.filter(F.col("update_no") % 16 == 3).withColumn("part", F.lit(3))
    every = updates.unionByName(twice)
    schema = "project_id LONG, update_no LONG, points DOUBLE"
    for part in range(4):
        every.filter(F.col("part") == part).drop("part").write.mode("append").parquet(f"{out}/in")
        stream = spark.readStream.schema(schema).parquet(f"{out}/in")
        follow_scores(stream, f"{out}/states", f"{out}/offsets").awaitTermination()
    return current_scores(spark, f"{out}/states")


@query(
    "page_text_files",
    """WITH c AS (SELECT conv_id // 4 AS k, string_agg('=== PAGE ' || turn || ' ===' || chr(10) || text || chr(10), '' ORDER BY conv_id, turn) AS content FROM conversations GROUP BY ALL),
p AS (SELECT k, unnest(string_split(content, '=== PAGE')) AS piece, generate_subscripts(string_split(content, '=== PAGE'), 1) - 1 AS page FROM c)
SELECT k, page, """
    + strip("piece")
    + " AS text FROM p WHERE page > 0 AND "
    + strip("piece")
    + " <> ''",
)
def page_text_files(spark, sf):
    """Four conversations to a text file, a page mark before each turn, read line by line."""
    out = shared_folder(spark)
    turn = F.concat(F.lit("=== PAGE "), F.col("turn").cast("string"), F.lit(" ===\n"), F.col("text"))
    turns = table(spark, sf, "conversations").select(F.floor(F.col("conv_id") / 4).alias("k"), "conv_id", "turn", turn.alias("text"))
    files = turns.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("conv_id", "turn", "text"))).alias("t"))
    value = F.array_join(F.transform("t", lambda r: r["text"]), "\n")
    files.select("k", value.alias("value")).write.partitionBy("k").text(out)
    pages = read_page_text(spark, f"{out}/k=*")
    return pages.select(F.regexp_extract("source_file", r"/k=(\d+)/", 1).cast("bigint").alias("k"), "page", "text")
