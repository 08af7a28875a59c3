"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from attesta.operators.lexical import bm25_candidates, bm25_search  # noqa: E402
from attesta.plans.index import read_index, search_index, write_index  # noqa: E402
from attesta.plans.search import search  # noqa: E402
from attesta.queries import registry  # noqa: E402
from attesta.queries.inputs import passages  # noqa: E402
from attesta.session import build_session, shared_folder, table, written  # noqa: E402

HEADLINE = [
    "word_windows", "heading_chunks", "credit_parse", "bm25_term_stats", "bm25_topk", "text_dense_topk", "dense_topk",
    "weighted_fusion", "rrf_multi_query", "query_expansion", "near_dup_two_keys", "grouped_search", "full_search",
    "evidence_decision", "qa_pairs", "html_text", "exact_dup_md5", "energy_points", "compliance_summary", "stops_near_sites",
]


def batch_times(spark, sf_dir: str) -> dict:
    """Seconds to index and store all documents, and of searches on the stored index in batches of growing size."""
    folder = shared_folder(spark)
    docs = table(spark, sf_dir, "documents").select(
        F.lit("all").alias("source"), F.col("doc_id").alias("chunk_id"), "text", F.col("source").alias("credit_id"),
        F.col("lang").alias("section"), F.col("doc_id").cast("string").alias("doc"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"),
    )
    start = time.perf_counter()
    built = search_index(docs)
    write_index(built, folder)
    out = {"index_seconds": round(time.perf_counter() - start, 3), "search_batch_seconds": {}, "full_search_batch_seconds": {}}
    index = read_index(spark, folder)
    asked = passages(spark, sf_dir)
    many = written(asked.withColumn("query_id", F.explode(F.sequence(F.col("query_id"), F.col("query_id") + 9000, F.lit(1000)))))
    for n in (1, 10, 100, 1000):
        batch = many.orderBy("query_id").limit(n)
        start = time.perf_counter()
        bm25_search(batch, index.lexical, 10).write.format("noop").mode("overwrite").save()
        out["search_batch_seconds"][str(n)] = round(time.perf_counter() - start, 3)
        start = time.perf_counter()
        search(batch, index, 5).write.format("noop").mode("overwrite").save()
        out["full_search_batch_seconds"][str(n)] = round(time.perf_counter() - start, 3)
    # rows that leave the scoring tasks, against all pairs of the 200 queries and the documents
    out["bm25_candidate_rows"] = bm25_candidates(asked, index.lexical, 10).count()
    out["bm25_pairs"] = asked.count() * docs.count()
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    registry.load_all()
    spark = build_session(f"local[{cpus}]", cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    # start-up of the JVM, the file readers, code generation and Python workers is not part of any query
    spark.range(8 * cpus).repartition(cpus).mapInArrow(lambda batches: batches, "id long").write.format("noop").mode("overwrite").save()
    registry.QUERIES["query_expansion"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    for name in [a for a in sys.argv[1:] if a != "batches"] or HEADLINE:
        start = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
        print(f"{name}: {times[name]}s", file=sys.stderr, flush=True)

    batches = batch_times(spark, sf_dir) if len(sys.argv) < 2 or "batches" in sys.argv else {}
    docs = table(spark, sf_dir, "documents").count()
    asked = table(spark, sf_dir, "benchmark").count()
    rate = {
        n: round(v / times[q], 1)
        for n, q, v in [
            ("documents_chunked_per_s", "word_windows", docs), ("documents_indexed_per_s", "bm25_term_stats", docs),
            ("bm25_query_document_pairs_per_s", "bm25_topk", docs * asked), ("bm25_queries_per_s", "bm25_topk", asked),
            ("full_search_queries_per_s", "full_search", asked),
        ]
        if q in times
    }
    print(
        json.dumps(
            {
                "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "throughput": rate, "cpus": cpus, **batches,
            }
        )
    )


if __name__ == "__main__":
    main()
