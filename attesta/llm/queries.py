"""One query per operator, over whole tables, with its DuckDB statement where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, hamming, langid, line_dedup, mixing, page_content, ppm, prefix_trie, repeats, simhash, spotsigs, toxicity
from .common import documents, remainder, tokenizer_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


@query("op1_hamming_topk", hamming.SQL)
def op1(spark: SparkSession, sf: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    codes = vectors.select(F.col("vec_id").alias("id"), hamming.sign_code(F.col("embedding")).alias("code"))
    return hamming.search(codes, codes.filter(F.col("id") % 20 == 0), k=10)


@query("op2_simhash_near_dedup")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf), shingle=4, distance=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op3_toxicity")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    held_out = remainder(F.col("doc_id"), 5) == 0
    docs = documents(spark, sf)
    lexicon = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"), ~held_out)
    scored = toxicity.toxicity(docs, lexicon)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "hits", "n_words")


@query("op4_ppm_scores")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    held_out = remainder(F.col("doc_id"), 7) == 2
    # equal ids are on the same side
    scored = ppm.score(documents(spark, sf), ~held_out)
    return scored.withColumn("held_out", held_out).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op5_bpe_round_trip")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.digests(documents(spark, sf), tokenizer_path())


@query("op6_spot_signatures", spotsigs.SQL)
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return spotsigs.compare(documents(spark, sf))


@query("op7_line_dedup", line_dedup.SQL.format(ratio=0.1, min_pages=5))
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return line_dedup.drop_boilerplate(documents(spark, sf), ratio=0.1, min_pages=5).select("doc_id", "n_lines", "n_dropped", "text")


@query("op8_repeated_strings")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return repeats.remove_repeats(documents(spark, sf), length=400).drop("kept")


@query("op9_language_id")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    held_out = remainder(F.col("doc_id"), 5) == 0
    docs = documents(spark, sf)
    found = langid.identify(docs, langid.fit(docs, ~held_out), keep=["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


@query("op10_source_mixing", mixing.SQL)
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(documents(spark, sf)).select("doc_id", "text", "lang", "source", "n_chars", "copy", "mix_order")


@query("op11_conversation_trie", prefix_trie.SQL)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_trie.conversation_trie(spark.read.parquet(f"{sf}/conversations.parquet"))


@query("op12_token_alignment")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return alignment.alignment_digests(documents(spark, sf), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


@query("op13_main_text")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return page_content.main_text(spark.read.parquet(f"{sf}/pages.parquet"), page_content.fit(), ["page_id", "url"])
