"""A training corpus from `documents`: five stages, each over all that the one before kept."""

from __future__ import annotations

import os
import sys
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark import cloudpickle  # noqa: E402
from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import attesta  # noqa: E402
from attesta.llm import bpe, langid, line_dedup, mixing, near_text  # noqa: E402
from attesta.llm.common import remainder, tokenizer_path  # noqa: E402
from attesta.session import ensure_checkpoint_dir  # noqa: E402

cloudpickle.register_pickle_by_value(attesta)

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that no language centroid is near, or that have no letter; `lang` becomes the prediction."""
    model = langid.fit(docs, remainder(F.col("doc_id"), 5) != 0)
    found = langid.identify(docs, model, keep=["doc_id", "text", "source", "n_chars"])
    return found.filter(~F.col("rejected")).select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that are boilerplate of their source; every document stays, `n_chars` follows its text."""
    out = line_dedup.drop_boilerplate(docs, site="source", ratio=0.1, min_pages=5)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least id of each group of near-duplicates: five-word shingles, similarity 0.8."""
    return near_text.keep_one(docs, shingle=5, similarity=0.8).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that all sources weigh the same, in shuffled order."""
    return mixing.mix(docs).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes every text and decodes it again: one row per document and copy."""
    return bpe.digests(docs, tokenizer_path())


STAGES = [
    ("language identification", language), ("line de-duplication", lines), ("SimHash near-duplicates", near_duplicates),
    ("source mixing", mixture), ("byte-pair encoding", tokens),
]

# a learned classifier, XXH64 and byte-pair merges are beyond SQL: tests/llm compare with plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(f"{base}/{i}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{i}")
    return docs
