"""Training and benchmark rows from page texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_any, md5_bucket, sentences

# ---- fixed values: header pattern, question forms, requirement words ----------------------------
CREDIT_MENTION = r"(?i)([A-Z]{1,2})\s+(Credit|Prerequisite)\s+([^:]+):\s*(.+)"
QUESTION_FORMS = [
    "What is %s %s: %s?",
    "What are the requirements for %s %s: %s?",
    "How do I achieve %s %s: %s?",
    "Tell me about %s %s: %s",
    "%s %s: %s requirements",
]
REQUIREMENT_WORDS = ["must", "shall", "require", "provide", "demonstrate", "achieve"]
# -------------------------------------------------------------------------------------------------


def credit_mentions(pages: DataFrame, text: str = "text") -> DataFrame:
    """pages(source_file, page, text) -> one row per credit mention, in text order."""
    found = F.arrays_zip(
        *[F.regexp_extract_all(text, F.lit(CREDIT_MENTION), F.lit(g)).alias(n)
          for g, n in [(1, "code"), (2, "kind"), (3, "name"), (4, "about")]]
    )
    return pages.select("source_file", "page", F.posexplode(found).alias("mention_no", "m")).select(
        "source_file", "page", "mention_no", F.col("m.code").alias("credit_code"), F.col("m.kind").alias("credit_type"),
        F.trim(F.regexp_replace("m.name", r"(?U)^\s+|\s+$", "")).alias("credit_name"),
        F.trim("m.about").alias("description"),
    )


def qa_pairs(pages: DataFrame) -> DataFrame:
    """Five questions with answer and citation per credit mention."""
    args = ["credit_code", "credit_type", "credit_name"]
    return credit_mentions(pages).select(
        F.explode(F.array(*[F.format_string(q, *args) for q in QUESTION_FORMS])).alias("question"),
        F.concat(F.format_string("%s %s: %s", *args), F.lit("\n\n"), F.col("description")).alias("answer"),
        F.struct("source_file", "page", *args).alias("citation"),
        F.lit("leed_credits").alias("source"), F.lit("medium").alias("difficulty"),
    )


def evidence_rows(pages: DataFrame) -> DataFrame:
    """Lines of 20 or more characters that read like a requirement, labelled supported."""
    lines = pages.select(
        "source_file", "page", F.split("text", "\n").alias("lines"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"),
    ).withColumn(
        # the line with those before and after it
        "credit_context", F.array_join(F.slice("lines", F.greatest(F.col("line_no"), F.lit(1)), F.when(F.col("line_no") == 0, 2).otherwise(3)), "\n"),
    ).withColumn("line", F.regexp_replace("line", r"(?U)^\s+|\s+$", ""))
    return lines.filter((F.length("line") >= 20) & contains_any(F.col("line"), REQUIREMENT_WORDS)).select(
        "source_file", "page", "line_no", F.col("line").alias("evidence_text"), "credit_context",
        F.lit("supported").alias("label"), F.lit(0.8).alias("confidence"),
    )


def citation_rows(pages: DataFrame) -> DataFrame:
    """Sentences of 30 to 300 characters with the citation of their page."""
    return (
        pages.select("source_file", "page", F.posexplode(sentences(F.col("text"))).alias("sentence_no", "statement"))
        .filter(F.length("statement").between(30, 300))
        .withColumn("citation_format", F.concat(F.lit("["), F.col("source_file"), F.lit(", p."), F.col("page").cast("string"), F.lit("]")))
    )


def with_split(rows: DataFrame, key: str = "question", train_tenths: int = 8) -> DataFrame:
    """Reproducible train/test split by a hash bucket of the key."""
    return rows.withColumn("split", F.when(md5_bucket(F.col(key), 10) < train_tenths, "train").otherwise("test"))


def benchmark_summary(split_rows: DataFrame) -> DataFrame:
    return split_rows.agg(
        F.lit("LEED_RAG_Benchmark").alias("name"), F.lit("1.0").alias("version"),
        F.count_if(F.col("split") == "train").alias("train_size"),
        F.count_if(F.col("split") == "test").alias("test_size"),
    )
