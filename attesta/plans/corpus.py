"""Corpus tables: normalisation, credits list, counts and document summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import or_none
from ..operators.skew import first_per_key


def normalize_chunks(df: DataFrame, source: str, doc: str | None = None) -> DataFrame:
    """One set of names for chunks from different producers; missing inputs count as null."""
    have = {c.lower(): c for c in df.columns}
    exact = set(df.columns)

    def col(name: str, kind: str = "string"):
        return F.col(f"`{name}`") if name in exact else F.lit(None).cast(kind)

    def first(*names: str):
        return F.coalesce(*[or_none(col(n)) for n in names])

    pages = col("pages", "array<int>")
    if "pages" in have and not dict(df.dtypes)["pages"].startswith("array"):
        pages = F.when(pages.isNotNull(), F.array(pages.cast("int")))
    return df.select(
        F.coalesce(col("text"), F.lit("")).alias("text"),
        F.coalesce(col("source"), F.lit(source)).alias("source"),
        F.coalesce(col("doc"), F.lit(doc).cast("string")).alias("doc"),
        first("type", "credit_type", "CreditType").alias("type"),
        first("credit_code", "CreditCode", "category").alias("credit_code"),
        first("credit_name", "CreditName").alias("credit_name"),
        col("points_min", "int").cast("int").alias("points_min"),
        col("points_max", "int").cast("int").alias("points_max"),
        F.coalesce(col("version"), F.lit("v4.1")).alias("version"),
        pages.alias("pages"),
    )


def corpus(parts: dict[str, DataFrame]) -> DataFrame:
    """Bag union of the sources, each row labelled with its source."""
    return reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [df.withColumn("source", F.lit(name)) for name, df in parts.items()],
    )


def credit_list(chunks: DataFrame, position: str) -> DataFrame:
    """First chunk per credit code that has both a code and a name."""
    named = chunks.filter(
        (F.coalesce("credit_code", F.lit("")) != "") & (F.coalesce("credit_name", F.lit("")) != "")
    ).select(position, "credit_code", "credit_name", F.coalesce("type", F.lit("Unknown")).alias("type"), "points_min", "points_max")
    return first_per_key(named, [F.col("credit_code")], [F.col(position)])


def corpus_counts(chunks: DataFrame, dims: list[str]) -> DataFrame:
    """(dimension, value, n): one pass over the chunks, one grouping set per dimension."""
    known = chunks.select(*[F.coalesce(F.col(d).cast("string"), F.lit("unknown")).alias(d) for d in dims])
    sets = known.groupingSets([[F.col(d)] for d in dims], *[F.col(d) for d in dims]).agg(
        F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n")
    )
    bits = {(2 ** len(dims) - 1) ^ (1 << (len(dims) - 1 - i)): d for i, d in enumerate(dims)}
    name = reduce(lambda acc, kv: acc.when(F.col("gid") == kv[0], kv[1]), bits.items(), F.when(F.lit(False), ""))
    return sets.select(name.alias("dimension"), F.coalesce(*dims).alias("value"), "n")


def document_summary(pages: DataFrame, objects: dict[str, DataFrame]) -> DataFrame:
    """Totals per source file: pages, characters and one count per object table."""
    base = pages.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("total_pages"), F.sum("total_chars").alias("total_text_chars")
    )
    for name, table in objects.items():
        counts = table.groupBy("source_file").agg(F.count(F.lit(1)).alias(f"total_{name}"))
        base = base.join(counts, "source_file", "left").withColumn(f"total_{name}", F.coalesce(f"total_{name}", F.lit(0)))
    return base


def processing_counters(files: DataFrame) -> DataFrame:
    """files(status, pages, tables) -> how many were processed and what they held."""
    return files.agg(
        F.count_if(F.col("status") == "successful").alias("files_processed"),
        F.count_if(F.col("status") == "failed").alias("files_failed"),
        F.count_if(F.col("status") == "skipped").alias("files_skipped"),
        F.coalesce(F.sum("pages"), F.lit(0)).alias("pages_processed"),
        F.coalesce(F.sum("tables"), F.lit(0)).alias("tables_extracted"),
    )
