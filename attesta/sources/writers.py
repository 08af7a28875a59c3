"""Sinks: chunk stores, credit exports, training sets, XML, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_chunks(chunks: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Chunk store partitioned by source; large sources keep as many files as they have partitions."""
    writer = chunks.write.mode(mode).partitionBy("source")
    writer.parquet(path) if fmt == "parquet" else writer.json(path)


def credit_csv_rows(credits: DataFrame) -> DataFrame:
    """Credits as flat rows: counts of list fields, joined errors and pages."""
    pages = F.col("pages") if "pages" in credits.columns else F.col("sources.pages")
    count = lambda c: F.coalesce(F.size(c), F.lit(0)).alias(f"{c}_count")
    return credits.select(
        "credit_code", "credit_name", "category", "credit_type", "points_min", "points_max", "intent",
        count("requirements"), count("documentation"), "completeness_score",
        F.array_join("validation_errors", "; ").alias("validation_errors"),
        F.array_join(F.transform(pages, lambda p: p.cast("string")), ", ").alias("pages"),
    )


def requirement_rows(credits: DataFrame) -> DataFrame:
    """One numbered row per requirement."""
    return credits.select("credit_code", "credit_name", F.posexplode("requirements").alias("n", "requirement_text")).select(
        "credit_code", "credit_name", (F.col("n") + 1).alias("requirement_number"), "requirement_text"
    )


def statistics_rows(credits: DataFrame) -> DataFrame:
    """(metric, value): the statistics sheet, one aggregate turned into rows."""
    is_pre = F.col("credit_type") == "Prerequisite"
    one = credits.agg(
        F.count(F.lit(1)).cast("double").alias("total"), F.count_if(is_pre).cast("double").alias("pre"),
        F.count_if(~is_pre).cast("double").alias("cred"),
        F.coalesce(F.sum("points_max"), F.lit(0)).cast("double").alias("points"),
        F.coalesce(F.avg("completeness_score"), F.lit(0.0)).alias("mean"),
    )
    pairs = "'Total Credits', total, 'Prerequisites', pre, 'Credits', cred, 'Total Points', points, 'Average Completeness', mean"
    return one.select(F.expr(f"stack(5, {pairs}) AS (metric, value)"))


def write_credit_csv(credits: DataFrame, path: str) -> None:
    credit_csv_rows(credits).write.mode("overwrite").option("header", True).csv(path)


def write_credit_report(credits: DataFrame, path: str) -> None:
    """Three sheets as three CSV folders."""
    cols = ["credit_code", "credit_name", "category", "credit_type", "points_min", "points_max", "intent", "completeness_score"]
    for name, df in {
        "Credits": credits.select(*cols), "Requirements": requirement_rows(credits), "Statistics": statistics_rows(credits),
    }.items():
        df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def write_training(qa: DataFrame, evidence: DataFrame, cited: DataFrame, summary: DataFrame, path: str) -> None:
    """JSONL training data; question pairs are partitioned by their split."""
    qa.write.mode("overwrite").partitionBy("split").json(f"{path}/qa_pairs")
    evidence.write.mode("overwrite").json(f"{path}/evidence")
    cited.write.mode("overwrite").json(f"{path}/citations")
    summary.write.mode("overwrite").json(f"{path}/benchmark")


def write_xml(records: DataFrame, path: str, root: str = "extractions", row: str = "extraction") -> None:
    records.write.mode("overwrite").format("xml").option("rootTag", root).option("rowTag", row).save(path)


def write_reports(reports: DataFrame, path: str, key: str = "project_id") -> None:
    """reports(key, report): Markdown text files in one folder per key."""
    reports.select(key, F.col("report").alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def write_results(results: DataFrame, path: str) -> None:
    """Nested results as JSON lines, one per project."""
    results.write.mode("overwrite").json(path)
