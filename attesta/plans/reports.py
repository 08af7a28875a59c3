"""Markdown reports and nested results per project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import compact
from .scorecards import location_scores


def _items(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda v: F.concat(F.lit("- "), v)), "\n")


def _section(title: str, body: Column) -> Column:
    """Blank line, title and body; nothing when the body is empty."""
    return F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(f"\n{title}\n"), body, F.lit("\n"))).otherwise("")


def compliance_reports(summaries: DataFrame) -> DataFrame:
    """summaries(project_id, project_name, n_targets, credits_achieved, total_points, credit_details, recommendations)."""
    g = lambda c: F.col(c).cast("string")
    details = F.array_join(
        F.transform(
            F.map_entries("credit_details"),
            lambda e: F.concat(F.lit("- **"), e["key"], F.lit("**: "), e["value"].cast("string"), F.lit(" points")),
        ),
        "\n",
    )
    text = F.concat(
        F.lit("# LEED Certification Analysis Report\n\n**Project:** "), F.coalesce("project_name", F.lit("Unknown")),
        F.lit("\n\n## Compliance Summary\n- Total Credits Analyzed: "), g("n_targets"), F.lit("\n- Credits Achieved: "),
        g("credits_achieved"), F.lit("\n- Total Points: "), g("total_points"), F.lit("\n"),
        _section("### Credit Details", details), _section("### Recommendations", _items(F.col("recommendations"))),
    )
    return summaries.select("project_id", text.alias("report"))


def location_reports(sites: DataFrame) -> DataFrame:
    """sites(project_id, address, n_stops, total_trips, weekend_trips, walk_score, land flags) -> one report each."""
    rows = F.array_sort(F.collect_list(F.struct("credit", "points", "status")))
    cards = location_scores(sites).groupBy("project_id").agg(rows.alias("cards"))
    g = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("false"))
    points = lambda i: F.get("cards", F.lit(i))["points"].cast("string")
    card = lambda c: F.concat(
        F.lit("### "), c["credit"], F.lit("\n- Status: "), c["status"], F.lit("\n- Points: "), c["points"].cast("string")
    )
    text = F.concat(
        F.lit("# Location Analysis Report\n\n## Site Information\n- Address: "), g("address"),
        F.lit("\n\n## Transit Access Analysis\n- Total weekday trips: "), g("total_trips"), F.lit("\n- Weekend trips: "),
        g("weekend_trips"), F.lit("\n- Nearby stops: "), g("n_stops"), F.lit("\n- LT Credit Points: "), points(0),
        F.lit("\n\n## Walkability Analysis\n- Walk Score: "), g("walk_score"), F.lit("\n- LT Credit Points: "), points(1),
        F.lit("\n\n## Environmental Context\n- Flood zone: "), g("flood_zone"), F.lit("\n- Sensitive habitat: "),
        g("sensitive_habitat"), F.lit("\n- Prime farmland: "), g("prime_farmland"), F.lit("\n- SS Credit Points: "), points(2),
        F.lit("\n\n## LEED Credit Summary\n"), F.array_join(F.transform("cards", card), "\n\n"),
    )
    return sites.join(cards, "project_id").select("project_id", text.alias("report"))


def credit_reports(projects: DataFrame, insights: DataFrame) -> DataFrame:
    """Per project and credit: header, recommendations, guidance.

    projects(query_id, project_id, project_name, project_type, credit_code); insights(query_id, recommendations, guidance).
    """
    text = F.concat(
        F.lit("# "), F.col("credit_code"), F.lit(" Credit Analysis Report\n**Project:** "), F.col("project_name"),
        F.lit("\n**Project Type:** "), F.col("project_type"), F.lit("\n"),
        _section("### Recommendations", _items(F.col("recommendations"))),
        _section("### Compliance Guidance", _items(F.col("guidance"))),
    )
    return projects.join(insights, "query_id", "left").select("project_id", "credit_code", text.alias("report"))


def search_reports(hits: DataFrame) -> DataFrame:
    """Numbered results per query: hits(query_id, rank, title, text, score, source)."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "title", "text", "score", "source")))
    one = lambda r, i: F.concat(
        F.format_string("**%d. ", i + 1), r["title"], F.lit("**\n"), compact(r["text"], 203),
        F.format_string("\nRelevance: %.3f\n", r["score"]), F.coalesce(F.concat(F.lit("Source: "), r["source"], F.lit("\n")), F.lit("")),
    )
    return hits.groupBy("query_id").agg(F.array_join(F.transform(rows, one), "\n").alias("report"))


def evaluation_report(summary: DataFrame) -> DataFrame:
    """summary with verdict columns -> one Markdown text."""
    text = F.concat(
        F.lit("# Retrieval Evaluation Report\n\n## Summary\n- **Total Queries Tested**: "), F.col("total_queries").cast("string"),
        F.format_string("\n- **Success Rate**: %.1f%%", F.col("success_rate") * 100),
        F.format_string("\n- **Average Relevance Score**: %.3f", "average_relevance"),
        F.format_string("\n- **Average Response Time**: %.2fs\n\n## Recommendations\n", "average_response_time"),
        F.concat_ws(
            "\n", F.concat(F.lit("1. **Response Time**: "), "time_verdict"), F.concat(F.lit("2. **Relevance**: "), "relevance_verdict"),
            F.concat(F.lit("3. **Success Rate**: "), "success_verdict"),
        ),
    )
    return summary.select(text.alias("report"))


def project_results(summaries: DataFrame) -> DataFrame:
    """Nested result per project, ready for JSON."""
    summary = F.struct(
        F.col("n_targets").alias("total_credits_analyzed"), "credits_achieved", "total_points", "credit_details", "recommendations"
    )
    slim = F.struct(F.col("n_targets").alias("total_credits_analyzed"), "credits_achieved", "total_points")
    return summaries.select("project_id", "project_name", slim.alias("summary"), summary.alias("full_summary"))
