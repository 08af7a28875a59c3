"""Retrieval evaluation: relevance per query, summaries, quality buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import or_none

# ---- fixed values: evaluation queries ------------------------------------------------------------
# with expected topics and source; queries about one particular building are left to the caller
EVALUATION_QUERIES = [
    ("energy efficiency requirements", ["energy", "efficiency", "ASHRAE", "performance"], "credits"),
    ("water efficiency LEED credits", ["water", "efficiency", "WE", "fixtures"], "credits"),
    ("cooling tower water treatment", ["cooling", "tower", "water", "treatment"], "all"),
    ("integrative process worksheet", ["integrative", "process", "worksheet", "IP"], "all"),
    ("LEED v4.1 BD+C credits", ["LEED", "v4.1", "BD+C", "credits"], "credits"),
    ("sustainable materials", ["materials", "sustainable", "MR", "recycled"], "credits"),
    ("indoor air quality", ["air", "quality", "EQ", "ventilation"], "credits"),
    ("site selection criteria", ["site", "selection", "SS", "location"], "credits"),
]
BASIC_QUERIES = [
    "energy efficiency requirements", "water conservation credits", "indoor air quality", "sustainable materials",
    "renewable energy", "transit access", "bicycle facilities", "parking reduction", "heat island reduction", "light pollution",
]
CREDIT_QUERIES = [
    "EA Credit Optimize Energy Performance", "WE Credit Water Use Reduction", "EQ Credit Indoor Air Quality Assessment",
    "MR Credit Building Product Disclosure", "LT Credit Access to Quality Transit", "SS Credit Heat Island Reduction",
    "IN Credit Innovation", "RP Credit Regional Priority",
]
COMPLIANCE_QUERIES = [
    "What documentation is required for LEED credits?", "How to calculate energy performance metrics?",
    "What are the prerequisites for certification?", "How to achieve innovation credits?",
    "What is the minimum energy performance requirement?", "How to document water use reduction?",
    "What are the requirements for indoor environmental quality?", "How to calculate renewable energy credits?",
]
DEPLOYMENT_QUERIES = [
    "What are the requirements for energy efficiency credits?", "How do I achieve LEED points for water conservation?",
    "What is required for indoor air quality credits?", "How to get points for sustainable materials?",
    "What are the prerequisites for LEED certification?", "How to calculate energy performance metrics?",
    "What documentation is needed for LEED credits?", "How to achieve innovation credits in LEED?",
    "What are the requirements for location and transportation credits?", "How to implement renewable energy systems for LEED?",
]
# --------------------------------------------------------------------------------------------------
SMOKE_QUERIES = BASIC_QUERIES + CREDIT_QUERIES + COMPLIANCE_QUERIES


def deployment_queries(spark: SparkSession) -> DataFrame:
    """(query_id, text) of the questions asked after an index is deployed."""
    return spark.createDataFrame(list(enumerate(DEPLOYMENT_QUERIES)), "query_id long, text string")


def evaluation_queries(spark: SparkSession) -> DataFrame:
    """(query_id, text, expected_topics, sources) of the topic queries, each with the source it asks for."""
    rows = [(i, text, topics, [source]) for i, (text, topics, source) in enumerate(EVALUATION_QUERIES)]
    return spark.createDataFrame(rows, "query_id long, text string, expected_topics array<string>, sources array<string>")


def smoke_queries(spark: SparkSession) -> DataFrame:
    """(query_id, text) of the queries without expected topics."""
    return spark.createDataFrame(list(enumerate(SMOKE_QUERIES)), "query_id long, text string")


def hit_relevance(text: Column, topics: Column, code: Column, category: Column) -> Column:
    """Share of expected topics in the text, plus 0.2 for the code and 0.1 for the category; at most 1."""
    low = F.transform(topics, lambda t: F.lower(t))

    def named(c: Column) -> Column:
        return F.coalesce(or_none(c).isNotNull() & F.exists(low, lambda t: F.contains(F.lower(c), t)), F.lit(False))

    share = F.when(
        F.size(low) > 0, F.size(F.filter(low, lambda t: F.contains(F.lower(text), t))) / F.size(low)
    ).otherwise(F.lit(0.5))
    return F.least(
        F.lit(1.0), share + F.when(named(code), 0.2).otherwise(0.0) + F.when(named(category), 0.1).otherwise(0.0)
    )


def query_relevance(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """queries(query_id, expected_topics) x hits -> mean relevance per query; 0 without hits."""
    scored = queries.join(hits, "query_id", "left").withColumn(
        "relevance",
        F.when(
            F.col("text").isNotNull(),
            hit_relevance(F.col("text"), F.col("expected_topics"), F.col("credit_code"), F.col("category")),
        ),
    )
    return scored.groupBy("query_id").agg(
        F.count("text").alias("n_results"), F.coalesce(F.round(F.avg("relevance"), 6), F.lit(0.0)).alias("relevance")
    )


def evaluation_summary(results: DataFrame) -> DataFrame:
    """results(success, relevance, response_time) -> totals; means run over the successes."""
    ok = F.col("success")
    n_ok = F.count_if(ok)
    return results.agg(
        F.count(F.lit(1)).alias("total_queries"), n_ok.alias("successful_queries"),
        F.round(F.coalesce(F.try_divide(n_ok, F.count(F.lit(1))), F.lit(0.0)), 6).alias("success_rate"),
        F.round(F.coalesce(F.avg(F.when(ok, F.col("relevance"))), F.lit(0.0)), 6).alias("average_relevance"),
        F.round(F.coalesce(F.avg(F.when(ok, F.col("response_time"))), F.lit(0.0)), 6).alias("average_response_time"),
    )


def verdicts(summary: DataFrame) -> DataFrame:
    """Pass marks: answers within 2 s, relevance above 0.6, success above 0.8."""
    return summary.withColumns(
        {
            "time_verdict": F.when(F.col("average_response_time") < 2.0, "met").otherwise("not met: above two seconds"),
            "relevance_verdict": F.when(F.col("average_relevance") > 0.6, "met").otherwise("not met: at or below 0.6"),
            "success_verdict": F.when(F.col("success_rate") > 0.8, "met").otherwise("not met: at or below 0.8"),
        }
    )


def retrieval_quality(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Queries answered, mean top score, score buckets, code and category coverage."""
    per_query = queries.select("query_id").join(
        hits.groupBy("query_id").agg(F.min_by("score", "rank").alias("top_score")), "query_id", "left"
    )
    top = F.col("top_score")
    scores = per_query.agg(
        F.count(F.lit(1)).alias("total_queries"), F.count(top).alias("queries_with_results"),
        F.round(F.coalesce(F.avg(top), F.lit(0.0)), 6).alias("average_top_score"),
        F.count_if(top > 0.7).alias("high"), F.count_if((top > 0.5) & (top <= 0.7)).alias("medium"),
        F.count_if(top <= 0.5).alias("low"),
    )
    cover = hits.agg(
        F.count_distinct(or_none(F.col("credit_code"))).alias("n_codes"),
        F.count_distinct(or_none(F.col("category"))).alias("n_categories"),
    )
    return scores.select(
        "*", cover.select("n_codes").scalar().alias("n_codes"), cover.select("n_categories").scalar().alias("n_categories")
    )
