"""The whole evidence analysis: search, references, decision, template and key facts of each piece of evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..functions.vectors import hashed_vector
from ..operators.skew import join_to_unique
from ..session import written
from .evidence import citation_blocks, citations, context_blocks, decisions, key_facts, templates, text_evidence
from .index import SearchIndex
from .search import search


def analyze_evidence(
    queries: DataFrame, evidence: DataFrame, index: SearchIndex, catalogue: DataFrame | None = None, keep: list[str] | None = None,
    k: int = 5, **options,
) -> DataFrame:
    """One row per evidence(evidence_id, query_id, text): what the corpus says about it.

    queries(query_id, text) are searched once (`search`, k hits each); the decision compares the evidence
    with the hits of its query, and the references, context and key facts of the query stand beside it.
    With a `catalogue` of credits, the template of the primary credit is added (`templates`, which takes
    `keep` columns along). Evidence without hits is 'unknown'.
    """
    hits = written(search(queries, index, k, **options))
    decided = decisions(text_evidence(evidence), hits.withColumn("vector", hashed_vector(tokens(F.col("text")))))
    facts = key_facts(hits)
    about = facts.join(citation_blocks(citations(hits)), "query_id").join(context_blocks(hits), "query_id")
    if catalogue is not None:
        asked = facts.select(F.col("primary_credit").alias("identifier")).filter("identifier is not null").distinct()
        filled = templates(asked, catalogue, keep or [])
        about = about.join(
            filled.select(F.col("identifier").alias("primary_credit"), F.struct(*[c for c in filled.columns if c != "identifier"]).alias("template")),
            "primary_credit", "left",
        )
    counts = evidence.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_evidence"))
    # a query with very much evidence has its rows salted
    return join_to_unique(decided, written(about.join(counts, "query_id")), "query_id", "n_evidence", ["evidence_id"], how="left")
