"""Citations, evidence decisions, templates and key facts from retrieved chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind, compact, or_none, tokens
from ..functions.vectors import cosine, hashed_vector, sparse_dot
from ..operators.matching import exact_templates, nearest_names, template_dictionary
from ..operators.skew import join_to_unique
from ..session import written

POSITIVE, AVERAGE = 0.42, 0.32


def decisions(evidence: DataFrame, retrieved: DataFrame, positive: float = POSITIVE, average: float = AVERAGE) -> DataFrame:
    """Does the evidence match what was retrieved for its query?

    evidence(evidence_id, query_id, vector, has_text); retrieved(query_id, rank, text, vector, source),
    a few rows per query. Every evidence row gets one decision.
    """
    # one row per query, a few hits each; a query with very much evidence has its rows salted
    packed = retrieved.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "vector", "text", "source"))).alias("ctx")
    )
    asked = evidence.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_evidence"))
    packed = written(packed.join(asked, "query_id"))
    like = sparse_dot if "struct" in dict(evidence.dtypes)["vector"] else cosine
    scored = join_to_unique(evidence, packed, "query_id", "n_evidence", ["evidence_id"], how="left").withColumn(
        "scores", F.transform("ctx", lambda r: F.round(like(F.col("vector"), r["vector"]), 6))
    )
    usable = F.coalesce(F.col("has_text") & (F.size("ctx") > 0), F.lit(False))
    top = F.array_max("scores")
    avg = F.aggregate("scores", F.lit(0.0), lambda a, x: a + x) / F.size("scores")
    best = F.get("ctx", (F.array_position("scores", top) - 1).cast("int"))
    return scored.select(
        "evidence_id", "query_id",
        F.when(~usable, "unknown").when((top >= positive) | (avg >= average), "supported").otherwise("insufficient").alias("decision"),
        F.when(usable, F.round(F.greatest(top, avg), 6)).otherwise(F.lit(0.0)).alias("confidence"),
        F.when(usable, F.round(top, 6)).alias("top_score"),
        F.when(usable, F.round(avg, 6)).alias("avg_score"),
        F.when(usable, compact(best["text"], 180)).alias("top_chunk"),
        F.when(usable, best["source"]).alias("top_source"),
    )


def text_evidence(evidence: DataFrame) -> DataFrame:
    """evidence(evidence_id, query_id, text) with its hashed vector."""
    return evidence.select(
        "evidence_id", "query_id", hashed_vector(tokens(F.col("text"))).alias("vector"),
        (F.length(F.trim(F.coalesce("text", F.lit("")))) > 0).alias("has_text"),
    )


def citations(hits: DataFrame) -> DataFrame:
    """(query_id, rank, label, source, pages, score, snippet) per hit."""
    have = set(hits.columns)

    def col(name: str, kind: str = "string") -> Column:
        return F.col(name) if name in have else F.lit(None).cast(kind)

    return hits.select(
        "query_id", "rank",
        F.coalesce(or_none(col("credit_code")), or_none(col("credit_name")), or_none(col("category")), F.lit("LEED Reference")).alias("label"),
        F.coalesce(or_none(col("source")), F.lit("knowledge-base")).alias("source"),
        F.coalesce(col("pages", "array<int>"), F.array().cast("array<int>")).alias("pages"),
        "score", compact(F.col("text")).alias("snippet"),
    )


def citation_blocks(cited: DataFrame) -> DataFrame:
    """One formatted block of numbered references per query (a few citations each)."""
    pages = F.array_join(F.transform(F.slice("pages", 1, 3), lambda p: p.cast("string")), ", ")
    head = F.concat_ws(
        " — ",
        F.concat(F.lit("**"), or_none(F.col("label")), F.lit("**")),
        F.concat(F.lit("from "), or_none(F.col("source"))),
        F.when(F.size("pages") > 0, F.concat(F.lit("(pages "), pages, F.lit(")"))),
    )
    lines = cited.withColumn("head", head)

    def entry(r: Column, i: Column) -> Column:
        number = F.concat((i + 1).cast("string"), F.lit(". "), r["head"])
        quoted = F.concat(F.lit('\n   "'), compact(r["snippet"], 150), F.lit('"'))
        return F.concat(number, F.when(F.length(F.trim(r["snippet"])) > 20, quoted).otherwise(F.lit("")), F.lit("\n"))

    rows = F.array_sort(F.collect_list(F.struct("rank", "head", "snippet")))
    return lines.groupBy("query_id").agg(rows.alias("r")).select(
        "query_id", F.concat(F.lit("**Reference Sources:**\n\n"), F.array_join(F.transform("r", entry), "\n")).alias("citations")
    )


def context_blocks(hits: DataFrame) -> DataFrame:
    """'Reference r (Score: s):' and text for each hit of a query, in rank order."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "score", "text")))
    part = lambda r: F.concat(F.format_string("Reference %d (Score: %.3f):\n", r["rank"], r["score"]), r["text"], F.lit("\n"))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(rows, part), "\n").alias("context"))


def prompts(queries: DataFrame, contexts: DataFrame) -> DataFrame:
    """Report prompt per query: queries(query_id, text, credit_code, credit_name, credit_type, points_min, points_max)."""
    g = F.col
    text = F.concat_ws(
        "\n",
        F.lit("Write a certification report for the credit below from the references given."),
        F.concat(F.lit("Credit: "), F.coalesce(g("credit_code"), F.lit("Unknown")), F.lit(" "), F.coalesce(g("credit_name"), F.lit("Unknown"))),
        F.concat(F.lit("Type: "), F.coalesce(g("credit_type"), F.lit("Credit"))),
        F.concat(F.lit("Points: "), F.coalesce(g("points_min"), F.lit(0)).cast("string"), F.lit("-"), F.coalesce(g("points_max"), F.lit(0)).cast("string")),
        F.lit(""),
        F.concat(F.lit("Query: "), g("text")),
        F.lit(""),
        F.lit("References:"),
        F.coalesce(g("context"), F.lit("")),
    )
    return queries.join(contexts, "query_id", "left").select("query_id", text.alias("prompt"))


def key_facts(hits: DataFrame) -> DataFrame:
    """Primary credit, intent, requirement lines, key sentences and related credits per query.

    hits(query_id, rank, text, credit_code, credit_name, category); the top three texts are read.
    """
    name = F.coalesce(or_none(F.col("credit_code")), or_none(F.col("credit_name")))
    rows = F.array_sort(F.collect_list(F.struct("rank", name.alias("credit"), "category", "text")))
    packed = hits.groupBy("query_id").agg(rows.alias("r")).withColumn("top", F.slice("r", 1, 3))

    def intent(t: Column) -> Column:
        at = F.instr(F.lower(t), F.lit("intent:"))
        line = F.get(F.split(F.substr(t, at, F.length(t)), "\n"), F.lit(0))
        return F.when(at > 0, or_none(F.trim(F.replace(line, F.lit("Intent:"), F.lit("")))))

    def requirement_lines(t: Column) -> Column:
        lines = F.transform(F.split(t, "\n"), lambda s: F.trim(s))
        kept = F.filter(lines, lambda s: (s != "") & (F.contains(F.lower(s), F.lit("requirement")) | F.startswith(s, F.lit("-"))))
        return F.when(F.contains(F.lower(t), F.lit("requirement")), F.slice(kept, 1, 3)).otherwise(F.array().cast("array<string>"))

    def key_sentences(t: Column) -> Column:
        ss = F.filter(F.transform(F.split(t, r"\."), lambda s: F.trim(s)), lambda s: F.length(s) > 30)
        return F.when(F.length(t) > 50, F.slice(ss, 1, 2)).otherwise(F.array().cast("array<string>"))

    first = F.get("r", F.lit(0))
    return packed.select(
        "query_id", first["credit"].alias("primary_credit"), first["category"].alias("category"),
        F.get(F.filter(F.transform("top", lambda x: intent(x["text"])), lambda s: s.isNotNull()), F.lit(0)).alias("intent"),
        F.flatten(F.transform("top", lambda x: requirement_lines(x["text"]))).alias("requirements"),
        F.flatten(F.transform("top", lambda x: key_sentences(x["text"]))).alias("key_points"),
        F.array_distinct(
            F.filter(
                F.transform(F.slice("r", F.lit(2), F.size("r")), lambda x: x["credit"]),
                lambda c: c.isNotNull() & ~c.eqNullSafe(first["credit"]),
            )
        ).alias("related_credits"),
    )


# ---- fixed values: template defaults ------------------------------------------------------------
DEFAULT_INTENT = "Document how the project meets the stated intent of this credit."
DEFAULT_REQUIREMENT = "List the quantitative and qualitative requirements for this credit."
DEFAULT_DOCUMENT = "Attach narrative description, calculations, and any required forms."
DEFAULT_NOTES = "Provide calculations that demonstrate compliance; cite baselines and assumptions."
CHECKS = ["Confirm prerequisite alignment.", "Highlight uncertainties and assumptions.", "Map each evidence item to a citation."]
# -------------------------------------------------------------------------------------------------


def fill_template(df: DataFrame) -> DataFrame:
    """Template columns from credit_code, credit_name, intent, requirements, documentation."""
    none = F.array().cast("array<string>")

    def items(c: str, default: str) -> Column:
        return bind(F.coalesce(F.col(c), none), lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(F.lit(default))))

    title = F.concat(
        F.coalesce("credit_code", F.lit("LEED Credit")), F.lit(" – "), F.coalesce("credit_name", F.lit("Unspecified"))
    )
    return df.withColumns(
        {
            "title": title,
            "intent": F.coalesce(or_none(F.col("intent")), F.lit(DEFAULT_INTENT)),
            "requirements": items("requirements", DEFAULT_REQUIREMENT),
            "documentation": items("documentation", DEFAULT_DOCUMENT),
            "calculation_notes": F.lit(DEFAULT_NOTES),
            "qa": F.array(*[F.lit(c) for c in CHECKS]),
        }
    )


def templates(identifiers: DataFrame, credits: DataFrame, load_order: list[str], cutoff: float = 0.6) -> DataFrame:
    """Filled template per identifier: exact key, else the most similar key, else the defaults."""
    cols = ["credit_code", "credit_name", "intent", "requirements", "documentation"]
    book = template_dictionary(credits, load_order).select("key", *cols).withColumn("matched", F.col("key"))
    exact = exact_templates(identifiers, book)
    missing = exact.filter(F.col("matched").isNull()).select("identifier", F.col("key").alias("name"))
    near = nearest_names(missing, book, cutoff).select("name", F.col("key").alias("near_key"))
    fuzzy = (
        missing.join(near, "name", "left")
        .join(book.withColumnRenamed("key", "near_key"), "near_key", "left")
        .select("identifier", *cols, "matched", F.when(F.col("matched").isNotNull(), "similar").otherwise("default").alias("how"))
    )
    hit = exact.filter(F.col("matched").isNotNull()).select("identifier", *cols, "matched", F.lit("exact").alias("how"))
    return fill_template(hit.unionByName(fuzzy))
