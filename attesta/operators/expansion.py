"""Rule-based query expansion, evaluated inside each query row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind

# ---- fixed values: vocabulary and query texts of the expansion rules ---------------------------
CATEGORY_CODES = {
    "energy": ["EA", "ENERGY AND ATMOSPHERE"],
    "water": ["WE", "WATER EFFICIENCY"],
    "materials": ["MR", "MATERIALS AND RESOURCES"],
    "indoor": ["EQ", "INDOOR ENVIRONMENTAL QUALITY"],
    "site": ["SS", "SUSTAINABLE SITES"],
    "location": ["LT", "LOCATION AND TRANSPORTATION"],
    "innovation": ["IN", "INNOVATION"],
    "regional": ["RP", "REGIONAL PRIORITY"],
}
TERM_QUERIES = {
    "energy efficiency": ["EA Minimum Energy Performance", "EA Optimize Energy Performance"],
    "energy": ["EA credit requirements", "energy performance ASHRAE 90.1"],
    "water": ["WE water use reduction", "WE outdoor water use reduction"],
    "materials": ["MR building life-cycle impact reduction", "MR building product disclosure"],
    "requirements": ["prerequisite requirements", "credit requirements"],
    "efficiency": ["energy efficiency", "water efficiency"],
}
CATEGORY_QUERIES = {
    "EA": [
        "EA Minimum Energy Performance requirements LEED v4.1 BD+C",
        "EA Optimize Energy Performance requirements thresholds",
        "energy performance prerequisite baseline ASHRAE Appendix G",
    ],
    "WE": ["WE water use reduction requirements LEED v4.1", "WE outdoor water use reduction thresholds"],
    "MR": ["MR building product disclosure requirements", "MR construction waste management requirements"],
}
CODES = ["EA", "WE", "MR", "EQ", "SS", "LT", "IN", "RP", "IP"]
# only the first two synonyms of a word are ever used
SYNONYMS = {
    "water": ["water efficiency", "water use"],
    "energy": ["energy efficiency", "energy performance"],
    "materials": ["materials", "resources"],
    "indoor": ["indoor air quality", "IAQ"],
    "site": ["sustainable sites", "site selection"],
    "efficiency": ["efficiency", "performance"],
    "requirements": ["requirements", "prerequisites"],
    "credits": ["credits", "points"],
    "we": ["water efficiency", "WE credits"],
    "ea": ["energy and atmosphere", "EA credits"],
    "mr": ["materials and resources", "MR credits"],
    "eq": ["indoor environmental quality", "EQ credits"],
    "ss": ["sustainable sites", "SS credits"],
    "lt": ["location and transportation", "LT credits"],
}
# ------------------------------------------------------------------------------------------------


def _rules(table: dict[str, list[str]]) -> Column:
    return F.array(
        *[F.struct(F.lit(k).alias("key"), F.array(*[F.lit(v) for v in vs]).alias("out")) for k, vs in table.items()]
    )


def _has(low: Column, *needles: str) -> Column:
    out = F.contains(low, F.lit(needles[0]))
    for n in needles[1:]:
        out = out | F.contains(low, F.lit(n))
    return out


def _matching(table: dict[str, list[str]], low: Column) -> Column:
    """Rules whose key occurs in the lower-cased query, in rule order."""
    return F.filter(_rules(table), lambda r: F.contains(low, r["key"]))


def _outputs(rules: Column) -> Column:
    return F.flatten(F.transform(rules, lambda r: r["out"]))


def _queries_of(code: Column) -> Column:
    """Query texts of a category code or category name."""
    out = F.array().cast("array<string>")
    for short, texts in CATEGORY_QUERIES.items():
        name = next(n for c, n in CATEGORY_CODES.values() if c == short)
        out = F.when(code.isin(short, name), F.array(*[F.lit(t) for t in texts])).otherwise(out)
    return out


def query_features(queries: DataFrame, text: str = "text") -> DataFrame:
    """Adds categories, codes, terms (arrays) and the three section flags."""
    low = F.lower(text)
    codes = F.filter(F.regexp_extract_all(text, F.lit(r"(?U)\b([A-Z]{1,2})\b"), F.lit(1)), lambda c: c.isin(CODES))
    return queries.withColumns(
        {
            "categories": _outputs(_matching(CATEGORY_CODES, low)),
            "codes": codes,
            "terms": F.transform(_matching(TERM_QUERIES, low), lambda r: r["key"]),
            "has_requirements": _has(low, "requirement", "prerequisite"),
            "has_thresholds": _has(low, "threshold", "point", "score"),
            "has_documentation": _has(low, "documentation", "submittal", "evidence"),
        }
    )


def sub_queries(queries: DataFrame, text: str = "text", max_subqueries: int = 6) -> DataFrame:
    """Adds `sub_queries`: at most `max_subqueries` distinct texts in rule order."""
    f = query_features(queries.withColumn(text, F.trim(text)), text)
    base, low = F.col(text), F.lower(text)
    req = F.col("has_requirements")
    none = F.array().cast("array<string>")

    def said(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    of_codes = F.flatten(
        F.transform(
            F.slice("codes", 1, 3),
            lambda c: F.when(
                req, F.array(said(c, " prerequisite requirements LEED v4.1"), said(c, " credit requirements LEED v4.1"))
            ).otherwise(F.array(said(c, " credit LEED v4.1 BD+C"), said(c, " requirements thresholds"))),
        )
    )
    of_categories = F.flatten(F.transform(F.slice("categories", 1, 2), _queries_of))
    by_credit = F.when(F.size("codes") > 0, of_codes).otherwise(of_categories)
    term_texts = _outputs(F.slice(_matching(TERM_QUERIES, low), 1, 3))
    by_term = F.when(
        req,
        F.transform(
            F.filter(term_texts, lambda t: ~F.contains(F.lower(t), F.lit("requirement"))),
            lambda t: said(t, " requirements LEED v4.1"),
        ),
    ).otherwise(F.transform(term_texts, lambda t: said(t, " LEED v4.1 BD+C")))
    by_section = F.array_compact(
        F.array(
            F.when(req, said(base, " prerequisite requirements")),
            F.when(req, said(base, " credit requirements")),
            F.when(F.col("has_thresholds"), said(base, " thresholds points")),
            F.when(F.col("has_documentation"), said(base, " documentation submittals")),
        )
    )
    own = F.when(~F.contains(low, F.lit("leed")), F.array(said(base, " LEED v4.1 BD+C"))).otherwise(none)

    def distinct(all_q: Column) -> Column:
        keys = F.transform(all_q, lambda q: F.lower(F.trim(q)))
        return bind(keys, lambda ks: F.filter(all_q, lambda q, i: F.array_position(ks, F.get(ks, i)) == i + 1))

    everything = bind(F.concat(by_credit, by_term, by_section, own), distinct)
    return f.withColumn(
        "sub_queries",
        F.when(base == "", F.array(base)).otherwise(F.slice(everything, 1, max_subqueries)),
    )


def expand_queries(queries: DataFrame, text: str = "text", max_subqueries: int = 6, llm=None) -> DataFrame:
    """(query_id, sub_no, sub_query): one row per generated query.

    `llm` may be a Column -> Column function giving an array of queries; without it the rules apply.
    """
    q = (
        queries.withColumn("sub_queries", F.slice(llm(F.col(text)), 1, max_subqueries))
        if llm
        else sub_queries(queries, text, max_subqueries)
    )
    return q.select("query_id", F.posexplode("sub_queries").alias("sub_no", "sub_query")).withColumn(
        "sub_no", F.col("sub_no") + 1
    )


def search_queries(queries: DataFrame, text: str = "text", max_subqueries: int = 6) -> DataFrame:
    """Queries as searched: the expansion if it gives more than one text, else the query itself."""
    used = F.when(F.size("sub_queries") > 1, F.col("sub_queries")).otherwise(F.array(F.col(text)))
    keep = [c for c in queries.columns if c != text]
    return sub_queries(queries, text, max_subqueries).select(
        *keep, F.posexplode(used).alias("sub_no", "sub_query")
    ).withColumn("sub_no", F.col("sub_no") + 1)


def with_domain_word(c: Column, word: str = "LEED") -> Column:
    t = F.trim(c)
    return F.when(F.contains(F.lower(t), F.lit(word.lower())), t).otherwise(F.concat(F.lit(word + " "), t))


def with_synonyms(c: Column) -> Column:
    """Query plus synonyms of the words it contains: four distinct terms at most, in rule order."""
    terms = F.array_distinct(F.slice(F.concat(F.array(c), _outputs(_matching(SYNONYMS, F.lower(c)))), 1, 4))
    joined = F.array_join(terms, " ")
    return F.when(F.length(joined) > F.length(c), joined).otherwise(c)
