"""Credit records from lines of text: a section state machine written as running values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import credits as cr
from ..functions.text import (
    BULLET, OPTION_HEADER, POINTS_LINE, RATING_LINE, SECTION_LINES, clean_line, first_match, parse_points, strip_bullet,
)
from ..session import written
from .skew import running

# ---- fixed values: category lines and header lines --------------------------------------------
CATEGORIES = [
    ("LOCATION AND TRANSPORTATION (LT)", r"(?i)^LOCATION AND TRANSPORTATION\s*\(LT\)$"),
    ("INTEGRATIVE PROCESS (IP)", r"(?i)^INTEGRATIVE PROCESS\s*\(IP\)$"),
    ("SUSTAINABLE SITES (SS)", r"(?i)^SUSTAINABLE SITES\s*\(SS\)$"),
    ("WATER EFFICIENCY (WE)", r"(?i)^WATER EFFICIENCY\s*\(WE\)$"),
    ("ENERGY AND ATMOSPHERE (EA)", r"(?i)^ENERGY AND ATMOSPHERE\s*\(EA\)$"),
    ("MATERIALS AND RESOURCES (MR)", r"(?i)^MATERIALS AND RESOURCES\s*\(MR\)$"),
    ("INDOOR ENVIRONMENTAL QUALITY (EQ)", r"(?i)^INDOOR ENVIRONMENTAL QUALITY\s*\(EQ\)$"),
    ("INNOVATION (IN)", r"(?i)^INNOVATION\s*\(IN\)$"),
    ("REGIONAL PRIORITY (RP)", r"(?i)^REGIONAL PRIORITY\s*\(RP\)$"),
    ("APPENDICES", r"(?i)^APPENDICES$"),
]
CODE_HEADER = r"(?i)^(LT|IP|SS|WE|EA|MR|EQ|IN|RP)\s+(Credit|Prerequisite)\s*:?\s*(.+)$"
BARE_HEADER = r"(?i)^(Credit|Prerequisite)\s*:?\s*(.+)$"
NUMBERED_HEADER = r"(?i)^([A-Z]{2})\s*([0-9]+)\s*(Credit|Prerequisite)\s*:?\s*(.+)$"
# -----------------------------------------------------------------------------------------------

# parser section -> credit field that collects its lines
LINE_FIELDS = {
    "applicability": "applicability", "documentation": "documentation", "equations": "equations",
    "related": "related_credits", "exemplary": "exemplary_performance", "referenced": "referenced_standards",
    "step_by_step": "step_by_step", "guidance": "guidance",
}


def _header(line: Column) -> Column:
    def parts(pattern: str, code: int | None, kind: int, name: int) -> Column:
        return F.when(
            line.rlike(pattern),
            F.struct(
                (F.upper(F.regexp_extract(line, pattern, code)) if code else F.lit(None).cast("string")).alias("code"),
                F.regexp_extract(line, pattern, kind).alias("kind"),
                F.regexp_extract(line, pattern, name).alias("name"),
            ),
        )

    found = F.coalesce(parts(CODE_HEADER, 1, 2, 3), parts(BARE_HEADER, None, 1, 2), parts(NUMBERED_HEADER, 1, 3, 4))
    return F.when(line.rlike(r"(?i)^(?:[A-Z]{2}\s*[0-9]*\s*)?(?:Credit|Prerequisite)"), found)


def classified_lines(lines: DataFrame) -> DataFrame:
    """lines(doc_id, page, line_no, line) with credit number, section and option of each line."""
    doc, order = ["doc_id"], ["page", "line_no"]
    blocks = [F.col("page"), F.floor(F.col("page") / 1024)]
    line = F.trim(F.regexp_replace("line", r"(?U)^\s+|\s+$", ""))
    flat = lines.select("doc_id", "page", "line_no", line.alias("line")).select(
        "*", _header(F.col("line")).alias("head"), first_match(F.col("line"), CATEGORIES).alias("cat")
    )
    is_head = F.col("head").isNotNull()
    plain = flat.withColumn(
        "marker", F.when(~is_head & ~F.col("line").rlike(POINTS_LINE) & ~F.col("line").rlike(RATING_LINE),
                         first_match(F.col("line"), SECTION_LINES))
    )
    plain = written(plain)  # patterns are matched once; the steps below read a few columns each
    first = running(
        plain, doc, blocks, order,
        sums={"credit_no": is_head.cast("int"), "section_no": F.col("marker").isNotNull().cast("int")},
        lasts={
            "category": F.col("cat"),
            "state": F.when(is_head, F.lit("")).otherwise(F.col("marker")),
        },
    ).filter("credit_no > 0")
    is_head = F.col("head").isNotNull()
    kind = (
        F.when(is_head, "header")
        .when(F.col("line").rlike(POINTS_LINE), "points")
        .when(F.col("line").rlike(RATING_LINE), "rating")
        .when(F.col("marker").isNotNull(), "section")
        .when((F.col("state") == "requirements") & F.col("line").rlike(OPTION_HEADER), "option")
        .otherwise("content")
    )
    staged = written(first.withColumn("kind", kind))
    # an open option stays open until the next credit, whatever sections come in between
    def place(page: Column, line_no: Column) -> Column:
        return F.struct(page.cast("long").alias("page"), line_no.cast("long").alias("line_no"))

    opened = F.when(is_head, place(F.lit(0), F.lit(0))).when(
        F.col("kind") == "option", place(F.col("page"), F.col("line_no"))
    )
    second = running(staged, doc, blocks, order, lasts={"option_at": opened})
    in_page = Window.partitionBy("doc_id", "page").orderBy("line_no")
    second = second.withColumn("ends_page", F.lead("line_no").over(in_page).isNull())
    return second.withColumn("option_at", F.when(F.col("option_at.page") > 0, F.col("option_at"))).select(
        "doc_id", "page", "line_no", "line", "kind", "head", "category", "credit_no", "section_no", "ends_page",
        F.nullif("state", F.lit("")).alias("section"), "option_at",
    )


def parse_credits(lines: DataFrame) -> DataFrame:
    """Credit records of lines(doc_id, page >= 1, line_no, line), one row per (doc_id, credit_no)."""
    c = classified_lines(lines)
    at = F.struct("page", "line_no")
    content = F.col("kind") == "content"
    sec = F.col("section")
    bullet = strip_bullet(F.col("line"))

    def ordered(cond: Column, value: Column) -> Column:
        rows = F.array_sort(F.collect_list(F.when(cond, F.struct("page", "line_no", value.alias("v")))))
        return F.transform(rows, lambda r: r["v"])

    collected = [
        ordered(
            content & (sec == name) & (F.col("line").rlike(BULLET) if name == "applicability" else F.lit(True)),
            bullet if name in ("applicability", "documentation") else F.col("line"),
        ).alias(field)
        for name, field in LINE_FIELDS.items()
    ]
    in_req = content & (sec == "requirements")
    option_rows = F.array_sort(
        F.collect_list(
            F.when(
                (F.col("kind") == "option") | (in_req & F.col("option_at").isNotNull()),
                F.struct("option_at", "page", "line_no", (F.col("kind") == "option").alias("is_head"),
                         F.when(F.col("kind") == "option", F.col("line")).otherwise(bullet).alias("v")),
            )
        )
    )
    intent_rows = F.array_sort(
        F.collect_list(F.when(content & (sec == "intent"), F.struct("section_no", "page", "line_no", F.col("line").alias("v"))))
    )
    grouped = c.groupBy("doc_id", "credit_no").agg(
        F.max(F.when(F.col("kind") == "header", F.struct("head.*", F.col("category").alias("category"), "page"))).alias("h"),
        F.max(F.when(F.col("kind") == "points", F.struct(at.alias("at"), F.col("line").alias("v")))).getField("v").alias("points_raw"),
        F.max(F.when(F.col("kind") == "rating", F.struct(at.alias("at"), F.col("line").alias("v")))).getField("v").alias("rating_system"),
        ordered(in_req & F.col("option_at").isNull(), bullet).alias("requirements"),
        *collected,
        option_rows.alias("option_rows"),
        intent_rows.alias("intent_rows"),
        # pages: the start page, and every page at whose end the credit is still open
        F.collect_set(F.when(F.col("ends_page") | (F.col("kind") == "header"), F.col("page"))).alias("pages"),
    )
    last_block = F.array_max(F.transform("intent_rows", lambda r: r["section_no"]))
    intent = F.when(
        F.size("intent_rows") > 0,
        clean_line(F.array_join(F.transform(
            F.filter("intent_rows", lambda r: r["section_no"] == last_block), lambda r: r["v"]), " ")),
    )
    heads = F.filter("option_rows", lambda r: r["is_head"])
    options = F.transform(
        heads,
        lambda h: F.struct(
            h["v"].alias("heading"),
            F.transform(
                F.filter("option_rows", lambda r: (r["option_at"] == h["option_at"]) & ~r["is_head"]), lambda r: r["v"]
            ).alias("lines"),
            F.lit(None).cast("int").alias("points"),
        ),
    )
    from_category = F.regexp_extract("h.category", r"\(([^()]*)\)[^()]*$", 1)
    points = parse_points(F.col("points_raw"))
    record = grouped.select(
        "doc_id", "credit_no",
        F.col("h.category").alias("category"),
        F.coalesce(F.col("h.code"), F.nullif(from_category, F.lit(""))).alias("credit_code"),
        clean_line(F.col("h.name")).alias("credit_name"),
        F.when(F.lower("h.kind") == "prerequisite", "Prerequisite").otherwise("Credit").alias("credit_type"),
        intent.alias("intent"), "requirements", options.alias("options"), "documentation", "points_raw",
        points["lo"].alias("points_min"), points["hi"].alias("points_max"),
        *[f for f in LINE_FIELDS.values() if f != "documentation"],
        "rating_system",
        F.array_sort("pages").alias("pages"),
    )
    return with_quality(record)


def with_quality(credits: DataFrame) -> DataFrame:
    """Adds completeness_score and validation_errors."""
    g = F.col
    return credits.withColumns(
        {
            "completeness_score": cr.completeness(
                g("credit_name"), g("credit_code"), g("category"), g("intent"), g("requirements"), g("documentation"),
                g("points_min"), g("related_credits"),
            ),
            "validation_errors": cr.validation_errors(
                g("credit_name"), g("credit_code"), g("category"), g("points_min"), g("points_max"), g("credit_type")
            ),
        }
    )


def extraction_statistics(credits: DataFrame) -> DataFrame:
    """One row of totals; points are summed over credits, not prerequisites."""
    is_pre = F.col("credit_type") == "Prerequisite"
    return credits.agg(
        F.count(F.lit(1)).alias("total_credits"),
        F.count_if(is_pre).alias("prerequisites"),
        F.count_if(~is_pre).alias("credits"),
        F.coalesce(F.sum(F.when(~is_pre, F.col("points_max"))), F.lit(0)).alias("total_points"),
        F.avg("completeness_score").alias("mean_completeness"),
        F.sum(F.size("validation_errors")).alias("n_errors"),
    )


def category_counts(credits: DataFrame) -> DataFrame:
    return credits.filter(F.coalesce(F.col("category"), F.lit("")) != "").groupBy("category").agg(F.count(F.lit(1)).alias("n"))
