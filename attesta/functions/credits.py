"""Credit records: ids, types, validation, text forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind, md5_hex, or_none

# ---- fixed values ---------------------------------------------------------------------------
RATING_SYSTEMS = [
    r"(?i)BD\+C", r"(?i)ID\+C", r"(?i)O\+M", r"(?i)\bND\b",
    r"(?i)Core and Shell", r"(?i)New Construction", r"(?i)Existing Buildings",
]
PROJECT_TYPES = [
    ("NC", r"(?i)\bNC\b|\bNew Construction\b"),
    ("CS", r"(?i)\bCS\b|\bCore and Shell\b"),
    ("Schools", r"(?i)\bSchools?\b"),
    ("Retail", r"(?i)\bRetail\b"),
    ("Healthcare", r"(?i)\bHealthcare\b"),
    ("Data Centers", r"(?i)\bData Centers?\b"),
    ("Warehouses", r"(?i)\bWarehouses?\b"),
    ("Hospitality", r"(?i)\bHospitality\b"),
]
SECTION_PRIORITY = {
    "requirements": 10, "intent": 9, "documentation": 8, "calc": 7,
    "thresholds": 6, "definitions": 5, "unknown": 1,
}
# ---------------------------------------------------------------------------------------------


def credit_id(code: Column, kind: Column, name: Column) -> Column:
    """Stable id such as EA-p2: number from the name, else the code, else a name hash 1..100."""
    prefix = F.when(F.contains(F.lower(kind), F.lit("prerequisite")), "p").otherwise("c")
    number = F.coalesce(
        or_none(F.regexp_extract(name, r"(?i)(?:credit|prerequisite|option)\s+(\d+)", 1)),
        or_none(F.regexp_extract(code, r"(\d+)", 1)),
        F.when(
            or_none(name).isNotNull(),
            (F.conv(md5_hex(name, 4), 16, 10).cast("int") % 100 + 1).cast("string"),
        ),
        F.lit("1"),
    )
    return F.when(or_none(code).isNull(), "UNKNOWN").otherwise(F.concat(code, F.lit("-"), prefix, number))


def rating_system(text: Column, given: Column) -> Column:
    return F.coalesce(or_none(given), *[or_none(F.regexp_extract(text, p, 0)) for p in RATING_SYSTEMS])


def project_types(text: Column, applicability: Column) -> Column:
    """Types named by the applicability items (item order, then type order), then by the text."""

    def hits(c: Column) -> Column:
        return F.array_compact(F.array(*[F.when(c.rlike(p), F.lit(t)) for t, p in PROJECT_TYPES]))

    none = F.array().cast("array<string>")
    found = F.array_distinct(
        F.concat(
            F.flatten(F.transform(F.coalesce(applicability, none), hits)),
            F.when(text.isNotNull(), hits(text)).otherwise(none),
        )
    )
    return bind(found, lambda f: F.when(F.size(f) > 0, f).otherwise(F.array(F.lit("NC"))))


def version_date(version: Column, effective: Column, version_day: Column) -> Column:
    inside = or_none(F.regexp_extract(version, r"\((\d{4}-\d{2}-\d{2})\)", 1))
    return F.when(or_none(version).isNotNull(), F.try_to_date(F.coalesce(inside, effective, version_day)))


def doc_type(kind: Column, source_file: Column) -> Column:
    k, f = F.lower(kind), F.lower(source_file)
    return (
        F.when(F.contains(k, F.lit("prerequisite")), "prerequisite")
        .when(F.contains(k, F.lit("credit")), "credit")
        .when(F.contains(f, F.lit("form")), "form")
        .when(F.contains(f, F.lit("guide")), "guide")
        .when(F.contains(f, F.lit("faq")), "faq")
        .when(F.contains(f, F.lit("addenda")) | F.contains(f, F.lit("addendum")), "addenda")
        .otherwise("credit")
    )


def source_category(path: Column) -> Column:
    """Corpus source of a file by its name; first rule wins."""
    p = F.lower(path)

    def has(*names):
        out = F.contains(p, F.lit(names[0]))
        for n in names[1:]:
            out = out | F.contains(p, F.lit(n))
        return out

    return (
        F.when(has("leed") & has("guide", "rating"), "guide")
        .when(has("form", "sample"), "forms")
        .when(has("calculator", "calc"), "calculators")
        .when(has("project", "sea"), "projects")
        .when(has("research", "proposal"), "research")
        .otherwise("credits")
    )


def _filled(c: Column) -> Column:
    return F.coalesce(F.size(c) > 0, F.lit(False))


# ---- fixed values: texts of the validation --------------------------------------------------------
NO_NAME, NO_CODE = "Missing credit name", "Missing credit code"
BAD_POINTS, BAD_TYPE = "Invalid points range", "Invalid credit type"
# -------------------------------------------------------------------------------------------------


def validation_errors(name: Column, code: Column, category: Column, lo: Column, hi: Column, kind: Column) -> Column:
    """Points are compared only when both are present and non-zero."""
    return F.array_compact(
        F.array(
            F.when(or_none(name).isNull(), F.lit(NO_NAME)),
            F.when(or_none(code).isNull() & or_none(category).isNotNull(), F.lit(NO_CODE)),
            F.when((lo != 0) & (hi != 0) & (lo > hi), F.lit(BAD_POINTS)),
            F.when(~F.coalesce(kind.isin("Credit", "Prerequisite"), F.lit(False)), F.lit(BAD_TYPE)),
        )
    )


def completeness(name, code, category, intent, requirements, documentation, points_min, related) -> Column:
    """Share of the eight expected fields that are present."""
    flags = [
        or_none(name).isNotNull(), or_none(code).isNotNull(), or_none(category).isNotNull(),
        or_none(intent).isNotNull(), _filled(requirements), _filled(documentation),
        points_min.isNotNull(), _filled(related),
    ]
    return sum((f.cast("int") for f in flags), F.lit(0)) / F.lit(8.0)


def section_priority(section: Column) -> Column:
    out = F.when(or_none(section).isNull(), F.lit(0))
    for name, p in SECTION_PRIORITY.items():
        out = out.when(F.lower(section) == name, F.lit(p))
    return out.otherwise(F.lit(1))


def bullets(title: str, items: Column) -> Column:
    """'Title:' and one '- item' line each; null when the list is empty."""
    return F.when(_filled(items), F.concat(F.lit(title + "\n- "), F.array_join(items, "\n- ")))


def joined_text(credit: dict[str, Column]) -> Column:
    """One text per credit: header, then blocks separated by blank lines."""
    g = credit.get
    blocks = [
        F.concat(F.lit("Intent: "), or_none(g("intent"))),
        bullets("Requirements:", g("requirements")),
        F.when(
            _filled(g("options")),
            F.array_join(
                F.transform(
                    g("options"), lambda o: F.concat(o["heading"], F.lit("\n- "), F.array_join(o["lines"], "\n- "))
                ),
                "\n\n",
            ),
        ),
        bullets("Submittals:", g("documentation")),
        bullets("Applicability:", g("applicability")),
        F.when(_filled(g("equations")), F.concat(F.lit("Equations:\n"), F.array_join(g("equations"), "\n"))),
        bullets("Related Credits:", g("related_credits")),
        bullets("Exemplary Performance:", g("exemplary_performance")),
        bullets("Referenced Standards:", g("referenced_standards")),
        bullets("Step-by-Step:", g("step_by_step")),
        bullets("Guidance:", g("guidance")),
    ]
    return F.concat(header(credit), F.lit("\n"), F.concat_ws("\n\n", *blocks))


def search_text(credit: dict[str, Column]) -> Column:
    """Shorter text form: one line per item, missing names replaced by 'Unknown'."""
    g = credit.get

    def lines(title: str, items: Column) -> Column:
        return F.when(
            _filled(items), F.concat(F.lit(title + "\n"), F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n"))
        )

    options = F.when(
        _filled(g("options")),
        F.array_join(
            F.transform(
                g("options"),
                lambda o: F.concat_ws(
                    "\n",
                    F.concat(F.coalesce(o["heading"], F.lit("Option")), F.lit(":")),
                    or_none(F.array_join(F.transform(o["lines"], lambda x: F.concat(F.lit("- "), x)), "\n")),
                ),
            ),
            "\n",
        ),
    )
    head = F.concat(
        F.coalesce(g("credit_code"), F.lit("Unknown")), F.lit(" "), F.coalesce(g("credit_type"), F.lit("Credit")),
        F.lit(": "), F.coalesce(g("credit_name"), F.lit("Unknown Credit")),
    )
    return F.concat_ws(
        "\n", head, F.concat(F.lit("Intent: "), or_none(g("intent"))), lines("Requirements:", g("requirements")),
        options, lines("Submittals:", g("documentation")), lines("Applicability:", g("applicability")),
    )


def header(credit: dict[str, Column]) -> Column:
    def shown(name: str) -> Column:
        return F.coalesce(credit[name], F.lit("None"))

    return F.concat(shown("credit_code"), F.lit(" "), shown("credit_type"), F.lit(": "), shown("credit_name"))
