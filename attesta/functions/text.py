"""Text columns: tokens, compaction, keys, line classes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# (?U): \w and \s must be Unicode-aware, or accented words fall apart.
TOKEN = r"(?U)[\w-]{2,}"
SPACES = r"(?U)[\s\x1c-\x1f]+"


def or_none(c: Column) -> Column:
    """Empty strings count as missing."""
    return F.nullif(c, F.lit(""))


def words(c: Column) -> Column:
    return F.filter(F.split(c, SPACES), lambda w: w != "")


def tokens(c: Column) -> Column:
    """Lower-cased words of two or more characters; hyphens stay inside words."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0))


def bind(value: Column, body) -> Column:
    """Evaluate `value` once and use it several times inside `body`."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def value_counts(arr: Column, key: str = "term") -> Column:
    """array<T> -> array<struct<key: T, n: int>>, by sorting inside the row: no shuffle."""

    def runs(s: Column) -> Column:
        starts = F.filter(
            F.transform(s, lambda x, i: F.when((i == 0) | (x != F.get(s, i - 1)), i)),
            lambda p: p.isNotNull(),
        )
        return bind(
            starts,
            lambda st: F.transform(
                st,
                lambda p, j: F.struct(
                    F.get(s, p).alias(key),
                    (F.coalesce(F.get(st, j + 1), F.size(s)) - p).alias("n"),
                ),
            ),
        )

    return bind(F.sort_array(arr), runs)


def md5_hex(c: Column, n: int) -> Column:
    return F.substring(F.md5(c.cast("binary")), 1, n)


def md5_bucket(c: Column, buckets: int) -> Column:
    """Stable bucket 0..buckets-1 from the first four hex digits (at most 65,536 buckets)."""
    return F.pmod(F.conv(md5_hex(c, 4), 16, 10).cast("int"), F.lit(buckets))


def compact(c: Column, limit: int = 360) -> Column:
    """Squeeze whitespace; cut to `limit` characters, the last three being dots."""
    squeezed = F.array_join(words(F.coalesce(c, F.lit(""))), " ")
    return bind(
        squeezed,
        lambda s: F.when(F.length(s) <= limit, s).otherwise(
            F.concat(F.substring(s, 1, limit - 3), F.lit("..."))
        ),
    )


def clean_line(c: Column) -> Column:
    return F.array_join(words(F.coalesce(c, F.lit(""))), " ")


def contains_any(c: Column, needles: list[str]) -> Column:
    """Substring match (not whole words) on the lower-cased text."""
    low = F.lower(c)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(n)) for n in needles])


def sentences(c: Column) -> Column:
    """Split after ., ! or ? followed by white space; trimmed."""
    return F.transform(F.split(c, r"(?U)[.!?]\s+"), lambda s: F.trim(F.regexp_replace(s, r"(?U)^\s+|\s+$", "")))


def dot_sentences(c: Column) -> Column:
    return F.transform(F.split(c, r"\."), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))


def parse_points(c: Column) -> Column:
    """'3 points' -> (3, 3); '1 - 4 points' -> (1, 4); anything else -> nulls."""
    pat = r"(?i)^(\d+)(\s*-\s*(\d+))?\s*points?$"
    lo = or_none(F.regexp_extract(c, pat, 1)).cast("int")
    hi = or_none(F.regexp_extract(c, pat, 3)).cast("int")
    return F.struct(lo.alias("lo"), F.coalesce(hi, lo).alias("hi"))


# ---- fixed values: line patterns ------------------------------------------------------------
BULLET = r"^[-\x{2022}]\s*(.*)"
OPTION_HEADER = r"(?i)^(Option\s*\d+\.|OR|AND)$"
POINTS_LINE = r"(?i)^(\d+)(\s*-\s*(\d+))?\s*points?$"
RATING_LINE = r"(?i)^(BD\+C.*|ID\+C.*|O\+M.*|ND\b.*)$"
# parser section -> line pattern; first hit wins
SECTION_LINES = [
    ("intent", r"(?i)^Intent:?$"),
    ("requirements", r"(?i)^Requirements?:?$"),
    ("documentation", r"(?i)^(Documentation|Submittals?):?$"),
    ("points", r"(?i)^Points:?$"),
    ("applicability", r"(?i)^(Applicable Rating System|This credit applies to)"),
    ("equations", r"(?i)^(Equations?|Calculations?):?$"),
    ("related", r"(?i)^(Related Credits|Cross-References):?$"),
    ("exemplary", r"(?i)^(Exemplary Performance):?$"),
    ("referenced", r"(?i)^(Referenced Standards|References):?$"),
    ("step_by_step", r"(?i)^(Step-by-Step|Implementation):?$"),
    ("guidance", r"(?i)^(Guidance|Tips|Best Practices):?$"),
]
# chunk section -> line pattern; first hit wins
HEADING_LINES = [
    ("intent", r"(?i)^Intent:?\s*$"),
    ("requirements", r"(?i)^Requirements?:?\s*$"),
    ("documentation", r"(?i)^(Documentation|Submittals?):?\s*$"),
    ("thresholds", r"(?i)^Points:?\s*$"),
    ("definitions", r"(?i)^(Applicable Rating System|This credit applies to|Applicability):?\s*$"),
    ("calc", r"(?i)^(Equations?|Calculations?):?\s*$"),
    ("definitions", r"(?i)^(Related Credits|Cross-References):?\s*$"),
    ("definitions", r"(?i)^(Exemplary Performance):?\s*$"),
    ("definitions", r"(?i)^(Referenced Standards|References):?\s*$"),
    ("calc", r"(?i)^(Step-by-Step|Implementation):?\s*$"),
    ("definitions", r"(?i)^(Guidance|Tips|Best Practices):?\s*$"),
]
# ---------------------------------------------------------------------------------------------


def first_match(c: Column, rules: list[tuple[str, str]]) -> Column:
    """Label of the first rule whose pattern matches, else null. All patterns start with (?i)^.

    One combined pattern sorts out the many lines that match no rule.
    """
    head = "(?i)^"
    any_rule = head + "(?:" + "|".join(p.removeprefix(head) for _, p in rules) + ")"
    return F.when(c.rlike(any_rule), F.coalesce(*[F.when(c.rlike(p), F.lit(label)) for label, p in rules]))


def strip_bullet(c: Column) -> Column:
    return F.when(c.rlike(BULLET), F.regexp_extract(c, BULLET, 1)).otherwise(c)


def chunk_text(c: dict[str, Column]) -> Column:
    """Text with its metadata in front, as it is indexed lexically."""
    parts = ["credit_id", "section", "credit_name", "credit_code", "text"]
    return F.concat_ws(" ", *[or_none(c[p]) for p in parts if p in c])


def result_key(chunk_id, credit_id, section, page_start, page_end, text, rank, score) -> Column:
    """Identity of a hit: chunk id, else credit+section+pages, else text hash, else position."""
    section = F.coalesce(section, F.lit("unknown"))
    by_credit = F.when(
        or_none(credit_id).isNotNull() & (section != "") & page_start.isNotNull(),
        F.concat(
            F.lit("credit:"), credit_id, F.lit("::section:"), section, F.lit("::pages:"),
            page_start.cast("string"), F.lit("-"), F.coalesce(page_end.cast("string"), F.lit("None")),
        ),
    )
    by_text = F.when(or_none(text).isNotNull(), F.concat(F.lit("text_hash:"), F.md5(text.cast("binary"))))
    by_place = F.concat(F.lit("rank:"), rank.cast("string"), F.lit("::score:"), score.cast("string"))
    return F.coalesce(
        F.concat(F.lit("chunk_id:"), or_none(chunk_id.cast("string"))), by_credit, by_text, by_place
    )


def strip_html(c: Column) -> Column:
    """Visible text of an HTML page."""
    s = F.regexp_replace(c, r"(?is)<!--.*?-->", " ")
    s = F.regexp_replace(s, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    s = F.regexp_replace(s, r"(?s)<[^>]*>", " ")
    for entity, char in [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]:
        s = F.replace(s, F.lit(entity), F.lit(char))
    return F.array_join(words(s), " ")


def html_title(c: Column) -> Column:
    return F.trim(F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title>", 1))


def row_text(cells: Column) -> Column:
    """map<string,string> -> 'col: value | col: value', blank cells left out."""
    kept = F.filter(F.map_entries(cells), lambda e: F.length(F.trim(F.coalesce(e["value"], F.lit("")))) > 0)
    return F.array_join(F.transform(kept, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), " | ")


def table_text(page: Column, rows: Column, columns: Column, data: Column) -> Column:
    """A table as text: head line, size line, then one 'Row n:' line per non-empty row."""
    body = F.filter(
        F.transform(
            F.coalesce(data, F.array()),
            lambda r, i: F.when(
                F.size(r) > 0,
                F.concat(
                    F.lit("Row "), (i + 1).cast("string"), F.lit(": "),
                    F.array_join(F.transform(r, lambda x: F.coalesce(x, F.lit(""))), " | "), F.lit("\n"),
                ),
            ),
        ),
        lambda s: s.isNotNull(),
    )
    return F.concat(
        F.lit("Table from page "), F.coalesce(page.cast("string"), F.lit("unknown")), F.lit(":\nRows: "),
        F.coalesce(rows, F.lit(0)).cast("string"), F.lit(", Columns: "),
        F.coalesce(columns, F.lit(0)).cast("string"), F.lit("\n\n"), F.array_join(body, ""),
    )


def display_text(c: Column) -> Column:
    """Catalogue text for display: dot leaders shortened, trailing page number cut, 400 characters."""
    s = F.trim(F.regexp_replace(c, r"\.{4,}", "..."))
    s = F.trim(F.regexp_replace(s, r"\s+\d+\s*$", ""))
    return bind(
        s, lambda t: F.when(F.length(t) > 400, F.concat(F.substring(t, 1, 400), F.lit("..."))).otherwise(t)
    )


def short_name(c: Column) -> Column:
    return F.when(F.length(c) > 120, F.concat(F.substring(c, 1, 116), F.lit("..."))).otherwise(c)


def display_name(code: Column, name: Column, category: Column, text: Column, kind: Column) -> Column:
    code = F.when(code != "None", or_none(code))
    name, category = or_none(name), or_none(category)
    pat = r"^([A-Z]{1,3})\s+(?:Credit|Prerequisite|Prereq)?\s*:?\s*(.+?)(?:\n|$)"
    found = F.when(F.regexp_extract(text, pat, 1) != "None", or_none(F.regexp_extract(text, pat, 1)))
    return F.coalesce(
        F.concat(code, F.lit(": "), name), code, name, category,
        F.concat(found, F.lit(": "), F.trim(F.substring(F.regexp_extract(text, pat, 2), 1, 50))),
        F.concat(kind, F.lit(" Information")),
    )
