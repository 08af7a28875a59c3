"""Credit records: parsing from lines, ids and metadata, section chunks, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import credits as cr
from ..functions.text import display_name, display_text, parse_points, short_name
from ..operators.chunking import credit_sections, credit_summary_chunks
from ..operators.matching import tables_of_credits
from ..operators.parsing import category_counts, classified_lines, extraction_statistics, parse_credits, with_quality
from ..plans.corpus import credit_list, normalize_chunks
from ..session import table
from ..sources.writers import credit_csv_rows, requirement_rows, statistics_rows
from .registry import query

# Every document becomes a page of the book `source`; some of its lines become credit structure,
# by document and line number. The same text runs on both engines.
LINE_RULE = """CASE (doc_id * 5 + i) % 41
  WHEN 0 THEN 'EA Credit: ' || lang || ' number ' || CAST(doc_id AS STRING)
  WHEN 1 THEN 'Intent' WHEN 3 THEN 'Requirements' WHEN 6 THEN 'Option 1.' WHEN 8 THEN '- ' || line WHEN 9 THEN 'OR'
  WHEN 11 THEN 'Submittals' WHEN 12 THEN '- ' || line WHEN 14 THEN 'requirements:' WHEN 17 THEN '3 points' WHEN 18 THEN 'BD+C: New Construction'
  WHEN 19 THEN 'Prerequisite: ' || lang WHEN 20 THEN '1 - 4 points' WHEN 21 THEN 'This credit applies to' WHEN 22 THEN '- Schools' WHEN 24 THEN 'Related Credits'
  WHEN 26 THEN 'WATER EFFICIENCY (WE)' WHEN 27 THEN 'Credit ' || lang WHEN 28 THEN 'Intent:' WHEN 30 THEN 'Guidance' WHEN 32 THEN 'Intent'
  WHEN 34 THEN 'EA7 Prerequisite: ' || lang WHEN 35 THEN 'Requirement' WHEN 37 THEN 'Exemplary Performance' WHEN 38 THEN 'ND plan'
  WHEN 39 THEN 'Equations' ELSE line END"""


def credit_lines(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("i", "line")
    )
    return docs.select(
        F.col("source").alias("doc_id"), (F.col("doc_id") + 1).cast("int").alias("page"), F.col("i").alias("line_no"),
        F.expr(LINE_RULE).alias("line"),
    )


STRIP = r"regexp_replace(line, '^[\s\x0b\x1c-\x1f\x{85}\p{Z}]+|[\s\x0b\x1c-\x1f\x{85}\p{Z}]+$', '', 'g')"
LINES_SQL = f"""
l0 AS (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
l1 AS (SELECT source AS doc_id, (doc_id + 1)::INT AS page, i AS line_no, {LINE_RULE} AS line FROM l0),
l2 AS MATERIALIZED (SELECT doc_id, page, line_no, {STRIP} AS line FROM l1),
l3 AS (SELECT *, regexp_matches(line, '(?i)^((LT|IP|SS|WE|EA|MR|EQ|IN|RP)\\s+)?(Credit|Prerequisite)\\s*:?\\s*(.+)$')
    OR regexp_matches(line, '(?i)^[A-Z]{{2}}\\s*[0-9]+\\s*(Credit|Prerequisite)\\s*:?\\s*(.+)$') AS is_head,
  CASE WHEN line = 'WATER EFFICIENCY (WE)' THEN line END AS cat,
  regexp_matches(line, '(?i)^(\\d+)(\\s*-\\s*(\\d+))?\\s*points?$') AS is_points,
  regexp_matches(line, '(?i)^(BD\\+C.*|ID\\+C.*|O\\+M.*|ND\\b.*)$') AS is_rating FROM l2),
l4 AS (SELECT *, CASE WHEN is_head OR is_points OR is_rating THEN NULL
   WHEN regexp_matches(line, '(?i)^Intent:?$') THEN 'intent' WHEN regexp_matches(line, '(?i)^Requirements?:?$') THEN 'requirements'
   WHEN regexp_matches(line, '(?i)^(Documentation|Submittals?):?$') THEN 'documentation' WHEN regexp_matches(line, '(?i)^(Applicable Rating System|This credit applies to)') THEN 'applicability'
   WHEN regexp_matches(line, '(?i)^Equations?:?$') THEN 'equations' WHEN regexp_matches(line, '(?i)^Related Credits:?$') THEN 'related'
   WHEN regexp_matches(line, '(?i)^Exemplary Performance:?$') THEN 'exemplary' WHEN regexp_matches(line, '(?i)^Guidance:?$') THEN 'guidance' END AS marker FROM l3),
l5 AS (SELECT *, sum(is_head::INT) OVER w AS credit_no, count(marker) OVER w AS section_no, last_value(cat IGNORE NULLS) OVER w AS category,
   last_value(CASE WHEN is_head THEN '' ELSE marker END IGNORE NULLS) OVER w AS state FROM l4
   WINDOW w AS (PARTITION BY doc_id ORDER BY page, line_no ROWS UNBOUNDED PRECEDING)),
l6 AS (SELECT *, CASE WHEN is_head THEN 'header' WHEN is_points THEN 'points' WHEN is_rating THEN 'rating' WHEN marker IS NOT NULL THEN 'section'
   WHEN state = 'requirements' AND regexp_matches(line, '(?i)^(Option\\s*\\d+\\.|OR|AND)$') THEN 'option' ELSE 'content' END AS kind,
   regexp_replace(line, '^[-•]\\s*', '') AS bare FROM l5 WHERE credit_no > 0),
cl AS MATERIALIZED (SELECT *, count(CASE WHEN kind = 'option' THEN 1 END) OVER (PARTITION BY doc_id, credit_no ORDER BY page, line_no ROWS UNBOUNDED PRECEDING) AS opt FROM l6)"""


@query(
    "credit_lines_classified",
    f"WITH {LINES_SQL} SELECT doc_id, page, line_no, kind, credit_no, coalesce(nullif(state, ''), '-') AS section, coalesce(category, '-') AS category, opt > 0 AS in_option FROM cl",
)
def credit_lines_classified(spark, sf):
    c = classified_lines(credit_lines(spark, sf))
    return c.select(
        "doc_id", "page", "line_no", "kind", "credit_no", F.coalesce("section", F.lit("-")).alias("section"),
        F.coalesce("category", F.lit("-")).alias("category"), F.col("option_at").isNotNull().alias("in_option"),
    )


def _agg(cond: str, value: str = "line") -> str:
    return f"string_agg(CASE WHEN {cond} THEN {value} END, ' ~ ' ORDER BY page, line_no)"


PARSE_SQL = f"""{LINES_SQL},
ib AS (SELECT doc_id, credit_no, max(section_no) AS b FROM cl WHERE kind = 'content' AND state = 'intent' GROUP BY ALL),
it AS (SELECT doc_id, credit_no, trim(regexp_replace(string_agg(line, ' ' ORDER BY page, line_no), '\\s+', ' ', 'g')) AS intent FROM cl JOIN ib USING (doc_id, credit_no)
   WHERE kind = 'content' AND state = 'intent' AND section_no = b GROUP BY ALL),
op AS (SELECT doc_id, credit_no, opt, min(CASE WHEN kind = 'option' THEN line END) || ' [' ||
     coalesce(string_agg(CASE WHEN kind = 'content' AND state = 'requirements' THEN bare END, ' ~ ' ORDER BY page, line_no), '') || ']' AS o
   FROM cl WHERE opt > 0 GROUP BY ALL),
ops AS (SELECT doc_id, credit_no, string_agg(o, ' ; ' ORDER BY opt) AS options, count(*) AS n_options FROM op GROUP BY ALL),
pe AS (SELECT doc_id, page, max(credit_no) AS credit_no FROM cl GROUP BY ALL),
pg0 AS (SELECT doc_id, credit_no, page FROM pe UNION SELECT doc_id, credit_no, page FROM cl WHERE kind = 'header'),
pg AS (SELECT doc_id, credit_no, string_agg(page::VARCHAR, ',' ORDER BY page) AS pages FROM pg0 GROUP BY ALL),
cr0 AS (SELECT doc_id, credit_no, max(CASE WHEN kind = 'header' THEN line END) AS h, max(CASE WHEN kind = 'header' THEN category END) AS category,
   arg_max(CASE WHEN kind = 'points' THEN line END, CASE WHEN kind = 'points' THEN page * 100000 + line_no END) AS points_raw,
   arg_max(CASE WHEN kind = 'rating' THEN line END, CASE WHEN kind = 'rating' THEN page * 100000 + line_no END) AS rating_system,
   {_agg("kind = 'content' AND state = 'requirements' AND opt = 0", 'bare')} AS requirements,
   {_agg("kind = 'content' AND state = 'documentation'", 'bare')} AS documentation,
   {_agg("kind = 'content' AND state = 'applicability' AND regexp_matches(line, '^[-•]')", 'bare')} AS applicability,
   {_agg("kind = 'content' AND state = 'related'")} AS related_credits, {_agg("kind = 'content' AND state = 'exemplary'")} AS exemplary,
   {_agg("kind = 'content' AND state = 'guidance'")} AS guidance, {_agg("kind = 'content' AND state = 'equations'")} AS equations FROM cl GROUP BY ALL),
cred AS MATERIALIZED (SELECT doc_id, credit_no, category,
   CASE WHEN h LIKE 'EA%' THEN 'EA' ELSE nullif(regexp_extract(category, '\\(([A-Z]+)\\)', 1), '') END AS credit_code,
   trim(regexp_replace(regexp_replace(h, '(?i)^([A-Z]{{2}}\\s*[0-9]*\\s*)?(Credit|Prerequisite)\\s*:?\\s*', ''), '\\s+', ' ', 'g')) AS credit_name,
   CASE WHEN regexp_matches(h, '(?i)Prerequisite:') THEN 'Prerequisite' ELSE 'Credit' END AS credit_type,
   intent, requirements, options, n_options, documentation, applicability, related_credits, exemplary, guidance, equations, rating_system, pages, points_raw,
   nullif(regexp_extract(points_raw, '^(\\d+)', 1), '')::INT AS points_min,
   coalesce(nullif(regexp_extract(points_raw, '-\\s*(\\d+)', 1), '')::INT, nullif(regexp_extract(points_raw, '^(\\d+)', 1), '')::INT) AS points_max
  FROM cr0 LEFT JOIN it USING (doc_id, credit_no) LEFT JOIN ops USING (doc_id, credit_no) LEFT JOIN pg USING (doc_id, credit_no)),
credq AS MATERIALIZED (SELECT *, (1 + (credit_code IS NOT NULL)::INT + (category IS NOT NULL)::INT + (coalesce(intent, '') <> '')::INT + (requirements IS NOT NULL)::INT
    + (documentation IS NOT NULL)::INT + (points_min IS NOT NULL)::INT + (related_credits IS NOT NULL)::INT) / 8.0::DOUBLE AS completeness_score,
   CASE WHEN credit_code IS NULL AND category IS NOT NULL THEN 'Missing credit code' ELSE '' END AS errors FROM cred)"""

TEXT_FIELDS = ["requirements", "documentation", "applicability", "related_credits", "guidance", "equations"]


@query(
    "credit_parse",
    f"""WITH {PARSE_SQL} SELECT doc_id, credit_no, coalesce(category, '-') AS category, coalesce(credit_code, '-') AS credit_code, credit_name, credit_type,
 coalesce(intent, '-') AS intent, coalesce(options, '') AS options, {', '.join(f"coalesce({f}, '') AS {f}" for f in TEXT_FIELDS)}, coalesce(exemplary, '') AS exemplary,
 coalesce(points_min, -1) AS points_min, coalesce(points_max, -1) AS points_max, coalesce(rating_system, '-') AS rating_system, pages, completeness_score FROM credq""",
)
def credit_parse(spark, sf):
    c = parse_credits(credit_lines(spark, sf))
    dash, minus = F.lit("-"), F.lit(-1)
    options = F.array_join(
        F.transform("options", lambda o: F.concat(o["heading"], F.lit(" ["), F.array_join(o["lines"], " ~ "), F.lit("]"))), " ; "
    )
    return c.select(
        "doc_id", "credit_no", *[F.coalesce(x, dash).alias(x) for x in ("category", "credit_code", "intent", "rating_system")],
        "credit_name", "credit_type", options.alias("options"), *[F.array_join(f, " ~ ").alias(f) for f in TEXT_FIELDS],
        F.array_join("exemplary_performance", " ~ ").alias("exemplary"),
        F.coalesce("points_min", minus).alias("points_min"), F.coalesce("points_max", minus).alias("points_max"),
        F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"), "completeness_score",
    )


@query(
    "extraction_statistics",
    f"""WITH {PARSE_SQL} SELECT count(*) AS total_credits, count(*) FILTER (credit_type = 'Prerequisite') AS prerequisites, count(*) FILTER (credit_type = 'Credit') AS credits,
 coalesce(sum(points_max) FILTER (credit_type = 'Credit'), 0)::BIGINT AS total_points, round(avg(completeness_score), 6) AS mean_completeness,
 count(*) FILTER (errors <> '') AS n_errors FROM credq""",
)
def extraction_statistics_query(spark, sf):
    s = extraction_statistics(parse_credits(credit_lines(spark, sf)))
    return s.withColumn("mean_completeness", F.round("mean_completeness", 6))


@query("category_counts", f"WITH {PARSE_SQL} SELECT category, count(*) AS n FROM credq WHERE category IS NOT NULL GROUP BY ALL")
def category_counts_query(spark, sf):
    return category_counts(parse_credits(credit_lines(spark, sf)))


@query(
    "credits_csv_rows",
    f"""WITH {PARSE_SQL} SELECT coalesce(credit_code, '') AS credit_code, credit_name, coalesce(category, '') AS category, credit_type, coalesce(points_min, -1) AS points_min,
 coalesce(points_max, -1) AS points_max, coalesce(intent, '') AS intent, coalesce(len(string_split(requirements, ' ~ ')), 0)::INT AS requirements_count,
 coalesce(len(string_split(documentation, ' ~ ')), 0)::INT AS documentation_count, completeness_score, errors AS validation_errors, replace(pages, ',', ', ') AS pages FROM credq""",
)
def credits_csv_rows(spark, sf):
    rows = credit_csv_rows(parse_credits(credit_lines(spark, sf)))
    text = {c: F.coalesce(c, F.lit("")) for c in ("credit_code", "category", "intent")}
    return rows.withColumns({**text, **{c: F.coalesce(c, F.lit(-1)) for c in ("points_min", "points_max")}})


@query(
    "requirements_sheet",
    f"""WITH {PARSE_SQL}, r AS (SELECT credit_code, credit_name, string_split(requirements, ' ~ ') AS rs FROM credq WHERE requirements IS NOT NULL)
SELECT coalesce(credit_code, '') AS credit_code, credit_name, generate_subscripts(rs, 1)::INT AS requirement_number, unnest(rs) AS requirement_text FROM r""",
)
def requirements_sheet(spark, sf):
    return requirement_rows(parse_credits(credit_lines(spark, sf))).withColumn("credit_code", F.coalesce("credit_code", F.lit("")))


@query(
    "statistics_sheet",
    f"""WITH {PARSE_SQL}, s AS (SELECT count(*) AS a, count(*) FILTER (credit_type = 'Prerequisite') AS b, count(*) FILTER (credit_type = 'Credit') AS c,
 coalesce(sum(points_max), 0) AS d, round(avg(completeness_score), 6) AS e FROM credq)
SELECT 'Total Credits' AS metric, a::DOUBLE AS value FROM s UNION ALL SELECT 'Prerequisites', b FROM s UNION ALL SELECT 'Credits', c FROM s
UNION ALL SELECT 'Total Points', d FROM s UNION ALL SELECT 'Average Completeness', e FROM s""",
)
def statistics_sheet(spark, sf):
    return statistics_rows(parse_credits(credit_lines(spark, sf))).withColumn("value", F.round("value", 6))


@query(
    "tables_to_credit",
    f"""WITH {PARSE_SQL}, cp AS (SELECT doc_id, credit_no, unnest(string_split(pages, ','))::INT AS page FROM cred),
t AS (SELECT source AS doc_id, (labels.doc_id + 1)::INT AS page, labels.doc_id AS table_id FROM labels JOIN documents USING (doc_id))
SELECT doc_id || '/' || credit_no AS credit_key, string_agg(DISTINCT table_id::VARCHAR, ',' ORDER BY table_id::VARCHAR) AS table_ids FROM cp JOIN t USING (doc_id, page) GROUP BY ALL""",
)
def tables_to_credit(spark, sf):
    """Labelled documents stand for pages that hold a table."""
    credits = parse_credits(credit_lines(spark, sf)).select(
        F.concat_ws("/", "doc_id", F.col("credit_no").cast("string")).alias("credit_key"), "doc_id", "pages"
    )
    tables = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id").select(
        F.col("source").alias("doc_id"), (F.col("doc_id") + 1).cast("int").alias("page"), F.col("doc_id").cast("string").alias("table_id")
    )
    found = tables_of_credits(credits, tables)
    return found.select("credit_key", F.array_join("table_ids", ",").alias("table_ids"))


# A credit record per part, written once for both engines; {L} is the list constructor.
PART_CREDITS = """SELECT p_partkey AS credit_no,
  CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_type END AS category,
  CASE p_size % 6 WHEN 0 THEN NULL WHEN 1 THEN 'EA' WHEN 2 THEN 'WE' WHEN 3 THEN 'MR4' WHEN 4 THEN '' ELSE 'SS' END AS credit_code,
  CASE p_size % 5 WHEN 0 THEN p_name || ' Credit ' || CAST(p_size AS STRING) WHEN 1 THEN NULL WHEN 2 THEN p_name || ' BD+C Indoor' WHEN 3 THEN 'ND ' || p_name ELSE p_name END AS credit_name,
  CASE p_size % 4 WHEN 0 THEN 'Prerequisite' WHEN 3 THEN 'Other' ELSE 'Credit' END AS credit_type,
  CASE p_size % 3 WHEN 0 THEN 'v4.1 (2023-0' || CAST(p_size % 9 + 1 AS STRING) || '-15)' WHEN 1 THEN NULL ELSE 'v4' END AS version,
  CASE WHEN p_size % 11 = 0 THEN 'ID+C' ELSE NULL END AS rating_system,
  CASE p_size % 8 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE 'Reduce ' || p_type || ' use' END AS intent,
  CASE WHEN p_size % 3 = 0 THEN NULL ELSE {L}('Use ' || p_brand, 'Report ' || p_name) END AS requirements,
  CASE WHEN p_size % 4 = 1 THEN {L}('Plan ' || p_brand) ELSE NULL END AS documentation,
  CASE WHEN p_size % 5 = 2 THEN {L}('Schools', 'new construction and retail') WHEN p_size % 5 = 3 THEN {L}('Data Center') ELSE NULL END AS applicability,
  CASE WHEN p_size % 6 = 5 THEN {L}('E = ' || p_name) ELSE NULL END AS equations,
  CASE WHEN p_size % 7 = 3 THEN {L}('sum', 'mean') ELSE NULL END AS calc_methods,
  CASE WHEN p_size % 2 = 0 THEN {L}(p_brand, p_type) ELSE NULL END AS related_credits,
  CASE WHEN p_size % 9 = 4 THEN {L}('double') ELSE NULL END AS exemplary_performance,
  CASE WHEN p_size % 3 = 1 THEN {L}('ASHRAE ' || CAST(p_size AS STRING)) ELSE NULL END AS referenced_standards,
  CASE WHEN p_size % 10 = 6 THEN {L}('first', 'second') ELSE NULL END AS step_by_step,
  CASE WHEN p_size % 4 = 2 THEN {L}('see ' || p_name) ELSE NULL END AS guidance,
  CASE WHEN p_size % 5 = 4 THEN NULL ELSE p_size % 4 END AS points_min,
  CASE WHEN p_size % 6 = 4 THEN NULL ELSE p_size % 3 + 1 END AS points_max,
  p_size AS size FROM part"""
PART_SQL = f"pc AS MATERIALIZED ({PART_CREDITS.replace('{L}', 'list_value')})"


def part_credits(spark, sf):
    base = spark.sql(PART_CREDITS.replace("{L}", "array").replace("FROM part", "FROM {part}"), part=table(spark, sf, "part"))
    size = F.col("size")
    option = lambda n: F.struct(
        F.lit(f"Option {n}.").alias("heading"), F.array(F.concat(F.lit(f"way {n} of "), F.col("credit_type"))).alias("lines"), F.lit(n).alias("points")
    )
    return base.withColumns(
        {
            "options": F.when(size % 6 == 2, F.array(option(1), option(2))),
            "sources": F.struct(
                F.when(size % 5 != 1, F.array(size + 3, size, size + 1)).alias("pages"),
                F.when(size % 2 == 0, F.lit("2020-02-03")).alias("effective_date"), F.lit("2019-01-01").alias("version_date"),
            ),
        }
    )


ID_SQL = """CASE WHEN coalesce(credit_code, '') = '' THEN 'UNKNOWN' ELSE credit_code || '-' || (CASE WHEN credit_type = 'Prerequisite' THEN 'p' ELSE 'c' END) ||
  coalesce(nullif(regexp_extract(credit_name, '(?i)(?:credit|prerequisite|option)\\s+(\\d+)', 1), ''), nullif(regexp_extract(credit_code, '(\\d+)', 1), ''),
    (('0x' || substr(md5(credit_name), 1, 4))::INT % 100 + 1)::VARCHAR, '1') END"""


@query("credit_ids", f"WITH {PART_SQL} SELECT credit_no, {ID_SQL} AS credit_id FROM pc")
def credit_ids(spark, sf):
    c = part_credits(spark, sf)
    return c.select("credit_no", cr.credit_id(F.col("credit_code"), F.col("credit_type"), F.col("credit_name")).alias("credit_id"))


META_SQL = """CASE WHEN credit_type = 'Prerequisite' THEN 'prerequisite' ELSE 'credit' END AS doc_type,
 coalesce(rating_system, nullif(regexp_extract(credit_name, 'BD\\+C'), ''), nullif(regexp_extract(credit_name, '\\bND\\b'), ''), '-') AS rating_system,
 CASE WHEN size % 5 = 2 THEN 'Schools,NC,Retail' WHEN size % 5 = 3 THEN 'Data Centers' ELSE 'NC' END AS project_types,
 coalesce(nullif(regexp_extract(coalesce(version, 'v4.1'), '\\((\\d{4}-\\d{2}-\\d{2})\\)', 1), ''), CASE WHEN size % 2 = 0 THEN '2020-02-03' ELSE '2019-01-01' END) AS version_date"""


@query("credit_metadata", f"WITH {PART_SQL} SELECT credit_no, {META_SQL} FROM pc")
def credit_metadata(spark, sf):
    c = part_credits(spark, sf)
    none = F.lit(None).cast("string")
    return c.select(
        "credit_no", cr.doc_type(F.col("credit_type"), none).alias("doc_type"),
        F.coalesce(cr.rating_system(F.col("credit_name"), F.col("rating_system")), F.lit("-")).alias("rating_system"),
        F.array_join(cr.project_types(none, F.col("applicability")), ",").alias("project_types"),
        cr.version_date(F.coalesce("version", F.lit("v4.1")), F.col("sources.effective_date"), F.col("sources.version_date"))
        .cast("string").alias("version_date"),
    )


PATH_SQL = """CASE doc_id % 5 WHEN 0 THEN 'in/Form-' || doc_id || '.pdf' WHEN 1 THEN 'in/user_GUIDE.pdf' WHEN 2 THEN 'in/faq.txt'
  WHEN 3 THEN CASE WHEN doc_id % 2 = 0 THEN 'in/Addenda.pdf' ELSE 'in/addendum.pdf' END ELSE 'in/other.pdf' END"""


@query(
    "document_types",
    f"""WITH d AS (SELECT doc_id, {PATH_SQL} AS path, CASE doc_id % 4 WHEN 0 THEN 'Prerequisite' WHEN 1 THEN 'LEED Credit' WHEN 2 THEN 'other' END AS kind FROM documents)
SELECT doc_id, CASE WHEN kind = 'Prerequisite' THEN 'prerequisite' WHEN kind = 'LEED Credit' THEN 'credit' WHEN doc_id % 5 = 0 THEN 'form' WHEN doc_id % 5 = 1 THEN 'guide'
  WHEN doc_id % 5 = 2 THEN 'faq' WHEN doc_id % 5 = 3 THEN 'addenda' ELSE 'credit' END AS doc_type FROM d""",
)
def document_types(spark, sf):
    """The kind of a document from its record, else from its path."""
    i = F.col("doc_id")
    path = (
        F.when(i % 5 == 0, F.concat(F.lit("in/Form-"), i.cast("string"), F.lit(".pdf"))).when(i % 5 == 1, "in/user_GUIDE.pdf").when(i % 5 == 2, "in/faq.txt")
        .when((i % 5 == 3) & (i % 2 == 0), "in/Addenda.pdf").when(i % 5 == 3, "in/addendum.pdf").otherwise("in/other.pdf")
    )
    kind = F.when(i % 4 == 0, "Prerequisite").when(i % 4 == 1, "LEED Credit").when(i % 4 == 2, "other")
    return table(spark, sf, "documents").select("doc_id", cr.doc_type(kind, path).alias("doc_type"))


@query(
    "completeness_validation",
    f"""WITH {PART_SQL} SELECT credit_no, ((coalesce(credit_name, '') <> '')::INT + (coalesce(credit_code, '') <> '')::INT + (category IS NOT NULL)::INT + (coalesce(intent, '') <> '')::INT
 + (requirements IS NOT NULL)::INT + (documentation IS NOT NULL)::INT + (points_min IS NOT NULL)::INT + (related_credits IS NOT NULL)::INT) / 8.0::DOUBLE AS completeness_score,
 concat_ws('; ', CASE WHEN credit_name IS NULL THEN 'Missing credit name' END, CASE WHEN coalesce(credit_code, '') = '' AND category IS NOT NULL THEN 'Missing credit code' END,
   CASE WHEN points_min > 0 AND points_max > 0 AND points_min > points_max THEN 'Invalid points range' END, CASE WHEN credit_type = 'Other' THEN 'Invalid credit type' END) AS validation_errors FROM pc""",
)
def completeness_validation(spark, sf):
    return with_quality(part_credits(spark, sf)).select(
        "credit_no", "completeness_score", F.array_join("validation_errors", "; ").alias("validation_errors")
    )


def _bul(title: str, col: str) -> str:
    return f"CASE WHEN {col} IS NOT NULL THEN '{title}' || chr(10) || '- ' || array_to_string({col}, chr(10) || '- ') END"


N = "({} IS NOT NULL)::INT"
SECTION_SQL = f"""{PART_SQL},
pi AS (SELECT *, {ID_SQL} AS credit_id, coalesce(credit_code, 'None') || ' ' || coalesce(credit_type, 'None') || ': ' || coalesce(credit_name, 'None') AS head,
  {N.format('related_credits')} AS nr, {N.format('exemplary_performance')} AS ne, {N.format('referenced_standards')} AS nf,
  (equations IS NOT NULL OR calc_methods IS NOT NULL)::INT AS nc FROM pc),
ps AS (
 SELECT credit_no, credit_id, head, 1 AS ord, 'intent' AS section, 0 AS idx, CASE WHEN trim(intent) <> '' THEN 'Intent: ' || intent END AS body FROM pi
 UNION ALL SELECT credit_no, credit_id, head, 2, 'requirements', 0, {_bul('Requirements:', 'requirements')} FROM pi
 UNION ALL SELECT credit_no, credit_id, head, 3, 'requirements', n, 'Option ' || n || '.' || chr(10) || '- way ' || n || ' of ' || credit_type FROM pi, (VALUES (1), (2)) v(n) WHERE size % 6 = 2
 UNION ALL SELECT credit_no, credit_id, head, 4, 'documentation', 0, {_bul('Documentation:', 'documentation')} FROM pi
 UNION ALL SELECT credit_no, credit_id, head, 5, 'calc', 0, CASE WHEN nc = 1 THEN rtrim('Calculations:' || chr(10) || coalesce(array_to_string(equations, chr(10)) || chr(10), '')
    || coalesce(array_to_string(calc_methods, chr(10)), ''), ' ' || chr(10)) END FROM pi
 UNION ALL SELECT credit_no, credit_id, head, 6, 'thresholds', 0, {_bul('Applicability:', 'applicability')} FROM pi
 UNION ALL SELECT credit_no, credit_id, head, 7, 'thresholds', (applicability IS NOT NULL)::INT, CASE WHEN points_min IS NOT NULL OR points_max IS NOT NULL THEN
    'Points: ' || coalesce(points_min::VARCHAR, 'None') || CASE WHEN points_max <> 0 AND points_max IS DISTINCT FROM points_min THEN ' - ' || points_max ELSE '' END END FROM pi
 UNION ALL SELECT credit_no, credit_id, head, 8, 'definitions', 0, {_bul('Related Credits:', 'related_credits')} FROM pi
 UNION ALL SELECT credit_no, credit_id, head, 9, 'definitions', nr, {_bul('Exemplary Performance:', 'exemplary_performance')} FROM pi
 UNION ALL SELECT credit_no, credit_id, head, 10, 'definitions', nr + ne, {_bul('Referenced Standards:', 'referenced_standards')} FROM pi
 UNION ALL SELECT credit_no, credit_id, head, 11, 'calc', nc, {_bul('Step-by-Step:', 'step_by_step')} FROM pi
 UNION ALL SELECT credit_no, credit_id, head, 12, 'definitions', nr + ne + nf, {_bul('Guidance:', 'guidance')} FROM pi)"""


@query(
    "credit_chunks",
    f"""WITH {SECTION_SQL} SELECT credit_no, credit_id || '-' || section || '-' || idx AS chunk_id, section, idx AS section_index, head || chr(10) || chr(10) || body AS text,
 CASE WHEN size % 5 <> 1 THEN size ELSE -1 END AS page_start, CASE WHEN size % 5 <> 1 THEN size + 3 ELSE -1 END AS page_end FROM ps JOIN pc USING (credit_no) WHERE body IS NOT NULL""",
)
def credit_chunks(spark, sf):
    parts = credit_sections(part_credits(spark, sf).withColumn("category", F.col("credit_no").cast("string")))
    minus = F.lit(-1)
    return parts.select(
        F.col("category").cast("long").alias("credit_no"), "chunk_id", "section", "section_index", "text",
        F.coalesce("page_start", minus).alias("page_start"), F.coalesce("page_end", minus).alias("page_end"),
    )


def _txt(title: str, col: str, end: str) -> str:
    return f"CASE WHEN {col} IS NOT NULL THEN '{title}' || chr(10) || '- ' || array_to_string({col}, chr(10) || '- ') END"


JOINED_BLOCKS = ", ".join(
    [
        "CASE WHEN coalesce(intent, '') <> '' THEN 'Intent: ' || intent END", _bul("Requirements:", "requirements"),
        "CASE WHEN size % 6 = 2 THEN 'Option 1.' || chr(10) || '- way 1 of ' || credit_type || chr(10) || chr(10) || 'Option 2.' || chr(10) || '- way 2 of ' || credit_type END",
        _bul("Submittals:", "documentation"), _bul("Applicability:", "applicability"),
        "CASE WHEN equations IS NOT NULL THEN 'Equations:' || chr(10) || array_to_string(equations, chr(10)) END",
        _bul("Related Credits:", "related_credits"), _bul("Exemplary Performance:", "exemplary_performance"),
        _bul("Referenced Standards:", "referenced_standards"), _bul("Step-by-Step:", "step_by_step"), _bul("Guidance:", "guidance"),
    ]
)


@query(
    "credit_texts",
    f"""WITH {SECTION_SQL} SELECT credit_no, head || chr(10) || concat_ws(chr(10) || chr(10), {JOINED_BLOCKS}) AS joined_text,
 concat_ws(chr(10), coalesce(credit_code, 'Unknown') || ' ' || coalesce(credit_type, 'Credit') || ': ' || coalesce(credit_name, 'Unknown Credit'),
  CASE WHEN coalesce(intent, '') <> '' THEN 'Intent: ' || intent END, {_bul("Requirements:", "requirements")},
  CASE WHEN size % 6 = 2 THEN 'Option 1.:' || chr(10) || '- way 1 of ' || credit_type || chr(10) || 'Option 2.:' || chr(10) || '- way 2 of ' || credit_type END,
  {_bul("Submittals:", "documentation")}, {_bul("Applicability:", "applicability")}) AS search_text FROM pi""",
)
def credit_texts(spark, sf):
    c = part_credits(spark, sf)
    cols = {n: F.col(n) for n in c.columns}
    return c.select("credit_no", cr.joined_text(cols).alias("joined_text"), cr.search_text(cols).alias("search_text"))


@query(
    "credit_summary_chunks",
    f"""WITH {PART_SQL}, t AS (SELECT credit_no, 'Credit: ' || coalesce(credit_name, 'Unknown') || chr(10) || 'Code: ' || coalesce(credit_code, 'N/A') || chr(10) || 'Type: ' || credit_type || chr(10)
  || 'Points: ' || coalesce(points_max, 0) || chr(10) || 'Description: ' || coalesce(intent, 'No description') || chr(10)
  || coalesce('Requirements: ' || array_to_string(requirements, ', ') || chr(10), '') AS text FROM pc)
SELECT credit_no, 'doc_credit_data_' || substr(md5(text), 1, 12) AS id, text FROM t""",
)
def credit_summary_chunks_query(spark, sf):
    c = part_credits(spark, sf).select(
        "credit_no", F.col("credit_name").alias("name"), F.col("credit_code").alias("code"), F.col("credit_type").alias("type"),
        F.col("points_max").alias("points"), F.col("intent").alias("description"), F.array_join("requirements", ", ").alias("requirements"),
    )
    return credit_summary_chunks(c).select("credit_no", "id", "text")


@query(
    "distinct_first_credit",
    f"""WITH {PART_SQL} SELECT credit_no, credit_code, credit_name, credit_type AS type FROM pc WHERE coalesce(credit_code, '') <> '' AND credit_name IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY credit_code ORDER BY credit_no) = 1""",
)
def distinct_first_credit(spark, sf):
    c = part_credits(spark, sf).withColumnRenamed("credit_type", "type")
    return credit_list(c, "credit_no").select("credit_no", "credit_code", "credit_name", "type")


@query(
    "normalize_chunks",
    f"""WITH {PART_SQL} SELECT 'credits' AS source, 'parts.json' AS doc, credit_type AS type, coalesce(nullif(credit_code, ''), category, '-') AS credit_code, coalesce(credit_name, '-') AS credit_name,
 coalesce(version, 'v4.1') AS version, 'p' || size AS pages, count(*) AS n FROM pc GROUP BY ALL""",
)
def normalize_chunks_query(spark, sf):
    raw = part_credits(spark, sf).select(
        "credit_code", "category", "credit_type", "version", F.col("credit_name").alias("CreditName"),
        F.col("size").alias("pages"), F.lit("").alias("text"),
    )
    n = normalize_chunks(raw, "credits", "parts.json")
    dash = F.lit("-")
    return n.groupBy(
        "source", "doc", "type", F.coalesce("credit_code", dash).alias("credit_code"), F.coalesce("credit_name", dash).alias("credit_name"),
        "version", F.concat(F.lit("p"), F.array_join(F.transform("pages", lambda p: p.cast("string")), ",")).alias("pages"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "points_parsing",
    """WITH t AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_size || ' points' WHEN 1 THEN '1 - ' || p_size || ' Points' WHEN 2 THEN p_size || ' point' ELSE p_name || ' points' END AS s FROM part)
SELECT p_partkey, coalesce(nullif(regexp_extract(s, '(?i)^(\\d+)(\\s*-\\s*(\\d+))?\\s*points?$', 1), '')::INT, -1) AS lo,
 coalesce(nullif(regexp_extract(s, '(?i)^(\\d+)(\\s*-\\s*(\\d+))?\\s*points?$', 3), '')::INT, nullif(regexp_extract(s, '(?i)^(\\d+)(\\s*-\\s*(\\d+))?\\s*points?$', 1), '')::INT, -1) AS hi FROM t""",
)
def points_parsing(spark, sf):
    size = F.col("p_size").cast("string")
    text = (
        F.when(F.col("p_size") % 4 == 0, F.concat(size, F.lit(" points")))
        .when(F.col("p_size") % 4 == 1, F.concat(F.lit("1 - "), size, F.lit(" Points")))
        .when(F.col("p_size") % 4 == 2, F.concat(size, F.lit(" point")))
        .otherwise(F.concat("p_name", F.lit(" points")))
    )
    p = parse_points(text)
    minus = F.lit(-1)
    return table(spark, sf, "part").select("p_partkey", F.coalesce(p["lo"], minus).alias("lo"), F.coalesce(p["hi"], minus).alias("hi"))


@query(
    "catalogue_display",
    r"""WITH d AS (SELECT doc_id, lang, regexp_replace(trim(regexp_replace(text || ' .......... ' || doc_id, '\.{4,}', '...', 'g')), '\s+\d+\s*$', '') AS t, text FROM documents)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'EA: ' || lang WHEN doc_id % 3 = 1 THEN lang ELSE 'Credit Information' END AS display_name,
 CASE WHEN length(trim(t)) > 400 THEN substr(trim(t), 1, 400) || '...' ELSE trim(t) END AS display_text,
 CASE WHEN length(text) > 120 THEN substr(text, 1, 116) || '...' ELSE text END AS short_name FROM d""",
)
def catalogue_display(spark, sf):
    d = table(spark, sf, "documents")
    k, none = F.col("doc_id") % 3, F.lit(None).cast("string")
    name = display_name(
        F.when(k == 0, F.lit("EA")).when(k == 1, F.lit("None")), F.when(k < 2, F.col("lang")), none,
        F.lit("no header here"), F.lit("Credit"),
    )
    padded = F.concat("text", F.lit(" .......... "), F.col("doc_id").cast("string"))
    return d.select(
        "doc_id", name.alias("display_name"), display_text(padded).alias("display_text"), short_name(F.col("text")).alias("short_name")
    )
