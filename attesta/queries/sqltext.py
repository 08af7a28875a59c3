"""Pieces of SQL shared by the oracle statements."""

from __future__ import annotations

SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"


def toks(x: str) -> str:
    return (
        rf"list_filter(string_split_regex(regexp_replace(lower(coalesce({x}, '')), '[^\p{{L}}\p{{N}}_\s-]', ' ', 'g'), '\s+'), "
        "lambda t: length(t) >= 2)"
    )


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{SPACE}'), lambda t: t <> '')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}|{SPACE}$', '', 'g')"


def compact(x: str, n: int = 360) -> str:
    s = f"array_to_string({words(f'coalesce({x}, chr(32))')}, ' ')"
    return f"CASE WHEN length({s}) <= {n} THEN {s} ELSE substr({s}, 1, {n - 3}) || '...' END"


def bm25(k: int, q: str = "q", chunks: str = "chunks", p: str = "") -> str:
    """CTEs ending in {p}bmk(query_id, source, chunk_id, score, rank) for q(query_id, text)."""
    return f"""
{p}tk AS MATERIALIZED (SELECT source, chunk_id, {toks('text')} AS t FROM {chunks}),
{p}post AS MATERIALIZED (SELECT source, chunk_id, term, count(*) AS tf
   FROM (SELECT source, chunk_id, unnest(t) AS term FROM {p}tk) GROUP BY ALL),
{p}terms AS MATERIALIZED (SELECT source, term, count(*) AS df FROM {p}post GROUP BY ALL),
{p}st AS MATERIALIZED (SELECT source, count(*) AS n_docs, sum(len(t))::DOUBLE / count(*) AS avgdl FROM {p}tk GROUP BY ALL),
{p}raw AS MATERIALIZED (SELECT source, term, df, n_docs, avgdl, ln((n_docs - df + 0.5)::DOUBLE) - ln((df + 0.5)::DOUBLE) AS r
   FROM {p}terms JOIN {p}st USING (source)),
{p}mi AS (SELECT source, avg(r) AS mean_idf FROM {p}raw GROUP BY ALL),
{p}qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({toks('text')}) AS term FROM {q}) GROUP BY ALL),
{p}w AS MATERIALIZED (SELECT query_id, source, term, avgdl, qtf * (CASE WHEN r < 0 THEN 0.25 * mean_idf ELSE r END) AS weight
   FROM {p}qt JOIN {p}raw USING (term) JOIN {p}mi USING (source)),
{p}bm AS (SELECT query_id, source, chunk_id,
     round(sum(weight * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(t) / avgdl))), 6) AS score
   FROM {p}post JOIN {p}w USING (source, term) JOIN {p}tk USING (source, chunk_id) GROUP BY ALL),
{p}bmk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, chunk_id) AS rank
   FROM {p}bm WHERE score > 0 QUALIFY rank <= {k})"""


def text_dense(k: int, q: str = "dq", chunks: str = "chunks", p: str = "") -> str:
    """CTEs ending in {p}dek(query_id, source, chunk_id, score, rank) over hashed text vectors."""
    dim = "('0x' || substr(md5(term), 1, 5))::INT"
    return f"""
{p}dv0 AS MATERIALIZED (SELECT source, chunk_id, {dim} AS dim, count(*)::DOUBLE AS n
   FROM (SELECT source, chunk_id, unnest({toks('text')}) AS term FROM {chunks}) GROUP BY ALL),
{p}dv AS MATERIALIZED (SELECT source, chunk_id, dim, n / sqrt(sum(n * n) OVER (PARTITION BY source, chunk_id)) AS w FROM {p}dv0),
{p}qv0 AS (SELECT query_id, {dim} AS dim, count(*)::DOUBLE AS n
   FROM (SELECT query_id, unnest({toks('text')}) AS term FROM {q}) GROUP BY ALL),
{p}qv AS MATERIALIZED (SELECT query_id, dim, n / sqrt(sum(n * n) OVER (PARTITION BY query_id)) AS qw FROM {p}qv0),
{p}de AS (SELECT query_id, source, chunk_id, round(sum(w * qw), 6) AS score FROM {p}dv JOIN {p}qv USING (dim) GROUP BY ALL),
{p}dek AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, chunk_id) AS rank
   FROM {p}de QUALIFY rank <= {k})"""


def weighted(out: str, dense: str, lexical: str, by: str = "query_id, source", key: str = "chunk_id") -> str:
    """CTEs ending in {out}({by}, {key}, dense_score, lexical_score, score, method, rank)."""
    return f"""
{out}_b AS (SELECT {by}, {key}, score, rank, 0 AS list_no FROM {dense} UNION ALL SELECT {by}, {key}, score, rank, 1 FROM {lexical}),
{out}_n AS (SELECT *, min(score) OVER (PARTITION BY {by}, list_no) AS lo, max(score) OVER (PARTITION BY {by}, list_no) AS hi,
     count(*) FILTER (list_no = 0) OVER (PARTITION BY {by}) AS nd, count(*) FILTER (list_no = 1) OVER (PARTITION BY {by}) AS nl FROM {out}_b),
{out}_u AS (SELECT *, (score - lo) / (CASE WHEN hi > lo THEN hi - lo ELSE 1.0 END) AS unit FROM {out}_n),
{out}_f AS (SELECT {by}, {key}, max(CASE WHEN list_no = 0 THEN score END) AS dense_score, max(CASE WHEN list_no = 1 THEN score END) AS lexical_score,
     min(list_no * 1000000 + rank) AS first_at,
     CASE WHEN min(nd) > 0 AND min(nl) > 0 THEN round(coalesce(max(CASE WHEN list_no = 0 THEN unit END) * 0.7::DOUBLE, 0)
        + coalesce(max(CASE WHEN list_no = 1 THEN unit END) * 0.3::DOUBLE, 0), 6) ELSE max(score) END AS score,
     CASE WHEN count(*) = 2 THEN 'hybrid' WHEN min(list_no) = 0 THEN 'dense' ELSE 'lexical' END AS method
   FROM {out}_u GROUP BY ALL),
{out} AS MATERIALIZED (SELECT * EXCLUDE (first_at), row_number() OVER (PARTITION BY {by} ORDER BY score DESC, first_at) AS rank FROM {out}_f)"""


SYNONYMS_SQL = """[
 {'k':'water','o':['water efficiency','water use']},{'k':'energy','o':['energy efficiency','energy performance']},
 {'k':'materials','o':['materials','resources']},{'k':'indoor','o':['indoor air quality','IAQ']},
 {'k':'site','o':['sustainable sites','site selection']},{'k':'efficiency','o':['efficiency','performance']},
 {'k':'requirements','o':['requirements','prerequisites']},{'k':'credits','o':['credits','points']},
 {'k':'we','o':['water efficiency','WE credits']},{'k':'ea','o':['energy and atmosphere','EA credits']},
 {'k':'mr','o':['materials and resources','MR credits']},{'k':'eq','o':['indoor environmental quality','EQ credits']},
 {'k':'ss','o':['sustainable sites','SS credits']},{'k':'lt','o':['location and transportation','LT credits']}]"""


def with_synonyms(x: str) -> str:
    hits = f"flatten(list_transform(list_filter({SYNONYMS_SQL}, lambda r: contains(lower({x}), r.k)), lambda r: r.o))"
    four = f"list_slice(list_concat([{x}], {hits}), 1, 4)"
    kept = f"list_filter({four}, lambda v, i: list_position({four}, v) = i)"
    j = f"array_to_string({kept}, ' ')"
    return f"CASE WHEN length({j}) > length({x}) THEN {j} ELSE {x} END"


def with_domain(x: str) -> str:
    return f"CASE WHEN contains(lower(trim({x})), 'leed') THEN trim({x}) ELSE 'LEED ' || trim({x}) END"


CATS_SQL = """[{'k':'energy','o':['EA','ENERGY AND ATMOSPHERE']},{'k':'water','o':['WE','WATER EFFICIENCY']},
 {'k':'materials','o':['MR','MATERIALS AND RESOURCES']},{'k':'indoor','o':['EQ','INDOOR ENVIRONMENTAL QUALITY']},
 {'k':'site','o':['SS','SUSTAINABLE SITES']},{'k':'location','o':['LT','LOCATION AND TRANSPORTATION']},
 {'k':'innovation','o':['IN','INNOVATION']},{'k':'regional','o':['RP','REGIONAL PRIORITY']}]"""
TERMS_SQL = """[{'k':'energy efficiency','o':['EA Minimum Energy Performance','EA Optimize Energy Performance']},
 {'k':'energy','o':['EA credit requirements','energy performance ASHRAE 90.1']},
 {'k':'water','o':['WE water use reduction','WE outdoor water use reduction']},
 {'k':'materials','o':['MR building life-cycle impact reduction','MR building product disclosure']},
 {'k':'requirements','o':['prerequisite requirements','credit requirements']},
 {'k':'efficiency','o':['energy efficiency','water efficiency']}]"""

FEATURES = rf"""
feat AS (SELECT query_id, trim(text) AS text, lower(trim(text)) AS low,
   flatten(list_transform(list_filter({CATS_SQL}, lambda r: contains(lower(text), r.k)), lambda r: r.o)) AS categories,
   list_filter(string_split_regex(text, '[^\p{{L}}\p{{N}}_]+'), lambda c: c IN ('EA','WE','MR','EQ','SS','LT','IN','RP','IP')) AS codes,
   list_transform(list_filter({TERMS_SQL}, lambda r: contains(lower(text), r.k)), lambda r: r.k) AS terms,
   contains(lower(text), 'requirement') OR contains(lower(text), 'prerequisite') AS has_requirements,
   contains(lower(text), 'threshold') OR contains(lower(text), 'point') OR contains(lower(text), 'score') AS has_thresholds,
   contains(lower(text), 'documentation') OR contains(lower(text), 'submittal') OR contains(lower(text), 'evidence') AS has_documentation
 FROM q)"""

# (query_id, grp, pos, sub): candidate sub-queries in rule order
EXPANSION = f"""{FEATURES},
cq AS (SELECT query_id, has_requirements, unnest(list_slice(codes, 1, 3)) AS c, generate_subscripts(list_slice(codes, 1, 3), 1) AS i FROM feat),
catq AS (SELECT query_id, unnest(list_slice(categories, 1, 2)) AS c, generate_subscripts(list_slice(categories, 1, 2), 1) AS i FROM feat WHERE len(codes) = 0),
rules(c, j, sub) AS (VALUES
 ('EA', 1, 'EA Minimum Energy Performance requirements LEED v4.1 BD+C'), ('EA', 2, 'EA Optimize Energy Performance requirements thresholds'),
 ('EA', 3, 'energy performance prerequisite baseline ASHRAE Appendix G'),
 ('WE', 1, 'WE water use reduction requirements LEED v4.1'), ('WE', 2, 'WE outdoor water use reduction thresholds'),
 ('MR', 1, 'MR building product disclosure requirements'), ('MR', 2, 'MR construction waste management requirements')),
tq AS (SELECT query_id, has_requirements AS hr, unnest(list_slice(list_filter({TERMS_SQL}, lambda r: contains(low, r.k)), 1, 3)) AS r,
   generate_subscripts(list_slice(list_filter({TERMS_SQL}, lambda r: contains(low, r.k)), 1, 3), 1) AS i FROM feat),
tq2 AS (SELECT query_id, hr, i, unnest(r.o) AS o, generate_subscripts(r.o, 1) AS j FROM tq),
cand AS (
  SELECT query_id, 1 AS g, i * 10 + j AS pos, sub FROM (
    SELECT query_id, i, unnest([1, 2]) AS j, unnest(CASE WHEN has_requirements
      THEN [c || ' prerequisite requirements LEED v4.1', c || ' credit requirements LEED v4.1']
      ELSE [c || ' credit LEED v4.1 BD+C', c || ' requirements thresholds'] END) AS sub FROM cq)
  UNION ALL SELECT query_id, 1, i * 10 + j, sub FROM catq JOIN rules USING (c)
  UNION ALL SELECT query_id, 2, i * 10 + j, CASE WHEN hr THEN o || ' requirements LEED v4.1' ELSE o || ' LEED v4.1 BD+C' END
    FROM tq2 WHERE NOT (hr AND contains(lower(o), 'requirement'))
  UNION ALL SELECT query_id, 3, 1, text || ' prerequisite requirements' FROM feat WHERE has_requirements
  UNION ALL SELECT query_id, 3, 2, text || ' credit requirements' FROM feat WHERE has_requirements
  UNION ALL SELECT query_id, 3, 3, text || ' thresholds points' FROM feat WHERE has_thresholds
  UNION ALL SELECT query_id, 3, 4, text || ' documentation submittals' FROM feat WHERE has_documentation
  UNION ALL SELECT query_id, 4, 1, text || ' LEED v4.1 BD+C' FROM feat WHERE NOT contains(low, 'leed')),
cand1 AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY query_id, lower(trim(sub)) ORDER BY g, pos) = 1),
subs AS MATERIALIZED (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY g, pos) AS sub_no, sub AS sub_query FROM cand1 QUALIFY sub_no <= 6)"""
