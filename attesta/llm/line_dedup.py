"""Line de-duplication by site-relative frequency, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    """128 bits of a line without surrounding spaces; null for a blank line, which is never boilerplate."""
    bare = F.trim(line)
    return F.when(bare != "", F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(bare, F.lit(1)).alias("b")))


def boilerplate(docs: DataFrame, site: str = "source", text: str = "text", ratio: float = 0.1, min_pages: int = 5) -> DataFrame:
    """(site, pages, keys): the lines on more than `ratio` of the pages of a site, and on at least `min_pages`.

    A line counts once per page. Each site has at most (lines per page) / ratio such lines. Pages of
    a null site form a site of their own.
    """
    pages = docs.select(F.col(site).alias("site"), F.col(text).alias("text"))
    totals = pages.groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    keys = F.array_distinct(F.filter(F.transform(_lines(F.col("text")), _key), lambda k: k.isNotNull()))
    counts = (
        pages.select("site", F.explode(keys).alias("key"))
        .groupBy("site", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pages)
    )
    common = counts.join(totals.withColumnRenamed("site", "_site"), F.col("site").eqNullSafe(F.col("_site")))
    return common.filter(F.col("n") > ratio * F.col("pages")).groupBy("site").agg(F.collect_list("key").alias("keys"))


def drop_boilerplate(
    docs: DataFrame, site: str = "source", text: str = "text", ratio: float = 0.1, min_pages: int = 5
) -> DataFrame:
    """All columns of `docs` with boilerplate lines removed from `text`, and `n_lines`, `n_dropped` (long).

    Every row stays; a page of boilerplate only keeps an empty text; a null text stays null with 0
    lines. Columns named n_lines or n_dropped in the input are replaced. The list of a site is looked
    up by a join that Spark plans by the written size of all lists: a broadcast below the session's
    limit, else a shuffle in which AQE splits large sites.
    """
    lists = written(boilerplate(docs, site, text, ratio, min_pages)).select(F.col("site").alias("_site"), F.col("keys").alias("_keys"))
    found = docs.join(lists, F.col(site).eqNullSafe(F.col("_site")), "left")
    lines = _lines(F.col(text))
    kept = F.filter(lines, lambda line: F.coalesce(~F.array_contains(F.col("_keys"), _key(line)), F.lit(True)))
    some = F.col("_keys").isNotNull() & F.col(text).isNotNull()
    out = found.withColumn("_kept", F.when(some, kept)).withColumn(
        "n_lines", F.coalesce(F.size(lines).cast("long"), F.lit(0).cast("long"))
    )
    out = out.withColumn("n_lines", F.when(F.col(text).isNull(), F.lit(0).cast("long")).otherwise(F.col("n_lines")))
    return out.withColumn(
        "n_dropped", F.when(some, F.col("n_lines") - F.size("_kept")).otherwise(F.lit(0)).cast("long")
    ).withColumn(text, F.when(F.col("n_dropped") > 0, F.array_join("_kept", "\n")).otherwise(F.col(text))).drop("_site", "_keys", "_kept")


SQL = """
WITH lines AS (SELECT source, unnest(list_distinct(list_transform(string_split(text, chr(10)), lambda x: trim(x)))) AS line FROM documents),
totals AS (SELECT source, count(*) AS pages FROM documents GROUP BY 1),
counts AS (SELECT source, line, count(*) AS n FROM lines WHERE line <> '' GROUP BY ALL HAVING count(*) >= {min_pages}),
lists AS (SELECT c.source, list(line) AS gone FROM counts c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source WHERE n > {ratio} * pages GROUP BY 1),
split AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls, coalesce(gone, []) AS gone FROM documents d LEFT JOIN lists l ON d.source IS NOT DISTINCT FROM l.source),
kept AS (SELECT *, list_filter(ls, lambda x: NOT list_contains(gone, trim(x))) AS k FROM split)
SELECT doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(len(ls) - len(k), 0)::BIGINT AS n_dropped,
  CASE WHEN len(ls) > len(k) THEN coalesce(array_to_string(k, chr(10)), '') ELSE text END AS text FROM kept
"""
