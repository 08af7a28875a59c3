"""Mixing of sources to target weights by Poisson replication, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

TAIL = 14  # the counts listed end this many standard deviations above the mean


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the hash of the parts, the same in every run; 52 bits."""
    text = F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def rates(docs: DataFrame, source: str = "source", weights: DataFrame | None = None, rows: int | None = None) -> DataFrame:
    """(source, rows_in, rate, cdf): the mean repetitions of a row of each source, and their distribution.

    `weights` (source, weight) are the target shares; sources it does not name get none, and those
    without rows leave their share to the others. Without it
    all sources get the same share. `rows` is the expected size of the mix, the input's by default.
    cdf[k] is the probability of at most k repetitions under a Poisson distribution with mean `rate`.
    """
    counts = docs.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("rows_in"))
    if weights is None:
        shares = counts.withColumn("weight", F.lit(1.0))
    else:
        asked = weights.groupBy(F.col("source").alias("_s")).agg(F.sum("weight").alias("weight"))
        shares = counts.join(asked, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
        shares = shares.withColumn("weight", F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0)))
    shares = written(shares)
    total = shares.agg(F.sum("weight").alias("w"), F.sum("rows_in").alias("n")).first()
    size = float(rows if rows is not None else (total.n or 0))
    rate = F.col("weight") * F.lit(size / total.w if total.w else 0.0) / F.col("rows_in")
    last = F.ceil(F.col("rate") + TAIL * F.sqrt("rate") + TAIL).cast("int")
    # log of k! grows with k: one running sum per source, then the running sum of the probabilities
    logs = F.aggregate(
        F.sequence(F.lit(1), last), F.array(F.lit(0.0)),
        lambda acc, k: F.concat(acc, F.array(F.element_at(acc, -1) + F.log(k.cast("double")))),
    )
    mass = F.transform(
        F.col("_logs"), lambda f, k: F.when(F.col("rate") > 0, F.exp(k * F.log("rate") - F.col("rate") - f)).otherwise(F.when(k == 0, 1.0).otherwise(0.0))
    )
    cdf = F.slice(
        F.aggregate(F.col("_mass"), F.array(F.lit(0.0)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + p))),
        F.lit(2), F.size("_mass"),
    )
    out = shares.withColumn("rate", rate).withColumn("_logs", logs).withColumn("_mass", mass)
    return out.select("source", "rows_in", "rate", cdf.alias("cdf"))


def mix(
    docs: DataFrame, source: str = "source", doc_id: str = "doc_id", weights: DataFrame | None = None,
    rows: int | None = None, seed: int = 42,
) -> DataFrame:
    """All columns of `docs`, each row repeated a Poisson number of times, in a globally shuffled order.

    Adds `copy` (0, 1, ...) and `mix_order` (the sort key in (0, 1)); input columns of these names are
    replaced. The number of copies inverts the distribution at a uniform number hashed from the seed
    and the id: the same id always gets the same number, repeated rows of one id alike. A null source
    is a source; a null id counts as one id. The rates join is planned by the size of the rates as
    written: a broadcast within the session's limit, else a shuffle in which AQE splits large sources.
    """
    table = written(rates(docs, source, weights, rows)).select(F.col("source").alias("_s"), F.col("cdf").alias("_cdf"))
    own = docs.drop("copy", "mix_order").join(table, F.col(source).eqNullSafe(F.col("_s")))
    draw = uniform(F.lit(seed), F.col(doc_id))
    times = F.size(F.filter(F.col("_cdf"), lambda c: c <= F.col("_u")))
    many = own.withColumn("_u", draw).withColumn("_n", times).filter("_n > 0").drop("_cdf", "_s", "_u")
    copies = many.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
    order = uniform(F.lit(seed), F.col(doc_id), F.col("copy"), F.lit("order"))
    return copies.withColumn("mix_order", order).orderBy("mix_order", doc_id, "copy")


SQL = """
WITH counts AS (SELECT source, count(*) AS rows_in FROM documents GROUP BY 1),
r AS (SELECT source, 1.0::DOUBLE * ((SELECT sum(rows_in) FROM counts)::DOUBLE / (SELECT count(*) FROM counts)) / rows_in AS rate FROM counts),
k AS (SELECT source, rate, unnest(range(0, (ceil(rate + 14 * sqrt(rate) + 14))::BIGINT + 1)) AS k FROM r),
m AS (SELECT source, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p FROM k),
c AS (SELECT source, list(cdf ORDER BY k) AS cdf FROM (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS cdf FROM m) GROUP BY 1),
u AS (SELECT d.*, cdf, (('0x' || substr(md5('42' || chr(31) || doc_id), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents d JOIN c ON d.source IS NOT DISTINCT FROM c.source),
n AS (SELECT *, len(list_filter(cdf, lambda x: x <= u)) AS n FROM u)
SELECT doc_id, text, lang, source, n_chars, copy::INTEGER AS copy,
  (('0x' || substr(md5('42' || chr(31) || doc_id || chr(31) || copy || chr(31) || 'order'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS mix_order
FROM (SELECT * EXCLUDE (cdf, u, n), unnest(range(0, n)) AS copy FROM n)
"""
