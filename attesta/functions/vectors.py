"""Vector columns (array<float|double>) and hashed bag-of-words vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind, md5_hex, value_counts

HASH_DIGITS = 5  # hexadecimal digits of a dimension: 2^20 of them


def dot(a: Column, b: Column) -> Column:
    prod = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prod, F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double; 0 where either vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def l2_normalise(a: Column) -> Column:
    return bind(
        norm(a), lambda n: F.transform(a, lambda x: F.when(n == 0, x.cast("double")).otherwise(x.cast("double") / n))
    )


def hash_dim(token: Column, digits: int = HASH_DIGITS) -> Column:
    """Dimension of a token: so many hexadecimal digits (at most 7) of its MD5."""
    return F.conv(md5_hex(token, digits), 16, 10).cast("int")


def hashed_vector(toks: Column, digits: int = HASH_DIGITS) -> Column:
    """tokens -> array<struct<dim, w>>, sparse term counts scaled to unit length."""
    counts = value_counts(F.transform(toks, lambda t: hash_dim(t, digits)), key="dim")

    def scaled(cs: Column) -> Column:
        length = F.sqrt(F.aggregate(cs, F.lit(0.0), lambda acc, e: acc + e["n"].cast("double") * e["n"]))
        return bind(
            length, lambda n: F.transform(cs, lambda e: F.struct(e["dim"].alias("dim"), (e["n"] / n).alias("w")))
        )

    return bind(counts, scaled)


def sparse_dot(a: Column, b: Column) -> Column:
    """Dot product of two sparse vectors held in one row (array<struct<dim, w>>, dims unique in each).

    Both are sorted together, so a shared dimension shows as two neighbours.
    """
    start = F.struct(F.lit(-1).alias("dim"), F.lit(0.0).alias("w"), F.lit(0.0).alias("s"))
    return F.aggregate(
        F.sort_array(F.concat(a, b)),
        start,
        lambda acc, e: F.struct(
            e["dim"].alias("dim"), e["w"].alias("w"),
            (acc["s"] + F.when(e["dim"] == acc["dim"], e["w"] * acc["w"]).otherwise(F.lit(0.0))).alias("s"),
        ),
        lambda acc: acc["s"],
    )
