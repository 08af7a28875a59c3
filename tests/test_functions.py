"""Scalar functions on hand-made values."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attesta.functions import credits as cr
from attesta.functions import text as tx
from attesta.functions import vectors as vx


def one(spark, column, **values):
    cols = [F.lit(v).alias(k) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v]).alias(k) for k, v in values.items()]
    return spark.range(1).select(*cols).select(column.alias("x")).first()["x"]


def py_tokens(s):
    return [t for t in re.sub(r"[^\w\s-]", " ", s.lower()).split() if len(t) >= 2]


def test_tokens_follow_the_rule(spark):
    cases = ["Énergie-2 a BC d'eau", "x", "", "  L’été, naïve; ÀÉ ", "a-b -- c_d 42", "Straße\tzwei\nEA"]
    rows = spark.createDataFrame([(c,) for c in cases], "t string").select("t", tx.tokens(F.col("t")).alias("k")).collect()
    for r in rows:
        assert r["k"] == py_tokens(r["t"])


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet="abéß -_.,\n1", max_size=30), min_size=1, max_size=30))
def test_tokens_property(spark, texts):
    rows = spark.createDataFrame([(c,) for c in texts], "t string").select("t", tx.tokens(F.col("t")).alias("k")).collect()
    assert all(r["k"] == py_tokens(r["t"]) for r in rows)


def test_value_counts(spark):
    got = one(spark, tx.value_counts(F.split(F.col("s"), ",")), s="b,a,b,c,b,a")
    assert [(r["term"], r["n"]) for r in got] == [("a", 2), ("b", 3), ("c", 1)]
    assert one(spark, tx.value_counts(F.filter(F.split(F.col("s"), ","), lambda x: x != "")), s="") == []


def test_compact(spark):
    assert one(spark, tx.compact(F.col("s"), 10), s=" a  b\n c ") == "a b c"
    assert one(spark, tx.compact(F.col("s"), 10), s="0123456789ab") == "0123456..."


@pytest.mark.parametrize(
    "s,lo,hi", [("3 points", 3, 3), ("1 - 4 Points", 1, 4), ("1-2 point", 1, 2), ("points", None, None), ("3 points max", None, None)]
)
def test_points(spark, s, lo, hi):
    r = one(spark, tx.parse_points(F.col("s")), s=s)
    assert (r["lo"], r["hi"]) == (lo, hi)


def test_credit_id_fallbacks(spark):
    cid = lambda **v: one(spark, cr.credit_id(F.col("c"), F.col("k"), F.col("n")), **v)
    assert cid(c="EA", k="Prerequisite", n="Prerequisite 2") == "EA-p2"
    assert cid(c="EA3", k="Credit", n="Name") == "EA3-c3"
    assert cid(c="EA", k="Credit", n="Optimize Energy Performance") == "EA-c18"
    expected = int(hashlib.md5(b"Heat").hexdigest()[:4], 16) % 100 + 1
    assert cid(c="SS", k="Credit", n="Heat") == f"SS-c{expected}"
    assert cid(c="", k="Credit", n="Heat") == "UNKNOWN"
    assert cid(c=None, k=None, n=None) == "UNKNOWN"


def test_rating_system_needs_word_boundaries(spark):
    none = F.lit(None).cast("string")
    assert one(spark, cr.rating_system(F.col("t"), none), t="Indoor and outdoor") is None
    assert one(spark, cr.rating_system(F.col("t"), none), t="Plan ND v4") == "ND"
    assert one(spark, cr.rating_system(F.col("t"), F.lit("O+M")), t="BD+C") == "O+M"


def test_project_types_and_dates(spark):
    none = F.lit(None).cast("string")
    assert one(spark, cr.project_types(none, F.col("a")), a=["retail and schools", "New Construction"]) == ["Schools", "Retail", "NC"]
    assert one(spark, cr.project_types(none, F.lit(None).cast("array<string>"))) == ["NC"]
    assert str(one(spark, cr.version_date(F.col("v"), none, F.lit("2020-01-01")), v="v4.1 (2023-01-02)")) == "2023-01-02"
    assert str(one(spark, cr.version_date(F.col("v"), none, F.lit("2020-01-01")), v="v4")) == "2020-01-01"


def test_validation_treats_zero_points_as_missing(spark):
    def errors(lo, hi):
        return one(
            spark, cr.validation_errors(F.lit("n"), F.lit("EA"), F.lit("E"), F.col("lo"), F.col("hi"), F.lit("Credit")), lo=lo, hi=hi
        )

    assert errors(5, 2) == ["Invalid points range"] and errors(5, 0) == [] and errors(1, 2) == []


def test_section_priority(spark):
    for s, p in [("Requirements", 10), ("calc", 7), ("other", 1), ("", 0), (None, 0)]:
        assert one(spark, cr.section_priority(F.col("s").cast("string")), s=s) == p


def test_cosine_and_sparse_dot(spark):
    assert one(spark, vx.cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[0.0, 0.0]) == 0.0
    assert abs(one(spark, vx.cosine(F.col("a"), F.col("b")), a=[1.0, 2.0], b=[2.0, 4.0]) - 1) < 1e-12
    vec = lambda c: vx.hashed_vector(tx.tokens(F.col(c)))
    same = one(spark, vx.sparse_dot(vec("a"), vec("b")), a="red blue blue", b="blue red blue")
    half = one(spark, vx.sparse_dot(vec("a"), vec("b")), a="red blue", b="red green")
    assert abs(same - 1) < 1e-12 and abs(half - 0.5) < 1e-12
    assert one(spark, vx.sparse_dot(vec("a"), vec("b")), a="", b="red") == 0.0


def test_html(spark):
    page = "<html><title> T&amp;x </title><style>p{}</style><!-- no --><p>A&nbsp;&lt;b&gt;</p><script>x()</script>"
    assert one(spark, tx.strip_html(F.col("h")), h=page) == "T&x A <b>"


def test_result_key_order(spark):
    def key(chunk, credit, page, text):
        n = F.lit(None)
        return one(
            spark,
            tx.result_key(
                F.lit(chunk).cast("string"), F.lit(credit).cast("string"), n.cast("string"), F.lit(page).cast("int"),
                n.cast("int"), F.lit(text).cast("string"), F.lit(3), F.lit(0.5),
            ),
        )

    assert key("c1", "EA-c1", 1, "t") == "chunk_id:c1"
    assert key(None, "EA-c1", 1, "t") == "credit:EA-c1::section:unknown::pages:1-None"
    assert key(None, "EA-c1", None, "t") == "text_hash:" + hashlib.md5(b"t").hexdigest()
    assert key(None, None, None, "") == "rank:3::score:0.5"
