"""Chunking, parsing, expansion, evidence and training on small hand-made inputs."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attesta.operators.chunking import (
    chunk_extractions, credit_sections, drop_exact_duplicates, heading_chunks, json_chunks, json_text, page_chunks, sheet_chunks, word_windows,
)
from attesta.operators.expansion import expand_queries, search_queries, with_domain_word, with_synonyms
from attesta.operators.parsing import classified_lines, parse_credits
from attesta.operators.skew import join_to_unique, running
from attesta.plans.evaluation import EVALUATION_QUERIES, SMOKE_QUERIES, query_relevance
from attesta.plans.evidence import decisions, fill_template, key_facts
from attesta.plans.training import citation_rows, evidence_rows, qa_pairs
from attesta.sources.schemas import CREDIT


@pytest.mark.parametrize("n,starts", [(0, []), (99, [0]), (1000, [0]), (1001, [0, 950]), (1950, [0, 950]), (1951, [0, 950, 1900])])
def test_window_starts(spark, n, starts):
    df = spark.createDataFrame([(" ".join(f"w{i}" for i in range(n)),)], "text string")
    got = word_windows(df, []).orderBy("chunk_index").collect()
    assert [r["chunk_start_word"] for r in got] == starts
    assert all(r["chunk_end_word"] - r["chunk_start_word"] <= 1000 for r in got)


def test_short_text_gives_no_window(spark):
    df = spark.createDataFrame([("x" * 99,), ("x" * 100,)], "text string")
    assert word_windows(df, []).count() == 1


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(1, 60), st.integers(5, 20), st.integers(0, 4))
def test_windows_cover_every_word(spark, n, size, overlap):
    df = spark.createDataFrame([(" ".join(f"w{i}" for i in range(n)),)], "text string")
    got = word_windows(df, [], max_words=size, overlap=overlap, min_chars=1).collect()
    seen = {w for r in got for w in r["text"].split()}
    assert seen == {f"w{i}" for i in range(n)}


def test_headings(spark):
    body = "b" * 120
    text = f"{body}\n  Intent: \n{body}\nRequirements\nshort\nPoints:\n{body}"
    got = heading_chunks(spark.createDataFrame([(text,)], "text string"), []).orderBy("chunk_index").collect()
    assert [(r["section"], r["section_index"]) for r in got] == [("general", 0), ("intent", 1), ("thresholds", 3)]
    assert got[1]["text"] == "Intent:\n" + body
    plain = heading_chunks(spark.createDataFrame([("Intent\n" + "w " * 40,)], "text string"), []).collect()
    assert plain == []  # one section below 100 characters, and the whole text too


def test_pages_sheets_json_and_router(spark):
    body = "word " * 30
    pages = spark.createDataFrame([("f", 1, body), ("f", 2, "  ")], "source_file string, page int, text string")
    tabs = spark.createDataFrame([("f", 1), ("f", 1)], "source_file string, page int")
    got = page_chunks(pages, {"has_tables": tabs, "has_images": tabs.filter("page = 9")}).collect()
    assert len(got) == 1 and got[0]["has_tables"] and not got[0]["has_images"]
    rows = spark.createDataFrame([("f", "s", 0, {"a": body, "b": " ", "c": None})], "source_file string, sheet_name string, row_index int, cells map<string,string>")
    assert sheet_chunks(rows).first()["text"].startswith("a: word word")
    doc = '{"a": {"b": 1, "c": [true, {"d": null}]}, "e": "x"}'
    j = spark.createDataFrame([(doc,)], "data string")
    assert j.select(json_text("data").alias("t")).first()["t"] == "a: a.b: 1 | a.c: True | a.c[1].d: None | e: x"
    assert json_chunks(j.withColumn("data", F.lit('{"k": "' + body + '"}')), []).count() == 1
    odd = ['{"a": ', "", None, "[]", "7", '[1, {"a": {}}, []]', "[" * 100_000]
    texts = [r["t"] for r in spark.createDataFrame([(x,) for x in odd], "data string").select(json_text("data").alias("t")).collect()]
    assert texts == [None, None, None, "", "7", "1 | [1].a:  | ", None]
    rec = spark.createDataFrame(
        [("p", "pdf", [(1, body)], None, None, None), ("x", "excel", None, [("s", [{"a": body}])], None, None),
         ("j", "json", None, None, body, None), ("t", "text", None, None, None, body), ("i", "image", None, None, body, body)],
        "source_file string, file_type string, text_content array<struct<page:int,text:string>>, "
        "sheets array<struct<name:string,rows:array<map<string,string>>>>, data_text string, content string",
    )
    assert sorted(r["source_file"] for r in chunk_extractions(rec).collect()) == ["j", "p", "t", "x"]


def test_exact_duplicates_keep_the_first(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b")], "id long, text string")
    assert sorted(r["id"] for r in drop_exact_duplicates(df, "id").collect()) == [1, 2]


LINES = [
    (1, "ignored before the first header"), (1, "WATER EFFICIENCY (WE)"), (1, "Credit: Cooling Tower"), (1, "Intent"), (1, "Save"), (1, "  water "),
    (1, "Requirements"), (1, "- First"), (1, "Option 1. "), (1, "• way one"), (2, "WATER EFFICIENCY (WE)"), (2, "Submittals:"), (2, "- Plan"),
    (2, "Requirements"), (2, "way two"), (2, "OR"), (2, "way three"), (2, "1 - 4 points"), (2, "BD+C: Schools"), (3, "Intent"), (3, "Replaced"),
    (3, "This credit applies to"), (3, "- Schools"), (3, "not a bullet"), (5, "EA2 Prerequisite: Base"), (5, "ND rating"), (5, "Guidance"), (5, "tip"),
]


def test_credit_parser(spark):
    rows = [("d", p, i, t) for i, (p, t) in enumerate(LINES)]
    df = spark.createDataFrame(rows, "doc_id string, page int, line_no int, line string")
    a, b = parse_credits(df).orderBy("credit_no").collect()
    assert (a["category"], a["credit_code"], a["credit_name"], a["credit_type"]) == ("WATER EFFICIENCY (WE)", "WE", "Cooling Tower", "Credit")
    assert a["intent"] == "Replaced" and a["requirements"] == ["First"] and a["documentation"] == ["Plan"]
    assert [(o["heading"], o["lines"]) for o in a["options"]] == [
        ("Option 1.", ["way one", "WATER EFFICIENCY (WE)", "way two"]), ("OR", ["way three"])]
    assert (a["points_min"], a["points_max"], a["rating_system"], a["pages"]) == (1, 4, "BD+C: Schools", [1, 2, 3])
    assert a["applicability"] == ["Schools"] and a["validation_errors"] == []
    assert (b["credit_code"], b["credit_type"], b["credit_name"], b["pages"], b["guidance"]) == ("EA", "Prerequisite", "Base", [5], ["tip"])
    assert b["rating_system"] == "ND rating" and abs(b["completeness_score"] - 3 / 8) < 1e-9


def test_parser_state_crosses_blocks_of_pages(spark):
    rows = [("d", 1, 0, "EA Credit: X"), ("d", 1, 1, "Guidance")] + [("d", p, 0, f"line {p}") for p in (2, 1500, 3000, 5000)]
    df = spark.createDataFrame(rows, "doc_id string, page int, line_no int, line string").repartition(4)
    assert parse_credits(df).first()["guidance"] == [f"line {p}" for p in (2, 1500, 3000, 5000)]
    assert {r["section"] for r in classified_lines(df).filter("page > 1").collect()} == {"guidance"}


def test_running_equals_plain_windows(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice("ab"), p, i, rnd.randint(0, 3), rnd.choice([None, "x", "y"])) for p in range(0, 6000, 400) for i in range(4)]
    df = spark.createDataFrame(rows, "k string, page int, i int, v int, s string")
    out = running(df, ["k"], [F.col("page"), F.floor(F.col("page") / 1024)], ["page", "i"], {"total": F.col("v")}, {"last": F.col("s")})
    got = {(r["k"], r["page"], r["i"]): (r["total"], r["last"]) for r in out.collect()}
    for k in "ab":
        total, last = 0, None
        for r in sorted((x for x in rows if x[0] == k), key=lambda x: (x[1], x[2])):
            total, last = total + r[3], r[4] or last
            assert got[(k, r[1], r[2])] == (total, last)


def test_hot_key_join_matches_plain_join(spark):
    left = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 2500).alias("k"))
    right = left.filter("k <> 7").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("m"))
    for how in ("inner", "left"):
        got = sorted(map(tuple, join_to_unique(left, right, "k", "n", ["id"], how).select("id", F.coalesce("m", F.lit(-9)).alias("m")).collect()))
        want = sorted(map(tuple, left.join(right.select("k", "m"), "k", how).select("id", F.coalesce("m", F.lit(-9))).collect()))
        assert got == want


GOLDEN = [
    "EA Minimum Energy Performance requirements LEED v4.1 BD+C", "EA Optimize Energy Performance requirements thresholds",
    "energy performance prerequisite baseline ASHRAE Appendix G", "EA Minimum Energy Performance requirements LEED v4.1",
    "EA Optimize Energy Performance requirements LEED v4.1", "energy performance ASHRAE 90.1 requirements LEED v4.1",
]


def test_expansion(spark):
    q = spark.createDataFrame([(1, "energy efficiency requirements"), (2, "  "), (3, "LEED EA points"), (4, "plain leed words")], "query_id long, text string")
    got = {}
    for r in expand_queries(q).orderBy("query_id", "sub_no").collect():
        got.setdefault(r["query_id"], []).append(r["sub_query"])
    assert got[1] == GOLDEN and got[2] == [""] and 4 not in got
    assert got[3] == ["EA credit LEED v4.1 BD+C", "EA requirements thresholds", "LEED EA points thresholds points"]
    used = {r["query_id"]: r["sub_query"] for r in search_queries(q).filter("query_id = 4").collect()}
    assert used == {4: "plain leed words"}
    s = spark.createDataFrame([("power",), ("LEED x",)], "t string").select(with_synonyms(F.col("t")).alias("s"), with_domain_word(F.col("t")).alias("d")).collect()
    assert s[0]["s"] == "power water efficiency WE credits" and s[0]["d"] == "LEED power" and s[1]["d"] == "LEED x"


def test_evidence_decisions(spark):
    ev = spark.createDataFrame(
        [(1, 1, [1.0, 0.0], True), (2, 1, [0.0, 1.0], True), (3, 2, [1.0, 0.0], True), (4, 1, [1.0, 0.0], False)],
        "evidence_id long, query_id long, vector array<double>, has_text boolean",
    )
    ctx = spark.createDataFrame([(1, 1, [1.0, 0.0], "t1", "s"), (1, 2, [1.0, 0.1], "t2", "s")], "query_id long, rank int, vector array<double>, text string, source string")
    got = {r["evidence_id"]: r for r in decisions(ev, ctx).collect()}
    assert got[1]["decision"] == "supported" and got[1]["confidence"] == 1.0 and got[1]["top_chunk"] == "t1"
    assert got[2]["decision"] == "insufficient" and got[3]["decision"] == "unknown" and got[4]["decision"] == "unknown"


def test_key_facts_and_template_defaults(spark):
    text = "Head\nIntent: Save water\nRequirement one\n- a\n- b\n- c. " + "A longer sentence that counts as a key point. no."
    hits = spark.createDataFrame([(1, 1, text, "WE", None, "w"), (1, 2, "x", None, "Name", "w"), (1, 3, "y", "WE", None, "w")],
                                 "query_id long, rank int, text string, credit_code string, credit_name string, category string")
    k = key_facts(hits).first()
    assert (k["primary_credit"], k["intent"], k["related_credits"]) == ("WE", "Save water", ["Name"])
    assert k["requirements"] == ["Requirement one", "- a", "- b"] and len(k["key_points"]) == 2
    t = fill_template(spark.createDataFrame([(None, None, "", None, [])], "credit_code string, credit_name string, intent string, requirements array<string>, documentation array<string>")).first()
    assert t["title"] == "LEED Credit – Unspecified" and len(t["requirements"]) == 1 and len(t["qa"]) == 3


def test_training_rows(spark):
    pages = spark.createDataFrame([("f", 1, "Owners must provide a long plan here.\nshort must\nEA Credit Energy: Do this well. And a second sentence that is long enough to keep.")],
                                  "source_file string, page int, text string")
    qa = qa_pairs(pages).collect()
    assert len(qa) == 5 and qa[0]["question"] == "What is EA Credit: Energy?" and qa[0]["citation"]["page"] == 1
    assert [r["line_no"] for r in evidence_rows(pages).collect()] == [0]
    cites = citation_rows(pages).collect()
    assert all(30 <= len(r["statement"]) <= 300 for r in cites) and cites[0]["citation_format"] == "[f, p.1]"


def test_relevance_rules(spark):
    q = spark.createDataFrame([(1, ["Energy", "EA"]), (2, []), (3, ["x"])], "query_id long, expected_topics array<string>")
    hits = spark.createDataFrame([(1, 1, "energy use", "EA", None), (2, 1, "t", None, None)], "query_id long, rank int, text string, credit_code string, category string")
    got = {r["query_id"]: r["relevance"] for r in query_relevance(q, hits).collect()}
    assert got == {1: 0.7, 2: 0.5, 3: 0.0}
    assert len(EVALUATION_QUERIES) == 8 and len(SMOKE_QUERIES) == 26


def test_credit_sections_skip_empty_lists(spark):
    empty = spark.read.schema(CREDIT).json(spark.createDataFrame([('{"credit_code": "EA", "credit_type": "Credit", "points_min": 0}',)], "v string").select("v").rdd.map(lambda r: r[0]))
    got = credit_sections(empty).collect()
    assert [(r["section"], r["text"]) for r in got] == [("thresholds", "EA Credit: None\n\nPoints: 0")]
    assert got[0]["version"] == "v4.1" and got[0]["project_types"] == ["NC"] and got[0]["chunk_id"] == "EA-c1-thresholds-0"
