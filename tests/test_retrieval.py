"""Retrieval operators against plain restatements of their rules."""

import math
import random

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attesta.operators.dense import dense_topk
from attesta.operators.fusion import rrf, rrf_two_lists, score_filter, weighted_fusion
from attesta.operators.grouping import group_by_credit, near_duplicates_in_lists, near_duplicates_in_table, pick_sections
from attesta.operators.lexical import bm25_search, lexical_index
from attesta.plans.index import StoredIndex, read_index, search_index, with_all_source, write_index
from attesta.plans.search import analyze_projects, credit_queries, route_sources, search, search_once

FEW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def test_bm25_hand_values(spark):
    docs = {1: "red red blue", 2: "blue green", 3: "blue", 4: "blue grey grey"}
    chunks = spark.createDataFrame([("a", k, v) for k, v in docs.items()], "source string, chunk_id long, text string")
    queries = spark.createDataFrame([(1, "red red grey blue"), (2, "nothing")], "query_id long, text string")
    got = {(r["query_id"], r["chunk_id"]): r["score"] for r in bm25_search(queries, lexical_index(chunks)).collect()}
    toks = {k: v.split() for k, v in docs.items()}
    n, avgdl = 4, sum(map(len, toks.values())) / 4
    df = {t: sum(t in w for w in toks.values()) for t in {t for w in toks.values() for t in w}}
    idf = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: v if v >= 0 else 0.25 * mean for t, v in idf.items()}
    for k, w in toks.items():
        want = sum(idf[t] * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / avgdl)) for t in "red red grey blue".split())
        assert (abs(got[(1, k)] - want) < 1e-5) if want > 0 else (1, k) not in got
    assert not any(q == 2 for q, _ in got)


def test_dense_plans_agree_and_are_exact(spark):
    rng = np.random.default_rng(1)
    vecs = rng.normal(size=(300, 8)).astype("float32")
    vecs[5] = vecs[6]  # a tie
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "vec_id long, embedding array<float>").repartition(5)
    queries = spark.createDataFrame([(i, vecs[i].tolist()) for i in range(20)], "query_id long, embedding array<float>")
    a = sorted(map(tuple, dense_topk(queries, corpus, 4).select("query_id", "vec_id", "rank").collect()))
    b = sorted(map(tuple, dense_topk(queries, corpus, 4, query_rows=6).select("query_id", "vec_id", "rank").collect()))
    unit = vecs.astype("float64") / np.linalg.norm(vecs.astype("float64"), axis=1, keepdims=True)
    want = []
    for q in range(20):
        s = np.round(unit @ unit[q], 6)
        want += [(q, int(i), r + 1) for r, i in enumerate(np.lexsort((np.arange(300), -s))[:4])]
    assert a == b == sorted(want)


def _hits(spark, rows):
    return spark.createDataFrame(rows, "query_id long, chunk_id string, score double, rank int")


def test_weighted_fusion_cases(spark):
    dense = _hits(spark, [(1, "a", 0.9, 1), (1, "b", 0.5, 2), (1, "c", 0.1, 3), (2, "x", 0.4, 1), (3, "s", 0.5, 1), (3, "t", 0.5, 2)])
    lex = _hits(spark, [(1, "b", 8.0, 1), (1, "d", 4.0, 2), (3, "t", 7.0, 1)])
    got = {(r["query_id"], r["chunk_id"]): r for r in weighted_fusion(dense, lex, ["query_id"]).collect()}
    assert got[(1, "a")]["score"] == 0.7 and got[(1, "a")]["method"] == "dense" and got[(1, "a")]["rank"] == 1
    assert got[(1, "b")]["score"] == 0.65 and got[(1, "b")]["method"] == "hybrid"
    assert got[(1, "d")]["score"] == 0.0 and got[(1, "d")]["method"] == "lexical"
    assert got[(2, "x")]["score"] == 0.4  # one side empty: not rescaled
    assert got[(3, "s")]["score"] == 0.0 and got[(3, "t")]["score"] == 0.0  # all scores equal: range 1


def test_rrf_counts_repeats_and_keeps_single_lists(spark):
    rows = [(1, 1, "a", 0.9, 1), (1, 1, "b", 0.8, 2), (1, 1, "a", 0.7, 3), (1, 2, "b", 0.95, 1), (2, 1, "z", 0.3, 1), (2, 1, "y", 0.9, 2)]
    lists = spark.createDataFrame(rows, "query_id long, list_no int, chunk_id string, score double, rank int")
    got = {(r["query_id"], r["chunk_id"]): r for r in rrf(lists, ["query_id"]).collect()}
    assert abs(got[(1, "a")]["score"] - (1 / 61 + 1 / 63)) < 1e-8 and abs(got[(1, "b")]["score"] - (1 / 62 + 1 / 61)) < 1e-8
    assert got[(1, "b")]["original_score"] == 0.95 and got[(1, "b")]["rank"] == 1
    assert got[(2, "z")]["score"] == 0.3 and got[(2, "z")]["rank"] == 1


@FEW
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 6)), min_size=1, max_size=20))
def test_rrf_property(spark, picks):
    lists, rows = {0: [], 1: []}, []
    for lst, key in picks:
        lists[lst].append(key)
        rows.append((1, str(key), float(key), len(lists[lst]), lst))
    df = spark.createDataFrame(rows, "query_id long, chunk_id string, score double, rank int, list_no int")
    got = rrf_two_lists(df.filter("list_no = 0"), df.filter("list_no = 1"), ["query_id"]).orderBy("rank").collect()
    want = {}
    for lst in (0, 1):
        for pos, key in enumerate(lists[lst], 1):
            want[str(key)] = want.get(str(key), 0) + 1 / (60 + pos)
    assert {r["chunk_id"]: r["score"] for r in got} == {k: round(v, 9) for k, v in want.items()}
    assert [r["rank"] for r in got] == list(range(1, len(want) + 1))
    assert [r["score"] for r in got] == sorted((r["score"] for r in got), reverse=True)


def test_score_filter_falls_back(spark):
    h = _hits(spark, [(1, "a", 0.9, 1), (1, "b", 0.2, 2)] + [(2, str(i), 0.01, i) for i in range(1, 6)])
    got = sorted((r["query_id"], r["rank"]) for r in score_filter(h, ["query_id"], 2).collect())
    assert got == [(1, 1), (2, 1), (2, 2), (2, 3), (2, 4)]


def _restated_near_dups(rows, threshold):
    firsts, kept, seen = {}, [], set()
    for r in rows:
        k1, k2 = r["k1"], r["k2"]
        if k1 is not None and k1 in firsts:
            a, b = np.array(r["vector"]), np.array(firsts[k1])
            if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold:
                continue
        elif k1 is not None:
            firsts[k1] = r["vector"]
        if k2 is not None:
            if k2 in seen:
                continue
            seen.add(k2)
        kept.append(r["rank"])
    return kept


def test_near_duplicates_match_the_rule_on_random_lists(spark):
    rnd = random.Random(3)
    rows = []
    for q in range(40):
        for rank in range(1, 11):
            credit = rnd.choice(["A", "A", "B", None])
            doc = rnd.choice(["d1", "d2", None])
            page = rnd.choice([1, 2, None])
            vector = [rnd.choice([1.0, 0.9, 0.0]), rnd.choice([1.0, 0.5]), 0.2]
            rows.append((q, rank, credit, "s", doc, page, page, vector))
    schema = "query_id long, rank int, credit_id string, section string, doc string, page_start int, page_end int, vector array<double>"
    df = spark.createDataFrame(rows, schema)
    got = {}
    for r in near_duplicates_in_lists(df, ["query_id"]).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["rank"])
    table_got = {}
    one = df.filter("query_id = 0")
    for r in near_duplicates_in_table(one, "rank").orderBy("rank").collect():
        table_got.setdefault(0, []).append(r["rank"])
    for q in range(40):
        mine = [
            {"rank": r[1], "k1": f"{r[2]}::s" if r[2] else None, "k2": f"{r[4]}::{r[5]}" if r[4] and r[5] else None, "vector": r[7]}
            for r in rows if r[0] == q
        ]
        assert got[q] == _restated_near_dups(mine, 0.97)
        if q == 0:
            assert table_got[0] == got[0]


def test_section_pick_prefers_priority_then_score(spark):
    rows = [(1, "c1", "definitions", 0.9, 1), (1, "c2", "requirements", 0.3, 2), (1, "c3", "requirements", 0.2, 3), (1, "c4", "odd", 0.8, 4), (1, "c5", "definitions", 0.85, 5)]
    df = spark.createDataFrame(rows, "query_id long, chunk_id string, section string, score double, rank int")
    got = [r["chunk_id"] for r in pick_sections(df, ["query_id"], 4).orderBy("pick").collect()]
    assert got == ["c2", "c1", "c4", "c5"]


def test_group_by_credit_ranks_are_contiguous(spark):
    rows = [(1, f"c{i}", f"cr{i % 4}" if i % 5 else None, "intent", 1.0 - i / 20, i) for i in range(1, 15)]
    df = spark.createDataFrame(rows, "query_id long, chunk_id string, credit_id string, section string, score double, rank int")
    got = group_by_credit(df, ["query_id"], 3, 2).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, len(got) + 1)) and len({r["credit"] for r in got}) == 3


def test_source_routing(spark):
    q = spark.createDataFrame([(1, ["a", "zz"]), (2, ["zz"]), (3, None)], "query_id long, sources array<string>")
    assert [r["used_sources"] for r in route_sources(q, ["a", "all"]).orderBy("query_id").collect()] == [["a"], ["all"], ["all"]]
    assert [r["used_sources"] for r in route_sources(q, ["b", "a"]).orderBy("query_id").collect()] == [["a"], ["b"], ["b"]]


def test_stored_index_gives_the_same_search(spark, sf, tmp_path):
    from attesta.queries.inputs import topic_queries, window_chunks

    lazy = search_index(window_chunks(spark, sf))
    write_index(lazy, str(tmp_path / "index"))
    queries = topic_queries(spark, sf)
    cols = ["query_id", "chunk_id", "score", "rank"]
    a = sorted(map(tuple, search(queries, lazy, 5).select(cols).collect()))
    b = sorted(map(tuple, search(queries, read_index(spark, str(tmp_path / "index")), 5).select(cols).collect()))
    assert a == b and a
    per_query = {}
    for q, c, _, rank in a:
        per_query.setdefault(q, []).append((rank, c))
    for hits in per_query.values():
        assert sorted(r for r, _ in hits) == list(range(1, len(hits) + 1)) and len({c for _, c in hits}) == len(hits) <= 5


def test_routed_search_over_several_sources(spark, sf):
    from attesta.queries.inputs import passages, window_chunks

    chunks = window_chunks(spark, sf, F.col("credit_id"))
    asked = passages(spark, sf).withColumn("sources", F.array(F.lit("src1"), F.lit("src2")))
    known = [f"src{i}" for i in range(20)]
    hits = search(route_sources(asked, known), search_index(chunks), 4).select("source", "query_id").distinct().collect()
    assert {r["source"] for r in hits} <= {"src1", "src2"} and len({r["source"] for r in hits}) == 2


WORDS = [f"w{i}" for i in range(40)]


def _texts(n, seed):
    rng = random.Random(seed)
    return [" ".join(WORDS[min(39, int(rng.expovariate(0.12)))] for _ in range(rng.randint(0, 30))) for _ in range(n)]


def _plain_bm25(texts, asked, k):
    toks = [t.split() for t in texts]
    avgdl = sum(map(len, toks)) / len(toks)
    df = {w: sum(w in t for t in toks) for w in {w for t in toks for w in t}}
    idf = {w: math.log(len(toks) - f + 0.5) - math.log(f + 0.5) for w, f in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: v if v >= 0 else 0.25 * mean for w, v in idf.items()}
    out = []
    for q, text in enumerate(asked):
        hits = []
        for c, t in enumerate(toks):
            s = sum(idf.get(w, 0) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avgdl)) for w in text.split())
            if round(s, 6) > 0:
                hits.append((-round(s, 6), c))
        out += [(q, c, r + 1) for r, (_, c) in enumerate(sorted(hits)[:k])]
    return out


def test_bm25_blocks_are_exact(spark, monkeypatch):
    from attesta.operators import blocks

    texts, asked = _texts(400, 1), _texts(30, 2)
    texts[7:60] = [texts[7]] * 53  # ties beyond k
    chunks = spark.createDataFrame([("a", i, t) for i, t in enumerate(texts)], "source string, chunk_id long, text string").repartition(3)
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    want = _plain_bm25(texts, asked, 6)
    for rows, asks in ((512, 256), (16, 7)):
        monkeypatch.setattr(blocks, "CHUNK_ROWS", rows)
        monkeypatch.setattr(blocks, "QUERY_ROWS", asks)
        got = bm25_search(queries, lexical_index(chunks), 6).select("query_id", "chunk_id", "rank").collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_rows_that_leave_the_tasks_follow_k_not_pairs(spark):
    from attesta.operators.lexical import bm25_candidates

    chunks = spark.createDataFrame([("a", i, t) for i, t in enumerate(_texts(2000, 3))], "source string, chunk_id long, text string").coalesce(2)
    queries = spark.createDataFrame(list(enumerate(_texts(50, 4))), "query_id long, text string")
    index = lexical_index(chunks)
    assert bm25_candidates(queries, index, 3).count() <= 3 * 50 * index.rows.rdd.getNumPartitions()


def test_all_source_equals_chunks_stored_twice(spark):
    rows = [("ab"[i % 2], i, t) for i, t in enumerate(_texts(100, 5))]
    chunks = spark.createDataFrame(rows, "source string, chunk_id long, text string")
    queries = spark.createDataFrame(list(enumerate(_texts(10, 6))), "query_id long, text string")
    once = bm25_search(queries, lexical_index(chunks, all_source="all"), 4)
    twice = bm25_search(queries, lexical_index(with_all_source(chunks)), 4)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.select(once.columns).collect()))


def test_index_changes_equal_a_rebuild(spark, tmp_path):
    texts = _texts(90, 7)
    chunks = spark.createDataFrame([("ab"[i % 2], i, t) for i, t in enumerate(texts)], "source string, chunk_id long, text string")
    index = StoredIndex(spark, str(tmp_path / "index"), all_source="all")
    index.add(chunks.filter("chunk_id < 50"))
    index.add(chunks.filter("chunk_id >= 50"))
    index.remove(chunks.filter("chunk_id % 4 = 1 OR source = 'zz'"))
    index.add(chunks.filter("chunk_id = 5"))  # once more
    index.remove(chunks.filter("chunk_id = 77"))
    kept = chunks.filter("chunk_id % 4 <> 1 OR chunk_id = 5")
    now, fresh = index.read(), lexical_index(kept, all_source="all")
    lists = lambda df: sorted(map(repr, df.collect()))
    assert lists(now.chunks.select("source", "chunk_id", "text")) == lists(kept)
    assert lists(now.lexical.rows.select(fresh.rows.columns)) == lists(fresh.rows)
    assert lists(now.lexical.terms.select(fresh.terms.columns)) == lists(fresh.terms)
    a, b = ({r.source: r for r in x.select("source", "n_docs", "n_words", "avgdl", "mean_idf").collect()} for x in (now.lexical.stats, fresh.stats))
    assert a.keys() == b.keys() == {"a", "b", "all"}
    assert all(a[s][:4] == b[s][:4] and abs(a[s].mean_idf - b[s].mean_idf) < 1e-9 for s in a)
    queries = spark.createDataFrame(list(enumerate(_texts(10, 8))), "query_id long, text string")
    hits = [bm25_search(queries, x, 5).select("query_id", "source", "chunk_id", "rank") for x in (now.lexical, fresh)]
    assert lists(hits[0]) == lists(hits[1])


META = "source string, chunk_id long, text string, credit_id string, section string, doc string, page_start int, page_end int, vector array<double>"


def test_given_vectors_reach_search_and_near_duplicates(spark):
    rows = [("a", i, f"solar roof number{i}", f"C{i // 4}", "requirements", f"d{i}", 1, 1, [1.0, float(i // 2), 0.0] if i != 5 else None) for i in range(12)]
    chunks = spark.createDataFrame(rows, META)
    queries = spark.createDataFrame([(1, "solar roof", [1.0, 2.0, 0.0]), (2, "solar roof", None)], "query_id long, text string, vector array<double>")
    index = search_index(chunks, vector="vector")
    hits = search(queries, index, 4, group=False, expand=False).collect()
    top = [h.chunk_id for h in sorted(hits, key=lambda h: h["rank"]) if h.query_id == 1]
    assert top[0] == 4 and len(top) == 4  # 4 has the query's vector (5 has none)
    assert any(h.query_id == 2 for h in hits)  # found by words only
    grouped = search(queries.filter("query_id = 1"), index, 6, expand=False).collect()
    assert grouped and len({h.chunk_id for h in grouped}) == len(grouped) and "vector" not in grouped[0].asDict()
    # equal vectors of one credit and section are near-duplicates: one of 0 and 1, one of 2 and 3
    assert not {2, 3} <= {h.chunk_id for h in grouped} and not {0, 1} <= {h.chunk_id for h in grouped}


def test_embed_makes_vectors_of_chunks_and_queries(spark):
    def embed(text):
        return F.array(F.length(F.regexp_replace(text, "[^s]", "")).cast("double"), F.length(F.regexp_replace(text, "[^r]", "")).cast("double"))

    chunks = spark.createDataFrame([(s, c, t, "C", "x", "d", c, c, None) for s, c, t in [("a", 1, "sss r"), ("a", 2, "r rrr rr"), ("a", 3, None)]], META).drop("vector")
    queries = spark.createDataFrame([(1, "LEED rrrr rr")], "query_id long, text string")
    hits = search(queries, search_index(chunks, embed=embed), 2, group=False, expand=False).collect()
    assert next(h.chunk_id for h in hits if h["rank"] == 1) == 2


def test_rrf_method_and_chunk_text(spark):
    from attesta.functions.text import chunk_text

    chunks = spark.createDataFrame(
        [("a", 1, "plain words", "EAc1", "requirements", "d", 1, 1, None), ("a", 2, "other words here", "WEc2", "intent", "d", 2, 2, None)], META
    ).drop("vector")
    queries = spark.createDataFrame([(1, "EAc1 words")], "query_id long, text string")
    index = search_index(chunks, lexical_text=chunk_text({c: F.col(c) for c in chunks.columns}))
    hits = search(queries, index, 2, group=False, expand=False, method="rrf").collect()
    assert next(h.chunk_id for h in hits if h["rank"] == 1) == 1


def test_rows_go_to_scoring_one_by_one(spark, monkeypatch):
    """Spark cuts Arrow batches by rows: a row that holds a block of chunks makes batches of gigabytes."""
    from pyspark.sql import DataFrame

    from attesta.operators import blocks
    from attesta.operators.lexical import bm25_candidates

    chunks = spark.createDataFrame([("s", i, f"a w{i % 7} w{i % 11}") for i in range(300)], "source string, chunk_id long, text string")
    queries = spark.createDataFrame([(i, f"a w{i} w{i + 1}") for i in range(40)], "query_id long, text string")
    index = lexical_index(chunks)
    want = sorted(bm25_search(queries, index, 3).collect())
    given, plain = [], type(chunks).mapInArrow
    monkeypatch.setattr(type(chunks), "mapInArrow", lambda self, *a, **k: given.append(self.schema) or plain(self, *a, **k))
    monkeypatch.setattr(blocks, "PASS_ROWS", 8)
    hits = bm25_search(queries, index, 3)
    kinds = [s["terms"].dataType.simpleString() for s in given if "terms" in s.names and "chunk_id" in s.names]
    assert kinds and set(kinds) == {"array<string>"}
    assert sorted(hits.collect()) == want
    assert bm25_candidates(queries, index, 3).count() and isinstance(hits, DataFrame)


def test_workers_get_few_rows_at_once(spark):
    """Spark's default of 10,000 rows of words, or a session's larger one, would fill the Python workers."""
    import pyarrow as pa

    from attesta.operators.lexical import bm25_candidates
    from attesta.session import ARROW_ROWS, BATCH_ROWS, written

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    counted = spark.range(0, 3500, 1, 1).mapInArrow(sizes, "n long")
    before = spark.conf.get(ARROW_ROWS)
    assert [r.n for r in written(counted).collect()] == [3500]
    for own, want in (("100000", BATCH_ROWS), ("0", BATCH_ROWS), ("500", 500)):
        spark.conf.set(ARROW_ROWS, own)
        try:
            got = [r.n for r in written(counted, BATCH_ROWS).collect()]
            assert max(got) == want and sum(got) == 3500 and spark.conf.get(ARROW_ROWS) == own
        finally:
            spark.conf.set(ARROW_ROWS, before)
    chunks = spark.createDataFrame([("s", i, f"a w{i % 7}") for i in range(30)], "source string, chunk_id long, text string")
    hits = bm25_candidates(spark.createDataFrame([(1, "w3")], "query_id long, text string"), lexical_index(chunks), 3)
    # the scoring is done, within that bound, when the hits are returned
    assert "MapInArrow" not in hits._jdf.queryExecution().toString() and hits.count() > 0


def test_workers_get_few_bytes_at_once(spark):
    """1,000 long texts would fill the Python workers, as 10,000 shorter ones do; a row above the bound comes alone."""
    import pyarrow as pa

    from attesta.session import ARROW_BYTES, BATCH_BYTES, BATCH_ROWS, written

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]})

    row = 1 << 20
    texts = spark.range(0, 40, 1, 1).select(F.repeat(F.lit("w "), row // 2).alias("text")).mapInArrow(sizes, "n long, size long")
    before = spark.conf.get(ARROW_BYTES)
    for own, most in (("64m", BATCH_BYTES), ("3m", 3 * row)):
        spark.conf.set(ARROW_BYTES, own)
        try:
            got = written(texts, BATCH_ROWS).collect()
            assert max(r["size"] for r in got) <= most + 2 * row and sum(r.n for r in got) == 40 and spark.conf.get(ARROW_BYTES) == own
        finally:
            spark.conf.set(ARROW_BYTES, before)
    longer = spark.range(0, 3, 1, 1).select(F.repeat(F.lit("w "), BATCH_BYTES).alias("text")).mapInArrow(sizes, "n long, size long")
    assert [r.n for r in written(longer, BATCH_ROWS).collect()] == [1, 1, 1]


def test_removal_takes_ids_to_the_rows_and_counts_only(spark, tmp_path, monkeypatch):
    """Vectors of removed chunks are not moved, and the ids are a table of their own, so that few of them are broadcast."""
    from attesta.operators.lexical import term_counts
    from attesta.plans import index as plans

    rows = [("s", i, f"a a w{i % 3}") for i in range(12)] + [("t", 50, None), (None, 51, "a")]
    store = StoredIndex(spark, str(tmp_path / "index"))
    store.add(spark.createDataFrame(rows, "source string, chunk_id long, text string"))
    given, plain = [], plans.written
    monkeypatch.setattr(plans, "written", lambda df, *a: given.append(df.columns) or plain(df, *a))
    store.remove(spark.createDataFrame([("s", 1), ("s", 4), ("zz", 5)], "source string, chunk_id long"))
    assert given == [["source", "chunk_id"], ["source", "chunk_id", "dl", "terms", "tfs"]]
    counts = term_counts(store.read().lexical.rows)
    assert "arrays_zip" not in counts._jdf.queryExecution().toString()
    got = {(r.source, r.term): (r.df, r.cf) for r in counts.collect()}
    # words of a single letter are no terms
    assert got == {("s", None): (10, 10), ("s", "w0"): (4, 4), ("s", "w1"): (2, 2), ("s", "w2"): (4, 4), ("t", None): (1, 0), (None, None): (1, 0)}


def _project_chunks(spark):
    words = ["EA", "WE", "credit", "requirements", "projects", "NC", "CS", "prerequisite"]
    rng = random.Random(9)
    rows = [("all", i, " ".join(rng.choices(words, k=8)), f"C{i % 5}", "requirements", f"d{i}", 1, 1, None) for i in range(60)]
    return spark.createDataFrame(rows, META).drop("vector")


def test_equal_questions_of_projects_are_searched_once(spark, monkeypatch):
    """Projects of one type ask the same: the search is given each question once, however many projects there are."""
    from attesta.plans import search as plans

    index = search_index(_project_chunks(spark))
    rows = [(i, "NC" if i % 3 else "CS", ["EA", "WE"] if i % 2 else ["EA"]) for i in range(200)] + [(500, "own type", ["EA"]), (501, None, ["WE"])]
    projects = spark.createDataFrame(rows, "project_id long, project_type string, target_credits array<string>")
    asked = credit_queries(projects)
    given, plain = [], plans.search
    want = asked.withColumnRenamed("text", "query").join(plain(asked.select("query_id", "text"), index, 3), "query_id", "left")
    monkeypatch.setattr(plans, "search", lambda queries, *a, **o: given.append(queries.count()) or plain(queries, *a, **o))
    got = analyze_projects(projects, index, 3)
    assert given == [5]  # EA and WE for NC, EA and WE for CS, EA for the own type
    assert sorted(map(repr, got.drop("compliance_status").collect())) == sorted(map(repr, want.collect()))
    assert got.filter("chunk_id IS NOT NULL").select("query_id").distinct().count() == asked.count()


def test_ids_with_several_rows_or_none_keep_their_hits(spark):
    """All rows of a query id are one question; the id may be null, and so may its text."""
    index = search_index(_project_chunks(spark))
    a, b = "EA requirements", "WE credit projects"
    rows = [("1", a), ("2", a), ("3", a), ("3", b), ("4", b), ("4", a), ("5", a), ("5", a), ("6", a), ("6", a), ("7", b), (None, b), (None, a), ("8", None), ("9", None), ("9", a), ("10", "")]
    queries = spark.createDataFrame(rows, "query_id string, text string").repartition(4)
    for options in ({}, {"group": False, "expand": False}):
        want, got = (sorted(map(repr, f(queries, index, 4, **options).collect())) for f in (search, search_once))
        assert got == want and got
    routed = queries.withColumn("used_sources", F.when(F.col("text") == a, F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("none"))))
    want, got = (sorted(map(repr, f(routed, index, 4).collect())) for f in (search, search_once))
    assert got == want and got


def test_only_vectors_of_hits_are_shuffled(spark):
    index = search_index(_project_chunks(spark))
    hits = search(spark.createDataFrame([(1, "EA requirements")], "query_id long, text string"), index, 3).select("chunk_id", "score")
    assert "left semi" in hits._jdf.queryExecution().toString().lower().replace("leftsemi", "left semi")
