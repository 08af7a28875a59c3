"""Cases beside the main path: repeated keys, lists without rows, null vectors, far latitudes, missing folders."""

import re

import pytest
from pyspark.sql import functions as F

from attesta import session
from attesta.operators.dense import dense_topk
from attesta.operators.fusion import rrf, score_filter
from attesta.operators.matching import stops_near_sites
from attesta.plans.scorecards import compliance_summary


def test_repeated_credit_counts_once(spark):
    projects = spark.createDataFrame([(1, 2), (2, 1)], "project_id long, n_targets int")
    scores = spark.createDataFrame([(1, "a", 5, 1), (1, "a", 3, 2), (1, "b", 2, 1)], "project_id long, credit string, points int, score_no int")
    got = {r["project_id"]: r for r in compliance_summary(projects, scores).collect()}
    assert (got[1]["total_points"], got[1]["credits_achieved"], got[1]["credit_details"]) == (5, 2, {"a": 3, "b": 2})
    assert got[2]["total_points"] == 0
    most = compliance_summary(projects, scores.drop("score_no")).filter("project_id = 1").first()
    assert most["total_points"] == 7


def test_one_list_is_decided_by_what_was_asked(spark):
    rows = [(1, 1, 2, "x", 0.9, 1), (1, 1, 2, "y", 0.5, 2), (2, 1, 1, "x", 0.9, 1)]
    lists = spark.createDataFrame(rows, "query_id long, list_no int, n_lists int, chunk_id string, score double, rank int")
    fused = rrf(lists, ["query_id"])
    got = {(r["query_id"], r["chunk_id"]): r["score"] for r in fused.collect()}
    assert got[1, "x"] == round(1 / 61, 9) and got[1, "y"] == round(1 / 62, 9) and got[2, "x"] == 0.9
    kept = score_filter(fused, ["query_id"], 1, 0.3).collect()
    assert len([r for r in kept if r["query_id"] == 1]) == 2


def test_null_vectors_take_no_part(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0]), (None, [1.0, 1.0]), (4, [1.0, None])], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(7, [1.0, 0.1]), (8, None)], "query_id long, embedding array<double>")
    assert [(r["query_id"], r["vec_id"]) for r in dense_topk(queries, corpus, 5).orderBy("rank").collect()] == [(7, 1), (7, 3)]


def test_mixed_widths_are_refused(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.5, 0.5])], "vec_id long, embedding array<double>").coalesce(1)
    queries = spark.createDataFrame([(7, [1.0, 0.1])], "query_id long, embedding array<double>")
    with pytest.raises(Exception, match="widths"):
        dense_topk(queries, corpus, 1).collect()


@pytest.mark.parametrize(("lat", "lon", "slat", "slon", "near"), [
    (80.0, 10.0, 80.0, 10.0398, 1), (80.0, 10.0, 80.0, 10.06, 0), (0.0, 179.999, 0.0, -179.999, 1), (89.9995, 0.0, 89.9995, 180.0, 1),
    (-80.0, -179.98, -80.0, 179.99, 1), (10.0, 20.0, 10.0, 20.1, 0),
])
def test_stops_anywhere(spark, lat, lon, slat, slon, near):
    sites = spark.createDataFrame([(1, lat, lon)], "site_id long, lat double, lon double")
    stops = spark.createDataFrame([(slat, slon, 9, True), (None, None, 1, True)], "lat double, lon double, frequency int, weekend boolean")
    assert stops_near_sites(sites, stops, 800.0).first()["n_stops"] == near


class _Cluster:
    """A context on a cluster that names no shared folder."""

    master = "spark://host:7077"

    def getCheckpointDir(self):
        return None

    def getConf(self):
        return {}

    def setCheckpointDir(self, path):
        raise AssertionError("a machine-local folder was taken")


def test_clusters_need_a_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(type("Session", (), {"sparkContext": _Cluster()})())


def test_written_tables_can_be_removed(spark):
    import os

    df = session.written(spark.range(3))
    path = session._WRITTEN[-1][1].removeprefix("file:")
    assert df.count() == 3 and os.path.isdir(path)
    session.remove_written()
    assert not os.path.isdir(path)


def test_hot_keys_are_spread_over_partitions(spark):
    from attesta.operators.skew import join_to_unique

    key = F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 3 == 1, F.col("id")).cast("long")
    left = spark.range(30_000).select(key.alias("k"), F.col("id").alias("v"))
    right = left.filter("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("m"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = join_to_unique(left, right, "k", "n", ["v"], how="left")
        # rows of the hot key and rows without one are shuffled by their salt too
        assert re.search(r"SortMergeJoin \[k#\d+L, _salt#\d+L\], \[_k#\d+L, _s#\d+L\]", joined._jdf.queryExecution().toString())
        assert joined.filter("m = 29997").count() == 10_001 and joined.filter("m is null and k is null").count() == 10_000
        assert joined.count() == 30_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
