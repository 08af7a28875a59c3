"""Sources, sinks, streams and score cards."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from attesta.operators.matching import (
    contained_candidates, contains_join, match_credit, metres_between, name_candidates, nearest_names, stops_near_sites, with_file_status,
)
from attesta.operators.parsing import with_quality
from attesta.plans.scorecards import (
    buildings_to_projects, certification_level, compliance_summary, energy_scores, high_priority, location_scores, transit_points, walk_points,
)
from attesta.session import table
from attesta.sources import readers as rd
from attesta.sources import writers as wr
from attesta.streaming.ingest import dedupe_stream, ingest_chunks, latest_scores, stored_hashes, stream_documents
from attesta.streaming.telemetry import session_counts, window_counts


def test_jsonl_reader_counts_bad_lines(spark, tmp_path):
    p = tmp_path / "c.jsonl"
    p.write_text('{"text": "a", "metadata": {"credit_code": "EA", "pages": [1]}}\n\n{broken\n{"text": "b"}\n')
    df = rd.read_jsonl(spark, str(p)).cache()
    assert df.filter("_bad IS NOT NULL").count() == 1
    assert sorted(r["text"] for r in rd.good_lines(df).collect()) == ["a", "b"]


def test_record_readers(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "x.json").write_text(json.dumps({"source_file": "x.pdf", "file_type": "pdf", "text_content": [{"page": 1, "text": "t"}]}, indent=1))
    e = rd.read_extractions(spark, str(tmp_path)).first()
    assert e["text_content"][0]["page"] == 1 and e["extraction_file"].endswith("deep/x.json")
    (tmp_path / "credits.jsonarray").write_text(json.dumps([{"credit_code": "EA", "requirements": ["r"]}, {"credit_code": "WE"}]))
    assert rd.read_credits(spark, str(tmp_path / "credits.jsonarray")).count() == 2
    (tmp_path / "b.jsonarray").write_text(json.dumps([{"building_name": "B", "square_footage": 10}]))
    assert rd.read_buildings(spark, str(tmp_path / "b.jsonarray")).first()["square_footage"] == 10


def test_files_text_and_pages(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é".encode("latin-1"))
    (tmp_path / "b.md").write_text("é", encoding="utf-8")
    (tmp_path / "c_extracted_1.json").write_text("{}")
    (tmp_path / "d.bin").write_bytes(b"x")
    assert sorted(r["path"].rsplit("/", 1)[1] for r in rd.discover_files(spark, str(tmp_path)).collect()) == ["a.txt", "b.md"]
    assert {r["content"] for r in rd.read_text_files(spark, str(tmp_path)).collect()} == {"é"}
    (tmp_path / "p.txt").write_text("head\n=== PAGE 1 ===\none\n=== PAGE 2 ===\n")
    got = rd.read_page_text(spark, str(tmp_path / "p.txt")).collect()
    assert sorted((r["page"], r["text"]) for r in got) == [(1, "1 ===\none"), (2, "2 ===")]


def test_page_marks_of_split_files(spark, tmp_path):
    rng = random.Random(6)
    texts = {}
    for name in "ab":
        lines = [rng.choice(["=== PAGE", "x === PAGE y === PAGE", "", "  words é of a line", "more"]) for _ in range(300)]
        texts[name] = "\n".join(lines) + "\n"
        (tmp_path / f"{name}.txt").write_text(texts[name], encoding="utf-8")
    whole = spark.createDataFrame(list(texts.items()), "source_file string, content string")
    want = sorted((r["source_file"], r["page"], r["text"]) for r in rd.split_page_marks(whole, ["source_file"]).collect())
    settings = {"spark.sql.files.maxPartitionBytes": "200", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        got = rd.read_page_text(spark, str(tmp_path)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r["source_file"][-5], r["page"], r["text"]) for r in got) == want and len(want) > 50


def test_meters_sheets_and_energy(spark, tmp_path):
    (tmp_path / "m.csv").write_text("Meter," + ",".join(f"M{i}" for i in range(1, 13)) + "\nGas," + ",".join(map(str, range(12))) + "\nshort,1\n")
    got = rd.read_meters(spark, str(tmp_path / "m.csv")).orderBy("month").collect()
    assert [r["value"] for r in got] == [float(i) for i in range(12)] and got[0]["meter"] == "Gas"
    lines = spark.createDataFrame([("f", 1, "Total Site Energy,5.5,x"), ("f", 2, "Total Source Energy,7"), ("f", 3, "Other,1")], "source_file string, line_no int, line string")
    e = rd.site_energy(lines, ["source_file"]).first()
    assert (e["total_site_energy"], e["total_source_energy"]) == (5.5, 7.0)
    (tmp_path / "sheets").mkdir()
    (tmp_path / "sheets" / "s1.csv").write_text("a,b\n" + "".join(f"{i},\n" for i in range(1200)))
    (tmp_path / "sheets" / "s2.csv").write_text('name,area,use\n"Hall, ""B""",5,x\nGym,7\n')
    rows = rd.read_sheets(spark, str(tmp_path / "sheets"))
    first = rows.filter("sheet_name = 's1'")
    assert first.count() == 1200 and first.filter("row_index = 3").first()["cells"] == {"a": "3", "b": ""}
    assert sorted(r["row_index"] for r in first.collect()) == list(range(1200))
    second = rows.filter("sheet_name = 's2'").orderBy("row_index").collect()
    assert [r["cells"] for r in second] == [{"name": 'Hall, "B"', "area": "5", "use": "x"}, {"name": "Gym", "area": "7", "use": ""}]


def test_sinks(spark, tmp_path):
    out = str(tmp_path)
    credits = with_quality(
        spark.createDataFrame(
            [("EA", "n", "c", "Credit", 1, 2, "i", ["r1", "r2"], ["d"], [], [4, 5])],
            "credit_code string, credit_name string, category string, credit_type string, points_min int, points_max int, intent string, "
            "requirements array<string>, documentation array<string>, related_credits array<string>, pages array<int>",
        )
    )
    wr.write_credit_csv(credits, out + "/csv")
    assert spark.read.option("header", True).csv(out + "/csv").first()["pages"] == "4, 5"
    wr.write_credit_report(credits, out + "/report")
    assert spark.read.option("header", True).csv(out + "/report/Requirements").count() == 2
    chunks = spark.createDataFrame([("a", "t1"), ("b", "t2")], "source string, text string")
    wr.write_chunks(chunks, out + "/chunks")
    wr.write_chunks(chunks, out + "/chunks_json", "json")
    assert spark.read.parquet(out + "/chunks").filter("source = 'a'").count() == 1 and spark.read.json(out + "/chunks_json").count() == 2
    wr.write_xml(chunks, out + "/xml")
    assert spark.read.format("xml").option("rowTag", "extraction").load(out + "/xml").count() == 2
    qa = chunks.withColumn("split", F.lit("train"))
    wr.write_training(qa, chunks, chunks, chunks.limit(1), out + "/train")
    assert spark.read.json(out + "/train/qa_pairs").first()["split"] == "train"
    wr.write_reports(spark.createDataFrame([(1, "# R\nx")], "project_id long, report string"), out + "/md")
    assert spark.read.text(out + "/md").count() == 2
    wr.write_results(spark.createDataFrame([(1, (2,))], "project_id long, summary struct<total_points:int>"), out + "/res")
    assert spark.read.json(out + "/res").first()["summary"]["total_points"] == 2


def test_streaming_ingest_keeps_each_text_once(spark, tmp_path):
    src, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    src.mkdir()
    body = "word " * 40
    (src / "a.json").write_text(json.dumps({"doc_id": 1, "source": "s", "text": body}) + "\n" + json.dumps({"doc_id": 2, "source": "s", "text": body}) + "\n")
    ingest_chunks(stream_documents(spark, str(src)), out, ck).awaitTermination()
    assert spark.read.parquet(out).count() == 1
    (src / "b.json").write_text(json.dumps({"doc_id": 3, "source": "s", "text": body}) + "\n" + json.dumps({"doc_id": 4, "source": "s", "text": body + "new"}) + "\n")
    ingest_chunks(stream_documents(spark, str(src)), out, ck).awaitTermination()
    stored = spark.read.parquet(out).collect()
    assert sorted(r["doc_id"] for r in stored) == [1, 4]
    # a bucket of the store is a folder: only those asked for are read
    assert len({r["bucket"] for r in stored}) == 2
    known = stored_hashes(spark, out, [stored[0]["bucket"]], 9)
    assert [r["text_md5"] for r in known.collect()] == [stored[0]["text_md5"]]
    assert len(known.select(F.input_file_name()).distinct().collect()) == 1
    assert stored_hashes(spark, out, [stored[0]["bucket"], stored[1]["bucket"]], 1).count() == 1  # of batch 0 only
    assert stored_hashes(spark, str(tmp_path / "nowhere"), [1], 9) is None


def _stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(path)


def _drain(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name).collect()


def test_late_rows_are_dropped_and_sessions_close(spark, tmp_path):
    def put(i, rows):
        (tmp_path / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(("ts", "user_id", "event_type", "value"), r))) for r in rows))
        time.sleep(0.05)

    put(0, [("2024-01-01 00:10:00", 1, "view", 1.0), ("2024-01-01 00:15:00", 1, "view", 1.0)])
    put(1, [("2024-01-01 06:00:00", 1, "view", 1.0)])
    put(2, [("2024-01-01 07:00:00", 2, "view", 1.0)])
    put(3, [("2024-01-01 00:20:00", 1, "view", 9.0)])  # too late: the watermark is at 05:00 by now
    put(4, [("2024-01-01 12:00:00", 2, "view", 1.0)])
    schema = "ts timestamp, user_id long, event_type string, value double"
    wins = _drain(window_counts(_stream(spark, str(tmp_path), schema), "1 hour"), "wins", "append")
    assert [(r["n"], r["total"]) for r in sorted(wins, key=lambda r: r["window_start"])][:1] == [(2, 2.0)]
    sess = _drain(session_counts(_stream(spark, str(tmp_path), schema), "30 minutes"), "sess", "append")
    assert sorted(r["n"] for r in sess if r["user_id"] == 1)[-1] == 2


def test_stream_dedupe(spark, tmp_path):
    for i, text in enumerate(["a", "a", "b"]):
        (tmp_path / f"{i}.json").write_text(json.dumps({"ts": f"2024-01-01 00:0{i}:00", "chunk_hash": "same", "text": text}))
        time.sleep(0.05)
    got = _drain(dedupe_stream(_stream(spark, str(tmp_path), "ts timestamp, chunk_hash string, text string")), "dd", "append")
    assert sorted(r["text"] for r in got) == ["a", "b"]


def test_running_state_per_project(spark, tmp_path):
    for i, rows in enumerate([[(1, 1, 5.0), (1, 3, 9.0)], [(1, 2, 7.0), (2, 1, 1.0)]]):
        (tmp_path / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(("project_id", "update_no", "points"), r))) for r in rows))
        time.sleep(0.05)
    got = _drain(latest_scores(_stream(spark, str(tmp_path), "project_id long, update_no long, points double")), "st", "update")
    last = {r["project_id"]: (r["n_updates"], r["total_points"]) for r in sorted(got, key=lambda r: r["n_updates"])}
    assert last == {1: (3, 9.0), 2: (1, 1.0)}


def test_scores_without_number(spark, tmp_path):
    """An update without a number counts, and is never the newest; no project is a call of Python."""
    for i, rows in enumerate([[(1, None, 5.0), (2, 2, 4.0)], [(1, 2, 7.0), (2, None, 1.0), (2, 1, 3.0)]]):
        (tmp_path / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(("project_id", "update_no", "points"), r))) for r in rows))
        time.sleep(0.05)
    scores = latest_scores(_stream(spark, str(tmp_path), "project_id long, update_no long, points double"))
    got = _drain(scores, "sn", "update")
    last = {r["project_id"]: (r["n_updates"], r["total_points"]) for r in sorted(got, key=lambda r: r["n_updates"])}
    assert last == {1: (2, 7.0), 2: (3, 4.0)}


def test_score_bands(spark):
    df = spark.createDataFrame([(360, 360, 75), (360, 100, 90), (72, 30, 49), (71, 300, 50)], "t int, w int, s int")
    got = df.select(transit_points(F.col("t"), F.col("w")).alias("t"), walk_points(F.col("s")).alias("s")).collect()
    assert [(r["t"], r["s"]) for r in got] == [(5, 3), (2, 5), (1, 0), (0, 1)]
    p = spark.createDataFrame([(1, 0.0, 100.0), (2, 15.0, 200.0), (3, 1.0, 0.0), (4, 100.0, 100.0)], "project_id long, total_site_energy double, building_area double")
    e = {r["project_id"]: r for r in energy_scores(p).collect()}
    assert (e[1]["points"], e[2]["points"], e[3]["points"], e[4]["points"]) == (20, 15, 0, 0)
    assert e[2]["status"] == "Achieved (15 points)" and e[2]["recommendations"] == [] and len(e[4]["recommendations"]) == 3 and e[3]["recommendations"] == []
    lv = spark.createDataFrame([(80,), (60,), (50,), (49,)], "s int").select(certification_level(F.col("s")).alias("l"))
    assert [r["l"] for r in lv.collect()] == ["Platinum", "Gold", "Silver", "Certified"]
    t = spark.createDataFrame([(65000.0, 0.15, 0.08), (70000.0, 0.15, 0.08), (70000.0, 0.2, 0.0)], "i double, p double, u double")
    assert [r[0] for r in t.select(high_priority(F.col("i"), F.col("p"), F.col("u"))).collect()] == [True, False, True]


def test_compliance_counts_only_points(spark):
    sites = spark.createDataFrame([(1, 360, 360, 75, False, False, None)], "project_id long, total_trips int, weekend_trips int, walk_score int, flood_zone boolean, sensitive_habitat boolean, prime_farmland boolean")
    s = compliance_summary(spark.createDataFrame([(1, 5), (2, 1)], "project_id long, n_targets int"), location_scores(sites))
    got = {r["project_id"]: r for r in s.collect()}
    assert (got[1]["credits_achieved"], got[1]["total_points"], len(got[1]["recommendations"])) == (3, 9, 2)
    assert (got[2]["credits_achieved"], got[2]["total_points"]) == (0, 0)


def test_buildings(spark):
    b = spark.createDataFrame([("Hall", "HAL", "Academic", 9000, ["LED Lighting", "Rain water"])], "building_name string, building_code string, building_type string, square_footage long, sustainability_features array<string>")
    p = buildings_to_projects(b).first()
    assert p["zones"][0]["volume"] == 27000.0 and p["hvac_system"]["equipment"][0]["capacity"] == 9.0
    assert p["target_credits"][1:3] == ["WE_Credit_Water_Use_Reduction", "EQ_Credit_Daylight"]


def test_contains_and_nearest_names(spark):
    q = spark.createDataFrame([(1, "Saving ENERGY now"), (2, "x")], "query_id long, text string")
    n = spark.createDataFrame([("energy",), ("now",), ("a longer needle than any text here",)], "keyword string")
    assert sorted((r["query_id"], r["keyword"]) for r in contains_join(q, "query_id", "text", n, "keyword").collect()) == [(1, "energy"), (1, "now")]
    names = spark.createDataFrame([("optimize enrgy",), ("zzzz",)], "name string")
    book = spark.createDataFrame([("optimize energy",), ("optimise energy",), ("water",)], "key string")
    got = nearest_names(names, book).collect()
    assert [(r["name"], r["key"]) for r in got] == [("optimize enrgy", "optimize energy")]


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def _random_names(n, seed, letters="abc"):
    rng = random.Random(seed)
    return ["".join(rng.choices(letters, k=rng.randint(0, 12))) for _ in range(n)]


@pytest.mark.parametrize("cutoff", [0.4, 0.6, 0.85])
def test_nearest_names_against_all_pairs(spark, cutoff):
    names, keys = _random_names(60, 1) + [None, "", "Ünïcode"], [*_random_names(60, 2), None, "", "Unïcode"]
    got = nearest_names(
        spark.createDataFrame([(x,) for x in names], "name string"), spark.createDataFrame([(x,) for x in keys], "key string"), cutoff
    ).collect()
    want = {}
    for a in {x for x in names if x is not None}:
        scored = [(-round(1 - _edits(a, k) / max(len(a), len(k), 1), 6), k) for k in {x for x in keys if x is not None}]
        best = min(scored)
        if -best[0] >= cutoff:
            want[a] = (best[1], -best[0])
    assert {r["name"]: (r["key"], r["similarity"]) for r in got} == want and want


def test_few_names_are_compared(spark, sf):
    # the names of the customers' nations and parts, not of a small alphabet
    names = table(spark, sf, "part").select(F.col("p_name").alias("name")).distinct().limit(150)
    keys = table(spark, sf, "supplier").select(F.col("s_name").alias("key")).unionByName(names.limit(40).select(F.concat("name", F.lit("x")).alias("key")))
    n, m = names.count(), keys.distinct().count()
    assert name_candidates(names, keys, 0.85).count() < n * m / 4
    assert nearest_names(names, keys, 0.85).count() >= 40


def test_contains_against_all_pairs(spark):
    hay, needles = [*_random_names(80, 3, "abcd"), None, "Abc dB", "Abc dB"], [*_random_names(30, 4, "abcd"), None, "", "C D", "dB"]
    rows = [(i if i != 5 else None, t) for i, t in enumerate(hay)]
    got = contains_join(
        spark.createDataFrame(rows, "id long, text string"), "id", "text", spark.createDataFrame(list(enumerate(needles)), "n long, needle string"), "needle"
    )
    want = sorted((-1 if i is None else i, n) for i, t in rows for n, x in enumerate(needles) if t is not None and x and x.lower() in t.lower())
    assert sorted((-1 if r["id"] is None else r["id"], r["n"]) for r in got.collect()) == want and want
    # a needle meets the texts that have its rarest piece, not all texts
    many = spark.createDataFrame([(i, f"common words of every text {i}") for i in range(300)], "id long, _low string")
    asked = spark.createDataFrame([("common words of every text 7",), ("no such thing",)], "_needle string")
    assert contained_candidates(many, "id", asked).count() < 200


def test_match_credit_takes_the_first_row(spark):
    targets = spark.createDataFrame([(1, "EA"), (2, "water"), (3, "EA"), (4, None), (5, "nothing"), (6, "Water Use")], "target_id long, target string")
    catalogue = spark.createDataFrame([(1, "WE", "Water Use Reduction"), (2, "EA", "Energy"), (3, "EA", "Energy again"), (4, "W2", "water too")], "pos long, code string, name string")
    got = {r["target_id"]: (r["code"], r["name"]) for r in match_credit(targets, catalogue).collect()}
    assert got == {1: ("EA", "Energy"), 2: ("WE", "Water Use Reduction"), 3: ("EA", "Energy"), 4: (None, None), 5: (None, None), 6: ("WE", "Water Use Reduction")}


def test_near_stops_against_all_pairs(spark):
    sites = spark.range(40).select(F.col("id").alias("site_id"), (30.2 + F.col("id") % 7 / 500).alias("lat"), (-97.7 + F.col("id") % 5 / 500).alias("lon"))
    stops = spark.range(60).select((30.2 + F.col("id") % 11 / 700).alias("lat"), (-97.7 + F.col("id") % 3 / 300).alias("lon"), F.col("id").alias("frequency"), (F.col("id") % 2 == 0).alias("weekend"))
    got = {r["site_id"]: (r["n_stops"], r["total_trips"], r["weekend_trips"]) for r in stops_near_sites(sites, stops, 700.0).collect()}
    s = stops.select(F.col("lat").alias("a"), F.col("lon").alias("b"), "frequency", "weekend")
    pairs = sites.crossJoin(s).withColumn("near", metres_between(F.col("lat"), F.col("lon"), F.col("a"), F.col("b")) <= 700)
    want = pairs.groupBy("site_id").agg(
        F.count(F.when(F.col("near"), 1)), F.coalesce(F.sum(F.when(F.col("near"), F.col("frequency"))), F.lit(0)),
        F.coalesce(F.sum(F.when(F.col("near") & F.col("weekend"), F.col("frequency"))), F.lit(0)),
    )
    assert got == {r[0]: (r[1], r[2], r[3]) for r in want.collect()}


def test_file_status(spark):
    f = spark.createDataFrame([("/a.pdf",), ("/b.PNG",), ("/c.txt",), ("/d.json",)], "path string")
    e = spark.createDataFrame([("/a.pdf", None), ("/c.txt", "boom")], "path string, error string")
    got = {r["path"]: (r["status"], r["reason"]) for r in with_file_status(f, e).collect()}
    assert got == {"/a.pdf": ("successful", None), "/b.PNG": ("skipped", "Unsupported file type: .png"), "/c.txt": ("failed", "boom"), "/d.json": ("failed", "Extractor returned None")}
