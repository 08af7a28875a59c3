"""Line de-duplication, mixing and language identification on hand-made and given rows."""

import math
from collections import Counter

from pyspark.sql import functions as F

from attesta.llm import langid, line_dedup, mixing
from attesta.llm.common import remainder, remainder_of

from .data import awkward, empty


def brute_lines(rows, ratio, min_pages):
    pages, seen = Counter(), Counter()
    for site, text in rows:
        pages[site] += 1
        seen.update((site, line) for line in {x.strip(" ") for x in (text or "").split("\n")} if line)
    out = []
    for site, text in rows:
        if text is None:
            out.append((0, None))
            continue
        lines = text.split("\n")
        kept = [x for x in lines if not (x.strip(" ") and seen[site, x.strip(" ")] >= min_pages and seen[site, x.strip(" ")] > ratio * pages[site])]
        out.append((len(lines) - len(kept), "\n".join(kept)))
    return out


def test_lines(spark, sf):
    extra = [(100 + i, f"menu\n\nown {i}\n menu \nfoot", "en", ("a", None, "z")[i % 3], 1, "x", "y", i) for i in range(30)]
    docs = awkward(spark, extra).union(spark.read.parquet(f"{sf}/documents.parquet").withColumns({c: F.lit(None) for c in ("id", "word", "key")}))
    rows = docs.select("source", "text").collect()
    for ratio, least in ((0.1, 3), (0.4, 5)):
        got = line_dedup.drop_boilerplate(docs.drop("n_lines"), ratio=ratio, min_pages=least)
        assert set(docs.columns) < set(got.columns)
        found = Counter((r.source, r.n_dropped, r.text) for r in got.collect())
        assert found == Counter((s, n, t) for (s, _), (n, t) in zip(rows, brute_lines(rows, ratio, least)))
    assert line_dedup.drop_boilerplate(empty(spark)).count() == 0


def test_mix(spark):
    docs = spark.range(60000).select(
        F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 3 > 0, "big").when(F.col("id") % 2 > 0, "small").alias("source"),
        F.lit(9).alias("copy"),
    )
    out = mixing.mix(docs).cache()
    sizes = {r.source: r.n for r in out.groupBy("source").agg(F.count("*").alias("n")).collect()}
    for s in ("big", "small", None):
        assert abs(sizes[s] - 20000) < 6 * math.sqrt(20000), sizes
    # the repetitions follow the distribution, not only its mean
    times = Counter(r.n for r in out.filter("source = 'small'").groupBy("doc_id").agg(F.count("*").alias("n")).collect())
    rate = 20000 / 10000
    for k in range(1, 6):
        want = 10000 * math.exp(-rate) * rate**k / math.factorial(k)
        assert abs(times[k] - want) < 6 * math.sqrt(want)
    order = [r.mix_order for r in out.select("mix_order").collect()]
    assert order == sorted(order)
    weights = spark.createDataFrame([("big", 3.0), ("other", 5.0), (None, 1.0)], "source string, weight double")
    asked = {r.source: r.n for r in mixing.mix(docs, weights=weights, rows=9000).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert set(asked) == {"big", None} and abs(asked["big"] - 6750) < 500


def test_mix_awkward(spark):
    docs = awkward(spark)
    got = mixing.mix(docs, rows=400).collect()
    assert {r.doc_id for r in got} <= {r.doc_id for r in docs.collect()} and len(got) > 200
    assert mixing.mix(empty(spark)).count() == 0


def test_language(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    held_out = remainder(F.col("doc_id"), 5) == 0
    model = langid.fit(docs, ~held_out)
    assert sorted(set(model.names)) == ["de", "en", "es", "fr"] and len(model.names) > 4
    got = langid.identify(docs, model).filter(held_out).collect()
    assert all(remainder_of(r.doc_id, 5) == 0 for r in got)
    right = sum(r.lang == r.lang_pred for r in got) / len(got)
    assert right > 0.97, right
    assert all(0 <= r.score <= 1 for r in got)
    # nearest centroid by brute force
    import numpy as np

    for r in got[:40]:
        v = np.log1p(langid.counts(r.text.encode())) * model.idf
        cos = model.centroids @ (v / np.linalg.norm(v))
        assert model.names[int(cos.argmax())] == r.lang_pred and abs(float(cos.max()) - r.score) < 1e-5


def test_language_awkward(spark):
    docs = awkward(spark)
    model = langid.fit(docs, F.lit(True))
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert [got[i].lang_pred for i in (4, 5, 6, 11)] == ["und"] * 4 and got[4].rejected
    assert got[7].lang_pred in {"fr", "en", "ru"} and got[8].lang_pred == "ru"
    nothing = langid.fit(empty(spark), F.lit(True))
    assert {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}
    assert langid.identify(empty(spark), model).count() == 0


def test_language_rejects_foreign_and_gibberish(spark, sf):
    import base64
    import random

    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    held_out = remainder(F.col("doc_id"), 5) == 0
    model = langid.fit(docs, ~held_out)
    rng = random.Random(7)
    finnish = "talo on suuri ja kaunis mutta metsässä asuu vanha karhu joka nukkuu koko talven eikä herää ennen kevättä kun lumi sulaa "
    finnish += "pois ja linnut palaavat etelästä takaisin kotiin järven rannalle missä lapset leikkivät auringossa iltaan asti"
    strange = [finnish, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5000)), base64.b64encode(rng.randbytes(3000)).decode(), rng.randbytes(3000).hex()]
    strange += ["".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(1000)), "".join(chr(rng.randint(0x621, 0x64A)) for _ in range(1000)), "z" * 500]
    assert [p[2] for p in model.predict([t.encode() for t in strange])] == [True] * len(strange)
    # clean documents stay, short ones too
    texts = [r.text.encode() for r in docs.filter(held_out).collect()]
    for size in (30, 100, 300, 10**6):
        kept = [not p[2] for p in model.predict([t[:size] for t in texts])]
        assert sum(kept) > 0.97 * len(kept), (size, sum(kept), len(kept))
