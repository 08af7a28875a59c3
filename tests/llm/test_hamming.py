import random

from pyspark.sql import functions as F

from attesta.llm import hamming


def brute(rows, queries, k):
    out = []
    for q, a in queries:
        if q is None or a is None:
            continue
        near = sorted(((a ^ b) & (1 << 64) - 1).bit_count() * 10**6 + i for i, b in rows if i is not None and b is not None)[:k]
        out += [(q, n + 1, x % 10**6, x // 10**6) for n, x in enumerate(near)]
    return sorted(out)


def test_matches_brute_force(spark):
    rng = random.Random(2)
    centres = [rng.getrandbits(64) for _ in range(4)]
    rows = [(i, rng.getrandbits(64) if i % 3 else rng.choice(centres) ^ (1 << rng.randrange(64))) for i in range(600)]
    rows += [(1000 + i, centres[0]) for i in range(100)] + [(None, 5), (2000, None), (2001, 0), (2001, 0)]
    rows = [(i, c - (1 << 64) if c is not None and c >> 63 else c) for i, c in rows]
    codes = spark.createDataFrame(rows, "id long, code long")
    for k in (1, 7):
        asked = [r for r in rows if r[0] is None or r[0] % 20 == 0]
        got = hamming.search(codes, spark.createDataFrame(asked, "id long, code long"), k).collect()
        assert sorted((r.query_id, r.rank, r.id, r.distance) for r in got) == brute(rows, asked, k)


def test_small_and_empty(spark):
    codes = spark.createDataFrame([(1, 3), (2, -1)], "id long, code long")
    got = hamming.search(codes, codes, 10).collect()
    assert sorted((r.query_id, r.id, r.distance) for r in got) == [(1, 1, 0), (1, 2, 62), (2, 1, 62), (2, 2, 0)]
    assert hamming.search(codes.filter("id < 0"), codes, 3).count() == 0
    assert hamming.search(codes, codes.filter("id < 0"), 3).count() == 0


def test_sign_code(spark):
    df = spark.createDataFrame([([0.5, -1.0, 0.0, 2.0],), (None,), ([1.0] * 64,)], "v array<float>")
    assert [r.c for r in df.select(hamming.sign_code(F.col("v")).alias("c")).collect()] == [9, None, -1]
