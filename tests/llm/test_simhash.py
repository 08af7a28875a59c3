import random

import xxhash

from attesta.llm import simhash
from attesta.llm.components import components

from .data import awkward, empty


def brute_fingerprint(text, k=4):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in lowered.translate({c: " " for c in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints, distance):
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for i in ids:
        for j in ids:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def unsigned(v):
    return v & (1 << 64) - 1


def test_documents_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: brute_fingerprint(r.text) for r in docs.collect()}
    got = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: unsigned(r.fp) for r in got} == want
    assert {r.doc_id: r.component_id for r in got} == brute_groups(want, 4)


def test_links_of_crowded_buckets(spark):
    rng = random.Random(1)
    centres = [rng.getrandbits(64) for _ in range(3)]
    values = {0, (1 << 64) - 1}
    for _ in range(250):
        v = rng.choice(centres)
        for b in rng.sample(range(64), rng.randint(0, 9)):
            v ^= 1 << b
        values.add(v)
    signed = {v - (1 << 64) if v >> 63 else v: v for v in values}
    fps = spark.createDataFrame([(s,) for s in signed], "fp long")
    for distance, parts, bucket in [(4, 3, 1024), (4, 3, 3), (3, 3, 3)]:
        found = {r.node: r.root for r in components(simhash.links(fps, distance, parts, bucket)).collect()}
        want = brute_groups(signed, distance)
        assert {k: found.get(k, k) for k in signed} == want, (distance, parts, bucket)


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = [(r.doc_id, unsigned(r.fp), r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert len(got) == docs.count()
    by_id = {d: (f, c) for d, f, c in got}
    assert by_id[2][1] == 1 and by_id[1][1] == 1
    assert [by_id[i] for i in (4, 5, 6)] == [(0, 4)] * 3
    assert by_id[None][1] is None
    assert [x[2] for x in got if x[0] == 10] == [10, 10]
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_keep_one(spark):
    docs = awkward(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert {1, 4, 7, 8, 9, 10, 11} <= set(ids) and None in ids and 2 not in ids and 5 not in ids
    assert ids.count(10) == 1


def test_component_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, None), (9, 9)], "u long, v long")
    found = {r.node: r.root for r in components(edges).collect()}
    assert all(found[i] == 0 for i in range(201)) and found[501] == 500
