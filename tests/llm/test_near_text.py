import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from attesta.llm import near_text

from .data import awkward, empty


def shingles(text, n=5):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(words, changes, rng):
    out = list(words)
    for _ in range(changes):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return out


def near_corpus():
    """Texts of 100 to 200 words, each with copies of growing distance, and strangers."""
    rng = random.Random(4)
    texts = []
    for g in range(60):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(100, 200))]
        texts += [(g, " ".join(edited(base, c, rng))) for c in (0, 1, 2, 3, 4)]
        texts.append((100 + g, " ".join(f"w{rng.randrange(3000)}" for _ in range(120))))
    return texts


def test_recall_and_clean_texts(spark):
    texts = near_corpus()
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string").repartition(4)
    group = {r.doc_id: r.component_id for r in near_text.near_duplicates(docs).collect()}
    sets = [shingles(t) for _, t in texts]
    assert len(group) == len(texts)
    same = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if texts[i][0] == texts[j][0]]
    alike = [(i, j) for i, j in same if jaccard(sets[i], sets[j]) >= 0.8]
    met = sum(group[i] == group[j] for i, j in alike)
    assert len(alike) > 200 and met >= 0.9 * len(alike)
    members = {}
    for i, g in group.items():
        members.setdefault(g, []).append(i)
    assert all(g == min(m) for g, m in members.items())
    # strangers stay alone, and no group joins texts of different origin
    assert all(len({texts[i][0] for i in m}) == 1 for m in members.values())


def test_given_documents(spark, sf):
    path = sf.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    group = {r.doc_id: r.component_id for r in near_text.near_duplicates(docs).collect()}
    sets = {r.doc_id: shingles(r.text) for r in rows}
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    pairs = {p for h in holders.values() if 1 < len(h) < 100 for p in itertools.combinations(sorted(h), 2)}
    near = {p: jaccard(sets[p[0]], sets[p[1]]) for p in pairs}
    alike = [p for p, j in near.items() if j >= 0.8]
    assert alike and sum(group[a] == group[b] for a, b in alike) >= 0.9 * len(alike)
    partners = {i for p, j in near.items() if j >= 0.5 for i in p}
    assert all(group[i] == i for i in sets if i not in partners and sets[i])


def test_meetings_against_all_pairs():
    rng = random.Random(1)
    rows = sorted({(p, rng.randrange(40)) for p in range(30) for _ in range(rng.choice([1, 2, 3, 4]))})
    few = {}
    for p, v in rows:
        few.setdefault(p, []).append(v)
    want = {(a, b) for vs in few.values() if len(vs) <= near_text.CROWD for a, b in itertools.combinations(sorted(vs), 2)}
    crowd = [(1000, v) for v in range(100, 180)]
    want |= {(100, v) for v in range(101, 180)}
    for size in (1, 7, 33, 1000):
        every = rows + crowd + [(2000, 5), (2000, 9)]
        batches = [
            pa.RecordBatch.from_arrays([pa.array([p for p, _ in part], pa.int64()), pa.array([v for _, v in part], pa.int64())], names=["point", "node"])
            for part in (every[i : i + size] for i in range(0, len(every), size))
        ]
        got = {(u, v) for b in near_text._meetings(iter(batches)) for u, v in zip(*(c.to_pylist() for c in b.columns), strict=True)}
        assert got == want | {(5, 9)}


def test_links_grow_with_a_group_not_with_its_square(spark):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(300)]
    docs = spark.createDataFrame([(i, " ".join(edited(base, 1, rng))) for i in range(400)], "doc_id long, text string")
    width, number = near_text.plan(400, 0.8, 0.92)
    nodes = near_text.prints(docs, width, number, "doc_id", "text", 5)
    assert near_text.links(nodes, width, 0.8).count() < 400 * 30
    assert {r.component_id for r in near_text.near_duplicates(docs).collect()} == {0}


def test_crowded_points_lose_no_link(spark):
    """Nodes of a crowded point that are far from its first one and near each other; a chain among them."""
    width = 12
    base, other = 0, (1 << 60) - 1  # 60 of 64 bits differ, in each word
    chain = [other ^ ((1 << (4 * i)) - 1) for i in range(6)]  # 4 bits of a word from one to the next
    words = [base, *chain, *[0x5555555555555555 ^ (1 << i) for i in range(5)]]
    rows = [(i, [7, 100 + 64 * i], w, w, w, w) for i, w in enumerate(words)]
    nodes = spark.createDataFrame(rows, "node long, segments array<long>, f0 long, f1 long, f2 long, f3 long")
    p = near_text.bit_share(0.8)
    most = {b: int(b * p + d * (b * p * (1 - p)) ** 0.5) for b, d in ((64, 3.0), (256, 1.25))}

    def differing(a, b):
        return (a ^ b).bit_count()

    want = [(i, j) for i, j in itertools.combinations(range(len(words)), 2) if differing(words[i], words[j]) <= most[64] and 4 * differing(words[i], words[j]) <= most[256]]
    got = [(r.u, r.v) for r in near_text.links(nodes, width, 0.8).collect()]

    def groups(pairs):
        root = list(range(len(words)))
        for _ in words:
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert set(got) <= set(want) and groups(got) == groups(want)
    assert groups(want)[0] == 0 and groups(want)[1:7] == [1] * 6 and groups(want)[7:] == [7] * 5


@pytest.mark.parametrize("n", [0, 1, 1000, 10**7, 10**9])
def test_plan(n):
    width, number = near_text.plan(n, 0.8, 0.92)
    assert 12 <= width <= 40 and 1 <= number <= 64


def test_bits_follow_similarity():
    rng = np.random.default_rng(5)
    shares = []
    for _ in range(40):
        common, own = rng.integers(0, 1 << 63, 800, dtype=np.uint64), rng.integers(0, 1 << 63, 200, dtype=np.uint64)
        a, b = np.concatenate((common, own[:100])), np.concatenate((common, own[100:]))
        shares.append((near_text.simhash_bits(a, 256) != near_text.simhash_bits(b, 256)).mean())
    assert abs(np.mean(shares) - near_text.bit_share(0.8)) < 0.02


def test_awkward(spark):
    docs = awkward(spark)
    got = near_text.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    group = {r.doc_id: r.component_id for r in got}
    assert group[1] == group[2] == 1 and group[4] == group[5] == group[6] == 4 and group[9] == 9 and group[10] == 10
    kept = near_text.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted({g or 0 for g in group.values()} | {0})
    assert near_text.keep_one(empty(spark)).count() == 0


def test_a_crowd_is_compared_once_for_all_its_points(spark, monkeypatch):
    """Nodes that share all of their points meet in as many rows as there are nodes, not once a point."""
    given, plain = [], near_text._crowd_links
    monkeypatch.setattr(near_text, "_crowd_links", lambda crowds, *a: given.append(crowds.collect()) or plain(crowds, *a))
    words = [1 << (i % 4) for i in range(50)] + [(1 << 60) - 1 - (1 << i) for i in range(20)]
    rows = [(i, [7, 9], w, w, w, w) for i, w in enumerate(words)]
    nodes = spark.createDataFrame(rows, "node long, segments array<long>, f0 long, f1 long, f2 long, f3 long")
    pairs = {(r.u, r.v) for r in near_text.links(nodes, 12, 0.8).collect()}
    assert sorted(r.node for r in given[0]) == list(range(70)) and {r.point for r in given[0]} == {0}
    root = list(range(70))
    for _ in range(70):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert root == [0] * 50 + [50] * 20


def test_crowds_of_other_first_nodes_stay_apart(spark):
    rows = [(1, 2, 10), (1, 3, 10), (1, 2, 11), (1, 4, 11), (5, 6, 12), (7, 8, None)]
    got = near_text._crowds(spark.createDataFrame(rows, "u long, v long, point long")).collect()
    assert sorted((r.point, r.node) for r in got) == [(1, 1), (1, 2), (1, 3), (1, 4), (5, 5), (5, 6)]
