import math
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from attesta.llm import ppm, queries
from attesta.llm.common import remainder_of

from .data import awkward, empty


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in lowered.translate({c: " " for c in range(9, 14)}).split(" ") if w]


def brute_model(texts, order):
    counts = defaultdict(Counter)
    for t in texts:
        s = b"\n" * order + ("".join(w + " " for w in words(t)) + "\n").encode()
        for i in range(order, len(s)):
            for k in range(order + 1):
                counts[s[i - k : i]][s[i]] += 1
    return counts


def brute_score(text, counts, order):
    s = b"\n" * order + ("".join(w + " " for w in words(text)) + "\n").encode()
    total = 0.0
    for i in range(order, len(s)):
        p, excluded = 1.0, set()
        for k in range(order, -1, -1):
            own = {c: n for c, n in counts.get(s[i - k : i], {}).items() if c not in excluded}
            if not own:
                continue
            n = sum(own.values())
            if s[i] in own:
                p *= (own[s[i]] - 0.5) / n
                break
            p *= len(own) / (2 * n)
            excluded |= set(own)
        else:
            p /= 256 - len(excluded)
        total += math.log10(p)
    return total


def close(a, b):
    return abs(a - b) <= 1e-4 * max(1.0, abs(b))


def test_model_matches_brute_force(spark):
    texts = ["the cat sat on the mat", "the hat of the cat", "a banana and a bandana", "été à la plage", "aaaa aaaa aaab", "", "The CAT"] * 2 + ["x"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    for order in (1, 3, 5):
        trie = ppm.fit(rows, order)
        counts = brute_model(texts, order)
        asked = [*texts, "the bat sat", "zzz ü", "banana " * 100, "é"]
        got = trie.scores([ppm.stream(ppm.words_of(t.encode()), order) for t in asked])
        for t, g in zip(asked, got):
            assert close(g, brute_score(t, counts, order)), (order, t, g)


def test_probabilities_sum_to_one(spark):
    rows = spark.createDataFrame([("the cat sat on the mat",), ("a band",)], "text string")
    trie = ppm.fit(rows, 3)
    import numpy as np

    p = 10.0 ** trie.logp.reshape(-1, trie.width)
    seen = trie.width - 1
    assert np.allclose(p[:, :seen].sum(axis=1) + p[:, seen] * (256 - seen), 1, atol=1e-5)


def test_query_matches_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    learned = [i for i in docs if remainder_of(i, 7) != 2]
    counts = Counter(w for i in learned for w in words(docs[i]))
    total, kinds = counts.total() + len(learned), len(counts) + 1
    got = queries.QUERIES["op4_ppm_scores"](spark, sf).collect()
    assert len(got) == len(docs)
    better = 0
    for r in got:
        own = words(docs[r.doc_id])
        assert r.held_out == (remainder_of(r.doc_id, 7) == 2) and r.train_tokens == total
        assert r.n_tokens == len(own) + 1 and r.n_known == 1 + sum(w in counts for w in own)
        base = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in own) + math.log10((len(learned) + 1) / (total + kinds + 1))
        assert abs(base - r.base_score) < 1e-6 * max(1, abs(base))
        better += r.held_out and r.score > r.base_score
    assert better > 0


def test_rare_words_and_repeated_rows(spark):
    docs = awkward(spark)
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    counts = Counter(w for _, t in texts for w in words(t))
    total, kinds = counts.total() + len(texts), len(counts) + 1
    got = ppm.score(docs, F.lit(True), order=2, frequent=3).collect()
    assert len(got) == len(texts)
    want = sorted((len(words(t)) + 1, round(sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in words(t)) + math.log10((len(texts) + 1) / (total + kinds + 1)), 4)) for _, t in texts)
    assert sorted((r.n_known, round(r.base_score, 4)) for r in got) == want
    assert ppm.score(empty(spark), F.lit(True)).count() == 0
    untrained = ppm.score(docs, F.lit(False), order=2).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in untrained)


def test_score_keeps_every_context(spark):
    """Whatever is broadcast, rare contexts count: more of them than any bounded model of the old kind held."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = ["".join(letters[(i * j + i // 3 + j * j) % 26] + (" " if (i + j) % 7 == 0 else "") for j in range(40)) for i in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "the cat"), (90, None), (91, "Ünü z"), (92, "zq zq")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    learned = F.coalesce(F.col("doc_id"), F.lit(0)) % 5 != 2
    for order, hot in ((1, 1000), (3, 40), (5, 0), (5, 500), (5, 1_000_000)):
        counts = brute_model([t for i, t in rows if (i or 0) % 5 != 2], order)
        got = ppm.score(docs, learned, order=order, hot=hot).collect()
        asked = Counter((i, round(brute_score(t, counts, order), 5)) for i, t in rows)
        assert Counter((r.doc_id, round(r.score, 5)) for r in got) == asked, (order, hot)


def test_query_scores_match_brute_force(spark, sf):
    """Of the given table, which has far more contexts than the old cap kept."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    counts = brute_model([t for i, t in docs.items() if remainder_of(i, 7) != 2], 5)
    assert len(counts) * (len(counts[b""]) + 1) > 5_000_000
    got = queries.QUERIES["op4_ppm_scores"](spark, sf).filter("held_out or doc_id % 20 = 0").collect()
    assert got and all(close(r.score, brute_score(docs[r.doc_id], counts, 5)) for r in got)


def test_pieces_of_text_are_bounded(spark):
    """A worker's arrays are many times the text scored at once; the caller bounds it."""
    from attesta.llm.common import map_batches

    docs = spark.range(0, 300, 1, 1).selectExpr("repeat('ab ', 100) AS text")
    sizes = [r.n for r in map_batches(docs, lambda cols, _: [[sum(map(len, cols[0]))]], "n bigint", piece_bytes=1000).collect()]
    assert max(sizes) <= 1000 and sum(sizes) == 300 * 300
    assert ppm.PIECE < 1 << 20


def test_driver_fills_the_broadcast_table_in_parts():
    """The temporaries of the driver's table have the size of a part, not of all strings."""
    grams = np.unique(np.random.default_rng(1).integers(0, 1 << 46, 500_000)).astype(np.uint64)
    logp = -np.arange(len(grams), dtype=np.float64)
    tracemalloc.start()
    hot = ppm.Hot.of(grams, logp)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak - hot.keys.nbytes - hot.values.nbytes < 12_000_000
    assert (hot.find(grams) == logp).all()
    assert np.isnan(hot.find(grams + np.uint64(1 << 47))).all()
