import hashlib
import random
from collections import Counter

import numpy as np

from attesta.llm import repeats, suffixes

from .data import awkward, empty


def brute(texts, length=400):
    seen = Counter()
    for t in texts:
        seen.update(t[i : i + length] for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = 1
        spans = int((np.diff(np.concatenate(([0], gone))) == 1).sum())
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def rows_of(df):
    return sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def test_suffix_order():
    rng = random.Random(1)
    for alphabet in (b"ab", b"a", b"abcz", bytes(range(256))):
        for n in (0, 1, 2, 50, 300):
            t = bytes(rng.choice(alphabet) for _ in range(n))
            got = suffixes.suffix_order(t, 1000).tolist()
            assert sorted(got) == list(range(n))
            # the last byte has no successor; among the others the order is that of the suffixes
            if n > 1 and t[-1] == min(t):
                assert [t[i:] for i in got if i < n - 1] == sorted(t[i:] for i in range(n - 1))
    t = b"mississippi" * 30 + b"\xff"
    got = suffixes.suffix_order(t, 400).tolist()
    assert [t[i : i + 400] for i in got] == sorted(t[i : i + 400] for i in range(len(t)))


def passages(seed, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(60)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [text(rng.randint(60, 140)) for _ in range(4)]
    out = []
    for i in range(n):
        parts = [text(rng.randint(0, 60)), rng.choice(shared), text(rng.randint(0, 40))]
        if i % 4 == 0:
            s = rng.choice(shared)
            parts[1] = s[: len(s) // 2] + "#" + s[len(s) // 2 :]
        if i % 5 == 0:
            parts.append(rng.choice(shared)[5:-9])
        out.append(" ".join(parts))
    return [*out, "x" * 900, "ab" * 300 + "c", "", out[0], out[1] + "tail", "é" * 250, "x" * 399]


def test_matches_brute_force(spark):
    texts = passages(4)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(brute([t.encode() for t in texts]))
    assert rows_of(repeats.remove_repeats(docs)) == want
    # anchors with more than three different surroundings are settled by halving
    assert rows_of(repeats.remove_repeats(docs, crowd=3)) == want


def test_documents_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([r.text.encode() for r in docs.collect()])
    assert rows_of(repeats.remove_repeats(docs)) == sorted(want) and any(w[1] for w in want)


def test_anchors_depend_on_content(spark):
    rng = random.Random(3)
    powers = repeats._powers(repeats.BLOCK + 400)
    core = bytes(rng.randrange(97, 123) for _ in range(4000))
    a = repeats.anchors(b"q" * 37 + core, 400, powers)
    b = repeats.anchors(core + b"zz", 400, powers)
    inside = lambda found, lo: {(p - lo, h) for p, h in zip(*(x.tolist() for x in found)) if 310 <= p - lo <= 3300}
    assert inside(a, 37) == inside(b, 0) and inside(b, 0)


def test_awkward(spark):
    docs = awkward(spark)
    texts = [(r.text or "").encode() for r in docs.collect()]
    got = repeats.remove_repeats(docs).collect()
    assert len(got) == len(texts)
    for t, (n, gone, spans, _) in zip(texts, brute([t[:3000] for t in texts])):
        if len(t) <= 3000:
            assert (n, gone, spans) in {(r.n_bytes, r.n_removed, r.n_spans) for r in got}
    big = [r for r in got if r.doc_id == 9]
    assert big[0].n_removed == big[0].n_bytes == 100000 and big[0].n_spans == 1
    assert repeats.remove_repeats(empty(spark)).count() == 0
