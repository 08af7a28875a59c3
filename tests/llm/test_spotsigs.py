import hashlib
import re

from attesta.llm import spotsigs

from .data import awkward, empty


def brute_set(text):
    words = re.sub(r"[\W_]+", " ", (text or "").lower()).strip().split(" ")
    content, last = [], ""
    for w in words:
        if w in spotsigs.ANCHORS:
            last = w
        else:
            content.append((last, w))
            last = ""
    number = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:8], 16)
    found = {number(f"{a}={w} {content[i + 1][1]}") for i, (a, w) in enumerate(content[:-1]) if a}
    return found


def hexed(s):
    return "".join(f"{x:08x}" for x in sorted(s))


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_documents_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), reverse=True)
    got = {r.doc_id: r for r in spotsigs.compare(docs).collect()}
    assert len(got) == len(rows)
    seen = 0
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        a, e, b = brute_set(text), brute_set(changed), brute_set(after)
        if a and e and b:
            seen += 1
            assert r.fingerprint == hexed(a) and r.edited_fingerprint == hexed(e)
            assert abs(r.near_edited - jaccard(a, e)) < 1e-9 and abs(r.near_next - jaccard(a, b)) < 1e-9
    assert seen > 100


def test_awkward(spark):
    docs = awkward(spark)
    got = spotsigs.compare(docs).collect()
    assert len(got) == docs.count()
    prints = {r.doc_id: r.fingerprint for r in got}
    assert prints[1] == prints[2] and prints[4] == prints[5] and all(prints.values())
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert spotsigs.compare(empty(spark)).count() == 0


def test_single_row(spark):
    one = spark.createDataFrame([(5, "the old house of the river")], "doc_id long, text string")
    (r,) = spotsigs.compare(one).collect()
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(b"the old housethe old house").hexdigest()


def test_near_pairs(spark):
    base = "the house of stone on the hill and a garden by the river with the old tower in the wood at the lake for the king "
    more = "the cat saw the dog of the farm and the bird on the roof by the barn with a goose in the pond "
    texts = [base + more * (i % 2) + f"the extra{i} word{i}" * (i > 3) for i in range(8)] + ["", None, "lone"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = {hashlib.sha256(hexed(s).encode()).hexdigest(): s for s in map(brute_set, texts) if s}
    want = {(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.8}
    got = {tuple(sorted((r.fp_a, r.fp_b))) for r in spotsigs.near_pairs(docs).collect()}
    assert {p for p in got if p[0] in sets and p[1] in sets} == want and want
