import random
import re

import pytest
from pyspark.sql import functions as F

from attesta.llm import queries, toxicity
from attesta.llm.common import remainder_of

from .data import awkward, empty


def corpus(spark, n=600):
    rng = random.Random(9)
    plain = ["river", "house", "garden", "moron", "tower", "wood", "king", "queen", "stone", "bird"]
    plain.remove("moron")
    rows = []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 80))]
        toxic = i % 6 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["idiot", "moronic", "moronish", "scum"])
        if i % 6 in (1, 2):
            words.insert(1, "scum pond")
        rows.append((i, " ".join(words), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_folding():
    for text in ("1d10t", "IDIOT", "ídïot", "ıdıot", "іdіоt", "i​diot", "ｉｄｉｏｔ"):
        assert toxicity.folded(text.encode()) == ["idiot"], text
    assert toxicity.folded("l0ser w0rthless".encode()) == toxicity.folded("LOSER worthIess".encode())
    assert toxicity.folded(None) == toxicity.folded(b" \n 12") == [] or toxicity.folded(None) == []


def test_learns_terms_and_exceptions(spark):
    docs = corpus(spark)
    lexicon = toxicity.fit(docs, docs, F.lit(True))
    assert any(t.startswith(" idio") for t in lexicon.terms) and any(t.startswith(" moro") for t in lexicon.terms)
    extra = spark.createDataFrame(
        [(1, "what an 1D1OT of the river"), (2, "a moronlike king in the tower"), (3, "a bird on the house"), (4, "the scum pond by the wood"), (5, None), (6, "")],
        "doc_id long, text string",
    )
    got = {r.doc_id: r for r in toxicity.toxicity(extra, lexicon).collect()}
    assert got[1].score >= 0.5 and got[2].score >= 0.5
    assert all(got[i].score < 0.5 and got[i].hits == 0 for i in (3, 5, 6)) and got[4].score < 0.5
    given = toxicity.fit(docs, docs, F.lit(True), exceptions=("idiot savant",))
    spared = spark.createDataFrame([(1, "an idiot savant"), (2, "an idiot")], "doc_id long, text string")
    assert {r.doc_id: r.hits for r in toxicity.toxicity(spared, given).collect()} == {1: 0, 2: 1}


def test_matches_brute_force(spark):
    lexicon = toxicity.Lexicon({" bad": 2.0, " worse ": 3.0, " ugiy": 1.0}, [" not bad ", " badge "])
    texts = ["bad worse", "not bad at all", "a badge of bad ugly uglier", "worsening", "b4d", "", None, "bad " * 500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in toxicity.toxicity(docs, lexicon).collect():
        line = " " + " ".join(toxicity.folded((texts[r.doc_id] or "").encode())) + " "
        spans = [m.span(1) for e in lexicon.exceptions for m in re.finditer(f"(?=({re.escape(e)}))", line)]
        hits = [m.span(1) for t in lexicon.terms for m in re.finditer(f"(?=({re.escape(t)}))", line)]
        hits = [h for h in hits if not any(a <= h[0] and h[1] <= b for a, b in spans)]
        assert r.hits == len(hits) and r.n_words == len(line.split()), texts[r.doc_id]


@pytest.mark.parametrize(("share", "recall"), [("0.01", 0.5), ("0.1", 0.9)])
def test_held_out_accuracy(spark, sf, share, recall):
    path = sf.replace("0.001", share)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    got = queries.QUERIES["op3_toxicity"](spark, path).collect()
    assert len(got) == spark.read.parquet(f"{path}/documents.parquet").count()
    held = [r for r in got if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (remainder_of(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    toxic, clean = ([r for r in held if labels[r.doc_id] == y] for y in (1, 0))
    assert sum(r.predicted for r in toxic) >= recall * len(toxic) and sum(r.predicted for r in clean) <= 0.01 * len(clean)


def test_awkward(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (3, 0)], "doc_id long, toxic int")
    lexicon = toxicity.fit(docs, labels, F.lit(True))
    got = toxicity.toxicity(docs, lexicon).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    nothing = toxicity.fit(empty(spark), labels.limit(0), F.lit(True))
    assert nothing.terms == {} and toxicity.toxicity(empty(spark), nothing).count() == 0
