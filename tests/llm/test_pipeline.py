"""The pipeline, stage by stage, against plain Python over what each stage was given."""

import hashlib
import itertools
import struct
from collections import Counter

from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from attesta.llm import langid
from attesta.llm.common import remainder, tokenizer_path

from .data import awkward, empty
from .test_rows import brute_lines
from .test_near_text import jaccard, shingles


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    given, kept = docs, {}
    for i, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, given, sf)
        assert i == len(cp.STAGES) - 1 or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{i}")
        kept[i] = (given.collect(), spark.read.parquet(f"{tmp_path}/{i}").collect())
        given = spark.read.parquet(f"{tmp_path}/{i}")

    before, after = kept[0]
    model = langid.fit(docs, remainder(F.col("doc_id"), 5) != 0)
    told = {r.doc_id: p for r, p in zip(before, model.predict([r.text.encode() for r in before]))}
    assert {r.doc_id: r.lang for r in after} == {i: p[0] for i, p in told.items() if not p[2]}
    assert len(after) > 0.95 * len(before)

    before, after = kept[1]
    want = brute_lines([(r.source, r.text) for r in before], 0.1, 5)
    assert Counter((r.doc_id, r.text, r.n_chars) for r in after) == Counter((r.doc_id, t, len(t)) for r, (_, t) in zip(before, want))

    before, after = kept[2]
    sets = {r.doc_id: shingles(r.text) for r in before}
    near = {(a, b): jaccard(sets[a], sets[b]) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] & sets[b] or not sets[a] | sets[b]}
    stay = {r.doc_id for r in after}
    alone = sets.keys() - {i for p, j in near.items() if j >= 0.5 for i in p}
    alike = [p for p, j in near.items() if j >= 0.8]
    assert alone <= stay and len(after) == len(stay)
    assert sum(b not in stay for _, b in alike) >= 0.9 * len(alike)
    assert {(r.doc_id, r.text) for r in after} <= {(r.doc_id, r.text) for r in before}

    before, after = kept[3]
    assert {(r.doc_id, r.text) for r in after} <= {(r.doc_id, r.text) for r in before}
    assert abs(len(after) - len(before)) < 6 * len(before) ** 0.5

    before, after = kept[4]
    library = Tokenizer.from_file(tokenizer_path())
    encoded = library.encode_batch([r.text for r in before], add_special_tokens=False)
    want = Counter((r.doc_id, len(e.ids), hashlib.sha256(struct.pack(f"<{len(e.ids)}I", *e.ids)).hexdigest()) for r, e in zip(before, encoded))
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in after) == want


def test_run(spark, sf):
    out = cp.run(spark, sf)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0


def test_awkward_rows(spark, sf):
    docs = awkward(spark)
    n = docs.count()
    counts = [stage(spark, docs, sf).count() for _, stage in cp.STAGES[1:]]
    # lines: all rows; near-duplicates: 1, 2 and 3 (close), 4 to 6 and 10 are groups; tokens: all rows
    assert counts[0] == counts[3] == n and 7 <= counts[1] <= 9 and counts[2] > 0
    assert all(stage(spark, docs, sf).columns == cp.COLUMNS for _, stage in cp.STAGES[:-1])
    assert cp.STAGES[0][1](spark, docs, sf).filter("doc_id = 4").count() == 0


def test_empty_table(spark, sf):
    nothing = empty(spark)
    assert all(stage(spark, nothing, sf).count() == 0 for _, stage in cp.STAGES)
