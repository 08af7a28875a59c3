import functools
import hashlib
import itertools
import json
from collections import Counter

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from attesta.llm import alignment
from attesta.llm.common import tokenizer_path

from .data import awkward, empty

PATHS = (tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def coders():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def brute(texts, coders):
    """One row per text by the tokenizer libraries and a walk over both lists."""
    a_coder, b_coder = coders
    alphabet = alignment.byte_alphabet()
    spell_a = functools.cache(lambda i: bytes(alphabet[c] for c in a_coder.id_to_token(i)))
    spell_b = functools.cache(lambda i: bytes([int(b_coder.id_to_piece(i)[3:5], 16)]) if b_coder.is_byte(i) else b_coder.id_to_piece(i).replace("▁", " ").encode())
    out, per_doc = [], []
    for text in texts:
        a, b = ([], []) if not text else (a_coder.encode(" " + text, add_special_tokens=False).ids, b_coder.encode(text))
        sa, sb = [spell_a(i) for i in a], [spell_b(i) for i in b]
        if not text or not b"".join(sa) == b"".join(sb) == (" " + text).encode():
            out.append([0, 0, 0, ""])
            per_doc.append(Counter())
            continue
        ea, eb = list(itertools.accumulate(map(len, sa))), list(itertools.accumulate(map(len, sb)))
        groups, links, i, j, ga, gb = [], Counter(), 0, 0, [], []
        while i < len(a):
            links[a[i], b[j]] += 1
            x, y = ea[i], eb[j]
            if x <= y:
                ga.append(a[i])
                i += 1
            if y <= x:
                gb.append(b[j])
                j += 1
            if x == y:
                groups.append(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}")
                ga, gb = [], []
        out.append([len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()])
        per_doc.append(links)
    counts = Counter(p for links in per_doc for p in links)
    most = {}
    for (a, _), n in counts.items():
        most[a] = max(most.get(a, 0), n)
    return [
        (n_a, n_b, n_g, sum(d.values()), sum(t for p, t in d.items() if counts[p] == most[p[0]]), sum(t * counts[p] for p, t in d.items()), sha)
        for (n_a, n_b, n_g, sha), d in zip(out, per_doc, strict=True)
    ]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def check(docs, coders, **options):
    rows = docs.select("doc_id", "text").collect()
    want = sorted(zip([r.doc_id or -1 for r in rows], brute([r.text for r in rows], coders), strict=True))
    got = alignment.alignment_digests(docs, *PATHS, **options).collect()
    assert sorted((r.doc_id or -1, tuple(r[c] for c in COLUMNS)) for r in got) == want
    return want


def test_documents_match_brute_force(spark, sf, coders):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = check(docs, coders)
    assert sum(w[1][0] > 0 for w in want) > 100
    # few pairs or none broadcast: the others go through the join
    check(docs.limit(60), coders, hot=50)
    check(docs.limit(60), coders, hot=0)


def test_awkward(spark, coders):
    extra = [
        (20 + i, t, None, None, None, None, None, None)
        for i, t in enumerate(["a\n\n b <|endoftext|> </s> \t x", "▁ under", "ﬁne №5", "日本語 \U0001f600", "\x00\x01", " ", "x" * 5000, "it's 1234567 don't", "a" + " " * 300 + "b"])
    ]
    docs = awkward(spark, extra)
    want = check(docs, coders)
    assert any(w[1][-1] == "" for w in want)
    assert alignment.alignment_digests(empty(spark), *PATHS).count() == 0


def test_arrays(spark):
    docs = spark.createDataFrame([(1, "internationalisation of tokenizers")], "doc_id long, text string")
    (r,) = alignment.align(docs, *PATHS, ["doc_id"]).collect()
    assert r.a_cuts[-1] == len(r.a_ids) and r.b_cuts[-1] == len(r.b_ids) and len(r.a_cuts) == len(r.b_cuts)
    assert sum(r.times) >= max(len(r.a_ids), len(r.b_ids))


def test_ranks_need_merges_in_order():
    with open(PATHS[0], encoding="utf-8") as f:
        spec = json.load(f)
    text = " It's 12 naïve <|endoftext|>\n\n  tests"
    plain = alignment.ByteLevel(json.dumps(spec))
    spec["model"]["merges"][:0] = [spec["model"]["merges"].pop()]
    other = alignment.ByteLevel(json.dumps(spec))
    assert plain.encode(text) and b"".join(other.table[i] for i in other.encode(text)) == text.encode()


@given(st.lists(st.integers(1, 60), min_size=1, max_size=40), st.data())
def test_gallop(steps, data):
    table = np.cumsum(np.array(steps))
    values = np.array(data.draw(st.lists(st.integers(0, int(table[-1])), max_size=30)), np.int64)
    guess = np.array(data.draw(st.lists(st.integers(0, len(table) - 1), min_size=len(values), max_size=len(values))), np.int64)
    assert alignment.gallop(values, table, guess).tolist() == np.searchsorted(table, values).tolist()
