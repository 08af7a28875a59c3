import hashlib
import random
import struct

import pytest
from tokenizers import Tokenizer

from attesta.llm import bpe
from attesta.llm.common import tokenizer_path

from .data import awkward, empty

ODD = (
    "a b Z é É 's 're 'LL <|endoftext|> <|startoftext|> <| \x00 \x1c \x85 \xa0 ﬁ ß İ ı Σ σς ñ é ñ 가 각 漢字 😀 १२ ½ \t \r\n \x0b   "
    "don't they'LL _x_ ### 123 ﻿ ​ ǅ µ ª"
).split(" ")


@pytest.fixture(scope="module")
def tools():
    path = tokenizer_path()
    with open(path, encoding="utf-8") as f:
        return Tokenizer.from_file(path), bpe.ForcedBpe(f.read())


def same(tools, texts):
    library, own = tools
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        ids, decoded = own.encode(text.encode())
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == want.ids, text[:200]
        assert decoded.decode() == library.decode(want.ids, skip_special_tokens=False)


def test_awkward_strings(tools):
    rng = random.Random(5)
    texts = ["".join(rng.choice([*ODD, " ", "\n", ""]) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    same(tools, [*texts, "", " ", "x" * 3000, "abcdefghij" * 500, "é" * 999])


def test_documents(tools, spark, sf):
    same(tools, [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()])


def test_cuts_are_forced(tools):
    own = tools[1]
    fragments = own.cuts("qzxjé漢the")
    assert "".join(fragments) == "qzxjé漢the" and len(fragments) > 1
    assert all(f[-1] + g[0] not in own.inside for f, g in zip(fragments, fragments[1:]))


def test_tables(tools, spark):
    library = tools[0]
    docs = awkward(spark)
    texts = sorted((r.text or "" for r in docs.collect()))
    want = sorted(
        (len(e.ids), hashlib.sha256(struct.pack(f"<{len(e.ids)}I", *e.ids)).hexdigest())
        for e in library.encode_batch(texts, add_special_tokens=False)
    )
    got = bpe.digests(docs, tokenizer_path()).collect()
    assert sorted((r.n_tokens, r.ids_sha256) for r in got) == want
    ids = {r.doc_id: r.ids for r in bpe.encode(docs, tokenizer_path()).collect()}
    assert ids[4] == [] and ids[8] == library.encode("один два три \U0001f600 é", add_special_tokens=False).ids
    assert bpe.digests(empty(spark), tokenizer_path()).count() == 0


def test_frequent_runs_stay_cached(tools, monkeypatch):
    """A full cache drops what was not read lately; it used to be emptied, frequent runs included."""
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 64)
    library = tools[0]
    own = bpe.ForcedBpe(library.to_str())
    worked, run = [], own.run
    monkeypatch.setattr(own, "run", lambda raw: worked.append(raw) or run(raw))
    texts = [f"Frequent word{i} other{i}, frequent" for i in range(200)]
    same((library, own), texts)
    assert worked.count(b"Frequent") == worked.count(b"frequent") == 1
    assert len(own.runs) + len(own.old_runs) <= 64 and len(own.fragments) + len(own.old_fragments) <= 64
