"""Byte-pair encoding and decoding by forced boundaries, equal to what a tokenizer file defines."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

CACHE_ENTRIES = 200_000
# runs of printable ASCII and precomposed Latin-1 letters: normalising them is lowering them
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
PLAIN_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-zß-öø-ÿ0-9]+")


class ForcedBpe:
    """Encoder for a tokenizer file with a byte-level word split, word-end suffix and merge list.

    Two neighbouring bytes that no vocabulary entry holds side by side can never end up in one token,
    so a word is cut there for certain; its fragments are encoded on their own and their tokens joined.
    White space never joins tokens either, which makes runs without it the unit of the cache.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        spec = json.loads(definition)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.ids = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {pair: i for i, pair in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        bodies = [t.removesuffix(self.end) if self.end else t for t in self.ids]
        self.inside = {a + b for t in bodies for a, b in zip(t, t[1:])}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        tokenizer = Tokenizer.from_str(definition)
        self.normalizer, self.pre_tokenizer = tokenizer.normalizer, tokenizer.pre_tokenizer
        # the byte alphabet of the letters that PLAIN allows
        self.bytes_of = {c: "".join(w for w, _ in self.pre_tokenizer.pre_tokenize_str(chr(c))) for c in [*range(0xDF, 0xF7), *range(0xF8, 0x100)]}
        # what a token adds to the ids and to the decoded text
        self.coded = {t: (struct.pack("<I", i), self.names[i]) for t, i in self.ids.items()}
        self.coded_special = {t: (struct.pack("<I", i), self.names[i]) for t, i in self.special.items()}
        # each cache has two halves: a full half becomes the older one, what is read there comes back, the rest is dropped
        self.fragments: dict[str, tuple[bytes, str]] = {}
        self.old_fragments: dict[str, tuple[bytes, str]] = {}
        self.runs: dict[bytes, tuple[bytes, bytes]] = {}
        self.old_runs: dict[bytes, tuple[bytes, bytes]] = {}

    def cuts(self, word: str) -> list[str]:
        """The fragments of a word between its certain cuts."""
        inside, out, start = self.inside, [], 0
        for i in [i for i, pair in enumerate(map(add, word, word[1:]), 1) if pair not in inside]:
            out.append(word[start:i])
            start = i
        out.append(word[start:])
        return out

    def merged(self, symbols: list[str]) -> list[str]:
        """Merge neighbours, least rank first and from the left, until no pair has a rank."""
        if len(symbols) > 48:
            return self._merged_long(symbols)
        get, none = self.ranks.get, len(self.ranks)
        found = [get(p, none) for p in zip(symbols, symbols[1:])]
        while found and (best := min(found)) < none:
            i = found.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del found[i]
            if i:
                found[i - 1] = get((symbols[i - 1], symbols[i]), none)
            if i < len(found):
                found[i] = get((symbols[i], symbols[i + 1]), none)
        return symbols

    def _merged_long(self, symbols: list[str]) -> list[str]:
        n, ranks = len(symbols), self.ranks
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        text: list[str | None] = list(symbols)
        heap = [(ranks[p], i, p) for i, p in enumerate(zip(symbols, symbols[1:])) if p in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if text[i] != pair[0] or j < 0 or text[j] != pair[1]:
                continue
            text[i], text[j], after[i] = pair[0] + pair[1], None, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (new := (text[a], text[b])) in ranks:
                    heapq.heappush(heap, (ranks[new], a, new))
        return [t for t in text if t is not None]

    def packed(self, tokens: list[str], coded: dict[str, tuple[bytes, str]]) -> tuple[bytes, str]:
        """Ids (little-endian, 32 bits each), and the names of their tokens with a space between them.

        Without a decoder in the tokenizer file, that is the text the ids decode to.
        """
        found = [coded[t] for t in tokens]
        return b"".join([i for i, _ in found]), " ".join([n for _, n in found])

    def fragment(self, text: str, last: bool) -> tuple[bytes, str]:
        """Tokens of a part of a word that starts at a certain cut and ends at one, or (`last`) with the word."""
        key = text + "\n" if last else text
        found = self.fragments.get(key)
        if found is None:
            found = self.old_fragments.get(key)
            if found is None:
                parts = self.cuts(text)
                if len(parts) > 1:
                    own = [*[self.fragment(p, False) for p in parts[:-1]], self.fragment(parts[-1], last)]
                    found = b"".join([i for i, _ in own]), " ".join([n for _, n in own])
                else:
                    symbols = list(text)
                    if last:
                        symbols[-1] += self.end
                    found = self.packed(self.merged(symbols), self.coded)
            if len(self.fragments) >= CACHE_ENTRIES // 2:
                self.fragments, self.old_fragments = {}, self.fragments
            if len(text) <= 64:
                self.fragments[key] = found
        return found

    def words(self, text: str) -> list[str]:
        """Normalised words in the byte alphabet of the vocabulary."""
        if text.isascii() and text.isalpha():
            return [text.lower()]
        if PLAIN.fullmatch(text):
            return [w if w.isascii() else w.translate(self.bytes_of) for w in PLAIN_WORDS.findall(text.lower())]
        return [w for w, _ in self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(text))]

    def run(self, raw: bytes) -> tuple[bytes, bytes]:
        """Ids and decoded text of a run without ASCII white space."""
        text = raw.decode("utf-8", "replace")
        found: list[tuple[bytes, str]] = []
        for part in self.split.split(text) if "<" in text else [text]:
            if part in self.special:
                found.append(self.packed([part], self.coded_special))
            elif part:
                found += [self.fragment(word, True) for word in self.words(part)]
        return b"".join([i for i, _ in found]), " ".join([n for _, n in found]).encode()

    def missed(self, raw: bytes) -> tuple[bytes, bytes]:
        """`run` for a run that is not in the newer half of the cache."""
        got = self.runs.get(raw) or self.old_runs.get(raw) or self.run(raw)
        if len(self.runs) >= CACHE_ENTRIES // 2:
            self.runs, self.old_runs = {}, self.runs
        if len(raw) <= 64:
            self.runs[raw] = got
        return got

    def encode(self, raw: bytes | None) -> tuple[bytes, bytes]:
        """(ids, decoded text) of a whole text in UTF-8; a null text counts as empty."""
        runs = (raw or b"").split()
        found = [got or self.missed(r) for r, got in zip(runs, map(self.runs.get, runs))]
        return b"".join([i for i, _ in found]), b" ".join([n for i, n in found if i])


def encoder_of(docs: DataFrame, path: str):
    """A maker of encoders for tasks; the tokenizer file is read once and broadcast (a few MB, fixed)."""
    with open(path, encoding="utf-8") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())
    return lambda: ForcedBpe(held.value)


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids: array<int>, decoded): tokens of each whole text, and the text they decode to.

    Null and empty texts give no ids and an empty text; every row gives one row; other columns are left out.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(cols, bpe):
        both = [bpe.encode(t) for t in cols[1]]
        return [cols[0], [list(struct.unpack(f"<{len(i) // 4}I", i)) for i, _ in both], [d.decode() for _, d in both]]

    return map_batches(docs.select(F.col(doc_id), F.col(text)), run, f"doc_id {kind}, ids array<int>, decoded string", encoder_of(docs, path))


def digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row, as `encode` defines ids and decoded text."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(cols, bpe):
        both = [bpe.encode(t) for t in cols[1]]
        return [
            cols[0], [len(i) // 4 for i, _ in both], [hashlib.sha256(i).hexdigest() for i, _ in both],
            [hashlib.sha256(d).hexdigest() for _, d in both],
        ]

    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return map_batches(docs.select(F.col(doc_id), F.col(text)), run, schema, encoder_of(docs, path))
