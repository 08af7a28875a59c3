"""Alignment of two tokenizers' tokens over the same bytes, and corpus-wide counts of linked token ids."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import _pieces

ID_BITS = 20  # ids of both vocabularies are below 2^20
ROWS = 200  # documents aligned at once
HOT_PAIRS = 1 << 20  # id pairs that are broadcast with their counts (17 bytes each); all others are joined
# the word pattern of byte-level BPE as `use_regex` means it (fixed value)
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[str, int]:
    """Character of the byte-level vocabulary -> byte: printable Latin-1 stands for itself, the rest follows from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """Byte-level BPE from a tokenizer file, its special tokens' strings read as plain text."""

    def __init__(self, definition: str):
        spec = json.loads(definition)
        alphabet = byte_alphabet()
        special = {t["id"] for t in spec["added_tokens"]}
        vocab = spec["model"]["vocab"]
        bytes_of = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items() if i not in special}
        self.table = [bytes_of.get(i, b"") for i in range(max(vocab.values()) + 1)]
        ranks = {t: i for i, t in enumerate(self.table) if t}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        in_order = [vocab[a + b] for a, b in merges]
        if in_order == sorted(in_order) and len(ranks) == len(bytes_of) == 256 + len(merges):
            # ids follow the merges, so they can serve as ranks
            import tiktoken

            coder = tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
            self.encode = coder.encode_ordinary
        else:
            from tokenizers import Tokenizer

            coder = Tokenizer.from_str(definition)
            coder.encode_special_tokens = True
            self.encode = lambda text: coder.encode(text, add_special_tokens=False).ids


class Pieces:
    """A sentence-piece model; it puts a space before the text by itself."""

    def __init__(self, model: bytes):
        import sentencepiece

        coder = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.table = [
            bytes([int(coder.id_to_piece(i)[3:5], 16)]) if coder.is_byte(i) else coder.id_to_piece(i).replace("▁", " ").encode()
            for i in range(coder.get_piece_size())
        ]
        self.encode = lambda text: coder.encode([text], num_threads=1)[0]


def gallop(values: np.ndarray, table: np.ndarray, guess: np.ndarray) -> np.ndarray:
    """First place in the ascending `table` that is not below each value (none is above the last).

    Each search starts at its guess, doubles its stride until the value is enclosed, and halves the gap.
    """
    low, high = guess.copy(), guess.copy()
    going, step = np.flatnonzero(table[guess] < values), 1
    while len(going):
        high[going] = np.minimum(low[going] + step, len(table) - 1)
        going = going[table[high[going]] < values[going]]
        low[going] = high[going]
        step *= 2
    going, step = np.flatnonzero(table[guess] >= values), 1
    while len(going):
        low[going] = np.maximum(high[going] - step, -1)
        there = low[going]
        going = going[(there >= 0) & (table[there] >= values[going])]
        high[going] = low[going]
        step *= 2
    going = np.flatnonzero(high - low > 1)
    while len(going):
        middle = (low[going] + high[going]) // 2
        below = table[middle] < values[going]
        low[going] = np.where(below, middle, low[going])
        high[going] = np.where(below, high[going], middle)
        going = going[high[going] - low[going] > 1]
    return high


def _lists(parts: list[np.ndarray], kind) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.int64))).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.astype(kind)))


def _cuts(x: np.ndarray, doc: np.ndarray, n: int) -> list[np.ndarray]:
    """`x` by its documents, which ascend."""
    return np.split(x, np.searchsorted(doc, np.arange(1, n))) if n else []


def aligned(ids_a: list[np.ndarray], ids_b: list[np.ndarray], sizes_a: np.ndarray, sizes_b: np.ndarray) -> list[list[np.ndarray]]:
    """[a_cuts, b_cuts, pairs, times], each by document; both token lists of a document spell the same bytes.

    The document's shorter list of token ends drives the search in the longer one. Common ends cut the
    lists into groups; the places found for two neighbouring ends enclose the tokens that overlap.
    """
    n = len(ids_a)
    swap = np.array([len(a) > len(b) for a, b in zip(ids_a, ids_b, strict=True)], bool)  # B is the shorter one
    short = [b if s else a for a, b, s in zip(ids_a, ids_b, swap, strict=True)]
    long = [a if s else b for a, b, s in zip(ids_a, ids_b, swap, strict=True)]
    n_short, n_long = np.array([len(x) for x in short], np.int64), np.array([len(x) for x in long], np.int64)
    first_short, first_long = np.cumsum(n_short) - n_short, np.cumsum(n_long) - n_long
    doc = np.repeat(np.arange(n), n_short)
    flat_short, flat_long = (np.concatenate(x) if n else np.empty(0, np.int64) for x in (short, long))
    on_short, on_long = np.repeat(swap, n_short), np.repeat(swap, n_long)
    # documents one after the other: ends ascend over all of them
    ends_short = np.cumsum(np.where(on_short, sizes_b[flat_short % len(sizes_b)], sizes_a[flat_short % len(sizes_a)]))
    ends_long = np.cumsum(np.where(on_long, sizes_a[flat_long % len(sizes_a)], sizes_b[flat_long % len(sizes_b)]))
    rank = np.arange(len(doc)) - first_short[doc]
    guess = first_long[doc] + rank * n_long[doc] // np.maximum(n_short[doc], 1)
    place = gallop(ends_short, ends_long, guess)
    common = ends_long[place] == ends_short if len(place) else np.empty(0, bool)

    start = np.empty(len(place), np.int64)
    start[1:] = place[:-1] + common[:-1]
    start[first_short[n_short > 0]] = first_long[n_short > 0]
    width = place - start + 1
    of = np.repeat(np.arange(len(place)), width)
    other = np.arange(len(of)) - np.repeat(np.cumsum(width) - width, width) + start[of]
    a = np.where(on_short[of], flat_long[other], flat_short[of])
    b = np.where(on_short[of], flat_short[of], flat_long[other])
    key, times = np.unique((doc[of] << 2 * ID_BITS) | (a << ID_BITS) | b, return_counts=True)
    pair_doc, mask = key >> 2 * ID_BITS, (1 << ID_BITS) - 1
    key = (((key >> ID_BITS) & mask) << 32) | (key & mask)

    cut = np.flatnonzero(common)
    cut_short, cut_long, cut_doc = rank[cut] + 1, place[cut] - first_long[doc[cut]] + 1, doc[cut]
    swapped = swap[cut_doc]
    return [
        _cuts(np.where(swapped, cut_long, cut_short), cut_doc, n), _cuts(np.where(swapped, cut_short, cut_long), cut_doc, n),
        _cuts(key, pair_doc, n), _cuts(times, pair_doc, n),
    ]


def groups_text(ids_a: list[str], ids_b: list[str], a_cuts: list[int], b_cuts: list[int]) -> str:
    """`a1,a2|b1;a3|b2,b3`: the ids of each group, in order."""
    spans = zip([0, *a_cuts], a_cuts, [0, *b_cuts], b_cuts, strict=False)  # starts have one more
    return ";".join([f"{','.join(ids_a[a:x])}|{','.join(ids_b[b:y])}" for a, x, b, y in spans])


OUTPUTS = {
    "a_ids": "array<int>", "b_ids": "array<int>", "a_cuts": "array<int>", "b_cuts": "array<int>", "groups": "string",
    "pairs": "array<bigint>", "times": "array<int>", "n_a": "bigint", "n_b": "bigint", "n_groups": "bigint",
}


def align(
    docs: DataFrame, path_a: str, path_b: str, keep: list[str], text: str = "text",
    outputs: tuple[str, ...] = ("a_ids", "b_ids", "a_cuts", "b_cuts", "pairs", "times"),
) -> DataFrame:
    """keep... and `outputs` (of OUTPUTS) of each text, whole.

    Tokenizer A (a byte-level BPE file) reads a space and the text, B (a sentence-piece model) the text.
    `a_cuts` and `b_cuts` are the numbers of tokens up to each common end: the ends of the groups, which
    `groups` spells out (`a1,a2|b1;a3|b2,b3`). `pairs` are the distinct linked id pairs (A's id in the upper,
    B's in the lower 32 bits): tokens whose byte ranges overlap, `times` how often each occurs in the
    document. Null and empty texts, and texts whose joined tokens differ from space + text, have empty
    arrays and an empty string. Every row gives one row.
    """
    with open(path_a, encoding="utf-8") as f:
        definition = f.read()
    with open(path_b, "rb") as f:
        model = f.read()
    held = docs.sparkSession.sparkContext.broadcast((definition, model))  # the vocabularies, a few MB
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder_a, coder_b = ByteLevel(held.value[0]), Pieces(held.value[1])
        table_a, table_b = coder_a.table, coder_b.table
        if max(len(table_a), len(table_b)) >= 1 << ID_BITS:
            raise ValueError("a vocabulary of 2^20 or more ids")
        sizes_a, sizes_b = np.array([len(t) for t in table_a]), np.array([len(t) for t in table_b])
        spell_a, spell_b = table_a.__getitem__, table_b.__getitem__
        names = [str(i) for i in range(max(len(table_a), len(table_b)))] if "groups" in outputs else []
        none = np.empty(0, np.int64)
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            texts = batch.column(n_keep).cast(pa.binary()).to_pylist()
            done = 0
            for (part,) in _pieces([texts]):
                ids_a, ids_b, lists_a, lists_b = [], [], [], []
                for raw in part:
                    found_a: list[int] = []
                    found_b: list[int] = []
                    if raw:
                        whole, plain = b" " + raw, raw.decode()
                        found_a, found_b = coder_a.encode(" " + plain), coder_b.encode(plain)
                        if b"".join(map(spell_b, found_b)) != whole or b"".join(map(spell_a, found_a)) != whole:
                            found_a, found_b = [], []
                    lists_a.append(found_a)
                    lists_b.append(found_b)
                    ids_a.append(np.array(found_a, np.int64) if found_a else none)
                    ids_b.append(np.array(found_b, np.int64) if found_b else none)
                a_cuts, b_cuts, pairs, times = aligned(ids_a, ids_b, sizes_a, sizes_b)
                cols = [batch.column(i).slice(done, len(part)) for i in range(n_keep)]
                done += len(part)
                for name in outputs:
                    if name == "groups":
                        spelt = [
                            groups_text(list(map(names.__getitem__, a)), list(map(names.__getitem__, b)), x.tolist(), y.tolist())
                            for a, b, x, y in zip(lists_a, lists_b, a_cuts, b_cuts, strict=True)
                        ]
                        cols.append(pa.array(spelt, pa.string()))
                    elif name.startswith("n_"):
                        counted = {"n_a": ids_a, "n_b": ids_b, "n_groups": a_cuts}[name]
                        cols.append(pa.array([len(x) for x in counted], pa.int64()))
                    else:
                        found = {"a_ids": ids_a, "b_ids": ids_b, "a_cuts": a_cuts, "b_cuts": b_cuts, "pairs": pairs, "times": times}[name]
                        cols.append(_lists(found, np.int64 if name == "pairs" else np.int32))
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, *outputs])

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    return docs.select(*keep, text).mapInArrow(run, ", ".join([*kinds, *[f"{n} {OUTPUTS[n]}" for n in outputs]]))


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best): documents with each linked pair, and whether no pair with the same A id has more."""
    counts = written(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")))
    a = F.shiftrightunsigned("pair", 32)
    most = counts.groupBy(a.alias("_a")).agg(F.max("n").alias("_most"))
    # one row per id of vocabulary A (below 2^20), whatever the corpus
    joined = counts.withColumn("_a", a).join(F.broadcast(most), "_a")
    return joined.select("pair", "n", (F.col("n") == F.col("_most")).alias("best"))


def link_counts(rows: DataFrame, hot: int = HOT_PAIRS) -> DataFrame:
    """rows(row, pairs, times, …) with n_best and count_sum: links of a pair that is the best of its A id, and
    the sum over links of their pair's documents. `row` is unique.

    The most frequent pairs, at most `hot`, are broadcast; the links of all others are joined with their counts.
    """
    counts = written(pair_counts(rows))
    classes = counts.groupBy(F.floor(F.log2(F.col("n"))).cast("int").alias("c")).agg(F.count(F.lit(1)).alias("m")).collect()
    low, total = 62, 0
    for c, m in sorted(classes, reverse=True):
        if total + m > hot:
            break
        low, total = c, total + m
    limit = 1 << low
    frequent = counts.filter(F.col("n") >= F.lit(limit)).toArrow()
    keys = frequent.column("pair").to_numpy()
    order = np.argsort(keys)
    held = rows.sparkSession.sparkContext.broadcast(
        (keys[order], frequent.column("n").to_numpy()[order], frequent.column("best").to_numpy()[order])
    )
    keep = [c for c in rows.columns if c not in ("pairs", "times")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = held.value
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times")
            flat, often = pairs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
            sizes = np.diff(pairs.offsets.to_numpy())
            row = np.repeat(np.arange(len(sizes)), sizes)
            at = np.minimum(np.searchsorted(known, flat), max(len(known) - 1, 0))
            hit = known[at] == flat if len(known) else np.zeros(len(flat), bool)
            some = at[hit]
            sums, bests = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            np.add.at(sums, row[hit], often[hit] * n[some])
            np.add.at(bests, row[hit], often[hit] * best[some])
            bounds = np.searchsorted(row[~hit], np.arange(1, len(sizes)))
            split = lambda x: _lists(np.split(x[~hit], bounds), np.int64) if len(sizes) else _lists([], np.int64)  # noqa: E731,B023
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(bests), pa.array(sums), split(flat), split(often)],
                names=[*keep, "n_best", "count_sum", "pairs", "times"],
            )

    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep]
    schema = ", ".join([*kinds, "n_best bigint, count_sum bigint, pairs array<bigint>, times array<bigint>"])
    found = rows.mapInArrow(run, schema)
    if limit == 1:
        return found.drop("pairs", "times")
    found = written(found)
    rare = found.select("row", F.inline(F.arrays_zip("pairs", "times"))).select("row", F.col("pairs").alias("pair"), "times")
    extra = rare.join(counts.filter(F.col("n") < limit), "pair").groupBy("row").agg(
        F.sum(F.col("times") * F.col("best").cast("bigint")).alias("_best"), F.sum(F.col("times") * F.col("n")).alias("_sum")
    )
    return found.drop("pairs", "times").join(extra, "row", "left").select(
        *keep, (F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum")
    )


def alignment_digests(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text", hot: int = HOT_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row, from `align`.

    Rows without tokens have zeros and an empty groups_sha256; repeated rows count as documents of their own.
    """
    found = align(docs, path_a, path_b, [doc_id], text, ("n_a", "n_b", "n_groups", "groups", "pairs", "times"))
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups"), 256)).otherwise(F.lit(""))
    rows = written(
        found.select(
            F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), "n_a", "n_b", "n_groups",
            digest.alias("groups_sha256"), "pairs", "times",
        )
    )
    with_links = rows.withColumn("n_links", F.aggregate("times", F.lit(0).cast("long"), lambda s, t: s + t))
    return link_counts(with_links, hot).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
