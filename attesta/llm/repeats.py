"""Removal of byte strings that occur more than once in a corpus, by suffix sorting of candidate passages."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import join_to_unique
from ..session import written
from .common import map_batches
from .suffixes import repeated

GRAM = 256  # bytes of an anchor
BLOCK = 1 << 19
_BASE = 0x9E3779B97F4A7C15
CROWD = 4096  # different surroundings of one anchor that are sorted in one task


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        one = np.ones(1, np.uint64)
        up = np.cumprod(np.concatenate((one, np.full(n, _BASE, np.uint64))))
        down = np.cumprod(np.concatenate((one, np.full(n, pow(_BASE, -1, 1 << 64), np.uint64))))
    return up, down


def anchors(text: bytes, length: int, powers: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Positions and 64-bit hashes of the anchors of a text.

    Every string of `length` bytes selects one of its GRAM-byte strings, the leftmost of least hash, by
    its content alone: wherever the string occurs again, the same anchor is selected in it.
    """
    grams = length - GRAM + 1
    positions, hashes = [], []
    up, down = powers
    for lo in range(0, len(text) - length + 1, BLOCK):
        t = np.frombuffer(text, np.uint8, min(BLOCK + length - 1, len(text) - lo), lo)
        with np.errstate(over="ignore"):
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((t.astype(np.uint64) + np.uint64(1)) * up[: len(t)])))
            h = (sums[GRAM:] - sums[:-GRAM]) * down[: len(t) - GRAM + 1]
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(29)
        # least hash, then leftmost: 44 bits of hash over 20 bits of place
        key = (h & ~np.uint64((1 << 20) - 1)) | np.arange(len(h), dtype=np.uint64)
        n = len(h) - grams + 1
        padded = np.full(-(-len(h) // grams) * grams, np.iinfo(np.uint64).max, np.uint64)
        padded[: len(h)] = key
        rows = padded.reshape(-1, grams)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:n], ahead[grams - 1 : grams - 1 + n])
        at = np.unique(least & np.uint64((1 << 20) - 1)).astype(np.int64)
        positions.append(at + lo)
        hashes.append(h[at])
    if not positions:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at, first = np.unique(np.concatenate(positions), return_index=True)
    return at, np.concatenate(hashes)[first]


def surroundings(text: bytes, at: int, length: int) -> tuple[int, bytes]:
    """(bytes before the anchor, all bytes) that strings of `length` with this anchor can cover."""
    lo = max(0, at - (length - GRAM))
    return at - lo, text[lo : at + length]


def _found(texts: DataFrame, length: int) -> DataFrame:
    """(h, around, a, b, pos): anchors of each text with the hash of their surroundings."""

    def run(cols, powers):
        out: list[list] = [[], [], [], [], []]
        for a, b, text in zip(*cols):
            at, hashes = anchors(text, length, powers)
            for p, h in zip(at.tolist(), hashes.astype(np.int64).tolist()):
                left, own = surroundings(text, p, length)
                out[0].append(h)
                out[1].append(xxhash.xxh64_intdigest(own, left) - (1 << 63))
                out[2].append(a)
                out[3].append(b)
                out[4].append(p)
        return out

    return map_batches(texts.select("a", "b", "text"), run, "h bigint, around bigint, a bigint, b bigint, pos bigint", lambda: _powers(BLOCK + length))


def _cut(texts: DataFrame, reps: DataFrame, length: int) -> DataFrame:
    """(h, around, left, own, place_a, place_b, pos): the bytes around the chosen anchor places."""
    wanted = reps.groupBy("a", "b", "first").agg(F.collect_list(F.struct("h", "around", "pos")).alias("wanted"))
    joined = texts.join(wanted, ["a", "b"]).filter(F.col("doc_id").eqNullSafe(F.col("first"))).select("a", "b", "text", "wanted")

    def run(cols, _):
        out: list[list] = [[] for _ in range(7)]
        for a, b, text, wanted in zip(*cols):
            for w in wanted:
                left, own = surroundings(text, w["pos"], length)
                for column, value in zip(out, (w["h"], w["around"], left, own, a, b, w["pos"])):
                    column.append(value)
        return out

    schema = "h bigint, around bigint, left bigint, own binary, a bigint, b bigint, pos bigint"
    return map_batches(joined, run, schema).dropDuplicates(["h", "around"])


BUFFER = 1 << 19


def _sorted_compare(rows: DataFrame, length: int) -> DataFrame:
    """(h, around, lo, hi): stretches, relative to the anchor, of repeated strings in its surroundings.

    All rows of an anchor meet in a task (at most CROWD), many anchors share one suffix sort.
    """

    def compare(group: list[tuple]) -> list[tuple]:
        buffer, starts, places, owner = b"".join(g[3] for g in group), [], [], []
        docs: dict = {}
        base = 0
        for i, (_, _, left, own, a, b, pos) in enumerate(group):
            n = len(own) - length + 1
            starts.append(np.arange(base, base + n))
            places.append((docs.setdefault((a, b), len(docs)) << 40) + pos - left + np.arange(n))
            owner.append(np.full(n, i))
            base += len(own)
        at, who = np.concatenate(starts), np.concatenate(owner)
        hit = repeated(buffer, at, np.concatenate(places), length)
        at, who = at[hit], who[hit]
        if not len(at):
            return []
        offsets = np.cumsum([0] + [len(g[3]) for g in group])
        at = at - offsets[who]
        cut = np.flatnonzero(np.concatenate(([True], (np.diff(who) > 0) | (np.diff(at) > length))))
        last = np.append(cut[1:], len(at)) - 1
        return [(group[i][0], group[i][1], a - group[i][2], b + length - group[i][2]) for i, a, b in zip(who[cut].tolist(), at[cut].tolist(), at[last].tolist())]

    def run(batches):
        import pyarrow as pa

        held: list[tuple] = []
        size = 0
        names = ["h", "around", "lo", "hi"]

        def out(found):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found) if found else [[]] * 4)], names=names)

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if size > BUFFER and row[0] != held[-1][0]:
                    yield out(compare(held))
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield out(compare(held))

    ordered = rows.repartition("h").sortWithinPartitions("h")
    return ordered.select("h", "around", "left", "own", "a", "b", "pos").mapInArrow(run, "h bigint, around bigint, lo bigint, hi bigint")


FAN = 8


def _halving_compare(rows: DataFrame, length: int) -> DataFrame:
    """The same for anchors with more different surroundings than one task should sort.

    Ranges of string starts are split, FAN at a time. Where all strings of a range together (their
    union) occur at two places, the range repeats; where not even the part common to all of them does,
    nothing in it repeats; else its parts are looked at. Counts are pre-aggregated, no anchor meets in
    one task, and what is written per range are hashes of 128 bits, not bytes.
    """
    reach = length - GRAM
    # starts from -reach to 0 before the anchor, as far as the surroundings go
    sized = rows.select(
        "h", "around", "left", "own", F.greatest(F.lit(-reach), -F.col("left")).cast("int").alias("lo"),
        F.least(F.lit(0), F.length("own") - F.col("left") - length).cast("int").alias("hi"),
    )
    span = 1 << reach.bit_length()
    width = span // FAN
    nodes = None
    found = None
    keys = ["h", "g", "s", "e"]
    while width:
        here = sized.withColumn("gs", F.sequence(F.lit(1 - span), F.lit(1 - width), F.lit(width))) if nodes is None else sized.join(nodes, ["h", "around"])
        cut = here.withColumn("g", F.explode("gs")).withColumn("s", F.greatest("lo", "g")).withColumn("e", F.least("hi", F.col("g") + width - 1))
        cut = cut.filter("s <= e")
        begin, n = F.col("left") + 1, F.col("e") - F.col("s")
        union = F.unhex(F.md5(F.substring(F.col("own"), (begin + F.col("s")).cast("int"), (n + length).cast("int"))))
        core = F.unhex(F.md5(F.substring(F.col("own"), (begin + F.col("e")).cast("int"), (length - n).cast("int"))))
        cut = written(cut.select("h", "around", "g", "s", "e", union.alias("union"), core.alias("core")))
        alike = cut.groupBy(*keys, "union").agg(F.count(F.lit(1)).alias("n"), F.min("around").alias("one"))
        told = cut.join(alike.filter("n > 1"), [*keys, "union"], "left")
        hit = told.filter("n > 1").select("h", "around", F.col("s").cast("bigint").alias("lo"), (F.col("e") + length).cast("bigint").alias("hi"))
        found = hit if found is None else found.union(hit)
        if width == 1:
            break
        # one row of each union goes on, as a partner for rows that share only some of its strings
        rest = told.filter("n is null or around = one").select("h", "around", *keys[1:], "core")
        even = rest.groupBy(*keys, "core").agg((F.count(F.lit(1)) > 1).alias("even")).filter("even")
        # rows that have different parts of the range can't be compared by a common core: they are split
        uneven = rest.groupBy("h", "g").agg(((F.min("s") < F.max("s")) | (F.min("e") < F.max("e"))).alias("uneven")).filter("uneven")
        rest = rest.join(uneven, ["h", "g"], "left").join(even, [*keys, "core"], "left").filter("uneven or even")
        smaller = max(1, width // FAN)
        parts = F.sequence(F.col("g"), F.col("g") + (width - smaller), F.lit(smaller))
        nodes = written(rest.groupBy("h", "around").agg(F.flatten(F.collect_set(parts)).alias("gs")))
        if nodes.isEmpty():
            break
        width = smaller
    return found


def _spans(text: bytes, ranges: list | None, all_of_it: bool) -> list[tuple[int, int]]:
    n = len(text)
    if all_of_it:
        return [(0, n)]
    out: list[list[int]] = []
    for r in sorted(((max(0, r["lo"]), min(n, r["hi"])) for r in ranges or [])):
        if out and r[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], r[1])
        else:
            out.append([*r])
    return [(a, b) for a, b in out]


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 400, crowd: int = CROWD) -> DataFrame:
    """(doc_id, text, copies, ranges): what to remove from each row; see `remove_repeats`.

    Anchors, selected by content, bring together all places that can hold the same string of `length`
    bytes. Surroundings of an anchor that are equal as a whole repeat as a whole; different ones are
    compared by a suffix sort of their bytes. Equal texts are told by 128 bits of hash. Neither texts
    nor groups meet in one task: hot anchors are counted before they are shuffled, and beyond `crowd`
    different surroundings an anchor is settled by halving instead of sorting.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("a", F.xxhash64("text")).withColumn("b", F.xxhash64("text", F.lit(1)))
    long = rows.filter(F.octet_length("text") >= length)
    firsts = long.groupBy("a", "b").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    seen = _found(long, length)
    again = written(
        seen.groupBy("h").agg(F.count(F.lit(1)).alias("n"), (F.min("around") == F.max("around")).alias("same")).filter("n > 1")
    )
    # copies of a text are told apart by nothing here: one row each is enough
    places = written(join_to_unique(seen, again, "h", "n", ["a", "b", "pos"]).groupBy("h", "around", "same", "a", "b", "pos").agg(F.count(F.lit(1)).alias("n")))
    kinds = places.filter("not same").groupBy("h", "around").agg(F.sum("n").alias("n"), F.min(F.struct("a", "b", "pos")).alias("rep"))
    crowds = written(kinds.groupBy("h").agg(F.count(F.lit(1)).alias("kinds")).withColumn("_n", F.col("kinds")))
    kinds = written(join_to_unique(kinds, crowds, "h", "_n", ["around"]).select("h", "around", "n", "kinds", "rep.*"))
    reps = written(join_to_unique(_cut(long, kinds.join(firsts, ["a", "b"]), length), crowds, "h", "_n", ["around"]))
    partial = _sorted_compare(reps.filter(F.col("kinds") <= crowd), length)
    crowded = reps.filter(F.col("kinds") > crowd)
    if not crowded.isEmpty():
        partial = partial.union(_halving_compare(crowded, length))
    reach = length - GRAM
    whole = places.filter("same").select("a", "b", "pos").union(
        places.join(kinds.filter("n > 1").select("h", "around"), ["h", "around"]).select("a", "b", "pos")
    ).select("a", "b", (F.col("pos") - reach).alias("lo"), (F.col("pos") + length).alias("hi"))
    some = places.filter("not same").join(written(partial), ["h", "around"]).select("a", "b", (F.col("pos") + F.col("lo")).alias("lo"), (F.col("pos") + F.col("hi")).alias("hi"))
    ranges = whole.union(some).distinct().groupBy("a", "b").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    info = written(firsts.join(ranges, ["a", "b"], "left").filter("copies > 1 or ranges is not null").select("a", "b", "copies", "ranges"))
    nothing = [F.lit(1).cast("bigint").alias("copies"), F.lit(None).cast("array<struct<lo:bigint,hi:bigint>>").alias("ranges")]
    short = rows.filter(F.octet_length("text") < length).select("doc_id", "text", *nothing)
    return long.join(info, ["a", "b"], "left").select("doc_id", "text", "copies", "ranges").union(short)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 400, crowd: int = CROWD) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept: binary, kept_sha256) of each row.

    Every byte covered by a string of `length` bytes that also starts elsewhere in the corpus, in the same text
    or another, is removed, the first occurrence too. A null text counts as empty; repeated rows are
    copies of each other; rows stay in number, other columns are left out.
    """
    found = repeats(docs, doc_id, text, length, crowd)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(cols, _):
        out: list[list] = [cols[0], [], [], [], [], []]
        for raw, copies, ranges in zip(*cols[1:]):
            spans = _spans(raw, ranges, (copies or 1) > 1)
            kept, end = [], 0
            for a, b in spans:
                kept.append(raw[end:a])
                end = b
            kept.append(raw[end:])
            own = b"".join(kept)
            for column, value in zip(out[1:], (len(raw), len(raw) - len(own), len(spans), own, hashlib.sha256(own).hexdigest())):
                column.append(value)
        return out

    schema = f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string"
    return map_batches(found, run, schema)
