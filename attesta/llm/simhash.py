"""SimHash near-duplicates: fingerprints in one pass, links by multi-index hashing over their segments."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import join_to_unique
from ..session import written
from .common import map_batches
from .components import components

BITS = 64


def fingerprint(text: bytes | None, shingle: int) -> int:
    """SimHash of a text: a bit is set if it is set in over half of the XXH64 (seed 42) of its word shingles.

    A-Z are lowered, words are runs without ASCII white space, shingles count as often as they occur;
    a text of fewer words is one shingle, a null text or one without words gives 0.
    """
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[: len(words) - shingle])).tolist()
    counts = np.zeros(BITS, np.int64)
    digest, stops = xxhash.xxh64_intdigest, (ends[shingle - 1 :] - 1).tolist()
    for i in range(0, len(starts), 65536):
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts[i : i + 65536], stops[i : i + 65536])], ">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint of each whole text as a signed long. Other columns are left out."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(cols, _):
        values = [fingerprint(t, shingle) for t in cols[1]]
        return [cols[0], [v - (1 << 64) if v >> 63 else v for v in values]]

    return map_batches(docs.select(F.col(doc_id), F.col(text)), run, f"doc_id {kind}, fp bigint")


def segments(parts: int, distance: int) -> list[tuple[int, int, int]]:
    """(low bit, width, radius) of each segment.

    Of `distance` = parts * r + a differing bits, one of the first a + 1 segments holds at most r or
    one of the others at most r - 1; a radius below zero needs no probes.
    """
    r, a = divmod(distance, parts)
    widths = [BITS // parts + (i < BITS % parts) for i in range(parts)]
    lows = [sum(widths[:i]) for i in range(parts)]
    return [(lo, w, r if i <= a else r - 1) for i, (lo, w) in enumerate(zip(lows, widths))]


def masks(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in c) for n in range(radius + 1) for c in combinations(range(width), n)]


def _segment(fp: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))


def _ball(fp: Column, seg: int, low: int, width: int, radius: int) -> Column:
    """The values of a segment within `radius` bits of the fingerprint's own."""
    flips = F.array(*[F.lit(m).cast("long") for m in masks(width, radius)])
    own = _segment(fp, low, width)
    return F.transform(flips, lambda m: F.struct(F.lit(seg).alias("seg"), own.bitwiseXOR(m).alias("key")))


def links(fps: DataFrame, distance: int = 4, parts: int = 3, bucket: int = 1024) -> DataFrame:
    """(u, v): links between distinct fingerprints `fp` that differ in at most `distance` bits.

    Every fingerprint is stored under its own value of each segment and looked up under all values
    in a small Hamming ball around it; matches are verified over all 64 bits. Bigger tables take
    fewer, wider `parts`. The links connect the same groups as all pairs do: buckets of more than
    `bucket` fingerprints, whose pairs would grow with the square of their size, are linked through
    middle points instead (`_middle_links`), which is exact too.
    """
    parts_of = [(i, lo, w, r) for i, (lo, w, r) in enumerate(segments(parts, distance)) if r >= 0]
    own = F.array(*[F.struct(F.lit(i).alias("seg"), _segment(F.col("fp"), lo, w).alias("key")) for i, lo, w, _ in parts_of])
    table = fps.select("fp", F.inline(own))
    balls = [_ball(F.col("fp"), *p) for p in parts_of]
    probes = fps.select(F.col("fp").alias("p"), F.inline(F.flatten(F.array(*balls))))
    sizes = table.groupBy("seg", "key").agg(F.count(F.lit(1)).alias("n"))
    hot = written(sizes.filter(F.col("n") > bucket).drop("n"))
    near = F.bit_count(F.col("p").bitwiseXOR(F.col("fp"))) <= distance
    if hot.isEmpty():
        return probes.hint("merge").join(table, ["seg", "key"]).filter((F.col("p") < F.col("fp")) & near).select(F.col("p").alias("u"), F.col("fp").alias("v"))
    cold = probes.hint("merge").join(table.join(hot, ["seg", "key"], "left_anti"), ["seg", "key"])
    pairs = cold.filter((F.col("p") != F.col("fp")) & near).select(F.least("p", "fp").alias("u"), F.greatest("p", "fp").alias("v"))
    return pairs.union(_middle_links(probes.join(hot, ["seg", "key"], "left_semi"), parts_of, distance))


def _middle_links(probes: DataFrame, parts_of: list[tuple[int, int, int, int]], distance: int) -> DataFrame:
    """Links within crowded buckets: rows linear in the bucket, however close its members are.

    Two fingerprints differ in at most `distance` bits exactly if some point lies within half of it
    (rounded down) of one and within the rest of the other. In a bucket every probe names the points
    around it up to distance // 2 + distance % 2 bits; all that name a point are linked to the least
    fingerprint that names it within distance // 2, if the two are near enough.
    """
    low, high = distance // 2, distance - distance // 2
    around = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in masks(BITS, low)])
    named = probes.select("p").distinct().select("p", F.explode(F.transform(around, lambda m: F.col("p").bitwiseXOR(m))).alias("at"))
    if high == low:
        least = named.groupBy("at").agg(F.min("p").alias("m"))
        return named.join(least, "at").filter("m < p").select(F.col("m").alias("u"), F.col("p").alias("v")).distinct()
    steps = F.array(F.lit(0).cast("long"), *[F.shiftleft(F.lit(1).cast("long"), b) for b in range(BITS)])
    wide = named.select("p", F.explode(F.transform(steps, lambda m: F.col("at").bitwiseXOR(m))).alias("at")).distinct()
    least = named.groupBy("at").agg(F.min("p").alias("m"))
    return wide.join(least, "at").filter("m <> p").select(F.least("m", "p").alias("u"), F.greatest("m", "p").alias("v")).distinct()


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, distance: int = 4, parts: int = 3,
    bucket: int = 1024,
) -> DataFrame:
    """(doc_id, fp, component_id): each row with the smallest doc_id of its near-duplicate group.

    Groups are the connected components of links of at most `distance` differing bits. Null and empty
    texts have fingerprint 0 and link like any other; repeated rows stay; a null doc_id stays and never
    names a group (a group of null ids only has a null component_id). An empty table gives no rows.
    """
    prints = written(fingerprints(docs, doc_id, text, shingle))
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    pairs = written(links(nodes.select("fp"), distance, parts, bucket))
    found = components(pairs).withColumnRenamed("node", "fp")
    grouped = nodes.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = written(grouped.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("fps")))
    named = join_to_unique(grouped, least, "root", "fps", ["fp"]).select("fp", "n", "component_id")
    return join_to_unique(prints, written(named), "fp", "n", ["doc_id"]).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The rows of `docs`, all columns, with one row of each near-duplicate group: that of the least doc_id.

    Of repeated rows with that id one stays, the one with the least text. Rows without a doc_id stay:
    they have no identity by which a group could name them. `how`: arguments of `near_duplicates`.
    """
    doc_id, text = how.get("doc_id", "doc_id"), how.get("text", "text")
    groups = near_duplicates(docs, **how)
    kept = groups.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_kept")).distinct()
    own = docs.join(kept, F.col(doc_id) == F.col("_kept")).drop("_kept")
    first = Window.partitionBy(doc_id).orderBy(F.col(text).asc_nulls_first())
    own = own.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1").drop("_rank")
    return own.unionByName(docs.filter(F.col(doc_id).isNull()))
