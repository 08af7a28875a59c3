"""Near-duplicates by similarity: long SimHashes of shingle sets, multi-index hashing over wide segments."""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, comb, log, log2, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import join_to_unique
from ..session import written
from .common import map_batches
from .components import components

CHECKED = 256  # bits over which distances are verified
CROWD = 4  # nodes of a point; those of a point that more of them name are compared by `_crowd_links`


def bit_share(similarity: float) -> float:
    """Expected share of differing SimHash bits of two sets with this Jaccard similarity."""
    return acos(2 * similarity / (1 + similarity)) / pi


def plan(n: int, similarity: float, recall: float) -> tuple[int, int]:
    """(width, number) of segments: wide enough for `n` sets to meet few strangers, as many as the recall takes.

    Two sets meet in a segment if they differ in at most 2 of its bits.
    """
    width, p = max(12, ceil(log2(max(n, 2))) + 6), bit_share(similarity)
    meet = sum(comb(width, d) * p**d * (1 - p) ** (width - d) for d in range(3))
    return width, max(1, ceil(log(1 - recall) / log(1 - meet)))


def shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """XXH64 of the distinct word shingles, ascending: A-Z lowered, words split at ASCII white space.

    A text of fewer words is one shingle; a null text or one without words has none.
    """
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: len(words) - shingle].tolist()]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], 42) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)], np.uint64))


def _mixed(hashes: np.ndarray, number: int) -> np.ndarray:
    """64 further bits of each hash."""
    x = hashes + np.uint64((number * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def simhash_bits(hashes: np.ndarray, bits: int) -> np.ndarray:
    """One bit per position: whether over half of the set's hashes have it; `bits` is a multiple of 64."""
    counts = np.zeros(bits, np.int64)
    for lo in range(0, len(hashes), 16384):
        part = hashes[lo : lo + 16384]
        wide = np.stack([_mixed(part, i) for i in range(bits // 64)], axis=1)
        counts += np.unpackbits(wide.view(np.uint8).reshape(len(part), -1), axis=1).sum(axis=0, dtype=np.int64)
    return 2 * counts > len(hashes)


def prints(docs: DataFrame, width: int, number: int, doc_id: str, text: str, shingle: int) -> DataFrame:
    """(doc_id, node, segments, f0..f3): identity of the shingle set, values of its segments, CHECKED bits."""
    kind = docs.schema[doc_id].dataType.simpleString()
    bits = max(CHECKED, -(-width * number // 64) * 64)
    powers = 1 << np.arange(width, dtype=np.int64)

    def run(cols, _):
        out: list[list] = [cols[0], [], [], [], [], [], []]
        for raw in cols[1]:
            hashes = shingle_hashes(raw, shingle)
            own = simhash_bits(hashes, bits)
            out[1].append(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), 7)).astype(np.int64).item() if len(hashes) else 0)
            out[2].append((own[: width * number].reshape(number, width) @ powers).tolist())
            for column, value in zip(out[3:], np.packbits(own[:CHECKED]).view(np.int64).tolist(), strict=True):
                column.append(value)
        return out

    schema = f"doc_id {kind}, node bigint, segments array<bigint>, f0 bigint, f1 bigint, f2 bigint, f3 bigint"
    return map_batches(docs.select(F.col(doc_id), F.col(text)), run, schema)


def _points(width: int) -> Column:
    """The points a node names: each segment's value and those one bit away, with the segment's number above them."""
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << b).cast("long") for b in range(width)])
    own = F.transform("segments", lambda s, i: s.bitwiseOR(F.shiftleft(i.cast("long"), width)))
    return F.flatten(F.transform(own, lambda s: F.transform(flips, lambda m: s.bitwiseXOR(m))))


def _meetings(batches: Iterator[pa.RecordBatch], points: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows (point, node) sorted by both -> (u, v), u < v: all pairs of a point named by few nodes; of a crowded
    one each node with the first. Runs may go over batches; little is held.

    With `points` a third column names the crowded point, so that all of its nodes can be told; null for others.
    """
    held_k, held_v = np.empty(0, np.int64), np.empty(0, np.int64)
    crowd: tuple[int, int] | None = None  # point and first node of a crowded run that goes on

    def found(us: list, vs: list, at: list) -> Iterator[pa.RecordBatch]:
        if not us:
            return
        both = np.stack((np.concatenate(us), np.concatenate(vs)), axis=1)
        at = np.concatenate([np.full(len(u), p) for u, p in zip(us, at, strict=True)])
        for of_few in (True, False):
            some = (at < 0) == of_few
            if not points:
                some = np.full(len(at), of_few)
            own = both[some]
            if not len(own):
                continue
            if of_few:
                own = np.unique(own, axis=0)
                own = own[own[:, 0] != own[:, 1]]
            columns = [pa.array(own[:, 0]), pa.array(own[:, 1])]
            if points:
                columns.append(pa.nulls(len(own), pa.int64()) if of_few else pa.array(at[some]))
            yield pa.RecordBatch.from_arrays(columns, names=["u", "v", "point"][: len(columns)])

    def complete(k: np.ndarray, v: np.ndarray, sizes: np.ndarray) -> tuple[list, list, list]:
        us, vs, ps = [], [], []
        few = np.repeat(sizes <= CROWD, sizes)
        for d in range(1, CROWD):
            if d >= len(k):
                break
            at = np.flatnonzero((k[d:] == k[:-d]) & few[d:])
            if not len(at):
                break
            us.append(v[at])
            vs.append(v[at + d])
            ps.append(-1)
        ends = np.cumsum(sizes)
        for i in np.flatnonzero(sizes > CROWD):
            a, b = ends[i] - sizes[i], ends[i]
            us.append(np.full(b - a - 1, v[a]))
            vs.append(v[a + 1 : b])
            ps.append(k[a])
        return us, vs, ps

    for batch in batches:
        k, v = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        us: list = []
        vs: list = []
        ps: list = []
        if crowd is not None and len(k):
            n = int(np.searchsorted(k, crowd[0], "right"))
            if n:
                us.append(np.full(n, crowd[1]))
                vs.append(v[:n])
                ps.append(crowd[0])
                k, v = k[n:], v[n:]
            if len(k):
                crowd = None
        k, v = np.concatenate((held_k, k)), np.concatenate((held_v, v))
        held_k = held_v = np.empty(0, np.int64)
        if len(k):
            starts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            last = starts[-1]
            u, w, p = complete(k[:last], v[:last], np.diff(starts))
            us += u
            vs += w
            ps += p
            if len(k) - last > CROWD:
                u, w, p = complete(k[last:], v[last:], np.array([len(k) - last]))
                us += u
                vs += w
                ps += p
                crowd = (int(k[-1]), int(v[last]))
            else:
                held_k, held_v = k[last:], v[last:]
        yield from found(us, vs, ps)
    if len(held_k) > 1:
        yield from found(*complete(held_k, held_v, np.array([len(held_k)])))


def _spanning(bits: np.ndarray, segments: np.ndarray, most64: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (u, v) of links that connect all rows of `bits` (n x 4 words) which a chain of near rows connects.

    Near: at most `most64` differing bits in the first word and `most` in all four, and a common point, which is
    at most 2 differing bits in one of the `segments`. Every row that was reached is compared with all that were
    not, so nothing is left out; a group of n near rows costs about n comparisons and gives n - 1 links.
    """
    left = np.arange(len(bits))
    us, vs = [], []
    while len(left) > 1:
        reached, left = [int(left[0])], left[1:]
        while reached and len(left):
            one = reached.pop()
            near = np.bitwise_count(bits[left, 0] ^ bits[one, 0]) <= most64
            at = np.flatnonzero(near)
            far = np.bitwise_count(bits[left[at]] ^ bits[one]).sum(axis=1, dtype=np.int64) > most
            apart = (np.bitwise_count(segments[left[at]] ^ segments[one]) > 2).all(axis=1)
            near[at[far | apart]] = False
            found = left[near]
            us += [one] * len(found)
            vs += found.tolist()
            reached += found.tolist()
            left = left[~near]
    return np.array(us, np.int64), np.array(vs, np.int64)


def _crowds(met: DataFrame) -> DataFrame:
    """(point, node) of what `_meetings` tells of crowded points: those with the same first node are one crowd,
    named by that node, and a node is in it once.

    A group of copies crowds nearly all points of its nodes, and most have the same first one: a row per point and
    node would repeat the same nodes by their number of points.
    """
    crowded = met.filter("point IS NOT NULL")
    return crowded.select(F.col("u").alias("point"), F.col("v").alias("node")).union(crowded.select("u", "u")).distinct()


def _crowd_links(crowds: DataFrame, nodes: DataFrame, most64: int, most: int) -> DataFrame:
    """(u, v) of crowds(point, node): links that leave all nodes of a crowd connected that its near pairs connect."""
    words = ["f0", "f1", "f2", "f3"]
    own = crowds.join(nodes.select("node", *words, "segments"), "node").select("point", "node", *words, "segments")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the nodes of one crowd

        def linked() -> pa.RecordBatch:
            rows = np.concatenate(held)
            u, v = _spanning(np.ascontiguousarray(rows[:, 2:6]).view(np.uint64), rows[:, 6:], most64, most)
            a, b = rows[u, 1], rows[v, 1]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            plain = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:6]], axis=1)
            rows = np.hstack((plain, batch.column(6).flatten().to_numpy().reshape(len(plain), -1)))
            for part in np.split(rows, np.flatnonzero(np.diff(rows[:, 0])) + 1):
                if held and held[0][0, 0] != part[0, 0]:
                    yield linked()
                    held.clear()
                held.append(part)
        if held:
            yield linked()

    return own.repartition("point").sortWithinPartitions("point", "node").mapInArrow(run, "u bigint, v bigint").distinct()


def links(nodes: DataFrame, width: int, similarity: float, slack: float = 1.25) -> DataFrame:
    """(u, v): nodes whose CHECKED bits differ in no more bits than sets of this similarity do, `slack` standard
    deviations added. nodes(node, segments, f0..f3). Of points that many nodes name, as many of these pairs as
    connect what all of them connect (`_crowds`).

    Candidates name a common point: their segments differ in at most 2 bits. A node names (width + 1) points a
    segment, so no point holds more than that share of the rows, however large a group of copies is.
    """
    points = nodes.select(F.explode(_points(width)).alias("point"), "node")
    sorted_points = points.repartition("point").sortWithinPartitions("point", "node")
    every = written(sorted_points.mapInArrow(lambda batches: _meetings(batches, True), "u bigint, v bigint, point bigint"))
    met = every.filter("point IS NULL").select("u", "v").distinct()
    p = bit_share(similarity)

    def most(bits: int, deviations: float) -> int:
        return int(bits * p + deviations * (bits * p * (1 - p)) ** 0.5)

    def differing(columns: list[str]) -> Column:
        return sum((F.bit_count(F.col(f"u_{c}").bitwiseXOR(F.col(f"v_{c}"))) for c in columns[1:]), F.bit_count(F.col(f"u_{columns[0]}").bitwiseXOR(F.col(f"v_{columns[0]}"))))

    def verified(pairs: DataFrame, columns: list[str], limit: int) -> DataFrame:
        for side in ("u", "v"):
            own = nodes.select(F.col("node").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in columns])
            pairs = pairs.hint("merge").join(own, side)
        return pairs.filter(differing(columns) <= limit).select("u", "v")

    # 64 bits first: they leave few pairs for the others
    near = written(verified(met, ["f0"], most(64, 3.0)))
    few = verified(near, ["f0", "f1", "f2", "f3"], most(CHECKED, slack))
    return few.union(_crowd_links(_crowds(every), nodes, most(64, 3.0), most(CHECKED, slack))).distinct()


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, recall: float = 0.92,
) -> DataFrame:
    """(doc_id, node, component_id): each row with the least doc_id of its group of near-duplicates.

    Texts with equal shingle sets are one node (told apart by 64 bits of hash); nodes are linked by
    `links`, groups are connected components. `recall` is the share of pairs at exactly this similarity that
    meet in a segment. Null and empty texts are one group; repeated rows stay; a null doc_id never names a
    group. An empty table gives no rows.
    """
    width, number = plan(docs.count(), similarity, recall)
    found = written(prints(docs, width, number, doc_id, text, shingle))
    # equal nodes have equal values
    firsts = [F.min(c).alias(c) for c in ("f0", "f1", "f2", "f3", "segments")]
    nodes = written(found.groupBy("node").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"), *firsts))
    groups = components(written(links(nodes, width, similarity)))
    grouped = nodes.select("node", "first", "n").join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = written(grouped.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("m")))
    named = written(join_to_unique(grouped, least, "root", "m", ["node"]).select("node", "n", "component_id"))
    return join_to_unique(found.select("doc_id", "node"), named, "node", "n", ["doc_id"]).select("doc_id", "node", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of `docs`, all columns, with one row of each group of near-duplicates: that of the least doc_id.

    Of repeated rows with that id one stays, the one with the least text; rows without a doc_id stay. `how`:
    arguments of `near_duplicates`.
    """
    groups = near_duplicates(docs, doc_id, text, **how)
    kept = groups.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_kept")).distinct()
    own = docs.join(kept, F.col(doc_id) == F.col("_kept")).drop("_kept")
    first = Window.partitionBy(doc_id).orderBy(F.col(text).asc_nulls_first())
    own = own.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1").drop("_rank")
    return own.unionByName(docs.filter(F.col(doc_id).isNull()))
