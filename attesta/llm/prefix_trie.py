"""Prefix tries of conversations: double arrays per prefix shard, shared upper nodes merged globally."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import join_to_unique
from ..session import written

TURN = 20  # bytes of a turn in a sequence: 16 of its digest, 4 with the code points of its text
ID_BLOCK = 1024  # ids that are joined to one text before they are hashed
SHARD_BYTES = 8 << 20  # sequences held at once for one double array


def turn_code(role: Column, text: Column) -> Column:
    """40 hexadecimal digits of a turn: equal for equal (role, text) only; null counts as empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, F.lit(":"), text)
    return F.concat(F.substring(F.sha2(whole, 256), 1, 32), F.lower(F.lpad(F.hex(F.length(text)), 8, "0")))


def rebuilt(conversations: DataFrame, group: int = 100, heads: int = 6) -> DataFrame:
    """(conv_id, seq): every conversation with its beginning taken from the first one of its group.

    The first h turns of conversation c - c % group, where h is the CRC-32 of the decimal id modulo
    `heads`, then the own turns after the first h. `seq` holds TURN bytes a turn. Turns are ordered by
    `turn`, null first, equal ones by the digest of role and text. Rows without conv_id belong to no
    conversation. Texts leave with the first projection; a conversation is one row of TURN bytes a turn.
    """
    coded = conversations.filter(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", turn_code(F.col("role"), F.col("text")).alias("code")
    )
    own = coded.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "code"))).alias("turns")).select(
        "conv_id", F.transform("turns", lambda t: t["code"]).alias("turns")
    )
    own = written(own)
    first = own.filter(F.col("conv_id") % group == 0).select(
        F.col("conv_id").alias("_base"), F.slice("turns", 1, heads - 1).alias("_head")
    )
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    joined = own.withColumn("_base", F.col("conv_id") - F.col("conv_id") % group).withColumn("_h", h).join(first, "_base", "left")
    none = F.array().cast("array<string>")
    begin = F.when(F.col("_head").isNull(), none).otherwise(F.slice("_head", F.lit(1), F.col("_h")))
    rest = F.slice("turns", F.col("_h") + 1, F.greatest(F.size("turns") - F.col("_h"), F.lit(0)))
    return joined.select("conv_id", F.unhex(F.array_join(F.concat(begin, rest), "")).alias("seq"))


def sequences(paths: DataFrame) -> DataFrame:
    """Rows (seq, block, conv_id, n, ids): the ids of equal sequences, joined in blocks of neighbouring ids.

    Copies of one conversation, however many, meet as few rows of bounded length.
    """
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    return paths.groupBy("seq", F.floor(F.col("conv_id") / ID_BLOCK).alias("block")).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"), ids.alias("ids")
    )


class DoubleArray:
    """A trie in two arrays: child c of slot s is slot base[s] + c, where check of that slot is s.

    Slots are filled parents first. `base` may be negative, so a node with one child fits any free slot.
    """

    TRIES = 64  # slots tried for a node of several children before the end of the arrays is taken

    def __init__(self):
        self.base, self.check = [0], [-2]  # the root; -1 marks a free slot
        self.free = 1

    def place(self, slot: int, codes: list[int]) -> None:
        """Give slot `slot` the children `codes`, in ascending order."""
        check = self.check
        while self.free < len(check) and check[self.free] != -1:
            self.free += 1
        end = len(check)
        for at in range(self.free, min(end, self.free + self.TRIES)):
            if check[at] == -1 and all(at + c - codes[0] >= end or check[at + c - codes[0]] == -1 for c in codes):
                break
        else:
            at = end
        low = at - codes[0]
        if low + codes[-1] >= len(check):
            more = low + codes[-1] + 1 - len(check)
            check.extend([-1] * more)
            self.base.extend([0] * more)
        self.base[slot] = low
        for c in codes:
            check[low + c] = slot

    def child(self, slot: int, code: int) -> int:
        at = self.base[slot] + code
        return at if 0 <= at < len(self.check) and self.check[at] == slot else -1


def pack(rows: list[list[int]]) -> tuple[DoubleArray, list[int]]:
    """The double array of sorted, distinct rows of dense codes, and its slots with parents first."""
    trie, order, level = DoubleArray(), [0], [(0, 0, len(rows), 0)]
    while level:
        below = []
        for slot, lo, hi, depth in level:
            if lo < hi and len(rows[lo]) == depth:
                lo += 1  # the row that ends here
            codes, starts, i = [], [], lo
            while i < hi:
                code = rows[i][depth]
                codes.append(code)
                starts.append(i)
                i += 1
                while i < hi and rows[i][depth] == code:
                    i += 1
            if codes:
                trie.place(slot, codes)
                for code, start, end in zip(codes, starts, [*starts[1:], hi], strict=True):
                    at = trie.base[slot] + code
                    order.append(at)
                    below.append((at, start, end, depth + 1))
        level = below
    return trie, order


NODES = (
    "key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends_sha256 string, own_tokens long"
)
COLUMNS_OF_NODE = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def shard_nodes(rows: list[tuple[bytes, int, int, str]]) -> list[tuple]:
    """All nodes of one shard of sorted, distinct sequences (seq, least id, ids, digest of the ids).

    Nodes on the paths of the first and the last sequence may go on in other shards: they carry their
    key, and count only what hangs off these paths (n_children, n_leaves, saved_tokens). All others are
    complete; `parent_key` is set where the parent is a shared one.
    """
    codes: dict[bytes, int] = {}
    dense = []
    for seq, *_ in rows:
        # codes in order of first appearance: children come in ascending order
        dense.append([codes.setdefault(seq[i : i + TURN], len(codes)) for i in range(0, len(seq), TURN)])
    lengths = [struct.unpack(">I", t[16:])[0] for t in codes]
    # the same turn may have been met earlier on another path, so rows are put in the order of their codes
    at = sorted(range(len(rows)), key=dense.__getitem__)
    trie, order = pack([dense[i] for i in at])

    size = len(trie.check)
    count, least, depth, last = [0] * size, [0] * size, [0] * size, [0] * size
    ends: list[str | None] = [None] * size
    shared: dict[int, bytes] = {}
    for i in at:
        seq, conv, n, digest = rows[i]
        on_edge = i in (0, len(rows) - 1)
        running = hashlib.md5() if on_edge else None
        slot = 0
        for d, code in enumerate([None, *dense[i]]):
            if code is not None:
                slot = trie.child(slot, code)
                depth[slot], last[slot] = d, lengths[code]
            least[slot] = conv if not count[slot] else min(least[slot], conv)
            count[slot] += n
            if on_edge:
                running.update(seq[(d - 1) * TURN : d * TURN] if d else b"")
                shared[slot] = running.copy().digest()
        ends[slot] = digest

    children, leaves, saved = [0] * size, [0] * size, [0] * size
    for slot in reversed(order):
        if slot not in shared:
            leaves[slot] += not children[slot]
            saved[slot] += (count[slot] - 1) * last[slot]
            parent = trie.check[slot]
            children[parent] += 1
            leaves[parent] += leaves[slot]
            saved[parent] += saved[slot]
    out = []
    for slot in order:
        parent = trie.check[slot]
        out.append(
            (
                shared.get(slot), shared.get(parent), least[slot], depth[slot], None if parent < 0 else least[parent],
                count[slot], children[slot], leaves[slot], saved[slot], ends[slot], last[slot],
            )
        )
    return out


def _shards(batches: Iterator[pa.RecordBatch], schema: pa.Schema, limit: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows of `sequences` -> nodes, shard by shard; one sequence's ids are hashed as they come."""
    rows: list[tuple] = []
    held, now, digest = 0, None, None

    def nodes() -> Iterator[pa.RecordBatch]:
        cols = list(zip(*shard_nodes(rows), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    for batch in batches:
        for seq, conv, n, ids in zip(*(batch.column(c).to_pylist() for c in ("seq", "conv_id", "n", "ids")), strict=True):
            if now is not None and now[0] == seq:
                digest.update(b"," + ids.encode())
                now = (seq, min(now[1], conv), now[2] + n)
                continue
            if now is not None:
                rows.append((*now, digest.hexdigest()))
                held += len(now[0]) + 64
                if held > limit:
                    yield from nodes()
                    rows, held = [], 0
            now, digest = (seq, conv, n), hashlib.sha256(ids.encode())
    if now is not None:
        rows.append((*now, digest.hexdigest()))
        yield from nodes()


def _subtree_sums(upper: DataFrame, deepest: int) -> DataFrame:
    """Adds up `leaves` and `saved` over the subtree of each node, by doubling steps towards the root.

    upper(key, jump, leaves, saved): `jump` is the parent. After round r a node has the sums of all
    descendants nearer than 2^r steps.
    """
    reach = 1
    while reach <= deepest:
        got = upper.filter(F.col("jump").isNotNull()).groupBy(F.col("jump").alias("key")).agg(
            F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"), F.count(F.lit(1)).alias("_n")
        )
        after = upper.join(got, "key", "left")
        after = written(
            after.select(
                "key", "jump", (F.col("leaves") + F.coalesce("_leaves", F.lit(0))).alias("leaves"),
                (F.col("saved") + F.coalesce("_saved", F.lit(0))).alias("saved"), "_n", F.col("jump").alias("_next"),
            )
        )
        goals = after.filter(F.col("_n").isNotNull()).select(F.col("key").alias("jump"), F.col("_n").alias("_in"), F.col("_next").alias("_far"))
        moved = join_to_unique(after.filter(F.col("jump").isNotNull()).select("key", "jump", "leaves", "saved"), goals, "jump", "_in", ["key"])
        # a node whose goal has no parent is done
        upper = written(
            moved.select("key", F.col("_far").alias("jump"), "leaves", "saved").unionByName(
                after.filter(F.col("jump").isNull()).select("key", "jump", "leaves", "saved")
            )
        )
        reach *= 2
    return upper.select("key", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))


def trie_nodes(paths: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Nodes of the trie of all paths(conv_id, seq): one row per distinct prefix, the root included.

    Sequences are sorted over all tasks, equal ones once with their ids; each task packs its range into
    double arrays of at most `shard_bytes` of sequences and walks them. A range has a third of all
    conversations if need be, in several shards: nodes that two shards can share lie on the paths of
    their first and last sequences, and only these are merged, their subtree sums by doubling steps.
    Without conversations there is no node.

    Returns conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256 (of the decimal ids of the members that end here, ascending, joined by commas).
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(paths.sparkSession.createDataFrame([], NODES).schema)
    rows = written(sequences(paths))
    ranged = rows.repartitionByRange("seq").sortWithinPartitions("seq", "block")

    def run(batches):
        yield from _shards(batches, schema, shard_bytes)

    nodes = written(ranged.mapInArrow(run, NODES))
    open_ = nodes.filter(F.col("key").isNotNull())
    merged = written(
        open_.groupBy("key").agg(
            F.min("conv_id").alias("conv_id"), F.max("parent_key").alias("parent_key"), F.max("depth").alias("depth"),
            F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"),
            F.sum("saved_tokens").alias("saved_tokens"), F.max("ends_sha256").alias("ends_sha256"), F.max("own_tokens").alias("own_tokens"),
        )
    )
    kids = merged.filter(F.col("parent_key").isNotNull()).groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("_kids"))
    upper = written(
        merged.join(kids, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("_kids", F.lit(0)))
    )
    start = upper.select(
        "key", F.col("parent_key").alias("jump"), (F.col("n_leaves") + (F.col("n_children") == 0).cast("long")).alias("leaves"),
        (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("own_tokens")).alias("saved"),
    )
    deepest = upper.agg(F.max("depth").alias("d")).first().d
    sums = _subtree_sums(written(start), deepest or 0)
    shared = upper.drop("n_leaves", "saved_tokens", "_kids").join(sums, "key")

    # least member of the parent, where that is a shared node: `n_children` rows ask for each
    asked = shared.select("parent_key", *COLUMNS_OF_NODE).unionByName(
        nodes.filter(F.col("key").isNull() & F.col("parent_key").isNotNull()).select("parent_key", *COLUMNS_OF_NODE)
    )
    owners = upper.filter("n_children > 0").select(F.col("key").alias("parent_key"), "n_children", F.col("conv_id").alias("parent_conv_id"))
    below = join_to_unique(asked.filter(F.col("parent_key").isNotNull()), owners, "parent_key", "n_children", ["conv_id", "depth"])
    root = shared.filter(F.col("parent_key").isNull()).withColumn("parent_conv_id", F.lit(None).cast("long"))
    inner = nodes.filter(F.col("key").isNull() & F.col("parent_key").isNull())
    every = below.drop("parent_key")
    for part in (root, inner):
        every = every.unionByName(part.select(*every.columns))
    return every.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations (conv_id, turn, role, text); other columns are not read."""
    return trie_nodes(rebuilt(conversations))


SQL = """
WITH coded AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, substr(sha256(length(role) || ':' || role || ':' || text), 1, 32)) AS turns
  FROM coded GROUP BY conv_id
), heads AS (
  SELECT conv_id, turns, conv_id - conv_id % 100 AS base,
    (xor(list_reduce(
      list_concat([4294967295::UBIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
      lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)::UBIGINT[]), lambda x, i: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))
    ), 4294967295::UBIGINT) % 6)::BIGINT AS h
  FROM own
), paths AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) AS seq FROM heads c LEFT JOIN own b ON b.conv_id = c.base
), steps AS (
  SELECT conv_id, seq, d, seq[1:d] AS prefix FROM paths, LATERAL (SELECT unnest(range(len(seq) + 1)) AS d)
), nodes AS (
  SELECT prefix, d, min(conv_id) AS conv_id, count(*) AS n,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE d = len(seq)), '')) AS ends
  FROM steps GROUP BY prefix, d
), kids AS (
  SELECT prefix[1:d - 1] AS prefix, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL
), counted AS (
  SELECT v.*, coalesce(k.n, 0) AS children, CASE WHEN v.d = 0 THEN 0 ELSE (v.n - 1) * length(v.prefix[v.d].t) END AS own
  FROM nodes v LEFT JOIN kids k ON k.prefix = v.prefix AND k.d = v.d
), below AS (
  SELECT s.prefix, s.d, sum((c.children = 0)::BIGINT) AS leaves, sum(c.own) AS saved
  FROM counted c JOIN steps s ON s.conv_id = c.conv_id AND s.d <= c.d GROUP BY s.prefix, s.d
)
SELECT c.conv_id, c.d AS depth, p.conv_id AS parent_conv_id, c.n AS n_convs, c.children AS n_children,
  b.leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, c.ends AS ends_sha256
FROM counted c JOIN below b ON b.prefix = c.prefix AND b.d = c.d
LEFT JOIN counted p ON c.d > 0 AND p.d = c.d - 1 AND p.prefix = c.prefix[1:c.d - 1]
"""
