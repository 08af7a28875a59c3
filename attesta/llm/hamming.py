"""Exact top-k search of binary codes by incremental multi-index hashing."""

from __future__ import annotations

from itertools import combinations
from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import join_to_unique
from ..session import written

BITS = 64


def sign_code(vector: Column) -> Column:
    """The signs of up to 64 values as a long: bit i is set if value i is above zero; null for a null vector."""
    bits = F.transform(vector, lambda v, i: F.when(v > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def _segments(codes: int) -> list[tuple[int, int]]:
    """(low bit, width) of segments about as wide as log2 of a quarter of the codes: a few codes per bucket."""
    parts = min(16, max(2, ceil(BITS / max(4.0, log2(max(codes, 2) / 4)))))
    widths = [BITS // parts + (i < BITS % parts) for i in range(parts)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def _segment(code: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(code, low).bitwiseAND(F.lit((1 << width) - 1))


def _flips(width: int, radius: int) -> Column:
    return F.array(*[F.lit(sum(1 << b for b in c)).cast("long") for c in combinations(range(width), radius)])


def _ball(code: Column, seg: int, low: int, width: int, radius: int) -> Column:
    own = _segment(code, low, width)
    return F.transform(_flips(width, radius), lambda m: F.struct(F.lit(seg).alias("seg"), own.bitwiseXOR(m).alias("key")))


def search(codes: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, id, distance): the k nearest rows of `codes` for every row of `queries`, exactly.

    Both have `id` and `code` (64 bits as a long). Rank 1 is nearest, ties go to the smaller id; a table of
    fewer than k rows gives them all. Rows with a null code or id are left out; repeated rows count
    each. The index holds distinct codes (with their k least ids) under their value of each segment.
    Round r looks up all values at r flipped bits of a query's segments. A pair is met once: in the
    round of its nearest segment, at the first such segment. After round r with s segments every code
    at distance < s * (r + 1) has been met, so a query is settled when its k-th distance is; the others
    go on. A pair beyond the k-th distance so far is dropped in the join.
    """
    rows = codes.filter(F.col("code").isNotNull() & F.col("id").isNotNull()).select("id", "code")
    least = Window.partitionBy("code").orderBy("id")
    held = rows.withColumn("n", F.row_number().over(least)).filter(F.col("n") <= k)
    index = written(held.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    asked = queries.filter(F.col("code").isNotNull() & F.col("id").isNotNull())
    wanted = written(asked.groupBy("code").agg(F.count(F.lit(1)).alias("asked")))
    parts = _segments(index.count())
    own = F.array(*[F.struct(F.lit(i).alias("seg"), _segment(F.col("code"), lo, w).alias("key")) for i, (lo, w) in enumerate(parts)])
    table = written(index.select("code", F.inline(own)))

    found = None  # (q, code, distance): the best so far of open queries
    open_queries = wanted.select(F.col("code").alias("q"), F.lit(BITS).alias("bound"))
    settled = []
    for radius in range(max(w for _, w in parts) + 1):
        balls = [_ball(F.col("q"), i, lo, w, radius) for i, (lo, w) in enumerate(parts) if radius <= w]
        probes = open_queries.select("q", "bound", F.inline(F.flatten(F.array(*balls))))
        apart = F.col("q").bitwiseXOR(F.col("code"))
        nearest = [F.bit_count(_segment(apart, lo, w)) for lo, w in parts]
        first = F.lit(True)
        for i, n in enumerate(nearest):
            first = first & F.when(F.col("seg") > i, n > radius).otherwise(n >= radius)
        # merged, not broadcast: the planner does not see how many rows the probes of a query make
        met = probes.hint("merge").join(table, ["seg", "key"]).filter(first & (F.bit_count(apart) <= F.col("bound")))
        met = met.select("q", "code", F.bit_count(apart).alias("distance"))
        best = _best(met if found is None else met.unionByName(found), index, k)
        done = len(parts) * (radius + 1)
        state = best.groupBy("q").agg(F.sum("n").alias("n"), F.max("distance").alias("bound"))
        state = written(
            open_queries.select("q").join(state, "q", "left")
            .select("q", F.when(F.coalesce("n", F.lit(0)) >= k, F.col("bound")).otherwise(F.lit(BITS)).alias("bound"))
            .withColumn("settled", (F.col("bound") < done) | F.lit(done > BITS))
        )
        best = written(best.join(state.select("q", "settled"), "q"))
        settled.append(best.filter("settled").select("q", "code", "distance"))
        found = best.filter("not settled").select("q", "code", "distance")
        open_queries = state.filter("not settled").select("q", "bound")
        if open_queries.isEmpty():
            break
    answers = settled[0]
    for s in settled[1:]:
        answers = answers.unionByName(s)
    hits = answers.join(index, "code").select("q", F.col("distance"), F.explode("ids").alias("hit"))
    order = Window.partitionBy("q").orderBy("distance", "hit")
    ranked = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    lists = ranked.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("rank", "hit", "distance"))).alias("hits"))
    lists = lists.join(wanted.withColumnRenamed("code", "q"), "q").withColumnRenamed("q", "code")
    answered = join_to_unique(asked.select(F.col("id").alias("query_id"), "code"), written(lists), "code", "asked", ["query_id"])
    return answered.select("query_id", F.inline("hits")).select("query_id", "rank", F.col("hit").alias("id"), "distance")


def _best(met: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """The nearest codes of each query that its k nearest rows can come from, with their numbers of ids."""
    order = Window.partitionBy("q").orderBy("distance", "first")
    sized = met.join(index.select("code", F.size("ids").alias("n"), F.get("ids", F.lit(0)).alias("first")), "code")
    kept = sized.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= k)
    # rows at a smaller distance; ties by id are between all codes of a distance
    before = F.sum("n").over(Window.partitionBy("q").orderBy("distance").rangeBetween(Window.unboundedPreceding, -1))
    return kept.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < k).select("q", "code", "distance", "n")


SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS s FROM embeddings WHERE embedding IS NOT NULL),
p AS (SELECT q.vec_id AS query_id, t.vec_id AS id, len(list_filter(range(1, len(q.s) + 1), lambda i: q.s[i] <> t.s[i])) AS distance FROM e q, e t WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INTEGER AS rank, id, distance::INTEGER AS distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM p) WHERE rank <= 10
"""
