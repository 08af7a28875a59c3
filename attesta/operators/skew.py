"""Joins and running values that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_SHARE = 1000  # a key is hot above 1/1000 of the rows, so there are fewer than 1000 hot keys
SALTS = 256


def join_to_unique(
    left: DataFrame, right: DataFrame, key: str, count_col: str, spread_by: list[str], how: str = "inner"
) -> DataFrame:
    """Join `left` to `right`, which has one row per key and the number of left rows in `count_col`.

    Hot keys are matched through a broadcast that holds fewer than HOT_SHARE rows whatever the data
    size; their left rows (and those without a key) are then salted so that they do not meet in one shuffle
    partition. All other keys go through an ordinary shuffle join.
    """
    payload = [c for c in right.columns if c not in (key, count_col)]
    total = right.agg(F.sum(count_col)).scalar()
    is_hot = F.col(count_col) * HOT_SHARE > total
    packed = F.struct(*payload)
    hot = right.filter(is_hot).select(key, packed.alias("_hot"))
    # not a literal: that would drop out of the join keys, and hot rows would be shuffled by their key alone
    zero = F.least(F.col(count_col).cast("long"), F.lit(0).cast("long"))
    cold = right.filter(~is_hot).select(F.col(key).alias("_k"), zero.alias("_s"), packed.alias("_cold"))

    tagged = left.join(F.broadcast(hot), key, "left").withColumn(
        "_salt",
        F.when(F.col("_hot").isNotNull() | F.col(key).isNull(), F.pmod(F.xxhash64(*spread_by), F.lit(SALTS)) + 1).otherwise(F.lit(0).cast("long")),
    )
    joined = tagged.join(
        cold, (F.col(key) == F.col("_k")) & (F.col("_salt") == F.col("_s")), "left"
    ).withColumn("_hit", F.coalesce("_hot", "_cold"))
    if how == "inner":
        joined = joined.filter(F.col("_hit").isNotNull())
    return joined.select(*left.columns, *[F.col(f"_hit.{c}").alias(c) for c in payload])


def running(
    df: DataFrame,
    part: list[str],
    blocks: list[Column],
    order: list[str],
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    inclusive: bool = True,
) -> DataFrame:
    """Running sums and last non-null values per `part`, computed block by block.

    Every window covers one block; only one summary row per block is carried on to the next level
    (`blocks` go from fine to coarse). A part with very many rows is thus spread over many tasks.
    """
    sums, lasts = sums or {}, lasts or {}
    frame_end = 0 if inclusive else -1
    if not blocks:
        w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, frame_end)
        return df.select(
            "*",
            *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(n) for n, c in sums.items()],
            *[F.last(c, ignorenulls=True).over(w).alias(n) for n, c in lasts.items()],
        )

    base = df.withColumn("_b", blocks[0])
    w = Window.partitionBy(*part, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, frame_end)
    inside = base.select(
        "*",
        *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"_in_{n}") for n, c in sums.items()],
        *[F.last(c, ignorenulls=True).over(w).alias(f"_in_{n}") for n, c in lasts.items()],
    )
    summary = base.groupBy(*part, "_b").agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()],
        *[
            F.max(F.when(c.isNotNull(), F.struct(*order, c.alias("_v")))).getField("_v").alias(f"_t_{n}")
            for n, c in lasts.items()
        ],
    )
    coarse = [F.floor(F.col("_blk") / 1024)] if len(blocks) > 1 else []
    carried = running(
        summary.withColumnRenamed("_b", "_blk"), part, coarse, ["_blk"],
        {f"_c_{n}": F.col(f"_t_{n}") for n in sums}, {f"_c_{n}": F.col(f"_t_{n}") for n in lasts}, inclusive=False,
    ).select(*part, F.col("_blk").alias("_b"), *[f"_c_{n}" for n in [*sums, *lasts]])
    out = inside.join(carried, [*part, "_b"])
    return out.select(
        *df.columns,
        *[(F.col(f"_in_{n}") + F.col(f"_c_{n}")).alias(n) for n in sums],
        *[F.coalesce(f"_in_{n}", f"_c_{n}").alias(n) for n in lasts],
    )


def first_per_key(df: DataFrame, key: list[Column], order: list[Column]) -> DataFrame:
    """One row per key, the lowest in `order`. Aggregated before the shuffle, so hot keys shrink first."""
    cols = df.columns
    return (
        df.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(key)])
        .agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_row"))
        .select("_row.*")
    )
