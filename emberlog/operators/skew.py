"""Joins that a hot key can't hold up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it has 1/HOT_KEYS of all rows, and LEAST_ROWS of them; so there are at most HOT_KEYS hot keys.
HOT_KEYS, LEAST_ROWS = 16_384, 1_000


def spread_join(left: DataFrame, right: DataFrame, key: list[str], weight: str, how: str = "inner") -> DataFrame:
    """left joined with right (inner or left), which has one row a key and, in `weight`, about how many rows left has of it.

    Rows of hot keys meet broadcast rows of right: at most HOT_KEYS rows, whatever the input, as the weights of all keys add
    up to the total. They then pass the shuffle join under keys of their own, dealt evenly; the other keys meet there.
    Right's columns should be scalars. Null keys match nothing.
    """
    total = right.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    least = max(LEAST_ROWS, total // HOT_KEYS)
    names = [c for c in right.columns if c not in (*key, weight)]
    found = F.struct(*names)
    hot = right.where(F.col(weight) >= least).select(*key, found.alias("__hot"))
    cold = right.where(F.col(weight) < least).select(*key, F.when(F.col(weight) >= 0, F.lit(0).cast("long")).alias("__spread"), found.alias("__cold"))  # no literal: that would be folded away
    spread = F.when(F.col("__hot").isNull(), F.lit(0)).otherwise(F.xxhash64(*left.columns).bitwiseOR(F.lit(1)))
    rows = left.join(F.broadcast(hot), key, "left").withColumn("__spread", spread)
    rows = rows.join(cold.hint("merge"), [*key, "__spread"], "left").withColumn("__found", F.coalesce("__hot", "__cold"))
    if how == "inner":
        rows = rows.where("__found is not null")
    return rows.select(*left.columns, *[F.col("__found")[n].alias(n) for n in names])
