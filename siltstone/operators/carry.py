"""Values carried forward over rows that lie on different tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carried(rows: DataFrame, *, keys: Sequence[str], block: Column, order: Sequence[Column], columns: dict[str, Column]) -> DataFrame:
    """The rows with one more column for each name in ``columns``: the last value that
    isn't null in the rows of the same keys before it, or null.

    ``block`` cuts each key's rows into stretches that follow each other in ``order``
    (rows that compare equal are in one). The last values of the blocks, one row each,
    are scanned over a key's blocks; each block then fills its own rows. So no task
    holds a key's rows, and what moves twice is one row a block. Null keys are keys, and
    nulls come first in the order.
    """
    places = [f"_o{i}" for i in range(len(order))]
    named = rows.select("*", block.alias("_b"), *[c.alias(k) for c, k in zip(order, places, strict=True)], *[c.alias(f"_v_{k}") for k, c in columns.items()])
    last = lambda k: F.max(F.when(F.col(f"_v_{k}").isNotNull(), F.struct(*places, F.col(f"_v_{k}").alias("v"))))["v"]
    ends = named.groupBy(*keys, "_b").agg(*[last(k).alias(k) for k in columns])
    before = Window.partitionBy(*keys).orderBy(F.col("_b").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    ahead = ends.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_b").alias("_k_b"), *[F.last(k, ignorenulls=True).over(before).alias(f"_a_{k}") for k in columns])
    within = Window.partitionBy(*keys, "_b").orderBy(*[F.col(k).asc_nulls_first() for k in places]).rowsBetween(Window.unboundedPreceding, -1)
    held = named.select("*", *[F.last(f"_v_{k}", ignorenulls=True).over(within).alias(f"_w_{k}") for k in columns])
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in (*keys, )] + [F.col("_b").eqNullSafe(F.col("_k_b"))]
    return held.join(ahead, same).select(*[F.col(c) for c in rows.columns], *[F.coalesce(f"_w_{k}", f"_a_{k}").alias(k) for k in columns])
