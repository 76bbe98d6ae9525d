"""Connected components of a table of links, by contraction in random order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.shared import discard, materialise


def components(links: DataFrame) -> DataFrame:
    """From links (a, b) return (id, root) for every id in a link: equal roots, same
    component. Roots are arbitrary members.

    Each round every node joins the neighbour that is least in an order drawn for the
    round, and the links are rewritten to the joined nodes. A star is gone after one
    round, a path shrinks by a constant share, so rounds grow with the logarithm of the
    largest diameter. Each round is a written table; the driver sees one flag a round.
    """
    left, written = links.select("a", "b").where("a <> b").distinct(), []
    found, turn = None, 0
    while True:
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = F.xxhash64("x", F.lit(turn))
        near = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", F.lit(turn)).alias("r"), F.col("b").alias("id"))).alias("m"))
        own = near.withColumn("x", F.col("a")).withColumn("own", F.struct(rank.alias("r"), F.col("a").alias("id")))
        step = materialise(own.select(F.col("a").alias("id"), F.least("own", "m")["id"].alias("root")), "components")
        pa, pb = step.select(F.col("id").alias("a"), F.col("root").alias("ra")), step.select(F.col("id").alias("b"), F.col("root").alias("rb"))
        moved = left.join(pa, "a").join(pb, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        left = materialise(moved, "components-links")
        if found is None:
            found, done = step, written
        else:
            onward = step.select(F.col("id").alias("root"), F.col("root").alias("next"))
            before, found = found, materialise(found.join(onward, "root", "left").select("id", F.coalesce("next", "root").alias("root")), "components")
            done = [*written, step, before]
        discard(*done, collect=False)
        written = [left]
        turn += 1
        if left.isEmpty():
            discard(left)
            return found
