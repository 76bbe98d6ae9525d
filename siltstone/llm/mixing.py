"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled (by a hash of their id) and get a virtual finish
time: the source's words up to and with the document, divided by the source's target.
All documents are then put in ranges of virtual time, and the order is cut off where
the words taken reach the total budget. Sources that must repeat queue up to
``max_epochs`` times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.shared import materialise, n_words

#: Documents in a block of a source, and in a range of virtual time, on average.
BLOCK = 4096
#: Blocks, or ranges, whose sums are added up together.
SPAN = 1024


def source_targets(sizes: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """From (source, source_size), one row each, make (source, source_size, weight,
    target). Targets share the sum of all sizes by weight; a target stops at
    max_epochs times its source's size, and the excess is shared again.

    That is a water level: with sources in the order of cap / weight, the level is the
    first at which what is left, shared by the weights not yet capped, goes over no
    cap. It takes prefix sums over the sources, which are few beside the documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    w = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(x).cast("long") for x in weights]), (turn + 1).cast("int"))).withColumn("cap", F.col("source_size") * max_epochs)
    ratio = F.col("cap").cast("double") / F.col("weight")
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    w = w.withColumn("ratio", ratio).withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("open", F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    w = w.withColumn("level", F.col("left").cast("double") / F.col("open"))
    w = w.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct(F.col("ratio"), F.col("level")))).over(Window.partitionBy())["level"])
    return w.select("source", "source_size", "weight", F.when(F.col("ratio") <= F.col("level"), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def _running(sums: DataFrame, key: str) -> DataFrame:
    """Add ahead to (source, key, s): the sum of s over all smaller keys of the source. In
    two steps, groups of SPAN keys and keys within a group, so that no task has more than
    a few thousand rows, or one row for SPAN keys."""
    sums = sums.withColumn("group", F.floor(F.col(key) / SPAN))
    before = Window.partitionBy("source").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = sums.groupBy("source", "group").agg(F.sum("s").alias("t")).withColumn("more", F.coalesce(F.sum("t").over(before), F.lit(0)))
    groups = groups.select(F.col("source").alias("source_"), F.col("group").alias("group_"), "more")
    within = Window.partitionBy("source", "group").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    own = sums.withColumn("own", F.coalesce(F.sum("s").over(within), F.lit(0)))
    found = own.join(groups, F.col("source").eqNullSafe(F.col("source_")) & (F.col("group") == F.col("group_")))
    return found.withColumn("ahead", F.col("own") + F.col("more")).drop("source_", "group_", "group", "own", "more")


def order_key(id_: Column, text: Column, seed: str = "mix") -> Column:
    """Where a document comes in the order of its source."""
    return F.md5(F.concat(F.lit(seed), F.coalesce(id_.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))


def fair_mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, seed: str = "mix", carry: tuple[str, ...] = ()) -> DataFrame:
    """Return per input row: doc_id, source, size, source_size, target, taken, epochs, u
    (``order_key``), and the columns in ``carry``. Of a source's rows with words, those
    that are taken at least any number of times come first in the order of u.

    * size is the number of words, 0 for null text; such rows take nothing
    * sources are in the order of their code points, null last, as a source of its own
    * the order within a source is that of md5(seed, doc_id, md5(text)); ties are rows
      with the same id and text, which get the same set of results in any run
    * ids may be of any type that has an order
    * the item at which the words taken would go over the budget and all after it are
      left out
    * an empty table gives an empty result; other columns are ignored
    """
    rows = materialise(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), order_key(F.col(id_col), F.col(text_col), seed).alias("u"), *carry),
        "mix-rows",
    )
    none = F.lit("" if docs.schema[id_col].dataType.typeName() == "string" else 0).cast(docs.schema[id_col].dataType)
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    bits = min(40, max(0, (n // BLOCK).bit_length()))
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights=weights, max_epochs=max_epochs)
    # A source's running sum in two steps, so that no task holds a whole source: sums of
    # blocks (ranges of the hash), then running sums within each block.
    block = F.shiftright(F.conv(F.substring("u", 1, 10), 16, 10).cast("long"), 40 - bits)
    rows = rows.withColumn("block", block)
    blocks = _running(rows.groupBy("source", "block").agg(F.sum("size").alias("s")), "block")
    blocks = blocks.join(targets.withColumnRenamed("source", "source_"), F.col("source").eqNullSafe(F.col("source_"))).drop("source_", "s").withColumnRenamed("source", "source_").withColumnRenamed("block", "block_")
    within = Window.partitionBy("source", "block").orderBy("u", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, 0)
    queued = rows.join(blocks, F.col("source").eqNullSafe(F.col("source_")) & (F.col("block") == F.col("block_"))).withColumn("cum", F.col("ahead") + F.sum("size").over(within))
    queued = materialise(queued.select("doc_id", "source", "size", "u", "source_size", "target", "cum", *carry), "mix-queued")

    def finish(epoch: Column) -> Column:
        return (F.col("cum") + epoch * F.col("source_size")).cast("double") / F.col("target")

    # Ranges of virtual time. Only the one in which the budget runs out is sorted.
    ranges = 1 << bits
    items = queued.where("size > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))).alias("epoch")).withColumn("finish", finish(F.col("epoch"))).withColumn("range", F.floor(F.col("finish") * ranges))

    def over(some: DataFrame):
        """The first range that goes over the budget, and the words before it."""
        sums = some.groupBy("range").agg(F.sum("size").alias("s"))
        upto = _running(sums.withColumn("source", F.lit(None).cast("string")), "range").withColumn("upto", F.col("ahead") + F.col("s"))
        return upto.where(F.col("upto") > total).orderBy("range").select("range", "ahead").first()

    # It is among the first, unless documents are long beside their source's target.
    cut = over(items.where("finish <= 2")) or over(items)
    if cut is None:  # the budget covers every item
        taken_epochs = F.lit(max_epochs)
    else:
        order = ["finish", F.col("source").asc_nulls_last(), "u", F.col("doc_id").asc_nulls_last(), "size", "epoch"]
        last = items.where(F.col("range") == cut[0]).withColumn("run", cut[1] + F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
        stop = last.where(F.col("run") > total).orderBy("run").select("finish", F.col("source").isNull().alias("z"), "source", "u", F.col("doc_id").isNull().alias("y"), "doc_id", "cum", "epoch").first()
        # An item is taken if it comes before the first that doesn't fit.
        def at(epoch: int) -> Column:
            here = F.struct(finish(F.lit(epoch)), F.col("source").isNull(), F.coalesce("source", F.lit("")), F.col("u"), F.col("doc_id").isNull(), F.coalesce("doc_id", none), F.col("cum"), F.lit(epoch))
            there = F.struct(F.lit(stop[0]).cast("double"), F.lit(stop[1]), F.lit(stop[2] or ""), F.lit(stop[3]), F.lit(stop[4]), F.coalesce(F.lit(stop[5]).cast(docs.schema[id_col].dataType), none), F.lit(stop[6]).cast("long"), F.lit(stop[7]))
            return F.when(here < there, 1).otherwise(0)

        taken_epochs = sum((at(e) for e in range(1, max_epochs)), at(0))
    epochs = F.when(F.col("size") > 0, taken_epochs).otherwise(0).cast("long")
    return queued.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * epochs).alias("taken"), epochs.alias("epochs"), "u", *carry)
