"""Near-duplicate documents by MinHash with tensored banding.

Two collections of small hash collisions, each ``width`` minhashes long, are computed
for a document; every pair of one from each collection is the key of a table. So
``fan`` * ``fan`` tables cost 2 * ``fan`` * ``width`` minhashes. What meets in a table
is checked on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.graph import components
from siltstone.llm.shared import carried, discard, map_arrow, materialise
from siltstone.llm.textscan import Chunk, chunks, mix

#: Hash collisions in each of the two collections, and minhashes in each of them. Two
#: sets at similarity 0.8 miss all tables with a chance of 0.0015, at 0.9 of 0.000004.
FAN, WIDTH = 10, 3


def shingle_sets(c: Chunk, shingle: int) -> list[np.ndarray]:
    """Each text's distinct shingles, as sorted 64-bit hashes."""
    h, sets = c.hashes(), []
    for a, b in zip(c.first[:-1], c.first[1:], strict=True):
        k = min(shingle, b - a)
        rolled = np.zeros(b - a - k + 1 if k else 0, np.uint64)
        for j in range(k):
            rolled = rolled * np.uint64(0xC6BC279692B5C323) + h[a + j : a + j + len(rolled)]
        sets.append(np.unique(mix(rolled)))
    return sets


def _signatures(shingle: int, fan: int, width: int):
    seeds = np.random.default_rng(90210).integers(1, 1 << 63, 2 * fan * width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, c in chunks(batch.column(1)):
                sets = shingle_sets(c, shingle)
                sizes = np.array([len(s) for s in sets])
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                held = np.flatnonzero(sizes)
                starts = (np.cumsum(sizes) - sizes)[held]
                keys = np.zeros((len(sets), 2 * fan), np.int64)
                if len(held):
                    halves = np.zeros((2 * fan, len(held)), np.uint64)
                    for i, s in enumerate(seeds):
                        least = np.minimum.reduceat(mix(flat ^ s), starts)
                        halves[i // width] = mix(halves[i // width] * np.uint64(31) + least)
                    keys[held] = halves.T.view(np.int64)
                    sums, more = np.add.reduceat(flat, starts), np.bitwise_xor.reduceat(mix(flat * seeds[0]), starts)
                    digest = np.zeros((len(sets), 2), np.uint64)
                    digest[held, 0], digest[held, 1] = sums, more
                else:
                    digest = np.zeros((len(sets), 2), np.uint64)
                at = np.arange(0, (len(sets) + 1) * 2 * fan, 2 * fan, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(sizes, pa.int64()), pa.array(digest[:, 0].view(np.int64)), pa.array(digest[:, 1].view(np.int64)), pa.ListArray.from_arrays(at, pa.array(keys.ravel())), *[x.slice(lo, hi - lo) for x in batch.columns[1:]]],
                    ["doc_id", "n_shingles", "d1", "d2", "halves", *batch.schema.names[1:]],
                )

    return run


def _similar(shingle: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            both = [[x for _, _, c in chunks(batch.column(k)) for x in shingle_sets(c, shingle)] for k in (2, 3)]
            same = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*both, strict=True)]
            held = pa.array([100 * n >= percent * (len(x) + len(y) - n) for n, x, y in zip(same, *both, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(held)

    return run


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets, made again from the whole texts, are similar enough."""
    one = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    return map_arrow(pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb"), _similar(shingle, percent), "a long, b long")


def _fits(percent: int) -> Column:
    """Whether sizes n and n2 allow the similarity."""
    return 100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")


def _to_pivots(tables: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of each table's pivot, the member with the most company, and others."""
    top = F.max(F.struct("weight", "node", "n")).alias("p")
    pivots = tables.groupBy("key").agg(top).select("key", F.col("p.node").alias("pivot"), F.col("p.n").alias("n2"))
    met = tables.join(pivots, "key").where((F.col("node") != F.col("pivot")) & _fits(percent))
    return met.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()


def _listed(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, c in chunks(batch.column(2)):
                sets = shingle_sets(c, shingle)
                at = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.ListArray.from_arrays(at, pa.array(np.concatenate(sets).view(np.int64)))], ["node", "root", "s"])

    return run


def _by_rare_shingles(open_: DataFrame, texts: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of nodes in different components that may be similar enough: all
    such pairs, by prefixes of the sets in the order of rarity. And the table of shingles
    that they are read from.

    Sets at the similarity share a shingle in the rarest fifth or so of the larger and
    the rarest tenth of the smaller, and what follows it must suffice for the overlap.
    So texts that share a common passage only, however many they are, don't meet.
    """
    sets = map_arrow(open_.join(texts, "node").select("node", "root", "text"), _listed(shingle), "node long, root long, s array<long>")
    each = materialise(sets.select("node", "root", F.size("s").cast("long").alias("n"), F.explode("s").alias("s")), "minhash-shingles")
    often = each.groupBy("s").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    # Shingles of one set only are its rarest: they count in the places of the others.
    ordered = each.join(often, "s").groupBy("node", "root", "n").agg(F.sort_array(F.collect_list(F.struct("times", "s"))).alias("f"))
    placed = ordered.select("node", "root", "n", (F.col("n") - F.size("f")).alias("alone"), F.posexplode("f").alias("i", "f")).select("node", "root", "n", F.col("f.s").alias("s"), (F.col("alone") + F.col("i")).alias("i"))
    larger = placed.where(f"100 * (n - i) >= {percent} * n").select("s", F.col("node").alias("a"), F.col("root").alias("ra"), "n", "i")
    smaller = placed.where(f"{100 + percent} * (n - i) >= {2 * percent} * n").select("s", F.col("node").alias("b"), F.col("root").alias("rb"), F.col("n").alias("n2"), F.col("i").alias("j"))
    enough = f"ra <> rb and (n2 < n or n2 = n and b < a) and {100 + percent} * least(n - i, n2 - j) >= {percent} * (n + n2)"
    return larger.join(smaller, "s").where(enough).select("a", "b").distinct(), each


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, fan: int = FAN, width: int = WIDTH, carry: tuple[str, ...] = ()) -> DataFrame:
    """Return per input row: doc_id, n_shingles, component_id, kept, and the columns in
    ``carry``.

    Documents are linked when 100 * intersection >= percent * union of their sets of
    distinct ``shingle``-word shingles; component_id is the least id that links reach.

    * null and empty texts have no shingles and are linked with nothing
    * a text of fewer words than ``shingle`` is one shingle
    * rows with equal sets are one document for the search, however many they are;
      a repeated id is one node for each of its sets; null ids get component_id null and
      are kept, and link nothing that has an id by themselves
    * ids are of any type that has an order; carried columns may have any names
    * an empty table gives an empty result; other columns are ignored

    Each table's members are checked against one of them, and components are formed, so
    a large group of copies costs a check or two for each of its members. The members of
    tables that still hold several components are searched by their rarest shingles.
    """
    given, carry = carry, tuple(f"carried_{i}" for i in range(len(carry)))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(k) for c, k in zip(given, carry, strict=True)])
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_shingles long, d1 long, d2 long, halves array<long>, text string" + carried(rows, carry)
    signed = materialise(map_arrow(rows, _signatures(shingle, fan, width), schema), "minhash-sets")
    # A node is a distinct set (by its size and a digest of 128 bits), numbered when it is
    # written; not an id, so that repeated ids with different texts stay apart. Sets are
    # not stored: texts take less.
    named = ["d1", "d2", "n_shingles"]
    distinct = signed.where("n_shingles > 0").groupBy(*named).agg(F.min("doc_id").alias("rep"), F.first("halves").alias("halves"))
    classes = materialise(distinct.withColumn("node", F.monotonically_increasing_id()).withColumn("n", F.col("n_shingles")), "minhash-nodes")
    # Tables whose key occurs once are dropped before nodes meet.
    left, right = F.slice("halves", 1, fan), F.slice("halves", fan + 1, fan)
    pairs = F.flatten(F.transform(left, lambda x, i: F.transform(right, lambda y, j: F.xxhash64(x, y, i, j))))
    tabled = classes.select(F.col("node").alias("doc_id"), "n", F.explode(pairs).alias("key"))
    shared = tabled.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    meets = materialise(tabled.join(shared, "key").select("key", F.col("doc_id").alias("node"), "n", "members"), "minhash-tables")
    wanted = classes.select(*named, "node").join(meets.select("node").distinct(), "node", "left_semi")
    texts = materialise(signed.select(*named, "text").join(wanted, named).groupBy("node").agg(F.first("text").alias("text")), "minhash-texts")
    # The pivots are the nodes that meet the most others: a text that a group of near
    # copies was made from is nearer to each of them than they are to each other.
    weights = meets.groupBy("node").agg(F.sum("members").alias("weight"))
    stars = _to_pivots(meets.select("key", "node", "n").join(weights, "node"), percent)
    links = materialise(_verified(stars, texts, shingle, percent), "minhash-links")
    groups = components(links)
    discard(links)
    # Tables that still hold several components: pairs across these.
    held = meets.select("key", "node").join(groups.withColumnRenamed("id", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = held.groupBy("key").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 <> r2").select("key")
    open_ = materialise(held.join(mixed, "key", "left_semi").select("node", "root").distinct(), "minhash-open")
    pairs, each = _by_rare_shingles(open_, texts, shingle, percent)
    pairs = materialise(pairs, "minhash-pairs")
    discard(each)
    more = materialise(_verified(pairs, texts, shingle, percent), "minhash-links")
    discard(pairs, texts, meets)
    if not more.isEmpty():
        ra, rb = open_.select(F.col("node").alias("a"), F.col("root").alias("ra")), open_.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        joined = components(more.join(ra, "a").join(rb, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")))
        moved = groups.join(joined.select(F.col("id").alias("root"), F.col("root").alias("next")), "root", "left").select("id", F.coalesce("next", "root").alias("root"))
        before, groups = groups, materialise(moved.unionByName(joined.join(groups.select("id"), "id", "left_anti")), "minhash-groups")
        discard(before, joined, collect=False)
    # Node -> least id of its component, for each distinct set; then every row.
    known = classes.where("rep is not null").select(*named, "rep", F.col("node").alias("id")).join(groups, "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = known.groupBy("root").agg(F.min("rep").alias("component"))
    placed = materialise(known.join(least, "root").select(*named, "component"), "minhash-placed")
    discard(classes, open_, more, groups)
    out = signed.select("doc_id", *named, *carry).join(placed, named, "left")
    comp = F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), comp.eqNullSafe(F.col("doc_id")).alias("kept"), *[F.col(k).alias(c) for c, k in zip(given, carry, strict=True)])
