"""Exact deduplication by progressive refinement, in DataFrame functions only.

Rows are grouped by length, the survivors by a hash of a prefix, and only rows whose
(length, prefix hash) occurs more than once have their whole text hashed and grouped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.shared import SPACES, materialise

#: Code points in the prefix that the second level hashes.
PREFIX = 128
#: Buckets of the bitmap of surviving keys. 2**22 bits are at most 65,536 words of 64
#: bits: the one thing that is broadcast, about 1 MB whatever the size of the input.
BITMAP_BITS = 22


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Return per input row: doc_id, keep_id, group_size, kept, text_sha256, and the
    columns in ``carry``.

    Texts are equal when they agree after each run of ASCII white space has become one
    space. The row with the smallest id of each group stays.

    * null text counts as empty; all empty texts are one group
    * null ids sort after all others: a group of null ids only has keep_id null, and
      its rows are kept
    * repeated rows (same id and text) are each counted in group_size and share their
      verdict, since nothing tells them apart
    * an empty table gives an empty result; other columns are ignored
    * text_sha256 is null for rows that the earlier levels found to be alone, unless
      digest_all asks for it everywhere
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACES, " ").alias("text"), *carry)
    keys = base.select(
        "doc_id", "text", F.length("text").alias("n"), *carry,
    ).withColumn("prefix", F.xxhash64("n", F.substring("text", 1, PREFIX)))
    # Levels 1 and 2. Partial aggregation leaves one row for each key and task, so a
    # group with a third of all rows costs no more than any other.
    by_prefix = keys.groupBy("n", "prefix").agg(F.count(F.lit(1)).alias("rows"))
    lengths = by_prefix.groupBy("n").agg(F.sum("rows").alias("same_length")).where("same_length > 1").select("n")
    survivors = by_prefix.join(lengths, "n", "left_semi").where("rows > 1").select("prefix")
    mask = (1 << BITMAP_BITS) - 1
    bucket = F.col("prefix").bitwiseAND(mask)
    bitmap = survivors.select(bucket.alias("b")).groupBy(F.shiftright("b", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("bits"))
    # Level 3: whole texts are hashed where the bit of their key is set.
    marked = keys.join(F.broadcast(bitmap), F.shiftright(bucket, 6) == F.col("word"), "left").withColumn("survives", F.coalesce(F.expr(f"getbit(bits, cast(prefix & {mask} & 63 as int)) = 1"), F.lit(False)))
    full = F.sha2(F.col("text"), 256)
    hashed = materialise(marked.select("doc_id", "survives", full.alias("sha") if digest_all else F.when(F.col("survives"), full).alias("sha"), *carry), "exact-dedup")
    groups = hashed.where("survives").groupBy("sha").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select(F.col("sha").alias("key"), "least", "rows")
    # Rows that are alone meet no group; a key of their own spreads them over the tasks.
    # A key with a large share of the rows is split by adaptive skew handling: one side
    # has one row for each key.
    rows = hashed.withColumn("key", F.when(F.col("survives"), F.col("sha")).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    keep = F.when(F.col("rows").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return rows.join(groups, "key", "left").select(
        "doc_id", keep.alias("keep_id"), F.coalesce("rows", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.col("sha").alias("text_sha256"), *carry,
    )
