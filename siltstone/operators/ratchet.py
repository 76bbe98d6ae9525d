"""Thresholds that only become tighter, kept for each group of a corpus.

A snapshot of metrics is merged with the thresholds that are stored; those that change
are written, one partition of the store for each group, and nothing else is touched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siltstone.sources.tables import dropped, written


def merged(old: DataFrame, new: DataFrame, keys: Sequence[str], rising: Sequence[str]) -> DataFrame:
    """Thresholds (keys, name, value), old and new, as keys, name, old_value, new_value,
    value, change (added, tightened, kept).

    For the names in ``rising`` more is tighter, for the others less. A threshold that is
    in one snapshot only, or null in the other, stays as it is; null keys are keys."""
    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in (*keys, "name")]
    clean = lambda df: df.where(F.col("value").isNotNull() & ~F.isnan("value"))
    both = clean(old).alias("o").join(clean(new).alias("n"), same, "full_outer")
    named = [F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in (*keys, "name")]
    both = both.select(*named, F.col("o.value").alias("old_value"), F.col("n.value").alias("new_value"))
    tight = F.when(F.col("name").isin(*rising), F.greatest("old_value", "new_value")).otherwise(F.least("old_value", "new_value"))
    change = F.when(F.col("old_value").isNull(), "added").when(F.col("value") != F.col("old_value"), "tightened").otherwise("kept")
    return both.withColumn("value", tight).withColumn("change", change)


class Store:
    """A table of thresholds, partitioned by a digest of the first key (which, unlike the
    key itself, tells null, empty and any other text apart)."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], schema: StructType) -> None:
        self.spark, self.path, self.keys = spark, path, list(keys)
        self.schema = schema

    def exists(self) -> bool:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def read(self) -> DataFrame:
        if not self.exists():
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(StructType([*self.schema, *self.spark.createDataFrame([], "part string").schema])).parquet(self.path).drop("part")

    def update(self, snapshot: DataFrame, rising: Sequence[str]) -> DataFrame:
        """Merge a snapshot (keys, name, value) into the store; returns what ``merged``
        says. Partitions without a change are not written; with no change at all,
        nothing is. What is written is read from a table of its own first, so that a
        lost task can be run again."""
        said = written(merged(self.read(), snapshot, self.keys, rising), "ratchet")
        part = F.coalesce(F.md5(F.col(self.keys[0]).cast("string").cast("binary")), F.lit("null"))
        rows = said.withColumn("part", part)
        changed = rows.where("change <> 'kept'").select("part").distinct()
        touched = rows.join(changed, "part", "left_semi").select(*self.keys, "name", "value", "part")
        if not changed.isEmpty():
            touched.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(self.path)
        return said

    def forget(self, *said: DataFrame) -> None:
        dropped(*said)
