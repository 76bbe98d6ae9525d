from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F

from siltstone.sources import metric_documents as docs

ROWS = [("a", "loc", "lines", 3.0, None), ("a", "loc", "share", 0.1, "x"), ("b", "fmt", "status", None, "pass"), (None, "loc", "lines", 5.0, None), ("é/\"", "size", "max", math.inf, "y\n")]


def key(r):
    return tuple((x is None, str(x)) for x in r)


def rows(df):
    return said(map(tuple, df.collect()))


def said(rows):
    """Rows as they are spelt, in order: NaN isn't equal to itself."""
    return sorted(map(key, rows))


def test_round_trip(spark, tmp_path):
    path = str(tmp_path / "m")
    table = lambda x: spark.createDataFrame(x, docs.SCHEMA)
    assert rows(docs.read(spark, path)) == []
    docs.write(table(ROWS), path)
    assert rows(docs.read(spark, path)) == said(ROWS)
    more = [("a", "loc", "lines", math.nan, "")]
    docs.write(table(more), "file://" + path)
    assert rows(docs.read(spark, path)) == said(ROWS + more)
    docs.write(table(ROWS[:2]), path, mode="overwrite")
    assert rows(docs.read(spark, path)) == said(ROWS[:2])
    kept = sorted(p.name for p in tmp_path.rglob("*") if p.is_file() and not p.name.startswith("."))
    assert len(kept) == 2 and "_files.json" in kept and not list((tmp_path / "m" / "_staged").glob("*"))
    (document,) = json.loads(next(p for p in (tmp_path / "m").glob("*-*.json")).read_text())
    assert document["subject"] == "a" and len(document["metrics"]) == 2
    docs.write(table([]), path)
    assert rows(docs.read(spark, path)) == said(ROWS[:2])


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "m")
    docs.write(spark.createDataFrame(ROWS, docs.SCHEMA), path)
    before = {p: p.read_bytes() for p in tmp_path.rglob("*") if p.is_file()}
    bad = spark.range(40).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("subject"), F.lit("loc").alias("collector"), F.lit("n").alias("metric"), F.when(F.col("id") == 33, F.raise_error(F.lit("lost"))).otherwise(F.lit(1.0)).cast("double").alias("value"), F.lit("").alias("text"))
    spark.dataSource.register(docs.MetricDocuments)
    with pytest.raises(Exception, match="lost"):
        bad.repartition(4, "subject").write.format("metric_documents").mode("append").save(path)
    assert {p: p.read_bytes() for p in tmp_path.rglob("*") if p.is_file()} == before and not list((tmp_path / "m" / "_staged").glob("*"))
    assert rows(docs.read(spark, path)) == said(ROWS)


def test_files_of_a_write_that_was_cut_off_are_not_read(spark, tmp_path):
    path = str(tmp_path / "m")
    docs.write(spark.createDataFrame(ROWS, docs.SCHEMA), path)
    (tmp_path / "m" / "other.json").write_text("[]")
    (tmp_path / "m" / "_staged" / "z").mkdir(parents=True)
    (tmp_path / "m" / "_staged" / "z" / "z.json").write_text("broken")
    assert rows(docs.read(spark, path)) == said(ROWS)
