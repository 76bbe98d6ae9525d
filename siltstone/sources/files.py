"""Sources: trees of files, documents in JSON, NDJSON and TOML, and keys of manifests."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siltstone.functions import scalars as S
from siltstone.operators.lines import lines_of, split_lines, trim

#: Folders that are not scanned (fixed values).
NOT_SCANNED = ("target", ".git", "quality")


def scannable(path: Column, *, extension: str = "rs") -> Column:
    """Whether a path has the extension and no part of it is a folder left out."""
    return has_extension(path, extension) & ~path.rlike(r"(^|/)(" + "|".join(x.replace(".", r"\.") for x in NOT_SCANNED) + r")(/|$)")


def has_extension(path: Column, extension: str = "rs") -> Column:
    """A file named just ``.rs`` has no extension."""
    return path.rlike(rf"[^/]\.{extension}$")


def relative(path: Column, root: str) -> Column:
    root = root.rstrip("/") + "/"
    return F.when(path.startswith(root), F.substring(path, len(root) + 1, 1 << 30)).otherwise(path)


def base_name(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(name == "", "unknown").otherwise(F.coalesce(name, F.lit("unknown")))


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, at in enumerate(batch.column(0).to_pylist()):
            with open(at, "rb") as f:
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([f.read()], pa.binary())], ["path", "content"])


def _passed_over(root: str, extension: str) -> list[tuple[str]]:
    """Files of a local root that Spark's reader passes over: empty ones, and those with a
    part of their path that starts with ``_`` or ``.``."""
    found = []
    for folder, _, names in os.walk(root):
        for name in names:
            at = os.path.join(folder, name)
            inside = os.path.relpath(at, root).split(os.sep)
            if name.endswith(f".{extension}") and os.path.isfile(at) and (not os.path.getsize(at) or any(p[0] in "_." for p in inside)):
                found.append((at,))
    return found


def scan_all(spark: SparkSession, root: str, *, extension: str = "rs", all_folders: bool = False) -> DataFrame:
    """path (relative), content, readable (whether it is UTF-8) of the files under a root.
    Tasks read the files; of a local root the driver lists the names, so that files that
    Spark's reader passes over are read too."""
    root = root.rstrip("/")
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{extension}").load(root)
    found = read.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content")
    more = _passed_over(root, extension) if os.path.isdir(root) else []
    if more:
        found = found.unionByName(spark.createDataFrame(more, "path string").mapInArrow(_contents, "path string, content binary")).dropDuplicates(["path"])
    kept = has_extension(F.col("path"), extension) if all_folders else scannable(F.col("path"), extension=extension)
    text = F.col("content").cast("string")
    return found.where(kept).select(relative(F.col("path"), root).alias("path"), text.alias("content"), F.is_valid_utf8(text).alias("readable"))


def scan(spark: SparkSession, root: str, **options) -> DataFrame:
    """path, content of the files under a root that are UTF-8."""
    return scan_all(spark, root, **options).where("readable").drop("readable")


def files_skipped(spark: SparkSession, root: str, **options) -> int:
    """How many files ``scan`` leaves out because they are not UTF-8."""
    return scan_all(spark, root, **options).where("not readable").count()


def json_document(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One JSON document a file, in a schema; a document that does not fit is an error."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def ndjson(texts: DataFrame, column: str = "text") -> DataFrame:
    """at, json (variant) of each line that is JSON; blank and other lines are skipped."""
    each = texts.select(F.posexplode(split_lines(F.col(column))).alias("at", "line")).where(trim(F.col("line")) != "")
    return each.select("at", S.parsed(F.col("line")).alias("json")).where("json is not null")


def toml(path: str) -> dict:
    """A configuration: small, and needed before anything runs, so read on the driver."""
    with open(path, "rb") as f:
        return tomllib.load(f)


def edition(manifests: DataFrame, *, default: str = "2021") -> DataFrame:
    """From (depth, path, content) of manifests: the first edition in [package] or
    [workspace.package], of the root (depth 0) first, then of its folders by path."""
    lines = lines_of(manifests.select("depth", "path", "content")).withColumn("x", trim(F.col("line")))
    x = F.col("x")
    here = Window.partitionBy("depth", "path").orderBy("line_no")
    section = F.when(x.startswith("[") & x.endswith("]"), F.expr("substring(x, 2, length(x) - 2)"))
    inside = lines.withColumn("section", F.last(section, ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, 0)))
    value = F.regexp_replace(trim(F.regexp_extract("x", r"^edition[^=]*=([\s\S]*)$", 1)), "^[,\" \n\r]+|[,\" \n\r]+$", "")
    found = inside.where(F.col("section").isin("package", "workspace.package") & x.startswith("edition") & x.contains("=")).withColumn("value", value).where("value <> ''")
    return found.agg(F.coalesce(F.min_by("value", F.struct("depth", "path", "line_no")), F.lit(default)).alias("edition"))
