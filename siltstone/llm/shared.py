"""Helpers that the corpus operators share: the shared folder, lineage cuts, words."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources.tables import dropped, written

#: A word is a run of anything but ASCII white space.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


#: Lists of the tables written within ``written_tables``, innermost last.
_SCOPES: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("scopes", default=())


@contextmanager
def written_tables() -> Iterator[list[DataFrame]]:
    """A list of all tables that ``materialise`` writes within the block, so that they can
    be deleted when what is made from them has been written."""
    own: list[DataFrame] = []
    before = _SCOPES.set((*_SCOPES.get(), own))
    try:
        yield own
    finally:
        _SCOPES.reset(before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table in the shared folder and read it back. What follows then depends
    on files that outlive any executor, not on shuffle files or cached blocks."""
    found = written(df, name)
    if _SCOPES.get():
        _SCOPES.get()[-1].append(found)
    return found


def discard(*tables: DataFrame, collect: bool = True) -> None:
    """Delete tables that ``materialise`` wrote and nothing reads any more, and let Spark
    clear the shuffle files of finished jobs (it does so when the driver collects)."""
    dropped(*tables)
    if tables and collect:
        tables[0].sparkSession.sparkContext._jvm.System.gc()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def n_words(text: Column) -> Column:
    """Number of words, without building them: runs of word characters are starts
    counted by their lengths after every word has shrunk to one character."""
    return F.length(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x"), SPACES, "")).cast("long")


def carried(docs: DataFrame, carry: tuple[str, ...]) -> str:
    """The end of a schema with the columns that an operator carries through."""
    return "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in carry)


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """mapInArrow. Texts are long, and a worker holds a batch: Spark ends batches at
    ``spark.sql.execution.arrow.maxBytesPerBatch`` (64 MB unless it is set otherwise)."""
    return df.mapInArrow(run, schema)
