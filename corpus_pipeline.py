"""The corpus pipeline: rules, exact and near copies, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a table; each is written and read
again before the next one starts. What a stage returns depends on the documents that it
was given and on a small table of verdicts, which stays in the shared folder (``run``
deletes it); all else that the stage wrote is deleted before it returns. So the tables of
one run never depend on those of another.

All stages: null texts count as empty; null and repeated ids are rows of their own; an
empty table gives an empty result; columns other than those of documents are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import exact_dedup, minhash, mixing, packing, quality
from siltstone.llm.shared import WORD, discard, documents, materialise, written_tables

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Where a row lies: the file (a hash of its path) and the place in it.
PLACE = ["file", "at"]
#: Rows of places, or sources, that are sent to all tasks, at most: some 50 MB. With more,
#: documents are shuffled to them.
SENT = 1 << 20


def placed(docs: DataFrame) -> DataFrame:
    """The documents with the place of each row, and ``key``: an order of rows by id (null
    last), then content, then place, so that only rows that are the same in all columns
    are told apart by where they lie. Places are those of the files that the documents are read from, so
    they are the same however often these are read; a table that isn't read from files
    is written first."""
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        docs = materialise(docs, "pipeline-documents")
    where = docs.select(*COLUMNS, F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    return where.withColumn("key", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64(*COLUMNS).alias("content"), *PLACE))


def sent(table: DataFrame) -> DataFrame:
    """A written table, to be broadcast in a join if it has few rows."""
    return F.broadcast(table) if table.count() <= SENT else table


def one_of_each(docs: DataFrame, judge: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """The documents less the rows that ``judge`` doesn't keep. It sees keys as ids."""
    docs = placed(docs)
    with written_tables() as own:
        verdicts = judge(docs).where("not kept").select("doc_id.file", "doc_id.at")
    gone = materialise(verdicts, f"pipeline-{name}-gone")
    discard(*own)
    return docs.join(sent(gone), PLACE, "left_anti").select(*COLUMNS)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned list reject go: rows are judged as
    they are read."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = quality.apply_rules(quality.statistics(docs, carry=tuple(COLUMNS[1:])), quality.fit(docs, labels, base_too=False))
    return judged.where("kept").select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays: the one with the least id (null
    last), and of rows with that id the first in the order of a hash of their content."""
    return one_of_each(docs, lambda d: exact_dedup.exact_dedup(d, id_col="key"), "exact")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8) stays, chosen as for
    equal texts. Texts without words are no copies."""
    return one_of_each(docs, lambda d: minhash.near_duplicates(d, id_col="key"), "near")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    How often depends on the source and on where the document comes in its order: before
    the last that is taken once, twice, ... So what texts meet is a row of last places for
    each source, and the places of the documents at such a place themselves."""
    docs = placed(docs)
    with written_tables() as own:
        mixed = mixing.fair_mix(docs, carry=tuple(PLACE)).select("source", "u", "epochs", *PLACE)
    taken = materialise(mixed, "pipeline-mix-taken")
    discard(*own)
    most = taken.agg(F.coalesce(F.max("epochs"), F.lit(0))).first()[0]
    lasts = [f"u{e}" for e in range(1, most + 1)]
    ends = taken.groupBy(F.col("source").alias("of")).agg(F.count(F.lit(1)).alias("rows"), *[F.max(F.when(F.col("epochs") >= e, F.col("u"))).alias(k) for e, k in enumerate(lasts, 1)])
    ends = materialise(ends, "pipeline-mix-ends")
    if ends.count() <= SENT:
        ends = F.broadcast(ends)
        same = F.col("source").eqNullSafe(F.col("of"))
        at_end = F.coalesce(sum((F.coalesce(F.col("u") == F.col(k), F.lit(False)).cast("int") for k in lasts), F.lit(0)) > 0, F.lit(False))
        edges = materialise(taken.join(ends, same).where(at_end).select(*PLACE, F.col("epochs").alias("own")), "pipeline-mix-edges")
        words = docs.withColumn("u", mixing.order_key(F.col("doc_id"), F.col("text"))).join(ends, same).join(sent(edges), PLACE, "left")
        before = sum((F.coalesce(F.col("u") < F.col(k), F.lit(False)).cast("int") for k in lasts), F.lit(0))
        times = F.coalesce("own", F.when(F.col("text").rlike(WORD), before).otherwise(0))
        counted = words.withColumn("times", times).where("times > 0")
    else:
        counted = docs.join(taken.where("epochs > 0").select(*PLACE, F.col("epochs").alias("times")), PLACE)
    return counted.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences. Which sequence a piece goes to follows the order in
    which the documents lie in their files; another order can cut them elsewhere."""
    import public_tokenizers

    return packing.pack(docs, tokenizer=public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [("rules", rules), ("exact", exact), ("near", near), ("mix", mix), ("pack", pack)]

#: The learned rules, the search for near copies and the tokeniser are not SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), []
    for name, work in STAGES[:-1]:
        with written_tables() as own:
            out = work(spark, docs, sf_dir)
        docs = materialise(out, f"pipeline-{name}")
        discard(*before, *own, collect=False)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
