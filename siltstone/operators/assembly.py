"""Assembly of collector results, and which collectors run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import scalars as S
from siltstone.functions.scalars import COLLECTORS

#: Metrics of each collector, as they are named in its JSON (fixed values).
METRICS = {
    "clippy": ("warningCount",), "tests": ("passed", "failed", "ignored"), "coverage": ("linePercent",), "deny": ("bannedCount", "licenseViolations"), "audit": ("vulnerabilityCount", "criticalCount"),
    "hack": ("featureCombinationsTested",), "mutants": ("mutationScore", "caught", "missed"), "duplicates": ("totalLines", "duplicateLines", "filesWithDuplicates", "duplicateBlocksOmitted"),
    "loc": ("totalLines", "codeLines", "commentLines", "blankLines", "longLines", "maxLineLengthFound", "maxLineLengthAllowed", "files", "filesWithLongLines", "longLineDetailsOmitted"),
    "size": ("files", "maxLinesPerFile", "maxCodeLinesPerFile", "maxLinesPerFunction", "maxParametersPerFunction"), "complexity": ("functions", "maxCyclomaticComplexity", "maxNestingDepth", "complexFunctions"),
}
FRACTIONS = ("linePercent", "mutationScore")
#: What each profile leaves out or is limited to (fixed values).
FAST, NOT_FULL = ("fmt", "clippy"), ("mutants",)


def collectors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(COLLECTORS, 1)), "ordinal long, collector string")


def enabled(asked: DataFrame) -> DataFrame:
    """From asked (profile, disabled array, available array, of one run or more): profile,
    ordinal, collector, runs, reason. Names that are not collectors are ignored; case
    does not count. An unknown profile is ``full``."""
    each = asked.select(F.coalesce(S.parse_name(F.col("profile"), S.PROFILES), F.lit("full")).alias("profile"), F.transform("disabled", F.lower).alias("off"), "available", F.posexplode(F.array(*map(F.lit, COLLECTORS))).alias("at", "collector"))
    each = each.withColumn("ordinal", (F.col("at") + 1).cast("long"))
    c = F.col("collector")
    left_out = ((F.col("profile") == "fast") & ~c.isin(*FAST)) | ((F.col("profile") == "full") & c.isin(*NOT_FULL))
    has = lambda a: F.coalesce(F.array_contains(a, c), F.lit(False))
    reason = F.when(has("off"), "disabled").when(left_out, "profile").when(~has("available"), "unavailable").otherwise("enabled")
    return each.select("profile", "ordinal", "collector", (reason == "enabled").alias("runs"), reason.alias("reason"))


def assemble(spark: SparkSession, results: DataFrame) -> DataFrame:
    """From results (seq, collector, status, stdout): ordinal, collector, status and its
    metrics as (metric, value), one row each, and one with a null metric for collectors
    that have none.

    Collectors without a result are skipped, with zeros. The last result of a name wins;
    unknown names are dropped. A status that is null or unknown is ``error``.
    """
    last = Window.partitionBy("collector").orderBy(F.col("seq").desc_nulls_last())
    known = results.withColumn("turn", F.row_number().over(last)).where("turn = 1").select("collector", F.coalesce(S.parse_name(F.col("status"), S.STATUSES), F.lit("error")).alias("said"), S.parsed(F.col("stdout")).alias("j"))
    found = collectors(spark).join(known, "collector", "left")
    j, none = F.col("j"), F.lit(None).cast("string")
    listed = F.when(F.lit(False), F.array(F.struct(none.alias("metric"), F.lit(0.0).alias("value"))))
    for name, metrics in METRICS.items():
        value = lambda m: F.coalesce(S.json_f64(j, f"$.{m}") if m in FRACTIONS else S.u32(S.json_u64(j, f"$.{m}")).cast("double"), F.lit(0.0))
        listed = listed.when(F.col("collector") == name, F.array(*[F.struct(F.lit(m).alias("metric"), value(m).alias("value")) for m in metrics]))
    each = found.select("ordinal", "collector", F.coalesce("said", F.lit("skipped")).alias("status"), F.explode_outer(listed).alias("x"))
    return each.select("ordinal", "collector", "status", "x.metric", "x.value")


def doctor(spark: SparkSession, available: DataFrame) -> DataFrame:
    """From available (tool): every collector in order, whether it can run, and the line
    that a report shows. The last four need no tool."""
    names = available.select(F.lower("tool").alias("collector")).distinct().withColumn("found", F.lit(True))
    ok = F.coalesce("found", F.lit(False)) | F.col("collector").isin(*COLLECTORS[8:])
    each = collectors(spark).join(names, "collector", "left").select("ordinal", "collector", ok.alias("available"))
    mark = F.when(F.col("available"), "✓").otherwise("✗")
    return each.withColumn("line", F.concat(F.lit("  "), mark, F.lit(" "), F.rpad("collector", 12, " "), F.lit(" "), F.when(F.col("available"), "available").otherwise("not found")))
