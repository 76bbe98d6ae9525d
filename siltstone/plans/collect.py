"""All metrics of a tree of sources and of captured tool outputs, from one scan."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.config import Context
from siltstone.functions import scalars as S
from siltstone.functions.scalars import COLLECTORS
from siltstone.operators import assembly, duplicates, lines, rust_syntax, tool_outputs
from siltstone.sources.tables import written

SCHEMA = "collector string, metric string, value double, text string"
#: JSON names of metrics -> names in the gate's rules, where they are not the same words.
RENAMED = {"maxLineLengthAllowed": "max_line_length_allowed"}


def snake(name: str) -> str:
    return RENAMED.get(name, "".join("_" + c.lower() if c.isupper() else c for c in name))


@dataclass
class Found:
    """What the collectors on sources share: files, what was parsed, limits."""

    files: DataFrame
    parsed: DataFrame
    ctx: Context

    @property
    def violations(self) -> DataFrame:
        """Violations of limits on files and functions, of all six kinds."""
        own = lines.size_violations(lines.classified(self.files), max_lines=self.ctx.limits.get("size:max-lines-per-file", 1 << 40), max_code=self.ctx.limits.get("size:max-code-lines-per-file", 1 << 40))
        of_files = own.select("rule_id", "path", "line", F.lit(None).cast("string").alias("function"), "message", "actual", "threshold", "severity")
        return of_files.unionByName(rust_syntax.violations(rust_syntax.functions(self.parsed), self.ctx.limits))


def _long(df: DataFrame, collector: str, status: str) -> DataFrame:
    """One row of metrics -> rows (collector, metric, value, text), with the status."""
    each = [F.struct(F.lit(k).alias("metric"), F.col(k).cast("double").alias("value"), F.lit(None).cast("string").alias("text")) for k in df.columns]
    said = F.struct(F.lit("status").alias("metric"), F.lit(None).cast("double").alias("value"), F.when(F.expr(status), "fail").otherwise("pass").alias("text"))
    return df.select(F.lit(collector).alias("collector"), F.explode(F.array(*each, said)).alias("m")).select("collector", "m.*")


def _loc(x: Found) -> DataFrame:
    got = lines.line_summary(lines.classified(x.files, max_line=x.ctx.max_line)).withColumn("max_line_length_allowed", F.lit(x.ctx.max_line).cast("long"))
    return _long(got, "loc", "long_lines > 0")


def _size(x: Found) -> DataFrame:
    files = lines.size_maxima(lines.classified(x.files))
    calls = rust_syntax.summary(rust_syntax.functions(x.parsed)).select("max_lines_per_function", "max_parameters_per_function")
    bad = x.violations.where("rule_id like 'size:%'").agg(F.count(F.lit(1)).alias("violations"))
    return _long(files.join(calls, F.lit(True)).join(bad, F.lit(True)), "size", "violations > 0")


def _complexity(x: Found) -> DataFrame:
    got = rust_syntax.summary(rust_syntax.functions(x.parsed), max_cyclomatic=x.ctx.limits.get("complexity:max-cyclomatic-per-function"))
    bad = x.violations.where("rule_id like 'complexity:%'").agg(F.count(F.lit(1)).alias("violations"))
    return _long(got.select("functions", "max_cyclomatic_complexity", "max_nesting_depth", "complex_functions").join(bad, F.lit(True)), "complexity", "violations > 0")


def _duplicates(x: Found) -> DataFrame:
    hits = duplicates.repeated(duplicates.windows_of(duplicates.held_syntax(x.parsed)))
    got = duplicates.summary(duplicates.intervals(hits)).select("duplicate_lines", "files_with_duplicates")
    return _long(got, "duplicates", "duplicate_lines > 0")


#: The collectors on sources: each makes rows (collector, metric, value, text). Others can
#: be added by name.
REGISTRY: dict[str, Callable[[Found], DataFrame]] = {"duplicates": _duplicates, "loc": _loc, "size": _size, "complexity": _complexity}


def tool_rows(runs: DataFrame) -> DataFrame:
    """Metrics and statuses of captured runs (collector, exit_code, stdout, stderr)."""
    numbers = tool_outputs.tool_metrics(runs)
    counted = numbers.where("metric in ('warning_count', 'failed', 'vulnerability_count')").select("collector", F.col("value").alias("count"))
    said = runs.join(F.broadcast(counted), "collector", "left").select("collector", F.lit("status").alias("metric"), F.lit(None).cast("double").alias("value"), tool_outputs.status(F.col("collector"), F.col("exit_code"), F.coalesce("count", F.lit(0.0))).alias("text"))
    ran = runs.select("collector").distinct()
    return numbers.join(F.broadcast(ran), "collector", "left_semi").select("collector", "metric", "value", F.lit(None).cast("string").alias("text")).unionByName(said)


def timed(part: DataFrame, collector: str) -> DataFrame:
    """A collector's metrics, made and written now, and ``duration_ms``: how long that took."""
    start = time.monotonic()
    made = written(part, f"metrics-{collector}")
    took = made.sparkSession.createDataFrame([(collector, "duration_ms", float(round(1000 * (time.monotonic() - start))), None)], SCHEMA)
    return made.unionByName(took)


def collect(spark: SparkSession, files: DataFrame, ctx: Context, runs: DataFrame | None = None, *, durations: bool = False) -> DataFrame:
    """Metrics (collector, metric, value, text) of all collectors that run; those that
    don't run have the status ``skipped`` and no metrics. With ``durations`` the collectors
    on sources run one after the other, and each is timed."""
    have = list(COLLECTORS[8:]) + ([r[0] for r in runs.select("collector").distinct().limit(50).collect()] if runs is not None else [])
    asked = spark.createDataFrame([(ctx.profile, list(ctx.disabled), have)], "profile string, disabled array<string>, available array<string>")
    which = {r.collector: r.runs for r in assembly.enabled(asked).collect()}
    found = Found(files, rust_syntax.syntax(files), ctx)
    parts = [timed(REGISTRY[k](found), k) if durations else REGISTRY[k](found) for k in REGISTRY if which.get(k)]
    if runs is not None:
        parts.append(tool_rows(runs.where(F.col("collector").isin([k for k, v in which.items() if v]))))
    off = [k for k, v in which.items() if not v]
    parts.append(spark.createDataFrame([(k, "status", None, "skipped") for k in off], SCHEMA))
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    return all_


def metrics_of(assembled: DataFrame) -> DataFrame:
    """Rows of assembly.assemble as metrics (collector, metric, value, text)."""
    names = {m: snake(m) for ms in assembly.METRICS.values() for m in ms}
    renamed = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("metric"))
    numbers = assembled.where("metric is not null").select("collector", renamed.alias("metric"), "value", F.lit(None).cast("string").alias("text"))
    said = assembled.groupBy("collector").agg(F.first("status").alias("text")).select("collector", F.lit("status").alias("metric"), F.lit(None).cast("double").alias("value"), "text")
    return numbers.unionByName(said)


def epoch_fields(events: DataFrame, column: str = "ts") -> DataFrame:
    """The distinct times of a table, in parts, as text, and whether in a leap year."""
    at = F.unix_timestamp(F.col(column).cast("timestamp"))
    parts = S.epoch_parts(F.col("seconds"))
    return events.select(at.alias("seconds")).where("seconds is not null").distinct().select("seconds", *[c.alias(k) for k, c in parts.items()], S.iso_utc(F.col("seconds")).alias("iso"), S.is_leap(parts["year"]).alias("leap"))
