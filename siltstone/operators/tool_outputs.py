"""Captured outputs of external tools: parsers, and the status of each run.

Input: runs (collector, exit_code, stdout, stderr), one row for each run, and columns that
tell runs of different projects apart (``keys``): results are for each of these, and a
run without findings has zeros. Everything is a DataFrame expression; what can't be
parsed gives the defaults, never an error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import scalars as S
from siltstone.operators.lines import split_lines, trim

#: What the tools are called with (fixed values, metadata only).
COMMANDS = {
    "fmt": "cargo fmt --check",
    "clippy": "cargo clippy --message-format=json --quiet",
    "tests": "cargo nextest run --message-format=json | cargo test --message-format=json",
    "coverage": "cargo llvm-cov --json --quiet",
    "deny": "cargo-deny check --format=json",
    "audit": "cargo-audit --json",
    "hack": "cargo hack check --feature-powerset --no-dev-deps",
    "mutants": "cargo mutants --output <dir>/mutants.out",
}


def of(runs: DataFrame, collector: str) -> DataFrame:
    return runs.where(F.col("collector") == collector)


def _lints(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every line of a run, or one row if it has none, with ``lint``: whether it is one."""
    lines = of(runs, "clippy").select(*keys, F.posexplode_outer(split_lines(F.col("stdout"))).alias("seq", "text"))
    j = F.col("j")
    parsed = lines.select(*keys, "seq", F.when(trim(F.col("text")) != "", S.parsed(F.col("text"))).alias("j"))
    each = parsed.select(*keys, "seq", S.json_str(j, "$.level").alias("level"), S.json_str(j, "$.code.code").alias("code"), S.json_str(j, "$.message").alias("message"), S.json_str(j, "$.file").alias("file"), S.u32(S.json_u64(j, "$.line")).alias("line"))
    return each.withColumn("lint", F.coalesce(F.col("level").isin("warning", "error") & F.col("code").isNotNull(), F.lit(False)))


def clippy_lints(runs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row for each coded warning or error: code, message, file, line. Blank lines and
    lines that are not JSON are skipped."""
    return _lints(runs, keys).where("lint").select(*keys, "seq", "level", "code", F.coalesce("message", F.lit("")).alias("message"), "file", "line")


def clippy_count(runs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return _lints(runs, keys).groupBy(*keys).agg(F.count_if("lint").alias("warning_count"))


def test_totals(runs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """passed, failed, ignored: each the number in the last part of a ``test result:``
    line that names it (later lines win, one by one)."""
    both = F.concat_ws("\n", F.coalesce("stdout", F.lit("")), F.coalesce("stderr", F.lit("")))
    lines = of(runs, "tests").select(*keys, F.posexplode_outer(F.filter(split_lines(both), lambda x: x.contains("test result:"))).alias("line_no", "line"))
    parts = lines.select(*keys, "line_no", F.posexplode_outer(F.split("line", ";")).alias("part_no", "part"))
    has = lambda k: F.col("part").contains(k) & F.col("n").isNotNull()
    # A part counts for the first of the names that it has with a number.
    kind = F.when(has("passed"), "passed").when(has("failed"), "failed").when(has("ignored"), "ignored")
    named = parts.withColumn("n", S.first_u32(F.col("part"))).withColumn("kind", kind)
    last = lambda k: F.coalesce(F.max_by(F.when(F.col("kind") == k, F.col("n")), F.when(F.col("kind") == k, F.struct("line_no", "part_no"))), F.lit(0)).cast("long").alias(k)
    return named.groupBy(*keys).agg(last("passed"), last("failed"), last("ignored"))


def coverage_percent(runs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    j = S.parsed(F.col("stdout"))
    percent = F.coalesce(S.json_f64(j, "$.lines.percent"), S.json_f64(j, "$.totals.lines.percent"))
    return of(runs, "coverage").select(*keys, percent.alias("found"), F.coalesce(percent, F.lit(0.0)).alias("line_percent"))


def deny_counts(runs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    j = S.parsed(F.col("stdout"))
    many = lambda path, name: F.when(S.json_items(j, path).isNotNull(), F.size(S.json_items(j, path))).otherwise(0).cast("long").alias(name)
    return of(runs, "deny").select(*keys, many("$.ban.list", "banned_count"), many("$.license.violations", "license_violations"))


def audit_counts(runs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    j = S.parsed(F.col("stdout"))
    critical = F.filter(F.coalesce(S.json_items(j, "$.vulnerabilities.list"), F.expr("cast(array() as array<variant>)")), lambda x: F.lower(S.json_str(x, "$.severity")) == "critical")
    return of(runs, "audit").select(*keys, F.coalesce(S.u32(S.json_u64(j, "$.vulnerabilities.found")), F.lit(0)).alias("vulnerability_count"), F.size(critical).cast("long").alias("critical_count"))


def feature_count(runs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The first number in the text, if it says ``combination`` anywhere."""
    text = F.coalesce("stderr", F.lit(""))
    return of(runs, "hack").select(*keys, F.when(text.contains("combination"), F.coalesce(S.first_u32(text), F.lit(0))).otherwise(0).cast("long").alias("feature_combinations_tested"))


def mutation_score(runs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """From the outcomes document in stdout; ``parsed`` is false if it is not JSON."""
    j = S.parsed(F.col("stdout"))
    caught, missed = (F.coalesce(S.u32(S.json_u64(j, f"$.{k}")), F.lit(0)) for k in ("caught", "missed"))
    return of(runs, "mutants").select(*keys, F.coalesce(F.try_divide(caught.cast("double"), caught + missed), F.lit(0.0)).alias("mutation_score"), caught.alias("caught"), missed.alias("missed"), j.isNotNull().alias("parsed"))


def runner_choice(available: DataFrame) -> DataFrame:
    """From (tool, available): the test runner, and what its stderr begins with."""
    has = F.coalesce(F.bool_or((F.col("tool") == "nextest") & F.col("available")), F.lit(False))
    return available.agg(F.when(has, "nextest").otherwise("test").alias("runner"), F.when(has, "[runner: nextest] ").otherwise("").alias("prefix"))


def status(collector: Column, exit_code: Column, count: Column) -> Column:
    """Status of a run from its exit code and its count of findings (lints, failures,
    vulnerabilities, duplicate or long lines, violations). No exit code: it did not run."""
    ok = exit_code == 0
    by_count = F.when(count > 0, "fail").otherwise("pass")
    return (
        F.when(collector.isin("tests", "audit", "duplicates", "loc", "size", "complexity"), by_count)
        .when(exit_code.isNull(), "error")
        .when(collector == "clippy", F.when(ok, "pass").when(count > 0, "fail").otherwise("error"))
        .when(collector == "coverage", F.when(ok, "pass").otherwise("error"))
        .otherwise(F.when(ok, "pass").otherwise("fail"))
    )


def tool_metrics(runs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """All metrics of the runs in long form: keys, collector, metric, value."""

    def long(df: DataFrame, collector: str, *names: str) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("m")
        return df.select(*keys, F.lit(collector).alias("collector"), each).select(*keys, "collector", "m.metric", "m.value")

    found = long(clippy_count(runs, keys), "clippy", "warning_count")
    for part in (
        long(test_totals(runs, keys), "tests", "passed", "failed", "ignored"), long(coverage_percent(runs, keys), "coverage", "line_percent"), long(deny_counts(runs, keys), "deny", "banned_count", "license_violations"),
        long(audit_counts(runs, keys), "audit", "vulnerability_count", "critical_count"), long(feature_count(runs, keys), "hack", "feature_combinations_tested"), long(mutation_score(runs, keys), "mutants", "mutation_score", "caught", "missed"),
    ):
        found = found.unionByName(part)
    return found


def statuses(runs: DataFrame, metrics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, collector, status of each run, from its exit code and its own count."""
    counted = metrics.where("metric in ('warning_count', 'failed', 'vulnerability_count')").select(*[F.col(k).alias(f"_{k}") for k in (*keys, "collector")], F.col("value").alias("count"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in (*keys, "collector")]
    return runs.join(counted, same, "left").select(*keys, "collector", status(F.col("collector"), F.col("exit_code"), F.coalesce("count", F.lit(0.0))).alias("status"))
