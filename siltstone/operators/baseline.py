"""Baselines: thresholds made from metrics, and what changed between two of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.gate import LEAST_LINE, THRESHOLDS

#: Which metric each threshold is copied from (fixed values). A status that passed makes
#: must_pass; a line length is never below LEAST_LINE.
COPIED = {
    "fmt.must_pass": "fmt.status", "clippy.max_warnings": "clippy.warning_count", "tests.max_failures": "tests.failed", "coverage.min_line_percent": "coverage.line_percent", "deny.max_banned": "deny.banned_count",
    "deny.max_license_violations": "deny.license_violations", "audit.max_vulnerabilities": "audit.vulnerability_count", "audit.max_critical": "audit.critical_count", "hack.must_pass": "hack.status",
    "mutants.min_score": "mutants.mutation_score", "duplicates.max_duplicate_lines": "duplicates.duplicate_lines", "loc.max_line_length": "loc.max_line_length_allowed",
    "size.max_lines_per_file": "size.max_lines_per_file", "size.max_code_lines_per_file": "size.max_code_lines_per_file", "size.max_lines_per_function": "size.max_lines_per_function",
    "size.max_parameters_per_function": "size.max_parameters_per_function", "complexity.max_cyclomatic_per_function": "complexity.max_cyclomatic_complexity", "complexity.max_nesting_depth": "complexity.max_nesting_depth",
}
#: The thresholds that the short diff shows, and the least difference of two fractions.
SHORT = ("fmt.must_pass", "clippy.max_warnings", "tests.max_failures", "coverage.min_line_percent")
EPSILON = 2.220446049250313e-16


def from_metrics(metrics: DataFrame) -> DataFrame:
    """Thresholds (name, value) from metrics (collector, metric, value, text). Missing
    counts are 0, a missing status did not pass."""
    names = metrics.sparkSession.createDataFrame([(t, *COPIED[t].split(".")) for t in THRESHOLDS], "name string, collector string, metric string")
    found = names.join(metrics, ["collector", "metric"], "left")
    number = F.coalesce("value", F.lit(0.0))
    value = F.when(F.col("metric") == "status", F.when(F.col("text") == "pass", 1.0).otherwise(0.0)).when(F.col("name") == "loc.max_line_length", F.greatest(number, F.lit(float(LEAST_LINE)))).otherwise(number)
    return found.select("name", value.alias("value"))


def diff(old: DataFrame, new: DataFrame, *, names: tuple[str, ...] | None = SHORT) -> DataFrame:
    """name, old_value, new_value of the thresholds that changed (all of them, with
    ``names`` None). One that is set in one baseline only has changed."""
    both = old.select("name", F.col("value").alias("old_value")).join(new.select("name", F.col("value").alias("new_value")), "name", "full_outer")
    same = F.col("old_value").eqNullSafe(F.col("new_value")) | F.coalesce(F.abs(F.col("old_value") - F.col("new_value")) <= EPSILON, F.lit(False))
    changed = both.where(~same)
    return changed if names is None else changed.where(F.col("name").isin(*names))
