"""The gate: metrics against thresholds, one rule for each collector.

Tables are in long form: metrics (collector, metric, value, text), thresholds (name,
value), with booleans as 0 and 1 and no row or a null value where one is not set. All of
them have a few dozen rows, so that pivoting them to one row moves nothing of size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.scalars import COLLECTORS, fixed

#: Thresholds of a baseline, and the absolute ones that take their place (fixed values).
THRESHOLDS = (
    "fmt.must_pass", "clippy.max_warnings", "tests.max_failures", "coverage.min_line_percent", "deny.max_banned", "deny.max_license_violations", "audit.max_vulnerabilities", "audit.max_critical",
    "hack.must_pass", "mutants.min_score", "duplicates.max_duplicate_lines", "loc.max_line_length", "size.max_lines_per_file", "size.max_code_lines_per_file", "size.max_lines_per_function",
    "size.max_parameters_per_function", "complexity.max_cyclomatic_per_function", "complexity.max_nesting_depth",
)
ABSOLUTE = {
    "clippy.max_warnings": "max_clippy_warnings", "coverage.min_line_percent": "min_coverage_percent", "duplicates.max_duplicate_lines": "max_duplicate_lines", "loc.max_line_length": "max_line_length",
    "size.max_lines_per_file": "max_lines_per_file", "size.max_code_lines_per_file": "max_code_lines_per_file", "size.max_lines_per_function": "max_lines_per_function",
    "size.max_parameters_per_function": "max_parameters_per_function", "complexity.max_cyclomatic_per_function": "max_cyclomatic_per_function", "complexity.max_nesting_depth": "max_nesting_depth",
}
#: No line length below this is ever said.
LEAST_LINE = 120


def effective(baseline: DataFrame, absolute: DataFrame) -> DataFrame:
    """Thresholds (name, value, source): the absolute one if it is set, else the one of
    the baseline. absolute: (name, value), named as in a configuration."""
    names = baseline.sparkSession.createDataFrame([(t, ABSOLUTE.get(t)) for t in THRESHOLDS], "name string, key string")
    own = absolute.where("value is not null").select(F.col("name").alias("key"), F.col("value").alias("absolute"))
    found = names.join(baseline.select("name", F.col("value").alias("base")), "name", "left").join(own, "key", "left")
    source = F.when(F.col("absolute").isNotNull(), "absolute").when(F.col("base").isNotNull(), "baseline")
    return found.select("name", F.coalesce("absolute", "base").alias("value"), source.alias("source"))


def _one_row(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    m = metrics.agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(".", "collector", "metric"), F.struct("value", "text")))).alias("m"))
    t = thresholds.agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("t"))
    return m.join(t, F.lit(True))  # one row each


def rows(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """One row for each collector: ordinal, collector, metric, outcome (passed, failed,
    skipped), violation, and for violations baseline_value, current_value (JSON), message.

    Counts that are missing are 0, statuses that are missing are skipped. Equal values
    pass. A collector that did not run is judged on its zeros, but for the two status
    rules, where it is skipped.
    """
    v = lambda k: F.coalesce(F.try_element_at("m", F.lit(k))["value"], F.lit(0.0))
    s = lambda k: F.coalesce(F.try_element_at("m", F.lit(k + ".status"))["text"], F.lit("skipped"))
    t = lambda k: F.try_element_at("t", F.lit(k))
    n = lambda c: F.coalesce(c, F.lit(0.0)).cast("long").cast("string")
    x = lambda c: F.coalesce(c, F.lit(0.0)).cast("string")

    def rule(collector: str, metric: str, ok: Column, base: Column, now: Column, message: Column) -> Column:
        return F.struct(F.lit(collector).alias("collector"), F.lit(metric).alias("metric"), F.when(ok, "passed").otherwise("failed").alias("outcome"), (~ok).alias("violation"), base.alias("baseline_value"), now.alias("current_value"), message.alias("message"))

    def by_status(collector: str) -> Column:
        at = s(collector)
        outcome = F.when(at == "pass", "passed").when(at == "fail", "failed").otherwise("skipped")
        bad = (at == "fail") & (F.coalesce(t(f"{collector}.must_pass"), F.lit(0.0)) != 0)
        return F.struct(F.lit(collector).alias("collector"), F.lit("status").alias("metric"), outcome.alias("outcome"), bad.alias("violation"), F.lit("true").alias("baseline_value"), F.lit('"fail"').alias("current_value"), F.lit(f"{collector} check failed").alias("message"))

    def most(collector: str, metric: str, name: str, says: str) -> Column:
        now, limit = v(f"{collector}.{metric}"), F.coalesce(t(name), F.lit(0.0))
        return rule(collector, metric, now <= limit, n(limit), n(now), F.format_string(says, n(now), n(limit)))

    def least(collector: str, metric: str, name: str, digits: int, says: str) -> Column:
        now, limit = v(f"{collector}.{metric}"), F.coalesce(t(name), F.lit(0.0))
        return rule(collector, metric, now >= limit, x(limit), x(now), F.format_string(says, fixed(now, digits), fixed(limit, digits)))

    def two(collector: str, a: str, b: str, ta: str, tb: str, says: str) -> Column:
        pair = lambda ka, va, kb, vb: F.format_string(f'{{"{ka}":%s,"{kb}":%s}}', n(va), n(vb)) if ka < kb else F.format_string(f'{{"{kb}":%s,"{ka}":%s}}', n(vb), n(va))
        x1, x2, y1, y2 = v(f"{collector}.{a}"), v(f"{collector}.{b}"), F.coalesce(t(f"{collector}.{ta}"), F.lit(0.0)), F.coalesce(t(f"{collector}.{tb}"), F.lit(0.0))
        return rule(collector, f"{a} + {b}", (x1 <= y1) & (x2 <= y2), pair(ta, y1, tb, y2), pair(a, x1, b, x2), F.format_string(says, n(x1), n(x2)))

    def none(collector: str, asked: Column, says: str) -> Column:
        now = v(f"{collector}.violations")
        return rule(collector, "violations", ~asked | (now == 0), F.lit("0"), n(now), F.format_string(says, n(now)))

    allowed = v("loc.max_line_length_allowed")
    line = F.when(allowed > 0, allowed).otherwise(F.greatest(F.coalesce(t("loc.max_line_length"), F.lit(0.0)), F.lit(float(LEAST_LINE))))
    some = lambda *names: F.coalesce(*[t(k) for k in names]).isNotNull()
    rules = [
        by_status("fmt"),
        most("clippy", "warning_count", "clippy.max_warnings", "clippy warnings (%s) exceed max allowed (%s)"),
        most("tests", "failed", "tests.max_failures", "test failures (%s) exceed max allowed (%s)"),
        least("coverage", "line_percent", "coverage.min_line_percent", 1, "coverage (%s%%) below minimum (%s%%)"),
        two("deny", "banned_count", "license_violations", "max_banned", "max_license_violations", "deny check failed: %s banned, %s license violations"),
        two("audit", "vulnerability_count", "critical_count", "max_vulnerabilities", "max_critical", "audit found %s vulnerabilities (%s critical), exceeds baseline"),
        by_status("hack"),
        least("mutants", "mutation_score", "mutants.min_score", 2, "mutation score (%s) below minimum (%s)"),
        most("duplicates", "duplicate_lines", "duplicates.max_duplicate_lines", "duplicate lines (%s) exceed maximum (%s)"),
        rule("loc", "long_lines", v("loc.long_lines") == 0, F.lit("0"), n(v("loc.long_lines")), F.format_string("%s lines exceed max length (%s)", n(v("loc.long_lines")), n(line))),
        none("size", some(*[k for k in THRESHOLDS if k.startswith("size.")]), "%s size violation(s) detected"),
        none("complexity", some(*[k for k in THRESHOLDS if k.startswith("complexity.")]), "%s complexity violation(s) detected"),
    ]
    assert len(rules) == len(COLLECTORS)
    said = lambda k: F.when(F.col("r.violation"), F.col(f"r.{k}")).alias(k)
    found = _one_row(metrics, thresholds).select(F.posexplode(F.array(*rules)).alias("at", "r"))
    return found.select((F.col("at") + 1).cast("long").alias("ordinal"), "r.collector", "r.metric", "r.outcome", "r.violation", said("baseline_value"), said("current_value"), said("message"))


def violations(judged: DataFrame) -> DataFrame:
    return judged.where("violation").select("ordinal", "collector", "metric", "baseline_value", "current_value", "message")


def summary(judged: DataFrame) -> DataFrame:
    """The verdict (fail if there is any violation) and the tallies."""
    many = lambda k: F.count_if(F.col("outcome") == k)
    return judged.agg(
        F.when(F.count_if("violation") == 0, "pass").otherwise("fail").alias("gate_result"), F.count_if("violation").alias("violations"),
        (many("passed") + many("failed")).alias("collectors_run"), many("passed").alias("collectors_passed"), many("failed").alias("collectors_failed"), many("skipped").alias("collectors_skipped"),
    )
