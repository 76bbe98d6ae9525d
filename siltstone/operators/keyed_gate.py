"""The gate for many groups at once: metrics of each group against a table of rules.

Metrics are in long form (keys, collector, metric, value), one row for each group and
metric, so that groups are judged where their rows are; nothing is gathered to one row.
A rule can be for all groups or for some: of the rules for one check of one group, the
one that names most of its keys counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RULES = "ordinal int, check string, collector string, metric string, least double, most double"


def unpivoted(wide: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Columns named collector.metric -> rows keys, collector, metric, value."""
    rest = [c for c in wide.columns if c not in keys]
    long = wide.select(*keys, *[F.col(f"`{c}`").cast("double").alias(c) for c in rest]).unpivot(list(keys), [F.col(f"`{c}`") for c in rest], "name", "value")
    return long.select(*keys, F.substring_index("name", ".", 1).alias("collector"), F.substring_index("name", ".", -1).alias("metric"), "value")


def rules(spark: SparkSession, rows: list[tuple], keys: Sequence[str]) -> DataFrame:
    """A table of rules from (ordinal, check, collector, metric, least, most, *keys): the
    value is at least ``least`` and at most ``most`` (None: no bound), in groups with
    these keys (None: any). Written by hand, so its size is known."""
    return spark.createDataFrame(rows, RULES + "".join(f", {k} string" for k in keys))


def checks(metrics: DataFrame, rules: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row for each group and check that applies: keys, ordinal, check, collector,
    metric, value, least, most, ok. Equal values pass; a metric that is missing or not a
    number in a group isn't judged there."""
    said = rules.select("ordinal", "check", "collector", "metric", "least", "most", *[F.col(k).alias(f"for_{k}") for k in keys])
    # Rules meet metrics by name; whether they are for the group is a condition of the join.
    fits = [F.col("r.collector") == F.col("m.collector"), F.col("r.metric") == F.col("m.metric"), *[F.col(f"r.for_{k}").isNull() | (F.col(f"r.for_{k}") == F.col(f"m.{k}").cast("string")) for k in keys]]
    named = sum((F.col(f"r.for_{k}").isNotNull().cast("int") for k in keys), F.lit(0))
    met = metrics.where(F.col("value").isNotNull() & ~F.isnan("value")).alias("m").join(F.broadcast(said.alias("r")), fits)
    met = met.select(*[F.col(f"m.{k}") for k in keys], "ordinal", "check", "m.collector", "m.metric", "value", "least", "most", named.alias("named"))
    best = Window.partitionBy(*keys, "check").orderBy(F.col("named").desc(), "ordinal")
    ok = F.coalesce(F.col("value") >= F.col("least"), F.lit(True)) & F.coalesce(F.col("value") <= F.col("most"), F.lit(True))
    return met.withColumn("k", F.row_number().over(best)).where("k = 1").drop("k", "named").withColumn("ok", ok)


def message(check: Column, value: Column, least: Column, most: Column) -> Column:
    number = lambda c: F.format_string("%.2f", c)
    return F.when(value < least, F.concat(check, F.lit(": "), number(value), F.lit(" is below "), number(least))).otherwise(F.concat(check, F.lit(": "), number(value), F.lit(" is above "), number(most)))


def outcomes(groups: DataFrame, judged: DataFrame, collectors: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """One row for each group and collector: keys, collector, checks, violations, outcome
    (passed if all of its checks are, skipped without any), first_message."""
    every = groups.select(*keys).distinct().withColumn("collector", F.explode(F.array(*map(F.lit, collectors))))
    said = F.when(~F.col("ok"), F.struct("ordinal", "check", message(F.col("check"), F.col("value"), F.col("least"), F.col("most")).alias("m")))
    rolled = judged.groupBy(*keys, "collector").agg(F.count(F.lit(1)).alias("checks"), F.count_if(~F.col("ok")).alias("violations"), F.bool_and("ok").alias("all_ok"), F.min(said)["m"].alias("first_message"))
    same = [F.col(f"e.{k}").eqNullSafe(F.col(f"j.{k}")) for k in (*keys, "collector")]
    both = every.alias("e").join(rolled.alias("j"), same, "left")
    outcome = F.when(F.col("all_ok").isNull(), "skipped").when(F.col("all_ok"), "passed").otherwise("failed")
    return both.select(*[F.col(f"e.{k}") for k in keys], "e.collector", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("checks", "violations")], outcome.alias("outcome"), "first_message")


def tallies(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row for each group: keys, gate_result (fail if there is any violation),
    violations, collectors_run, _passed, _failed, _skipped."""
    many = lambda k: F.count_if(F.col("outcome") == k)
    return found.groupBy(*keys).agg(
        F.when(F.sum("violations") == 0, "pass").otherwise("fail").alias("gate_result"), F.sum("violations").alias("violations"), (many("passed") + many("failed")).alias("collectors_run"),
        many("passed").alias("collectors_passed"), many("failed").alias("collectors_failed"), many("skipped").alias("collectors_skipped"),
    )
