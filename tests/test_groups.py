from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from siltstone.operators import intervals, keyed_gate, ratchet
from siltstone.plans import groups
from siltstone.plans import queries as tables
from tests.oracle import SF, assert_same

KEYS = ("source", "lang")


@pytest.mark.parametrize("name", sorted(groups.QUERIES))
def test_against_sql(spark, name):
    assert_same(spark, groups.QUERIES[name], groups.ORACLES[name])


def metrics(spark, rows):
    return spark.createDataFrame(rows, "source string, lang string, collector string, metric string, value double")


def test_rules_for_some_groups_and_equal_values(spark):
    rules = keyed_gate.rules(spark, [(1, "lines", "size", "lines", None, 10.0, None, None), (2, "lines", "size", "lines", None, 5.0, "a", None), (3, "lines", "size", "lines", None, 20.0, "a", "en"), (4, "code", "loc", "code", 50.0, 90.0, None, None), (5, "odd", "loc", "none", 1.0, None, None, None)], KEYS)
    rows = [("a", "en", "size", "lines", 20.0), ("a", "de", "size", "lines", 6.0), ("a", None, "size", "lines", 5.0), (None, "en", "size", "lines", 10.0), ("b", "en", "size", "lines", 10.5)]
    rows += [("a", "en", "loc", "code", 50.0), ("a", "de", "loc", "code", 49.99), (None, "en", "loc", "code", 91.0), ("b", "en", "loc", "code", float("nan")), ("b", None, "loc", "code", None)]
    m = metrics(spark, rows)
    judged = keyed_gate.checks(m, rules, KEYS)
    got = {(r.source, r.lang, r.collector): (r.ordinal, r.ok) for r in judged.collect()}
    assert got == {
        ("a", "en", "size"): (3, True), ("a", "de", "size"): (2, False), ("a", None, "size"): (2, True), (None, "en", "size"): (1, True), ("b", "en", "size"): (1, False),
        ("a", "en", "loc"): (4, True), ("a", "de", "loc"): (4, False), (None, "en", "loc"): (4, False),
    }
    found = keyed_gate.outcomes(m, judged, ("loc", "size", "fmt"), KEYS)
    said = {(r.source, r.lang, r.collector): (r.checks, r.violations, r.outcome, r.first_message) for r in found.collect()}
    assert len(said) == 18 and said["a", "de", "loc"] == (1, 1, "failed", "code: 49.99 is below 50.00") and said[None, "en", "loc"][3] == "code: 91.00 is above 90.00"
    assert said["b", None, "loc"] == (0, 0, "skipped", None) and said["a", "en", "size"] == (1, 0, "passed", None)
    tallies = {(r.source, r.lang): tuple(r)[2:] for r in keyed_gate.tallies(found, KEYS).collect()}
    assert tallies["a", "de"] == ("fail", 2, 2, 0, 2, 1) and tallies["b", None] == ("pass", 0, 0, 0, 0, 3)
    none = keyed_gate.checks(m.limit(0), rules, KEYS)
    assert none.count() == 0 and keyed_gate.outcomes(m.limit(0), none, ("loc",), KEYS).count() == 0


def test_ratchet(spark, tmp_path):
    schema = "source string, lang string, name string, value double"
    table = lambda rows: spark.createDataFrame(rows, schema)
    store = ratchet.Store(spark, str(tmp_path / "t"), KEYS, table([]).schema)
    first = [("a", "en", "most", 10.0), ("a", "en", "least", 50.0), (None, "en", "most", 3.0), ("", "en", "most", 4.0), ("b", None, "most", 9.0), ("b", "de", "most", None)]
    assert {r.change for r in store.update(table(first), ("least",)).collect()} == {"added"}
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    before = files()
    second = [("a", "en", "most", 12.0), ("a", "en", "least", 40.0), (None, "en", "most", 2.0), ("", "en", "most", float("nan")), ("c", "en", "most", 1.0)]
    said = {(r.source, r.lang, r.name): (r.old_value, r.new_value, r.value, r.change) for r in store.update(table(second), ("least",)).collect()}
    assert said == {
        ("a", "en", "most"): (10.0, 12.0, 10.0, "kept"), ("a", "en", "least"): (50.0, 40.0, 50.0, "kept"), (None, "en", "most"): (3.0, 2.0, 2.0, "tightened"),
        ("", "en", "most"): (4.0, None, 4.0, "kept"), ("b", None, "most"): (9.0, None, 9.0, "kept"), ("c", "en", "most"): (None, 1.0, 1.0, "added"),
    }
    # Partitions without a change keep their files; a second run changes nothing at all.
    after = files()
    assert len(set(before) - set(after)) == 1 and len(set(after) - set(before)) == 2
    again = store.update(table(second), ("least",)).collect()
    assert {r.change for r in again} == {"kept"} and files() == after
    want = {k: v[2] for k, v in said.items()}
    assert {(r.source, r.lang, r.name): r.value for r in store.read().collect()} == want


def test_lines_of_intervals(spark):
    spans = [("x", "a", 1, 3), ("y", "a", 2, 200), ("z", "b", 5, 4), ("w", "c", 64, 64), ("x", "b", 60, 70)]
    left = spark.createDataFrame(spans, "block string, path string, start_line int, end_line int")
    right = spark.range(1, 301).selectExpr("cast(id as int) as line_no").crossJoin(spark.createDataFrame([("a",), ("b",)], "path string"))
    want = sorted((b, p, n) for b, p, s, e in spans if p in "ab" for n in range(s, e + 1))
    for size in (1, 7, 64, 1000):
        assert sorted((r.block, r.path, r.line_no) for r in intervals.lines_in(left, right, size=size).collect()) == want


def test_plans_have_no_nested_loops(spark):
    plan = tables.QUERIES["dup_block_lines"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    m = metrics(spark, [("a", "en", "loc", "code", 1.0)])
    plan = keyed_gate.checks(m, keyed_gate.rules(spark, groups.RULES, KEYS), KEYS)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_parity_in_sql(spark):
    want = {r.doc_id: r.half for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2).alias("half")).collect()}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    assert dict(con.execute(f"with {groups._CRC} select doc_id, half from crc").fetchall()) == want
