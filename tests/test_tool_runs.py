from __future__ import annotations

from siltstone import config
from siltstone.operators import tool_outputs
from siltstone.plans import collect as plans

SCHEMA = "project string, collector string, exit_code int, stdout string, stderr string"
LINT = '{"level":"warning","code":{"code":"c"},"message":"m"}'


def test_runs_of_several_projects(spark):
    rows = [
        ("a", "clippy", 0, f"{LINT}\n\nnoise\n{LINT}", ""), ("b", "clippy", 0, "", ""), (None, "clippy", 1, None, None), ("c", "clippy", 1, LINT, ""),
        ("a", "tests", 0, "test result: ok. 3 passed; 1 failed", "x\ntest result: ok. 4 passed; 2 ignored"), ("b", "tests", 0, "nothing said", None), (None, "tests", 0, None, None),
        ("a", "audit", 0, '{"vulnerabilities":{"found":2,"list":[{"severity":"critical"}]}}', ""), ("b", "audit", 0, "junk", ""), ("b", "fmt", 1, "", ""), ("a", "fmt", None, "", ""),
    ]
    runs = spark.createDataFrame(rows, SCHEMA)
    metrics = tool_outputs.tool_metrics(runs, ["project"])
    got = {(r.project, r.metric): r.value for r in metrics.collect()}
    assert {k[0]: v for k, v in got.items() if k[1] == "warning_count"} == {"a": 2, "b": 0, None: 0, "c": 1}
    assert {k: v for k, v in got.items() if k[1] in ("passed", "failed", "ignored")} == {("a", "passed"): 4, ("a", "failed"): 1, ("a", "ignored"): 2, **{(p, m): 0 for p in ("b", None) for m in ("passed", "failed", "ignored")}}
    assert got["a", "critical_count"] == 1 and got["b", "vulnerability_count"] == 0
    said = {(r.project, r.collector): r.status for r in tool_outputs.statuses(runs, metrics, ["project"]).collect()}
    assert said == {
        ("a", "clippy"): "pass", ("b", "clippy"): "pass", (None, "clippy"): "error", ("c", "clippy"): "fail", ("a", "tests"): "fail", ("b", "tests"): "pass", (None, "tests"): "pass",
        ("a", "audit"): "fail", ("b", "audit"): "pass", ("b", "fmt"): "fail", ("a", "fmt"): "error",
    }
    assert {r.project for r in tool_outputs.clippy_lints(runs, ["project"]).collect()} == {"a", "c"}


def test_collectors_are_timed(spark):
    files = spark.createDataFrame([("a.rs", "fn f() {}\n")], "path string, content string")
    ctx = config.Context()
    found = plans.collect(spark, files, ctx, durations=True).collect()
    took = {r.collector: r.value for r in found if r.metric == "duration_ms"}
    assert set(took) == set(plans.REGISTRY) and all(v >= 0 for v in took.values())
    plain = {tuple(r) for r in plans.collect(spark, files, ctx).collect()}
    assert {tuple(r) for r in found if r.metric != "duration_ms"} == plain
