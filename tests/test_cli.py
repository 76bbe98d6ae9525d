from __future__ import annotations

import json

import pytest

from siltstone import cli, config, report
from siltstone.functions.scalars import COLLECTORS
from siltstone.operators import baseline, duplicates, gate, lines, rust_syntax
from siltstone.plans import collect as plans
from siltstone.sources import files as sources


@pytest.fixture
def project(tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "target").mkdir()
    (tmp_path / "Cargo.toml").write_text('[package]\nedition = "2024"\n')
    (tmp_path / "siltstone.toml").write_text("[gate.size]\nmax_lines_per_file = 3\n[gate.complexity]\nmax-nesting-depth = 0\n")
    (tmp_path / "src" / "a.rs").write_text("fn f(x: u8) {\n    if x > 1 {\n    }\n}\n")
    (tmp_path / "src" / "_b.rs").write_text("fn g() {}\n")
    (tmp_path / "src" / "empty.rs").write_text("")
    (tmp_path / "src" / "bad.rs").write_bytes(b"\xff\xfe")
    (tmp_path / "target" / "c.rs").write_text("fn gone() {}\n")
    return tmp_path


def test_scan(spark, project):
    got = dict(tuple(r) for r in sources.scan(spark, str(project)).collect())
    assert sorted(got) == ["src/_b.rs", "src/a.rs", "src/empty.rs"] and got["src/empty.rs"] == ""
    assert sources.files_skipped(spark, str(project)) == 1 and sources.files_skipped(spark, str(project / "target"), all_folders=True) == 0
    assert "target/c.rs" in {r.path for r in sources.scan(spark, str(project), all_folders=True).collect()}


def test_report_says_what_it_leaves_out(spark, monkeypatch):
    monkeypatch.setattr(report, "SHOWN", 3)
    document = {"gateResult": "pass", "summary": dict.fromkeys(("collectorsRun", "collectorsPassed", "collectorsFailed", "collectorsSkipped"), 0), "violations": []}
    said = report.report_text(document, {"rows": spark.range(9, -1, -1), "few": spark.range(3)})
    assert said.split("rows:")[1].split() == ["0", "1", "2", "...", "and", "7", "more", "few:", "0", "1", "2"]


def test_commands(spark, project, capsys):
    run = lambda *a: cli.main(["--project-dir", str(project), *a], spark)
    assert run("gate") == 2  # nothing collected yet
    assert run("init") == 0 and run("doctor") == 0
    assert "duplicates" in capsys.readouterr().out
    runs = project / "runs.json"
    runs.write_text(json.dumps({"collector": "clippy", "exit_code": 0, "stdout": '{"level":"warning","code":{"code":"c"}}', "stderr": ""}) + "\n")
    assert run("--runs", str(runs), "--disable-collector", "loc,nothing", "collect") == 0
    found = json.loads((project / "quality" / "metricsSummary.json").read_text())
    assert list(found["collectors"]) == list(COLLECTORS) and found["project"]["rustEdition"] == "2024"
    assert found["collectors"]["clippy"] == {"warningCount": 1, "status": "pass"} and found["collectors"]["loc"] == {"status": "skipped"}
    assert found["collectors"]["size"]["violations"] == 1 and found["collectors"]["complexity"]["maxNestingDepth"] == 1
    assert run("init-baseline") == 0 and run("init-baseline") == 1 and run("--force", "init-baseline") == 0
    assert run("gate") == 1  # size and complexity have violations
    shown = json.loads((project / "quality" / "qualityReport.json").read_text())
    assert [v["collector"] for v in shown["violations"]] == ["size", "complexity"] and shown["summary"]["collectorsRun"] == 10
    (project / "siltstone.toml").write_text("")
    capsys.readouterr()
    assert run("-v", "--runs", str(runs), "qa") == 0
    assert "duplicate blocks:" in capsys.readouterr().out
    assert run("update-baseline") == 0
    assert "threshold changes" in capsys.readouterr().out.lower()
    base = json.loads((project / "quality" / "baseline.json").read_text())
    with pytest.raises(ValueError):
        report.threshold_rows(base | {"schemaVersion": "2"})


def test_config(tmp_path, capsys):
    got = config.context({"gate": {"defaults": {"max-lines-per-file": 9}, "complexity": {"max_nesting_depth": 4}}, "profile": {"default": "FAST"}, "collectors": {"audit": False}, "output": {"dir": "o"}}, disabled="Loc, what")
    assert got.profile == "fast" and got.disabled == ("loc", "audit") and got.output == "o"
    assert got.limits == {"size:max-lines-per-file": 9, "complexity:max-nesting-depth": 4}
    assert "what" in capsys.readouterr().err
    (tmp_path / "x.toml").write_text("= broken")
    assert config.load(str(tmp_path / "x.toml")) == {} and config.load(None) == {}
    assert config.context({}, profile="odd").profile == "full"


def test_all_pass_and_empty_tables(spark):
    held = [(c, "status", None, "pass") for c in COLLECTORS] + [("coverage", "line_percent", 90.0, None)]
    metrics = spark.createDataFrame(held, plans.SCHEMA)
    base = baseline.from_metrics(metrics)
    got = gate.summary(gate.rows(metrics, base)).first()
    assert (got.gate_result, got.collectors_passed, got.collectors_failed, got.violations) == ("pass", 12, 0, 0)
    none = gate.summary(gate.rows(metrics.limit(0), base.limit(0))).first()
    assert (none.gate_result, none.collectors_run, none.collectors_skipped) == ("pass", 10, 2)
    assert baseline.diff(base, base, names=None).count() == 0


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("", 1), ("if a {}", 2), ("if a {} else if b {}", 3), ("match x { 1 => {}, 2 => {}, _ => {} }", 5), ("match x { 1 => a, 2 => b, 3 => c, _ => d }", 6), ("for i in 0..9 {}", 2), ("while a {}", 2), ("loop { break; }", 2), ("g()?;", 2),
        ("if a && b || c {}", 2), ("let f = |x: u8| if x > 1 { 2 } else { 3 };", 2), ("match if a { 1 } else { 2 } { _ => () }", 3), ("if let S { a, .. } = x {} ", 2), ("while let Some(x) = it.next() { if let 1..=3 = x {} }", 3), ("fn inner() { if a {} }", 1),
    ],
)
def test_complexity(body, want):
    (got,) = rust_syntax.functions_of(rust_syntax.token_tree("fn f() {" + body + "}"))
    assert got["cyclomatic"] == want


def test_syntax_tokens_repeat(spark):
    body = "\n".join(f"    let x{i} = call{i}(a, b, c)?;" for i in range(12))
    files = spark.createDataFrame([("a.rs", f"fn f() {{\n{body}\n}}"), ("b.rs", f"// note\nfn g(z: u8) {{\n{body}\n}}"), ("c.rs", "fn ("), ("d.rs", None)], "path string, content string")
    parsed = rust_syntax.syntax(files)
    tokens = duplicates.held_syntax(parsed)
    spans = duplicates.token_intervals(duplicates.repeated(duplicates.windows_of(tokens)))
    got = sorted(tuple(r) for r in duplicates.line_intervals(spans).collect())
    assert got == [("a.rs", 1, 14), ("b.rs", 2, 15)]
    (block,) = duplicates.top_blocks(duplicates.blocks(spans, tokens)).collect()
    assert (block.path, block.lines, block.occurrences, block.omitted) == ("a.rs", 14, 2, 0)
    assert rust_syntax.syntax(files.limit(0)).count() == 0


def test_empty_and_null_files(spark):
    files = spark.createDataFrame([], "path string, content string")
    assert tuple(lines.size_maxima(lines.classified(files)).first()) == (0, 0, 0)
    assert lines.line_summary(lines.classified(files)).first().total_lines == 0
    assert duplicates.summary(duplicates.intervals(duplicates.repeated(duplicates.windows(files)))).first().status == "pass"
    null = spark.createDataFrame([("a", None)], "path string, content string")
    assert lines.classified(null).first().total == 0 and duplicates.windows(null).count() == 0
