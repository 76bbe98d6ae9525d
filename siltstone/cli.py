"""Commands: init, collect, gate, qa, init-baseline, update-baseline, doctor.

Tools are not run: ``--runs`` names captured outputs, NDJSON of collector, exit_code,
stdout, stderr.
"""

from __future__ import annotations

import argparse
import json
import os
import shutil
import sys

from pyspark.sql import SparkSession

from siltstone import config, report
from siltstone.functions import scalars as S
from siltstone.operators import assembly, baseline, duplicates, gate, lines, rust_syntax
from siltstone.plans import collect as plans
from siltstone.sources import files as sources

#: Which program each collector needs (fixed values).
PROGRAMS = {"fmt": "rustfmt", "clippy": "cargo-clippy", "tests": "cargo", "coverage": "cargo-llvm-cov", "deny": "cargo-deny", "audit": "cargo-audit", "hack": "cargo-hack", "mutants": "cargo-mutants"}
RUNS = "collector string, exit_code int, stdout string, stderr string"


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siltstone")
    p.add_argument("--project-dir", default=".")
    p.add_argument("--output-dir")
    p.add_argument("--profile")
    p.add_argument("--config")
    p.add_argument("--runs")
    p.add_argument("--json", action="store_true")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("--disable-collector", default="")
    p.add_argument("command", nargs="?", default="qa", choices=["init", "collect", "gate", "qa", "init-baseline", "update-baseline", "doctor"])
    p.add_argument("--force", action="store_true")
    return p


def _read(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Returns the exit code: 0, 1 if the gate fails, 2 for a wrong configuration."""
    a = _parser().parse_args(argv)
    held = config.load(a.config or os.path.join(a.project_dir, "siltstone.toml"))
    ctx = config.context(held, root=a.project_dir, output=a.output_dir, profile=a.profile, disabled=a.disable_collector)
    out = ctx.output if os.path.isabs(ctx.output) else os.path.join(ctx.root, ctx.output)
    at = {k: os.path.join(out, f"{k}.json") for k in ("metricsSummary", "baseline", "qualityReport")}
    os.makedirs(out, exist_ok=True)
    spark = spark or SparkSession.builder.getOrCreate()
    now = spark.range(1).select(S.now_iso()).first()[0]
    if a.command == "init":
        print(f"created {out}")
        return 0
    if a.command == "doctor":
        have = spark.createDataFrame([(k,) for k, x in PROGRAMS.items() if shutil.which(x)], "tool string")
        for r in assembly.doctor(spark, have).orderBy("ordinal").collect():
            print(r.line)
        return 0
    files = None
    try:
        if a.command in ("collect", "qa"):
            files = sources.scan(spark, ctx.root)
            if skipped := sources.files_skipped(spark, ctx.root):
                print(f"files left out because they are not UTF-8: {skipped}")
            runs = spark.read.schema(RUNS).json(a.runs) if a.runs else None
            depth = [(0, os.path.join(ctx.root, "Cargo.toml")), *[(1, os.path.join(ctx.root, d, "Cargo.toml")) for d in sorted(os.listdir(ctx.root))]]
            manifests = []
            for k, p in depth:
                if os.path.isfile(p):
                    with open(p, encoding="utf-8") as f:
                        manifests.append((k, p, f.read()))
            year = sources.edition(spark.createDataFrame(manifests, "depth int, path string, content string")).first()[0]
            metrics = plans.collect(spark, files, ctx, runs)
            project = {"name": os.path.basename(os.path.abspath(ctx.root)), "rustEdition": year, "workspaceRoot": os.path.abspath(ctx.root)}
            document = report.summary_document(metrics, generated_at=now, project=project)
            report.write_json(document, at["metricsSummary"])
            if a.command == "collect":
                print(report.pretty(document) if a.json else report.summary_text(document), end="")
                return 0
        document = _read(at["metricsSummary"])
        metrics = spark.createDataFrame(report.metrics_rows(document), plans.SCHEMA)
        made = baseline.from_metrics(metrics)
        if a.command in ("init-baseline", "update-baseline") or not os.path.exists(at["baseline"]):
            if a.command == "gate":
                raise FileNotFoundError(at["baseline"])
            if a.command == "init-baseline" and os.path.exists(at["baseline"]) and not a.force:
                print(f"error: {at['baseline']} exists; use --force", file=sys.stderr)
                return 1
            if a.command == "update-baseline" and os.path.exists(at["baseline"]):
                old = spark.createDataFrame(report.threshold_rows(_read(at["baseline"])), "name string, value double")
                changed = baseline.diff(old, made, names=None).orderBy("name").collect()
                print("Threshold changes:" if changed else "No threshold changes.")
                for r in changed:
                    print(f"  {r.name}: {r.old_value} -> {r.new_value}")
            report.write_json(report.baseline_document(made, created_at=now), at["baseline"])
            if a.command != "qa":
                return 0
        base = spark.createDataFrame(report.threshold_rows(_read(at["baseline"])), "name string, value double")
    except (FileNotFoundError, KeyError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    absolute = spark.createDataFrame(list(ctx.absolute.items()), "name string, value double")
    judged = gate.rows(metrics, gate.effective(base, absolute))
    result = report.report_document(judged, gate.summary(judged), generated_at=now)
    report.write_json(result, at["qualityReport"])
    details = None
    if a.verbose and files is not None:
        parsed = rust_syntax.syntax(files)
        tokens = duplicates.held_syntax(parsed)
        spans = duplicates.token_intervals(duplicates.repeated(duplicates.windows_of(tokens)))
        details = {"violations": plans.Found(files, parsed, ctx).violations, "long lines": lines.long_lines(files, max_line=ctx.max_line), "duplicate blocks": duplicates.top_blocks(duplicates.blocks(spans, tokens))}
    print(report.pretty(result) if a.json else report.report_text(result, details), end="")
    return report.exit_code(result)


if __name__ == "__main__":
    sys.exit(main())
