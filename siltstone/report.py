"""Sinks: JSON documents, text reports and the exit code. Their tables are small: a few
dozen metrics and rules, and lists that are reports with a top or a first N."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.scalars import COLLECTORS

#: What a status looks like (fixed values).
#: Rows of a table that a report shows.
SHOWN = 200
GLYPHS = {"pass": "✓ pass", "fail": "✗ FAIL", "skipped": "○ skip", "error": "⚠ error"}


def camel(name: str) -> str:
    first, *rest = name.split("_")
    return first + "".join(x.capitalize() for x in rest)


def summary_document(metrics: DataFrame, *, generated_at: str, project: dict, version: str = "1") -> dict:
    """The metrics document, collectors in order."""
    found: dict[str, dict] = {k: {"status": "skipped"} for k in COLLECTORS}
    for r in metrics.collect():
        if r.collector in found:
            value = r.text if r.value is None else int(r.value) if float(r.value).is_integer() and r.metric not in ("line_percent", "mutation_score") else r.value
            found[r.collector][camel(r.metric)] = value
    return {"schemaVersion": version, "generatedAt": generated_at, "project": project, "collectors": found}


def metrics_rows(document: dict) -> list[tuple]:
    """The document back as rows (collector, metric, value, text)."""
    check_version(document)
    from siltstone.plans.collect import snake

    rows = []
    for collector, held in document["collectors"].items():
        for k, v in held.items():
            rows.append((collector, snake(k), None, v) if isinstance(v, str) else (collector, snake(k), float(v), None))
    return rows


def check_version(document: dict) -> None:
    if document.get("schemaVersion") != "1":
        raise ValueError(f"schema version {document.get('schemaVersion')!r} is not supported, only '1' is")


def report_document(judged: DataFrame, verdict: DataFrame, *, generated_at: str) -> dict:
    v = verdict.first()
    bad = judged.where("violation").orderBy("ordinal").collect()
    return {
        "schemaVersion": "1", "generatedAt": generated_at, "gateResult": v.gate_result,
        "violations": [{"collector": r.collector, "metric": r.metric, "baselineValue": json.loads(r.baseline_value), "currentValue": json.loads(r.current_value), "message": r.message} for r in bad],
        "summary": {"collectorsRun": v.collectors_run, "collectorsPassed": v.collectors_passed, "collectorsFailed": v.collectors_failed, "collectorsSkipped": v.collectors_skipped},
    }


def baseline_document(thresholds: DataFrame, *, created_at: str) -> dict:
    held: dict[str, dict] = {}
    for r in thresholds.collect():
        collector, name = r.name.split(".")
        whole = name not in ("min_line_percent", "min_score")
        value = None if r.value is None else bool(r.value) if name == "must_pass" else int(r.value) if whole else r.value
        held.setdefault(collector, {})[camel(name)] = value
    return {"schemaVersion": "1", "createdAt": created_at, "thresholds": {k: held[k] for k in COLLECTORS if k in held}}


def threshold_rows(document: dict) -> list[tuple]:
    check_version(document)
    from siltstone.plans.collect import snake

    return [(f"{c}.{snake(k)}", None if v is None else float(v)) for c, held in document["thresholds"].items() for k, v in held.items()]


def pretty(document: dict) -> str:
    return json.dumps(document, indent=2, ensure_ascii=False) + "\n"


def write_json(document: dict, path: str) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(pretty(document))


def summary_text(document: dict) -> str:
    """One line for each collector: its status and its numbers."""
    out = [f"project: {document['project'].get('name', '')}", "collectors:"]
    for name, held in document["collectors"].items():
        numbers = ", ".join(f"{k} {v}" for k, v in held.items() if k != "status")
        out.append(f"  {name:<12}{GLYPHS[held['status']]}" + (f" ({numbers})" if numbers else ""))
    return "\n".join(out) + "\n"


def report_text(document: dict, details: dict[str, DataFrame] | None = None) -> str:
    """The verdict, the tallies, the violations, and with ``details`` some tables."""
    s = document["summary"]
    out = [f"gate: {document['gateResult'].upper()}", f"collectors: {s['collectorsRun']} run, {s['collectorsPassed']} passed, {s['collectorsFailed']} failed, {s['collectorsSkipped']} skipped"]
    out += [f"  ✗ [{v['collector']}] {v['metric']}: {v['message']}" for v in document["violations"]]
    for title, table in (details or {}).items():
        out += ["", f"{title}:"]
        shown = F.concat_ws(" ", *[F.col(c).cast("string") for c in table.columns])
        # In the order of the columns; how many are not shown is said.
        more = table.count() - SHOWN
        out += [f"  {r[0]}" for r in table.orderBy(*table.columns).select(shown).limit(SHOWN).collect()]
        out += [f"  ... and {more} more"] if more > 0 else []
    return "\n".join(out) + "\n"


def exit_code(document: dict) -> int:
    return 1 if document["gateResult"] != "pass" else 0
