"""Queries over small inline tables, and the same in DuckDB SQL or as golden rows.

The tables are SQL that both engines read the same way: the branches in them (comments,
tool outputs, thresholds) are in none of the data sets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import scalars as S
from siltstone.operators import assembly, baseline, duplicates, gate, lines, rust_syntax, tool_outputs
from siltstone.plans import collect as plans
from siltstone.plans import queries as tables
from siltstone.sources import files as sources

_NL = " || chr(10) || "


def _text(*parts: str) -> str:
    """A SQL string of lines."""
    return _NL.join("'" + p.replace("'", "''") + "'" for p in parts) if len(parts) > 1 else "'" + parts[0].replace("'", "''") + "'"


def _values(names: str, *rows: str) -> str:
    return f"select * from (values {', '.join(f'({r})' for r in rows)}) as t({names})"


LINES = _values(
    "path, content",
    "'a', " + _text("/* opened here,", "  goes on,", "  and on", "*/", "let n = 1;"),
    "'b', " + _text("/* opened and closed */", "let n = 1;"),
    "'c', " + _text("// to the end of the line", "let n = 1;", "/* more", "  of it", "*/"),
    "'d', " + _text("let n = 1;", "/* closed on", "  the last line */"),
    "'e', " + _text("/**/", "let n = 1;"),
    "'f', 'let n = 1; /* between */ let m = 2;'",
    "'g', " + _text("/* opened,", "", "  then an empty line", "*/", "let n = 1;"),
    "'h', " + _text("/// doc", "//! inner", "fn main() {}"),
    "'i', " + _text("/* d */ code", "x", "code /* open", "*/", "y", ""),
    "'j', 'a' || chr(13) || chr(10) || chr(13) || chr(10) || 'b' || chr(13) || chr(10)",
    "'k', ''",
    "'l', '\u00a0 // c\u2003' || chr(10) || '\u3000'",
)
RUNS = _values(
    "collector, exit_code, stdout, stderr",
    "'fmt', 1, '', 'Diff in a file'",
    "'clippy', 0, "
    + _text(
        '{"level":"warning","code":{"code":"clippy::a"},"message":"m1","file":"a.rs","line":3}', "", "not json", '{"level":"error","code":{"code":"clippy::b"},"line":-1}', '{"level":"note","code":{"code":"clippy::c"}}', '{"level":"warning","code":null}', '{"level":"warning","code":{"code":7}}',
        '{"level":"warning","code":{"code":"clippy::d"},"message":5,"file":null,"line":"9"}',
    )
    + ", ''",
    "'tests', 101, " + _text("running 3 tests", "test result: ok. 8 passed; 1 failed; 1 ignored; 0 measured") + ", " + _text("test result: FAILED. 4 passed; x failed; 99999999999 ignored", "no result: 77 passed"),
    "'coverage', 0, '{\"lines\":{\"percent\":87.5}}', ''",
    "'coverage', 0, '{\"totals\":{\"lines\":{\"percent\":92}}}', ''",
    "'coverage', 1, '{}', ''",
    "'coverage', 1, 'junk', ''",
    "'coverage', 1, '{\"lines\":{\"percent\":\"80\"}}', ''",
    "'deny', 1, '{\"ban\":{\"list\":[1,{},\"x\"]},\"license\":{\"violations\":[]}}', ''",
    "'deny', 0, '{\"ban\":{\"list\":5}}', ''",
    "'audit', 1, '{\"vulnerabilities\":{\"found\":2,\"list\":[{\"severity\":\"CRITICAL\"},{\"severity\":\"low\"},{\"severity\":1}]}}', ''",
    "'audit', 0, '{\"vulnerabilities\":{\"found\":true}}', ''",
    "'audit', 0, '{\"vulnerabilities\":{\"found\":1.5,\"list\":{}}}', ''",
    "'hack', 0, '', " + _text("info: start", "Checked 16 combinations"),
    "'hack', 0, '', 'Checked 16 things'",
    "'mutants', 0, '{\"caught\":80,\"missed\":20}', ''",
    "'mutants', 0, '{\"caught\":0}', ''",
    "'mutants', 2, 'broken', ''",
)
COUNTS = _values(
    "id, collector, exit_code, count",
    *[f"{i}, '{c}', {e}, {n}" for i, (c, e, n) in enumerate((c, e, n) for c in ("fmt", "clippy", "tests", "coverage", "deny", "audit", "hack", "mutants", "duplicates", "loc", "size", "complexity") for e in ("0", "1", "cast(null as int)") for n in (0, 3))],
)
METRICS = {
    "clean": "select * from (values ('fmt','status',cast(null as double),'pass'),('hack','status',cast(null as double),'pass'),('coverage','line_percent',80.0,''),('mutants','mutation_score',0.75,''),('clippy','warning_count',5.0,'')) as t(collector, metric, value, text)",
    "bad": "select * from (values ('fmt','status',cast(null as double),'fail'),('hack','status',cast(null as double),'fail'),('clippy','warning_count',5.0,''),('tests','failed',1.0,''),('coverage','line_percent',79.93,''),('deny','banned_count',0.0,''),('deny','license_violations',2.0,''),('audit','vulnerability_count',1.0,''),('mutants','mutation_score',0.5,''),('duplicates','duplicate_lines',10.0,''),('loc','long_lines',3.0,''),('loc','max_line_length_allowed',0.0,''),('size','violations',2.0,''),('complexity','violations',4.0,'')) as t(collector, metric, value, text)",
}
THRESHOLDS = "select * from (values ('fmt.must_pass',0.0),('clippy.max_warnings',10.0),('tests.max_failures',0.0),('coverage.min_line_percent',80.0),('deny.max_banned',0.0),('deny.max_license_violations',0.0),('audit.max_vulnerabilities',0.0),('audit.max_critical',0.0),('hack.must_pass',1.0),('mutants.min_score',0.75),('duplicates.max_duplicate_lines',10.0),('loc.max_line_length',284.0),('size.max_lines_per_file',cast(null as double))) as t(name, value)"
ABSOLUTE = "select * from (values ('max_clippy_warnings',0.0),('max_lines_per_file',500.0),('max_duplicate_lines',cast(null as double)),('unknown',1.0)) as t(name, value)"
RESULTS = _values(
    "seq, collector, status, stdout",
    "1, 'clippy', 'pass', '{\"warningCount\":7}'", "2, 'clippy', 'FAIL', '{\"warningCount\":4294967299}'", "3, 'other', 'pass', '{}'", "4, 'coverage', 'pass', '{\"linePercent\":81.5}'", "5, 'tests', 'error', 'junk'",
    "6, 'loc', 'pass', '{\"totalLines\":10,\"longLines\":true,\"files\":\"3\"}'", "7, 'fmt', 'odd', ''", "8, 'mutants', 'pass', '{\"mutationScore\":0.8,\"caught\":80,\"missed\":20}'",
)
ASKED = _values("run, profile, disabled, available", "1, 'fast', '', 'fmt,clippy,tests,loc'", "2, 'Full', 'CLIPPY,nothing', 'fmt,clippy,mutants,loc,size'", "3, 'deep', 'loc', 'mutants,loc'", "4, 'odd', '', ''")
MANIFESTS = _values(
    "run, depth, path, content",
    "1, 0, 'Cargo.toml', " + _text("[workspace]", 'edition = "1999"', "[workspace.package]", '  edition = "2024", '),
    "1, 1, 'a/Cargo.toml', " + _text("[package]", 'edition = "2018"'),
    "2, 0, 'Cargo.toml', " + _text("[package]", 'name = "x"', "edition.workspace = true"),
    "3, 0, 'Cargo.toml', '[dependencies]'",
    "3, 1, 'b/Cargo.toml', " + _text("[package]", 'edition="2021"'),
    "3, 1, 'a/Cargo.toml', " + _text("[package]", "edition =", "edition = '2015'"),
)
PATHS = _values("path", *[f"'{p}'" for p in ("/w/src/a.rs", "/w/target/a.rs", "/w/x/.git/b.rs", "/w/quality.rs", "/w/qualityx/c.rs", "/other/d.rs", "/w/.rs", "/w/e.RS", "/w/f.rs.txt", "quality/g.rs", "h.rs")])
SCALARS = _values("id, words, seconds, name", "1, 'a 12 x 7', 0, 'FMT'", "2, '+5', 1704067200, 'Clippy'", "3, '4294967296 -1 3.5 9', 1718451045, 'deep'", "4, '', 951782400, 'what'", "5, 'none', 4107542399, 'loc'")
RUST = {
    "a.rs": ["/// doc", "pub fn f(a: i32, b: HashMap<A, B>,) -> u8 {", "    if a > 0 { for x in b { if x {} } } else if b {}", "    match a { 1 => {}, 2 => g(|p, q| p), _ => {} }", "    h()?; println!(\"{}\", if a {1} else {2}); a && b", "}"],
    "b.rs": ["struct S { x: u8 }", "impl<T> S where T: Fn(u8) -> u8 {", "    #[inline]", "    fn m(&self, x: u8) { loop { while x {} } }", "    const C: u8 = 1;", "}", "mod t { fn hidden() {} }", "trait R { fn d(&self) {} }", "async fn empty() {}"],
    "broken.rs": ["fn f( {"],
    "notitem.rs": ["fn ok() {}", "let x = 1;"],
    "tokens.rs": ["// gone", "fn t<'a>(x: &'a str) -> char { r#\"a\"b\"# ; b'\\n'; 1..2; 0x1F_u8 /* c /* d */ */ }"],
}


def _rust(spark: SparkSession) -> DataFrame:
    return rust_syntax.syntax(spark.createDataFrame([(k, "\n".join(v)) for k, v in RUST.items()], "path string, content string"))


def _edition(spark: SparkSession) -> DataFrame:
    held = spark.sql(MANIFESTS)
    found = None
    for run in (1, 2, 3):
        one = sources.edition(held.where(F.col("run") == run)).select(F.lit(run).alias("run"), "edition")
        found = one if found is None else found.unionByName(one)
    return found


def _asked(spark: SparkSession) -> DataFrame:
    asked = spark.sql(ASKED).select("run", "profile", F.split("disabled", ",").alias("disabled"), F.split("available", ",").alias("available"))
    found = None
    for run in (1, 2, 3, 4):
        one = assembly.enabled(asked.where(F.col("run") == run)).select(F.lit(run).alias("run"), "profile", "ordinal", "collector", "runs", "reason")
        found = one if found is None else found.unionByName(one)
    return found


def _judged(spark: SparkSession, which: str) -> DataFrame:
    return gate.rows(spark.sql(METRICS[which]), gate.effective(spark.sql(THRESHOLDS), spark.sql(ABSOLUTE)))


def _kinds(spark: SparkSession) -> DataFrame:
    held = spark.sql(LINES)
    counted = lines.classified(held).select("path", "total", "blank", "comment", "code")
    shown = lines.kinds(held).groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "kind"))), lambda x: x.kind), ",").alias("kinds"))
    return counted.join(shown, "path", "left").select("path", "total", "blank", "comment", "code", F.coalesce("kinds", F.lit("")).alias("kinds"))


def _scalars(spark: SparkSession) -> DataFrame:
    parts = S.epoch_parts(F.col("seconds").cast("long"))
    return spark.sql(SCALARS).select("id", S.first_u32(F.col("words")).alias("number"), S.iso_utc(F.col("seconds").cast("long")).alias("iso"), S.is_leap(parts["year"]).alias("leap"), S.parse_name(F.col("name"), S.COLLECTORS).alias("collector"), S.parse_name(F.col("name"), S.PROFILES).alias("profile"), F.rpad("name", 12, " ").alias("padded"))


def metrics_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the documents as files, in the form that the gate takes."""
    counts, repeats = tables.measured(spark, sf_dir)
    loc = lines.line_summary(counts).join(lines.size_maxima(counts).drop("files"), F.lit(True)).join(duplicates.summary(repeats).drop("status"), F.lit(True))
    which = [("loc", k) for k in ("files", "total_lines", "code_lines", "comment_lines", "blank_lines", "long_lines", "max_line_length_found")] + [("size", "max_lines_per_file"), ("size", "max_code_lines_per_file"), ("duplicates", "duplicate_lines"), ("duplicates", "files_with_duplicates")]
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("collector"), F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for c, m in which])).alias("x")
    return loc.select(each).select("x.*", F.lit("").alias("text"))


_Q = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, _Q] = {
    "line_kinds_fixture": lambda s, d: _kinds(s),
    "clippy_lints": lambda s, d: tool_outputs.clippy_lints(s.sql(RUNS)),
    "test_totals": lambda s, d: tool_outputs.test_totals(s.sql(RUNS)),
    "coverage_percent": lambda s, d: tool_outputs.coverage_percent(s.sql(RUNS)),
    "deny_counts": lambda s, d: tool_outputs.deny_counts(s.sql(RUNS)),
    "audit_counts": lambda s, d: tool_outputs.audit_counts(s.sql(RUNS)),
    "feature_count": lambda s, d: tool_outputs.feature_count(s.sql(RUNS)),
    "mutation_score": lambda s, d: tool_outputs.mutation_score(s.sql(RUNS)),
    "status_rollup": lambda s, d: s.sql(COUNTS).select("id", tool_outputs.status(F.col("collector"), F.col("exit_code"), F.col("count")).alias("status")),
    "metrics_long": metrics_long,
    "thresholds_effective": lambda s, d: gate.effective(s.sql(THRESHOLDS), s.sql(ABSOLUTE)),
    "gate_rows": lambda s, d: _judged(s, "bad"),
    "gate_violations": lambda s, d: gate.violations(_judged(s, "bad")),
    "gate_summary": lambda s, d: gate.summary(_judged(s, "bad")),
    "gate_summary_clean": lambda s, d: gate.summary(gate.rows(s.sql(METRICS["clean"]), s.sql(THRESHOLDS))),
    "baseline_from_metrics": lambda s, d: baseline.from_metrics(metrics_long(s, d)),
    "baseline_diff": lambda s, d: baseline.diff(s.sql(THRESHOLDS), baseline.from_metrics(s.sql(METRICS["bad"])), names=None),
    "baseline_diff_short": lambda s, d: baseline.diff(s.sql(THRESHOLDS), baseline.from_metrics(s.sql(METRICS["bad"]))),
    "collector_assembly": lambda s, d: assembly.assemble(s, s.sql(RESULTS)),
    "profile_selection": lambda s, d: _asked(s),
    "doctor": lambda s, d: assembly.doctor(s, s.sql("select * from (values ('fmt'), ('AUDIT'), ('x')) as t(tool)")).select("ordinal", "collector", "available", "line"),
    "edition_lookup": lambda s, d: _edition(s),
    "scannable_paths": lambda s, d: s.sql(PATHS).select("path", sources.scannable(F.col("path")).alias("scanned"), sources.has_extension(F.col("path")).alias("named"), sources.relative(F.col("path"), "/w").alias("relative"), sources.base_name(F.col("path")).alias("base")),
    "scalar_functions": lambda s, d: _scalars(s),
    "epoch_fields": lambda s, d: plans.epoch_fields(s.read.parquet(f"{d}/events.parquet")),
    "rust_tokens": lambda s, d: rust_syntax.tokens(_rust(s)).where("path = 'tokens.rs'").select("pos", "tok", "line"),
    "rust_functions": lambda s, d: rust_syntax.functions(_rust(s)).select("path", "seq", "kind", "name", "start_line", "total_lines", "params"),
    "rust_complexity": lambda s, d: rust_syntax.functions(_rust(s)).select("path", "name", "cyclomatic", "nesting"),
    "complexity_violations": lambda s, d: rust_syntax.violations(rust_syntax.functions(_rust(s)), {"size:max-parameters-per-function": 1, "complexity:max-cyclomatic-per-function": 3, "complexity:max-nesting-depth": 2}),
    "rust_summary": lambda s, d: rust_syntax.summary(rust_syntax.functions(_rust(s)), max_cyclomatic=3),
    "rust_token_counts": lambda s, d: duplicates.held_syntax(_rust(s)).where("path not in ('a.rs', 'b.rs')").select("path", F.size("t").cast("long").alias("tokens")),
}

_U32 = lambda path: f"case when json_type(j, '{path}') = 'UBIGINT' then (json_extract(j, '{path}')::ubigint & 4294967295::ubigint)::bigint end"
_F64 = lambda path: f"case when json_type(j, '{path}') in ('UBIGINT', 'BIGINT', 'DOUBLE') then json_extract(j, '{path}')::double end"
_STR = lambda path: f"case when json_type(j, '{path}') = 'VARCHAR' then json_extract_string(j, '{path}') end"
_LEN = lambda path: f"case when json_type(j, '{path}') = 'ARRAY' then json_array_length(j, '{path}') else 0 end::bigint"
_J = lambda c: f"with r as ({RUNS}), p as (select *, case when json_valid(stdout) then stdout::json end as j from r where collector = '{c}')"
_WORD = r"(list_filter(string_split_regex({}, '[\t-\r \x{{85}}\p{{Z}}]+'), lambda w: regexp_full_match(w, '\+?[0-9]+') and try_cast(w as hugeint) <= 4294967295))[1]::bigint"
_M = lambda k: f"coalesce((select max(value) from m where collector || '.' || metric = '{k}'), 0)"
_S = lambda k: f"coalesce((select max(text) from m where collector = '{k}' and metric = 'status'), 'skipped')"
_T = lambda k: f"(select max(value) from e where name = '{k}')"
_L = lambda x: f"cast(cast(coalesce({x}, 0) as bigint) as varchar)"
_D = lambda x: f"cast(cast(coalesce({x}, 0) as double) as varchar)"


def _most(i: int, c: str, m: str, t: str, says: str) -> str:
    v, x = _M(f"{c}.{m}"), f"coalesce({_T(t)}, 0)"
    return f"select {i}, '{c}', '{m}', {v} > {x}, {_L(x)}, {_L(v)}, printf('{says}', {_L(v)}, {_L(x)})"


def _least(i: int, c: str, m: str, t: str, says: str) -> str:
    v, x = _M(f"{c}.{m}"), f"coalesce({_T(t)}, 0)"
    return f"select {i}, '{c}', '{m}', {v} < {x}, {_D(x)}, {_D(v)}, printf('{says}', cast({v} as double), cast({x} as double))"


def _two(i: int, c: str, a: str, b: str, ta: str, tb: str, says: str) -> str:
    va, vb, xa, xb = _M(f"{c}.{a}"), _M(f"{c}.{b}"), f"coalesce({_T(f'{c}.{ta}')}, 0)", f"coalesce({_T(f'{c}.{tb}')}, 0)"
    pair = lambda *kv: "'{' || " + " || ',' || ".join(f"""'"{k}":' || {_L(x)}""" for k, x in sorted(kv)) + " || '}'"
    return f"select {i}, '{c}', '{a} + {b}', {va} > {xa} or {vb} > {xb}, {pair((ta, xa), (tb, xb))}, {pair((a, va), (b, vb))}, printf('{says}', {_L(va)}, {_L(vb)})"


def _none(i: int, c: str, m: str, says: str, asked: str = "true", more: str = "") -> str:
    return f"select {i}, '{c}', '{m}', {asked} and {_M(f'{c}.{m}')} <> 0, '0', {_L(_M(f'{c}.{m}'))}, printf('{says}', {_L(_M(f'{c}.{m}'))}{more})"


def _gate(metrics: str, absolute: str | None) -> str:
    named = " union all ".join(f"select '{k}' as name, {f'{chr(39)}{gate.ABSOLUTE[k]}{chr(39)}' if k in gate.ABSOLUTE else 'null'} as key" for k in gate.THRESHOLDS)
    own = f"({absolute})" if absolute else "(select '' as name, 0.0 as value where false)"
    status = lambda i, c: f"select {i}, '{c}', 'status', {_S(c)} = 'fail' and coalesce({_T(f'{c}.must_pass')}, 0) <> 0, 'true', '\"fail\"', '{c} check failed'"
    some = lambda c: "(" + " or ".join(f"{_T(k)} is not null" for k in gate.THRESHOLDS if k.startswith(c)) + ")"
    line = f"case when {_M('loc.max_line_length_allowed')} > 0 then {_M('loc.max_line_length_allowed')} else greatest(coalesce({_T('loc.max_line_length')}, 0), 120) end"
    rules = [
        status(1, "fmt"), _most(2, "clippy", "warning_count", "clippy.max_warnings", "clippy warnings (%s) exceed max allowed (%s)"), _most(3, "tests", "failed", "tests.max_failures", "test failures (%s) exceed max allowed (%s)"),
        _least(4, "coverage", "line_percent", "coverage.min_line_percent", "coverage (%.1f%%) below minimum (%.1f%%)"),
        _two(5, "deny", "banned_count", "license_violations", "max_banned", "max_license_violations", "deny check failed: %s banned, %s license violations"),
        _two(6, "audit", "vulnerability_count", "critical_count", "max_vulnerabilities", "max_critical", "audit found %s vulnerabilities (%s critical), exceeds baseline"),
        status(7, "hack"), _least(8, "mutants", "mutation_score", "mutants.min_score", "mutation score (%.2f) below minimum (%.2f)"), _most(9, "duplicates", "duplicate_lines", "duplicates.max_duplicate_lines", "duplicate lines (%s) exceed maximum (%s)"),
        _none(10, "loc", "long_lines", "%s lines exceed max length (%s)", more=f", {_L(line)}"), _none(11, "size", "violations", "%s size violation(s) detected", some("size.")), _none(12, "complexity", "violations", "%s complexity violation(s) detected", some("complexity.")),
    ]
    return f"""with m as ({metrics}), b as ({THRESHOLDS}), a as {own}, n as ({named}),
        e as (select n.name, coalesce(a.value, b.value) as value, case when a.value is not null then 'absolute' when b.value is not null then 'baseline' end as source
              from n left join b on n.name = b.name left join a on n.key = a.name and a.value is not null),
        g0(ordinal, collector, metric, violation, bv, cv, msg) as ({' union all '.join(rules)}),
        g as (select ordinal::bigint as ordinal, collector, metric, case when metric <> 'status' then case when violation then 'failed' else 'passed' end
                  when collector = 'fmt' then case {_S('fmt')} when 'pass' then 'passed' when 'fail' then 'failed' else 'skipped' end
                  else case {_S('hack')} when 'pass' then 'passed' when 'fail' then 'failed' else 'skipped' end end as outcome,
              violation, case when violation then bv end as baseline_value, case when violation then cv end as current_value, case when violation then msg end as message from g0)"""


_TALLY = """select case when count(*) filter (violation) = 0 then 'pass' else 'fail' end as gate_result, count(*) filter (violation) as violations, count(*) filter (outcome in ('passed', 'failed')) as collectors_run,
    count(*) filter (outcome = 'passed') as collectors_passed, count(*) filter (outcome = 'failed') as collectors_failed, count(*) filter (outcome = 'skipped') as collectors_skipped from g"""
_LONG = f"""with {tables._LINES}, {tables._DUP.replace('f as (', 'fd as (', 1).replace('from f)', 'from fd)').replace('x as (', 'xd as (', 1).replace('from x)', 'from xd)').replace('k as (', 'kd as (', 1).replace('from k)', 'from kd)').replace('join k on ti.path = k.path', 'join kd on ti.path = kd.path')},
    one as (select {tables._SUMS}, coalesce(max(total), 0) as max_lines_per_file, coalesce(max(code), 0) as max_code_lines_per_file from g),
    two as (select coalesce(sum(end_line - start_line + 1), 0)::bigint as duplicate_lines, count(distinct path) as files_with_duplicates from m),
    ml as ({' union all '.join(f"select 'loc' as collector, '{k}' as metric, {k}::double as value, '' as text from one" for k in ('files', 'total_lines', 'code_lines', 'comment_lines', 'blank_lines', 'long_lines', 'max_line_length_found'))}
        union all select 'size', 'max_lines_per_file', max_lines_per_file::double, '' from one union all select 'size', 'max_code_lines_per_file', max_code_lines_per_file::double, '' from one
        union all select 'duplicates', 'duplicate_lines', duplicate_lines::double, '' from two union all select 'duplicates', 'files_with_duplicates', files_with_duplicates::double, '' from two)"""
_COPIES = " union all ".join(f"select '{t}' as name, '{m.split('.')[0]}' as collector, '{m.split('.')[1]}' as metric" for t, m in baseline.COPIED.items())
_MADE = "select c.name, case when c.metric = 'status' then case when x.text = 'pass' then 1.0 else 0.0 end when c.name = 'loc.max_line_length' then greatest(coalesce(x.value, 0), 120.0) else coalesce(x.value, 0) end::double as value from ({copies}) c left join {metrics} x on c.collector = x.collector and c.metric = x.metric"
_DIFF = f"""with o as ({THRESHOLDS}), x as ({METRICS['bad']}), n as ({_MADE.format(copies=_COPIES, metrics='x')})
    select coalesce(o.name, n.name) as name, o.value::double as old_value, n.value as new_value from o full join n on o.name = n.name
    where o.value is distinct from n.value and not coalesce(abs(o.value - n.value) <= 2.220446049250313e-16, false)"""
_ASSEMBLED = " union all ".join(f"select '{c}' as collector, {k} as k, '{m}' as metric" for c, ms in assembly.METRICS.items() for k, m in enumerate(ms))
_ORDER = " union all ".join(f"select {i}::bigint as ordinal, '{c}' as collector" for i, c in enumerate(S.COLLECTORS, 1))


def _golden(names: str, rows: list[tuple]) -> str:
    shown = lambda v: "null" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"{v}::bigint"
    return f"select * from (values {', '.join('(' + ', '.join(map(shown, r)) + ')' for r in rows)}) as t({names})"


ORACLES: dict[str, str] = {
    "line_kinds_fixture": f"""with {tables._LINES.replace("select 'doc/' || doc_id as path, coalesce(text, '') as content, lang, source from documents", f"select path, content, '' as lang, '' as source from ({LINES})")},
        s as (select path, string_agg(kind, ',' order by line_no) as kinds from k group by path)
        select g.path, total, blank, comment, code, coalesce(kinds, '') as kinds from g left join s on g.path = s.path""",
    "clippy_lints": f"""with r as ({RUNS}), l as (select string_split_regex(stdout, '\\r?\\n') as l from r where collector = 'clippy'), x as (select unnest(range(0, len(l)))::int as seq, unnest(l) as line from l),
        p as (select seq, case when json_valid(line) then line::json end as j from x where trim(line) <> '')
        select seq, {_STR('$.level')} as level, {_STR('$.code.code')} as code, coalesce({_STR('$.message')}, '') as message, {_STR('$.file')} as file, {_U32('$.line')} as line from p
        where j is not null and {_STR('$.level')} in ('warning', 'error') and {_STR('$.code.code')} is not null""",
    "test_totals": f"""with r as ({RUNS}), l as (select string_split(stdout || chr(10) || stderr, chr(10)) as l from r where collector = 'tests'), x as (select unnest(range(0, len(l))) as a, unnest(l) as line from l),
        y as (select a, string_split(line, ';') as ps from x where contains(line, 'test result:')), z as (select a, unnest(range(0, len(ps))) as b, unnest(ps) as part from y),
        n as (select a * 1000 + b as o, part, {_WORD.format('part')} as n from z),
        k as (select o, n, case when contains(part, 'passed') then 'passed' when contains(part, 'failed') then 'failed' when contains(part, 'ignored') then 'ignored' end as kind from n where n is not null)
        select coalesce(arg_max(n, o) filter (kind = 'passed'), 0)::bigint as passed, coalesce(arg_max(n, o) filter (kind = 'failed'), 0)::bigint as failed, coalesce(arg_max(n, o) filter (kind = 'ignored'), 0)::bigint as ignored from k""",
    "coverage_percent": f"{_J('coverage')}, q as (select coalesce({_F64('$.lines.percent')}, {_F64('$.totals.lines.percent')}) as found from p) select found, coalesce(found, 0.0)::double as line_percent from q",
    "deny_counts": f"{_J('deny')} select {_LEN('$.ban.list')} as banned_count, {_LEN('$.license.violations')} as license_violations from p",
    "audit_counts": f"""{_J('audit')} select coalesce({_U32('$.vulnerabilities.found')}, 0)::bigint as vulnerability_count,
        coalesce(len(list_filter(case when json_type(j, '$.vulnerabilities.list') = 'ARRAY' then json_extract(j, '$.vulnerabilities.list[*]') else [] end, lambda x: json_type(x, '$.severity') = 'VARCHAR' and lower(json_extract_string(x, '$.severity')) = 'critical')), 0)::bigint as critical_count from p""",
    "feature_count": f"with r as ({RUNS}) select case when contains(stderr, 'combination') then coalesce({_WORD.format('stderr')}, 0) else 0 end::bigint as feature_combinations_tested from r where collector = 'hack'",
    "mutation_score": f"{_J('mutants')}, q as (select coalesce({_U32('$.caught')}, 0) as caught, coalesce({_U32('$.missed')}, 0) as missed, j is not null as parsed from p) select case when caught + missed > 0 then caught::double / (caught + missed) else 0.0 end::double as mutation_score, caught::bigint as caught, missed::bigint as missed, parsed from q",
    "status_rollup": f"""with c as ({COUNTS}) select id, case when collector in ('tests', 'audit', 'duplicates', 'loc', 'size', 'complexity') then case when count > 0 then 'fail' else 'pass' end when exit_code is null then 'error'
        when exit_code = 0 then 'pass' when collector = 'coverage' or (collector = 'clippy' and count = 0) then 'error' else 'fail' end as status from c""",
    "metrics_long": f"{_LONG} select * from ml",
    "thresholds_effective": f"{_gate(METRICS['bad'], ABSOLUTE)} select name, value::double as value, source from e",
    "gate_rows": f"{_gate(METRICS['bad'], ABSOLUTE)} select * from g",
    "gate_violations": f"{_gate(METRICS['bad'], ABSOLUTE)} select ordinal, collector, metric, baseline_value, current_value, message from g where violation",
    "gate_summary": f"{_gate(METRICS['bad'], ABSOLUTE)} {_TALLY}",
    "gate_summary_clean": f"{_gate(METRICS['clean'], None)} {_TALLY}",
    "baseline_from_metrics": f"{_LONG} {_MADE.format(copies=_COPIES, metrics='ml')}",
    "baseline_diff": _DIFF,
    "baseline_diff_short": f"{_DIFF} and coalesce(o.name, n.name) in ('fmt.must_pass', 'clippy.max_warnings', 'tests.max_failures', 'coverage.min_line_percent')",
    "collector_assembly": f"""with r as ({RESULTS}), c as ({_ORDER}), k as ({_ASSEMBLED}), l as (select *, case when json_valid(stdout) then stdout::json end as j from r qualify row_number() over (partition by collector order by seq desc) = 1)
        select c.ordinal, c.collector, case when l.seq is null then 'skipped' when lower(l.status) in ('pass', 'fail', 'skipped', 'error') then lower(l.status) else 'error' end as status, k.metric,
            case when k.metric is null then null when k.metric in ('linePercent', 'mutationScore') then coalesce(case when json_type(j, '$.' || k.metric) in ('UBIGINT', 'BIGINT', 'DOUBLE') then json_extract(j, '$.' || k.metric)::double end, 0.0)
            else coalesce(case when json_type(j, '$.' || k.metric) = 'UBIGINT' then (json_extract(j, '$.' || k.metric)::ubigint & 4294967295::ubigint)::double end, 0.0) end::double as value
        from c left join l on c.collector = l.collector left join k on c.collector = k.collector""",
    "profile_selection": f"""with a as ({ASKED}), c as ({_ORDER}), x as (select run, case when lower(profile) in ('fast', 'full', 'deep') then lower(profile) else 'full' end as profile, list_contains(string_split(lower(disabled), ','), collector) as off, list_contains(string_split(available, ','), collector) as has, ordinal, collector from a, c),
        y as (select *, case when off then 'disabled' when (profile = 'fast' and collector not in ('fmt', 'clippy')) or (profile = 'full' and collector = 'mutants') then 'profile' when not has then 'unavailable' else 'enabled' end as reason from x)
        select run, profile, ordinal, collector, reason = 'enabled' as runs, reason from y""",
    "doctor": f"with c as ({_ORDER}), x as (select *, collector in ('fmt', 'audit') or ordinal > 8 as available from c) select *, '  ' || case when available then '✓' else '✗' end || ' ' || rpad(collector, 12, ' ') || ' ' || case when available then 'available' else 'not found' end as line from x",
    "edition_lookup": _golden("run, edition", [(1, "2024"), (2, "true"), (3, "'2015'")]).replace("::bigint", ""),
    "scannable_paths": f"""with p as ({PATHS}) select path, regexp_matches(path, '[^/]\\.rs$') and not list_has_any(string_split(path, '/'), ['target', '.git', 'quality']) as scanned, regexp_matches(path, '[^/]\\.rs$') as named,
        case when starts_with(path, '/w/') then path[4:] else path end as relative, string_split(path, '/')[-1] as base from p""",
    "scalar_functions": f"""with s as ({SCALARS}), t as (select *, to_timestamp(seconds) at time zone 'UTC' as ts, lower(name) as n from s)
        select id, {_WORD.format('words')} as number, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as iso, (year(ts) % 4 = 0 and year(ts) % 100 <> 0) or year(ts) % 400 = 0 as leap, case when n in ('fmt', 'clippy', 'loc') then n end as collector, case when n = 'deep' then n end as profile, rpad(name, 12, ' ') as padded from t""",
    "epoch_fields": """with e as (select distinct floor(epoch(ts::timestamp))::bigint as seconds from events where ts is not null), t as (select seconds, make_timestamp(seconds * 1000000) as ts from e)
        select seconds, year(ts) as year, month(ts) as month, day(ts) as day, hour(ts) as hour, minute(ts) as minute, second(ts) as second, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as iso, (year(ts) % 4 = 0 and year(ts) % 100 <> 0) or year(ts) % 400 = 0 as leap from t""",
    "rust_tokens": _golden("pos, tok, line", [(i, t, 2) for i, t in enumerate([
        "ident:fn", "ident:t", "punct:<:Joint", "punct:':Joint", "ident:a", "punct:>:Alone", "(", "ident:x", "punct:::Alone", "punct:&:Joint", "punct:':Joint", "ident:a", "ident:str", ")", "punct:-:Joint", "punct:>:Alone", "ident:char", "{",
        'literal:r#"a"b"#', "punct:;:Alone", "literal:b'\\n'", "punct:;:Alone", "literal:1", "punct:.:Joint", "punct:.:Alone", "literal:2", "punct:;:Alone", "literal:0x1F_u8", "}"])]),
    "rust_functions": _golden("path, seq, kind, name, start_line, total_lines, params", [("a.rs", 0, "function", "f", 1, 6, 2), ("b.rs", 0, "function", "empty", 9, 1, 0), ("b.rs", 1, "method", "m", 3, 2, 2), ("tokens.rs", 0, "function", "t", 2, 1, 1)]),
    "rust_complexity": _golden("path, name, cyclomatic, nesting", [("a.rs", "f", 10, 3), ("b.rs", "empty", 1, 0), ("b.rs", "m", 3, 2), ("tokens.rs", "t", 1, 0)]),
    "complexity_violations": _golden("rule_id, path, line, function, message, actual, threshold, severity", [
        ("size:max-parameters-per-function", "a.rs", 1, "f", "Function `f` has 2 parameters; maximum allowed is 1", 2, 1, "major"), ("size:max-parameters-per-function", "b.rs", 3, "m", "Function `m` has 2 parameters; maximum allowed is 1", 2, 1, "major"),
        ("complexity:max-cyclomatic-per-function", "a.rs", 1, "f", "Function `f` has cyclomatic complexity 10; maximum allowed is 3", 10, 3, "major"), ("complexity:max-nesting-depth", "a.rs", 1, "f", "Function `f` has nesting depth 3; maximum allowed is 2", 3, 2, "major")]),
    "rust_summary": _golden("functions, max_lines_per_function, max_parameters_per_function, max_cyclomatic_complexity, max_nesting_depth, complex_functions", [(4, 6, 2, 10, 3, 1)]),
    "rust_token_counts": _golden("path, tokens", [("broken.rs", 0), ("tokens.rs", 29), ("notitem.rs", 11)]),
}
