"""Queries over the operators, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import lossy
from siltstone.operators import duplicates, lines, tool_outputs
from siltstone.operators.carry import carried
from siltstone.operators.intervals import lines_in
from siltstone.operators.token_windows import measured_table, repeated_windows, token_table
from siltstone.sources.tables import written


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.files_of(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def loc_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_summary(lines.classified(_files(spark, sf_dir)))


def loc_by_source_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_summary(lines.classified(_files(spark, sf_dir)), "source", "lang")


def long_line_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.long_lines(_files(spark, sf_dir))


def long_line_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each long line by its first and its last 100 bytes."""
    each = lines.lines_of(_files(spark, sf_dir).select("path", "content")).where(F.octet_length("line") > lines.MAX_LINE)
    return each.select("path", F.col("line_no").cast("long").alias("line_no"), lossy.first_bytes(F.col("line"), 100).alias("head"), lossy.last_bytes(F.col("line"), 100).alias("tail"))


def long_line_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.classified(_files(spark, sf_dir)).where("long > 0").select("path", F.col("long").alias("long_lines"))


def file_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.classified(_files(spark, sf_dir)).select("path", F.col("total").alias("total_lines"), F.col("code").alias("code_lines"))


def size_file_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.size_violations(lines.classified(_files(spark, sf_dir)))


def size_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.size_maxima(lines.classified(_files(spark, sf_dir)))


def doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.coalesce(F.element_at("l", -1), F.lit(0)).cast("long")
    return duplicates.held_tokens(_files(spark, sf_dir)).select("path", F.size("t").cast("long").alias("tokens"), F.when(F.size("t") > 0, last).otherwise(0).cast("long").alias("last_line"), F.md5(F.array_join("t", "\x01")).alias("digest"))


def dup_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.windows(_files(spark, sf_dir)).select("path", F.col("start").cast("long").alias("start"), F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "key")


def dup_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.repeated_keys(duplicates.windows(_files(spark, sf_dir)))


def _table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table(_files(spark, sf_dir))


def _intervals(table: DataFrame) -> DataFrame:
    return duplicates.token_intervals(repeated_windows(table, size=duplicates.WINDOW, min_lines=duplicates.MIN_LINES))


def measured(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Counts of each document as a file, and its intervals of duplicate lines: both from
    one scan of the texts."""
    table = measured_table(_files(spark, sf_dir))
    return table.drop("row", "h", "l"), duplicates.line_intervals(_intervals(table))


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _intervals(_table(spark, sf_dir))


def dup_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token intervals."""
    return _spans(spark, sf_dir).select("path", *[F.col(k).cast("long").alias(k) for k in ("start", "end", "start_line", "end_line")])


def dup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.line_intervals(_spans(spark, sf_dir))


def dup_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.files(dup_lines(spark, sf_dir))


def dup_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.summary(dup_lines(spark, sf_dir))


def dup_blocks_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir)
    return duplicates.top_blocks(duplicates.blocks(_intervals(table), table), listed=10)


def dup_block_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every occurrence of a duplicate block."""
    table = _table(spark, sf_dir)
    found = duplicates.occurrences(_intervals(table), table)
    each = lines.lines_of(_files(spark, sf_dir).select("path", "content")).select("path", "line_no", F.unhex(F.md5(F.col("line").cast("binary"))).alias("digest"))
    return lines_in(found, each).select("block", "path", F.col("line_no").cast("long").alias("line_no"), F.lower(F.hex("digest")).alias("digest"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return lines.classified(turns.select(F.concat_ws("/", F.lit("conv"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("path"), F.coalesce("text", F.lit("")).alias("content")))


def turn_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).agg(F.count(F.lit(1)).alias("turns"), F.coalesce(F.max("total"), F.lit(0)).cast("long").alias("max_lines"), F.coalesce(F.max("longest"), F.lit(0)).cast("long").alias("max_bytes"))


def turn_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.size_violations(_turns(spark, sf_dir), max_lines=1, max_code=1)


def turn_context(spark: SparkSession, sf_dir: str, *, block: int = 256) -> DataFrame:
    """For each turn of an assistant the last system text and the last user text before."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    said = lambda role: F.when(F.col("role") == role, F.col("text"))
    found = carried(turns, keys=["conv_id"], block=F.floor(F.col("turn") / block), order=[F.col("turn"), F.col("role"), F.col("text")], columns={"last_system": said("system"), "last_user": said("user")})
    return found.where("role = 'assistant'").select("conv_id", "turn", "last_system", "last_user")


def tool_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What tools that count a document's lines would print, as captured runs of seven
    collectors for each document: path, collector, exit_code, stdout, stderr."""
    files = _files(spark, sf_dir).withColumn("body", F.col("content"))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    many = lambda c, item: F.array_join(F.array_repeat(F.lit(item), F.col(c).cast("int")), ",")
    numbered = F.transform(lines.split_lines(F.col("body")), lambda x, i: F.struct((i + 1).alias("line"), F.octet_length(x).alias("n")))
    long = F.filter(numbered, lambda x: x.n > lines.MAX_LINE)
    lint = lambda x: F.to_json(F.struct(F.lit("warning").alias("level"), F.struct(F.lit("long_line").alias("code")).alias("code"), text(x.n, " bytes").alias("message"), F.col("path").alias("file"), x.line.alias("line")))
    bad = F.when(F.col("long") > 0, 1).otherwise(0)
    run = lambda collector, code, out, err="": F.struct(F.lit(collector).alias("collector"), code.cast("int").alias("exit_code"), out.alias("stdout"), (F.lit(err) if isinstance(err, str) else err).alias("stderr"))
    runs = F.array(
        run("clippy", bad, F.array_join(F.concat(F.array(F.lit("checking"), F.lit("")), F.transform(long, lint), F.array(F.lit('{"level":"note"}'))), "\n")),
        run("tests", bad, text("running\ntest result: ok. 1 passed; 0 failed\n"), text("test result: done. ", F.col("code"), " passed; ", F.col("long"), " failed; ", F.col("blank"), " ignored")),
        run("coverage", F.lit(0), F.when(F.col("total") > 0, text('{"totals":{"lines":{"percent":', F.floor(100 * F.col("code") / F.col("total")), "}}}")).otherwise("no lines")),
        run("deny", bad, text('{"ban":{"list":[', many("blank", "0"), ']},"license":{"violations":[', many("long", '"x"'), "]}}")),
        run("audit", F.lit(0), text('{"vulnerabilities":{"found":', F.col("long"), ',"list":[', many("long", '{"severity":"Critical"}'), "]}}")),
        run("hack", F.lit(0), F.lit(""), text("info: checked ", F.col("total"), " combinations")),
        run("mutants", F.lit(0), text('{"caught":', F.col("code"), ',"missed":', F.col("long"), "}")),
    )
    # Written, since each parser reads the runs of its tool.
    return written(lines.classified(files).select("path", F.explode(runs).alias("r")).select("path", "r.*"), "tool-runs")


def tool_metrics_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the parsers read from the runs of each document."""
    return tool_outputs.tool_metrics(tool_runs(spark, sf_dir), ["path"])


def tool_lints_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_outputs.clippy_lints(tool_runs(spark, sf_dir), ["path"]).select("path", F.col("seq").cast("long").alias("seq"), "level", "code", "message", F.col("line").cast("long").alias("line"))


def tool_statuses_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = tool_runs(spark, sf_dir)
    return tool_outputs.statuses(runs, tool_outputs.tool_metrics(runs, ["path"]), ["path"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (loc_summary, loc_by_source_lang, long_line_details, long_line_previews, long_line_files, file_sizes, size_file_violations, size_max, doc_tokens, dup_windows, dup_keys, dup_intervals, dup_lines, dup_files, dup_blocks_top, dup_block_lines, dup_summary, turn_sizes, turn_violations, turn_context, tool_metrics_by_document, tool_lints_by_document, tool_statuses_by_document)
}

_LINES = r"""
    f as (select 'doc/' || doc_id as path, coalesce(text, '') as content, lang, source from documents),
    a as (select path, lang, source, case when content = '' then []::varchar[] else string_split_regex(regexp_replace(content, '\r?\n\z', ''), '\r?\n') end as l from f),
    x as (select path, unnest(range(1, len(l) + 1)) as line_no, unnest(l) as line from a),
    t as (select *, strlen(line) as n, regexp_replace(line, '^[\t-\r \x{85}\p{Z}]+|[\t-\r \x{85}\p{Z}]+$', '', 'g') as s from x),
    e as (select *, case when s = '' then null when s like '%*/' then false when s like '/*%' then true end as event from t),
    o as (select *, coalesce(last_value(event ignore nulls) over (partition by path order by line_no rows between unbounded preceding and 1 preceding), false) as open from e),
    k as (select *, case when s = '' then 'blank' when open or s like '//%' or s like '/*%' then 'comment' else 'code' end as kind from o),
    c as (select path, count(*) as total, count(*) filter (kind = 'blank') as blank, count(*) filter (kind = 'comment') as comment, count(*) filter (kind = 'code') as code,
                 count(*) filter (n > 100) as long, max(n) as longest from k group by path),
    g as (select a.path, lang, source, coalesce(total, 0)::bigint as total, coalesce(blank, 0)::bigint as blank, coalesce(comment, 0)::bigint as comment, coalesce(code, 0)::bigint as code,
                 coalesce(long, 0)::bigint as long, coalesce(longest, 0)::bigint as longest from a left join c on a.path = c.path)"""
_SUMS = """count(*) as files, sum(total)::bigint as total_lines, sum(code)::bigint as code_lines, sum(comment)::bigint as comment_lines, sum(blank)::bigint as blank_lines,
    sum(long)::bigint as long_lines, max(longest)::bigint as max_line_length_found, count(*) filter (long > 0) as files_with_long_lines"""
_TOKENS = r"""
    f as (select 'doc/' || doc_id as path, string_split_regex(coalesce(text, ''), '\r?\n') as l from documents),
    x as (select path, unnest(range(1, len(l) + 1)) as line, unnest(l) as s from f),
    y as (select path, line, regexp_extract_all(s, '[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\t\n\x0B\f\r ]') as ts from x),
    z as (select path, line, unnest(range(1, len(ts) + 1)) as i, unnest(ts) as t from y),
    k0 as (select path, list(t order by line, i) as ts, list(line order by line, i) as ls from z group by path)"""
_DUP = _TOKENS + r""",
    k as (select * from k0 where len(ts) >= 100),
    w0 as (select path, ts, ls, unnest(range(0, len(ts) - 99)) as start from k),
    w as (select path, start, ls[start + 1] as start_line, ls[start + 100] as end_line, md5(array_to_string(ts[start + 1 : start + 100], chr(1))) as key from w0 where ls[start + 100] - ls[start + 1] + 1 >= 6),
    d as (select key, count(*) as windows from w group by key having count(distinct path) > 1 or max(start) - min(start) >= 100),
    h0 as (select path, start, start_line, end_line from w where key in (select key from d)),
    h1 as (select *, lag(start) over (partition by path order by start) as p from h0),
    h2 as (select *, sum(case when p is null or start > p + 100 then 1 else 0 end) over (partition by path order by start rows unbounded preceding) as island from h1),
    ti as (select path, min(start) as start, max(start) + 100 as "end", min(start_line) as start_line, max(end_line) as end_line from h2 group by path, island),
    h as (select path, start_line, max(end_line) as end_line from ti group by path, start_line),
    b as (select *, max(end_line) over (partition by path order by start_line rows between unbounded preceding and 1 preceding) as e from h),
    n as (select *, sum(case when e is null or start_line > e + 1 then 1 else 0 end) over (partition by path order by start_line rows unbounded preceding) as island from b),
    m as (select path, min(start_line)::bigint as start_line, max(end_line)::bigint as end_line from n group by path, island),
    bk as (select ti.path, start, start_line, end_line, "end" - start as tokens, md5(array_to_string(ts[start + 1 : "end"], chr(1))) as key from ti join k on ti.path = k.path where end_line - start_line + 1 >= 6),
    bo as (select *, row_number() over (partition by key order by path, start) as i, count(*) over (partition by key) as c from bk),
    bl as (select key, max(case when i = c then end_line - start_line + 1 end) as lines, max(tokens) as tokens, max(c) as occurrences, max(case when i = 1 then path end) as path, max(case when i = 1 then start_line end) as start_line
           from bo group by key having max(c) >= 2)"""
_TURNS = _LINES.replace("select 'doc/' || doc_id as path, coalesce(text, '') as content, lang, source from documents", "select 'conv/' || conv_id || '/' || turn as path, coalesce(text, '') as content, '' as lang, '' as source from conversations")


#: Metrics that the tools' outputs hold: collector, metric, value.
_TOOLS = [
    ("clippy", "warning_count", "long"), ("tests", "passed", "code"), ("tests", "failed", "long"), ("tests", "ignored", "blank"), ("coverage", "line_percent", "case when total > 0 then floor(100 * code / total) else 0 end"),
    ("deny", "banned_count", "blank"), ("deny", "license_violations", "long"), ("audit", "vulnerability_count", "long"), ("audit", "critical_count", "long"), ("hack", "feature_combinations_tested", "total"),
    ("mutants", "mutation_score", "case when code + long > 0 then code::double / (code + long) else 0 end"), ("mutants", "caught", "code"), ("mutants", "missed", "long"),
]


def _over(table: str, ctes: str, lines: int, code: int) -> str:
    one = lambda rule, k, most, says: f"select path, 1::bigint as line, 'size:{rule}' as rule_id, {k} as actual, {most}::bigint as threshold, printf('{says}', {k}, {most}::bigint) as message, 'major' as severity from {table} where {k} > {most}"
    return f"with {ctes} " + one("max-lines-per-file", "total", lines, "File has %d lines; maximum allowed is %d") + " union all " + one("max-code-lines-per-file", "code", code, "File has %d code lines; maximum allowed is %d")


ORACLES: dict[str, str] = {
    "loc_summary": f"with {_LINES} select {_SUMS} from g",
    "loc_by_source_lang": f"with {_LINES} select source, lang, {_SUMS} from g group by source, lang",
    "long_line_details": f"with {_LINES} select path, line_no::bigint as line_no, n::bigint as length, 100::bigint as threshold, greatest((select count(*) from t where n > 100) - 200, 0)::bigint as omitted from t where n > 100 order by path, line_no limit 200",
    "long_line_previews": f"""with {_LINES},
        hl as (select path, line_no, line, list_max(list_filter(range(0, 101), lambda k: strlen(left(line, k::int)) <= 100)) as h, list_max(list_filter(range(0, 101), lambda k: strlen(right(line, k::int)) <= 100)) as l from t where n > 100)
        select path, line_no::bigint as line_no, left(line, h::int) || case when strlen(left(line, h::int)) < 100 then chr(65533) else '' end as head, repeat(chr(65533), (100 - strlen(right(line, l::int)))::int) || right(line, l::int) as tail from hl""",
    "long_line_files": f"with {_LINES} select path, long as long_lines from g where long > 0",
    "file_sizes": f"with {_LINES} select path, total as total_lines, code as code_lines from g",
    "size_file_violations": _over("g", _LINES, 40, 30),
    "size_max": f"with {_LINES} select count(*) as files, coalesce(max(total), 0) as max_lines_per_file, coalesce(max(code), 0) as max_code_lines_per_file from g",
    "doc_tokens": f"with {_TOKENS} select f.path, coalesce(len(ts), 0)::bigint as tokens, coalesce(ls[-1], 0)::bigint as last_line, md5(coalesce(array_to_string(ts, chr(1)), '')) as digest from f left join k0 on f.path = k0.path",
    "dup_windows": f"with {_DUP} select path, start::bigint as start, start_line::bigint as start_line, end_line::bigint as end_line, key from w",
    "dup_keys": f"with {_DUP} select key, windows from d",
    "dup_intervals": f'with {_DUP} select path, start::bigint as start, "end"::bigint as "end", start_line::bigint as start_line, end_line::bigint as end_line from ti',
    "dup_lines": f"with {_DUP} select path, start_line, end_line from m",
    "dup_files": f"with {_DUP} select path, sum(end_line - start_line + 1)::bigint as duplicate_lines from m group by path",
    "dup_blocks_top": f"with {_DUP} select path, start_line::bigint as start_line, lines::bigint as lines, tokens::bigint as tokens, occurrences, greatest((select count(*) from bl) - 10, 0)::bigint as omitted from bl order by lines desc, occurrences desc, path, start_line, key limit 10",
    "dup_block_lines": f"""with {_DUP} select b.name as block, a.path, x.line::bigint as line_no, md5(x.s) as digest from bo a join (select key, path || ':' || start as name from bo where i = 1 and c > 1) b on a.key = b.key
        join x on x.path = a.path and x.line between a.start_line and a.end_line""",
    "dup_summary": f"with {_DUP} select coalesce(sum(end_line - start_line + 1), 0)::bigint as duplicate_lines, count(distinct path) as files_with_duplicates, case when count(*) > 0 then 'fail' else 'pass' end as status from m",
    "turn_sizes": f"with {_TURNS} select count(*) as turns, coalesce(max(total), 0)::bigint as max_lines, coalesce(max(longest), 0)::bigint as max_bytes from g",
    "turn_violations": _over("g", _TURNS, 1, 1),
    "tool_metrics_by_document": f"""with {_LINES}, v as ({" union all ".join(f"select path, '{c}' as collector, '{m}' as metric, {x}::double as value from g" for c, m, x in _TOOLS)}) select * from v""",
    "tool_lints_by_document": f"with {_LINES} select path, row_number() over (partition by path order by line_no) + 1 as seq, 'warning' as level, 'long_line' as code, n || ' bytes' as message, line_no::bigint as line from t where n > 100",
    "tool_statuses_by_document": f"""with {_LINES} select path, collector, case when collector in ('clippy', 'tests', 'deny', 'audit') and long > 0 then 'fail' else 'pass' end as status
        from g, (select unnest(['clippy', 'tests', 'coverage', 'deny', 'audit', 'hack', 'mutants']) as collector)""",
    "turn_context": """with s as (select conv_id, turn, role, last_value(case when role = 'system' then coalesce(text, '') end ignore nulls) over w as last_system, last_value(case when role = 'user' then coalesce(text, '') end ignore nulls) over w as last_user
        from conversations window w as (partition by conv_id order by turn nulls first, role nulls first, coalesce(text, '') rows between unbounded preceding and 1 preceding)) select conv_id, turn, last_system, last_user from s where role = 'assistant'""",
}
