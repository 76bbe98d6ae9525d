"""Queries that judge each source and language of the corpus, and the same in DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import duplicates, keyed_gate, lines, ratchet
from siltstone.plans import queries as tables
from siltstone.sources import metric_documents
from siltstone.sources.tables import shared_dir, written

KEYS = ("source", "lang")
#: Checks of the corpus: ordinal, check, collector, metric, least, most, source, lang.
RULES = [
    (1, "long lines", "loc", "long_percent", None, 40.0, None, None),
    (2, "long lines", "loc", "long_percent", None, 75.0, None, "de"),
    (3, "longest line", "loc", "longest", None, 1200.0, None, None),
    (4, "code", "loc", "code_percent", 95.0, None, None, None),
    (5, "code", "loc", "code_percent", 60.0, None, "src0", None),
    (6, "file length", "size", "max_lines", None, 60.0, None, None),
    (7, "file length", "size", "max_lines", None, 400.0, "src0", None),
    (8, "file length", "size", "max_lines", None, 30.0, "src0", "en"),
    (9, "files over a limit", "size", "violations", None, 2.0, None, None),
    (10, "repeats", "duplicates", "duplicate_percent", None, 5.0, None, None),
    (11, "repeats in bulk", "duplicates", "duplicate_lines", None, 500.0, "src0", None),
]
#: Collectors that a corpus can be judged by; no rule is for the last.
COLLECTORS = ("loc", "size", "duplicates", "complexity")
RISING = ("loc.min_code_percent",)


def _percent(part: Column, whole: Column) -> Column:
    """In hundredths, rounded down, so that it is the same number everywhere."""
    return F.when(whole > 0, F.floor(10000 * part / whole) / 100)


def line_metrics(counts: DataFrame, *keys: str) -> DataFrame:
    """Metrics of files in groups, one column each, named collector.metric."""
    total = lambda c: F.sum(c).cast("double")
    over = (F.col("total") > lines.MAX_FILE_LINES).cast("long") + (F.col("code") > lines.MAX_CODE_LINES).cast("long")
    return counts.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("loc.files"), total("total").alias("loc.total_lines"), _percent(F.sum("long"), F.sum("total")).alias("loc.long_percent"), F.max("longest").cast("double").alias("loc.longest"),
        _percent(F.sum("code"), F.sum("total")).alias("loc.code_percent"), F.max("total").cast("double").alias("size.max_lines"), F.max("code").cast("double").alias("size.max_code_lines"), F.sum(over).cast("double").alias("size.violations"),
    )


def group_metrics(counts: DataFrame, repeats: DataFrame) -> DataFrame:
    """Metrics in long form of each source and language, those of repeats included."""
    own = counts.select("path", *KEYS, "total").join(duplicates.files(repeats), "path", "left")
    more = own.groupBy(*KEYS).agg(F.coalesce(F.sum("duplicate_lines"), F.lit(0)).cast("double").alias("duplicates.duplicate_lines"), _percent(F.coalesce(F.sum("duplicate_lines"), F.lit(0)), F.sum("total")).alias("duplicates.duplicate_percent"))
    return keyed_gate.unpivoted(line_metrics(counts, *KEYS), KEYS).unionByName(keyed_gate.unpivoted(more, KEYS))


def gate_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = group_metrics(*tables.measured(spark, sf_dir))
    judged = keyed_gate.checks(metrics, keyed_gate.rules(spark, RULES, KEYS), KEYS)
    return keyed_gate.outcomes(metrics, judged, COLLECTORS, KEYS)


def gate_tallies_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed_gate.tallies(gate_by_source(spark, sf_dir), KEYS)


def thresholds(metrics: DataFrame) -> DataFrame:
    """Thresholds (keys, name, value) that a group's metrics just meet. A line length is
    never below 120."""
    said = F.array(
        F.struct(F.lit("loc.max_line_length").alias("name"), F.greatest(F.col("`loc.longest`"), F.lit(120.0)).alias("value")), F.struct(F.lit("loc.min_code_percent").alias("name"), F.col("`loc.code_percent`").alias("value")),
        F.struct(F.lit("size.max_lines_per_file").alias("name"), F.col("`size.max_lines`").alias("value")), F.struct(F.lit("size.max_code_lines_per_file").alias("name"), F.col("`size.max_code_lines`").alias("value")),
    )
    return metrics.select(*KEYS, F.explode(said).alias("t")).select(*KEYS, "t.*").where("value is not null")


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Thresholds of two halves of the documents, by the parity of the CRC of their ids,
    from one scan; written, so that a run can be repeated on the same numbers."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    half = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2
    files = docs.select(F.lit("").alias("path"), F.coalesce("text", F.lit("")).alias("content"), *KEYS, half.alias("half"))
    found = written(line_metrics(lines.classified(files), *KEYS, "half"), "snapshots")
    return thresholds(found.where("half = 0")), thresholds(found.where("half = 1"))


def ratchet_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thresholds in the store after the second half has tightened those of the first,
    read back, with what happened to each."""
    first, second = snapshots(spark, sf_dir)
    store = ratchet.Store(spark, f"{shared_dir(spark).rstrip('/')}/thresholds-{uuid.uuid4().hex}", KEYS, first.schema)
    store.forget(store.update(first, RISING))
    said = store.update(second, RISING)
    same = [F.col(f"s.{k}").eqNullSafe(F.col(f"r.{k}")) for k in (*KEYS, "name")]
    both = said.alias("s").join(store.read().alias("r"), same)
    return both.select(*[F.col(f"r.{k}") for k in (*KEYS, "name")], "s.old_value", "s.new_value", "r.value", "s.change")


def metrics_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of each source, written as documents and read back."""
    metrics = keyed_gate.unpivoted(line_metrics(lines.classified(tables._files(spark, sf_dir)), "source"), ["source"])
    path = f"{shared_dir(spark).rstrip('/')}/metrics-{uuid.uuid4().hex}"
    metric_documents.write(metrics.select(F.col("source").alias("subject"), "collector", "metric", "value", F.lit(None).cast("string").alias("text")), path)
    return metric_documents.read(spark, path).select(F.col("subject").alias("source"), "collector", "metric", "value")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (gate_by_source, gate_tallies_by_source, ratchet_by_source, metrics_round_trip)}

_COUNTED = lambda by: f"""select {by}, count(*)::double as files, sum(total)::double as total_lines, case when sum(total) > 0 then floor(10000 * sum(long)::double / sum(total)) / 100 end as long_percent, max(longest)::double as longest,
    case when sum(total) > 0 then floor(10000 * sum(code)::double / sum(total)) / 100 end as code_percent, max(total)::double as max_lines, max(code)::double as max_code_lines, sum((total > {lines.MAX_FILE_LINES})::int + (code > {lines.MAX_CODE_LINES})::int)::double as violations from g group by {by}"""  # noqa: E731
_VALUE = lambda x: "null" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
_RULES = "select * from (values " + ", ".join("(" + ", ".join(map(_VALUE, r)) + ")" for r in RULES) + ") as t(ordinal, name, collector, metric, least, most, for_source, for_lang)"
_OF = {"files": "loc", "total_lines": "loc", "long_percent": "loc", "longest": "loc", "code_percent": "loc", "max_lines": "size", "max_code_lines": "size", "violations": "size"}
_DUP = tables._DUP.replace("f as (", "fd as (", 1).replace("from f)", "from fd)").replace("x as (", "xd as (", 1).replace("from x)", "from xd)").replace("k as (", "kd as (", 1).replace("from k)", "from kd)").replace("join k on ti.path = k.path", "join kd on ti.path = kd.path")
_GATE = f"""with {tables._LINES}, {_DUP}, wide as ({_COUNTED("source, lang")}),
    dl as (select path, sum(end_line - start_line + 1) as n from m group by path),
    dw as (select source, lang, coalesce(sum(n), 0)::double as lines, case when sum(total) > 0 then floor(10000 * coalesce(sum(n), 0)::double / sum(total)) / 100 end as share from g left join dl on g.path = dl.path group by source, lang),
    long_ as ({" union all ".join(f"select source, lang, '{c}' as collector, '{k}' as metric, {k} as value from wide" for k, c in _OF.items())}
        union all select source, lang, 'duplicates', 'duplicate_lines', lines from dw union all select source, lang, 'duplicates', 'duplicate_percent', share from dw),
    r as ({_RULES}),
    met as (select long_.*, r.ordinal, r.name, r.least, r.most, row_number() over (partition by source, lang, r.name order by (for_source is not null)::int + (for_lang is not null)::int desc, ordinal) as k
            from long_ join r on long_.collector = r.collector and long_.metric = r.metric and (for_source is null or for_source = source) and (for_lang is null or for_lang = lang) where value is not null),
    ok as (select *, coalesce(value >= least, true) and coalesce(value <= most, true) as ok from met where k = 1),
    rolled as (select source, lang, collector, count(*) as checks, count(*) filter (not ok) as violations, bool_and(ok) as all_ok,
                      arg_min(case when value < least then printf('%s: %.2f is below %.2f', name, value, least::double) else printf('%s: %.2f is above %.2f', name, value, most::double) end, ordinal) filter (not ok) as first_message from ok group by source, lang, collector),
    every as (select source, lang, unnest([{", ".join(f"'{c}'" for c in COLLECTORS)}]) as collector from wide),
    gated as (select e.source, e.lang, e.collector, coalesce(checks, 0)::bigint as checks, coalesce(violations, 0)::bigint as violations, case when all_ok is null then 'skipped' when all_ok then 'passed' else 'failed' end as outcome, first_message
              from every e left join rolled j on e.source is not distinct from j.source and e.lang is not distinct from j.lang and e.collector = j.collector)"""
_CRC = """
    tab as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda c, z: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
    ids as (select doc_id, coalesce(doc_id::varchar, '') as s from documents),
    crc as (select doc_id, (4294967295 - list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(s) + 1), lambda i: ascii(s[i])::bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 2 as half from ids, tab)"""
_NAMES = {"loc.max_line_length": "greatest(longest, 120)", "loc.min_code_percent": "code_percent", "size.max_lines_per_file": "max_lines", "size.max_code_lines_per_file": "max_code_lines"}

ORACLES: dict[str, str] = {
    "gate_by_source": f"{_GATE} select * from gated",
    "gate_tallies_by_source": f"""{_GATE} select source, lang, case when sum(violations) = 0 then 'pass' else 'fail' end as gate_result, sum(violations)::bigint as violations, count(*) filter (outcome in ('passed', 'failed')) as collectors_run,
        count(*) filter (outcome = 'passed') as collectors_passed, count(*) filter (outcome = 'failed') as collectors_failed, count(*) filter (outcome = 'skipped') as collectors_skipped from gated group by source, lang""",
    "metrics_round_trip": f"""with {tables._LINES}, wide as ({_COUNTED("source")}) {" union all ".join(f"select source, '{c}' as collector, '{k}' as metric, {k} as value from wide" for k, c in _OF.items())}""",
    "ratchet_by_source": f"""with {tables._LINES},{_CRC},
        halves as (select g.*, half from g join crc on g.path = 'doc/' || crc.doc_id),
        wide as ({_COUNTED("source, lang, half").replace("from g group", "from halves group")}),
        th as ({" union all ".join(f"select source, lang, half, '{n}' as name, {x}::double as value from wide" for n, x in _NAMES.items())}),
        ot as (select * from th where half = 0 and value is not null), nt as (select * from th where half = 1 and value is not null),
        b as (select coalesce(ot.source, nt.source) as source, coalesce(ot.lang, nt.lang) as lang, coalesce(ot.name, nt.name) as name, ot.value as old_value, nt.value as new_value
              from ot full join nt on ot.source is not distinct from nt.source and ot.lang is not distinct from nt.lang and ot.name = nt.name),
        v as (select *, case when name = 'loc.min_code_percent' then greatest(old_value, new_value) else least(old_value, new_value) end as value from b)
        select source, lang, name, old_value, new_value, value, case when old_value is null then 'added' when value <> old_value then 'tightened' else 'kept' end as change from v""",
}
