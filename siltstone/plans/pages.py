"""Queries over web pages, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.operators import markup

_COLUMNS = {"id_col": "page_id", "text_col": "html"}


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def page_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.regions(_pages(spark, sf_dir), **_COLUMNS).withColumnRenamed("id", "page_id")


def page_nesting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.nesting(_pages(spark, sf_dir), **_COLUMNS).withColumnRenamed("id", "page_id")


def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.blocks(_pages(spark, sf_dir), **_COLUMNS).withColumnRenamed("id", "page_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (page_regions, page_nesting, page_blocks)}

_RAW = r"<(?i:%s)(?:[^>A-Za-z0-9][^>]*)?(?:\z|>.*?(?:</(?i:%s)(?:[^>A-Za-z0-9][^>]*)?(?:>|\z)|\z))"
#: A page in one pass from the left: comments, raw elements, tags, text.
_TOKEN = r"(?s)<!--.*?(?:-->|\z)|" + _RAW % ("script", "script") + "|" + _RAW % ("style", "style") + r"|<[A-Za-z/!?][^>]*(?:>|\z)|[^<]+|<"
_SCAN = rf"""
    p as (select row_number() over () as r, page_id, regexp_extract_all(coalesce(html, ''), '{_TOKEN}') as ts from pages),
    k as (select r, page_id, unnest(range(1, len(ts) + 1)) as i, unnest(ts) as t from p),
    w as (select *, case when starts_with(t, '<!--') then 'comment' when regexp_matches(t, '^<(?i:script)([^A-Za-z0-9]|\z)') then 'script' when regexp_matches(t, '^<(?i:style)([^A-Za-z0-9]|\z)') then 'style'
                              when regexp_matches(t, '^<[A-Za-z/!?]') then 'tag' else 'text' end as kind, coalesce(sum(length(t)) over (partition by r order by i rows between unbounded preceding and 1 preceding), 0) as place from k),
    o as (select *, regexp_extract(t, '^<[^>]*>?') as head, case when kind in ('script', 'style') then regexp_extract(substring(t, length(regexp_extract(t, '^<[^>]*>?')) + 1), '(?s)</(?i:script|style)(?:[^>A-Za-z0-9][^>]*)?>?$') else '' end as tail from w)"""
_TAGS = (
    _SCAN
    + rf""",
    g as (select r, page_id, place, head as t from o where kind in ('tag', 'script', 'style') union all select r, page_id, place + length(t) - length(tail), tail from o where tail <> ''),
    e as (select r, page_id, place, lower(regexp_extract(t, '^</?([A-Za-z][A-Za-z0-9:-]*)', 1)) as name, not starts_with(t, '</') as opens from g where t not like '%/>'),
    f as (select * from e where name <> '' and name not in ({", ".join(f"'{v}'" for v in markup.VOID)})),
    s as (select *, sum(case when opens then 1 else -1 end) over (partition by r, name order by place rows unbounded preceding) as d from f),
    m as (select a.r, a.page_id, a.name, a.place, a.opens, (select min(b.place) from s b where a.opens and b.r = a.r and b.name = a.name and b.place > a.place and b.d < a.d) as partner from s a),
    c as (select m.*, m.opens and partner is not null or exists (select 1 from m x where x.r = m.r and x.partner = m.place) as closed from m),
    q as (select *, sum(case when not closed then 0 when opens then 1 else -1 end) over (partition by r order by place rows unbounded preceding) as depth from c)"""
)

ORACLES: dict[str, str] = {
    "page_regions": f"""with {_SCAN},
        x as (select r, page_id, kind, length(t) as chars, (kind <> 'text' or coalesce(lag(kind) over (partition by r order by i), '') <> 'text')::int as new from o where kind not in ('script', 'style')
              union all select r, page_id, 'tag', length(head), 1 from o where kind in ('script', 'style')
              union all select r, page_id, kind, length(t) - length(head) - length(tail), 1 from o where kind in ('script', 'style') and head like '%>'
              union all select r, page_id, 'tag', length(tail), 1 from o where tail <> '')
        select page_id, kind, sum(new)::bigint as pieces, sum(chars)::bigint as chars from x group by r, page_id, kind""",
    "page_nesting": f"""with {_TAGS}
        select p.page_id, coalesce(max(depth), 0)::bigint as max_depth, count(*) filter (opens) as n_elements, count(*) filter (opens and not closed) as n_unclosed, count(*) filter (not opens and not closed) as n_unopened
        from p left join q on p.r = q.r group by p.r, p.page_id""",
    "page_blocks": f"""with {_TAGS}
        select q.page_id, q.name, q.place::bigint as start, q.partner::bigint as "end", q.depth::bigint as depth from q where q.opens and q.closed""",
}
