"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_NORM = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"
_SIZE = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _lloyd(dim: int = 64, clusters: int = 8, rounds: int = 10) -> str:
    """Lloyd rounds as so many CTEs: c0, c1, ... are the centroids, a0, a1, ... what is nearest."""
    step = lambda k: f"""
        d{k} as materialized (select v.r, c.c, list_sum(list_transform(generate_series(1, {dim}), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))::bigint as d from v, c{k} c),
        a{k} as materialized (select r, arg_min(c, (d, c)) as c, min(d) as d from d{k} group by r)"""  # noqa: E731
    move = lambda k: f"""
        s{k} as (select a.c, i, sum(v.x[i])::hugeint as s, count(*)::hugeint as n from a{k} a join v on a.r = v.r, (select unnest(generate_series(1, {dim})) as i) group by a.c, i),
        m{k} as (select c, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as x from s{k} group by c),
        c{k + 1} as materialized (select o.c, coalesce(m.x, o.x) as x from c{k} o left join m{k} m on o.c = m.c)"""  # noqa: E731
    turns = ",".join(f"{step(k)},{move(k)}" for k in range(rounds))
    return f"""
        with v as materialized (
            select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as x from embeddings
            where len(embedding) = {dim} and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
        c0 as materialized (select (row_number() over (order by sha256('3:' || coalesce(vec_id::varchar, '')), x) - 1)::int as c, x from v order by c limit {clusters}),{turns},{step(rounds)}
        select v.vec_id, a.c as cluster, a.d as distance, (sum(a.d) over (partition by a.c))::bigint as cluster_inertia, (sum(a.d) over ())::bigint as inertia, sha256(array_to_string(c.x, ',')) as centroid_sha256
        from a{rounds} a join v on a.r = v.r join c{rounds} c on a.c = c.c"""


ORACLES: dict[str, str] = {
    "op4_exact_dedup": f"""
        with n as (select doc_id, {_NORM} as t from documents)
        select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
               doc_id = min(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
        from n""",
    "op7_fair_mixing": f"""
        with r as (select doc_id, source, {_SIZE}::bigint as size, md5('mix' || coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))) as u from documents),
        s as (select source, sum(size)::bigint as source_size from r group by source),
        w as (select *, [5, 2, 1][((row_number() over (order by source asc nulls last) - 1) % 3 + 1)::int]::bigint as weight, source_size * 3 as cap from s),
        v as (select *, cap::double / weight as ratio, (select sum(source_size) from s)::bigint as total from w),
        l as (select *, (total - coalesce(sum(cap) over o, 0))::double / ((select sum(weight) from w) - coalesce(sum(weight) over o, 0))::double as level
              from v window o as (order by ratio, source asc nulls last rows between unbounded preceding and 1 preceding)),
        e as (select level from l where level <= ratio order by ratio, level limit 1),
        t as (select source, source_size, total, case when ratio <= (select level from e) then cap::double else (select level from e) * weight end as target from v),
        q as (select r.*, t.source_size, t.target, t.total, sum(size) over (partition by r.source order by u, doc_id nulls last, size rows unbounded preceding)::bigint as cum
              from r join t on r.source is not distinct from t.source),
        i as (select q.*, e.epoch, (cum + e.epoch * source_size)::double / target as finish from q, (select unnest([0, 1, 2]) as epoch) e where size > 0),
        k as (select *, sum(size) over (order by finish, source nulls last, u, doc_id nulls last, cum, epoch rows unbounded preceding) as run from i),
        g as (select doc_id, u, source, cum, sum(size)::bigint as taken from k where run <= total group by doc_id, u, source, cum)
        select q.doc_id, q.size, q.source_size, q.target, coalesce(g.taken, 0)::bigint as taken
        from q left join g on q.u = g.u and q.doc_id is not distinct from g.doc_id and q.source is not distinct from g.source and q.cum = g.cum and q.size > 0""",
    "op11_fill_in_middle": """
        with d as (select doc_id, coalesce(text, '') as t, length(coalesce(text, ''))::bigint as n, sha256('1:' || coalesce(doc_id::varchar, '')) as x from documents),
        h as (select *, ('0x' || x[1:8])::bigint as h1, ('0x' || x[9:16])::bigint as h2, ('0x' || x[17:24])::bigint as h3, ('0x' || x[25:32])::bigint as h4 from d),
        f as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
                     case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from h),
        p as (select *, substring(t, 1, a) as before, substring(t, a + 1, b - a) as middle, substring(t, b + 1) as after from f)
        select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
               sha256(case form when 'plain' then t when 'psm' then '<P>' || before || '<S>' || after || '<M>' || middle else '<S>' || after || '<P>' || before || '<M>' || middle end) as output_sha256,
               sha256(t) as restored_sha256
        from p""",
    "op12_lloyd_clusters": _lloyd(),
    "op13_decontaminate": f"""
        with i as (select coalesce(item_id::varchar, '') as item, {_WORDS} as w from benchmark),
        iw as (select distinct item, m, array_to_string(w[s + 1 : s + m], ' ') as t from (select item, w, m, unnest(range(0, len(w) - m + 1)) as s from (select *, least(len(w), 10) as m from i where len(w) > 0))),
        d as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
        dw as (select r, m, s, array_to_string(w[s + 1 : s + m], ' ') as t from (select r, w, m, unnest(range(0, len(w) - m + 1)) as s from d, (select distinct m from iw) where len(w) >= m)),
        hit as (select dw.* from dw where exists (select 1 from iw where iw.t = dw.t and iw.m = dw.m)),
        n as (select r, count(distinct p) as n_hit from (select r, unnest(range(s, s + m)) as p from hit) group by r),
        l as (select r, count(*) as n_items, sha256(array_to_string(list(item order by item), ',')) as items_sha256 from (select distinct r, item from hit join iw on iw.t = hit.t and iw.m = hit.m) group by r)
        select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, coalesce(items_sha256, sha256('')) as items_sha256, n_hit is not null as contaminated
        from d left join n on d.r = n.r left join l on d.r = l.r""",
}
