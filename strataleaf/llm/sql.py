"""SQL twins of the text problems, for DuckDB over the same tables."""

_WORDS = r"[lower(w) for w in regexp_extract_all(coalesce({0}, ''), '[\p{{L}}\p{{N}}]+')]"

P8 = f"""with d as (select doc_id, {_WORDS.format('text')} w from documents), i as (select item_id, {_WORDS.format('text')} w from eval_items),
dg as (select doc_id, array_to_string(w[k:k + 11], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 10)) k from d)),
ig as (select item_id, array_to_string(w[k:k + 11], ' ') g from (select item_id, w, unnest(range(1, len(w) - 10)) k from i))
select distinct doc_id, item_id from dg join ig using (g)"""

P9 = """with s as (select doc_id, k - 1 po, substring(text, k, 120) g from (select doc_id, text, unnest(range(1, length(text) - 118)) k from documents)),
r as (select g from s group by 1 having min(doc_id) <> max(doc_id)), x as (select distinct doc_id, po from s where g in (from r)),
n as (select doc_id, least(120, coalesce(lead(po) over (partition by doc_id order by po) - po, 120)) c from x)
select doc_id, sum(c)::bigint as shared_chars from n group by 1"""

P6 = f"""with recursive v as (select version_id, content from (select *, row_number() over (partition by version_id order by updated_at desc nulls last) rn from node_versions where version_id is not null) where rn = 1),
w as (select version_id, {_WORDS.format('content')} w from v), s as (select version_id, list_sort(list_distinct([w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] for k in range(1, len(w) - 1)])) t from w where len(w) >= 20),
k as (select md5(array_to_string(t, '|')) id, any_value(len(t)) n, any_value(t) t, list(version_id) m from s group by 1), f as (select id, n, unnest(t) g from k),
p as (select a.id a, b.id b, any_value(a.n) + any_value(b.n) u, count(*) o from f a join f b on a.g = b.g and a.id <> b.id and 10 * least(a.n, b.n) >= 7 * greatest(a.n, b.n) group by 1, 2 having 17 * count(*) >= 7 * (any_value(a.n) + any_value(b.n))),
c as (select id a, id b from k union select c.a, p.b from c join p on p.a = c.b), l as (select a, min(b) c from c group by 1),
g as (select l.c, unnest(k.m) version_id from k join l on l.a = k.id), q as (select c, min(version_id) group_id from g group by 1 having count(*) > 1)
select group_id, version_id from g join q using (c)"""

SQL = {"p6_found": P6, "p8_found": P8, "p9_found": P9}
