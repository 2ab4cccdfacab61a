"""DuckDB texts for the queries that SQL can express; plain definitions, none of the methods."""

WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\x0C\r]+'), lambda x: x <> '')"

SUBSTRING = rf"""
with d as (select doc_id, {WORDS} as ws from documents),
w as (select doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) as h
      from (select doc_id, ws, unnest(range(1, len(ws) - 48)) as i from d)),
f as (select h, min(doc_id) as lo from w group by h),
gone as (select doc_id, unnest(range(i, i + 50)) as k from w join f using (h) where doc_id > lo),
g as (select doc_id, list(distinct k) as ks from gone group by doc_id)
select d.doc_id, len(ws)::bigint as n_words, coalesce(len(ks), 0)::bigint as n_removed,
       sha256(array_to_string(case when ks is null then ws
              else list_transform(list_filter(range(1, len(ws) + 1), lambda k: not list_contains(ks, k)), lambda k: ws[k]) end, ' ')) as kept_sha256
from d left join g using (doc_id)
"""

CONTAMINATION = r"""
with d as (select doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\pL\pN]+'), lambda x: x <> '') as w from documents),
b as (select distinct item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\pL\pN]+'), lambda x: x <> '') as w from benchmark),
i as (select item_id, w, least(5, len(w)) as k, len(w) - least(5, len(w)) + 1 as m from b where len(w) > 0),
it as (select item_id, k, m, p, array_to_string(w[p + 1:p + k], ' ') as s from (select *, unnest(range(m)) as p from i)),
ds as (select doc_id, k, p, array_to_string(w[p + 1:p + k], ' ') as s
       from (select doc_id, w, k, unnest(range(greatest(len(w) - k + 1, 0))) as p from d, (select distinct k from i))),
hit as (select distinct doc_id, item_id, k, m, ds.p - it.p as start from ds join it using (k, s)),
win as (select doc_id, item_id, start, m, s, count(*) as n from hit join ds using (doc_id, k) where ds.p >= start and ds.p < start + m group by all),
own as (select item_id, s, count(*) as n from it group by all),
size as (select doc_id, item_id, start, m, sum(n) as n from win group by all),
shared as (select doc_id, item_id, start, sum(least(win.n, own.n)) as o from win join own using (item_id, s) group by all),
sim as (select doc_id, item_id, start, o / (n + m - o) as similarity from shared join size using (doc_id, item_id, start))
select doc_id, item_id, max(similarity)::double as similarity, arg_max(start, similarity - start * 1e-12)::int as first_word
from sim where similarity >= 0.8 group by doc_id, item_id
"""


def clusters(k: int = 40, dim: int = 64, scale: int = 256, rounds: int = 5, prefix: str = "2:") -> str:
    """Lloyd rounds written out, each with all distances; whole numbers in doubles are exact at this size."""
    parts = [
        f"v as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::double))::double[{dim}] as x from embeddings "
        f"where len(embedding) = {dim} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        f"c0 as (select (row_number() over (order by sha256('{prefix}' || vec_id), x) - 1)::int as cluster, x as c from v where vec_id is not null order by cluster limit {k})",
    ]
    for n in range(rounds + 1):
        distance = "array_inner_product(x, x) - 2 * array_inner_product(x, c) + array_inner_product(c, c)"
        parts.append(f"a{n} as materialized (select r, arg_min(cluster, (d, cluster)) as cluster, min(d) as d from (select r, cluster, {distance} as d from v, c{n}) group by r)")
        if n < rounds:
            parts.append(
                f"s{n} as (select cluster, j, floor(sum(x[j]::hugeint)::double / count(*)) as m from a{n} join v using (r), unnest(range(1, {dim + 1})) as t(j) group by cluster, j)"
            )
            parts.append(
                f"c{n + 1} as materialized (select cluster, coalesce(m, c) as c from c{n} left join (select cluster, list(m order by j)::double[{dim}] as m from s{n} group by cluster) using (cluster))"
            )
    return "with " + ",\n".join(parts) + f"""
select vec_id, a{rounds}.cluster, d::bigint as distance, (sum(d) over (partition by a{rounds}.cluster))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia,
       sha256(array_to_string(list_transform(c::double[], lambda y: y::bigint::varchar), ',')) as centroid_sha256
from a{rounds} join v using (r) join c{rounds} on c{rounds}.cluster = a{rounds}.cluster
"""


SEARCH = r"""
with word as (select '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+' as p, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' as up, 'abcdefghijklmnopqrstuvwxyz' as low),
d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), up, low), p) as ts from documents, word),
b as (select row_number() over () as q, * from (select distinct item_id, text from benchmark)),
i as (select q, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), up, low), p)) as t from b, word),
asked as (select q, item_id, t, count(*) as times from i group by all),
tf as (select r, t, count(*) as tf from (select r, unnest(ts) as t from d) group by all),
s as (select count(*) as n_docs, sum(len(ts))::bigint as n_terms from d where len(ts) > 0),
df as (select t, count(*) as df from tf group by t),
w as (select t, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::bigint as w from df, s),
m as (select r, doc_id, 100 - 25 + ((25 * len(ts) * n_docs) // n_terms) as m from d, s where len(ts) > 0),
score as (select q, item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint as score
          from asked join w using (t) join tf using (t) join m using (r) group by all)
select item_id, rank::int as rank, doc_id, score
from (select *, row_number() over (partition by q order by score desc, doc_id nulls last) as rank from score where score > 0) where rank <= 20
"""
