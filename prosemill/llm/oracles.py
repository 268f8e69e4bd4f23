"""DuckDB SQL for the results that SQL can express."""

ORACLES: dict[str, str] = {}

ORACLES["op3_poisson_mix"] = """
with recursive n as (select source, count(*) as n from documents group by source),
r as (select source, (1.0::double / (select count(*) from n)::double) * (select sum(n) from n)::double * 1.0::double / n::double as rate from n),
m as (select source, rate, cast(ceil(rate + 10 * sqrt(rate)) + 20 as integer) as most from r),
cdf as (
  select source, rate, most, 0 as k, exp(-rate) as p, exp(-rate) as c from m
  union all
  select source, rate, most, k + 1, p * rate / (k + 1)::double, c + p * rate / (k + 1)::double from cdf where k + 1 < most
),
u as (select *, cast('0x' || substr(md5('17|' || coalesce(cast(doc_id as varchar), '')), 1, 12) as bigint)::double / 281474976710656.0::double as u from documents),
k as (
  select d.doc_id, any_value(d.text) as text, any_value(d.lang) as lang, any_value(d.source) as source, any_value(d.n_chars) as n_chars, count(*) filter (where cdf.c <= d.u) as n
  from u d join cdf on d.source is not distinct from cdf.source group by d.doc_id
)
select doc_id, text, lang, source, n_chars, cast(copy as integer) as copy, cast(n as integer) as n_copies,
  md5('17|' || coalesce(cast(doc_id as varchar), '') || '|' || cast(copy as varchar)) as mix_key
from k, unnest(range(0, n)) as t(copy)
"""

ORACLES["op9_line_dedup"] = """
with p as (
  select doc_id, generate_subscripts(l, 1) as i, unnest(l) as line
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents)
),
k as (
  select doc_id, i, line, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) as key from p
),
d as (select key, min(doc_id) as first from k where length(key) >= 10 group by key having count(distinct doc_id) > 1),
j as (select k.doc_id, k.i, k.line, d.first is not null and k.doc_id > d.first as gone from k left join d on k.key = d.key)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from j group by doc_id
"""

ORACLES["op2_near_duplicates"] = """
with recursive w as (
  select doc_id, list_filter(string_split(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), 'abcdefghijklmnopqrstuvwxyz     '), ' '), lambda x: x <> '') as w
  from documents
),
s as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as shingle
  from w
),
n as (select doc_id, count(*) as n from s group by doc_id),
m as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by all),
e as (select m.a, m.b from m join n x on m.a = x.doc_id join n y on m.b = y.doc_id where 100 * shared >= 75 * (x.n + y.n - shared)),
f as (select a as u, b as v from e union all select b, a from e),
r as (select doc_id as node, doc_id as root from documents union select f.v, r.root from r join f on r.node = f.u),
c as (select node, min(root) as component_id from r group by node)
select d.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id, c.component_id = d.doc_id as kept
from documents d left join n on d.doc_id = n.doc_id join c on d.doc_id = c.node
"""

ORACLES["op6_near_vectors"] = """
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as x from embeddings
  where label is not null and embedding is not null and list_count(embedding) = len(embedding) and len(list_filter(embedding, lambda x: not isfinite(x))) = 0
),
e as (
  select a.vec_id as u, b.vec_id as v from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.x, b.x) >= 0.98
),
r as (select vec_id as node, vec_id as root from embeddings union select e.v, r.root from r join e on r.node = e.u),
c as (select node, min(root) as component_id from r group by node),
n as (select u, count(*) as n from e group by u)
select d.vec_id, coalesce(n.n, 0) as n_links, c.component_id, c.component_id = d.vec_id as kept
from embeddings d left join n on d.vec_id = n.u join c on d.vec_id = c.node
"""

ORACLES["op7_warc"] = """
with p as (select page_id, encode(coalesce(html, '')) as raw from pages),
d as (select page_id, octet_length(raw) as n, sha256(raw) as digest from p),
f as (select digest, min(page_id) as first from d where n >= 100 group by digest)
select d.page_id, d.n as payload_bytes, d.digest as payload_digest,
  case when f.first < d.page_id and d.n >= 100 then 'revisit' else 'response' end as record_type,
  case when f.first < d.page_id and d.n >= 100 then f.first end as refers_to
from d left join f on d.digest = f.digest
"""

ORACLES["op10_substring_dedup"] = """
with h as (select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
w as (select doc_id, n, h, unnest(range(0, n - 49)) as i from h where n >= 50),
k as (select doc_id, i, md5(substr(h, 2 * i + 1, 100)) as k from w),
f as (select k, min(doc_id) as first from k group by k having min(doc_id) < max(doc_id)),
g as (select k.doc_id, k.i from k join f on k.k = f.k where f.first < k.doc_id),
s as (select doc_id, i, case when i > lag(i) over (partition by doc_id order by i) + 50 or lag(i) over (partition by doc_id order by i) is null then 1 else 0 end as new from g),
r as (select doc_id, i, sum(new) over (partition by doc_id order by i rows unbounded preceding) as run from s),
p as (select doc_id, run, min(i) as a, max(i) + 50 as z from r group by doc_id, run),
q as (select doc_id, a, z, lag(z, 1, 0) over (partition by doc_id order by a) as b, row_number() over (partition by doc_id order by a desc) as last from p),
t as (
  select q.doc_id, sum(z - a) as n_removed, count(*) as n_spans,
    string_agg(substr(h.h, 2 * b + 1, 2 * (a - b)), '' order by a) || max(case when last = 1 then substr(h.h, 2 * z + 1, 2 * (h.n - z)) else '' end) as kept
  from q join h on q.doc_id = h.doc_id group by q.doc_id
)
select h.doc_id, h.n as n_bytes, cast(coalesce(t.n_removed, 0) as bigint) as n_removed, coalesce(t.n_spans, 0) as n_spans, sha256(unhex(coalesce(t.kept, h.h))) as kept_sha256
from h left join t on h.doc_id = t.doc_id
"""
