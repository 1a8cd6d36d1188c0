"""DuckDB SQL for the queries that SQL can express on whole tables."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES: dict[str, str] = {}

_WORDS = rf"[x for x in regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') if x <> '']"

ORACLES["op1_decontamination"] = rf"""
with d as (select doc_id, {_WORDS} as w from documents),
b as (select cast(item_id as varchar) as item, {_WORDS} as w from benchmark where item_id is not null),
bw as (select distinct item, array_to_string(w[s:s + least(len(w), 8) - 1], ' ') as win, least(len(w), 8) as k
       from (select item, w, unnest(range(1, len(w) - least(len(w), 8) + 2)) as s from b where len(w) > 0)),
ks as (select distinct k from bw),
dw as (select doc_id, s, k, array_to_string(w[s:s + k - 1], ' ') as win
       from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as s from d, ks where len(w) >= k)),
hit as (select doc_id, s, k, item from dw join bw using (k, win)),
pos as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + k)) as p from hit) group by doc_id),
it as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from hit group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_items, 0) >= 2 as contaminated
from d left join pos using (doc_id) left join it using (doc_id)
"""

ORACLES["op5_exact_topk"] = """
with v as (select distinct vec_id, [cast(floor(64 * cast(x as double)) as bigint) for x in embedding] as v from embeddings
           where vec_id is not null and len(embedding) > 0 and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_dot_product(cast(q.v as double[]), cast(c.v as double[])) as bigint) as score
      from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 20 = 0)
select query_id, cast(rank as integer) as rank, vec_id, score from
  (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 20
"""

ORACLES["op8_warc_bundles"] = """
with p as (select page_id, strlen(coalesce(html, '')) as n, sha256(coalesce(html, '')) as digest from pages),
g as (select digest, min(page_id) as first from p where n >= 100 group by digest having count(*) > 1)
select page_id, cast(n as bigint) as payload_bytes, digest as payload_digest,
       case when first is not null and page_id is distinct from first then 'revisit' else 'response' end as record_type,
       case when first is not null and page_id is distinct from first then first end as refers_to
from p left join g using (digest)
"""

ORACLES["op9_jaccard_join"] = rf"""
with recursive t as (select doc_id, [x for x in regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x20\x09-\x0D]+') if x <> ''] as w
           from documents),
sh as (select distinct doc_id, array_to_string(w[i:i + k - 1], ' ') as s
       from (select doc_id, w, least(len(w), 4) as k, unnest(range(1, len(w) - least(len(w), 4) + 2)) as i from t where len(w) > 0)),
n as (select doc_id, count(*) as n from sh group by doc_id),
same as (select a.doc_id as x, b.doc_id as y, count(*) as c from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
link as (select x, y from same join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * c >= 85 * (nx.n + ny.n - c)),
edge as (select x, y from link union all select y, x from link),
reach as (select x, y from edge union select r.x, e.y from reach r join edge e on r.y = e.x)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(m.low, d.doc_id)) as component_id
from documents d left join n using (doc_id) left join (select x as doc_id, min(y) as low from reach group by x) m using (doc_id)
"""

ORACLES["op2_source_mixing"] = r"""
with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
           cast('0x' || substr(md5('17|' || coalesce(cast(doc_id as varchar), '') || '|' || coalesce(text, '')), 1, 15) as bigint) as h from documents),
s as (select source, sum(size) as n, 2.0 * sum(size) as cap, [5.0, 2.0, 1.0][cast((row_number() over (order by source nulls last) - 1) % 3 as integer) + 1] as w from d group by source),
o as (select *, coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as taken,
      sum(w) over (order by cap / w, source nulls last rows between current row and unbounded following) as rest,
      row_number() over (order by cap / w, source nulls last) as place, 1.5 * (select sum(n) from s) as budget from s),
lam as (select budget - taken as left_, rest from o where (budget - taken) * w / rest < cap order by place limit 1),
t as (select source, n, least((select left_ from lam) * w / (select rest from lam), cap) as target from s),
p as (select source, cast(n as bigint) as source_size, coalesce(target, 2.0 * n) as target, case when n > 0 then cast(floor(coalesce(target, 2.0 * n) / n) as bigint) else 0 end as passes from t),
b as (select d.source, d.h, sum(d.size) as words, p.target - p.passes * p.source_size as need from d join p on d.source is not distinct from p.source where d.size > 0 group by all),
r as (select *, sum(words) over (partition by source order by h) as through from b where need > 0),
e as (select source, case when words - (need - through + words) < need - through + words then h + 1 else h end as cut from r where through > need and through - words <= need)
select d.doc_id, d.size, p.source_size, p.target,
       d.size * (p.passes + case when d.h < coalesce(e.cut, case when p.target - p.passes * p.source_size > 0 then 1152921504606846976 else 0 end) then 1 else 0 end) as taken
from d join p on d.source is not distinct from p.source left join e on d.source is not distinct from e.source
"""

ORACLES["op10_suffix_dedup"] = """
with d as (select row_number() over () as r, doc_id, encode(coalesce(text, '')) as b from documents),
w as (select r, s, hash(b[s:s + 199]) as h, md5(hex(b[s:s + 31])) as g from (select r, b, unnest(range(1, octet_length(b) - 198)) as s from d)),
twice as (select h, g from w group by h, g having count(*) > 1),
hit as (select r, s, max(s + 200) over (partition by r order by s rows between unbounded preceding and 1 preceding) as before from w join twice using (h, g)),
run as (select r, s, sum(case when before is null or s > before then 1 else 0 end) over (partition by r order by s) as k from hit),
span as (select r, k, min(s) as low, max(s) + 200 as high from run group by r, k),
piece as (select r, low, coalesce(lag(high) over (partition by r order by low), 1) as start, low - 1 as stop from span
          union all select r, 2147483647, max(high), 2147483647 from span group by r),
kept as (select r, sha256(unhex(string_agg(hex(b[start:least(stop, octet_length(b))]), '' order by low))) as kept from piece join d using (r) group by r),
n as (select r, cast(sum(high - low) as bigint) as n_removed, count(*) as n_spans from span group by r)
select d.doc_id, cast(octet_length(b) as bigint) as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, coalesce(kept, sha256(b)) as kept_sha256
from d left join n using (r) left join kept using (r)
"""
