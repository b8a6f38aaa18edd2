"""SQL of the queries that SQL can express on whole tables."""

from __future__ import annotations

TEXTS: dict[str, str] = {}

TEXTS["p5_found"] = r"""
with parsed as (
  select record_id, case when json_valid(payload) then cast(payload as json) end as j from raw_relations
), named as (
  select record_id, lower(trim(k)) as field, json_extract_string(j, '$."' || k || '"') as value
  from (select record_id, j, unnest(json_keys(j)) as k from parsed where j is not null)
), records as (
  select record_id, max(value) filter (field = 'head') as h, max(value) filter (field = 'relation') as r, max(value) filter (field = 'tail') as t
  from named group by record_id
), rel as (
  select record_id as id, regexp_replace(lower(h), '[^\p{L}\p{M}\p{N}]', '', 'g') as h,
    regexp_replace(lower(r), '[^\p{L}\p{M}\p{N}]', '', 'g') as r, regexp_replace(lower(t), '[^\p{L}\p{M}\p{N}]', '', 'g') as t
  from records where h is not null and r is not null and t is not null
), rel_copies as (
  select min(id) over (partition by h, r, t) as kept_id, id as copy_id from rel
), graph as (
  select graph_id as id,
    list_sort(list_distinct(list_transform(coalesce(entities, []), lambda x: regexp_replace(lower(x), '[^\p{L}\p{M}\p{N}]', '', 'g')))) as e,
    list_sort(list_distinct(list_transform(list_filter(coalesce(relations, []), lambda x: len(x) = 3),
      lambda x: array_to_string(list_transform(x, lambda y: regexp_replace(lower(y), '[^\p{L}\p{M}\p{N}]', '', 'g')), '|')))) as r
  from baseline_kg
), graph_copies as (
  select min(id) over (partition by e, r) as kept_id, id as copy_id from graph
)
select 'relation' as kind, kept_id, copy_id from rel_copies where kept_id < copy_id
union all
select 'graph' as kind, kept_id, copy_id from graph_copies where kept_id < copy_id
"""

TEXTS["p5_counts"] = TEXTS["p5_found"].split("), rel_copies as (")[0] + r"""
), graph as (""" + TEXTS["p5_found"].split("), graph as (")[1].split("), graph_copies as (")[0] + r""")
select 'relation' as kind, min(id) as kept_id, count(*) as n from rel group by h, r, t
union all
select 'graph' as kind, min(id) as kept_id, count(*) as n from graph group by e, r
"""

TEXTS["p4_found"] = r"""
with limits as (
  select used_for, min(max_size) as max_size from size_limits where unit = 'characters' group by used_for
), val as (
  select id, kind, 'text' as field, text as v from in_plain_text
  union all
  select id, kind, 'essay_content', essay_content from in_plain_text
), core as (
  select id, field, kind,
    regexp_replace(regexp_replace(v, '^[\s\p{Z}\x{85}\x1c-\x1f]*(```)?[\s\p{Z}\x{85}\x1c-\x1f]*', ''), '[\s\p{Z}\x{85}\x1c-\x1f]*(```)?[\s\p{Z}\x{85}\x1c-\x1f]*$', '') as c
  from val where v is not null
)
select distinct id, field from core
left join limits n on n.used_for = core.kind and core.kind <> '*'
left join limits r on r.used_for = '*'
where length(c) > coalesce(n.max_size, r.max_size)
"""

TEXTS["p4_cover"] = r"""
with limits as (
  select used_for, min(max_size) as max_size, min("overlap") as shared from size_limits where unit = 'characters' group by used_for
), val as (
  select id, kind, 'text' as field, text as v from in_plain_text
  union
  select id, kind, 'essay_content', essay_content from in_plain_text
), core as (
  select id, field, kind, v, length(regexp_extract(v, '^[\s\p{Z}\x{85}\x1c-\x1f]*(```)?[\s\p{Z}\x{85}\x1c-\x1f]*')) as covered_from,
    length(v) - length(regexp_extract(v, '[\s\p{Z}\x{85}\x1c-\x1f]*(```)?[\s\p{Z}\x{85}\x1c-\x1f]*$')) as covered_to
  from val where v is not null
)
select id, field, covered_from, covered_to, coalesce(n.shared, r.shared) as least_shared, coalesce(n.shared, r.shared) as most_shared, true as kept from core
left join limits n on n.used_for = core.kind and core.kind <> '*'
left join limits r on r.used_for = '*'
where covered_to - covered_from > coalesce(n.max_size, r.max_size)
"""

TEXTS["p7_found"] = r"""
with items as (
  select item_id, lang in ('zh', 'ja') as unspaced, regexp_extract_all(lower(nfc_normalize(text)), '[\p{L}\p{N}]+') as w from benchmark where text is not null
), docs as (
  select doc_id, regexp_extract_all(lower(nfc_normalize(text)), '[\p{L}\p{N}]+') as w from documents where text is not null
), units as (
  select item_id, w, len(w) as k, least(10, len(w)) as n from items where not unspaced and len(w) > 0
), item_words as (
  select item_id, n, unnest(w) as x, generate_subscripts(w, 1) as i, k from units
), item_windows as (
  select distinct item_id, n, g from (select item_id, n, i, k, string_agg(x, ' ') over (partition by item_id order by i rows between current row and n - 1 following) as g from item_words) where i + n - 1 <= k
), doc_words as (
  select doc_id, unnest(w) as x, generate_subscripts(w, 1) as i, len(w) as k from docs
), doc_windows as (
  select n, doc_id, string_agg(x, ' ') over (partition by n, doc_id order by i rows between current row and n - 1 following) as g, i, k from doc_words, (select distinct n from item_windows)
), item_chars as (
  select item_id, array_to_string(w, '') as s, least(20, length(array_to_string(w, ''))) as n from items where unspaced and len(w) > 0
), char_windows as (
  select distinct item_id, n, substr(s, i, n) as g from (select item_id, s, n, unnest(range(1, length(s) - n + 2)) as i from item_chars)
), doc_chars as (
  select doc_id, array_to_string(w, '') as s from docs
)
select distinct item_id, doc_id from doc_windows join item_windows using (n, g) where i + n - 1 <= k
union
select distinct item_id, doc_id from char_windows join doc_chars on contains(s, g)
"""
