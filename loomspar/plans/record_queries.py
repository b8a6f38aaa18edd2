"""Queries over entity and relation records: projections, joins, merges, rollups, edit logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspar.functions import text as T
from loomspar.operators import records, resolve, schema_view
from loomspar.plans.base import NODES, RELS, Registry, current_nodes, current_rels
from loomspar.runtime import table

query = Registry()
QUERIES, SQL = query.queries, query.sql

SAFE = "trim(replace(coalesce({0}, ''), chr(10), ' '))"


def safe(x: str) -> str:
    return SAFE.replace("{0}", x)


PROPS = "json_transform(case when json_valid(node_properties) then node_properties else '[]' end, '[{\"prop_name\":\"VARCHAR\",\"prop_value\":\"VARCHAR\"}]')"


@query(f"""with {NODES} select * exclude (props), cast(len(list_filter(props, lambda p: {safe("p.prop_name")} <> '')) as int) as n_properties from (
  select entity_id, 'En_' || substr(sha256(coalesce(chunk_ids, '') || chr(1) || entity_name || chr(1) || coalesce(entity_description, '')), 1, 8) as id, {safe("entity_name")} as entity_name,
    coalesce(nullif(trim(entity_type_hint), ''), 'Other') as entity_type_hint, try_cast(trim(entity_confidence) as double) as confidence, {PROPS} as props from nodes where {safe("entity_name")} <> '')""")
def p01_clean_entities(spark: SparkSession, folder: str) -> DataFrame:
    raw = current_nodes(spark, folder).select("entity_id", F.col("chunk_ids").alias("chunk_id"), "entity_name", "entity_description", "entity_type_hint", F.col("entity_confidence").alias("confidence"), "node_properties")
    clean = records.clean_entities(raw)
    ids = raw.select("entity_id", T.content_id("En_", 8, "chunk_id", "entity_name", "entity_description").alias("id")).distinct()
    return clean.select("id", "entity_name", "entity_type_hint", "confidence", F.size("node_properties").alias("n_properties")).join(ids, "id").distinct()


@query(f"""with {NODES} select entity_id, case when {safe("entity_name")} = '' then 'no name' else 'no context' end as problem from nodes
where {safe("entity_name")} = '' or ({safe("entity_description")} = '' and {safe("entity_resolution_context")} = '' and {safe("entity_type_hint")} = '')""")
def p04_invalid_entities(spark: SparkSession, folder: str) -> DataFrame:
    unnamed = T.safe_text("entity_name") == ""
    bare = (T.safe_text("entity_description") == "") & (T.safe_text("entity_resolution_context") == "") & (T.safe_text("entity_type_hint") == "")
    return current_nodes(spark, folder).filter(unnamed | bare).select("entity_id", F.when(unnamed, "no name").otherwise("no context").alias("problem"))


@query("select entity_id, count(*) as deliveries from kg_nodes group by entity_id having count(*) > 1")
def p05_repeated_ids(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "kg_nodes").groupBy("entity_id").agg(F.count("*").alias("deliveries")).filter("deliveries > 1")


@query(f"""with {RELS}, {NODES} select relation_id, start_id = end_id as self_loop from rels where start_id in (select entity_id from nodes) and end_id in (select entity_id from nodes)""")
def p08_valid_relations(spark: SparkSession, folder: str) -> DataFrame:
    """Relations whose ends are both known, and whether they are the same."""
    known = current_nodes(spark, folder).select("entity_id")
    rels = current_rels(spark, folder)
    valid = rels.join(known.withColumnRenamed("entity_id", "start_id"), "start_id", "left_semi").join(known.withColumnRenamed("entity_id", "end_id"), "end_id", "left_semi")
    return valid.select("relation_id", (F.col("start_id") == F.col("end_id")).alias("self_loop"))


@query(f"""with {RELS}, keys as (select relation_id, unnest(list_distinct(list_concat(json_keys(cast(case when json_valid(qualifiers) then qualifiers else '{{}}' end as json)), {list(records.QUALIFIERS)}))) as k from rels)
select relation_id, count(*) as keys, string_agg(k, ',' order by k) as names from keys group by relation_id""")
def p08_default_qualifiers(spark: SparkSession, folder: str) -> DataFrame:
    rows = records.with_default_qualifiers(current_rels(spark, folder).select("relation_id", "qualifiers"))
    return rows.select("relation_id", F.size("qualifiers").cast("long").alias("keys"), F.array_join(F.array_sort(F.map_keys("qualifiers")), ",").alias("names"))


@query(f"""with {NODES}, t as (select entity_id as id, {safe("entity_name")} as name_text, {safe("entity_description")} as description_text, {safe("entity_type_hint")} as h, {safe("entity_resolution_context")} as c,
  array_to_string(list_transform(list_filter({PROPS}, lambda p: {safe("p.prop_name")} <> ''), lambda p: {safe("p.prop_name")} || ':' || {safe("p.prop_value")}), ' | ') as p from nodes)
select id, name_text, description_text, concat_ws(' ; ', case when h <> '' then '[TYPE:' || h || ']' end, nullif(c, ''), nullif(p, '')) as context_text from t""")
def p10_entity_texts(spark: SparkSession, folder: str) -> DataFrame:
    return records.entity_texts(current_nodes(spark, folder).withColumnRenamed("entity_id", "id"))


ENDS = """ends as (select r.*, coalesce(nullif(trim(s.entity_name), ''), start_id) as start_name, s.class_label as start_class, s.class_group as start_group, coalesce(nullif(trim(o.entity_name), ''), end_id) as end_name, o.class_label as end_class, o.class_group as end_group
  from rels r left join nodes s on s.entity_id = r.start_id left join nodes o on o.entity_id = r.end_id)"""


@query(f"""with {RELS}, {NODES}, {ENDS} select relation_id, substr({safe("raw_relation_name")}, 1, 256) as name_text, substr({safe("rel_desc")}, 1, 512) as description_text,
  substr({safe("start_name")} || ' (' || {safe("start_class")} || ', ' || {safe("start_group")} || ') -> ' || {safe("end_name")} || ' (' || {safe("end_class")} || ', ' || {safe("end_group")} || ')', 1, 512) as ends_text,
  substr(array_to_string(list_filter([{safe("rel_hint_type")}, {safe("canonical_rel_name")}, {safe("canonical_rel_desc")}, {safe("rel_cls")}], lambda x: x <> '' and upper(x) <> 'TBD'), ' ; '), 1, 512) as hint_text from ends""")
def p12_relation_texts(spark: SparkSession, folder: str) -> DataFrame:
    return records.relation_texts(records.with_ends(current_rels(spark, folder), current_nodes(spark, folder)))


@query(f"""with {NODES} select entity_id, concat_ws(' | ', entity_id, substr({safe("entity_name")}, 1, 120), substr({safe("entity_description")}, 1, 300), substr({safe("entity_resolution_context")}, 1, 400), substr({safe("entity_type_hint")}, 1, 80)) as line from nodes""")
def p14_member_lines(spark: SparkSession, folder: str) -> DataFrame:
    part = lambda c, n: F.substring(T.safe_text(c), 1, n)
    return current_nodes(spark, folder).select("entity_id", F.concat_ws(" | ", "entity_id", part("entity_name", 120), part("entity_description", 300), part("entity_resolution_context", 400), part("entity_type_hint", 80)).alias("line"))


@query(f"""with {RELS} select relation_id, {safe("canonical_rel_name")} as name from rels where {safe("canonical_rel_name")} <> '' and upper({safe("canonical_rel_name")}) <> 'TBD'""")
def p15_active_relations(spark: SparkSession, folder: str) -> DataFrame:
    return current_rels(spark, folder).filter(records.is_set("canonical_rel_name")).select("relation_id", T.safe_text("canonical_rel_name").alias("name"))


@query("select kind, id, label, domain, range_label from (select 'relation' as kind, pid as id, label, domain_label as domain, range_label, row_number() over (partition by label order by pid) as n from ref_relations union all select 'concept', qid, label, null, null, row_number() over (partition by label order by qid) from ref_concepts) where n = 1")
def p20_reference_labels(spark: SparkSession, folder: str) -> DataFrame:
    relations = records.keep(table(spark, folder, "ref_relations").select("label", F.col("pid").alias("id"), F.col("domain_label").alias("domain"), "range_label"), ["label"], ["id"], last=False)
    concepts = records.keep(table(spark, folder, "ref_concepts").select("label", F.col("qid").alias("id")), ["label"], ["id"], last=False)
    return relations.select(F.lit("relation").alias("kind"), "id", "label", "domain", "range_label").unionByName(concepts.select(F.lit("concept").alias("kind"), "id", "label"), allowMissingColumns=True)


@query(f"with {NODES} select entity_id, entity_name, class_label, loaded_at from nodes")
def w06_latest_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return current_nodes(spark, folder).select("entity_id", "entity_name", "class_label", "loaded_at")


@query("select essay_id, canonical_rel_name, relation_id, cast(row_number() over (partition by essay_id, canonical_rel_name order by coalesce(try_cast(confidence as double), 0) desc, seq) as int) as rank from kg_rels where essay_id is not null")
def w07_rank_candidates(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "kg_rels").filter("essay_id is not null").withColumn("score", T.to_double("confidence", 0.0))
    return records.numbered(rows, ["essay_id", "canonical_rel_name"], [F.desc("score"), "seq"]).select("essay_id", "canonical_rel_name", "relation_id", "rank")


CHUNKS = "unnest(cast(json_transform(case when json_valid(chunk_ids) then chunk_ids else '[]' end, '[\"VARCHAR\"]') as varchar[]))"


@query(f"""with {NODES}, seen as (select distinct essay_id, entity_id, {CHUNKS} as chunk_id from nodes) select essay_id, chunk_id, count(*) as entities, string_agg(entity_id, ',' order by entity_id) as ids from seen group by all having count(*) >= 2""")
def j08_entities_by_chunk(spark: SparkSession, folder: str) -> DataFrame:
    """Entities that stand in one chunk together; chunks with fewer than two are skipped."""
    seen = current_nodes(spark, folder).select("essay_id", "entity_id", F.explode(F.from_json("chunk_ids", "array<string>")).alias("chunk_id")).distinct()
    return seen.groupBy("essay_id", "chunk_id").agg(F.count("*").alias("entities"), F.array_join(F.sort_array(F.collect_list("entity_id")), ",").alias("ids")).filter("entities >= 2")


@query(f"with {NODES}, {RELS} select entity_id from nodes where not exists (select 1 from rels where start_id = entity_id) and not exists (select 1 from rels where end_id = entity_id)")
def j11_unconnected_entities(spark: SparkSession, folder: str) -> DataFrame:
    rels = current_rels(spark, folder)
    used = rels.select(F.col("start_id").alias("entity_id")).union(rels.select("end_id")).filter("entity_id is not null").distinct()
    return current_nodes(spark, folder).select("entity_id").join(used, "entity_id", "left_anti")


@query(f"""with {NODES}, {RELS}, {ENDS}, own as (select entity_id, -1 as s, nullif(trim(entity_name), '') as n, nullif(trim(class_label), '') as l from nodes
  union all select start_id, seq * 2, nullif(trim(start_name), ''), nullif(trim(start_class), '') from ends union all select end_id, seq * 2 + 1, nullif(trim(end_name), ''), nullif(trim(end_class), '') from ends),
chunk as (select entity_id, {CHUNKS} as c from nodes union select start_id, chunk_id from rels where chunk_id is not null union select end_id, chunk_id from rels where chunk_id is not null)
select o.entity_id, arg_min(n, s) filter (n is not null) as entity_name, arg_min(l, s) filter (l is not null) as class_label, coalesce(any_value(k.t), '') as chunks
from own o left join (select entity_id, string_agg(distinct c, ',' order by c) as t from chunk where c is not null group by entity_id) k on k.entity_id = o.entity_id where o.entity_id is not null group by o.entity_id""")
def j12_upsert_nodes(spark: SparkSession, folder: str) -> DataFrame:
    nodes = current_nodes(spark, folder)
    rels = records.with_ends(current_rels(spark, folder), nodes)
    listed = nodes.select("entity_id", "entity_name", "class_label", F.from_json("chunk_ids", "array<string>").alias("chunks"))
    return records.upsert_nodes(listed, rels).select("entity_id", "entity_name", "class_label", F.array_join("chunks", ",").alias("chunks"))


@query(f"with {NODES}, {RELS}, {ENDS} select relation_id, start_name, end_name, start_class, end_class from ends")
def j13_edge_names(spark: SparkSession, folder: str) -> DataFrame:
    return records.with_ends(current_rels(spark, folder), current_nodes(spark, folder)).select("relation_id", "start_name", "end_name", "start_class", "end_class")


@query(f"""with {NODES}, rows as (select lower({safe("entity_name")}) as canonical_id, entity_id, try_cast(trim(entity_confidence) as double) as c, {safe("entity_name")} as name from nodes where {safe("entity_name")} <> '')
select canonical_id, arg_min(name, entity_id) as name, max(c) as confidence, count(distinct entity_id) as merged from rows group by canonical_id""")
def a02_merge_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Entities of equal name (but for case) as one, with the highest confidence."""
    rows = current_nodes(spark, folder).filter(T.safe_text("entity_name") != "").select(
        F.lower(T.safe_text("entity_name")).alias("canonical_id"), F.col("entity_id").alias("id"), F.col("entity_id").alias("seq"), T.safe_text("entity_name").alias("name"), T.to_double("entity_confidence").alias("confidence"),
        F.from_json("node_properties", "array<struct<prop_name:string,prop_value:string,justification:string>>").alias("properties"),
    )
    return resolve.merge_entities(rows).select("canonical_id", "name", "confidence", F.size("merged_from").cast("long").alias("merged"))


@query(f"""with c as (select seq, {safe("canonical_rel_name")} as l, {safe("rel_hint_type")} as h, rel_desc as d, try_cast(trim(confidence) as double) as c, start_id from kg_rels)
select lower(l) as label_key, lower(h) as hint_key, arg_min(l, seq) as label, max(c) as confidence, arg_max(d, (coalesce(c, 0), -seq)) filter ({safe("d")} <> '') as description, count(*) as candidates, count(distinct start_id) as members from c group by all""")
def a03_merge_classes(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "kg_rels").select("seq", T.safe_text("canonical_rel_name").alias("label"), T.safe_text("rel_hint_type").alias("hint"), F.col("rel_desc").alias("description"), T.to_double("confidence").alias("confidence"), F.col("start_id").alias("member"))
    return resolve.merge_classes(rows)


@query("""select count(*) as actions, cast(sum(case when event_type in ('purchase', 'signup') then 1 else 0 end) as bigint) as structural, cast(sum(case when value is null or value < 0 then 1 else 0 end) as bigint) as errors, count(distinct user_id) as clusters, count(distinct case when event_type in ('purchase', 'signup') then user_id end) as clusters_structural from events""")
def a05_action_summary(spark: SparkSession, folder: str) -> DataFrame:
    log = table(spark, folder, "events").select(F.col("user_id").alias("cluster"), F.col("event_type").alias("action"), (F.col("value").isNull() | (F.col("value") < 0)).alias("error"))
    return resolve.action_summary(log, ("purchase", "signup"))


@query(f"""with {RELS}, r as (select relation_id, {safe("canonical_rel_name")} as name, coalesce(nullif({safe("rel_cls")}, ''), 'TBD') as cls, coalesce(nullif({safe("rel_cls_group")}, ''), 'TBD') as grp, nullif({safe("canonical_rel_desc")}, '') as d from rels where {safe("canonical_rel_name")} <> '' and upper({safe("canonical_rel_name")}) <> 'TBD')
select case when grouping(name) = 0 then 'name' when grouping(cls) = 0 then 'class' else 'group' end as level, coalesce(name, cls, grp) as label, count(*) as instances, count(distinct name) as names, min(d) as description, array_to_string(list_sort(list(relation_id))[:10], ',') as first_ids
from (select *, name as n2 from r) group by grouping sets ((name), (cls), (grp))""")
def a07_relation_rollups(spark: SparkSession, folder: str) -> DataFrame:
    """Resolved relations by canonical name, class and group in one pass; ids of the first ten as a sample for reading."""
    return schema_view.relation_rollups(current_rels(spark, folder))


@query(f"""with {RELS}, q as (select seq, start_id, end_id, {safe("canonical_rel_name")} as name, coalesce(rel_cls, '') as cls, coalesce(rel_cls_group, '') as grp, cast(case when json_valid(qualifiers) then qualifiers else '{{}}' end as json) as j from rels),
kv as (select seq, k, json_extract_string(j, '$."' || k || '"') as v from (select seq, j, unnest(json_keys(j)) as k from q)),
good as (select seq, list_sort(list(k || '=' || v)) as e from kv where v is not null and trim(v) <> '' and lower(trim(v)) <> 'null' group by seq),
full_rows as (select q.*, coalesce(e, []) as e from q left join good using (seq)),
best as (select start_id, end_id, name, cls, grp, arg_max(seq, (len(e), -seq)) as base, arg_max(e, (len(e), -seq)) as be from full_rows where name <> '' and upper(name) <> 'TBD' group by all)
select f.seq, case when b.base is not null and len(list_filter(f.e, lambda x: not list_contains(b.be, x))) = 0 then b.base else f.seq end as base_seq, coalesce(b.base is not null and len(list_filter(f.e, lambda x: not list_contains(b.be, x))) = 0 and b.base <> f.seq, false) as merged
from full_rows f left join best b on b.start_id is not distinct from f.start_id and b.end_id is not distinct from f.end_id and b.name = f.name and b.cls = f.cls and b.grp = f.grp""")
def a10_merge_duplicate_edges(spark: SparkSession, folder: str) -> DataFrame:
    rows = current_rels(spark, folder).select("seq", "start_id", "end_id", T.safe_text("canonical_rel_name").alias("name"), F.coalesce("rel_cls", F.lit("")).alias("cls"), F.coalesce("rel_cls_group", F.lit("")).alias("cls_group"), "qualifiers")
    return resolve.merge_duplicate_edges(rows)


ENTITY = f"""e as (select entity_id, coalesce(nullif({safe("class_group")}, ''), 'TBD') as grp, coalesce(nullif({safe("class_label")}, ''), 'TBD') as cls, node_properties from nodes)"""


@query(f"with {NODES}, {ENTITY} select coalesce(grp, '*') as class_group, coalesce(cls, '*') as class_label, count(*) as entities from e group by rollup (grp, cls)")
def a12_entity_tree(spark: SparkSession, folder: str) -> DataFrame:
    return schema_view.entity_tree(current_nodes(spark, folder))


@query(f"""with {RELS}, r as (select coalesce(nullif({safe("rel_cls_group")}, ''), 'TBD') as g, coalesce(nullif({safe("rel_cls")}, ''), 'TBD') as c, coalesce(nullif({safe("canonical_rel_name")}, ''), 'TBD') as n, coalesce(nullif({safe("raw_relation_name")}, ''), '<raw:N/A>') as w from rels)
select coalesce(g, '*') as rel_cls_group, coalesce(c, '*') as rel_cls, coalesce(n, '*') as name, coalesce(w, '*') as raw, count(*) as relations from r group by rollup (g, c, n, w)""")
def a13_relation_tree(spark: SparkSession, folder: str) -> DataFrame:
    return schema_view.relation_tree(current_rels(spark, folder))


@query(f"""with {RELS}, {NODES}, {ENDS}, d as (select distinct canonical_rel_name as name, {safe("raw_relation_name")} as surface from rels where {safe("canonical_rel_name")} <> '')
select name, relations, domains, ranges, n as surfaces from (select canonical_rel_name as name, count(*) as relations, count(distinct nullif({safe("start_class")}, '')) as domains, count(distinct nullif({safe("end_class")}, '')) as ranges from ends where {safe("canonical_rel_name")} <> '' group by 1)
join (select name, count(*) as n from d group by 1) using (name)""")
def a15_relations_by_name(spark: SparkSession, folder: str) -> DataFrame:
    return schema_view.relations_by_name(records.with_ends(current_rels(spark, folder), current_nodes(spark, folder)))


@query(f"""with {RELS}, {NODES}, {ENDS}, p as (select coalesce(nullif({safe("canonical_rel_name")}, ''), 'TBD') as name, coalesce(nullif({safe("start_class")}, ''), 'TBD') as d, coalesce(nullif({safe("end_class")}, ''), 'TBD') as r, coalesce(start_name, '') || ' -> ' || coalesce(end_name, '') as x from ends)
select name, string_agg(distinct d, '|' order by d) as domains, string_agg(distinct r, '|' order by r) as ranges, count(*) as relations, array_to_string(list_sort(list(distinct x))[:25], ' ; ') as examples from p group by name""")
def a16_domain_range(spark: SparkSession, folder: str) -> DataFrame:
    """Domain and range classes of each relation, with 25 example pairs for reading."""
    return schema_view.domain_range(records.with_ends(current_rels(spark, folder), current_nodes(spark, folder)))


@query(f"""with {NODES}, {ENTITY}, p as (select grp, cls, {safe("x.prop_name")} as name from (select grp, cls, unnest({PROPS}) as x from e))
select case when grouping(grp) = 1 then '*' else grp end as class_group, case when grouping(cls) = 1 then '*' else cls end as class_label, name, count(*) as n from p where name <> '' group by grouping sets ((name), (grp, cls, name))""")
def a17_data_properties(spark: SparkSession, folder: str) -> DataFrame:
    return schema_view.data_properties(current_nodes(spark, folder))


@query(f"with {RELS} select start_id, end_id, canonical_rel_name, count(*) as n from rels group by all having count(*) > 1")
def a18_duplicate_edges(spark: SparkSession, folder: str) -> DataFrame:
    return current_rels(spark, folder).groupBy("start_id", "end_id", "canonical_rel_name").agg(F.count("*").alias("n")).filter("n > 1")


@query("""select user_id, arg_max(event_type, event_id) filter (event_type is not null) as event_type, arg_max(value, event_id) filter (value is not null) as value, count(*) as edits from events group by user_id""")
def x01_last_writes(spark: SparkSession, folder: str) -> DataFrame:
    """Events as an edit log: the last value set of each field by user."""
    return resolve.last_writes(table(spark, folder, "events"), "user_id", ["event_type", "value"], "event_id")


@query("""select relation_id, arg_max(canonical_rel_name, seq) filter (canonical_rel_name is not null) as canonical_rel_name, arg_max(rel_cls, seq) filter (rel_cls is not null) as rel_cls, arg_max(rel_cls_group, seq) filter (rel_cls_group is not null) as rel_cls_group, count(*) as edits from kg_rels group by relation_id""")
def x09_relation_setters(spark: SparkSession, folder: str) -> DataFrame:
    """Deliveries of a relation as successive settings of its name, class and group."""
    return resolve.last_writes(table(spark, folder, "kg_rels"), "relation_id", ["canonical_rel_name", "rel_cls", "rel_cls_group"], "seq")


@query(f"""with {RELS}, c as (select relation_id, seq, start_id, end_id, confidence, remark, least(start_id, end_id) || chr(1) || greatest(start_id, end_id) as k, {safe("canonical_rel_name")} as n, qualifiers from rels where start_id is not null and end_id is not null),
g as (select k, n from c where n <> '' group by k, n having count(*) > 1),
m as (select c.*, row_number() over (partition by k, n order by seq) as pos from c join g using (k, n)),
kv as (select k, n, x, json_extract_string(j, '$."' || x || '"') as v from (select k, n, j, unnest(json_keys(j)) as x from (select k, n, cast(case when json_valid(qualifiers) then qualifiers else '{{}}' end as json) as j from m))),
bad as (select distinct k, n from (select k, n, x from kv where v is not null and trim(v) <> '' and lower(trim(v)) <> 'null' group by k, n, x having count(distinct v) > 1)),
ok as (select m.*, first_value(start_id) over (partition by k, n order by pos) as base from m where not exists (select 1 from bad where bad.k = m.k and bad.n = m.n))
select 'RelR_' || substr(sha256(string_agg(relation_id, ',' order by relation_id)), 1, 8) as relation_id, string_agg(relation_id, ',' order by relation_id) as merged_from, max(n) as name, max(try_cast(trim(confidence) as double)) as confidence, cast(sum(case when start_id <> base then 1 else 0 end) as bigint) as reversed from ok group by k, n""")
def x12_merge_relations(spark: SparkSession, folder: str) -> DataFrame:
    """Relations of one name between the same two ends, in either direction, merged where their qualifiers agree."""
    rows = current_rels(spark, folder).filter("start_id is not null and end_id is not null").withColumn("name", T.safe_text("canonical_rel_name")).withColumn("k", F.concat_ws("\u0001", F.least("start_id", "end_id"), F.greatest("start_id", "end_id")))
    groups = rows.filter("name <> ''").groupBy("k", "name").agg(F.sort_array(F.collect_list(F.struct("seq", "relation_id"))).alias("s"), F.count("*").alias("n")).filter("n > 1")
    merges = groups.select(F.sha2(F.concat_ws("\u0001", "k", "name"), 256).alias("merge_id"), F.lit(0).alias("seq"), F.transform("s", lambda x: x["relation_id"]).alias("ids"), "name")
    relations = rows.select("relation_id", "seq", "start_id", "end_id", "name", T.to_double("confidence").alias("confidence"), "qualifiers", "remark")
    return resolve.fold_relation_merges(relations, merges).select("relation_id", F.array_join("merged_from", ",").alias("merged_from"), "name", "confidence", "reversed")


@query(f"with {NODES} select entity_id as id, min(entity_id) over (partition by lower(trim(coalesce(entity_name, '')))) as target from nodes")
def x13_resolve_aliases(spark: SparkSession, folder: str) -> DataFrame:
    """Chains of merges (each entity into the one of equal name before it) followed to their end."""
    nodes = current_nodes(spark, folder).select(F.col("entity_id").alias("id"), F.lower(F.trim(F.coalesce("entity_name", F.lit("")))).alias("name"))
    chain = nodes.withColumn("into", F.lag("id").over(Window.partitionBy("name").orderBy("id"))).filter("into is not null").select("id", "into")
    return resolve.resolve_aliases(nodes.select("id"), chain)


@query()
def x08_class_actions(spark: SparkSession, folder: str) -> DataFrame:
    """Ordered class calls folded by essay: equal labels merged, unresolved classes renamed (no SQL: sequential); the other calls are covered by unit tests."""
    label = F.coalesce(T.first_filled("class_label"), F.lit("TBD"))
    nodes = current_nodes(spark, folder).filter("essay_id is not null")
    classes = nodes.groupBy(F.col("essay_id").alias("doc_id"), label.alias("label"), T.safe_text("class_group").alias("class_group")).agg(F.sort_array(F.collect_set("entity_id")).alias("members"), F.max(T.to_double("entity_confidence", 0.5)).alias("confidence"))
    classes = classes.withColumn("class_id", T.content_id("ClsC_", 8, "doc_id", "label", "class_group")).withColumn("description", F.lit(""))
    same = classes.groupBy("doc_id", "label").agg(F.sort_array(F.collect_list("class_id")).alias("class_ids")).filter("size(class_ids) > 1")
    merges = same.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("label")).alias("seq"), F.lit("merge_classes").alias("name"), F.to_json(F.struct("class_ids", F.col("label").alias("name"), F.col("label").alias("provisional_id"))).alias("args"))
    renamed = classes.filter("label = 'TBD'").groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    renames = renamed.select("doc_id", F.lit(1_000_000).alias("seq"), F.lit("modify_class").alias("name"), F.to_json(F.struct("class_id", F.lit("Other").alias("name"))).alias("args"))
    out = resolve.fold_class_actions(classes.select("doc_id", "class_id", "label", "description", "class_group", "confidence", "members"), merges.unionByName(renames))
    return out.select("doc_id", "class_id", "label", "class_group", F.size("members").alias("members"), "errors")


@query("""with w as (select user_id, event_id, sum(case when event_type = 'purchase' then 1 else 0 end) over (partition by user_id order by event_id) as island, event_type from events)
select u.user_id, coalesce(max(n), 0) as streak from (select distinct user_id from events) u left join (select user_id, island, count(*) as n from w where event_type <> 'purchase' or event_type is null group by all) s using (user_id) group by u.user_id""")
def w09_streaks(spark: SparkSession, folder: str) -> DataFrame:
    log = table(spark, folder, "events").select("user_id", "event_id", F.coalesce(F.col("event_type") == "purchase", F.lit(False)).alias("changed"))
    return resolve.streaks(log, "user_id", "event_id", "changed")
