"""Queries over records brought to fixed schemas, with lists as the operators give them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspar.functions import text as T
from loomspar.operators import chunk, cluster, metrics, normalise, records, resolve, schema_view
from loomspar.plans.base import GRAPHS, NODES, RELS, Registry, current_nodes, current_rels, graph_edges, graph_entities
from loomspar.plans.eval_queries import STRUCTURE, structure
from loomspar.plans.record_queries import ENDS, PROPS, safe
from loomspar.runtime import cut, table

query = Registry()
QUERIES, SQL = query.queries, query.sql


def joined(c: Column | str, by: str = "|") -> Column:
    return F.array_join(c, by)


def tag(name: str, x: str) -> str:
    return f"case when {x} <> '' then '[{name}:' || {x} || ']' end"


@query(f"""with {NODES} select entity_id as id, entity_name, entity_id as merged_from, entity_id || '/' || coalesce(entity_name, '') as members, len({PROPS}) as n_properties, 0 as n_history from nodes""")
def p02_fixed_entities(spark: SparkSession, folder: str) -> DataFrame:
    nodes = current_nodes(spark, folder).select(
        F.col("entity_id").alias("id"), "entity_name", "entity_description", "entity_type_hint", T.to_double("entity_confidence").alias("confidence_score"), F.col("entity_resolution_context").alias("resolution_context"),
        F.from_json("node_properties", normalise.PROPERTY).alias("node_properties"), F.lit(None).cast("array<string>").alias("merged_from"),
    )
    out = normalise.fixed_entities(nodes)
    member = F.transform("members", lambda m: F.concat(m["id"], F.lit("/"), F.coalesce(m["entity_name"], F.lit(""))))
    return out.select("id", "entity_name", joined("merged_from").alias("merged_from"), joined(member).alias("members"), F.size("node_properties").cast("long").alias("n_properties"), F.size("merge_history").alias("n_history"))


@query(f"""with {NODES}, numbered as (select *, row_number() over (order by entity_id) - 1 as seq from nodes),
own as (select seq, unnest(from_json(chunk_ids, '["VARCHAR"]')) as c from numbered)
select seq, case when entity_flag = 'resolved' then entity_id else 'Tmp_' || substr(replace(coalesce(nullif(trim(entity_name), ''), 'no_name'), ' ', '_'), 1, 40) || '_' || seq end as id,
  coalesce(nullif(trim(entity_name), ''), '') as entity_name, coalesce(nullif(trim(entity_flag), ''), 'entity_raw') as flag, coalesce((select string_agg(c, ',' order by c) from (select distinct c from own where own.seq = numbered.seq and c <> '')), '') as chunk_ids from numbered""")
def p03_class_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """Entities as input of class recognition; ids of those that aren't resolved are made, chunk ids are found inside a record at some depth."""
    nodes = current_nodes(spark, folder)
    rows = nodes.join(_numbered(nodes.select("entity_id")), "entity_id").select(
        "seq", F.when(F.col("entity_flag") == "resolved", F.col("entity_id")).alias("id"), F.lit(None).cast("string").alias("canonical_id"), "entity_name", "entity_description", "entity_type_hint", F.col("entity_resolution_context").alias("resolution_context"),
        F.lit(None).cast("string").alias("text_span"), F.col("entity_flag").alias("flag"), F.array("entity_id").alias("merged_from"),
        F.to_json(F.struct(F.struct(F.lit("chunk_id").alias("value"), F.array(F.struct(F.from_json("chunk_ids", "array<string>").alias("chunk_id"))).alias("parts")).alias("inner"))).alias("record"),
    )
    chunks = nodes.select(F.col("entity_id").alias("id"), F.explode(F.from_json("chunk_ids", "array<string>")).alias("chunk_id"))
    out = normalise.class_inputs(rows, chunks)
    return out.select("seq", "id", "entity_name", "flag", joined(F.array_sort("chunk_ids"), ",").alias("chunk_ids"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Running numbers by the only column, by ranges: each partition is numbered on its own and set off by those before it."""
    name = rows.columns[0]
    out = chunk.chunk_ids(rows.select(F.col(name).alias("section_id"), F.lit(0).alias("chunk_index")))
    return out.select(F.col("section_id").alias(name), F.substring("id", 4, 20).cast("long").alias("seq"))


@query(f"""with {RELS} select relation_id, coalesce(nullif(trim(canonical_rel_name), ''), 'TBD') as canonical_rel_name, coalesce(canonical_rel_desc, '') as canonical_rel_desc, coalesce(nullif(trim(rel_cls), ''), 'TBD') as rel_cls,
  coalesce(nullif(trim(rel_cls_group), ''), 'TBD') as rel_cls_group, concat_ws('|', nullif(justification, ''), nullif(trim(remark), '')) as remarks, coalesce(qualifiers, '{{}}') as qualifiers from rels""")
def p06_relation_defaults(spark: SparkSession, folder: str) -> DataFrame:
    """Relations with their schema fields set; the list of remarks is given the justification here."""
    rows = current_rels(spark, folder).withColumn("remarks", F.array("justification"))
    return normalise.relation_defaults(rows).withColumn("remarks", joined("remarks"))


@query(f"""with {NODES}, c as (select essay_id as group_id, {safe("class_label")} as label, list(entity_id order by entity_id) as ids from nodes where essay_id is not null group by all),
g as (select essay_id as group_id, list(entity_id) filter (try_cast(trim(entity_confidence) as double) >= 0.5) as given from nodes where essay_id is not null group by 1),
k as (select c.group_id, label, given, list_filter(ids, lambda m: list_contains(given, m)) as m from c join g using (group_id) where given is not null)
select group_id, label, array_to_string(m, ',') as members from k where label <> '' and len(m) >= case when len(given) > 1 then 2 else 1 end""")
def p07_known_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates by essay and label, of which the members with a confidence of a half were in the prompt."""
    nodes = current_nodes(spark, folder).filter("essay_id is not null")
    found = nodes.groupBy(F.col("essay_id").alias("group_id"), T.safe_text("class_label").alias("label")).agg(F.array_sort(F.collect_list("entity_id")).alias("member_ids")).withColumn("candidate", F.col("label"))
    groups = nodes.filter(T.to_double("entity_confidence") >= 0.5).groupBy(F.col("essay_id").alias("group_id")).agg(F.collect_list("entity_id").alias("ids"))
    return normalise.known_candidates(found, groups).select("group_id", "label", joined("member_ids", ",").alias("members"))


@query(f"""with {RELS} select relation_id, coalesce(nullif(trim(start_id), ''), '') as start_id, coalesce(nullif(trim(end_id), ''), '') as end_id, coalesce(nullif(trim(raw_relation_name), ''), '') as raw_relation_name,
  coalesce(nullif(trim(canonical_rel_name), ''), '') as canonical_rel_name, coalesce(nullif(trim(rel_desc), ''), '') as rel_desc, coalesce(nullif(trim(confidence), ''), '') as confidence, coalesce(nullif(trim(evidence_excerpt), ''), '') as evidence_excerpt,
  coalesce(nullif(trim(qualifiers), ''), '{{}}') as qualifiers, 17 as n_columns from rels""")
def p09_export_relations(spark: SparkSession, folder: str) -> DataFrame:
    """Relations under the names that extractors give their fields, as the 17 columns of the file."""
    raw = current_rels(spark, folder).withColumnsRenamed({"start_id": "subject_entity_id", "end_id": "object_entity_id", "raw_relation_name": "relation_name", "rel_desc": "relation_description", "evidence_excerpt": "evidence"})
    out = normalise.export_relations(raw)
    return out.select("relation_id", "start_id", "end_id", "raw_relation_name", "canonical_rel_name", "rel_desc", "confidence", "evidence_excerpt", "qualifiers", F.lit(len(out.columns)).alias("n_columns"))


@query(f"""with {NODES}, m as (select coalesce(class_id, '') as class_id, row_number() over (partition by coalesce(class_id, '') order by entity_id) - 1 as pos, {safe("entity_name")} || ' (' || {safe("entity_type_hint")} || ') - ' || substr({safe("entity_description")}, 1, 120) as line from nodes where essay_id is not null),
c as (select coalesce(class_id, '') as class_id, min({safe("class_label")}) as label, max({safe("class_group")}) as hint from nodes where essay_id is not null group by 1)
select class_id, substr(label, 1, 120) as label, substr(hint, 1, 80) as hint, substr(t, 1, 1000) as members_text from c join (select class_id, string_agg(line, ' ; ' order by pos) as t from m where pos < 112 group by 1) using (class_id)""")
def p11_class_texts(spark: SparkSession, folder: str) -> DataFrame:
    nodes = current_nodes(spark, folder).filter("essay_id is not null").withColumn("class_id", F.coalesce("class_id", F.lit("")))
    classes = nodes.groupBy("class_id").agg(F.min(T.safe_text("class_label")).alias("label"), F.max(T.safe_text("class_group")).alias("hint")).withColumns({"description": F.lit(""), "evidence": F.lit("")})
    members = records.numbered(nodes.select("class_id", "entity_id", "entity_name", "entity_type_hint", "entity_description"), ["class_id"], ["entity_id"], "n").withColumn("pos", F.col("n") - 1)
    return normalise.class_texts(classes, members).select("class_id", "label", "hint", "members_text")


@query(f"""with {NODES} select {safe("entity_id")} as entity_id, {safe("entity_name")} as name, {safe("entity_description")} as description, concat_ws(' ; ', {tag("CLASS", safe("class_label"))}, {tag("GROUP", safe("class_group"))}, {tag("PROPS", safe("node_properties"))}) as context from nodes""")
def p13_evaluation_entities(spark: SparkSession, folder: str) -> DataFrame:
    return normalise.evaluation_entity_texts(current_nodes(spark, folder))


@query(f"""with {RELS}, {NODES}, t as (select r.*, {safe("s.entity_name")} as hn, {safe("s.class_label")} as hc, {safe("o.entity_name")} as tn, {safe("o.class_label")} as tc from rels r left join nodes s on s.entity_id = r.start_id left join nodes o on o.entity_id = r.end_id)
select relation_id, coalesce(nullif({safe("canonical_rel_name")}, ''), {safe("raw_relation_name")}) as name, concat_ws(' ; ', nullif(coalesce(nullif({safe("rel_desc")}, ''), {safe("canonical_rel_desc")}), ''), nullif({safe("qualifiers")}, '')) as description,
  concat_ws(' ', {tag("H", "hn")}, {tag("HCLS", "hc")}, {tag("T", "tn")}, {tag("TCLS", "tc")}) as head_tail, concat_ws(' ; ', nullif({safe("canonical_rel_name")}, ''), nullif({safe("canonical_rel_desc")}, ''), {tag("CLS", safe("rel_cls"))}) as context from t""")
def p13_evaluation_relations(spark: SparkSession, folder: str) -> DataFrame:
    return normalise.evaluation_relation_texts(current_rels(spark, folder), current_nodes(spark, folder))


@query(f"""with {RELS} select relation_id, rel_hint_type as item_label, case when rel_cls_group in ('Equivalent', 'Narrower', 'Broader', 'Unrelated') then rel_cls_group else 'Unrelated' end as judgement, coalesce(try_cast(trim(confidence) as double), 0) as confidence,
  coalesce(nullif(trim(justification), ''), nullif(trim(remark), ''), '') as justification from (select relation_id, regexp_replace(trim(coalesce(rel_hint_type, '')), '\\s+', ' ', 'g') as rel_hint_type, case when seq % 5 = 0 then 'Narrower' when seq % 5 = 1 then 'Equivalent' else canonical_rel_name end as rel_cls_group, confidence, justification, remark from rels) where rel_hint_type <> ''""")
def p18_normalised_judgements(spark: SparkSession, folder: str) -> DataFrame:
    """A judge's answers as JSON, normalised: labels that aren't grades, confidences that aren't numbers and missing labels occur."""
    grade = F.when(F.col("seq") % 5 == 0, "Narrower").when(F.col("seq") % 5 == 1, "Equivalent").otherwise(F.col("canonical_rel_name"))
    item = F.struct(F.col("rel_hint_type").alias("item_label"), grade.alias("judgement"), "confidence", "justification", F.col("remark").alias("note"))
    answers = current_rels(spark, folder).select(F.col("relation_id").alias("key"), F.lit("asked").alias("ref_label"), F.concat(F.lit("Answer: "), F.to_json(F.struct(F.array(item).alias("items"))), F.lit(" done")).alias("answer"))
    return normalise.judgements(answers).select(F.col("key").alias("relation_id"), "item_label", "judgement", "confidence", "justification")


@query(f"""with {RELS}, {NODES}, {ENDS}, r as (select seq, {safe("canonical_rel_name")} as name, nullif(trim(raw_relation_name), '') as surface, nullif(trim(evidence_excerpt), '') as evidence, nullif(trim(start_class), '') as d, nullif(trim(end_class), '') as g, nullif(trim(start_name || ' -> ' || end_name), '') as x from ends where {safe("canonical_rel_name")} <> ''),
s as (select name, array_to_string(list(v order by q)[:25], '|') as surfaces from (select name, surface as v, min(seq) as q from r where surface is not null group by all) group by name),
e as (select name, array_to_string(list(v order by q)[:20], '|') as evidences from (select name, evidence as v, min(seq) as q from r where evidence is not null group by all) group by name),
p as (select name, array_to_string(list(v order by q)[:10], '|') as examples from (select name, x as v, min(seq) as q from r where x is not null group by all) group by name)
select name, count(*) as "count", coalesce(min(surfaces), '') as surfaces, coalesce(min(evidences), '') as evidences, coalesce(min(examples), '') as examples, coalesce(string_agg(distinct d, '|' order by d), '') as domains, coalesce(string_agg(distinct g, '|' order by g), '') as ranges
from r left join s using (name) left join e using (name) left join p using (name) group by name""")
def p19_relation_items(spark: SparkSession, folder: str) -> DataFrame:
    """Items of relations with their lists: also the whole output of the rollup by name."""
    rows = records.with_ends(current_rels(spark, folder), current_nodes(spark, folder))
    rows = rows.select("seq", T.safe_text("canonical_rel_name").alias("name"), F.col("raw_relation_name").alias("surface"), F.col("evidence_excerpt").alias("evidence"), "start_name", "end_name", "start_class", "end_class")
    lists = ("surfaces", "evidences", "examples", "domains", "ranges")
    return normalise.relation_items(rows).select("name", "count", *(joined(c).alias(c) for c in lists))


@query(f"""with {NODES} select entity_id, coalesce(nullif(trim(entity_name), ''), '') as entity_name, coalesce(nullif(trim(class_label), ''), 'TBD') as class_label, coalesce(nullif(trim(class_group), ''), 'TBD') as class_group, len({PROPS}) as n_properties from nodes""")
def s30_entity_records(spark: SparkSession, folder: str) -> DataFrame:
    """Entities under other names of their columns."""
    raw = current_nodes(spark, folder).withColumnsRenamed({"entity_id": "node_id", "entity_name": "canonical_name", "class_label": "_class_label"})
    return normalise.entity_records(raw).select("entity_id", "entity_name", "class_label", "class_group", F.size("node_properties").cast("long").alias("n_properties"))


@query(f"""with {RELS} select relation_id, start_id, end_id, coalesce(nullif(trim(canonical_rel_name), ''), nullif(trim(raw_relation_name), ''), 'TBD') as name, upper(coalesce(nullif(trim(rel_cls_group), ''), nullif(trim(rel_hint_type), ''), 'TBD')) as rel_cls_group from rels where trim(start_id) <> '' and trim(end_id) <> ''""")
def s30_relation_records(spark: SparkSession, folder: str) -> DataFrame:
    raw = current_rels(spark, folder).withColumnsRenamed({"start_id": "subject_entity_id", "end_id": "object_entity_id", "raw_relation_name": "relation_name"})
    return normalise.relation_records(raw).select("relation_id", "start_id", "end_id", F.col("canonical_rel_name").alias("name"), "rel_cls_group")


@query(f"""with {NODES}, {RELS}, m as (select essay_id as candidate, start_id as id, min(seq) as seq from rels where essay_id is not null and start_id is not null group by all)
select candidate, string_agg(id || '/' || coalesce(entity_name, ''), ',' order by m.seq, id) as members from m join nodes on entity_id = id group by candidate""")
def j06_member_objects(spark: SparkSession, folder: str) -> DataFrame:
    """Entities that relations of an essay start from, with one id that no node has, as objects in the order of the list."""
    starts = current_rels(spark, folder).filter("essay_id is not null and start_id is not null").groupBy(F.col("essay_id").alias("candidate"), "start_id").agg(F.min("seq").alias("seq"))
    lists = starts.groupBy("candidate").agg(F.concat(F.array(F.lit("none")), F.transform(F.array_sort(F.collect_list(F.struct("seq", "start_id"))), lambda x: x["start_id"])).alias("member_ids"))
    out = normalise.member_objects(lists, current_nodes(spark, folder).select(F.col("entity_id").alias("id"), "entity_name"))
    return out.select("candidate", joined(F.transform("members", lambda m: F.concat(m["id"], F.lit("/"), F.coalesce(m["entity_name"], F.lit("")))), ",").alias("members"))


@query(f"""with {NODES}, {RELS}, c as (select end_id as id, max(seq) as seq from rels where end_id is not null group by 1), l as (select c.id, r.canonical_rel_name as class_label, r.rel_desc as d from c join rels r on r.seq = c.seq)
select n.entity_id as id, coalesce(nullif(l.d, ''), n.entity_description) as entity_description, n.entity_name, l.class_label from nodes n left join l on l.id = n.entity_id""")
def j07_entities_with_class(spark: SparkSession, folder: str) -> DataFrame:
    """Entities with the class that names them last; relations stand for classes, their description is the copy that a class keeps."""
    rels = current_rels(spark, folder)
    member = F.struct(F.col("end_id").alias("id"), F.col("rel_desc").alias("entity_description"))
    classes = rels.select("seq", F.col("relation_id").alias("class_id"), F.col("canonical_rel_name").alias("class_label"), F.col("rel_cls_group").alias("class_group"), F.array(member).alias("members"))
    entities = current_nodes(spark, folder).select(F.col("entity_id").alias("id"), "entity_name", "entity_description")
    return normalise.with_class(entities, classes).select("id", "entity_name", "entity_description", "class_label")


@query(f"""with {RELS}, {NODES} select relation_id, case when seq % 3 = 0 then null when seq % 3 = 1 then 'given' else s.class_label end as subject_class_label, s.entity_name as subject_entity_name, o.class_group as object_class_group
from rels r join nodes s on s.entity_id = r.start_id join nodes o on o.entity_id = r.end_id""")
def j09_missing_ends(spark: SparkSession, folder: str) -> DataFrame:
    """Classes and names of the ends where a relation lacks the key; a class that is given stays, null too."""
    key = F.lit("subject_class_label")
    given = F.when(F.col("seq") % 3 == 0, F.create_map(key, F.lit(None).cast("string"))).when(F.col("seq") % 3 == 1, F.create_map(key, F.lit("given"))).otherwise(F.create_map().cast("map<string,string>"))
    rows = current_rels(spark, folder).select("relation_id", "start_id", "end_id", given.alias("given"))
    return normalise.with_missing_ends(rows, current_nodes(spark, folder)).select("relation_id", "subject_class_label", "subject_entity_name", "object_class_group")


@query(f"""with {RELS}, p as (select canonical_rel_name as ref_label, rel_hint_type as item_label, min(seq) as rank from rels where canonical_rel_name is not null and rel_hint_type is not null group by all),
i as (select canonical_rel_name as ref_label, rel_hint_type as item_label, arg_max(rel_cls_group, seq) as judgement from rels where canonical_rel_name is not null and rel_hint_type is not null and rel_cls_group is not null and try_cast(trim(confidence) as double) >= 0.9 group by all)
select ref_label, item_label, rank, coalesce(judgement, 'Unrelated') as judgement from p left join i using (ref_label, item_label)""")
def j20_ranked_judgements(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs with their last judgement; groups of confident relations stand for judgements."""
    rels = current_rels(spark, folder).filter("canonical_rel_name is not null and rel_hint_type is not null").withColumnsRenamed({"canonical_rel_name": "ref_label", "rel_hint_type": "item_label"})
    items = rels.filter(F.col("rel_cls_group").isNotNull() & (T.to_double("confidence") >= 0.9)).select("ref_label", "item_label", F.col("seq").alias("pos"), F.col("rel_cls_group").alias("judgement"), T.to_double("confidence").alias("confidence"))
    return normalise.ranked_judgements(rels.groupBy("ref_label", "item_label").agg(F.min("seq").alias("rank")), items).select("ref_label", "item_label", "rank", "judgement")


@query("""select label, string_agg(vec_id, ',' order by vec_id) as members, count(*) as size, cast(row_number() over (order by case when label = -1 then 1 else 0 end, label) as int) as place from (select vec_id, case when label % 10 = 3 then -1 else label end as label from embeddings) group by label""")
def a01_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Members by cluster in input order; label 3 stands for noise, which comes last. One row for each label."""
    rows = table(spark, folder, "embeddings").select("vec_id", F.when(F.col("label") % 10 == 3, -1).otherwise(F.col("label")).alias("label"))
    out = normalise.clusters(rows, "label", "vec_id", "vec_id")
    places = out.select("order").alias("o").join(out.select(F.col("order").alias("before")), F.col("before") <= F.col("order")).groupBy("order").agg(F.count("*").cast("int").alias("place"))
    return out.join(places, "order").select("label", joined(F.transform("members", lambda m: m.cast("string")), ",").alias("members"), "size", "place")


ACTIONS = ("set_canonical_rel", "set_rel_cls", "merge_relations", "modify_rel_schema", "add_rel_remark")


@query(f"""with log as (select start_id as cluster, {list(ACTIONS)}[1 + seq % 5] as action, try_cast(trim(confidence) as double) is null as error from kg_rels where start_id is not null)
select cluster, count(*) as actions, cast(sum(case when action in ('set_canonical_rel', 'set_rel_cls', 'modify_rel_schema') then 1 else 0 end) as bigint) as schema_actions, cast(sum(case when action = 'merge_relations' then 1 else 0 end) as bigint) as merges, cast(sum(case when error then 1 else 0 end) as bigint) as errors from log group by cluster""")
def a06_relation_actions(spark: SparkSession, folder: str) -> DataFrame:
    action = F.get(F.array(*map(F.lit, ACTIONS)), (F.col("seq") % 5).cast("int"))
    log = table(spark, folder, "kg_rels").filter("start_id is not null").select(F.col("start_id").alias("cluster"), action.alias("action"), T.to_double("confidence").isNull().alias("error"))
    return normalise.relation_action_summary(log)


@query(f"""with {NODES}, t as (select coalesce(class_group, '') as g, coalesce(class_label, '') as c, count(*) as n from nodes group by all) select g as class_group, c as class_label, n, row_number() over (order by n desc, lower(g), lower(c), g, c) as place from t""")
def o06_sorted_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Classes in the order of reports; places by comparing the counts, of which there is one for each class."""
    rows = current_nodes(spark, folder).select(F.coalesce("class_group", F.lit("")).alias("class_group"), F.coalesce("class_label", F.lit("")).alias("class_label"))
    tree = normalise.counted_tree(rows, ["class_group", "class_label"]).withColumn("by", F.struct("sort_key", "class_group", "class_label"))
    places = tree.select("by").join(tree.select(F.col("by").alias("before")), F.col("before") <= F.col("by")).groupBy("by").agg(F.count("*").alias("place"))
    return tree.join(places, "by").select("class_group", "class_label", "n", "place")


@query("""select seq, case seq % 4 when 0 then coalesce(rel_desc, '') when 1 then coalesce(rel_desc, '') when 2 then coalesce(rel_desc, '') || chr(10) || coalesce(raw_relation_name, '') else 'plain ' || coalesce(rel_desc, '') end as text from kg_rels""")
def f14_answer_text(spark: SparkSession, folder: str) -> DataFrame:
    """Answers in four shapes: an object, a JSON string, a list of parts, plain text."""
    desc, name = F.coalesce("rel_desc", F.lit("")), F.coalesce("raw_relation_name", F.lit(""))
    string = F.substring(F.to_json(F.array(desc)), 2, 1 << 20)
    shapes = [F.to_json(F.struct(F.lit(1).alias("n"), desc.alias("content"))), F.substring(string, F.lit(1), F.length(string) - 1), F.to_json(F.array(F.struct(desc.alias("text")), F.struct(name.alias("text")))), F.concat(F.lit("plain "), desc)]
    answer = F.coalesce(*(F.when(F.col("seq") % 4 == n, s) for n, s in enumerate(shapes)))
    return table(spark, folder, "kg_rels").select("seq", answer.alias("a")).select("seq", normalise.answer_text("a").alias("text"))


@query(f"""with {NODES} select entity_id, 'top,' || from_json(chunk_ids, '["VARCHAR"]')[1] as found, 1 + len(list_distinct(from_json(chunk_ids, '["VARCHAR"]'))) as n from nodes where json_valid(chunk_ids) and len(from_json(chunk_ids, '["VARCHAR"]')) = 1""")
def f17_nested_values(spark: SparkSession, folder: str) -> DataFrame:
    """Values of a key at two depths of a record, beside a value that looks like the key; records of one chunk."""
    ids = F.from_json("chunk_ids", "array<string>")
    record = F.to_json(F.struct(F.lit("top").alias("chunk_id"), F.lit('"chunk_id": "no"').alias("note"), F.array(F.struct(F.lit("chunk_id").alias("name"), ids.alias("chunk_id"))).alias("members")))
    found = normalise.nested_values(record, "chunk_id")
    return current_nodes(spark, folder).filter(F.size(ids) == 1).select("entity_id", found.alias("f")).select("entity_id", joined("f", ",").alias("found"), F.size("f").cast("long").alias("n"))


@query("""select seq, least(x * 5, 1.0) as clustering_shown, 1 - x as no_leakage, abs(x - 1) as compression_gap, x * 100 as composite_percent from (select seq, try_cast(trim(confidence) as double) as x from kg_rels) where x is not null""")
def f30_figure_scalars(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "kg_rels").select("seq", T.to_double("confidence").alias("x")).filter("x is not null").select("seq", *(F.col("x").alias(c) for c in ("clustering", "leakage", "compression", "composite")))
    return normalise.figure_scalars(rows).select("seq", "clustering_shown", "no_leakage", "compression_gap", "composite_percent")


@query(f"with {NODES} select entity_id as id, coalesce(nullif(trim(entity_name), ''), entity_id) as text from nodes")
def v05_name_texts(spark: SparkSession, folder: str) -> DataFrame:
    return normalise.name_texts(current_nodes(spark, folder).withColumnRenamed("entity_id", "id"))


@query(f"""with {RELS}, calls as (select seq, relation_id, canonical_rel_name as name, rel_cls as cls, remark from kg_rels where relation_id is not null),
f as (select relation_id, arg_max(trim(name), seq) filter ({safe("name")} <> '') as name, arg_max(trim(cls), seq) filter ({safe("cls")} <> '') as cls, coalesce(string_agg(trim(remark), '|' order by seq) filter ({safe("remark")} <> ''), '') as remarks from calls group by 1)
select relation_id, coalesce(f.name, r.raw_relation_name) as name, coalesce(f.cls, r.rel_hint_type) as cls, case when f.name is not null and f.name <> r.raw_relation_name then r.raw_relation_name end as original_name, f.remarks from rels r join f using (relation_id)""")
def x10_schema_edits(spark: SparkSession, folder: str) -> DataFrame:
    """Each delivery of a relation as calls that name it and add a remark, folded in load order."""
    rows = table(spark, folder, "kg_rels").filter("relation_id is not null")
    edits = rows.select("seq", "relation_id", F.lit("modify_rel_schema").alias("function"), F.col("canonical_rel_name").alias("name"), F.col("rel_cls").alias("cls"), F.lit(None).cast("string").alias("cls_group"), F.lit(None).cast("string").alias("remark"))
    remarks = rows.select("seq", "relation_id", F.lit("add_rel_remark").alias("function"), *(F.lit(None).cast("string").alias(c) for c in ("name", "cls", "cls_group")), "remark")
    base = current_rels(spark, folder).select("relation_id", F.col("raw_relation_name").alias("name"), F.col("rel_hint_type").alias("cls"), "rel_cls_group", F.array().cast("array<string>").alias("remarks")).withColumnRenamed("rel_cls_group", "cls_group")
    return normalise.schema_edits(base, edits.unionByName(remarks)).select("relation_id", "name", "cls", "original_name", joined("remarks").alias("remarks"))


@query(f"""with {GRAPHS}, t as (select graph_id, source, relation, target, min(pos) as pos from edges0 group by all), v as (select distinct graph_id, lower(x) as x from (select graph_id, unnest(entities) as x from baseline_kg) where x is not null union select graph_id, source from t where source is not null union select graph_id, target from t where target is not null)
select graph_id, (select string_agg(x, '|' order by x) from v where v.graph_id = g.graph_id) as entities, string_agg(coalesce(source, '') || '>' || coalesce(relation, '') || '>' || coalesce(target, ''), '|' order by pos) as relations, string_agg(distinct relation, '|' order by relation) as edges from t g group by graph_id""")
def p23_graph_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Triples as a graph's lists: entities and relation names in order of the alphabet, triples once each in their order."""
    triples = graph_edges(spark, folder).groupBy("graph_id", "source", "relation", "target").agg(F.min("seq").alias("seq"))
    names = graph_entities(spark, folder).filter("node is not null").unionByName(triples.select("graph_id", F.explode(F.array_compact(F.array("source", "target"))).alias("node"))).distinct()
    line = F.concat_ws(">", *(F.coalesce(c, F.lit("")) for c in ("source", "relation", "target")))
    lists = triples.groupBy("graph_id").agg(joined(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("l")))), lambda x: x["l"])).alias("relations"), joined(F.array_sort(F.collect_set("relation"))).alias("edges"))
    return lists.join(names.groupBy("graph_id").agg(joined(F.array_sort(F.collect_list("node"))).alias("entities")), "graph_id", "left").select("graph_id", "entities", "relations", "edges")


@query(f"""with {NODES}, rows as (select lower({safe("entity_name")}) as canonical_id, entity_id, {PROPS} as p from nodes where {safe("entity_name")} <> ''),
props as (select canonical_id, x.prop_name as k, x.prop_value as v, min((entity_id, i)) as first from (select canonical_id, entity_id, unnest(p) as x, generate_subscripts(p, 1) as i from rows) group by all)
select canonical_id, string_agg(distinct entity_id, ',' order by entity_id) as merged_from, coalesce((select string_agg(k || '=' || coalesce(v, ''), '|' order by first) from props where props.canonical_id = rows.canonical_id), '') as properties from rows group by canonical_id""")
def a02_merged_entities(spark: SparkSession, folder: str) -> DataFrame:
    """What entities of equal name were merged from, and their properties, each once."""
    rows = current_nodes(spark, folder).filter(T.safe_text("entity_name") != "").select(
        F.lower(T.safe_text("entity_name")).alias("canonical_id"), F.col("entity_id").alias("id"), F.col("entity_id").alias("seq"), T.safe_text("entity_name").alias("name"), T.to_double("entity_confidence").alias("confidence"), F.from_json("node_properties", normalise.PROPERTY).alias("properties")
    )
    shown = F.transform("properties", lambda p: F.concat(p["prop_name"], F.lit("="), F.coalesce(p["prop_value"], F.lit(""))))
    return resolve.merge_entities(rows).select("canonical_id", joined("merged_from", ",").alias("merged_from"), F.coalesce(joined(shown), F.lit("")).alias("properties"))


@query(f"""with {NODES}, e as (select coalesce(nullif({safe("class_group")}, ''), 'TBD') as class_group, coalesce(nullif({safe("class_label")}, ''), 'TBD') as class_label, entity_id, coalesce(entity_name, '') as n from nodes)
select class_group, class_label, count(*) as entities, string_agg(entity_id || '/' || n, ',' order by entity_id) as members from e group by all""")
def a12_entity_lists(spark: SparkSession, folder: str) -> DataFrame:
    """The tree of entities with ids and names."""
    rows = current_nodes(spark, folder).select(schema_view.filled("class_group").alias("class_group"), schema_view.filled("class_label").alias("class_label"), F.struct("entity_id", F.coalesce("entity_name", F.lit("")).alias("n")).alias("e"))
    each = rows.groupBy("class_group", "class_label").agg(F.count("*").alias("entities"), F.array_sort(F.collect_list("e")).alias("m"))
    return each.select("class_group", "class_label", "entities", joined(F.transform("m", lambda x: F.concat(x["entity_id"], F.lit("/"), x["n"])), ",").alias("members"))


@query(f"""with c as (select seq, lower({safe("canonical_rel_name")}) as label_key, lower({safe("rel_hint_type")}) as hint_key, start_id from kg_rels where start_id is not null)
select label_key, hint_key, string_agg(start_id, ',' order by first, start_id) as members from (select label_key, hint_key, start_id, min(seq) as first from c group by all) group by all""")
def a03_class_members(spark: SparkSession, folder: str) -> DataFrame:
    """Members of merged classes, each where it came first."""
    rows = table(spark, folder, "kg_rels").filter("start_id is not null").groupBy(F.lower(T.safe_text("canonical_rel_name")).alias("label_key"), F.lower(T.safe_text("rel_hint_type")).alias("hint_key"), "start_id").agg(F.min("seq").alias("seq"))
    members = F.transform(F.array_sort(F.collect_list(F.struct("seq", "start_id"))), lambda x: x["start_id"])
    return rows.groupBy("label_key", "hint_key").agg(joined(members, ",").alias("members"))


@query(f"""with {NODES}, pool as (select entity_id from nodes where entity_confidence is null or try_cast(trim(entity_confidence) as double) < 0.5 union select entity_id from nodes where entity_flag = 'entity_raw'),
taken as (select entity_id from nodes where class_label is not null and trim(class_label) <> '' and upper(trim(class_label)) <> 'TBD') select entity_id from pool where entity_id not in (select entity_id from taken)""")
def j11_unassigned_pool(spark: SparkSession, folder: str) -> DataFrame:
    """Entities that are noise (a low confidence stands for it) or were seen, less those that a class has."""
    nodes = current_nodes(spark, folder)
    confidence = T.to_double("entity_confidence")
    noise, seen = nodes.filter(F.col("entity_confidence").isNull() | (confidence < 0.5)).select("entity_id"), nodes.filter("entity_flag = 'entity_raw'").select("entity_id")
    return noise.union(seen).distinct().join(nodes.filter(records.is_set("class_label")).select("entity_id"), "entity_id", "left_anti")


@query(f"with recursive {STRUCTURE} select method, array_to_string([max(case when metric = 'avg_degree' then c end), max(case when metric = 'connectivity' then c end), max(case when metric = 'clustering' then c end)], '|') as cells from (select method, metric, printf('%.2f', mean) || ' ± ' || printf('%.2f', std) as c from stats) group by method")
def r07_report_table(spark: SparkSession, folder: str) -> DataFrame:
    """Methods with mean and deviation of their metrics as text."""
    wanted = ("avg_degree", "connectivity", "clustering")
    statistics = metrics.method_statistics(structure(spark, folder), "method", list(wanted))
    rows = statistics.groupBy("method").agg(*(F.max(F.when(F.col("metric") == m, metrics.shown(F.col("mean"), F.col("std"), 2))).alias(m) for m in wanted))
    return rows.select("method", joined(F.array(*wanted)).alias("cells"))


@query()
def c03_recluster(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters of more than 30 members within each label, clustered again (no SQL: hierarchy)."""
    rows = table(spark, folder, "embeddings").select(F.col("label").alias("group_id"), F.col("vec_id").alias("id"), "embedding")
    return cluster.recluster(rows, cut(cluster.cluster(rows)))


@query()
def c06_diagnosis(spark: SparkSession, folder: str) -> DataFrame:
    """How the clustering of each label came out (no SQL: hierarchy)."""
    rows = table(spark, folder, "embeddings").select(F.col("label").alias("group_id"), F.col("vec_id").alias("id"), "embedding")
    return cluster.diagnose(cut(cluster.cluster(rows, least=3))).withColumn("largest", joined(F.transform("largest", lambda n: n.cast("string")), ","))
