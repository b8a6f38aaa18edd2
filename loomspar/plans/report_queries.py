"""Queries for retrieval evaluation, audits and reports, and the remaining set and lineage operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspar.functions import text as T
from loomspar.operators import chunk, metrics, records
from loomspar.plans.base import GRAPHS, NODES, RELS, Registry, current_nodes, current_rels, graph_edges
from loomspar.plans.eval_queries import GOLD, JUDGED, STRUCTURE, a21_method_statistics, gold, judged, weights
from loomspar.plans.record_queries import CHUNKS, PROPS, safe
from loomspar.plans.text_queries import BODY, sections
from loomspar.runtime import shared_dir, table
from loomspar.sources import io

query = Registry()
QUERIES, SQL = query.queries, query.sql

WS = r"[\s\p{Z}\x{85}\x{1c}-\x{1f}]"


@query(rf"""with {NODES}, essay as (select id, max(trim(regexp_replace(coalesce(text, ''), '{WS}+', ' ', 'g'))) as v from in_plain_text group by id)
select entity_id, case when length(v) > 400 then (case when contains(substr(v, 1, 400), ' ') then regexp_extract(substr(v, 1, 400), '(?s)^(.*) ', 1) else substr(v, 1, 400) end) || '...' else coalesce(v, '') end as context from nodes left join essay on id = essay_id""")
def j03_entity_context(spark: SparkSession, folder: str) -> DataFrame:
    """Each entity with the beginning of its essay, cut at a word."""
    essay = table(spark, folder, "in_plain_text").groupBy(F.col("id").alias("essay_id")).agg(F.max(T.collapse("text")).alias("v"))
    return current_nodes(spark, folder).select("entity_id", "essay_id").join(essay, "essay_id", "left").select("entity_id", T.clip_words("v", 400).alias("context"))


@query(f"""with {NODES}, c as (select distinct lower({safe("entity_name")}) as canonical_id, {CHUNKS} as chunk_id from nodes where {safe("entity_name")} <> '') select canonical_id, count(*) as chunks, string_agg(chunk_id, ',' order by chunk_id) as chunk_ids from c where chunk_id is not null group by canonical_id""")
def j05_lineage_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks that a merged entity comes from, through the entities merged into it."""
    rows = current_nodes(spark, folder).filter(T.safe_text("entity_name") != "").select(F.lower(T.safe_text("entity_name")).alias("canonical_id"), F.explode(F.from_json("chunk_ids", "array<string>")).alias("chunk_id")).filter("chunk_id is not null").distinct()
    return rows.groupBy("canonical_id").agg(F.count("*").alias("chunks"), F.array_join(F.sort_array(F.collect_list("chunk_id")), ",").alias("chunk_ids"))


@query(f"""with {RELS}, {GOLD}, m as (select domain_label as concept, start_id as member, seq from gold join ref_relations on label = predicate union all select range_label, end_id, seq from gold join ref_relations on label = predicate),
f as (select concept, member, min(seq) as s from m where member is not null and coalesce(concept, '') <> '' group by all), n as (select *, row_number() over (partition by concept order by s, member) as k from f)
select concept, string_agg(member, ',' order by k) as members from n where k <= 25 group by concept""")
def j16_concept_members(spark: SparkSession, folder: str) -> DataFrame:
    """The first 25 members of each reference concept: ends of gold triples whose predicate has it as domain or range."""
    refs = table(spark, folder, "ref_relations").select(F.col("label").alias("predicate"), "domain_label", "range_label")
    rows = gold(spark, folder).join(refs, "predicate").select("seq", F.explode(F.array(F.struct(F.col("domain_label").alias("concept"), F.col("start_id").alias("member")), F.struct(F.col("range_label").alias("concept"), F.col("end_id").alias("member")))).alias("x")).select("seq", "x.*")
    first = rows.filter("member is not null and coalesce(concept, '') <> ''").groupBy("concept", "member").agg(F.min("seq").alias("s"))
    kept = records.numbered(first, ["concept"], ["s", "member"], "k").filter("k <= 25")
    return kept.groupBy("concept").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "member"))), lambda x: x["member"]), ",").alias("members"))


@query(f"with {NODES}, c as (select coalesce(nullif({safe('class_label')}, ''), 'TBD') as label, count(*) as n from nodes group by 1) select label, n, round(n / (select sum(n) from c), 6) as share from c order by n desc, label limit 10")
def o02_largest_classes(spark: SparkSession, folder: str) -> DataFrame:
    """The ten largest classes and their share: a top-k report."""
    each = current_nodes(spark, folder).groupBy(F.coalesce(F.nullif(T.safe_text("class_label"), F.lit("")), F.lit(records.UNSET)).alias("label")).agg(F.count("*").alias("n"))
    return each.select("label", "n", F.round(F.col("n") / each.agg(F.sum("n")).scalar(), 6).alias("share")).orderBy(F.desc("n"), "label").limit(10)


@query(f"""with {NODES}, {JUDGED}, a as (select ref_label, weight, coalesce(covered_compat, 0) as covered from weights left join anchors using (ref_label)) select ref_label, weight, covered from a order by covered, weight desc, ref_label limit 10""")
def o07_audit_sheet(spark: SparkSession, folder: str) -> DataFrame:
    """Ten anchors for a human audit: missed ones first, by weight."""
    pairs = judged(spark, folder)
    rows = weights(spark, folder, pairs).join(metrics.per_anchor(pairs), "ref_label", "left").select("ref_label", "weight", F.coalesce("covered_compat", F.lit(0)).alias("covered"))
    return rows.orderBy("covered", F.desc("weight"), "ref_label").limit(10)


@query(f"""with {GRAPHS}, essay as (select id, max(lower(trim(regexp_replace(coalesce(nullif(essay_content, ''), text, ''), '{WS}+', ' ', 'g')))) as t from in_plain_text group by id),
fact as (select e.graph_id, b.method, b.essay_id, lower(trim(regexp_replace(e.source, '{WS}+', ' ', 'g'))) as s, lower(trim(regexp_replace(e.target, '{WS}+', ' ', 'g'))) as o from edges e join baseline_kg b using (graph_id))
select method, count(*) as facts, cast(sum(case when contains(coalesce(t, ''), s) and contains(coalesce(t, ''), o) then 1 else 0 end) as bigint) as hits, round(avg(case when contains(coalesce(t, ''), s) and contains(coalesce(t, ''), o) then 1.0 else 0.0 end), 6) as accuracy from fact left join essay on id = essay_id group by method""")
def r01_retrieval_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """Facts whose both ends stand in the essay, by method; the judge is the verbatim rule."""
    essay = table(spark, folder, "in_plain_text").groupBy(F.col("id").alias("essay_id")).agg(F.max(F.lower(T.collapse(F.coalesce(F.nullif("essay_content", F.lit("")), "text")))).alias("t"))
    facts = graph_edges(spark, folder).filter("source is not null and target is not null").select("graph_id", "source", "target").distinct()
    rows = facts.join(table(spark, folder, "baseline_kg").select("graph_id", "method", "essay_id"), "graph_id").join(essay, "essay_id", "left")
    hit = F.contains(F.coalesce("t", F.lit("")), F.lower(T.collapse("source"))) & F.contains(F.coalesce("t", F.lit("")), F.lower(T.collapse("target")))
    return rows.groupBy("method").agg(F.count("*").alias("facts"), F.sum(hit.cast("int")).alias("hits"), F.round(F.avg(hit.cast("double")), 6).alias("accuracy"))


@query(f"with recursive {STRUCTURE} select method, round(max(mean) filter (metric = 'avg_degree'), 6) as avg_degree, round(max(mean) filter (metric = 'clustering'), 6) as clustering, round(max(mean) filter (metric = 'connectivity'), 6) as connectivity from stats group by method")
def r03_metrics_by_method(spark: SparkSession, folder: str) -> DataFrame:
    return a21_method_statistics(spark, folder).groupBy("method").pivot("metric", ["avg_degree", "clustering", "connectivity"]).agg(F.first("mean"))


@query("select cast(cast(ts as date) as varchar) as run, count(*) as actions, count(distinct event_type) as kinds, round(sum(coalesce(value, 0)), 4) as total from events group by 1")
def a11_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Sums over the runs (days) of an action log."""
    return table(spark, folder, "events").groupBy(F.to_date("ts").cast("string").alias("run")).agg(F.count("*").alias("actions"), F.countDistinct("event_type").alias("kinds"), F.round(F.sum(F.coalesce("value", F.lit(0.0))), 4).alias("total"))


@query(f"""with {RELS}, {GOLD}, g as (select distinct predicate from gold), r as (select distinct label from ref_relations) select coalesce(predicate, label) as label, case when label is null then 'gold only' when predicate is null then 'reference only' else 'both' end as side from g full join r on predicate = label""")
def u03_predicate_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Gold predicates and reference predicates: in both sets or in one."""
    g = gold(spark, folder).select(F.col("predicate").alias("label")).distinct().withColumn("g", F.lit(True))
    r = table(spark, folder, "ref_relations").select("label").distinct().withColumn("r", F.lit(True))
    return g.join(r, "label", "full").select("label", F.when(F.col("r").isNull(), "gold only").when(F.col("g").isNull(), "reference only").otherwise("both").alias("side"))


@query("select doc_id, case when coalesce(text, '') = '' then 'skipped_empty' when floor(length(text) / 4) > 8000 then 'kept_skipped_prompt' else 'sent' end as action from documents")
def x02_prompt_guard(spark: SparkSession, folder: str) -> DataFrame:
    action = F.when(F.coalesce("text", F.lit("")) == "", "skipped_empty").when(T.tokens_chars("text") > 8000, "kept_skipped_prompt").otherwise("sent")
    return table(spark, folder, "documents").select("doc_id", action.alias("action"))


@query("""select graph_id, cast(len(list_filter(list_distinct(list_concat(list_transform(list_filter(relations, lambda r: len(r) = 3), lambda r: r[1]), list_transform(list_filter(relations, lambda r: len(r) = 3), lambda r: r[3]))), lambda m: list_contains(entities, m))) as int) as known from baseline_kg""")
def p07_known_members(spark: SparkSession, folder: str) -> DataFrame:
    """Ends of relations that the graph lists as entities."""
    whole = F.filter("relations", lambda r: F.size(r) == 3)
    ends = F.concat(F.transform(whole, lambda r: r[0]), F.transform(whole, lambda r: r[2]))
    return table(spark, folder, "baseline_kg").select("graph_id", F.size(F.array_intersect(ends, F.coalesce("entities", F.array().cast("array<string>")))).alias("known"))


@query(r"select graph_id, pos - 1 as pos, a as subject, b as predicate, c as object from (select graph_id, pos, r, regexp_replace(r[1], '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') as a, regexp_replace(r[2], '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') as b, regexp_replace(r[3], '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') as c from (select graph_id, unnest(relations) as r, generate_subscripts(relations, 1) as pos from baseline_kg)) where len(r) = 3 and a <> '' and b <> '' and c <> ''")
def p17_triples(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "baseline_kg").select("graph_id", F.posexplode("relations").alias("pos", "r")).filter("size(r) = 3")
    parts = rows.select("graph_id", "pos", *(T.strip(F.col("r")[n]).alias(c) for n, c in enumerate(("subject", "predicate", "object"))))
    return parts.filter("subject <> '' and predicate <> '' and object <> ''")


@query(f"with {BODY} select doc_id, 'Ch_' || lpad(cast(row_number() over (order by doc_id) - 1 as varchar), 6, '0') as id from parts where len(sentences) > 0")
def w02_running_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Running ids over all documents with text, one chunk each, numbered by offset."""
    rows = sections(spark, folder).filter("size(sentences) > 0").select("section_id", F.lit(0).alias("chunk_index"))
    return chunk.chunk_ids(rows).select(F.col("section_id").alias("doc_id"), "id")


@query(f"with {RELS} select canonical_rel_name as name, count(distinct start_id) as starts, count(distinct end_id) as ends, min(seq) as first_seq from rels group by 1")
def a08_relation_ends(spark: SparkSession, folder: str) -> DataFrame:
    return current_rels(spark, folder).groupBy(F.col("canonical_rel_name").alias("name")).agg(F.countDistinct("start_id").alias("starts"), F.countDistinct("end_id").alias("ends"), F.min("seq").alias("first_seq"))


@query(r"""select seq, regexp_extract('Answer: ' || coalesce(qualifiers, '') || ' (end)', '(?s)\{.*\}', 0) as found from kg_rels where contains(coalesce(qualifiers, ''), '{')""")
def f13_json_object(spark: SparkSession, folder: str) -> DataFrame:
    """JSON objects inside running text."""
    text = F.concat(F.lit("Answer: "), F.coalesce("qualifiers", F.lit("")), F.lit(" (end)"))
    return table(spark, folder, "kg_rels").select("seq", T.json_object_text(text).alias("found")).filter("found is not null")


@query("select graph_id, string_agg(x, '|' order by p) as names from (select graph_id, x, min(p) as p from (select graph_id, unnest(edges) as x, generate_subscripts(edges, 1) as p from baseline_kg) group by all) group by graph_id")
def f16_ordered_unique(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "baseline_kg").filter("size(edges) > 0").select("graph_id", F.array_join(T.ordered_unique("edges"), "|").alias("names"))


@query(f"with {RELS} select relation_id, least(start_id, end_id) as first_id, greatest(start_id, end_id) as second_id, start_id > end_id as turned from rels where start_id is not null and end_id is not null")
def f19_swap_ends(spark: SparkSession, folder: str) -> DataFrame:
    """Relations in one direction: ends swapped where they stand the other way round."""
    turned = F.col("start_id") > F.col("end_id")
    rels = current_rels(spark, folder).filter("start_id is not null and end_id is not null")
    return rels.select("relation_id", F.when(turned, F.col("end_id")).otherwise(F.col("start_id")).alias("first_id"), F.when(turned, F.col("start_id")).otherwise(F.col("end_id")).alias("second_id"), turned.alias("turned"))


@query("select seq, printf('%.1f%%', try_cast(trim(confidence) as double) * 100) as share from kg_rels where try_cast(trim(confidence) as double) is not null")
def f23_percent(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "kg_rels").withColumn("c", T.to_double("confidence")).filter("c is not null").select("seq", T.percent("c").alias("share"))


@query(f"""with {NODES} select entity_id, coalesce(entity_name, '') as entity_name, coalesce(entity_description, '') as entity_description,
  array_to_string(list_transform({PROPS}, lambda p: replace(p.prop_name, '"', chr(39)) || '=' || coalesce(replace(p.prop_value, '"', chr(39)), '')), '|') as properties from nodes""")
def s13_graph_files(spark: SparkSession, folder: str) -> DataFrame:
    """The graph written as CSV files and read again."""
    place = f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}"
    io.write_graph(current_nodes(spark, folder), current_rels(spark, folder), place)
    nodes, _ = io.read_graph(spark, place)
    properties = F.transform(F.from_json("node_properties", "array<struct<prop_name:string,prop_value:string>>"), lambda p: F.concat(p["prop_name"], F.lit("="), F.coalesce(p["prop_value"], F.lit(""))))
    return nodes.select("entity_id", *(F.coalesce(c, F.lit("")).alias(c) for c in ("entity_name", "entity_description")), F.array_join(properties, "|").alias("properties"))
