"""Queries over graphs: the baseline graphs (many, small) and the knowledge graph (one, large)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspar.functions import text as T
from loomspar.operators import graph, records
from loomspar.plans.base import GRAPHS, NODES, RELS, Registry, current_nodes, current_rels, graph_edges, graph_entities
from loomspar.runtime import table

query = Registry()
QUERIES, SQL = query.queries, query.sql

COMPONENTS = """walk as (
  select graph_id, node, node as reached from vertices
  union
  select w.graph_id, w.node, case when e.source = w.reached then e.target else e.source end
  from walk w join edges e on e.graph_id = w.graph_id and (e.source = w.reached or e.target = w.reached)
), component as (select graph_id, node, min(reached) as component from walk group by all)"""
LOCAL = """pair as (select distinct graph_id, least(source, target) as a, greatest(source, target) as b from edges where source <> target
), near as (select graph_id, a as x, b as y from pair union all select graph_id, b, a from pair
), deg as (select graph_id, x as node, count(*) as d from near group by all
), tri as (select p.graph_id, p.x as node, count(*) as t from near p join near q on q.graph_id = p.graph_id and q.x = p.x and q.y > p.y join pair r on r.graph_id = p.graph_id and r.a = p.y and r.b = q.y group by all
), local as (select v.graph_id, v.node, coalesce(d, 0) as degree, coalesce(t, 0) as triangles, case when d > 1 then 2.0 * coalesce(t, 0) / (d * (d - 1)) else 0.0 end as coefficient
  from vertices v left join deg using (graph_id, node) left join tri using (graph_id, node))"""
KG_EDGES = """kg as (select relation_id, start_id as source, end_id as target, coalesce(nullif(trim(canonical_rel_name), ''), raw_relation_name, '') as relation, seq from rels where start_id is not null and end_id is not null)"""


def kg_edges(spark: SparkSession, folder: str) -> DataFrame:
    rows = current_rels(spark, folder).filter("start_id is not null and end_id is not null")
    return rows.select(F.lit(0).alias("graph_id"), "relation_id", "seq", F.col("start_id").alias("source"), F.col("end_id").alias("target"), F.coalesce(F.nullif(F.trim("canonical_rel_name"), F.lit("")), "raw_relation_name", F.lit("")).alias("relation"))


@query(f"with {GRAPHS} select graph_id, source, target, relation from edges")
def g01_collapse(spark: SparkSession, folder: str) -> DataFrame:
    return graph.collapse(graph_edges(spark, folder))


@query(f"""with {RELS}, {KG_EDGES} select source, target, arg_max(relation, seq) as relation, count(*) as parallel from kg group by all""")
def g01_collapse_kg(spark: SparkSession, folder: str) -> DataFrame:
    return kg_edges(spark, folder).groupBy("source", "target").agg(F.max_by("relation", "seq").alias("relation"), F.count("*").alias("parallel"))


@query(f"""with recursive {GRAPHS}, {COMPONENTS} select graph_id, node, component from component""")
def g03_components(spark: SparkSession, folder: str) -> DataFrame:
    edges = graph.collapse(graph_edges(spark, folder))
    return graph.components(edges, graph.nodes_of(edges, graph_entities(spark, folder)))


@query()
def g03_components_kg(spark: SparkSession, folder: str) -> DataFrame:
    """Components of the whole knowledge graph, with their sizes (checked against a search in tests; too slow as SQL)."""
    edges = kg_edges(spark, folder)
    nodes = graph.nodes_of(edges, table(spark, folder, "kg_nodes").filter("entity_id is not null").select(F.lit(0).alias("graph_id"), F.col("entity_id").alias("node")))
    return graph.components(edges, nodes).groupBy("component").agg(F.count("*").alias("size"))


@query(f"""with {GRAPHS}, {LOCAL} select graph_id, node, degree, triangles, round(coefficient, 6) as coefficient from local""")
def g04_clustering(spark: SparkSession, folder: str) -> DataFrame:
    edges = graph.collapse(graph_edges(spark, folder))
    return graph.clustering(edges, graph.nodes_of(edges, graph_entities(spark, folder))).withColumn("coefficient", F.round("coefficient", 6))


@query(f"""with {RELS}, {NODES}, {KG_EDGES.replace("kg as", "edges as").replace("select relation_id", "select 0 as graph_id, relation_id")},
vertices as (select 0 as graph_id, entity_id as node from nodes union select 0, source from edges union select 0, target from edges), {LOCAL}
select node, degree, triangles, round(coefficient, 6) as coefficient from local""")
def g04_clustering_kg(spark: SparkSession, folder: str) -> DataFrame:
    edges = kg_edges(spark, folder)
    nodes = graph.nodes_of(edges, current_nodes(spark, folder).select(F.lit(0).alias("graph_id"), F.col("entity_id").alias("node")))
    return graph.clustering(edges, nodes).select("node", "degree", "triangles", F.round("coefficient", 6).alias("coefficient"))


@query(f"""with {RELS}, {NODES}, {KG_EDGES}, seeds as (select entity_id as node from nodes where class_label = 'Airport'),
two as (select source as a, target as b from kg union select target, source from kg),
one as (select distinct b as node from two join seeds on a = node),
far as (select distinct b as node from two join one on a = node)
select node, cast(min(hop) as int) as hop from (select node, 0 as hop from seeds union all select node, 1 from one union all select node, 2 from far) group by node""")
def g05_two_hops(spark: SparkSession, folder: str) -> DataFrame:
    seeds = current_nodes(spark, folder).filter("class_label = 'Airport'").select(F.lit(0).alias("graph_id"), F.col("entity_id").alias("node"))
    return graph.expand(kg_edges(spark, folder), seeds, 2).select("node", "hop")


@query(f"""with {RELS}, {NODES}, {KG_EDGES}, inside as (select entity_id from nodes where class_label in ('Centrifugal Pump', 'Pressure Vessel', 'Control Valve'))
select relation_id, source, target, relation from kg where source in (from inside) and target in (from inside)""")
def g06_induced_edges(spark: SparkSession, folder: str) -> DataFrame:
    inside = current_nodes(spark, folder).filter(F.col("class_label").isin("Centrifugal Pump", "Pressure Vessel", "Control Valve")).select(F.lit(0).alias("graph_id"), F.col("entity_id").alias("node"))
    return graph.induced(kg_edges(spark, folder), inside).select("relation_id", "source", "target", "relation")


@query(f"""with {GRAPHS} select v.graph_id, 'NODES:' || chr(10) || v.text || chr(10) || 'EDGES (' || coalesce(e.n, 0) || '):' || coalesce(chr(10) || e.text, '') as context
from (select graph_id, array_to_string(list_sort(list('- ' || node))[:250], chr(10)) as text from vertices group by graph_id) v
left join (select graph_id, count(*) as n, array_to_string(list_sort(list('- ' || source || ' -[' || relation || ']-> ' || target))[:300], chr(10)) as text from edges group by graph_id) e using (graph_id)""")
def g06_graph_context(spark: SparkSession, folder: str) -> DataFrame:
    """A graph as text for a judge; the report shows 250 nodes and 300 edges at most."""
    edges = graph.collapse(graph_edges(spark, folder))
    nodes = graph.nodes_of(edges, graph_entities(spark, folder)).groupBy("graph_id").agg(F.array_join(F.slice(F.sort_array(F.collect_list(F.concat(F.lit("- "), "node"))), 1, 250), "\n").alias("nodes"))
    line = F.concat(F.lit("- "), "source", F.lit(" -["), "relation", F.lit("]-> "), "target")
    links = edges.groupBy("graph_id").agg(F.count("*").alias("n"), F.array_join(F.slice(F.sort_array(F.collect_list(line)), 1, 300), "\n").alias("edges"))
    text = F.concat(F.lit("NODES:\n"), "nodes", F.lit("\nEDGES ("), F.coalesce("n", F.lit(0)).cast("string"), F.lit("):"), F.coalesce(F.concat(F.lit("\n"), "edges"), F.lit("")))
    return nodes.join(links, "graph_id", "left").select("graph_id", text.alias("context"))


@query(f"""with recursive {GRAPHS}, {COMPONENTS}, {LOCAL},
size as (select graph_id, count(*) as n from vertices group by all), link as (select graph_id, count(*) as m, count(distinct nullif(relation, '')) as types from edges group by all),
part as (select graph_id, count(*) as parts, max(k) as largest from (select graph_id, component, count(*) as k from component group by all) group by all),
clus as (select graph_id, avg(coefficient) as c from local group by all)
select s.graph_id, n as n_nodes, coalesce(m, 0) as n_edges, coalesce(types, 0) as n_types, parts as n_components, largest, round(c, 6) as avg_clustering, round(coalesce(m, 0) / greatest(n, 1), 6) as avg_degree,
  round(case when n > 1 then coalesce(m, 0) / (n * (n - 1)) else 0 end, 6) as density, round(largest / n, 6) as largest_share, round(coalesce(types, 0) / greatest(coalesce(m, 0), 1), 6) as type_diversity
from size s left join link using (graph_id) join part using (graph_id) join clus using (graph_id)""")
def g07_graph_measures(spark: SparkSession, folder: str) -> DataFrame:
    out = graph.measures(graph.collapse(graph_edges(spark, folder)), graph_entities(spark, folder))
    return out.select("graph_id", "n_nodes", "n_edges", "n_types", "n_components", "largest", *(F.round(c, 6).alias(c) for c in ("avg_clustering", "avg_degree", "density", "largest_share", "type_diversity")))


WORDS = r"len(list_filter(regexp_split_to_array({0}, '[\s\p{Z}]+'), lambda w: w <> ''))"


@query(f"""with essay as (select id, max({WORDS.replace("{0}", "coalesce(nullif(essay_content, ''), text, '')")}) as n from in_plain_text group by id),
words as (select graph_id, method, essay_id, list_avg(list_transform(entities, lambda x: {WORDS.replace("{0}", "x")})) as entity_words,
  coalesce(list_sum(list_transform(list_filter(relations, lambda r: len(r) = 3), lambda r: {WORDS.replace("{0}", "array_to_string(r, ' ')")})), 0) as triple_words, len(entities) as n_entities, len(relations) as n_relations from baseline_kg)
select graph_id, method, cast(n_entities as int) as n_entities, cast(n_relations as int) as n_relations, round(coalesce(entity_words, 0), 6) as avg_entity_words, round(triple_words / greatest(coalesce(n, 0), 1), 6) as triple_compression
from words left join essay on id = essay_id""")
def f29_text_measures(spark: SparkSession, folder: str) -> DataFrame:
    """Granularity of entities, and the words of the triples against those of the essay."""
    essay = table(spark, folder, "in_plain_text").groupBy(F.col("id").alias("essay_id")).agg(F.max(T.word_count(F.coalesce(F.nullif("essay_content", F.lit("")), "text"))).alias("n"))
    graphs = table(spark, folder, "baseline_kg")
    total = lambda a: F.aggregate(F.transform(a, lambda x: T.word_count(x)), F.lit(0), lambda s, x: s + x)
    triples = F.transform(F.filter("relations", lambda r: F.size(r) == 3), lambda r: F.array_join(r, " "))
    return graphs.join(essay, "essay_id", "left").select(
        "graph_id", "method", F.size("entities").alias("n_entities"), F.size("relations").alias("n_relations"),
        F.round(F.when(F.size("entities") > 0, total(F.col("entities")) / F.size("entities")).otherwise(0.0), 6).alias("avg_entity_words"),
        F.round(total(triples) / F.greatest(F.coalesce("n", F.lit(0)), F.lit(1)), 6).alias("triple_compression"),
    )


@query(f"""with {GRAPHS} select graph_id, cast(count(distinct source || chr(1) || relation || chr(1) || target) as bigint) as relations, array_to_string(list_sort(list(distinct relation)), '|') as names from edges0 group by graph_id""")
def p23_triples_to_graph(spark: SparkSession, folder: str) -> DataFrame:
    rows = graph_edges(spark, folder).select("graph_id", "source", "relation", "target").distinct()
    return rows.groupBy("graph_id").agg(F.count("*").alias("relations"), F.array_join(F.sort_array(F.collect_set("relation")), "|").alias("names"))


@query("""select graph_id, cast(len(list_filter(relations, lambda r: len(r) <> 3)) as int) as dropped, cast(len(list_distinct(entities)) as int) as entities, cast(len(list_distinct(edges)) as int) as edge_names from baseline_kg""")
def p24_parse_graph(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "baseline_kg").select("graph_id", F.size(F.filter("relations", lambda r: F.size(r) != 3)).alias("dropped"), F.size(F.array_distinct("entities")).alias("entities"), F.size(F.array_distinct("edges")).alias("edge_names"))


@query("""select essay_id, problem from (
  select distinct id as essay_id, 'missing_right' as problem from in_plain_text where id not in (select essay_id from baseline_kg where essay_id is not null)
  union all select distinct essay_id, 'missing_left' from baseline_kg where essay_id not in (select id from in_plain_text)
  union all select id, 'repeated_left' from in_plain_text group by id having count(*) > 1
  union all select essay_id, 'repeated_right' from baseline_kg group by essay_id having count(*) > 1)""")
def j14_misaligned_ids(spark: SparkSession, folder: str) -> DataFrame:
    essays = table(spark, folder, "in_plain_text").select(F.col("id").alias("essay_id"))
    return records.misaligned(essays, table(spark, folder, "baseline_kg"), "essay_id")
