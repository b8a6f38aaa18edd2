"""Queries that score alignment and graphs.

Judgements are derived from the graph itself: a resolved class label stands for the reference label, the freely typed
hint of the same entity for the candidate, and how the two are written decides the judgement.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspar.functions import text as T
from loomspar.operators import graph, metrics, records
from loomspar.plans.base import GRAPHS, NODES, RELS, Registry, current_nodes, current_rels, graph_edges, graph_entities
from loomspar.plans.graph_queries import COMPONENTS, LOCAL, f29_text_measures
from loomspar.runtime import table

query = Registry()
QUERIES, SQL = query.queries, query.sql

JUDGED = f"""pairs as (
  select trim(class_label) as ref_label, lower(trim(entity_type_hint)) as item_label, count(*) as n, round(sum(cast(round(coalesce(try_cast(trim(entity_confidence) as double), 0) * 100) as bigint)) / count(*) / 100, 6) as confidence
  from nodes where coalesce(trim(class_label), '') not in ('', 'TBD') and coalesce(trim(entity_type_hint), '') <> '' group by all
), judged as (
  select *, judgement <> 'Unrelated' as usable, cast(row_number() over (partition by ref_label order by n desc, item_label) as int) as rank from (
    select *, case when lower(ref_label) = item_label then 'Equivalent' when contains(item_label, lower(ref_label)) then 'Narrower' when contains(lower(ref_label), item_label) then 'Broader' else 'Unrelated' end as judgement from pairs)
), weights as (select l.label as ref_label, coalesce(w, 0) as weight from (select distinct label from ref_concepts) l left join (select ref_label, sum(n) as w from pairs group by all) on ref_label = label
), anchors as (
  select ref_label, count(*) as candidates, max(case when usable and judgement = 'Equivalent' then 1 else 0 end) as covered_exact, min(case when usable and judgement = 'Equivalent' then rank end) as first_rank_exact,
    max(case when usable and judgement in ('Equivalent', 'Narrower') then 1 else 0 end) as covered_compat, min(case when usable and judgement in ('Equivalent', 'Narrower') then rank end) as first_rank_compat,
    max(case when usable and judgement in ('Equivalent', 'Narrower', 'Broader') then 1 else 0 end) as covered_gen, min(case when usable and judgement in ('Equivalent', 'Narrower', 'Broader') then rank end) as first_rank_gen
  from judged group by ref_label)"""


def judged(spark: SparkSession, folder: str) -> DataFrame:
    rows = current_nodes(spark, folder).select(F.trim(F.coalesce("class_label", F.lit(""))).alias("ref_label"), F.lower(F.trim(F.coalesce("entity_type_hint", F.lit("")))).alias("item_label"), T.to_double("entity_confidence", 0.0).alias("c"))
    pairs = rows.filter((~F.col("ref_label").isin("", records.UNSET)) & (F.col("item_label") != "")).groupBy("ref_label", "item_label").agg(F.count("*").alias("n"), F.round(F.sum(F.round(F.col("c") * 100).cast("bigint")) / F.count("*") / 100, 6).alias("confidence"))
    low = F.lower("ref_label")
    judgement = F.when(low == F.col("item_label"), "Equivalent").when(F.contains("item_label", low), "Narrower").when(F.contains(low, F.col("item_label")), "Broader").otherwise("Unrelated")
    rank = F.row_number().over(Window.partitionBy("ref_label").orderBy(F.desc("n"), "item_label"))
    return pairs.withColumn("judgement", judgement).withColumns({"usable": F.col("judgement") != "Unrelated", "rank": rank})


def weights(spark: SparkSession, folder: str, pairs: DataFrame) -> DataFrame:
    listed = table(spark, folder, "ref_concepts").select(F.col("label").alias("ref_label")).distinct()
    return listed.join(pairs.groupBy("ref_label").agg(F.sum("n").alias("weight")), "ref_label", "left").na.fill(0, ["weight"])


@query(f"with {NODES}, {JUDGED} select ref_label, item_label, judgement, usable, rank, confidence from judged")
def p18_judgements(spark: SparkSession, folder: str) -> DataFrame:
    return judged(spark, folder).select("ref_label", "item_label", "judgement", "usable", "rank", "confidence")


def _coverage(mode: str) -> str:
    within = f"coalesce(first_rank_{mode} <= 3, false)"
    refined = "round(sum(case when covered_compat = 1 and covered_exact = 0 then weight else 0 end) / sum(weight), 6)" if mode == "compat" else "cast(null as double)"
    return f"select '{mode}' as mode, round(sum(coalesce(covered_{mode}, 0) * weight) / sum(weight), 6) as coverage, round(sum(case when {within} then weight else 0 end) / sum(weight), 6) as hits, round(sum(case when {within} then weight / first_rank_{mode} else 0 end) / sum(weight), 6) as mrr, {refined} as refinement from weights left join anchors using (ref_label) where weight > 0"


@query(f"with {NODES}, {JUDGED} " + " union all ".join(map(_coverage, metrics.MODES)))
def a22_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Coverage, hits and reciprocal rank within 3, and refinement, weighted by how often a class is used."""
    pairs = judged(spark, folder)
    out = metrics.coverage(metrics.per_anchor(pairs), weights(spark, folder, pairs), 3)
    return out.select("mode", *(F.round(c, 6).alias(c) for c in ("coverage", "hits", "mrr", "refinement")))


@query(f"with {NODES}, {JUDGED}, c as ({' union all '.join(map(_coverage, metrics.MODES))}), x as (select max(coverage) filter (mode = 'exact') as e, max(coverage) filter (mode = 'compat') as n, max(coverage) filter (mode = 'gen') as g from c) select round(e, 5) as equivalent, round(n - e, 5) as narrower, round(g - n, 5) as broader, round(1 - g, 5) as missed from x")
def a34_match_quality(spark: SparkSession, folder: str) -> DataFrame:
    out = metrics.match_quality(a22_coverage(spark, folder))
    return out.select(*(F.round(c, 5).alias(c) for c in out.columns))


@query(f"with {NODES}, {JUDGED} select mode, round(avg(case when usable and list_contains(js, judgement) then 1.0 else 0.0 end), 6) as precision from judged cross join (values ('exact', ['Equivalent']), ('compat', ['Equivalent', 'Narrower']), ('gen', ['Equivalent', 'Narrower', 'Broader'])) m(mode, js) where ref_label in (select ref_label from weights where weight > 0) group by mode")
def a24_precision(spark: SparkSession, folder: str) -> DataFrame:
    pairs = judged(spark, folder)
    return metrics.precision(pairs, weights(spark, folder, pairs)).withColumn("precision", F.round("precision", 6))


@query(f"""with {NODES}, {JUDGED}, s as (select confidence as score, sum(case when usable and judgement in ('Equivalent', 'Narrower') then 1 else 0 end) as p, count(*) as n from judged where ref_label in (select ref_label from weights where weight > 0) group by all),
r as (select score, p, sum(n) over (order by score desc) as seen, sum(p) over (order by score desc) as tp, sum(p) over () as total from s) select round(sum(p / total * tp / seen), 6) as ap, cast(max(seen) as bigint) as n from r""")
def a26_average_precision(spark: SparkSession, folder: str) -> DataFrame:
    pairs = judged(spark, folder)
    active = pairs.join(weights(spark, folder, pairs).filter("weight > 0").select("ref_label"), "ref_label", "left_semi")
    return metrics.average_precision(active.select(F.col("confidence").alias("score"), F.when(metrics.good("compat"), 1).otherwise(0).alias("positive"))).select(F.round("ap", 6).alias("ap"), "n")


@query(f"""with {NODES}, {JUDGED}, s as (select confidence as score, sum(case when usable and judgement in ('Equivalent', 'Narrower') then 1 else 0 end) as p, count(*) as n from judged group by all)
select score, cast(sum(n) over (order by score desc) as bigint) as n, cast(sum(p) over (order by score desc) as bigint) as tp, round(sum(p) over (order by score desc) / sum(n) over (order by score desc), 6) as precision, round(sum(p) over (order by score desc) / sum(p) over (), 6) as recall from s""")
def w04_precision_recall(spark: SparkSession, folder: str) -> DataFrame:
    rows = judged(spark, folder).select(F.col("confidence").alias("score"), F.when(metrics.good("compat"), 1).otherwise(0).alias("positive"))
    return metrics.precision_recall(rows).select("score", "n", "tp", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(f"with {NODES}, {JUDGED} select * from anchors")
def a27_per_anchor(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.per_anchor(judged(spark, folder))


@query(f"""with {NODES}, {JUDGED}, l as (select list_sort(list(confidence)) as v, count(*) as n from judged)
select (select n from l) as n, cast(count(*) filter (judgement = 'Equivalent') as bigint) as equivalent, cast(count(*) filter (judgement = 'Narrower') as bigint) as narrower, cast(count(*) filter (judgement = 'Broader') as bigint) as broader, cast(count(*) filter (judgement = 'Unrelated') as bigint) as unrelated,
  (select v[1] from l) as confidence_min, (select v[cast(floor(n / 2) as int) + 1] from l) as confidence_p50, (select v[cast(floor(0.9 * (n - 1)) as int) + 1] from l) as confidence_p90, (select v[n] from l) as confidence_max from judged""")
def a28_judge_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.judge_statistics(judged(spark, folder))


@query(f"""with {NODES}, {JUDGED}, e as (select ref_label, max(case when judgement = 'Equivalent' then 1 else 0 end) as e, max(case when judgement = 'Narrower' then 1 else 0 end) as n, max(case when judgement = 'Broader' then 1 else 0 end) as b from judged group by all)
select cast(sum(case when e = 1 and n = 0 and b = 0 then 1 else 0 end) as bigint) as only_equivalent, cast(sum(case when n = 1 and b = 0 then 1 else 0 end) as bigint) as narrower, cast(sum(case when b = 1 and n = 0 then 1 else 0 end) as bigint) as broader, cast(sum(case when n = 1 and b = 1 then 1 else 0 end) as bigint) as mixed from e""")
def a29_refinement_kinds(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.refinement_kinds(judged(spark, folder))


@query(f"with {NODES}, {JUDGED} select ref_label, weight > 0 as active, case when covered_exact = 1 then 'Equivalent' when covered_compat = 1 then 'Narrower' when covered_gen = 1 then 'Broader' else '-' end as tier from weights left join anchors using (ref_label)")
def a35_match_tiers(spark: SparkSession, folder: str) -> DataFrame:
    pairs = judged(spark, folder)
    return metrics.match_tiers(metrics.per_anchor(pairs), weights(spark, folder, pairs))


@query(f"with {NODES}, {JUDGED} select judgement, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from judged group by judgement")
def a36_judgement_shares(spark: SparkSession, folder: str) -> DataFrame:
    each = judged(spark, folder).groupBy("judgement").agg(F.count("*").alias("n"))
    return each.select("judgement", "n", F.round(F.col("n") / each.agg(F.sum("n")).scalar(), 6).alias("share"))


@query(f"with {NODES}, {JUDGED} select item_label, arg_min(ref_label, (case judgement when 'Equivalent' then 1 when 'Narrower' then 2 else 3 end, -confidence, ref_label)) as ref_label from judged where usable group by item_label")
def a32_best_concepts(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.best_concepts(judged(spark, folder))


ESSAY_KIND = "kind as (select id, coalesce(min(kind), 'all') as split from in_plain_text group by id)"
GOLD = f"""{ESSAY_KIND}, gold as (select coalesce(split, 'all') as split, trim(canonical_rel_name) as predicate, start_id, end_id, seq from rels left join kind on id = essay_id where coalesce(trim(canonical_rel_name), '') not in ('', 'TBD'))"""


def gold(spark: SparkSession, folder: str) -> DataFrame:
    """Resolved relations as gold triples; the kind of the essay is the split."""
    kind = table(spark, folder, "in_plain_text").groupBy(F.col("id").alias("essay_id")).agg(F.coalesce(F.min("kind"), F.lit("all")).alias("split"))
    rels = current_rels(spark, folder).filter(records.is_set("canonical_rel_name"))
    return rels.join(kind, "essay_id", "left").select(F.coalesce("split", F.lit("all")).alias("split"), F.trim("canonical_rel_name").alias("predicate"), "start_id", "end_id", "seq")


@query(f"""with {RELS}, {GOLD}, n as (select s as split, predicate as label, count(*) as n from (select predicate, unnest([split, 'all']) as s from gold) group by all), active as (select n.*, domain_label, range_label from n join ref_relations using (label))
select split, label, 'relation' as kind, n as weight from active union all select split, c, 'concept', cast(sum(n) as bigint) from (select split, n, unnest([domain_label, range_label]) as c from active) where coalesce(c, '') <> '' group by split, c""")
def a14_predicate_weights(spark: SparkSession, folder: str) -> DataFrame:
    predicates = table(spark, folder, "ref_relations").select("label", F.col("domain_label").alias("domain"), F.col("range_label").alias("range"))
    return metrics.predicate_weights(gold(spark, folder), predicates)


@query(f"""with {RELS}, {GOLD}, p as (select predicate, start_id || '|' || end_id as pair, min(seq) as s from gold where start_id is not null and end_id is not null group by all)
select predicate, string_agg(pair, ';' order by s) as pairs from (select *, row_number() over (partition by predicate order by s) as n from p) where n <= 25 group by predicate""")
def a19_gold_index(spark: SparkSession, folder: str) -> DataFrame:
    """The first 25 distinct pairs of each predicate, as the index for a judge's prompt."""
    pairs = gold(spark, folder).filter("start_id is not null and end_id is not null").groupBy("predicate", F.concat_ws("|", "start_id", "end_id").alias("pair")).agg(F.min("seq").alias("s"))
    first = records.numbered(pairs, ["predicate"], ["s"], "n").filter("n <= 25")
    return first.groupBy("predicate").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("s", "pair"))), lambda x: x["pair"]), ";").alias("pairs"))


@query(f"""with {RELS}, {NODES}, {GOLD}, used as (select predicate as label, list_distinct(list(coalesce(s.class_label, 'TBD'))) as ds, list_distinct(list(coalesce(o.class_label, 'TBD'))) as rs from gold left join nodes s on s.entity_id = start_id left join nodes o on o.entity_id = end_id group by all),
x as (select label, domain_label as d, range_label as r, ds, rs, lambda_d, lambda_r, inv_d, inv_r from used join ref_relations using (label), lateral (select
  len(list_filter(ds, lambda c: list_has_all(string_split(lower(c), ' '), string_split(lower(domain_label), ' ')))) > 0 as lambda_d, len(list_filter(rs, lambda c: list_has_all(string_split(lower(c), ' '), string_split(lower(range_label), ' ')))) > 0 as lambda_r,
  len(list_filter(ds, lambda c: list_has_all(string_split(lower(c), ' '), string_split(lower(range_label), ' ')))) > 0 as inv_d, len(list_filter(rs, lambda c: list_has_all(string_split(lower(c), ' '), string_split(lower(domain_label), ' ')))) > 0 as inv_r))
select label, lambda_d and lambda_r as same, inv_d and inv_r as inverse, (lambda_d and lambda_r) or (inv_d and inv_r) as "any" from x""")
def a31_direction_relaxed(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the classes at both ends of a relation fit its domain and range, in either direction."""
    side = lambda p: current_nodes(spark, folder).select(F.col("entity_id").alias(f"{p}_id"), F.coalesce("class_label", F.lit(records.UNSET)).alias(p))
    rows = gold(spark, folder).join(side("start"), "start_id", "left").join(side("end"), "end_id", "left").na.fill(records.UNSET, ["start", "end"])
    chosen = rows.groupBy(F.col("predicate").alias("label")).agg(F.collect_set("start").alias("domains"), F.collect_set("end").alias("ranges"))
    expected = table(spark, folder, "ref_relations").select("label", F.col("domain_label").alias("domain"), F.col("range_label").alias("range"))
    same = table(spark, folder, "ref_concepts").select(F.col("label").alias("item_label"), F.col("label").alias("ref_label"))
    return metrics.direction_relaxed(chosen, expected, same)


STRUCTURE = f"""{GRAPHS}, {COMPONENTS}, {LOCAL}, n as (select graph_id, count(*) as n from vertices group by all), m as (select graph_id, count(*) as m from edges group by all),
part as (select graph_id, max(k) as largest from (select graph_id, component, count(*) as k from component group by all) group by all), clus as (select graph_id, avg(coefficient) as c from local group by all),
per as (select b.graph_id, b.method, coalesce(m, 0) / n as avg_degree, largest / n as connectivity, c as clustering from baseline_kg b join n using (graph_id) left join m using (graph_id) join part using (graph_id) join clus using (graph_id)),
long as (select method, metric, value from (unpivot per on avg_degree, connectivity, clustering into name metric value value)),
stats as (select method, metric, count(value) as n, avg(value) as mean, coalesce(stddev_samp(value), 0) as std from long group by all)"""


def structure(spark: SparkSession, folder: str) -> DataFrame:
    shape = graph.measures(graph.collapse(graph_edges(spark, folder)), graph_entities(spark, folder))
    methods = table(spark, folder, "baseline_kg").select("graph_id", "method")
    return methods.join(shape, "graph_id").select("graph_id", "method", "avg_degree", F.col("largest_share").alias("connectivity"), F.col("avg_clustering").alias("clustering"))


@query(f"with recursive {STRUCTURE} select method, metric, n, round(mean, 6) as mean, round(std, 6) as std from stats")
def a21_method_statistics(spark: SparkSession, folder: str) -> DataFrame:
    out = metrics.method_statistics(structure(spark, folder), "method", ["avg_degree", "connectivity", "clustering"])
    return out.select("method", "metric", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(f"""with recursive {STRUCTURE}, r as (select method, metric, round(mean, 6) as mean from stats) select method, metric, cast(row_number() over (partition by metric order by mean desc, method) as int) as rank,
  round(case when max(mean) over w = min(mean) over w then 1.0 else (mean - min(mean) over w) / (max(mean) over w - min(mean) over w) end, 5) as scaled from r window w as (partition by metric)""")
def w05_method_ranks(spark: SparkSession, folder: str) -> DataFrame:
    """Methods ranked by each metric, and their means scaled within it."""
    return metrics.rank_methods(a21_method_statistics(spark, folder), "method").select("method", "metric", "rank", F.round("scaled", 5).alias("scaled"))


@query(f"""with recursive {STRUCTURE}, words as (select graph_id, cast(0.25 as double) as leakage, cast(0.8 as double) as accuracy from baseline_kg)
select graph_id, round(accuracy * connectivity * (1 - leakage), 6) as egu, round(accuracy * connectivity, 6) as rwa, round(avg_degree * clustering * connectivity, 6) as sci, round(accuracy * leakage, 6) as leaked, round(accuracy * (1 - leakage) * (1 - connectivity), 6) as fragmented from per join words using (graph_id)""")
def f26_composite_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Composite scores of each graph at a given accuracy and leakage."""
    rows = structure(spark, folder).withColumns({"accuracy": F.lit(0.8), "leakage": F.lit(0.25)})
    return metrics.composite(rows).select("graph_id", *(F.round(c, 6).alias(c) for c in ("egu", "rwa", "sci", "leaked", "fragmented")))


@query("select method, round(avg(n_entities), 6) as entities, round(avg(n_relations), 6) as relations from (select method, len(entities) as n_entities, len(relations) as n_relations from baseline_kg) group by method")
def a30_macro_average(spark: SparkSession, folder: str) -> DataFrame:
    return f29_text_measures(spark, folder).groupBy("method").agg(F.round(F.avg("n_entities"), 6).alias("entities"), F.round(F.avg("n_relations"), 6).alias("relations"))
