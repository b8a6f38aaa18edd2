"""Queries over embeddings: normalisation, fusion, search, assignment, clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspar.functions import vectors as V
from loomspar.operators import cluster, records, vector
from loomspar.plans.base import Registry, current_nodes
from loomspar.runtime import cut, table

query = Registry()
QUERIES, SQL = query.queries, query.sql

E = "e as (select vec_id, label, cast(embedding as double[]) as v from embeddings where embedding is not null)"


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", "label", V.doubles("embedding").alias("v")).filter("v is not null")


@query(f"with {E} select vec_id, round(sqrt(list_dot_product(v, v)), 6) as norm, round(v[1] / sqrt(list_dot_product(v, v)), 6) as first from e")
def v03_normalise(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings(spark, folder).select("vec_id", F.round(V.norm(F.col("v")), 6).alias("norm"), F.round(F.get(V.normalise(F.col("v")), F.lit(0)), 6).alias("first"))


@query(f"""with {E}, f as (select vec_id, list_concat(list_transform(v[1:32], lambda x: x * 0.6), list_transform(v[33:64], lambda x: x * 0.4)) as w from e)
select vec_id, round(w[1] / sqrt(list_dot_product(w, w)), 6) as first, round(w[64] / sqrt(list_dot_product(w, w)), 6) as last from f""")
def v04_fuse_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Two fields, the halves of a vector, fused with weights 3 : 2."""
    zeros = F.array_repeat(F.lit(0.0), 32)
    fused = V.fuse([F.concat(F.slice("v", 1, 32), zeros), F.concat(zeros, F.slice("v", 33, 32))], [0.6, 0.4])
    return embeddings(spark, folder).select("vec_id", fused.alias("w")).select("vec_id", F.round(F.get("w", F.lit(0)), 6).alias("first"), F.round(F.get("w", F.lit(63)), 6).alias("last"))


@query(f"""with {E}, s as (select q.vec_id as query_id, c.vec_id as id, list_cosine_similarity(q.v, c.v) as similarity from e q, e c where q.vec_id % 50 = 0)
select query_id, id, cast(rank as int) as rank, round(similarity, 6) as similarity from (select *, row_number() over (partition by query_id order by round(similarity, 12) desc, id desc) as rank from s) where rank <= 8""")
def v06_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 8 nearest of all rows for every row whose id is divisible by 50."""
    rows = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return vector.search(rows, rows.filter("id % 50 = 0"), 8).select("query_id", "id", "rank", F.round("similarity", 6).alias("similarity"))


@query(f"""with {E}, u as (select label, i, avg(x) as m from (select label, unnest(v) as x, generate_subscripts(v, 1) as i from e) group by all), a as (select label, list(m order by i) as v from u group by label),
s as (select vec_id as id, cast(a.label as varchar) as anchor, list_cosine_similarity(e.v, a.v) as similarity from e, a), r as (select *, row_number() over (partition by id order by round(similarity, 12) desc, anchor) as rank from s)
select id, anchor, cast(rank as int) as rank, round(similarity, 6) as similarity, similarity < 0.2 as dropped from r where rank <= 3 and (similarity >= 0.2 or rank = 1)""")
def v07_anchored_assignment(spark: SparkSession, folder: str) -> DataFrame:
    """Rows assigned to up to three label centres."""
    rows = embeddings(spark, folder)
    means = rows.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    anchors = means.groupBy(F.col("label").cast("string").alias("anchor")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("embedding"))
    out = vector.assign_anchors(rows.select(F.col("vec_id").alias("id"), F.col("v").alias("embedding")), anchors)
    return out.select("id", "anchor", "rank", F.round("similarity", 6).alias("similarity"), "dropped")


@query()
def v01_entity_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """Entities as fused vectors of name, description and context, by the offline encoder (no SQL: hash function)."""
    texts = records.entity_texts(current_nodes(spark, folder).withColumnRenamed("entity_id", "id"))
    return vector.encode_fields(texts, "id", {"name_text": 0.40, "description_text": 0.25, "context_text": 0.35})


@query()
def c01_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings clustered by density within each label (no SQL: hierarchy)."""
    rows = table(spark, folder, "embeddings").select(F.col("label").alias("group_id"), F.col("vec_id").alias("id"), "embedding")
    return cluster.cluster(rows)


@query()
def c05_split_policy(spark: SparkSession, folder: str) -> DataFrame:
    """How the members of each cluster would be passed on."""
    found = cut(c01_clusters(spark, folder))
    sizes = found.groupBy("group_id").agg(F.count("*").alias("n"), F.countDistinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("subclusters"))
    return cluster.split_policy(sizes).select("group_id", "n", "subclusters", "policy")
