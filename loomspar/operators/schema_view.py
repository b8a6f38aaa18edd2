"""The schema that a knowledge graph shows: trees, rollups, domains and ranges, data properties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspar.functions import text as T
from loomspar.operators.records import UNSET, is_set


def filled(c: str, default: str = UNSET) -> Column:
    return F.coalesce(F.nullif(T.safe_text(c), F.lit("")), F.lit(default))


def entity_tree(nodes: DataFrame) -> DataFrame:
    """Entities by group and class with subtotals (``*``)."""
    rows = nodes.select(filled("class_group").alias("g"), filled("class_label").alias("c"))
    return rows.rollup("g", "c").agg(F.count("*").alias("entities")).select(F.coalesce("g", F.lit("*")).alias("class_group"), F.coalesce("c", F.lit("*")).alias("class_label"), "entities")


def relation_tree(relations: DataFrame) -> DataFrame:
    """Relations by group, class, canonical and raw name with subtotals (``*``)."""
    rows = relations.select(filled("rel_cls_group").alias("g"), filled("rel_cls").alias("c"), filled("canonical_rel_name").alias("n"), filled("raw_relation_name", "<raw:N/A>").alias("w"))
    star = lambda c, name: F.coalesce(c, F.lit("*")).alias(name)
    return rows.rollup("g", "c", "n", "w").agg(F.count("*").alias("relations")).select(star("g", "rel_cls_group"), star("c", "rel_cls"), star("n", "name"), star("w", "raw"), "relations")


def _first(rows: DataFrame, keys: list[str], value: str, n: int) -> DataFrame:
    """(keys, values): the n smallest distinct values of each group. Partial lists are cut to n before anything is moved."""
    ranked = rows.select(*keys, value).distinct().withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(value)))
    return ranked.filter(F.col("_n") <= n).groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("values"))


def relation_rollups(relations: DataFrame) -> DataFrame:
    """Resolved relations by canonical name, class and group: (level, label, instances, names, description, first_ids)."""
    rows = relations.filter(is_set("canonical_rel_name")).select(
        "relation_id", F.nullif(T.safe_text("canonical_rel_desc"), F.lit("")).alias("d"), T.safe_text("canonical_rel_name").alias("name"),
        F.explode(F.array(F.struct(F.lit("name").alias("level"), T.safe_text("canonical_rel_name").alias("label")), F.struct(F.lit("class").alias("level"), filled("rel_cls").alias("label")), F.struct(F.lit("group").alias("level"), filled("rel_cls_group").alias("label")))).alias("x"),
    ).select("relation_id", "d", "name", "x.*")
    each = rows.groupBy("level", "label").agg(F.count("*").alias("instances"), F.countDistinct("name").alias("names"), F.min("d").alias("description"))
    return each.join(_first(rows, ["level", "label"], "relation_id", 10), ["level", "label"]).select("level", "label", "instances", "names", "description", F.array_join("values", ",").alias("first_ids"))


def relations_by_name(relations: DataFrame) -> DataFrame:
    """Named relations: instances, distinct domain and range classes, distinct surface forms. relations have the classes of their ends."""
    rows = relations.filter(T.safe_text("canonical_rel_name") != "").withColumn("name", F.col("canonical_rel_name"))
    filled_class = lambda c: F.nullif(T.safe_text(c), F.lit(""))
    return rows.groupBy("name").agg(F.count("*").alias("relations"), F.countDistinct(filled_class("start_class")).alias("domains"), F.countDistinct(filled_class("end_class")).alias("ranges"), F.countDistinct(T.safe_text("raw_relation_name")).alias("surfaces"))


def domain_range(relations: DataFrame) -> DataFrame:
    """Classes at both ends of each relation, and its first 25 pairs of names."""
    rows = relations.select(filled("canonical_rel_name").alias("name"), filled("start_class").alias("d"), filled("end_class").alias("r"), F.concat(F.coalesce("start_name", F.lit("")), F.lit(" -> "), F.coalesce("end_name", F.lit(""))).alias("x"))
    each = rows.groupBy("name").agg(F.array_join(F.sort_array(F.collect_set("d")), "|").alias("domains"), F.array_join(F.sort_array(F.collect_set("r")), "|").alias("ranges"), F.count("*").alias("relations"))
    return each.join(_first(rows, ["name"], "x", 25), "name").select("name", "domains", "ranges", "relations", F.array_join("values", " ; ").alias("examples"))


def data_properties(nodes: DataFrame) -> DataFrame:
    """Property names over all entities (``*``) and by group and class."""
    properties = F.from_json("node_properties", "array<struct<prop_name:string,prop_value:string>>")
    rows = nodes.select(filled("class_group").alias("g"), filled("class_label").alias("c"), F.explode(properties).alias("p")).select("g", "c", T.safe_text("p.prop_name").alias("name")).filter("name <> ''")
    each = rows.groupBy("g", "c", "name").agg(F.count("*").alias("n"))
    return each.select(F.col("g").alias("class_group"), F.col("c").alias("class_label"), "name", "n").unionByName(each.groupBy("name").agg(F.sum("n").alias("n")).select(F.lit("*").alias("class_group"), F.lit("*").alias("class_label"), "name", "n"))
