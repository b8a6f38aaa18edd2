"""Projections and joins of entity and relation records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspar.functions import text as T

# The broad relation groups and the keys of qualifiers.
RELATION_GROUPS = ("IDENTITY", "COMPOSITION", "CAUSALITY", "TEMPORALITY", "SPATIALITY", "ROLE", "PURPOSE", "DEPENDENCY", "COUPLING", "TRANSFORMATION", "COMPARISON", "INFORMATION", "ASSOCIATION")
QUALIFIERS = ("TemporalQualifier", "SpatialQualifier", "OperationalConstraint", "ConditionExpression", "UncertaintyQualifier", "CausalHint", "LogicalMarker", "OtherQualifier")
UNSET = "TBD"


def keep(rows: DataFrame, key: list[str], order: list[Column | str], last: bool = True) -> DataFrame:
    """One row for each key: the last (or first) in the given order. Order by every column that can differ, so that ties are equal rows."""
    struct = F.struct(F.struct(*order).alias("_by"), *[F.col(c) for c in rows.columns if c not in key])
    best = rows.groupBy(*key).agg((F.max if last else F.min)(struct).alias("_row"))
    return best.select(*key, *[F.col(f"_row.{c}").alias(c) for c in rows.columns if c not in key])


def is_set(c: Column | str) -> Column:
    """Neither null nor blank nor TBD."""
    v = T.safe_text(c)
    return (v != "") & (F.upper(v) != UNSET)


def clean_entities(raw: DataFrame) -> DataFrame:
    """Entities as extracted (entity_name, entity_description, entity_type_hint, confidence, node_properties json, chunk_id): unnamed ones dropped, defaults set, id from content."""
    properties = F.from_json("node_properties", "array<struct<prop_name:string,prop_value:string,justification:string>>")
    return raw.filter(T.safe_text("entity_name") != "").select(
        T.content_id("En_", 8, "chunk_id", "entity_name", "entity_description").alias("id"), "chunk_id", T.safe_text("entity_name").alias("entity_name"), T.safe_text("entity_description").alias("entity_description"),
        F.coalesce(T.first_filled("entity_type_hint"), F.lit("Other")).alias("entity_type_hint"), T.to_double("confidence").alias("confidence"),
        F.coalesce(F.filter(properties, lambda p: T.safe_text(p["prop_name"]) != ""), F.array().cast("array<struct<prop_name:string,prop_value:string,justification:string>>")).alias("node_properties"),
    )


def entity_texts(entities: DataFrame) -> DataFrame:
    """(id, name_text, description_text, context_text): the fields that are embedded. node_properties is JSON text."""
    properties = F.from_json("node_properties", "array<struct<prop_name:string,prop_value:string>>")
    shown = F.array_join(F.transform(F.filter(properties, lambda p: T.safe_text(p["prop_name"]) != ""), lambda p: F.concat(T.safe_text(p["prop_name"]), F.lit(":"), T.safe_text(p["prop_value"]))), " | ")
    kind = F.when(T.safe_text("entity_type_hint") != "", F.concat(F.lit("[TYPE:"), T.safe_text("entity_type_hint"), F.lit("]")))
    context = F.concat_ws(" ; ", kind, F.nullif(T.safe_text("entity_resolution_context"), F.lit("")), F.nullif(shown, F.lit("")))
    return entities.select("id", T.safe_text("entity_name").alias("name_text"), T.safe_text("entity_description").alias("description_text"), context.alias("context_text"))


def relation_texts(relations: DataFrame) -> DataFrame:
    """(relation_id, name_text, description_text, ends_text, hint_text) of relations with the names and classes of their ends."""
    side = lambda p: F.concat(T.safe_text(f"{p}_name"), F.lit(" ("), T.safe_text(f"{p}_class"), F.lit(", "), T.safe_text(f"{p}_group"), F.lit(")"))
    hints = F.array(*(T.safe_text(c) for c in ("rel_hint_type", "canonical_rel_name", "canonical_rel_desc", "rel_cls")))
    return relations.select(
        "relation_id", F.substring(T.safe_text("raw_relation_name"), 1, 256).alias("name_text"), F.substring(T.safe_text("rel_desc"), 1, 512).alias("description_text"),
        F.substring(F.concat(side("start"), F.lit(" -> "), side("end")), 1, 512).alias("ends_text"),
        F.substring(F.array_join(F.filter(hints, lambda x: (x != "") & (F.upper(x) != UNSET)), " ; "), 1, 512).alias("hint_text"),
    )


def with_ends(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Relations left joined with name, class and group of both ends; a name is the id where the node is unknown."""
    side = lambda p: nodes.select(F.col("entity_id").alias(f"{p}_id"), T.first_filled("entity_name").alias(f"{p}_name"), F.col("class_label").alias(f"{p}_class"), F.col("class_group").alias(f"{p}_group"))
    out = relations.join(side("start"), "start_id", "left").join(side("end"), "end_id", "left")
    return out.withColumns({"start_name": F.coalesce("start_name", "start_id"), "end_name": F.coalesce("end_name", "end_id")})


def with_default_qualifiers(relations: DataFrame) -> DataFrame:
    """``qualifiers`` as a map that has all standard keys, null where nothing was given."""
    given = F.coalesce(F.from_json("qualifiers", "map<string,string>"), F.create_map().cast("map<string,string>"))
    missing = F.map_from_arrays(F.array_except(F.array(*map(F.lit, QUALIFIERS)), F.map_keys(given)), F.transform(F.array_except(F.array(*map(F.lit, QUALIFIERS)), F.map_keys(given)), lambda _: F.lit(None).cast("string")))
    return relations.withColumn("qualifiers", F.map_concat(given, missing))


def upsert_nodes(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """Nodes with what relations know of their ends: only empty fields are filled, chunk ids are united, unknown ends become nodes.

    nodes: entity_id, entity_name, class_label, chunks array; relations: seq, start_id, end_id, start_name, end_name, start_class, end_class, chunk_id.
    """
    empty = lambda c: F.nullif(F.trim(c), F.lit(""))
    own = nodes.select("entity_id", F.lit(-1).cast("bigint").alias("seq"), empty(F.col("entity_name")).alias("name"), empty(F.col("class_label")).alias("label"), "chunks")
    ends = [relations.select(F.col(f"{p}_id").alias("entity_id"), (F.col("seq") * 2 + n).alias("seq"), empty(F.col(f"{p}_name")).alias("name"), empty(F.col(f"{p}_class")).alias("label"), F.array_compact(F.array("chunk_id")).alias("chunks")) for n, p in enumerate(("start", "end"))]
    rows = own.unionByName(ends[0]).unionByName(ends[1]).filter("entity_id is not null")
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("seq", c)))[c]
    each = rows.groupBy("entity_id").agg(first("name").alias("entity_name"), first("label").alias("class_label"), F.max(F.col("seq") == -1).alias("listed"))
    # a hub stands in very many relations: chunk ids are made distinct before they are gathered
    chunks = rows.select("entity_id", F.explode("chunks").alias("chunk")).distinct().groupBy("entity_id").agg(F.sort_array(F.collect_list("chunk")).alias("chunks"))
    return each.join(chunks, "entity_id", "left").withColumn("chunks", F.coalesce("chunks", F.array().cast("array<string>")))


def misaligned(items: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """(key, problem): ids that only one side has, and ids that a side has more than once."""
    left, right = items.select(key), other.select(key)
    parts = [
        left.distinct().join(right, key, "left_anti").select(key, F.lit("missing_right").alias("problem")), right.distinct().join(left, key, "left_anti").select(key, F.lit("missing_left").alias("problem")),
        left.groupBy(key).count().filter("count > 1").select(key, F.lit("repeated_left").alias("problem")), right.groupBy(key).count().filter("count > 1").select(key, F.lit("repeated_right").alias("problem")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def numbered(rows: DataFrame, group: list[str], order: list[Column | str], name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
