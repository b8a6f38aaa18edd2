"""Duplicates hidden by formatting differences (problem 5).

Method: dictionary encoding. Each distinct value is canonicalised once and gets an integer; records are rewritten
as sorted (field, integer) tuples and the compact tuples are grouped. Hot values (a relation name may be in a third
of all records) are spread when the integers are joined back, hot tuples when copies are listed.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loomspar.runtime import cut, spread_lookup, table

_IGNORED = regex.compile(r"[^\p{L}\p{M}\p{N}]+")
FIELDS = ("head", "relation", "tail")


def canonical(value: str) -> str:
    """Letters and digits of value in order, without case; accents count, however they are encoded."""
    return _IGNORED.sub("", unicodedata.normalize("NFC", unicodedata.normalize("NFC", value).casefold()))


@F.pandas_udf(StringType())
def _canonical(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in values:
        yield batch.map(canonical)


def encode(cells: DataFrame) -> DataFrame:
    """Dictionary of the column ``value`` of cells: (value, code, n). Equal codes mean equal but for formatting.

    Null values have no entry. n is the number of cells with the value.
    """
    values = cut(cells.filter("value is not null").groupBy("value").agg(F.count("*").alias("n")).withColumn("canon", _canonical("value")))
    codes = cut(values.select("canon").distinct().withColumn("code", F.monotonically_increasing_id()))
    return cut(values.join(codes, "canon").select("value", "code", "n"))


def copies(tuples: DataFrame, unit: str = "id") -> DataFrame:
    """(kept_id, copy_id) of all records with equal ``key``: kept_id is the smallest id, copy_id every other one.

    tuples has the columns ``unit`` and ``key``, one row for each id. A key with one record has no row here; repeated
    rows of an id count once. A key that holds a large share of the records is spread over several tasks.
    """
    groups = cut(tuples.groupBy("key").agg(F.min(unit).alias("kept_id"), F.count("*").alias("n")).filter("n > 1"))
    found = spread_lookup(tuples, groups, "key", "n", unit)
    return found.filter(F.col(unit) > F.col("kept_id")).select("kept_id", F.col(unit).alias("copy_id")).distinct()


def counts(tuples: DataFrame, unit: str = "id") -> DataFrame:
    """(kept_id, n): the smallest id of each ``key`` and how many records have it, itself counted."""
    return tuples.groupBy("key").agg(F.min(unit).alias("kept_id"), F.count("*").alias("n")).select("kept_id", "n")


def record_copies(records: DataFrame, unit: str, fields: tuple[str, ...]) -> DataFrame:
    """(kept_id, copy_id) of records that are equal by ``record_keys``."""
    return copies(record_keys(records, unit, fields))


def record_keys(records: DataFrame, unit: str, fields: tuple[str, ...]) -> DataFrame:
    """(id, key) of records; those are equal that are so in all fields but for case, punctuation and whitespace.

    A record with a null field is no record. Empty values, and values without letters or digits, equal one another.
    """
    whole = records.dropna(subset=[unit, *fields]).select(F.col(unit).alias("id"), *fields)
    cells = whole.select("id", F.posexplode(F.array(*(F.col(f).cast("string") for f in fields))).alias("field", "value"))
    coded = spread_lookup(cells, encode(cells), "value", "n", "id")
    return coded.groupBy("id").agg(F.sort_array(F.collect_set(F.struct("field", "code"))).alias("key"))


def payload_fields(payload: Column, fields: tuple[str, ...] = FIELDS) -> list[Column]:
    """The fields of a JSON object by name in any case; all null where the text is no whole JSON object."""
    entries = F.map_entries(F.from_json(payload, "map<string,string>"))
    whole = F.rtrim(payload, F.lit(" \t\r\n")).endswith("}")


    def named(field: str) -> Column:
        return F.get(F.filter(entries, lambda e: F.lower(F.trim(e["key"])) == field), F.lit(0))["value"]

    return [F.when(whole, named(f)).alias(f) for f in fields]


def graph_copies(graphs: DataFrame, unit: str, entities: str, relations: str) -> DataFrame:
    """(kept_id, copy_id) of graphs that are equal by ``graph_keys``."""
    return copies(graph_keys(graphs, unit, entities, relations))


def graph_keys(graphs: DataFrame, unit: str, entities: str, relations: str) -> DataFrame:
    """(id, key) of graphs; those are equal that have equal sets of entities and of relations but for formatting.

    Elements of relations that don't have three parts are no relations and are left out; repeated elements count
    once; a null list is an empty one. Null entities, and relations with a null part, are left out as well.
    """
    graphs = graphs.filter(F.col(unit).isNotNull()).select(F.col(unit).alias("id"), F.col(entities).alias("e"), F.col(relations).alias("r"))
    nodes = graphs.select("id", F.explode("e").alias("value")).select("id", F.lit(-1).alias("relation"), F.lit(0).alias("field"), "value")
    triples = graphs.select("id", F.posexplode("r").alias("relation", "parts")).filter("size(parts) = 3 and not exists(parts, x -> x is null)")
    cells = nodes.unionByName(triples.select("id", "relation", F.posexplode("parts").alias("field", "value")))
    coded = spread_lookup(cells, encode(cells), "value", "n", "id")
    items = coded.groupBy("id", "relation").agg(
        F.sort_array(F.collect_set(F.struct("field", "code"))).alias("item"),
    )
    sets = items.select("id", F.when(F.col("relation") < 0, F.transform("item", lambda x: F.array(x["code"]))).otherwise(F.array(F.transform("item", lambda x: x["code"]))).alias("items"))
    keys = sets.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("key"))
    empty = graphs.select("id").join(keys, "id", "left_anti").select("id", F.array().cast("array<array<bigint>>").alias("key"))
    return keys.unionByName(empty)


def _keys(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    raw = table(spark, folder, "raw_relations").select("record_id", *payload_fields(F.col("payload")))
    return {"relation": record_keys(raw, "record_id", FIELDS), "graph": graph_keys(table(spark, folder, "baseline_kg"), "graph_id", "entities", "relations")}


def found(spark: SparkSession, folder: str) -> DataFrame:
    """p5_found: copies of relation records and of whole graphs."""
    relations, graphs = (copies(k).select(F.lit(kind).alias("kind"), "kept_id", "copy_id") for kind, k in _keys(spark, folder).items())
    return relations.unionByName(graphs)


def counted(spark: SparkSession, folder: str) -> DataFrame:
    """p5_counts: one of each relation record and graph with the number of its copies, itself counted."""
    relations, graphs = (counts(k).select(F.lit(kind).alias("kind"), "kept_id", "n") for kind, k in _keys(spark, folder).items())
    return relations.unionByName(graphs)
