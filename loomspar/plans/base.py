"""What several query modules share: registration, and the graph tables in current form with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspar.operators import records
from loomspar.runtime import table


class Registry:
    def __init__(self) -> None:
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def add(f):
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add


NODES = "nodes as (select * from kg_nodes where entity_id is not null qualify row_number() over (partition by entity_id order by loaded_at desc, extracted_at desc) = 1)"
RELS = "rels as (select * from kg_rels where relation_id is not null qualify row_number() over (partition by relation_id order by loaded_at desc, seq desc) = 1)"
GRAPHS = """edges0 as (
  select graph_id, pos, lower(r[1]) as source, lower(r[2]) as relation, lower(r[3]) as target
  from (select graph_id, unnest(relations) as r, generate_subscripts(relations, 1) as pos from baseline_kg) where len(r) = 3
), edges as (select graph_id, source, target, arg_max(relation, pos) as relation from edges0 where source is not null and target is not null group by all
), vertices as (
  select distinct graph_id, lower(x) as node from (select graph_id, unnest(entities) as x from baseline_kg) where x is not null
  union select graph_id, source from edges union select graph_id, target from edges)"""


def current_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Each entity as it was delivered last."""
    rows = table(spark, folder, "kg_nodes").filter("entity_id is not null")
    return records.keep(rows, ["entity_id"], ["loaded_at", "extracted_at"])


def current_rels(spark: SparkSession, folder: str) -> DataFrame:
    """Each relation as it was delivered last."""
    return records.keep(table(spark, folder, "kg_rels").filter("relation_id is not null"), ["relation_id"], ["loaded_at", "seq"])


def graph_edges(spark: SparkSession, folder: str) -> DataFrame:
    """(graph_id, seq, source, relation, target) of all three-part relations of the graphs, in lower case."""
    rows = table(spark, folder, "baseline_kg").select("graph_id", F.posexplode("relations").alias("seq", "r")).filter("size(r) = 3")
    return rows.select("graph_id", "seq", *(F.lower(F.col("r")[n]).alias(c) for n, c in enumerate(("source", "relation", "target"))))


def graph_entities(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "baseline_kg").select("graph_id", F.explode("entities").alias("node")).select("graph_id", F.lower("node").alias("node"))
