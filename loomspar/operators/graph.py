"""Graph operators over edge tables (graph_id, source, target): collapse, components, clustering, expansion.

All work on many graphs at once, keyed by graph_id; nothing is collected and no graph has to fit into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspar.runtime import cut


def collapse(edges: DataFrame, order: str = "seq") -> DataFrame:
    """Parallel edges become one, with the relation of the last: (graph_id, source, target, relation)."""
    return edges.filter("source is not null and target is not null").groupBy("graph_id", "source", "target").agg(F.max_by("relation", order).alias("relation"))


def nodes_of(edges: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """(graph_id, node): end points and, if given, entities without edges."""
    ends = edges.select("graph_id", F.explode(F.array("source", "target")).alias("node"))
    return (ends if entities is None else ends.unionByName(entities.select("graph_id", "node"))).filter("node is not null").distinct()


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(graph_id, node, component): weakly connected components, named by their smallest node.

    Alternating large-star and small-star steps: the number of rounds grows with the logarithm of the size, and a
    node with many neighbours is aggregated by minimum, never gathered.
    """
    pairs = edges.filter("source <> target").select("graph_id", F.greatest("source", "target").alias("u"), F.least("source", "target").alias("v")).distinct()
    pairs = cut(pairs)
    while True:
        both = pairs.unionByName(pairs.select("graph_id", F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("graph_id", "u").agg(F.min("v").alias("m")).select("graph_id", "u", F.least("m", "u").alias("m"))
        large = both.join(least, ["graph_id", "u"]).filter("v > u").select("graph_id", F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("graph_id", "u").agg(F.min("v").alias("m"))
        small = large.join(least, ["graph_id", "u"]).select("graph_id", F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        following = cut(small)
        if following.join(pairs, ["graph_id", "u", "v"], "left_anti").isEmpty() and pairs.join(following, ["graph_id", "u", "v"], "left_anti").isEmpty():
            break
        pairs = following
    roots = pairs.groupBy("graph_id", F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return nodes.join(roots, ["graph_id", "node"], "left").select("graph_id", "node", F.coalesce("component", "node").alias("component"))


def clustering(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(graph_id, node, degree, triangles, coefficient) on the undirected simple graph; below two neighbours it is 0.

    Edges point from the node of lower degree to that of higher, so a hub has few outgoing ones and no more than
    the root of all edges are paired at one node.
    """
    plain = cut(edges.filter("source <> target").select("graph_id", F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct())
    degree = cut(plain.select("graph_id", F.explode(F.array("a", "b")).alias("node")).groupBy("graph_id", "node").agg(F.count("*").alias("degree")))
    rank = lambda s: degree.select("graph_id", F.col("node").alias(s), F.col("degree").alias(f"d{s}"))
    sized = plain.join(rank("a"), ["graph_id", "a"]).join(rank("b"), ["graph_id", "b"])
    first = F.struct(F.col("da").alias("d"), F.col("a").alias("n")) < F.struct(F.col("db").alias("d"), F.col("b").alias("n"))
    directed = cut(sized.select("graph_id", F.when(first, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("v")))
    wedge = directed.alias("x").join(directed.alias("y"), F.expr("x.graph_id = y.graph_id and x.u = y.u and x.v < y.v")).select("x.graph_id", F.col("x.u").alias("u"), F.col("x.v").alias("a"), F.col("y.v").alias("b"))
    closed = wedge.join(plain, ["graph_id", "a", "b"])
    triangles = closed.select("graph_id", F.explode(F.array("u", "a", "b")).alias("node")).groupBy("graph_id", "node").agg(F.count("*").alias("triangles"))
    out = nodes.join(degree, ["graph_id", "node"], "left").join(triangles, ["graph_id", "node"], "left").na.fill(0, ["degree", "triangles"])
    return out.withColumn("coefficient", F.when(F.col("degree") > 1, 2 * F.col("triangles") / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0))


def expand(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(graph_id, node, hop): nodes within so many hops of the seeds (graph_id, node), in both directions; seeds have hop 0."""
    both = edges.select("graph_id", "source", "target").unionByName(edges.select("graph_id", F.col("target").alias("source"), F.col("source").alias("target"))).filter("source is not null and target is not null").distinct()
    found = seeds.select("graph_id", "node").distinct().withColumn("hop", F.lit(0))
    frontier = found
    for hop in range(1, hops + 1):
        step = frontier.select("graph_id", F.col("node").alias("source")).join(both, ["graph_id", "source"]).select("graph_id", F.col("target").alias("node")).distinct()
        frontier = cut(step.join(found, ["graph_id", "node"], "left_anti").withColumn("hop", F.lit(hop)))
        found = found.unionByName(frontier)
    return found


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges with both ends among the nodes (graph_id, node)."""
    ends = nodes.select("graph_id", "node").distinct()
    return edges.join(ends.withColumnRenamed("node", "source"), ["graph_id", "source"], "left_semi").join(ends.withColumnRenamed("node", "target"), ["graph_id", "target"], "left_semi")


def measures(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Size and structure of every graph: one row for each graph_id of the entities or edges."""
    nodes = cut(nodes_of(edges, entities))
    size = nodes.groupBy("graph_id").agg(F.count("*").alias("n_nodes"))
    links = edges.groupBy("graph_id").agg(F.count("*").alias("n_edges"), F.countDistinct(F.nullif("relation", F.lit(""))).alias("n_types"))
    parts = components(edges, nodes).groupBy("graph_id", "component").agg(F.count("*").alias("n")).groupBy("graph_id").agg(F.count("*").alias("n_components"), F.max("n").alias("largest"))
    local = clustering(edges, nodes).groupBy("graph_id").agg(F.avg("coefficient").alias("avg_clustering"))
    n, m = F.col("n_nodes"), F.col("n_edges")
    return (
        size.join(links, "graph_id", "left").join(parts, "graph_id").join(local, "graph_id").na.fill(0, ["n_edges", "n_types"])
        .withColumns({"avg_degree": m / F.greatest(n, F.lit(1)), "density": F.when(n > 1, m / (n * (n - 1))).otherwise(0.0), "largest_share": F.col("largest") / n, "type_diversity": F.col("n_types") / F.greatest(m, F.lit(1))})
    )
