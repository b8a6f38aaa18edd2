import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspar.operators import cluster, graph, metrics, records, resolve, vector
from loomspar.runtime import spread_lookup

EDGES = "graph_id int, seq int, source string, relation string, target string"


def edges(spark, pairs):
    return spark.createDataFrame([(g, n, a, "r", b) for n, (g, a, b) in enumerate(pairs)], EDGES)


def test_collapse(spark):
    df = spark.createDataFrame([(1, 0, "a", "r1", "b"), (1, 1, "a", "r2", "b"), (1, 2, None, "x", "b")], EDGES)
    assert [tuple(r) for r in graph.collapse(df).collect()] == [(1, "a", "b", "r2")]


def test_triangle_and_isolated(spark):
    df = edges(spark, [(1, "a", "b"), (1, "b", "c"), (1, "c", "a")])
    lone = spark.createDataFrame([(1, "d")], "graph_id int, node string")
    r = graph.measures(graph.collapse(df), lone).first()
    assert (r["avg_degree"], r["density"], r["n_components"], r["largest_share"], r["avg_clustering"]) == (0.75, 0.25, 2, 0.75, 0.75)


def test_components_and_clustering_at_random(spark):
    rng = random.Random(1)
    pairs = [(g, str(rng.randrange(40)), str(rng.randrange(40))) for g in range(6) for _ in range(25 + 5 * g)] + [(9, str(n), str(n + 1)) for n in range(200)]
    df = edges(spark, pairs + pairs[:20])
    found = {}
    for r in graph.components(df, graph.nodes_of(df)).collect():
        found.setdefault((r["graph_id"], r["component"]), set()).add(r["node"])
    expected = []
    for g in {p[0] for p in pairs}:
        groups = []
        for _, a, b in (p for p in pairs if p[0] == g):
            touching = [x for x in groups if x & {a, b}]
            groups = [x for x in groups if x not in touching] + [set.union({a, b}, *touching)]
        expected += groups
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, expected))
    near = {}
    for g, a, b in pairs:
        if a != b:
            near.setdefault((g, a), set()).add(b), near.setdefault((g, b), set()).add(a)
    for r in graph.clustering(df, graph.nodes_of(df)).collect():
        n = near.get((r["graph_id"], r["node"]), set())
        t = sum(y in near[r["graph_id"], x] for x, y in itertools.combinations(n, 2))
        assert (r["degree"], r["triangles"]) == (len(n), t)


def test_expand(spark):
    df = edges(spark, [(1, "a", "b"), (1, "b", "c"), (1, "c", "d")])
    seeds = spark.createDataFrame([(1, "b"), (1, "zz")], "graph_id int, node string")
    assert {r["node"] for r in graph.expand(df, seeds, 1).collect()} == {"a", "b", "c", "zz"}


def test_merge_classes(spark):
    rows = [(0, "City ", "x", "d1", 0.5, "m1"), (1, "city", "X", "d2", 0.5, "m1"), (2, "CITY", "x", "", 0.9, "m2")]
    r = resolve.merge_classes(spark.createDataFrame(rows, "seq int, label string, hint string, description string, confidence double, member string")).first()
    assert (r["label"], r["confidence"], r["description"], r["members"]) == ("City ", 0.9, "d1", 2)


def test_merge_entities(spark):
    p = lambda *x: [{"prop_name": n, "prop_value": v, "justification": None} for n, v in x]
    rows = [("c", "e2", 1, "B", 0.8, p(("a", "1"), ("b", "2"))), ("c", "e1", 0, "A", None, p(("a", "1")))]
    r = resolve.merge_entities(spark.createDataFrame(rows, "canonical_id string, id string, seq int, name string, confidence double, properties array<struct<prop_name:string,prop_value:string,justification:string>>")).first()
    assert (r["name"], r["confidence"], r["merged_from"], len(r["properties"])) == ("A", 0.8, ["e1", "e2"], 2)


def test_merge_duplicate_edges(spark):
    rows = [(0, "a", "b", "n", '{"a":"1","b":"2"}'), (1, "a", "b", "n", '{"a":"1"}'), (2, "a", "b", "n", '{"c":"3"}'), (3, "a", "b", "TBD", "{}"), (4, "a", "b", "TBD", "{}"), (5, None, "b", "n", None), (6, None, "b", "n", None)]
    df = spark.createDataFrame(rows, "seq int, start_id string, end_id string, name string, qualifiers string").withColumns({"cls": F.lit("c"), "cls_group": F.lit(None).cast("string")})
    assert {r["seq"]: r["base_seq"] for r in resolve.merge_duplicate_edges(df).collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5}


def test_aliases_and_streaks(spark):
    ids = spark.createDataFrame([(str(n),) for n in range(9)], "id string")
    merges = spark.createDataFrame([(str(n), str(n - 1)) for n in range(1, 7)] + [("8", "8")], "id string, into string")
    assert {r["id"]: r["target"] for r in resolve.resolve_aliases(ids, merges).collect()} == {**{str(n): "0" for n in range(7)}, "7": "7", "8": "8"}
    log = spark.createDataFrame([(1, n, c) for n, c in enumerate([True, False, False, True, False])] + [(2, 0, True)], "g int, o int, c boolean")
    assert {r["g"]: r["streak"] for r in resolve.streaks(log, "g", "o", "c").collect()} == {1: 2, 2: 0}


def test_alias_chains_keep_the_plan_small(spark):
    n = 300
    ids = spark.range(n).select(F.col("id").cast("string").alias("id"))
    merges = spark.range(1, n).select(F.col("id").cast("string").alias("id"), (F.col("id") - 1).cast("string").alias("into"))
    out = resolve.resolve_aliases(ids, merges)
    assert out._jdf.queryExecution().analyzed().collectLeaves().size() <= 2 * n.bit_length()
    assert {tuple(r) for r in out.collect()} == {(str(k), "0") for k in range(n)}


def test_alias_cycles(spark):
    # a cycle of two with tails, one of seven, a chain beside them, and no merges at all
    pairs = [("a", "b"), ("b", "a"), ("t", "a"), ("u", "t"), ("v", "b"), ("x", "y"), ("y", "z")] + [(f"c{k}", f"c{(k + 1) % 7}") for k in range(7)]
    ids = spark.createDataFrame([(i,) for i, _ in pairs] + [("z",), ("alone",), ("a",)], "id string")
    got = sorted(tuple(r) for r in resolve.resolve_aliases(ids, spark.createDataFrame(pairs, "id string, into string")).collect())
    stay = ["a", "a", "b", "z", "alone", *(f"c{k}" for k in range(7))]
    assert got == sorted([(i, i) for i in stay] + [("t", "a"), ("u", "a"), ("v", "b"), ("x", "z"), ("y", "z")])
    assert {tuple(r) for r in resolve.resolve_aliases(ids, spark.createDataFrame([], "id string, into string")).collect()} == {(i, i) for i in {r["id"] for r in ids.collect()}}


def test_groups_share_batches(spark):
    # one call for each group would cost more than its work: many groups are in one batch, and calls go only to documents that have some
    rows = [(g, 10 * g + n, [float(v), 1.0]) for g in range(300) for n, v in enumerate((0, 0.1, 9, 9.2, 50))] + [(900, 9000, [1.0, 2.0]), (None, 9100, [0.0, 1.0])]
    found = cluster.cluster(spark.createDataFrame(rows, "group_id bigint, id bigint, embedding array<double>"))
    assert "InPandas" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r["group_id"], r["id"]): r["cluster"] for r in found.collect()}
    assert got == {(g, i): ([0, 0, 1, 1, -1][i % 10] if g is not None and g < 300 else -1) for g, i, _ in rows}
    classes = spark.createDataFrame([(d, f"c{n}", label, "", "TBD", None if d == 2 else 0.5, ["a", "b", "a"]) for d in (1, 2) for n, label in enumerate(("x", "y"))], "doc_id bigint, class_id string, label string, description string, class_group string, confidence double, members array<string>")
    calls = spark.createDataFrame([(1, 1, "modify_class", '{"class_id":"c1","name":"w"}'), (1, 0, "modify_class", '{"class_id":"c1","name":"v"}'), (1, 2, "merge_classes", '{"class_ids":["c0"]}'), (3, 0, "create_class", '{"name":"new","members":["q"]}')], "doc_id bigint, seq int, name string, args string")
    folded = resolve.fold_class_actions(classes, calls)
    assert "InPandas" in (plan := folded._jdf.queryExecution().executedPlan().toString()) and "FlatMap" not in plan
    assert sorted((r["doc_id"], r["label"], r["confidence"], r["members"], r["errors"]) for r in folded.collect()) == [(1, "w", 0.5, ["a", "b"], 1), (1, "x", 0.5, ["a", "b"], 1), (2, "x", None, ["a", "b"], 0), (2, "y", None, ["a", "b"], 0), (3, "new", 0.5, ["q"], 0)]


def test_relation_merge_turns_direction(spark):
    rows = [("r1", 0, "A", "B", "n", 0.5, "{}", "x"), ("r2", 1, "B", "A", "n", 0.7, "{}", "y"), ("r3", 2, "A", "C", "n", 0.1, "{}", "")]
    rel = spark.createDataFrame(rows, "relation_id string, seq int, start_id string, end_id string, name string, confidence double, qualifiers string, remark string")
    merges = spark.createDataFrame([("m1", 0, ["r1", "r2"], "p"), ("m2", 1, ["r1", "r3"], "p"), ("m3", 2, ["r3"], "p")], "merge_id string, seq int, ids array<string>, name string")
    got = resolve.fold_relation_merges(rel, merges).collect()
    assert [(r["merged_from"], r["reversed"], r["confidence"], r["remarks"]) for r in got] == [(["r1", "r2"], 1, 0.7, ["x", "y"])]


def test_class_calls():
    c = lambda i, m: {"class_id": i, "label": i, "description": "", "class_group": "TBD", "confidence": 0.3, "members": m}
    s = resolve.ClassStore([c("a", ["1", "2"]), c("b", ["2", "3"]), c("d", ["9"])])
    assert s.apply("merge_classes", {"class_ids": ["a", "b"], "provisional_id": "p"}) == "done" and s.apply("merge_classes", {"class_ids": ["d"]}) == "error"
    assert s.apply("modify_class", {"class_id": "p", "name": "new"}) == "done" and s.classes[s.find("a")]["members"] == ["1", "2", "3"]
    assert s.apply("split_class", {"class_id": "p", "parts": [{"name": "x", "members": ["1"]}, {"members": ["1"]}]}) == "done" and s.classes[s.find("p")]["members"] == ["2", "3"]
    assert s.apply("reassign_entities", {"members": ["2"], "from": None, "to": "d"}) == "done" and s.classes["d"]["members"] == ["9", "2"] and s.classes["d"]["confidence"] == 0.4
    assert s.apply("reassign_entities", {"members": ["2"], "to": None}) == "error" and s.classes["d"]["members"] == ["9", "2"]
    assert s.apply("create_class", {}) == "error" and s.apply("create_class", {"name": "n"}) == "done" and s.apply("other", {}) == "unknown"
    old = resolve.ClassStore([c("d", ["9"])], compat_null_target=True)
    assert old.apply("reassign_entities", {"members": ["9"], "to": None}) == "error" and old.classes["d"]["members"] == []


def judged(spark, rows):
    return spark.createDataFrame(rows, "ref_label string, item_label string, judgement string, usable boolean, rank int, confidence double")


def test_rank_metrics(spark):
    j = judged(spark, [("a", "x", "Equivalent", True, 1, 0.1), ("b", "y", "Equivalent", True, 2, 0.2), ("c", "z", "Unrelated", False, 1, 0.3), ("c", "w", "Narrower", True, 9, 0.4)])
    w = spark.createDataFrame([("a", 2), ("b", 1), ("c", 1), ("off", 0)], "ref_label string, weight int")
    got = {r["mode"]: r for r in metrics.coverage(metrics.per_anchor(j), w, 3).collect()}
    assert (got["exact"]["hits"], got["exact"]["mrr"], got["compat"]["coverage"], got["compat"]["refinement"]) == (0.75, 0.625, 1.0, 0.25)
    s = metrics.judge_statistics(j).first()
    assert (s["confidence_p50"], s["confidence_p90"], s["equivalent"]) == (0.3, 0.3, 2)
    assert metrics.coverage(metrics.per_anchor(j), w.filter("weight > 9"), 3).first()["coverage"] == 0.0


def test_average_precision(spark):
    rng = random.Random(2)
    pairs = [(round(rng.random(), 1), rng.randrange(2)) for _ in range(200)]
    total, seen, tp, ap = sum(p for _, p in pairs), 0, 0, 0.0
    for s in sorted({s for s, _ in pairs}, reverse=True):
        n, p = sum(x == s for x, _ in pairs), sum(y for x, y in pairs if x == s)
        seen, tp = seen + n, tp + p
        ap += p / total * tp / seen
    df = spark.createDataFrame(pairs, "score double, positive int")
    assert metrics.average_precision(df).first()["ap"] == pytest.approx(ap)
    assert metrics.average_precision(df.filter("positive = 0")).first()["ap"] is None


def test_weights_and_ranks(spark):
    t = spark.createDataFrame([("train", "p"), ("test", "p"), ("all", "p")], "split string, predicate string")
    p = spark.createDataFrame([("p", "D", "")], "label string, domain string, range string")
    got = {(r["split"], r["label"]): r["weight"] for r in metrics.predicate_weights(t, p).collect()}
    assert got["all", "p"] == 4 and got["train", "D"] == 1
    s = spark.createDataFrame([("x", "m", 0.5), ("y", "m", 0.5)], "method string, metric string, mean double")
    assert {r["method"]: (r["rank"], r["scaled"]) for r in metrics.rank_methods(s, "method").collect()} == {"x": (1, 1.0), "y": (2, 1.0)}


def test_clusters():
    rng = np.random.default_rng(0)
    points = np.concatenate([rng.normal(c, 0.05, (20, 2)) for c in ((0, 0), (5, 0), (0, 5))])
    labels = cluster.density_clusters(points, 5)
    for k in range(3):
        part = labels[20 * k : 20 * k + 20]
        assert len({x for x in part if x >= 0}) <= 4 and not {x for x in part if x >= 0} & {x for x in np.delete(labels, slice(20 * k, 20 * k + 20)) if x >= 0}
    tree = cluster.spanning_tree(points)
    best, inside = 0.0, {0}
    d = np.linalg.norm(points[:, None] - points[None], axis=2)
    while len(inside) < len(points):  # another growth order, same weight
        w, b = min((d[a, b], b) for a in inside for b in range(len(points)) if b not in inside)
        best += w
        inside.add(b)
    assert tree[:, 2].sum() == pytest.approx(best)
    assert list(cluster.density_clusters(points[:1])) == [-1] and list(cluster.density_clusters(points[:0])) == []
    assert set(cluster.density_clusters(np.zeros((6, 2)))) <= {-1, 0, 1, 2}


def test_recluster_and_diagnose(spark):
    rng = np.random.default_rng(1)
    centres = [(0, 0), (0.5, 0), (9, 9)]
    rows = spark.createDataFrame([(0, k * 100 + n, [float(x) for x in rng.normal(c, 0.02)]) for k, c in enumerate(centres) for n in range(20)], "g int, id bigint, embedding array<double>")
    found = spark.createDataFrame([(0, k * 100 + n, 0 if k < 2 else 1) for k in range(3) for n in range(20)] + [(0, 999, -1)], "g int, id bigint, cluster int")
    out = {r["id"]: r for r in cluster.recluster(rows, found, "g", 30, 5).collect()}
    assert len(out) == 61 and all(out[200 + n]["part"] == -1 for n in range(20))
    assert {out[n]["part"] for n in range(20)} != {out[100 + n]["part"] for n in range(20)}
    row = cluster.diagnose(found, "g").first()
    assert row["clusters"] == 2 and row["largest"] == [40, 20] and abs(row["noise_share"] - 1 / 61) < 1e-9


def test_size_does_not_change_clusters(spark):
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.normal(c, 0.3, (60, 3)) for c in ((0, 0, 0), (4, 0, 0), (0, 4, 0))] + [np.round(rng.normal(0, 2, (60, 3)))])  # the last ones have equal distances
    data = [(g, n, [float(x) for x in v]) for g in (0, None) for n, v in enumerate(points)] + [(1, 500 + n, [float(n % 3)]) for n in range(20)]
    rows = spark.createDataFrame(data, "g int, id bigint, embedding array<double>")
    whole, blocks = ({(r["g"], r["id"]): r["cluster"] for r in cluster.cluster(rows, "g", 3, limit).collect()} for limit in (5000, 30))
    assert len(whole) == len(data) and whole == blocks


def test_search_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(300, 8))
    vectors[7] = vectors[3]
    rows = spark.createDataFrame([(n, [float(x) for x in v]) for n, v in enumerate(vectors)] + [(999, None)], "id bigint, embedding array<double>")
    monkeypatch.setattr(vector, "BLOCK", 4)
    got = {(r["query_id"], r["rank"]): r["id"] for r in vector.search(rows, rows.filter("id % 50 = 0"), 5).collect()}
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for q in range(0, 300, 50):
        order = np.lexsort((-np.arange(300), -np.round(unit @ unit[q], 12)))[:5]
        assert [got[q, k + 1] for k in range(5)] == list(order)


def test_records(spark):
    nodes = spark.createDataFrame([("a", "A", "", ["c1"])], "entity_id string, entity_name string, class_label string, chunks array<string>")
    rel = spark.createDataFrame([(0, "a", "b", "zzz", "B", "K", None, "c2")], "seq bigint, start_id string, end_id string, start_name string, end_name string, start_class string, end_class string, chunk_id string")
    got = {r["entity_id"]: (r["entity_name"], r["class_label"], r["chunks"]) for r in records.upsert_nodes(nodes, rel).collect()}
    assert got == {"a": ("A", "K", ["c1", "c2"]), "b": ("B", None, ["c2"])}


def test_spread_lookup(spark):
    facts = spark.createDataFrame([(n, "hot" if n % 3 else f"k{n % 7}") for n in range(3000)] + [(9999, None)], "id bigint, key string")
    dictionary = facts.filter("key is not null").groupBy("key").agg(F.count("*").alias("n")).withColumn("code", F.length("key"))
    got = spread_lookup(facts, dictionary, "key", "n", "id")
    assert got.columns == ["key", "id", "code"] and got.count() == 3000 and got.filter("code <> length(key)").isEmpty()
