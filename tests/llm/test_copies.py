import random

from loomspar.llm import copies


def brute(records):
    seen, out = {}, []
    for i, *fields in sorted(records):
        if any(f is None for f in fields):
            continue
        key = tuple(copies.canonical(f) for f in fields)
        if key in seen:
            out.append((seen[key], i))
        seen.setdefault(key, i)
    return sorted(out)


def found(spark, records):
    frame = spark.createDataFrame([(*r, "x", 1) for r in records], "i bigint, a string, b string, value string, n int")  # clashing names
    return sorted((r["kept_id"], r["copy_id"]) for r in copies.record_copies(frame.withColumnRenamed("value", "value"), "i", ("a", "b")).collect())


def test_against_brute_force(spark):
    rng = random.Random(5)
    forms = lambda w: rng.choice([w, w.upper(), f" {w}! ", w.replace("o", " o"), f"«{w}»", w.title()])
    base = ["moon orbiter", "école choir", "ecole choir", "feeds", "", "x1", "straße", None]
    records = [(n, *(forms(w) if w else w for w in (rng.choice(base), rng.choice(base)))) for n in range(400)]
    records += [(n, "hot", "hot") for n in range(400, 900)]  # one group holds more than half of the rows
    records += [(1000, "a" * 50_000, "b"), (1001, "A" * 50_000, "B")]
    assert found(spark, records + records[:50]) == brute(set(records))


def test_empty(spark):
    assert found(spark, []) == []
    graphs = spark.createDataFrame([], "g bigint, e array<string>, r array<array<string>>")
    assert copies.graph_copies(graphs, "g", "e", "r").count() == 0


def test_graphs(spark):
    rows = [
        (1, ["A", "b"], [["A", "is", "b"], ["x", "y"]]), (2, ["B ", "a", "A"], [["a", "IS", "B."], ["a", "is", "b"]]), (3, ["a", "b"], [["b", "is", "a"]]), (4, None, None), (5, [], []), (6, ["a", "b"], None), (None, [], []),
    ]
    graphs = spark.createDataFrame(rows, "g bigint, e array<string>, r array<array<string>>")
    assert sorted(tuple(r) for r in copies.graph_copies(graphs, "g", "e", "r").collect()) == [(1, 2), (4, 5)]


def test_payloads(spark):
    texts = ['{"head":"a","relation":"b","tail":"c"}', '{"TAIL":"c","Head":"a","relation":"b"}', '{"head": "a", "relation": ', '{"head":"a","tail":"c"}', "", None, "[1]", '{"head":"a","relation":null,"tail":"c"}', '{"head":1,"relation":"b","tail":"c"}']
    frame = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "id int, payload string")
    got = {r["id"]: (r["head"], r["relation"], r["tail"]) for r in frame.select("id", *copies.payload_fields(frame["payload"])).collect()}
    whole = {k for k, v in got.items() if all(x is not None for x in v)}
    assert whole == {0, 1, 8} and got[0] == got[1]
