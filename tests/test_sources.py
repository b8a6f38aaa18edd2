import json
import zipfile

from loomspar.operators import normalise
from loomspar.plans import model, pipeline, stages
from loomspar.sources import io, sinks


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_documents_and_sections(spark, tmp_path):
    docs = [{"id": 1, "title": "T", "text": "x"}, {"id": 2, "content": "y"}, {"title": "no id"}]
    for n, shape in enumerate((docs, {"essays": docs}, {"data": docs}, {"items": docs}, {"documents": docs})):
        got = io.read_documents(spark, put(tmp_path / f"d{n}.json", json.dumps(shape))).orderBy("seq").collect()
        assert [(r["id"], r["title"], r["text"]) for r in got] == [(1, "T", "x"), (2, "2", "y"), (None, "no id", "")]
    assert [r["problem"] for r in io.document_problems(io.read_documents(spark, str(tmp_path / "d0.json"))).collect()] == ["no id"]
    got = io.read_sections(spark, put(tmp_path / "s.json", json.dumps([{"text": "a"}, {"title": "B", "start_page": 3}]))).orderBy("ref_index").collect()
    assert [(r["title"], r["text"], r["start_page"]) for r in got] == [("section_0", "a", -1), ("B", "", 3)]


def test_jsonl(spark, tmp_path):
    path = put(tmp_path / "r.jsonl", '{"a": 1}\n\n{"a": broken\n{"a": 3}\n')
    assert sorted(r["a"] for r in io.read_jsonl(spark, path, "a int", strict=False).collect()) == [1, 3]
    assert io.read_jsonl(spark, path, "a int", strict=False, with_file=True).first()["file_name"] == "r.jsonl"
    try:
        io.read_jsonl(spark, path, "a int").collect()
        raise AssertionError("a broken line must fail")
    except Exception as e:
        assert "broken line must fail" not in str(e)
    assert io.first_existing(spark, str(tmp_path / "none"), path) == path


def test_graph_round_trip(spark, tmp_path):
    node = {c: None for c in io.NODE_COLUMNS} | {"entity_id": "e", "entity_name": 'a "quoted", name\nline', "node_properties": '[{"prop_value":"5\\" pipe"}]'}
    rel = {c: "" for c in io.RELATION_COLUMNS} | {"relation_id": "r", "qualifiers": '{\n "a": "1"\n}'}
    schema = lambda cs: ", ".join(f"{c} string" for c in cs)
    io.write_graph(spark.createDataFrame([tuple(node[c] for c in io.NODE_COLUMNS)], schema(io.NODE_COLUMNS)), spark.createDataFrame([tuple(rel[c] for c in io.RELATION_COLUMNS)], schema(io.RELATION_COLUMNS)), str(tmp_path / "g"))
    nodes, rels = io.read_graph(spark, str(tmp_path / "g"))
    r = nodes.first()
    assert r["entity_name"] == node["entity_name"] and json.loads(r["node_properties"]) == [{"prop_value": "5' pipe"}] and rels.first()["qualifiers"] == rel["qualifiers"]


def test_results_archives_pages(spark, tmp_path):
    put(tmp_path / "run_7.json", json.dumps({"summary": {"accuracy": 0.5}}))
    put(tmp_path / "run_8.json", json.dumps([{"x": 1}, {"accuracy": "85%"}]))
    assert {r["result_id"]: r["accuracy"] for r in io.read_results(spark, str(tmp_path / "run_*.json")).collect()} == {7: 0.5, 8: 0.85}
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("keep/x.txt", "hello")
        z.writestr("drop/y.txt", "no")
    assert [tuple(r) for r in io.read_archive(spark, str(tmp_path / "a.zip"), "keep/").collect()] == [("keep/x.txt", "hello")]
    pages = spark.createDataFrame([("d", n, "x" * 20) for n in range(1, 5)], "document string, page int, text string")
    assert [(r["page"], len(r["text"])) for r in io.page_texts(pages, 2, 3, 10).orderBy("page").collect()] == [(2, 22), (3, 22)]


def test_triples(spark):
    row = (json.dumps([{"Head": "a", "Relation": "r", "Tail": "b"}, {"Head": "a", "Relation": "", "Tail": "b"}]), "[]", json.dumps([{"Event": "e", "Entity": ["x", "y"]}]))
    got = io.collect_triples(spark.createDataFrame([row], "entity_relation_dict string, event_relation_dict string, event_entity_dict string"))
    assert sorted(map(tuple, got.collect())) == [("a", "r", "b"), ("e", "is participated by", "x"), ("e", "is participated by", "y")]
    gold = io.gold_triples(("train", spark.createDataFrame([("1", "s", [("a", "r", "b"), ("a", None, "b")])], "id string, sent string, triples array<struct<sub:string,rel:string,obj:string>>")))
    assert [r["object"] for r in gold.collect()] == ["b"]


class Failing:
    def complete(self, prompt):
        if "bad" in prompt:
            raise ValueError("no")
        return '[{"entity_name": "X"}]'


def test_model_stage(spark):
    prompts = spark.createDataFrame([(1, "ok"), (2, "ok"), (3, "bad"), (4, "y" * 50_000)], "key int, prompt string")
    got = {r["key"]: r for r in model.complete(prompts, Failing).collect()}
    assert got[1]["hash"] == got[2]["hash"] and got[3]["error"] == "ValueError: no" and got[4]["error"] == "skipped_prompt"
    cache = spark.createDataFrame([(got[3]["hash"], "[]", None)], "hash string, answer string, error string")
    again = {r["key"]: r["error"] for r in model.complete(prompts, Failing, cache).collect()}
    assert again[3] is None
    assert model.ModelConfig(rec="m", steps={"rel_rec": "z"}).model_of("rel_rec") == "z"


def test_pipeline(spark):
    rows = spark.createDataFrame([(1, ["Alice Moor met Bob Lane. Bob Lane called Alice Moor."]), (2, ["nothing here"])], "section_id bigint, sentences array<string>")
    nodes, relations, run = pipeline.build_graph(rows)
    assert not any(s["error"] for s in run.steps)
    assert {r["entity_name"] for r in nodes.collect()} == {"Alice Moor", "Bob Lane"} and sorted((r["relation_name"], r["canonical_rel_name"], r["rel_cls"]) for r in relations.collect()) == [("called", "called", "Called"), ("met", "met", "Met")]
    assert all(r["class_label"] for r in nodes.collect())
    assert pipeline.iterate(0, lambda s: s + 1, lambda s: 0)[1] == 3


def test_entity_actions(spark):
    rows = [(1, i, n, "", "t", c, [k], [i]) for k, (i, n, c) in enumerate([("a", "Pump", 0.2), ("b", "pumps", 0.9), ("c", "Valve", 0.5), ("d", "Gate", 0.5)])]
    entities = spark.createDataFrame(rows, "section_id int, id string, name string, description string, hint string, confidence double, chunks array<int>, merged_from array<string>")
    answer = json.dumps([{"action": "MergeEntities", "entity_ids": ["a", "b", "zz"], "canonical_name": "Pump"}, {"action": "ModifyEntity", "entity_id": "c", "new_name": "Control Valve"}, {"action": "KeepEntity", "entity_id": "d"}, {"action": "Other"}])
    answers = spark.createDataFrame([((1, 0, 0), ["a", "b", "c", "d"], f"Here: {answer}")], "key struct<section_id:int,cluster:int,bucket:int>, ids array<string>, answer string")
    out = {r["name"]: r for r in stages.apply_entity_actions(entities, stages.entity_actions(answers)).collect()}
    assert set(out) == {"Pump", "Control Valve", "Gate"} and out["Pump"]["merged_from"] == ["a", "b"] and out["Pump"]["confidence"] == 0.9 and out["Pump"]["chunks"] == [0, 1] and out["Pump"]["merges"] == 1


class Stubborn(model.RuleClient):
    deterministic = False


def test_rounds_end_after_three_without_change(spark):
    rows = spark.createDataFrame([(1, "r1", "runs at", "TBD", "TBD", "TBD", []), (1, "r2", "Runs at", "TBD", "TBD", "TBD", [])], "section_id int, id string, relation_name string, canonical_rel_name string, rel_cls string, rel_cls_group string, remarks array<string>")
    out, n = stages.relation_rounds(rows, Stubborn)
    assert n == 4 and {r["canonical_rel_name"] for r in out.collect()} == {"runAt"}
    classes = spark.createDataFrame([(1, "c1", "Pump", "", "TBD", 0.5, ["a"]), (1, "c2", "pumps", "", "TBD", 0.7, ["b"]), (2, "c3", "Pump", "", "TBD", 0.5, ["c"])], "section_id bigint, class_id string, label string, description string, class_group string, confidence double, members array<string>")
    out, n = stages.class_rounds(classes)
    assert n == 2 and sorted(len(r["members"]) for r in out.collect()) == [1, 2]


def test_sinks(spark, tmp_path):
    sinks.write_section(spark.createDataFrame([(1, 7, None, "", "body"), (2, None, " T ", "text", "x"), (3, None, "", None, None)], "seq int, id int, title string, text string, content string"), str(tmp_path / "s"))
    assert sorted((r["title"], r["text"]) for r in spark.read.json(str(tmp_path / "s")).collect()) == [("7", "body"), ("T", "text"), ("essay_3", "")]
    rows = [(c, n, f"n{n}", "t", "d" * 300, None, "span") for n, c in enumerate([1, -1, 0, 1])]
    entities = spark.createDataFrame(rows, "cluster int, seq int, entity_name string, entity_type_hint string, entity_description string, resolution_context string, text_span string")
    sinks.write_cluster_summary(entities, str(tmp_path / "c"))
    got = {r["cluster"]: r for r in spark.read.json(str(tmp_path / "c" / "summary")).collect()}
    assert got[1]["size"] == 2 and got[-1]["place"] == 1 and json.loads(got[1]["members"][0])["resolution_context"] == "span" and len(json.loads(got[1]["members"][1])["entity_description"]) == 243
    candidates = spark.createDataFrame([("k1", "L", ["a", "zz"]), ("k2", "M", ["zz"])], "candidate string, class_label string, member_ids array<string>")
    sinks.write_class_round(candidates, spark.createDataFrame([("a", "A")], "id string, entity_name string"), str(tmp_path / "r"), 0)
    assert [(r["candidate_id"], r["n_members"], r["members"][0]["entity_name"]) for r in spark.read.json(str(tmp_path / "r" / "round=0")).collect()] == [("k1", 1, "A")]
    answers = spark.createDataFrame([("d", 1, "ok", None), ("d", 2, None, "late")], "document string, page int, answer string, error string")
    sinks.write_page_extras(answers, str(tmp_path / "p"))
    assert {r["page"]: r["extras_text"] for r in spark.read.json(str(tmp_path / "p" / "records")).collect()} == {1: "ok", 2: "[ERROR] page 2: late"}
    for _ in range(2):
        sinks.write_model_calls(answers, str(tmp_path / "calls"), "rel_rec")
    assert spark.read.json(str(tmp_path / "calls")).count() == 4
    for name, ok in (("001", True), ("002", False)):
        sinks.publish_run({"nodes": answers, "relations": answers}, str(tmp_path / "runs"), name, ok)
    sinks.publish_run({"nodes": answers}, str(tmp_path / "runs"), "003", True)
    assert sinks.snapshots(spark, str(tmp_path / "runs")) == ["001", "002_FAILED"] and sinks.snapshots(spark, str(tmp_path / "none")) == []
    (tmp_path / "e").mkdir()
    put(tmp_path / "e" / "summary.csv", "split,x\nall,1\n")
    bundle = sinks.read_evaluation(spark, str(tmp_path / "e"))
    assert bundle["summary"].first()["split"] == "all" and bundle["by_concept"] is None


def test_graph_under_other_names(spark):
    relation = spark.createDataFrame([("r", "a", "b", "rel", None, "role", None)], "rid string, subject string, object string, rel_name string, canonical string, rel_group string, qualifier string")
    assert normalise.relation_records(relation).first()["canonical_rel_name"] == "rel" and normalise.export_relations(relation).columns == list(io.RELATION_COLUMNS)
    given = spark.createDataFrame([("r", "a", "b", {"subject_class_label": None})], "relation_id string, start_id string, end_id string, given map<string,string>")
    nodes = spark.createDataFrame([("a", "A", "C", "G"), ("b", "B", "D", "H")], "entity_id string, entity_name string, class_label string, class_group string")
    row = normalise.with_missing_ends(given, nodes).first()
    assert row["subject_class_label"] is None and row["object_class_label"] == "D" and row["subject_entity_name"] == "A"
