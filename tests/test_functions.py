from pyspark.sql import functions as F

from loomspar.functions import text as T
from loomspar.functions import vectors as V
from loomspar.operators import chunk


def value(spark, column, **fields):
    names = [*fields] or ["_"]
    return spark.range(1).select(*(F.lit(fields.get(n)).alias(n) for n in names)).select(column.alias("x")).first()["x"]


def sentence(n):
    """A sentence of exactly n estimated tokens (n a multiple of 5)."""
    return " ".join(["w"] * (n * 4 // 5))


def folded(sizes, most, least):
    return [([len(s.split()) * 5 // 4 for s in c[3]], c[7]) for c in chunk.fold([sentence(n) for n in sizes], most, least)]


def test_chunk_budget():
    over, below = "exceeded_max_kept_whole_or_to_meet_min", "below_min_unable_to_expand"
    assert folded([40, 70, 10, 30, 90, 5], 200, 100) == [([40, 70], None), ([10, 30, 90], None), ([5], below)]
    assert folded([60, 190], 200, 100) == [([60, 190], over)]
    assert folded([60, 60, 10], 100, None) == [([60, 60], over), ([10], None)]
    assert folded([60, 40, 10], 100, None) == [([60, 40, 10], over)]
    assert folded([100, 10], 100, None) == [([100], None), ([10], None)]
    assert folded([5, 5], None, None) == [([5, 5], None)] and folded([], 200, 100) == []


def test_chunk_headings():
    first, last, body, taken, _, _, heading, _ = next(chunk.fold(["1.2 Scope", "One two.", "Three."], None, None))
    assert (first, last, heading, taken, body) == (0, 1, "1.2 Scope", ["One two.", "Three."], "One two.\nThree.")
    assert [c[7] for c in chunk.fold(["3 Annex"], 200, 100)] == ["heading_only"]


def test_tokens(spark):
    rows = spark.createDataFrame([(None,), ("",), ("a",), ("a b c",)], "t string").select(T.tokens_fast("t"), T.tokens_words("t"), T.tokens_chars("t")).collect()
    assert [tuple(r) for r in rows] == [(0, 1, 0), (0, 1, 0), (1, 1, 0), (3, 3, 1)]


def test_previous_context_and_ids(spark):
    rows = spark.createDataFrame([(s, i, t) for s in (1, 2) for i, t in enumerate(["a", " ", "c", "d"])], "section_id bigint, chunk_index int, text string")
    got = {(r["section_id"], r["chunk_index"]): r["context"] for r in chunk.previous_context(rows, 2).collect()}
    assert [got[1, i] for i in range(4)] == [[], ["a"], ["a"], ["c"]]
    ids = {(r["section_id"], r["chunk_index"]): r["id"] for r in chunk.chunk_ids(rows).collect()}
    assert ids[1, 0] == "Ch_000000" and ids[2, 3] == "Ch_000007" and len(set(ids.values())) == 8


def test_json_texts(spark):
    assert value(spark, T.json_array_text("a"), a="```json\n[1,2,]\n```") == "[1,2]"
    assert value(spark, T.json_array_text("a"), a="none") is None
    assert value(spark, T.json_object_text("a"), a='x {"a": {"b": 1}} y') == '{"a": {"b": 1}}'
    assert value(spark, T.fix_escapes("a"), a='{"a": "\\d \\n"}\r\n') == '{"a": "\\\\d \\n"}\n'


def test_ids(spark):
    frame = spark.createDataFrame([("ont_1_x_train_12",), ("ont_1_x_test_3",), ("abc_7",), ("abc",)], "i string")
    got = [tuple(r) for r in frame.select(T.id_prefix("i"), T.id_number("i"), T.id_split("i")).collect()]
    assert got == [("ont_1_x", 12, "train"), ("ont_1_x", 3, "test"), ("abc", 7, "all"), ("abc", -1, "all")]


def test_qualifiers(spark):
    frame = spark.createDataFrame([('{"a":"1","b":" ","c":"null","d":null}', '{"a":"1","z":"2"}'), (None, "{}"), ("broken", '{"a":"1"}'), ('{"a":"1"}', '{"a":"2"}')], "x string, y string")
    got = frame.select(T.map_text(T.qualifiers("x")).alias("m"), T.qualifiers_subset(T.qualifiers("x"), T.qualifiers("y")).alias("s")).collect()
    assert [(r["m"], r["s"]) for r in got] == [('{"a":"1"}', True), ("{}", True), ("{}", True), ('{"a":"1"}', False)]


def test_text_functions(spark):
    assert value(spark, T.clip_words("a", 8), a="one two three") == "one two..."
    assert value(spark, T.clip("a", 3), a="abcd") == "abc..." and value(spark, T.clip("a", 4), a="abcd") == "abcd"
    assert value(spark, T.ngram_overlap("a", "b", 4), a="a b c d e", b="a b c d x") == 0.5
    assert value(spark, T.ngram_overlap("a", "b", 4), a="a b", b="a b") == 0.0
    assert value(spark, T.contains_fact("a", "b"), a="The  Pump\nfeeds it", b="pump FEEDS") is True
    assert value(spark, T.contains_fact("a", "b"), a="x", b=" ") is False
    assert value(spark, T.to_int("a", -1), a="7.9") == 7 and value(spark, T.to_double("a", 0.5), a="n/a") == 0.5 and value(spark, T.percent("a"), a=0.984) == "98.4%"
    assert value(spark, T.first_filled("a", "b"), a=" ", b=" x ") == "x" and value(spark, T.ordered_unique(F.array(F.lit("b"), F.lit("a"), F.lit("b")))) == ["b", "a"]
    assert value(spark, T.strip_fences("a"), a=" ```\nbody\n``` ") == "body" and value(spark, T.strip_fences("a"), a="```") == "```"
    assert value(spark, T.simple_sentences("a"), a='One. Two? "Three" 4! five') == ["One.", "Two?", '"Three" 4! five']
    assert value(spark, T.simple_sentences("a"), a="") == []


def test_vectors(spark):
    arr = lambda *x: F.array(*map(F.lit, x))
    assert value(spark, V.normalise(arr(3.0, 4.0))) == [0.6, 0.8] and value(spark, V.normalise(arr(0.0, 0.0))) == [0.0, 0.0]
    assert value(spark, V.cosine(arr(1.0, 0.0), arr(0.0, 0.0))) == 0.0
    assert value(spark, V.fuse([arr(1.0, 0.0), arr(0.0, 1.0)], [1.0, 0.0])) == [1.0, 0.0]
    assert value(spark, V.mean_pool(F.array(arr(1.0, 2.0), arr(3.0, 4.0), arr(9.0, 9.0)), arr(1, 1, 0))) == [2.0, 3.0]
