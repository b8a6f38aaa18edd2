import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspar.llm import canon

ENTRIES = [("c", "Q1", "Centrifugal Pump"), ("c", "Q1", "rotodynamic pump"), ("c", "Q2", "River"), ("c", "Q3", "Rolling Bearing"), ("c", "Q4", "Place Of Birth"), ("c", "Q4", "born in"), ("c", "Q5", "Electric Motor")]


def mapped(spark, values):
    entries = spark.createDataFrame(ENTRIES, "kind string, ref_id string, name string")
    records = spark.createDataFrame([(str(n), "c", v, "x", 1) for n, v in enumerate(values)], "record_id string, kind string, value string, key string, n int")  # clashing names
    return {int(r["record_id"]): r["ref_id"] for r in canon.map_records(records, entries).collect()}


CASES = [
    ("CENTRIFUGAL PUMP", "Q1"), ("centrifugalPump", "Q1"), ("pump, centrifugal", "Q1"), ("centr. pump", "Q1"), ("cntrfgl pmp", "Q1"), ("rotodnyamic_pumps", "Q1"), ("3. rivers", "Q2"), ("is born in?", "Q4"),
    ("place birth", "Q4"), ("electric mitro", "Q5"), ("river of tears", "none"), ("bearing in mind", "none"), ("n/a", "none"), ("???", "none"), ("pumpkin", "none"), (" ", None), (None, None), ("", None),
]


def test_forms(spark):
    got = mapped(spark, [v for v, _ in CASES])
    assert {v: got.get(n) for n, (v, _) in enumerate(CASES)} == dict(CASES)


def test_repeated_rows_and_long_values(spark):
    got = mapped(spark, ["River", "River", "word " * 20000, "x" * 3000])
    assert got == {0: "Q2", 1: "Q2", 2: "none", 3: "none"}


def test_ties_go_to_smaller_id(spark):
    entries = spark.createDataFrame([("c", "B", "town"), ("c", "A", "town")], "kind string, ref_id string, name string")
    records = spark.createDataFrame([("1", "c", "Town")], "record_id string, kind string, value string")
    assert [r["ref_id"] for r in canon.map_records(records, entries).collect()] == ["A"]


@pytest.mark.parametrize("empty", ["records", "entries"])
def test_empty(spark, empty):
    entries = spark.createDataFrame([] if empty == "entries" else ENTRIES, "kind string, ref_id string, name string")
    records = spark.createDataFrame([] if empty == "records" else [("1", "c", "River")], "record_id string, kind string, value string")
    assert [r["ref_id"] for r in canon.map_records(records, entries).collect()] == ([] if empty == "records" else ["none"])


words = st.text("abcd", min_size=0, max_size=7)


@settings(max_examples=300, deadline=None)
@given(words, words)
def test_deletion_variants_meet(a, b):
    """Two words within two edits share a variant, so the join on variants loses no pair."""
    d = canon.edit_distance(a, b, 2)
    if d <= 2 and min(len(a), len(b)) > 2:
        assert canon.variants(a, 2) & canon.variants(b, 2)


@settings(max_examples=200, deadline=None)
@given(words, words)
def test_edit_distance_is_symmetric_and_bounded(a, b):
    assert canon.edit_distance(a, b, 9) == canon.edit_distance(b, a, 9)
    assert (canon.edit_distance(a, b, 9) == 0) == (a == b)
    assert min(canon.edit_distance(a, b, 9), 3) == canon.edit_distance(a, b, 2)
