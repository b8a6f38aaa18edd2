"""Every pN_found query against an independent check on the smallest data."""

import re
from collections import defaultdict

import duckdb
import pytest

import __spark_entry__
from loomspar.llm import registry


def sql_rows(name, data):
    con = duckdb.connect()
    for t in ("raw_relations", "baseline_kg", "in_plain_text", "size_limits", "documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return sorted(map(tuple, con.execute(registry.ORACLE_SQL[name]).fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, data, name):
    assert sorted(map(tuple, registry.QUERIES[name](spark, data).collect()), key=repr) == sql_rows(name, data)


def test_columns(spark, data):
    expected = {
        "p1_found": "record_id ref_id", "p2_found": "id sent_start sent_end", "p3_found": "entity_id_a entity_id_b", "p4_found": "id field",
        "p5_found": "kind kept_id copy_id", "p7_found": "item_id doc_id", "p8_found": "doc_id subject",
    }
    queries = __spark_entry__.queries()
    for name, columns in expected.items():
        assert queries[name](spark, data).columns == columns.split()


def test_leaks_brute_force(spark, data):
    word = re.compile(r"[^\W_]+")
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text", "lang").collect()
    runs, chars = defaultdict(set), defaultdict(set)
    for i, text, lang in items:
        w = word.findall(text.lower())
        if lang in ("zh", "ja"):
            s = "".join(w)
            for k in range(max(1, len(s) - 19)):
                chars[s[k : k + 20]].add(i)
        else:
            n = min(10, len(w))
            for k in range(len(w) - n + 1):
                runs[tuple(w[k : k + n])].add(i)
    sizes = {len(k) for k in runs}
    expected = set()
    for d, text in docs:
        w = word.findall((text or "").lower())
        for n in sizes:
            for k in range(len(w) - n + 1):
                expected |= {(i, d) for i in runs.get(tuple(w[k : k + n]), ())}
        s = "".join(w)
        for k in range(len(s) - 19):
            expected |= {(i, d) for i in chars.get(s[k : k + 20], ())}
    assert {tuple(r) for r in registry.QUERIES["p7_found"](spark, data).collect()} == expected


def test_every_entry_runs(spark, data):
    for name, query in registry.QUERIES.items():
        if name not in registry.ORACLE_SQL:
            assert query(spark, data).count() > 0, name
