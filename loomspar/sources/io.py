"""Sources and sinks: JSON documents, JSON lines, CSV, graph files, benchmark files, archives and pages."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspar.functions import text as T

DOCUMENT = "struct<id:string,title:string,text:string,content:string>"
# The columns of the two files of a graph.
NODE_COLUMNS = ("entity_id", "entity_name", "entity_description", "entity_type_hint", "entity_confidence", "entity_resolution_context", "entity_flag", "class_id", "class_label", "class_group", "chunk_ids", "node_properties")
RELATION_COLUMNS = ("relation_id", "start_id", "end_id", "raw_relation_name", "canonical_rel_name", "canonical_rel_desc", "rel_cls", "rel_cls_group", "rel_hint_type", "confidence", "resolution_context", "justification", "remark", "evidence_excerpt", "chunk_id", "qualifiers", "rel_desc")


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of sections: ref_index is the position; untitled ones are ``section_<i>``, missing text is empty."""
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.posexplode(F.from_json("value", "array<struct<title:string,text:string,start_page:int,end_page:int>>")).alias("ref_index", "s"))
    return rows.select("ref_index", F.coalesce(T.first_filled("s.title"), F.concat(F.lit("section_"), F.col("ref_index"))).alias("title"), F.coalesce("s.text", F.lit("")).alias("text"), F.coalesce("s.start_page", F.lit(-1)).alias("start_page"), F.coalesce("s.end_page", F.lit(-1)).alias("end_page"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents as a JSON list, or as the first list under essays, data, items or documents: (seq, id, title, text)."""
    whole = spark.read.text(path, wholetext=True)
    shapes = [F.from_json("value", f"array<{DOCUMENT}>"), *(F.from_json("value", f"struct<{k}:array<{DOCUMENT}>>")[k] for k in ("essays", "data", "items", "documents"))]
    listed = [F.when(F.ltrim("value").startswith("["), shapes[0]), *(F.when(F.ltrim("value").startswith("{"), s) for s in shapes[1:])]
    rows = whole.select(F.posexplode(F.coalesce(*listed)).alias("seq", "d"))
    return rows.select("seq", F.try_to_number("d.id", F.lit("999999999999999999")).cast("bigint").alias("id"), F.coalesce(T.first_filled("d.title"), F.col("d.id"), F.concat(F.lit("essay_"), F.col("seq"))).alias("title"), F.coalesce(F.nullif("d.text", F.lit("")), "d.content", F.lit("")).alias("text"))


def document_problems(documents: DataFrame) -> DataFrame:
    """Documents that break the contract: (id, problem) for missing and repeated ids."""
    missing = documents.filter("id is null").select("id", F.lit("no id").alias("problem"))
    return missing.unionByName(documents.filter("id is not null").groupBy("id").count().filter("count > 1").select("id", F.lit("repeated id").alias("problem")))


def requested(documents: DataFrame, ids: list[int]) -> DataFrame:
    """The requested documents that exist."""
    return documents.filter(F.col("id").isin(sorted(set(ids))))


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True, with_file: bool = False) -> DataFrame:
    """JSON lines; strict: a broken line is an error, else it is left out. Blank lines never count."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    return rows.withColumn("file_name", F.element_at(F.split("_metadata.file_path", "/"), -1)) if with_file else rows


def write_jsonl(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.write.mode("append" if append else "overwrite").json(path)


def read_csv(spark: SparkSession, path: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """CSV with header, all strings; quoted fields may hold line breaks."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return reader.schema(", ".join(f"{c} string" for c in columns)).csv(path) if columns else reader.csv(path)


def write_csv(rows: DataFrame, path: str, quote_all: bool = False) -> None:
    """CSV with columns in order of the alphabet; nulls are empty."""
    plain = rows.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in sorted(rows.columns)))
    plain.write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", quote_all).option("emptyValue", "").csv(path)


def write_graph(nodes: DataFrame, relations: DataFrame, path: str) -> None:
    """The graph as two CSV folders, every field quoted; strings inside the JSON columns hold no double quotes."""
    for rows, columns, name in ((nodes, NODE_COLUMNS, "nodes"), (relations, RELATION_COLUMNS, "relations")):
        out = rows.select(*(F.coalesce(T.single_quotes(c) if c in ("node_properties", "qualifiers") else F.col(c), F.lit("")).alias(c) for c in columns))
        out.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").csv(f"{path}/{name}")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return read_csv(spark, f"{path}/nodes", NODE_COLUMNS), read_csv(spark, f"{path}/relations", RELATION_COLUMNS)


def write_vectors(rows: DataFrame, path: str) -> None:
    """Vectors with their metadata as Parquet, ``embedding array<float>``; searched exactly by operators.vector.search."""
    rows.withColumn("embedding", F.col("embedding").cast("array<float>")).write.mode("overwrite").parquet(path)


def read_class_rounds(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Round files of classes with ids made unique: an id that an earlier file has is ``<file>__<id>``."""
    rows = read_jsonl(spark, path, schema, strict=False, with_file=True)
    first = rows.groupBy("candidate_id").agg(F.min("file_name").alias("first_file"))
    stem = F.regexp_replace("file_name", r"\.[^.]*$", "")
    return rows.join(first, "candidate_id").withColumn("candidate_id", F.when(F.col("file_name") == F.col("first_file"), F.col("candidate_id")).otherwise(F.concat(stem, F.lit("__"), "candidate_id"))).drop("first_file")


def first_existing(spark: SparkSession, *paths: str) -> str | None:
    """The first path that exists."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    for p in paths:
        path = hadoop.Path(p)
        if path.getFileSystem(conf).exists(path):
            return p
    return None


def gold_triples(*splits: tuple[str, DataFrame]) -> DataFrame:
    """Triples of benchmark files (id, sent, triples array of sub, rel, obj) by split; all three parts are required."""
    parts = [rows.select(F.lit(name).alias("split"), F.col("id").alias("sentence_id"), "sent", F.explode("triples").alias("t")) for name, rows in splits]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    triples = out.select("split", "sentence_id", "sent", T.first_filled("t.sub").alias("subject"), T.first_filled("t.rel").alias("predicate"), T.first_filled("t.obj").alias("object"))
    return triples.dropna(subset=["subject", "predicate", "object"])


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """(result_id, accuracy) of result files: a summary's accuracy, or the last one of a list; "85%" is 0.85. The id is the last number in the file's name."""
    whole = spark.read.text(path, wholetext=True).withColumn("name", F.element_at(F.split("_metadata.file_path", "/"), -1))
    found = F.regexp_extract_all("value", F.lit(r'"accuracy"\s*:\s*"?([0-9.]+%?)'), F.lit(1))
    last = F.try_element_at(found, F.lit(-1))
    value = F.when(last.endswith("%"), F.rtrim(last, F.lit("%")).try_cast("double") / 100).otherwise(last.try_cast("double"))
    return whole.select(F.try_element_at(F.regexp_extract_all("name", F.lit(r"(\d+)"), F.lit(1)), F.lit(-1)).try_cast("bigint").alias("result_id"), value.alias("accuracy"))


def read_archive(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """(file, content) of the members of zip archives whose name begins with the prefix. Each archive is one row of a task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for body in frame["content"]:
                with zipfile.ZipFile(io.BytesIO(body)) as archive:
                    names = [n for n in archive.namelist() if n.startswith(prefix) and not n.endswith("/")]
                    yield pd.DataFrame({"file": names, "content": [archive.read(n).decode("utf-8", "replace") for n in names]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "file string, content string")


def page_texts(pages: DataFrame, first: int = 1, last: int | None = None, most: int = 12_000) -> DataFrame:
    """Pages (document, page, text) from first to last as text of at most ``most`` characters with a mark where it was cut off. PDF pages need a PDF library; text pages don't."""
    inside = (F.col("page") >= first) & (F.lit(True) if last is None else F.col("page") <= last)
    body = F.coalesce("text", F.lit(""))
    return pages.filter(inside).select("document", "page", F.when(F.length(body) > most, F.concat(F.substring(body, 1, most), F.lit("\n[TRUNCATED]"))).otherwise(body).alias("text"))


def collect_triples(rows: DataFrame) -> DataFrame:
    """(head, relation, tail) of an external extractor's three kinds of records: entity relations, event relations, events with entities."""
    triple = "array<struct<Head:string,Relation:string,Tail:string>>"
    event = "array<struct<Event:string,Entity:array<string>>>"
    direct = [rows.select(F.explode(F.from_json(c, triple)).alias("t")).select("t.Head", "t.Relation", "t.Tail") for c in ("entity_relation_dict", "event_relation_dict")]
    events = rows.select(F.explode(F.from_json("event_entity_dict", event)).alias("e")).select(F.col("e.Event").alias("Head"), F.lit("is participated by").alias("Relation"), F.explode("e.Entity").alias("Tail"))
    out = direct[0].unionByName(direct[1]).unionByName(events).select(*(F.trim(c).alias(c.lower()) for c in ("Head", "Relation", "Tail")))
    return out.filter("head <> '' and relation <> '' and tail <> ''")


def train_only(rows: DataFrame, column: str = "title") -> DataFrame:
    """Without test items."""
    return rows.filter(~(F.contains(column, F.lit("_test_")) | F.col(column).endswith("_test")))


def ontology_chunks(items: DataFrame) -> DataFrame:
    """Items (title, text) as ready-made chunks, numbered within their ontology by title."""
    prefix = T.id_prefix("title")
    rows = items.withColumn("prefix", prefix)
    return rows.withColumn("id", F.format_string("Ch_%06d", F.row_number().over(Window.partitionBy("prefix").orderBy("title")) - 1)).withColumn("reason", F.lit("manual_chunk_created_per_ontology"))
