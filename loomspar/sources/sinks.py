"""Sinks of the pipeline: sections, cluster and class summaries, page extras, calls to models, and the folders of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspar.functions import text as T
from loomspar.operators import normalise
from loomspar.sources import io

#: Characters of a field in a summary.
SHOWN = 240


def write_section(documents: DataFrame, path: str) -> None:
    """Each document (id, title, text, content) as a section: text before content, title before id, else ``essay_<seq>`` (column seq)."""
    body = F.coalesce(F.nullif("text", F.lit("")), "content", F.lit(""))
    title = F.coalesce(T.first_filled("title"), F.col("id").cast("string"), F.concat(F.lit("essay_"), F.col("seq").cast("string")))
    documents.select(title.alias("title"), body.alias("text"), F.lit(-1).alias("start_page"), F.lit(-1).alias("end_page")).write.mode("overwrite").json(path)


def cluster_summary(entities: DataFrame) -> DataFrame:
    """(cluster, size, members) by cluster, noise last in ``place``: each member with its fields cut at SHOWN characters; a missing context is its text span. entities: cluster, seq and the fields."""
    context = F.coalesce(T.first_filled("resolution_context", "text_span"), F.lit(""))
    fields = {"entity_name": F.col("entity_name"), "entity_type_hint": F.col("entity_type_hint"), "entity_description": F.col("entity_description"), "resolution_context": context}
    member = F.to_json(F.struct(*(T.clip(F.coalesce(v, F.lit("")), SHOWN).alias(k) for k, v in fields.items())))
    rows = entities.select("cluster", "seq", member.alias("member"))
    out = normalise.clusters(rows, "cluster", "seq", "member")
    return out.select("cluster", "size", "members", F.when(F.col("cluster") == -1, F.lit(1)).otherwise(0).alias("place"))


def write_cluster_summary(entities: DataFrame, path: str) -> None:
    """Entities with their cluster, and the summary of the clusters, as JSON lines under path."""
    entities.withColumnRenamed("cluster", "_cluster_id").write.mode("overwrite").json(f"{path}/entities")
    cluster_summary(entities).write.mode("overwrite").json(f"{path}/summary")


def write_class_round(candidates: DataFrame, entities: DataFrame, path: str, round_no: int) -> None:
    """Classes of one round with their members as objects; candidates without a known member are left out. Read again by io.read_class_rounds."""
    members = normalise.member_objects(candidates.select("candidate", "member_ids"), entities)
    rows = candidates.drop("member_ids").join(members, "candidate").withColumnRenamed("candidate", "candidate_id").withColumn("n_members", F.size("members"))
    rows.write.mode("overwrite").json(f"{path}/round={round_no}")


def page_extras(answers: DataFrame) -> DataFrame:
    """(document, page, extras, line): what a model said of each page; a failed call is a text of its own (answers: document, page, answer, error)."""
    extras = F.when(F.col("error").isNotNull(), F.concat(F.lit("[ERROR] page "), F.col("page").cast("string"), F.lit(": "), F.col("error"))).otherwise(F.coalesce("answer", F.lit("")))
    header = F.concat(F.lit("\n\n" + "=" * 20 + " PAGE "), F.col("page").cast("string"), F.lit(" " + "=" * 20 + "\n"))
    return answers.select("document", "page", extras.alias("extras"), F.concat(header, extras).alias("line"))


def write_page_extras(answers: DataFrame, path: str) -> None:
    rows = page_extras(answers)
    rows.select("document", "page", F.col("extras").alias("extras_text")).write.mode("overwrite").json(f"{path}/records")
    rows.orderBy("document", "page").select("document", "line").write.mode("overwrite").partitionBy("document").text(f"{path}/text")


def write_model_calls(calls: DataFrame, path: str, step: str) -> None:
    """Prompts, raw and parsed answers and errors of a step as rows, added to those that are there."""
    calls.withColumn("step", F.lit(step)).write.mode("append").partitionBy("step").json(path)


def publish_run(frames: dict[str, DataFrame], path: str, name: str, ok: bool) -> str:
    """Tables of a run under a folder of its own, marked ``_FAILED`` where it failed; an earlier one of that name is replaced."""
    folder = f"{path}/{name}{'' if ok else '_FAILED'}"
    for table, rows in frames.items():
        rows.write.mode("overwrite").parquet(f"{folder}/{table}")
    return folder


def snapshots(spark: SparkSession, path: str, needed: tuple[str, ...] = ("nodes", "relations"), most: int | None = None) -> list[str]:
    """Names of the runs under path that have all tables, in order; a listing of folders, one name for each run."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in system.listStatus(root) if s.isDirectory()) if system.exists(root) else []
    return [n for n in names if all(system.exists(hadoop.Path(f"{path}/{n}/{t}")) for t in needed)][:most]


def read_evaluation(spark: SparkSession, path: str) -> dict[str, DataFrame | None]:
    """The files of one evaluation: summary, by_relation and by_concept (CSV), records of both kinds (JSON lines); None where a file is missing."""
    found = {name: io.first_existing(spark, f"{path}/{name}.csv", f"{path}/{name}.jsonl") for name in ("summary", "by_relation", "by_concept", "relation_records", "concept_records")}
    return {name: None if p is None else io.read_csv(spark, p) if p.endswith(".csv") else spark.read.json(p) for name, p in found.items()}
