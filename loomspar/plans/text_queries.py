"""Queries over texts: sections, sentences, chunks, scalar functions, context windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspar.functions import text as T
from loomspar.operators import chunk
from loomspar.runtime import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# SQL fragments
WS = r"[\s\p{Z}\x{85}\x{1c}-\x{1f}]"
STRIP = rf"regexp_replace(regexp_replace({{0}}, '^{WS}+', ''), '{WS}+$', '')"
WORDS = rf"len(list_filter(regexp_split_to_array(coalesce({{0}}, ''), '{WS}+'), lambda w: w <> ''))"
LINES = r"'\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]'"


def _strip(x: str) -> str:
    return STRIP.replace("{0}", x)


def _words(x: str) -> str:
    return WORDS.replace("{0}", x)


BODY = f"""
body as (
  select doc_id, case when starts_with(s, '```') and ends_with(s, '```') and length(s) >= 6 then {_strip("substr(s, 4, length(s) - 6)")} else s end as b
  from (select doc_id, {_strip("coalesce(text, '')")} as s from documents)
), parts as (
  select doc_id, list_filter(list_transform(
    case when b = '' then [] when contains(b, chr(10)) then regexp_split_to_array(b, {LINES})
      else string_split(regexp_replace(regexp_replace(b, '([.?!]){WS}+([A-Z0-9"''(\\[])', '\\1' || chr(1) || '\\2', 'g'), '([.?!]){WS}+([A-Z0-9"''(\\[])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) end,
    lambda x: {_strip("x")}), lambda x: x <> '') as sentences
  from body
)"""
TOKENS = "greatest(1, cast(floor(" + _words("{0}") + " * 1.25) as int))"


def sections(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(F.col("doc_id").alias("section_id"), T.simple_sentences("text").alias("sentences"))


@query(f"with {BODY} select doc_id, generate_subscripts(sentences, 1) - 1 as pos, unnest(sentences) as sentence from parts")
def f05_simple_sentences(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.posexplode(T.simple_sentences("text")).alias("pos", "sentence"))


@query(f"""with recursive {BODY}, sent as (
  select doc_id, generate_subscripts(sentences, 1) - 1 as i, unnest(sentences) as s, len(sentences) as total from parts
), tok as (
  select doc_id, i, total, {TOKENS.replace("{0}", "s")} as t,
    regexp_full_match(s, '\\s*\\d+(\\.\\d+)*\\s+[\\p{{L}}\\p{{N}}_\\-\\(\\) ]{{1,80}}') or (length(s) < 120 and ends_with({_strip("s")}, 'Mechanisms') and regexp_matches(s, '\\d')) as h from sent
), fold as (
  select doc_id, i, total, 0 as chunk_index, case when h then 0 else t end as acc, case when h then 1 else 0 end as heading, case when h then 0 else 1 end as n, i as first_sentence from tok where i = 0
  union all
  select k.doc_id, k.i, k.total,
    case when closed then f.chunk_index + 1 else f.chunk_index end,
    case when closed then (case when k.h then 0 else k.t end) else f.acc + k.t end,
    case when closed then (case when k.h then 1 else 0 end) else f.heading end,
    case when closed then (case when k.h then 0 else 1 end) else f.n + 1 end,
    case when closed then k.i else f.first_sentence end
  from (select *, n > 0 and acc >= 100 as closed from fold) f join tok k on k.doc_id = f.doc_id and k.i = f.i + 1
)
select doc_id, chunk_index, cast(first_sentence as int) as span_start, cast(case when n = 0 then first_sentence else first_sentence + n - 1 end as int) as span_end,
  cast(case when n = 0 then th else acc end as int) as n_tokens,
  case when n = 0 then 'heading_only' when acc > 200 then 'exceeded_max_kept_whole_or_to_meet_min' when acc < 100 then 'below_min_unable_to_expand' end as reason
from (
  select f.*, k.t as th, row_number() over (partition by f.doc_id, f.chunk_index order by f.i desc) as last
  from fold f join tok k on k.doc_id = f.doc_id and k.i = f.i
) where last = 1""")
def f01_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Flagship: documents cut into chunks by sentences and token budget (100 to 200)."""
    return chunk.chunk_sections(sections(spark, folder)).select(F.col("section_id").alias("doc_id"), "chunk_index", "span_start", "span_end", "n_tokens", "reason")


@query(f"""select doc_id, cast({_words("text")} as int) as n_words, cast(case when coalesce(text, '') = '' then 0 else {TOKENS.replace("{0}", "text")} end as int) as tokens_fast,
  cast(greatest(1, {_words("text")}) as int) as tokens_words, cast(floor(length(coalesce(text, '')) / 4) as int) as tokens_chars from documents""")
def f02_token_estimates(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", T.word_count("text").alias("n_words"), T.tokens_fast("text").alias("tokens_fast"), T.tokens_words("text").alias("tokens_words"), T.tokens_chars("text").alias("tokens_chars"))


@query(r"""select distinct id, line from (select id, unnest(string_split(coalesce(text, ''), chr(10))) as line from in_plain_text)
where regexp_full_match(line, '\s*\d+(\.\d+)*\s+[\p{L}\p{N}_\-\(\) ]{1,80}') or (length(line) < 120 and ends_with(trim(line), 'Mechanisms') and regexp_matches(line, '\d'))""")
def f06_headings(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "in_plain_text").select("id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    return lines.filter(T.is_heading("line")).distinct()


@query(f"""select distinct id, case when starts_with(s, '```') and ends_with(s, '```') and length(s) >= 6 then {_strip("substr(s, 4, length(s) - 6)")} else s end as body
from (select id, {_strip("text")} as s from in_plain_text where text is not null)""")
def f07_strip_fences(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "in_plain_text").filter("text is not null").select("id", T.strip_fences("text").alias("body")).distinct()


@query(rf"""select doc_id, trim(replace(coalesce(title, ''), chr(10), ' ')) as title, trim(regexp_replace(text, '{WS}+', ' ', 'g')) as collapsed,
  case when length(text) > 240 then substr(text, 1, 240) || '...' else text end as clipped from (select doc_id, title, coalesce(text, '') as text from documents)""")
def f08_safe_and_clipped_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", T.safe_text("title").alias("title"), T.collapse("text").alias("collapsed"), T.clip("text", 240).alias("clipped"))


@query(rf"""select doc_id, case when length(v) > 800 then (case when contains(h, ' ') then regexp_extract(h, '(?s)^(.*) ', 1) else h end) || '...' else v end as clipped
from (select doc_id, v, substr(v, 1, 800) as h from (select doc_id, trim(regexp_replace(coalesce(text, ''), '{WS}+', ' ', 'g')) as v from documents))""")
def f10_clip_at_words(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", T.clip_words("text", 800).alias("clipped"))


@query(r"""select seq, case when f is null then null else f end as relation, case when d is null then null else d end as group_label from (
  select seq, coalesce(nullif(trim(canonical_rel_name), ''), nullif(trim(raw_relation_name), '')) as f, upper(coalesce(nullif(trim(rel_cls_group), ''), nullif(trim(rel_hint_type), ''), 'TBD')) as d from kg_rels)""")
def f11_first_filled(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "kg_rels").select("seq", T.first_filled("canonical_rel_name", "raw_relation_name").alias("relation"), F.upper(F.coalesce(T.first_filled("rel_cls_group", "rel_hint_type"), F.lit("TBD"))).alias("group_label"))


@query(r"""select entity_id, cast(json_array_length(a) as int) as n, a as found from (
  select distinct entity_id, nullif(regexp_replace(regexp_extract(answer, '(?s)\[.*\]', 0), ',\s*([\]}])', '\1', 'g'), '') as a
  from (select entity_id, translate('Answer: ```json' || chr(10) || replace(coalesce(chunk_ids, ''), ']', ',]') || chr(10) || '```', '“”‘’', '""''''') as answer from kg_nodes)) where json_valid(a)""")
def f12_json_array(spark: SparkSession, folder: str) -> DataFrame:
    """Arrays from answers with fences and trailing commas."""
    answer = F.concat(F.lit("Answer: ```json\n"), F.replace(F.coalesce("chunk_ids", F.lit("")), F.lit("]"), F.lit(",]")), F.lit("\n```"))
    found = table(spark, folder, "kg_nodes").select("entity_id", T.json_array_text(answer).alias("found")).distinct()
    return found.select("entity_id", F.json_array_length("found").cast("int").alias("n"), "found").filter("n is not null")


@query("select doc_id, substr(sha256(text), 1, 16) as hash from documents where text is not null")
def f15_prompt_hash(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").filter("text is not null").select("doc_id", T.prompt_hash("text").alias("hash"))


@query(r"""select relation_id, seq, string_agg(k || '=' || v, ';' order by k) as qualifiers, count(k) as n
from (select relation_id, seq, k, json_extract_string(q, '$."' || k || '"') as v from (select relation_id, seq, q, unnest(json_keys(q)) as k from (select relation_id, seq, cast(case when json_valid(qualifiers) then qualifiers else '{}' end as json) as q from kg_rels)))
where v is not null and trim(v) <> '' and lower(trim(v)) <> 'null' group by relation_id, seq""")
def f18_qualifiers(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "kg_rels").select("relation_id", "seq", T.qualifiers("qualifiers").alias("q")).filter("size(q) > 0")
    return rows.select("relation_id", "seq", F.array_join(F.transform(F.array_sort(F.map_entries("q")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("qualifiers"), F.size("q").cast("long").alias("n"))


@query("""select seq, len(p) as n, array_to_string(list_transform(p, lambda x: replace(x.prop_name, '"', chr(39)) || '=' || coalesce(replace(x.prop_value, '"', chr(39)), '')), '|') as properties from (
  select seq, from_json(json_array(json_object('prop_name', 'raw "' || coalesce(raw_relation_name, '') || '"', 'prop_value', evidence_excerpt), json_object('prop_name', 'back\\slash', 'prop_value', '5" pipe \\" ' || coalesce(remark, ''))),
    '[{"prop_name":"VARCHAR","prop_value":"VARCHAR"}]') as p from kg_rels)""")
def f20_single_quotes(spark: SparkSession, folder: str) -> DataFrame:
    """Properties that hold quotes and backslashes, as JSON after the rule for quotes and read again from it."""
    fields = lambda name, value: F.struct(name.alias("prop_name"), value.alias("prop_value"))
    first = fields(F.concat(F.lit('raw "'), F.coalesce("raw_relation_name", F.lit("")), F.lit('"')), F.col("evidence_excerpt"))
    second = fields(F.lit("back\\slash"), F.concat(F.lit('5" pipe \\" '), F.coalesce("remark", F.lit(""))))
    stored = table(spark, folder, "kg_rels").select("seq", T.single_quotes(F.to_json(F.array(first, second))).alias("stored"))
    parsed = stored.select("seq", F.from_json("stored", "array<struct<prop_name:string,prop_value:string>>").alias("p"))
    return parsed.select("seq", F.size("p").cast("long").alias("n"), F.array_join(F.transform("p", lambda x: F.concat(x["prop_name"], F.lit("="), F.coalesce(x["prop_value"], F.lit("")))), "|").alias("properties"))


@query(r"""select item_id, regexp_extract(i, '^(.*)_[0-9]+$', 1) as prefix_plain, cast(regexp_extract(i, '_([0-9]+)$', 1) as int) as number, split as split_found from (select item_id, split, ontology || '_' || split || '_' || item_id as i from benchmark)""")
def f21_parse_ids(spark: SparkSession, folder: str) -> DataFrame:
    ids = table(spark, folder, "benchmark").select("item_id", F.concat_ws("_", "ontology", "split", "item_id").alias("i"))
    return ids.select("item_id", F.regexp_extract("i", "^(.*)_[0-9]+$", 1).alias("prefix_plain"), T.id_number("i").alias("number"), T.id_split("i").alias("split_found"))


@query("""select seq, try_cast(trim(confidence) as double) as value, coalesce(try_cast(trim(confidence) as double), 0.0) as value_or_zero from kg_rels""")
def f22_safe_casts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "kg_rels").select("seq", T.to_double("confidence").alias("value"), T.to_double("confidence", 0.0).alias("value_or_zero"))


NGRAM = "(select case when len(w) >= 4 then list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' '))) else [] end)"


@query(f"""with essay as (
  select id, any_value(coalesce(nullif(essay_content, ''), text)) as t from in_plain_text group by id
), words as (
  select g.graph_id, list_filter(regexp_split_to_array(lower(coalesce(e.t, '')), '{WS}+'), lambda x: x <> '') as a,
    list_filter(regexp_split_to_array(lower(array_to_string(g.entities, ' ')), '{WS}+'), lambda x: x <> '') as b
  from baseline_kg g left join essay e on e.id = g.essay_id
), grams as (
  select graph_id, case when len(a) >= 4 then list_distinct(list_transform(range(1, len(a) - 2), lambda i: array_to_string(list_slice(a, i, i + 3), ' '))) else [] end as x,
    case when len(b) >= 4 then list_distinct(list_transform(range(1, len(b) - 2), lambda i: array_to_string(list_slice(b, i, i + 3), ' '))) else [] end as y from words
)
select graph_id, case when len(x) = 0 then 0.0 else round(len(list_intersect(x, y)) / len(x), 6) end as overlap from grams""")
def f24_ngram_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """The share of an essay's 4-grams in the joined entity names of each graph about it."""
    essay = table(spark, folder, "in_plain_text").groupBy("id").agg(F.any_value(F.coalesce(F.nullif("essay_content", F.lit("")), "text")).alias("t"))
    graphs = table(spark, folder, "baseline_kg").select("graph_id", F.col("essay_id").alias("id"), F.array_join("entities", " ").alias("names"))
    return graphs.join(essay, "id", "left").select("graph_id", F.round(T.ngram_overlap("t", "names", 4), 6).alias("overlap"))


@query(rf"""with essay as (select id, string_agg(distinct lower(trim(regexp_replace(coalesce(text, '') || ' ' || coalesce(essay_content, ''), '{WS}+', ' ', 'g'))), ' ') as t from in_plain_text group by id)
select r.seq, (f <> '' and contains(coalesce(e.t, ''), f)) as verbatim from (select seq, essay_id, lower(trim(regexp_replace(coalesce(evidence_excerpt, ''), '{WS}+', ' ', 'g'))) as f from kg_rels) r left join essay e on e.id = r.essay_id""")
def f25_verbatim_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a relation's excerpt stands word for word in its essay."""
    essay = table(spark, folder, "in_plain_text").select("id", T.collapse(F.concat_ws(" ", F.coalesce("text", F.lit("")), F.coalesce("essay_content", F.lit("")))).alias("t")).distinct().groupBy("id").agg(F.array_join(F.collect_list("t"), " ").alias("t"))
    return table(spark, folder, "kg_rels").select("seq", F.col("essay_id").alias("id"), "evidence_excerpt").join(essay, "id", "left").select("seq", T.contains_fact("t", "evidence_excerpt").alias("verbatim"))


@query(f"""with {BODY}, s as (select doc_id, generate_subscripts(sentences, 1) - 1 as pos, unnest(sentences) as sentence from parts)
select doc_id, pos, cast(coalesce(sum(length(sentence)) over w, 0) as bigint) as context_chars, count(*) over w as context_rows from s window w as (partition by doc_id order by pos rows between 4 preceding and 1 preceding)""")
def w01_previous_context(spark: SparkSession, folder: str) -> DataFrame:
    rows = f05_simple_sentences(spark, folder)
    found = chunk.previous_context(rows, 4, "doc_id", "pos", "sentence")
    return found.select("doc_id", "pos", F.aggregate("context", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)).alias("context_chars"), F.size("context").cast("bigint").alias("context_rows"))


@query("""select class_label, entity_id, cast(floor((row_number() over (partition by class_label order by entity_id) - 1) / 10) as int) as bucket
from (select distinct coalesce(class_label, '') as class_label, entity_id from kg_nodes)""")
def w03_buckets(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "kg_nodes").select(F.coalesce("class_label", F.lit("")).alias("class_label"), "entity_id").distinct()
    return chunk.buckets(rows, "class_label", ["entity_id"])


@query(f"""with {BODY}, s as (select doc_id, coalesce(title, '') as t from documents), c as (select doc_id, len(sentences) as n from parts where len(sentences) > 0)
select s.doc_id, 'Sec_' || s.doc_id as id, coalesce(nullif(trim(s.t), ''), 'section_' || s.doc_id) as title, cast(coalesce(c.n, 0) as int) as n_sentences from s left join c using (doc_id)""")
def s01_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as sections, with the default title."""
    docs = table(spark, folder, "documents")
    title = F.coalesce(T.first_filled("title"), F.concat(F.lit("section_"), F.col("doc_id")))
    return docs.select("doc_id", F.concat(F.lit("Sec_"), F.col("doc_id")).alias("id"), title.alias("title"), F.size(T.simple_sentences("text")).alias("n_sentences"))
