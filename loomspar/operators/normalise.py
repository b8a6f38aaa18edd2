"""Records brought to fixed schemas: aliases, defaults, lists for readers, texts for prompts and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspar.functions import text as T
from loomspar.operators.records import UNSET

PROPERTY = "array<struct<prop_name:string,prop_value:string,justification:string>>"
# The grades of a judgement, and the setters of relation schemas.
JUDGEMENTS = ("Equivalent", "Narrower", "Broader", "Unrelated")
SETTERS = ("set_canonical_rel", "set_rel_cls", "set_rel_cls_group", "modify_rel_schema")
# Under which names the fields of records come, first choice first.
ENTITY_ALIASES = {
    "entity_id": ("entity_id", "id", "node_id"), "entity_name": ("entity_name", "name", "canonical_name", "label"), "entity_description": ("entity_description", "description"),
    "entity_type_hint": ("entity_type_hint", "type_hint", "type"), "class_label": ("class_label", "_class_label"), "class_group": ("class_group", "_class_group"), "node_properties": ("node_properties",),
}
RELATION_ALIASES = {
    "relation_id": ("relation_id", "id", "rid"), "start_id": ("start_id", "subject_entity_id", "subject_id", "subject_entity", "subject_entity_name", "subject"), "end_id": ("end_id", "object_entity_id", "object_id", "object_entity", "object_entity_name", "object"),
    "raw_relation_name": ("raw_relation_name", "relation_name", "rel_name"), "canonical_rel_name": ("canonical_rel_name", "canonical"), "canonical_rel_desc": ("canonical_rel_desc", "canonical_desc"), "rel_cls": ("rel_cls", "relation_class"),
    "rel_cls_group": ("rel_cls_group", "relation_class_group", "rel_group"), "rel_hint_type": ("rel_hint_type", "hint"), "confidence": ("confidence",), "resolution_context": ("resolution_context", "resolution"), "justification": ("justification",),
    "remark": ("remark", "remarks"), "evidence_excerpt": ("evidence_excerpt", "evidence"), "chunk_id": ("chunk_id", "source_chunk", "context_chunk"), "qualifiers": ("qualifiers", "qualifier"), "rel_desc": ("rel_desc", "relation_description"),
}


def aliased(rows: DataFrame, name: str, aliases: dict[str, tuple[str, ...]], default: str | None = None) -> Column:
    """The first filled of the columns that a field may come under; columns that rows don't have are passed over."""
    there = [F.col(c).cast("string") for c in aliases[name] if c in rows.columns]
    return F.coalesce(*(T.first_filled(c) for c in there), F.lit(default).cast("string")).alias(name)


def entity_records(rows: DataFrame) -> DataFrame:
    """Entities under any of their column names (JSON lines or CSV) as (entity_id, name, description, hint, class, group, properties); rows without an id are left out."""
    fields = [aliased(rows, c, ENTITY_ALIASES, {"class_label": UNSET, "class_group": UNSET, "entity_id": None}.get(c, "")) for c in ENTITY_ALIASES if c != "node_properties"]
    properties = F.coalesce(F.from_json(aliased(rows, "node_properties", ENTITY_ALIASES), PROPERTY), F.array().cast(PROPERTY))
    return rows.select(*fields, properties.alias("node_properties")).filter("entity_id is not null")


def relation_records(rows: DataFrame) -> DataFrame:
    """Relations under any of their column names for reading schemas; those without an id or an end are left out, the group is upper case."""
    of = lambda c, default=None: aliased(rows, c, RELATION_ALIASES, default)
    picked = rows.select(of("relation_id"), of("start_id"), of("end_id"), of("raw_relation_name", ""), of("canonical_rel_name"), of("canonical_rel_desc", ""), of("rel_cls", UNSET), of("rel_cls_group"), of("rel_hint_type"), of("qualifiers"))
    whole = picked.filter("relation_id is not null and start_id is not null and end_id is not null")
    return whole.select(
        "relation_id", "start_id", "end_id", "raw_relation_name", F.coalesce("canonical_rel_name", F.nullif("raw_relation_name", F.lit("")), F.lit(UNSET)).alias("canonical_rel_name"), "canonical_rel_desc", "rel_cls",
        F.upper(F.coalesce("rel_cls_group", "rel_hint_type", F.lit(UNSET))).alias("rel_cls_group"), T.qualifiers("qualifiers").alias("qualifiers"),
    )


def export_relations(rows: DataFrame) -> DataFrame:
    """The 17 columns of the relation file; what isn't given is empty, qualifiers are an object."""
    return rows.select(*(T.single_quotes(aliased(rows, c, RELATION_ALIASES, "{}")).alias(c) if c == "qualifiers" else aliased(rows, c, RELATION_ALIASES, "") for c in RELATION_ALIASES))


def fixed_entities(entities: DataFrame) -> DataFrame:
    """Entities with all their fields: what was merged into one and its members are the entity itself where nothing is given.

    entities: id, entity_name, entity_description, entity_type_hint, confidence_score, resolution_context, node_properties
    array, merged_from array<string>.
    """
    own = F.struct("id", "entity_name", "entity_description", "entity_type_hint")
    return entities.select(
        "id", "entity_name", "entity_description", "entity_type_hint", "confidence_score", "resolution_context", F.coalesce("node_properties", F.array().cast(PROPERTY)).alias("node_properties"),
        F.coalesce("merged_from", F.array("id")).alias("merged_from"), F.array(own).alias("members"), F.array().cast("array<string>").alias("merge_history"),
    )


def nested_values(json_text: Column | str, key: str) -> Column:
    """All strings that stand under a key at any depth of a JSON text, alone or in a list, once each in their order.

    A key is told from a value that looks like it by the colon behind it; inside strings its quotes would be escaped.
    """
    string = r'"(?:[^"\\]|\\.)*"'
    found = F.regexp_extract_all(T.col(json_text), F.lit(rf'(?<!\\)"{key}"\s*:\s*({string}|\[(?:{string}|[^"\]])*\])'), F.lit(1))
    lists = F.transform(found, lambda x: F.from_json(F.when(x.startswith("["), x).otherwise(F.concat(F.lit("["), x, F.lit("]"))), "array<string>"))
    return T.ordered_unique(F.flatten(F.coalesce(F.filter(lists, lambda x: x.isNotNull()), F.array().cast("array<array<string>>"))), filled=True)


def class_inputs(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Entities as class recognition takes them: (seq, id, entity_name, entity_description, entity_type_hint, resolution_context, flag, chunk_ids).

    rows: seq, id, canonical_id, entity_name, entity_description, entity_type_hint, resolution_context, text_span, flag,
    merged_from array, record (JSON); chunks: id, chunk_id of the raw entities. An id that is missing is made of the name
    and seq; chunk ids are those anywhere in the record and those of the raw entities that were merged, in this order.
    """
    name = F.replace(F.substring(F.trim(F.coalesce("entity_name", F.lit("no_name"))), 1, 1 << 20), F.lit(" "), F.lit("_"))
    made = F.concat(F.lit("Tmp_"), F.substring(F.when(name == "", F.lit("no_name")).otherwise(name), 1, 40), F.lit("_"), F.col("seq").cast("string"))
    own = rows.select("seq", F.posexplode(nested_values("record", "chunk_id")).alias("pos", "chunk_id")).select("seq", F.struct(F.lit(0).alias("part"), "pos", "chunk_id").alias("c"))
    sources = rows.select("seq", F.posexplode("merged_from").alias("pos", "id")).join(chunks, "id").select("seq", F.struct(F.lit(1).alias("part"), "pos", "chunk_id").alias("c"))
    gathered = own.unionByName(sources).groupBy("seq", "c.chunk_id").agg(F.min("c").alias("c")).groupBy("seq").agg(F.transform(F.array_sort(F.collect_list("c")), lambda x: x["chunk_id"]).alias("chunk_ids"))
    filled = lambda *c: F.coalesce(T.first_filled(*c), F.lit(""))
    out = rows.join(gathered, "seq", "left")
    return out.select(
        "seq", F.coalesce(T.first_filled("id", "canonical_id"), made).alias("id"), filled("entity_name").alias("entity_name"), filled("entity_description").alias("entity_description"), filled("entity_type_hint").alias("entity_type_hint"),
        filled("resolution_context", "text_span").alias("resolution_context"), F.coalesce(T.first_filled("flag"), F.lit("entity_raw")).alias("flag"), F.coalesce("chunk_ids", F.array().cast("array<string>")).alias("chunk_ids"),
    )


def relation_defaults(relations: DataFrame) -> DataFrame:
    """Relations with the fields of a schema set: TBD where nothing is resolved, an empty description, remarks as a list of filled texts, qualifiers as an object."""
    unset = lambda c: F.coalesce(T.first_filled(c), F.lit(UNSET)).alias(c)
    remarks = F.filter(F.concat(F.coalesce("remarks", F.array().cast("array<string>")), F.array(F.trim("remark"))), lambda x: x.isNotNull() & (x != ""))
    return relations.select("relation_id", unset("canonical_rel_name"), F.coalesce("canonical_rel_desc", F.lit("")).alias("canonical_rel_desc"), unset("rel_cls"), unset("rel_cls_group"), remarks.alias("remarks"), F.coalesce("qualifiers", F.lit("{}")).alias("qualifiers"))


def known_candidates(candidates: DataFrame, groups: DataFrame, single: bool = False) -> DataFrame:
    """Class candidates whose members were in the prompt: (group_id, candidate, label, member_ids).

    candidates: group_id, candidate, label, member_ids; groups: group_id, ids. Unknown members are dropped; candidates
    without a label or member are, and where several entities were given, those with one member, unless single is set.
    """
    joined = candidates.join(groups, "group_id").withColumn("member_ids", F.filter("member_ids", lambda m: F.array_contains(F.col("ids"), m)))
    enough = F.when((F.size("ids") > 1) & (not single), 2).otherwise(1)
    return joined.filter((F.trim(F.coalesce("label", F.lit(""))) != "") & (F.size("member_ids") >= enough)).select("group_id", "candidate", "label", "member_ids")


def member_objects(candidates: DataFrame, entities: DataFrame) -> DataFrame:
    """(candidate, members) with the known entities of ``member_ids`` in its order; candidates without any have no row. Entities: id and what is shown."""
    each = candidates.select("candidate", F.posexplode("member_ids").alias("pos", "id")).join(entities, "id")
    shown = F.struct("pos", "id", *[c for c in entities.columns if c != "id"])
    return each.groupBy("candidate").agg(F.array_sort(F.collect_list(shown)).alias("members"))


def class_texts(classes: DataFrame, members: DataFrame) -> DataFrame:
    """(class_id, label, description, hint, evidence, members_text), cut at 120, 300, 80, 200 and 1000 characters.

    members: class_id, pos, entity_name, entity_type_hint, entity_description. Of a class's members no more are gathered
    than can show in the text.
    """
    part = lambda c, n: F.substring(T.safe_text(c), 1, n)
    line = F.concat(T.safe_text("entity_name"), F.lit(" ("), T.safe_text("entity_type_hint"), F.lit(") - "), part("entity_description", 120))
    # a line has six characters at least and a separator three
    lines = members.select("class_id", F.struct("pos", line.alias("line")).alias("m")).groupBy("class_id").agg(F.array_sort(F.collect_list(F.when(F.col("m.pos") < 112, F.col("m")))).alias("ms"))
    text = F.substring(F.array_join(F.transform("ms", lambda m: m["line"]), " ; "), 1, 1000)
    out = classes.join(lines, "class_id", "left")
    return out.select("class_id", part("label", 120).alias("label"), part("description", 300).alias("description"), part("hint", 80).alias("hint"), part("evidence", 200).alias("evidence"), F.coalesce(text, F.lit("")).alias("members_text"))


def _tagged(*pairs: tuple[str, Column]) -> list[Column]:
    return [F.when(c != "", F.concat(F.lit(f"[{tag}:"), c, F.lit("]"))) if tag else F.nullif(c, F.lit("")) for tag, c in pairs]


def evaluation_entity_texts(nodes: DataFrame) -> DataFrame:
    s = T.safe_text
    return nodes.select(s("entity_id").alias("entity_id"), s("entity_name").alias("name"), s("entity_description").alias("description"), F.concat_ws(" ; ", *_tagged(("CLASS", s("class_label")), ("GROUP", s("class_group")), ("PROPS", s("node_properties")))).alias("context"))


def evaluation_relation_texts(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """(relation_id, name, description, head_tail, context) of relations for evaluation; unknown ends have no tags."""
    s = T.safe_text
    side = lambda p: nodes.select(F.col("entity_id").alias(f"{p}_id"), s("entity_name").alias(f"{p}_name"), s("class_label").alias(f"{p}_class"))
    rows = relations.join(side("start"), "start_id", "left").join(side("end"), "end_id", "left")
    filled = lambda *c: F.coalesce(T.first_filled(*(s(x) for x in c)), F.lit(""))
    ends = F.concat_ws(" ", *_tagged(("H", F.col("start_name")), ("HCLS", F.col("start_class")), ("T", F.col("end_name")), ("TCLS", F.col("end_class"))))
    return rows.select(
        "relation_id", filled("canonical_rel_name", "raw_relation_name").alias("name"), F.concat_ws(" ; ", *_tagged(("", filled("rel_desc", "canonical_rel_desc")), ("", s("qualifiers")))).alias("description"), ends.alias("head_tail"),
        F.concat_ws(" ; ", *_tagged(("", s("canonical_rel_name")), ("", s("canonical_rel_desc")), ("CLS", s("rel_cls")))).alias("context"),
    )


def judgements(answers: DataFrame) -> DataFrame:
    """Items of a judge's answers (key, ref_label, answer): unlabelled ones dropped, unknown grades are Unrelated, a confidence that is no number is 0.

    Out: key, pos, ref_label (the answer's own before the one that was asked for), item_label, judgement, usable, confidence, justification.
    """
    item = "struct<item_label:string,judgement:string,usable_as_schema:boolean,confidence:string,justification:string,note:string>"
    parsed = answers.withColumn("a", F.from_json(T.json_object_text("answer"), f"struct<ref_label:string,items:array<{item}>>"))
    rows = parsed.select("key", F.coalesce(T.first_filled("a.ref_label"), F.col("ref_label")).alias("ref_label"), F.posexplode("a.items").alias("pos", "i"))
    grade = T.collapse("i.judgement")
    return rows.select(
        "key", "pos", "ref_label", T.collapse(F.coalesce("i.item_label", F.lit(""))).alias("item_label"), F.when(grade.isin(*JUDGEMENTS), grade).otherwise("Unrelated").alias("judgement"), F.coalesce("i.usable_as_schema", F.lit(False)).alias("usable"),
        T.to_double("i.confidence", 0.0).alias("confidence"), F.coalesce(T.first_filled("i.justification", "i.note"), F.lit("")).alias("justification"),
    ).filter("item_label <> ''")


def with_class(entities: DataFrame, classes: DataFrame) -> DataFrame:
    """Every entity with its class, null without one; of an entity in several classes the last one counts.

    entities: id and its fields; classes: seq, class_id, class_label, class_group, members array<struct with id and any of the fields>.
    An entity's field comes from the class's copy where that has it, else from the entity.
    """
    assigned = classes.select("seq", "class_id", "class_label", "class_group", F.explode("members").alias("m")).filter("m.id is not null")
    last = assigned.groupBy(F.col("m.id").alias("id")).agg(F.max(F.struct("seq", "class_id", "class_label", "class_group", "m")).alias("c"))
    copied = {f.name for f in classes.schema["members"].dataType.elementType.fields}
    own = [F.coalesce(F.nullif(F.col(f"c.m.{c}"), F.lit("")), F.col(f"e.{c}")).alias(c) if c in copied else F.col(f"e.{c}") for c in entities.columns if c != "id"]
    return entities.alias("e").join(last, "id", "left").select("id", *own, "c.class_id", "c.class_label", "c.class_group")


def with_missing_ends(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Relations (relation_id, start_id, end_id, given map<string,string>) with class and name of their ends where ``given`` lacks the key; a key that is there stays, null too. Both ends must be known."""
    side = lambda p, name: nodes.select(F.col("entity_id").alias(p), *(F.col(c).alias(f"{name}_{c}") for c in ("class_label", "class_group", "entity_name")))
    rows = relations.join(side("start_id", "subject"), "start_id").join(side("end_id", "object"), "end_id")
    keys = [f"{s}_{c}" for s in ("subject", "object") for c in ("class_label", "class_group", "entity_name")]
    return rows.select("relation_id", *(F.when(F.array_contains(F.map_keys("given"), k), F.try_element_at("given", F.lit(k))).otherwise(F.col(k)).alias(k) for k in keys))


def ranked_judgements(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Candidate pairs (ref_label, item_label, rank) with their judgement; of several the last (greatest pos) counts, without one it is Unrelated."""
    last = items.groupBy("ref_label", "item_label").agg(F.max(F.struct("pos", "judgement", "confidence")).alias("j"))
    return pairs.join(last, ["ref_label", "item_label"], "left").select("ref_label", "item_label", "rank", F.coalesce("j.judgement", F.lit("Unrelated")).alias("judgement"), F.coalesce("j.confidence", F.lit(0.0)).alias("confidence"))


def clusters(rows: DataFrame, label: str, seq: str, member: str, noise: bool = True) -> DataFrame:
    """(label, members, size, place): members of each label in the order of seq; places by label with noise (-1) last, or left out."""
    kept = rows if noise else rows.filter(F.col(label) != -1)
    groups = kept.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(member).alias("m")))), lambda x: x["m"]).alias("members"), F.count("*").alias("size"))
    order = F.struct((F.col(label) == -1).alias("noise"), F.col(label).alias("label"))
    return groups.withColumn("order", order)


def relation_action_summary(log: DataFrame) -> DataFrame:
    """(cluster, actions, schema_actions, merges, errors) of the calls on relations; merges aren't schema actions. log: cluster, action, error."""
    n = lambda c, name: F.sum(F.when(c, 1).otherwise(0)).cast("bigint").alias(name)
    return log.groupBy("cluster").agg(F.count("*").alias("actions"), n(F.col("action").isin(*SETTERS), "schema_actions"), n(F.col("action") == "merge_relations", "merges"), n(F.col("error"), "errors"))


def relation_items(relations: DataFrame) -> DataFrame:
    """(name, count, surfaces, evidence, examples, domains, ranges): of each resolved relation the first 25 surface forms, 20 pieces of evidence and 10 example pairs in order of seq, and all classes of its ends.

    relations: seq, name, surface, evidence, start_name, end_name, start_class, end_class. Values are made distinct before they are gathered, and only the first are.
    """
    named = relations.filter("name <> ''")
    out = named.groupBy("name").agg(F.count("*").alias("count"))
    example = F.when(F.col("start_name").isNotNull() & F.col("end_name").isNotNull(), F.concat("start_name", F.lit(" -> "), "end_name"))
    for value, column, most in ((F.col("surface"), "surfaces", 25), (F.col("evidence"), "evidences", 20), (example, "examples", 10), (F.col("start_class"), "domains", None), (F.col("end_class"), "ranges", None)):
        each = named.select("name", "seq", T.first_filled(value).alias("v")).filter("v is not null").groupBy("name", "v").agg(F.min("seq").alias("seq"))
        key = F.struct("seq", "v") if most else F.struct("v", "seq")
        gathered = F.transform(F.array_sort(F.collect_list(key)), lambda x: x["v"])
        out = out.join(each.groupBy("name").agg((F.slice(gathered, 1, most) if most else gathered).alias(column)), "name", "left")
    empty = F.array().cast("array<string>")
    return out.select("name", "count", *(F.coalesce(c, empty).alias(c) for c in ("surfaces", "evidences", "examples", "domains", "ranges")))


def counted_tree(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by all keys with the order of reports: larger groups first at every level, then names without regard to case."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("sort_key", F.struct((-F.col("n")).alias("n"), *(F.lower(k).alias(k) for k in keys)))


def answer_text(answer: Column | str) -> Column:
    """A model's answer as plain text: a JSON string is read, of an object the first of its text, content, output or message fields, of a list all items by line; other text stays."""
    raw = F.coalesce(T.col(answer), F.lit(""))
    fields = [F.get_json_object(raw, f"$.{k}") for k in ("text", "content", "output", "message")]
    items = F.from_json(raw, "array<string>")
    text = F.array_join(F.transform(items, lambda x: F.coalesce(F.get_json_object(x, "$.text"), F.get_json_object(x, "$.content"), x)), "\n")
    return F.when(F.ltrim(raw).startswith("{"), F.coalesce(*fields, raw)).when(F.ltrim(raw).startswith("[") & items.isNotNull(), text).when(F.ltrim(raw).startswith('"'), F.coalesce(F.from_json(F.concat(F.lit("["), raw, F.lit("]")), "array<string>")[0], raw)).otherwise(raw)


def figure_scalars(rows: DataFrame) -> DataFrame:
    """Values as figures show them: clustering times five up to 1, one minus leakage, distance of the compression ratio from 1, the composite in per cent."""
    return rows.withColumns({"clustering_shown": F.least(F.col("clustering") * 5, F.lit(1.0)), "no_leakage": 1 - F.col("leakage"), "compression_gap": F.abs(F.col("compression") - 1), "composite_percent": F.col("composite") * 100})


def name_texts(nodes: DataFrame) -> DataFrame:
    """(id, text): the name alone, or the id where it is blank."""
    return nodes.select("id", F.coalesce(T.first_filled("entity_name"), F.col("id")).alias("text"))


def schema_edits(relations: DataFrame, calls: DataFrame) -> DataFrame:
    """Relations after ordered ``modify_rel_schema`` and ``add_rel_remark`` calls (seq, relation_id, function, name, cls, cls_group, remark).

    Filled fields overwrite, the last of them wins; the name a relation had before its first renaming is kept once; remarks
    are added in order. relations: relation_id, name, cls, cls_group, remarks array. Calls on unknown relations have no effect.
    """
    edit = F.col("function") == "modify_rel_schema"
    last = lambda c: F.max(F.when(edit & (T.safe_text(c) != ""), F.struct("seq", F.trim(c).alias("v"))))["v"].alias(f"new_{c}")
    remark = F.when((F.col("function") == "add_rel_remark") & (T.safe_text("remark") != ""), F.struct("seq", F.trim("remark").alias("v")))
    folded = calls.groupBy("relation_id").agg(*(last(c) for c in ("name", "cls", "cls_group")), F.transform(F.array_sort(F.collect_list(remark)), lambda x: x["v"]).alias("added"))
    rows = relations.join(folded, "relation_id", "left")
    none = F.array().cast("array<string>")
    return rows.select(
        "relation_id", *(F.coalesce(f"new_{c}", c).alias(c) for c in ("name", "cls", "cls_group")), F.when(F.col("new_name").isNotNull() & (F.col("new_name") != F.col("name")), F.col("name")).alias("original_name"),
        F.concat(F.coalesce("remarks", none), F.coalesce("added", none)).alias("remarks"),
    )
