"""Mapping free-entered values to a canonical list (problem 1).

Method: token-level repair. Each distinct value is split into tokens, each distinct token is joined with the tokens of
the reference list by edit distance (an equi-join on shared deletion variants, so no token meets the whole list), also
as a truncated or vowel-less form; the repaired tokens are combined by soft TF-IDF to rank whole entries. Values below
the threshold are reported as ``none``. Work is done once for each distinct value and joined back to the records.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspar.llm.pieces import BLANKS
from loomspar.runtime import cut, spread_lookup, table

NONE = "none"
#: Least cosine of a value and an entry. Two words of equal weight of which one fits reach 0.71.
THRESHOLD = 0.75
#: Similarity of a token that differs by that many edits, in words of six letters and more, and in shorter ones.
BY_EDITS, BY_EDITS_SHORT = (1.0, 0.9, 0.8), (1.0, 0.9, 0.6)
#: Similarity of a plural; of a vowel-less or truncated token.
PLURAL, SHORTENED = 0.97, 0.85
#: Tokens that may stand before a value without being part of it.
AUXILIARIES = ("is", "was", "are", "were")
_VOWELS = frozenset("aeiou")


def edits_allowed(length: int) -> int:
    return 0 if length < 2 else 1 if length < 4 else 2


def edit_distance(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, replace, swap of letters that are or become neighbours) from a to b; most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    far = len(a) + len(b)
    rows = [[far] * (len(b) + 2), [far, *range(len(b) + 1)]]
    seen: dict[str, int] = {}
    for i, x in enumerate(a, 1):
        row, last = [far, i], 0
        for j, y in enumerate(b, 1):
            k, m = seen.get(y, 0), last
            if x == y:
                last = j
            row.append(min(rows[i][j] + (x != y), row[j] + 1, rows[i][j + 1] + 1, rows[k][m] + (i - k - 1) + 1 + (j - m - 1)))
        rows.append(row)
        seen[x] = i
    return min(rows[-1][-1], most + 1)


def skeleton(token: str) -> str:
    """The token without vowels but for its first letter."""
    return token[:1] + "".join(c for c in token[1:] if c not in _VOWELS)


def variants(token: str, edits: int) -> set[str]:
    """token with up to that many characters left out."""
    out = {token}
    for n in range(1, min(edits, len(token) - 1) + 1):
        for gone in combinations(range(len(token)), n):
            out.add("".join(c for i, c in enumerate(token) if i not in gone))
    return out


def similarity(token: str, dotted: bool, word: str) -> float:
    """How well a token stands for a word of the list; 0 if it doesn't."""
    if token == word:
        return 1.0
    if dotted and word.startswith(token):
        return SHORTENED
    if token == word + "s":
        return PLURAL
    most = min(edits_allowed(len(token)), edits_allowed(len(word)))
    best = 0.0
    d = edit_distance(token, word, most)
    if d <= most:
        best = (BY_EDITS if min(len(token), len(word)) >= 6 else BY_EDITS_SHORT)[d]
    if len(token) >= 3 and len(token) < len(word) and token == skeleton(word):
        best = max(best, SHORTENED)
    return best


def _keys(of_list: bool, longest: int):
    """Join keys of tokens. A token that exceeds the longest word of the list by more than two letters can mean none of them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for kind, token, dotted in zip(frame["kind"], frame["token"], frame["dotted"], strict=True):
                if len(token) > longest + 2:
                    continue
                keys = variants(token, edits_allowed(len(token)))
                if of_list:
                    keys = keys | {"^" + token[:n] for n in range(1, len(token))} | {"~" + skeleton(token)}
                elif dotted:
                    keys = keys | {"^" + token}
                elif len(token) >= 3:
                    keys = keys | {"~" + token}
                rows.extend((kind, token, dotted, k) for k in keys)
            yield pd.DataFrame(rows, columns=["kind", "token", "dotted", "key"])

    return run


def _verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        frame["sim"] = [similarity(t, d, w) for t, d, w in zip(frame["token"], frame["dotted"], frame["word"], strict=True)]
        yield frame[frame["sim"] > 0]


def tokens(value: Column) -> Column:
    """Lower-case tokens of a value, camel case split and a leading number dropped; a full stop after a token is kept."""
    spaced = F.regexp_replace(F.regexp_replace(value, r"(?<=[\p{Ll}\p{N}])(?=\p{Lu})", " "), r"^[\s\p{Z}\"'(\[]*\p{Nd}{1,3}[.)][\s\p{Z}]+", "")
    found = F.regexp_extract_all(F.lower(spaced), F.lit(r"[\p{L}\p{M}\p{N}]+\.?"), F.lit(0))
    led = (F.size(found) > 1) & F.rtrim(F.get(found, F.lit(0)), F.lit(".")).isin(*AUXILIARIES)
    return F.when(led, F.slice(found, F.lit(2), F.size(found))).otherwise(found)


def map_values(values: DataFrame, entries: DataFrame) -> DataFrame:
    """The entry that each distinct value means.

    values: kind, value, n (records with it); entries: kind, ref_id, name (several names of an entry are several
    rows). Out: kind, value, n, ref_id, score; ref_id is ``none`` where no entry of the kind reaches the threshold. Ties
    go to the smaller ref_id. Values without a letter or digit, and all values where the list is empty, are ``none``.
    """
    names = entries.filter("name is not null and ref_id is not null").distinct()
    listed = cut(names.select("kind", "ref_id", "name", F.explode(F.array_distinct(F.transform(tokens(F.col("name")), lambda t: F.rtrim(t, F.lit("."))))).alias("word")))
    entry_key = F.concat_ws("\u0001", "ref_id", "name").alias("entry")
    size = names.groupBy("kind").agg(F.count("*").alias("size"))
    words = listed.groupBy("kind", "word").agg(F.count("*").alias("df")).join(F.broadcast(size), "kind")  # one row for each list
    words = cut(words.select("kind", "word", F.log1p(F.col("size") / F.col("df")).alias("w")))
    rarest = size.select("kind", F.log1p("size").alias("w_most"))

    split = cut(
        values.select("kind", "value", F.posexplode(tokens(F.col("value"))).alias("pos", "raw"))
        .select("kind", "value", "pos", F.rtrim("raw", F.lit(".")).alias("token"), F.col("raw").endswith(".").alias("dotted"))
        .withColumn("key", F.concat("kind", F.lit("\u0001"), "token", F.lit("\u0001"), F.col("dotted").cast("string")))
    )
    counted = split.groupBy("key", "kind", "token", "dotted").agg(F.count("*").alias("n"))
    schema = "kind string, token string, dotted boolean, key string"
    longest = words.agg(F.max(F.length("word"))).first()[0] or 0
    left = counted.select("kind", "token", "dotted").mapInPandas(_keys(False, longest), schema)
    right = words.select("kind", F.col("word").alias("token"), F.lit(False).alias("dotted")).mapInPandas(_keys(True, longest), schema).select("kind", "key", F.col("token").alias("word"))
    pairs = left.join(right, ["kind", "key"]).select("kind", "token", "dotted", "word").distinct()
    repaired = pairs.mapInPandas(_verify, "kind string, token string, dotted boolean, word string, sim double").join(words, ["kind", "word"])
    dictionary = cut(
        counted.join(repaired.groupBy("kind", "token", "dotted").agg(F.collect_list(F.struct("word", "sim", "w")).alias("words")), ["kind", "token", "dotted"], "left").select("key", "words", "n")
    )
    known = spread_lookup(split, dictionary, "key", "n", "value").join(F.broadcast(rarest), "kind", "left")
    # a token that stands for no word of an entry weighs as the rarest word there could be
    known = cut(known.select("kind", "value", "pos", "words", (F.col("w_most") * F.col("w_most")).alias("own")))
    weight = known.groupBy("kind", "value").agg(F.sum("own").alias("own_total"))
    norms = listed.join(words, ["kind", "word"]).groupBy("kind", entry_key, "ref_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    hits = (
        known.select("kind", "value", "pos", "own", F.explode("words").alias("x")).select("kind", "value", "pos", "own", "x.*")
        .join(listed.select("kind", "word", entry_key), ["kind", "word"])
        .groupBy("kind", "value", "entry", "pos", "own").agg(F.max(F.struct("sim", "w", "word")).alias("m"))
        # a word of an entry stands for one token only, however often a value repeats it
        .groupBy("kind", "value", "entry", "m.word", "m.w", "own").agg(F.max("m.sim").alias("sim"))
        .groupBy("kind", "value", "entry")
        .agg(F.sum(F.col("sim") * F.col("w") * F.col("w")).alias("dot"), F.sum(F.col("w") * F.col("w") - F.col("own")).alias("shift"))
    )
    scored = hits.join(weight, ["kind", "value"]).join(norms, ["kind", "entry"]).select("kind", "value", "ref_id", F.round(F.col("dot") / F.sqrt(F.col("own_total") + F.col("shift")) / F.col("norm"), 9).alias("score"))
    best = scored.filter(F.col("score") >= THRESHOLD).groupBy("kind", "value").agg(F.min(F.struct((-F.col("score")).alias("minus"), "ref_id")).alias("b"))
    return values.join(best, ["kind", "value"], "left").select("kind", "value", "n", F.coalesce("b.ref_id", F.lit(NONE)).alias("ref_id"), (-F.col("b.minus")).alias("score"))


def unresolved(column: str) -> Column:
    text = F.btrim(F.col(column), F.lit(BLANKS))
    return F.col(column).isNull() | (text == "") | (F.upper(text) == "TBD")


def entries_of(spark: SparkSession, folder: str) -> DataFrame:
    """(kind, ref_id, name): the labels and alternative labels of both reference lists."""
    names = F.explode(F.concat(F.array("label"), F.coalesce("alt_labels", F.array().cast("array<string>")))).alias("name")
    relations = table(spark, folder, "ref_relations").select(F.lit("relation").alias("kind"), F.col("pid").alias("ref_id"), names)
    concepts = table(spark, folder, "ref_concepts").select(F.lit("concept").alias("kind"), F.col("qid").alias("ref_id"), names)
    return relations.unionByName(concepts)


def map_records(records: DataFrame, entries: DataFrame) -> DataFrame:
    """(record_id, kind, value, ref_id, score) of each distinct record (record_id, kind, value); null or blank values have no row."""
    keyed = records.select("record_id", "kind", "value").filter((F.btrim(F.col("value"), F.lit(BLANKS)) != "") & F.col("record_id").isNotNull()).withColumn("key", F.concat_ws("\u0001", "kind", "value"))
    values = cut(keyed.groupBy("kind", "value").agg(F.count("*").alias("n")))
    mapped = cut(map_values(values, entries).select(F.concat_ws("\u0001", "kind", "value").alias("key"), "ref_id", "score", "n"))
    return spread_lookup(keyed, mapped, "key", "n", "record_id").drop("key").distinct()


def found(spark: SparkSession, folder: str) -> DataFrame:
    """p1_found: unresolved relation names and type hints with the entry that was meant."""
    relations = table(spark, folder, "kg_rels").filter(unresolved("canonical_rel_name")).select(F.col("relation_id").alias("record_id"), F.lit("relation").alias("kind"), F.col("raw_relation_name").alias("value"))
    entities = table(spark, folder, "kg_nodes").filter(unresolved("class_label")).select(F.col("entity_id").alias("record_id"), F.lit("concept").alias("kind"), F.col("entity_type_hint").alias("value"))
    return map_records(relations.unionByName(entities), entries_of(spark, folder)).select("record_id", "ref_id").distinct()
