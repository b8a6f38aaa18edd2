"""Scalar text, JSON and number functions. All are expressions of built-in functions and stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as str.split() knows it (a regular expression class without brackets).
SPACE = r"\s\p{Z}\x{85}\x{1c}-\x{1f}"
TOKENS_PER_WORD = 1.25
# Fixed value: the shape of a heading line.
HEADING = r"^\s*\d+(\.\d+)*\s+[\p{L}\p{N}_\-\(\) ]{1,80}$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(text: Column | str) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(col(text), f"^[{SPACE}]+|[{SPACE}]+$", "")


def words(text: Column | str) -> Column:
    """The words between white space; null for null."""
    return F.filter(F.split(col(text), f"[{SPACE}]+"), lambda w: w != "")


def word_count(text: Column | str) -> Column:
    return F.coalesce(F.size(words(text)), F.lit(0))


def tokens_fast(text: Column | str) -> Column:
    """Estimate by words: 0 for an empty or null text, else at least 1."""
    return F.when(F.coalesce(col(text), F.lit("")) == "", F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(word_count(text) * TOKENS_PER_WORD))).cast("int")


def tokens_words(text: Column | str) -> Column:
    return F.greatest(F.lit(1), word_count(text)).cast("int")


def tokens_chars(text: Column | str) -> Column:
    return F.floor(F.length(F.coalesce(col(text), F.lit(""))) / 4).cast("int")


def strip_fences(text: Column | str) -> Column:
    """Without outer white space and one pair of backtick fences."""
    outer = strip(text)
    inner = strip(F.substring(outer, F.lit(4), F.length(outer) - 6))
    return F.when(outer.startswith("```") & outer.endswith("```") & (F.length(outer) >= 6), inner).otherwise(outer)


def simple_sentences(text: Column | str) -> Column:
    """Rule-based sentences: the lines if there are several, else a split after . ? ! before a capital, digit or opening mark."""
    body = strip_fences(F.coalesce(col(text), F.lit("")))
    lines = F.filter(F.transform(F.split(body, r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"), strip), lambda x: x != "")
    parts = F.filter(F.transform(F.split(body, f"(?<=[.?!])[{SPACE}]+(?=[A-Z0-9\"'(\\[])"), strip), lambda x: x != "")
    return F.when(body == "", F.array().cast("array<string>")).when(F.contains(body, F.lit("\n")), lines).otherwise(parts)


def is_heading(text: Column | str) -> Column:
    plain = strip(text)
    return F.coalesce(col(text).rlike(HEADING) | ((F.length(col(text)) < 120) & plain.endswith("Mechanisms") & col(text).rlike(r"\d")), F.lit(False))


def safe_text(value: Column | str) -> Column:
    """"" for null; line breaks become blanks; trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(col(value), F.lit("")), r"\n", " "))


def collapse(value: Column | str) -> Column:
    """Runs of white space become one blank; "" for null."""
    return F.trim(F.regexp_replace(F.coalesce(col(value), F.lit("")), f"[{SPACE}]+", " "))


def clip(value: Column | str, size: int, mark: str = "...") -> Column:
    """The first ``size`` characters, with a mark where something was cut off."""
    v = F.coalesce(col(value), F.lit(""))
    return F.when(F.length(v) > size, F.concat(F.substring(v, 1, size), F.lit(mark))).otherwise(v)


def clip_words(value: Column | str, size: int) -> Column:
    """White space collapsed, cut at ``size`` characters back to the last blank, with ``...``."""
    v = collapse(value)
    head = F.substring(v, 1, size)
    cut = F.when(F.contains(head, F.lit(" ")), F.regexp_extract(head, "(?s)^(.*) ", 1)).otherwise(head)
    return F.when(F.length(v) > size, F.concat(cut, F.lit("..."))).otherwise(v)


def first_filled(*values: Column | str) -> Column:
    """The first value that isn't null or blank, trimmed."""
    return F.coalesce(*(F.nullif(F.trim(col(v)), F.lit("")) for v in values))


def json_array_text(text: Column | str) -> Column:
    """The JSON array in a model's answer: fences and typographic quotes repaired, trailing commas dropped; null without one."""
    plain = F.translate(F.coalesce(col(text), F.lit("")), "“”‘’", "\"\"''")
    found = F.regexp_extract(plain, r"(?s)\[.*\]", 0)
    return F.nullif(F.regexp_replace(found, r",\s*([\]}])", "$1"), F.lit(""))


def json_object_text(text: Column | str) -> Column:
    """From the first { to the last }; null without one."""
    return F.nullif(F.regexp_extract(F.coalesce(col(text), F.lit("")), r"(?s)\{.*\}", 0), F.lit(""))


def fix_escapes(text: Column | str) -> Column:
    """Doubles backslashes that begin no JSON escape, and CRLF becomes LF."""
    return F.regexp_replace(F.regexp_replace(col(text), r"\r\n", "\n"), r'\\(?!["\\/bfnrtu])', r"\\\\")


def prompt_hash(text: Column | str) -> Column:
    return F.substring(F.sha2(col(text), 256), 1, 16)


def content_id(prefix: str, size: int, *values: Column | str) -> Column:
    """An identifier that depends on content alone, so that a repeated task gives the same one."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\u0001", *(F.coalesce(col(v).cast("string"), F.lit("")) for v in values)), 256), 1, size))


def ordered_unique(values: Column | str, filled: bool = False) -> Column:
    """Distinct elements, first occurrences kept in order; filled: null and blank ones dropped."""
    out = F.array_distinct(col(values))
    return F.filter(out, lambda x: x.isNotNull() & (x != "")) if filled else out


def id_prefix(value: Column | str) -> Column:
    """``<prefix>_(train|test)_<n>`` or ``<prefix>_<n>``: the prefix; else the whole id."""
    v = col(value)
    return F.when(v.rlike(r"^.*?_(train|test)_\d+$"), F.regexp_extract(v, r"^(.*?)_(train|test)_\d+$", 1)).when(v.rlike(r"^.*_[0-9]+$"), F.regexp_extract(v, r"^(.*)_([0-9]+)$", 1)).otherwise(v)


def id_number(value: Column | str) -> Column:
    return F.coalesce(F.regexp_extract(col(value), r"_([0-9]+)$", 1).try_cast("int"), F.lit(-1))


def id_split(value: Column | str) -> Column:
    v = F.lower(F.coalesce(col(value), F.lit("")))
    return F.when(v.rlike("(^|_)train(_|$)"), "train").when(v.rlike("(^|_)valid(_|$)"), "valid").when(v.rlike("(^|_)test(_|$)"), "test").otherwise("all")


def to_double(value: Column | str, default: float | None = None) -> Column:
    cast = F.trim(col(value).cast("string")).try_cast("double")
    return cast if default is None else F.coalesce(cast, F.lit(default))


def to_int(value: Column | str, default: int | None = None) -> Column:
    cast = F.trim(col(value).cast("string")).try_cast("double").cast("bigint")
    return cast if default is None else F.coalesce(cast, F.lit(default))


def percent(value: Column | str, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", col(value).cast("double") * 100)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once: an expression that a lambda mentions is computed again for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ngrams(text: Column | str, n: int) -> Column:
    """Distinct n-grams of the lower-case words."""

    def of(w: Column) -> Column:
        some = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " ")))
        return F.when(F.size(w) >= n, some).otherwise(F.array().cast("array<string>"))

    return bound(words(F.lower(F.coalesce(col(text), F.lit("")))), of)


def ngram_overlap(text: Column | str, other: Column | str, n: int = 4) -> Column:
    """The share of the text's n-grams that occur in the other text; 0 without n-grams."""
    return bound(ngrams(text, n), lambda own: F.when(F.size(own) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(own, ngrams(other, n))) / F.size(own)))


def contains_fact(context: Column | str, fact: Column | str) -> Column:
    """Whether the fact stands in the context word for word; white space and case don't matter. Empty facts don't."""
    return F.coalesce((collapse(fact) != "") & F.contains(F.lower(collapse(context)), F.lower(collapse(fact))), F.lit(False))


def qualifiers(value: Column | str) -> Column:
    """A JSON object of qualifiers as a map without null, blank and "null" values; empty for null or broken text."""
    raw = F.coalesce(F.from_json(col(value), "map<string,string>"), F.create_map().cast("map<string,string>"))
    return F.map_filter(raw, lambda _, v: v.isNotNull() & (F.trim(v) != "") & (F.lower(F.trim(v)) != "null"))


def qualifiers_subset(small: Column | str, large: Column | str) -> Column:
    return F.forall(F.map_entries(col(small)), lambda e: F.try_element_at(col(large), e["key"]).eqNullSafe(e["value"]))


def map_text(value: Column | str) -> Column:
    """A map as text in order of its keys: maps themselves can't be grouped or compared."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(col(value)))))


def single_quotes(value: Column | str) -> Column:
    """JSON text whose values and keys hold no double quotes, so that it can be stored in CSV: they become single ones.

    Inside a JSON string a double quote is always escaped, which tells it from the ones that delimit; the text stays JSON at
    any depth. Null stays null.
    """
    return F.regexp_replace(col(value), r'(?<!\\)((?:\\\\)*)\\(?:"|u0022)', "$1'")
