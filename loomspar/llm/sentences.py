"""Sentence boundaries across languages and scripts (problem 2).

Method: unsupervised boundary statistics (after Kiss and Strunk). The language of a paragraph is told by its words, whose
frequencies in each language are learned from texts that say their language. One pass over all texts counts, for each language,
types with and without a final period, what follows these periods, and words at certain sentence starts. From the
counts, by log-likelihood ratios: abbreviations; sentence starters; numbers and words that stick to a period before
them (collocations); and whether an abbreviation can end a sentence. A second pass classifies each period with
these statistics. Marks that need no statistics (? ! and those of scripts with their own full stop), quotations,
brackets, list items, blank lines and the blanks of Thai are decided by rule.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspar.runtime import cut, table

# Scripts that are told apart; a text without a known word counts with its script.
SCRIPTS = (("cyrillic", r"\p{Cyrillic}"), ("arabic", r"\p{Arabic}"), ("devanagari", r"\p{Devanagari}"), ("thai", r"\p{Thai}"), ("cjk", r"[\p{Han}\p{Hiragana}\p{Katakana}]"))

#: About so many texts with a stated language are read to learn its words. A word counts from that share of a language's
#: words on (so at most 1 / share of them do), a language from that share of all words on.
LABELLED, COMMON_WORD, COMMON_LANGUAGE = 20_000, 1e-3, 1e-3
#: A word is taken to have at least this share in any language.
FLOOR = 1e-4
#: Punkt's thresholds: score of an abbreviation, log-likelihood ratio of a sentence starter and of a collocation.
ABBREVIATION, STARTER, COLLOCATION = 0.3, 30.0, 7.88
#: Types rarer than this share of a language's periods (starts) can't be learned: at most 1 / share of them are broadcast.
RARE = 1e-5
#: A starter follows an abbreviation inside a sentence with this chance.
NOISE = 0.05
_FLUSH = 200_000

_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+(?:[.'’\-][\p{L}\p{M}\p{N}]+)*")
_NUMBER = regex.compile(r"[\p{N}][\p{N}.,:\-]*")
_LATIN = regex.compile(r"\p{Latin}")
_BLANK_LINE = regex.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
_MARKER = regex.compile(r"(?:^|\n)[^\S\n`]*`*[^\S\n]*(?:[-*•‣]|\(?\d{1,3}\)|[a-z]\))[^\S\n]+")
_NUMBERED = regex.compile(r"(?:^|\n)[^\S\n`]*`*[^\S\n]*\d{1,3}\.[^\S\n]+")
_HEADING = regex.compile(r"[\s`]*\d{1,3}(?:\.\d{1,3})+\.?[^\S\n]+\p{Lu}[^\n.!?:;]{0,60}(?=\n)")
_EVENT = regex.compile(r"[\"“”„«»‹›「」『』（）()\[\]【】《》]|[.!?…。！？｡।॥؟۔．]+")
_OPEN = {"“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "【": "】", "《": "》"}
_OPENERS = {c: tuple(o for o, closing in _OPEN.items() if c in closing) for c in {c for closing in _OPEN.values() for c in closing}}
_CLOSERS = "\"“”»›」』)）]】》'’"
_OWN_STOPS = frozenset("。！？｡।॥؟۔．")
_TRIM = regex.compile(r"^[\s`]+|[\s`]+$")
_THAI_GAP = regex.compile(r"(?<=[\p{Thai}])(?<!\p{N})\s+(?!\s|\p{N})|(?<=[^\s\p{N}])\s+(?=[\p{Thai}])(?=[^\p{N}])")
_RUN_BACK = regex.compile(r"(?r)[\p{L}\p{M}\p{N}]+")
_JOINERS = frozenset(".'’-/")
_ONLY_CLOSERS = regex.compile("[ \u00a0\u202f'’" + regex.escape(_CLOSERS) + "]*")
_LEAD = " \t\r\n\f\v 　  \"“„«‹¿¡([（「『'‘—–-"


@dataclass(slots=True)
class Language:
    """What was learned of one language. abbreviations: type -> (ends sentences: True, False or None, sticks to numbers)."""

    abbreviations: dict[str, tuple[bool | None, bool]] = field(default_factory=dict)
    starters: frozenset[str] = frozenset()
    after_number: frozenset[str] = frozenset()


_SCRIPTS = tuple((name, regex.compile(pattern)) for name, pattern in SCRIPTS)


@dataclass(slots=True)
class Model:
    """What was learned of a corpus. words: word -> (language, weight) of the languages it speaks for; scripts: of each language; by_script: the most frequent language of each script."""

    languages: dict[str, Language] = field(default_factory=dict)
    words: dict[str, tuple[tuple[str, float], ...]] = field(default_factory=dict)
    scripts: dict[str, str] = field(default_factory=dict)
    by_script: dict[str, str] = field(default_factory=dict)
    _longest: int = -1

    def votes(self, text: str) -> dict[str, float]:
        """What the words of a text say for each language."""
        out: dict[str, float] = {}
        for w in _WORD.findall(text.lower()):
            for k, weight in self.words.get(w, ()):
                out[k] = out.get(k, 0.0) + weight
        return out

    def pick(self, votes: dict[str, float]) -> dict[str, str]:
        """By script, the language with the most votes; scripts without any are missing."""
        return {self.scripts[k]: k for k in sorted(votes, key=lambda k: (votes[k], k))}

    def local(self, parts: list[str]) -> list[dict[str, str]]:
        """The languages of each part of a text; what a part doesn't say, all parts together do."""
        votes = [self.votes(p) for p in parts]
        total: dict[str, float] = {}
        for v in votes:
            for k, weight in v.items():
                total[k] = total.get(k, 0.0) + weight
        whole = self.pick(total)
        return [whole | self.pick(v) for v in votes]

    def longest(self) -> int:
        """The length of the longest abbreviation that was learned."""
        if self._longest < 0:
            self._longest = max((len(w) for language in self.languages.values() for w in language.abbreviations), default=0)
        return self._longest

    def of_token(self, token: str, local: dict[str, str]) -> str:
        """The language that a token counts with, by its script; numbers count with the Latin one."""
        script = "latin" if token.isascii() else script_of(token)
        return local.get(script) or ("und" if script == "latin" else self.by_script.get(script, script))


def script_of(token: str) -> str:
    for name, pattern in _SCRIPTS:
        if pattern.search(token):
            return name
    return "latin"


def learn_words(texts: DataFrame, text: str, lang: str) -> Model:
    """A model that tells languages apart. A stated language is the first part of a tag such as en or en-GB, in any case."""
    label = F.regexp_extract(F.lower(F.coalesce(lang, F.lit(""))), r"^\s*([a-z]{2,3})(?![a-z])", 1)
    stated = texts.select(label.alias("label"), F.col(text).alias("text")).filter("label <> '' and text <> ''")
    share = F.lit(LABELLED) / F.greatest(stated.agg(F.count("*")).scalar(), F.lit(1))
    some = stated.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share * (1 << 20))
    counts = cut(some.select("label", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{M}]+"), F.lit(0))).alias("word")).groupBy("label", "word").agg(F.count("*").alias("n")))
    total = counts.groupBy("label").agg(F.sum("n").alias("total")).filter(F.col("total") >= counts.agg(F.sum("n")).scalar() * COMMON_LANGUAGE)
    frequent = counts.join(F.broadcast(total), "label").filter(F.col("n") >= F.col("total") * COMMON_WORD)  # at most 1 / COMMON_LANGUAGE languages
    found: dict[str, list[tuple[str, float]]] = {}
    letters: dict[str, Counter] = {}
    size: Counter[str] = Counter()
    for r in frequent.orderBy("label", "word").collect():
        found.setdefault(r["word"], []).append((r["label"], math.log1p(r["n"] / r["total"] / FLOOR)))
        letters.setdefault(r["label"], Counter())[script_of(r["word"])] += r["n"]
        size[r["label"]] = r["total"]
    scripts = {k: max(v, key=lambda x: (v[x], x)) for k, v in letters.items()}
    by_script = {script: max((k for k in scripts if scripts[k] == script), key=lambda k: (size[k], k)) for script in {*scripts.values()}}
    return Model({}, {w: tuple(v) for w, v in found.items()}, scripts, by_script)


def segments(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whole): parts of text that no sentence crosses; whole: the part is one sentence (heading, list item)."""
    start = 0
    for gap in [*((m.start(), m.end()) for m in _BLANK_LINE.finditer(text)), (len(text), len(text))]:
        if gap[0] > start:
            yield from _paragraph(text, start, gap[0])
        start = gap[1]


def _paragraph(text: str, start: int, end: int) -> Iterator[tuple[int, int, bool]]:
    part = text[start:end]
    marks = [m.span() for m in _MARKER.finditer(part)]
    if not marks and "\n" in part.strip() and all(_NUMBERED.match("\n" + line) for line in part.strip("\n").split("\n")):
        marks = [m.span() for m in _NUMBERED.finditer(part)]
    if not marks:
        heading = _HEADING.match(part)
        if heading:
            yield start, start + heading.end(), True
            start += heading.end()
        elif "\n" not in part.strip() and _HEADING.fullmatch(part.strip()[:200] + "\n", partial=True) and _HEADING.match(part.strip() + "\n"):
            yield start, end, True
            return
        yield start, end, False
        return
    if marks[0][0] > 0:
        yield start, start + marks[0][0], False
    for k, (_, after) in enumerate(marks):
        yield start + after, start + (marks[k + 1][0] if k + 1 < len(marks) else len(part)), True


def pairs(events: list[tuple[int, int, str]]) -> dict[int, int]:
    """Offsets of matching quotation marks and brackets: opening -> closing. A closing mark matches the nearest open one that it can close."""
    found, stack = {}, []
    places: dict[str, list[int]] = {}  # by opening mark, where it is on the stack
    for at, _, mark in events:
        openers = ('"',) if mark == '"' else _OPENERS.get(mark, ())
        k = max((places[o][-1] for o in openers if places.get(o)), default=-1)
        if k >= 0:
            found[stack[k][0]] = at
            while len(stack) > k:
                places[stack.pop()[1]].pop()
        elif mark == '"' or mark in _OPEN:
            places.setdefault(mark, []).append(len(stack))
            stack.append((at, mark))
    return found


def following(text: str, at: int, end: int, wanted: bool = True) -> tuple[str, str]:
    """(class, word) of what follows offset at: l lower case, u capital, n number, o letter without case, p punctuation, e nothing.

    The word is left empty where it isn't wanted, and of lower-case words.
    """
    while at < end and text[at] in _LEAD:
        at += 1
    if at >= end:
        return "e", ""
    c = text[at]
    if c.isnumeric():
        return "n", "##"
    if not c.isalpha():
        return ("p", c) if c in ",;:)]…/" else ("u", c)  # emoji and the like begin sentences as capitals do
    if c.islower():
        return "l", ""
    match = _WORD.match(text, at, end) if wanted else None
    word = match.group() if match else c if wanted else ""
    return ("u" if c.isupper() or c.istitle() else "o"), word


def token_start(text: str, at: int, low: int, before: tuple[int, int]) -> int:
    """Where the token that ends at offset at begins: words joined by single joiners. before: (at, start) of an earlier period, so that no part is read twice."""
    start = at
    while True:
        run = _RUN_BACK.match(text, low, start)
        if not run:
            return start + (start < at)
        start = run.start()
        if start == low or text[start - 1] not in _JOINERS:
            return start
        start -= 1
        if start == before[0]:
            return before[1] if before[1] < before[0] else start + 1


def period_type(text: str, start: int, at: int) -> str:
    """The type before the period at offset at, whose token begins at start: its lower-case form, ## for numbers, empty if there is none."""
    return "" if start == at else "##" if _NUMBER.fullmatch(text, start, at) else text[start:at].lower()


def count_text(text: str, counts: Counter, model: Model) -> None:
    """Adds the text's counts: (language, kind, type, following) with kind t type, p type with period, f followed by, s start."""
    parts = [text[start:end] for start, end, whole in segments(text) if not whole]
    for part, local in zip(parts, model.local(parts), strict=True):
        kind, word = following(part, 0, len(part))
        if kind in "uno":
            counts[model.of_token(word, local), "s", word, ""] += 1
        for m in _WORD.finditer(part):
            token = m.group()
            number = _NUMBER.fullmatch(token) is not None
            language = local.get("latin", "und") if number else model.of_token(token, local)
            counts[language, "t", "##" if number else token.lower(), ""] += 1
            if token[0].isupper() or number or not token[0].islower():
                counts[language, "c", "##" if number else token, ""] += 1
            at = m.end()
            if part[at : at + 1] == "." and part[at + 1 : at + 2] not in (".", "…"):
                name = "##" if number else token.lower()
                counts[language, "p", name, ""] += 1
                if at + 1 < len(part) and part[at + 1].isspace():
                    kind, word = following(part, at + 1, len(part))
                    if kind != "e":
                        counts[language, "f", name, word if kind in "uo" else "##" if kind == "n" else "-"] += 1
        for m in _EVENT.finditer(part):
            if m.group()[-1] in "!?。！？।؟" and part[m.end() : m.end() + 1].isspace() | (m.group()[-1] in _OWN_STOPS):
                kind, word = following(part, m.end(), len(part))
                if kind in "uno":
                    counts[model.of_token(word, local), "s", word, ""] += 1


_COUNT_FIELDS = (("language", pa.string()), ("kind", pa.string()), ("type", pa.string()), ("next", pa.string()), ("n", pa.int64()))


def _flush(counts: Counter) -> pa.RecordBatch:
    columns = [*zip(*counts.keys(), strict=True)] if counts else [[]] * 4
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns), pa.array(counts.values(), pa.int64())], names=[n for n, _ in _COUNT_FIELDS])


def _count(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                count_text(text, counts, model)
                if len(counts) > _FLUSH:
                    yield _flush(counts)
                    counts = Counter()
        yield _flush(counts)

    return run


def log_ratio(k: Column, n: Column, p: Column, q: Column) -> Column:
    """Log-likelihood ratio, times two, of k of n cases under chance q against chance p."""
    p, q = F.greatest(p, F.lit(1e-9)), F.greatest(q, F.lit(1e-9))
    return 2 * (k * F.log(q / p) + (n - k) * F.log(F.greatest(1 - q, F.lit(1e-9)) / F.greatest(1 - p, F.lit(1e-9))))


def learn(texts: DataFrame, text: str = "text", lang: str | None = None) -> Model:
    """The statistics of all texts, by language (by script where no text states its language). Null and empty texts add nothing."""
    model = learn_words(texts, text, lang) if lang else Model()
    counts = cut(
        texts.select(text).filter(F.col(text) != "")
        .mapInArrow(_count(model), "language string, kind string, type string, next string, n bigint")
        .groupBy("language", "kind", "type", "next").agg(F.sum("n").alias("n"))
    )
    total = counts.groupBy("language").agg(
        *(F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).cast("double").alias(v) for k, v in (("t", "tokens"), ("p", "periods"), ("s", "starts"), ("c", "capitals")))
    )  # one row for each language
    of = lambda kind, name: counts.filter(F.col("kind") == kind).select("language", F.col("type"), F.col("n").cast("double").alias(name))
    begun = (
        of("s", "at_start").join(of("c", "all"), ["language", "type"], "left").join(F.broadcast(total), "language")
        .withColumn("share", F.col("at_start") / F.col("starts"))
        .withColumn("elsewhere", F.greatest(F.coalesce("all", F.lit(0.0)) - F.col("at_start"), F.lit(0.0)) / F.greatest(F.col("capitals") - F.col("starts"), F.lit(1.0)))
    )
    starter = begun.filter(
        (F.col("share") > F.col("elsewhere")) & (F.col("share") >= RARE) & (F.col("at_start") >= 3)
        & (log_ratio(F.col("at_start"), F.col("starts"), F.col("elsewhere"), F.col("share")) > STARTER)
    )
    starter = cut(starter.select("language", F.col("type").alias("next"), "share"))
    rate = starter.groupBy("language").agg(F.least(F.sum("share"), F.lit(0.97)).alias("rate"))
    follow = counts.filter("kind = 'f'").select("language", "type", "next", F.col("n").cast("double").alias("n")).join(starter.select("language", "next", F.lit(1).alias("is_starter")), ["language", "next"], "left")
    number, lower = F.col("next") == "##", F.col("next") == "-"
    context = follow.groupBy("language", "type").agg(
        F.sum(F.when(number, F.col("n")).otherwise(0.0)).alias("numbers"), F.sum(F.when(lower, F.col("n")).otherwise(0.0)).alias("lowers"),
        F.sum(F.when(~number & ~lower, F.col("n")).otherwise(0.0)).alias("capitals_after"), F.sum(F.when(F.col("is_starter").isNotNull() & ~number & ~lower, F.col("n")).otherwise(0.0)).alias("starters_after"),
    )
    size = F.length(F.regexp_replace("type", r"\.", ""))
    inner = F.length("type") - size
    without = F.greatest(F.col("occurs") - F.col("with_period"), F.lit(0.0))
    ratio = log_ratio(F.col("with_period"), F.col("occurs"), F.col("periods") / F.col("tokens"), F.lit(0.99))
    score = F.when(F.col("type") == "##", F.lit(0.0)).otherwise(ratio * F.exp(-size) * (inner + 1) * F.pow(F.greatest(size, F.lit(1)).cast("double"), -without))
    ends = log_ratio(F.col("starters_after"), F.col("capitals_after"), F.lit(NOISE), F.coalesce("rate", F.lit(0.5)))
    types = (
        of("p", "with_period").join(of("t", "occurs"), ["language", "type"]).join(F.broadcast(total), "language").join(F.broadcast(rate), "language", "left")
        .join(context, ["language", "type"], "left").na.fill(0.0, ["numbers", "lowers", "capitals_after", "starters_after"])
        .withColumns({"score": score, "ends": ends, "followed": F.col("numbers") + F.col("lowers") + F.col("capitals_after")})
        .withColumn("numeric", (F.col("numbers") >= 2) & (F.col("numbers") > 0.5 * F.col("followed")))
        .filter((F.col("with_period") >= RARE * F.col("periods")) & (F.col("type") != "##"))
        .filter((F.col("score") >= ABBREVIATION) | F.col("numeric") | (size == 1) | (inner > 0) | (F.col("lowers") > 0.2 * F.col("with_period")))
    )
    numeric = follow.filter("type = '##' and next not in ('##', '-') and is_starter is null").select("language", "next", "n")
    sums = numeric.join(begun.select("language", F.col("type").alias("next"), F.col("share").alias("at")), ["language", "next"], "left").join(F.broadcast(total), "language")
    sticking = sums.filter((F.col("n") >= 3) & (F.col("n") >= RARE * F.col("periods")) & (F.col("n") / F.col("periods") > 3 * F.coalesce("at", F.lit(0.0))) & (log_ratio(F.col("n"), F.col("periods"), F.coalesce("at", F.lit(1e-6)), F.col("n") / F.col("periods")) > COLLOCATION))
    out = model.languages
    for r in types.select("language", "type", F.when(F.col("capitals_after") >= 1, F.col("ends") > 0).alias("ends"), "numeric").collect():
        out.setdefault(r[0], Language()).abbreviations[r[1]] = (r[2], r[3])
    for frame, name in ((starter, "starters"), (sticking, "after_number")):
        for r in frame.groupBy("language").agg(F.collect_set("next").alias("words")).collect():
            setattr(out.setdefault(r[0], Language()), name, frozenset(r[1]))
    return model


_NONE = Language()


def ends_here(text: str, start: int, at: int, after: int, end: int, local: dict[str, str], model: Model) -> bool:
    """Whether the single period at offset at ends a sentence; start: of the token before it; after: offset behind it and any closing marks."""
    spaced = after < end and text[after].isspace()
    kind, word = following(text, after, end, spaced)
    if kind == "e":
        return True
    if kind in "lp" or (kind == "n" and not spaced):
        return False
    if at - start > model.longest() and not _NUMBER.fullmatch(text, start, at):  # can't be learned; what matters is whether it holds a period
        return text.find(".", start, at) < 0 or spaced and word in model.languages.get(model.of_token(text[start : start + 1], local), _NONE).starters
    name = period_type(text, start, at)
    if not name:
        return spaced
    learned = model.languages.get(local.get("latin", "und") if name == "##" else model.of_token(name, local), _NONE)
    if name == "##":
        return spaced and word not in learned.after_number or not spaced and kind == "u"
    entry = learned.abbreviations.get(name)
    if entry is None and len(name) > 1 and "." not in name:
        return True
    closing, numeric = entry or (None, False)
    if kind == "n":
        return not numeric and closing is True
    return closing if closing is not None and (spaced or closing) else spaced and word in learned.starters


def spans(text: str, model: Model) -> list[tuple[int, int]]:
    """(start, end) of each sentence of text, in order."""
    out: list[tuple[int, int]] = []
    parts = [*segments(text)]
    languages = iter(model.local([text[start:end] for start, end, whole in parts if not whole]))
    for start, end, whole in parts:
        if whole:
            _add(text, start, end, out)
            continue
        cuts = []
        part, local = text[start:end], next(languages)
        events = [(m.start() + start, m.end() + start, m.group()) for m in _EVENT.finditer(part)]
        if events:
            cuts = _cuts(text, start, end, events, local, model)
        if _SCRIPTS[3][1].search(part):
            cuts = sorted({*cuts, *(m.start() + start for m in _THAI_GAP.finditer(part))})
        low = start
        for c in cuts:
            _add(text, low, c, out)
            low = c
        _add(text, low, end, out)
    return out


def _cuts(text: str, start: int, end: int, events: list[tuple[int, int, str]], local: dict[str, str], model: Model) -> list[int]:
    matched = pairs(events)
    closing = {c: o for o, c in matched.items()}
    cuts: list[int] = []
    low, inside_until, last_mark, before = start, -1, None, (-1, -1)
    for at, stop, mark in events:
        if at in matched:
            inside_until = max(inside_until, matched[at])
            continue
        quoted_from = None
        if at in closing:
            if at < inside_until or last_mark is None or not _ONLY_CLOSERS.fullmatch(text, last_mark[1], at):
                continue
            quoted_from, (m_at, m_stop, mark) = closing[at], last_mark
            after = stop
        elif mark[0] in ".!?…。！？｡।॥؟۔．":
            if at < inside_until:
                last_mark = (at, stop, mark)
                continue
            m_at, m_stop, after = at, stop, stop
        else:
            continue
        while after < end and text[after] in _CLOSERS and after not in matched:
            after += 1
        last_mark = (m_at, m_stop, mark)
        if mark == "." and m_at != before[0]:
            before = (m_at, token_start(text, m_at, start, before))
        if _final(text, m_at, m_stop, mark, after, low, end, local, model, quoted_from, before[1]):
            cuts.append(after)
            low = after
    return cuts


def _final(text: str, at: int, stop: int, mark: str, after: int, low: int, end: int, local: dict[str, str], model: Model, quoted_from: int | None, token: int) -> bool:
    own = mark[-1] in _OWN_STOPS
    if quoted_from is not None:
        kind, word = following(text, after, end)
        opens = text[low:quoted_from].strip(" \t\r\n 　`") == ""
        if kind in "lp" or text[after:end].lstrip()[:1] in ("—", "–", "-"):
            return False
        if kind in "eun":
            return kind != "n" or opens
        return opens
    if own:
        return True
    if mark == ".":
        return ends_here(text, max(token, low), at, after, end, local, model)
    kind, word = following(text, after, end)
    if "!" in mark or "?" in mark:
        return kind not in "lp"
    # dots that trail off
    return kind in "eu" or (kind == "n" and not text[at - 1 : at].isspace())


def _add(text: str, start: int, end: int, out: list[tuple[int, int]]) -> None:
    while start < end and (text[start].isspace() or text[start] == "`"):
        start += 1
    while end > start and (text[end - 1].isspace() or text[end - 1] == "`"):
        end -= 1
    if start < end and any(c.isalnum() for c in text[start:end]):
        out.append((start, end))


def _classify(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, first, last = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for a, b in spans(text, model):
                    keys.append(key), first.append(a), last.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64())], names=["id", "sent_start", "sent_end"])

    return run


def sentences(texts: DataFrame, unit: str = "id", text: str = "text", lang: str | None = None, model: Model | None = None) -> DataFrame:
    """(id, sent_start, sent_end) of each sentence; offsets in code points of the text as stored.

    Null and empty texts, and texts without a letter or digit, have no rows; equal rows count once. The model is
    learned from the same texts if none is given; lang names a column with the language that a text states, which may be
    null or wrong. Each text is one sentence at least, however long.
    """
    rows = texts.select(F.col(unit).cast("bigint").alias("id"), F.col(text).alias("text"), (F.col(lang) if lang else F.lit(None).cast("string")).alias("lang"))
    model = learn(rows, lang="lang" if lang else None) if model is None else model
    return rows.filter("text <> ''").select("id", "text").mapInArrow(_classify(model), "id bigint, sent_start bigint, sent_end bigint").distinct()


def found(spark: SparkSession, folder: str) -> DataFrame:
    """p2_found: the sentences of all in_plain_text.text."""
    return sentences(table(spark, folder, "in_plain_text"), lang="lang")
