"""Variant spellings of names typed by people (problem 3).

Method: merge-and-rematch resolution. Equal records collapse to one profile. Profiles meet in blocks made of a whole name
up to a few letters (see ``name_keys``), are compared, and matching ones merge: the merged profile has the spellings,
initials and attributes of both, is in all blocks of its members and, by its united attributes, enters further ones, and
is compared again, until no further merge occurs. A profile only merges into one that has every kind of attribute it has
itself, so profiles that contradict each other can't be joined by a poorer one between them; what is left is merged
pairwise, best partners first.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspar.llm import canon
from loomspar.runtime import cut, spread_lookup, table

# Classes of the reference list that are persons or organisations.
PERSONS = ("Person", "Engineer", "Researcher", "Politician", "Athlete", "Musician")
ORGANISATIONS = ("Company", "University", "Public Agency", "Sports Club", "Hospital")
# Words beside a name, legal forms, and words that organisations' names abbreviate.
TITLES = frozenset("dr mr ms mrs miss prof ing sir herr frau mme mlle".split())
LEGAL = frozenset("ltd limited inc incorporated gmbh mbh sa llc corp ag plc".split())
FILLERS = frozenset("the of and de la le societe anonyme gesellschaft co".split())
ABBREVIATED = {
    "mfg": "manufacturing", "intl": "international", "ins": "insurance", "assoc": "association", "assn": "association", "univ": "university", "fc": "football club",
    "labs": "laboratories", "lab": "laboratories", "eng": "engineering", "engr": "engineering", "dept": "department", "inst": "institute", "hosp": "hospital", "turb": "turbine",
    "wks": "works", "publ": "publishing", "pub": "publishing", "gen": "general", "res": "research", "soft": "software", "mus": "music", "shpg": "shipping", "ship": "shipping",
}
# Short and foreign forms of given names.
NICKNAMES = {
    "alexander": "alex sandy alexandre sasha sascha xander aleksandr", "anthony": "tony antony anton", "antoinette": "toinette toni nettie", "benjamin": "ben benny", "charlotte": "charlie lottie lotte",
    "dmitry": "dima dmitri dmitrij mitya", "dolores": "lola loli", "ekaterina": "katya katja katia", "elizabeth": "liz lizzie beth betty eliza lisa elisabeth", "francisco": "paco pancho",
    "frederick": "fred freddy fritz frederic", "friederike": "rike fritzi", "gabriela": "gaby gabi", "giovanni": "gianni vanni", "guillermo": "memo guille", "harold": "harry hal",
    "isabella": "bella isa", "johannes": "hans hannes", "jonathan": "jon jonny johnny", "josephine": "josie jo", "katherine": "kate kathy katie kat catherine", "leonardo": "leo",
    "margaret": "maggie meg peggy", "michael": "mike mick michel", "nicholas": "nick nico nicolas", "oswald": "ozzie oz", "philippa": "pippa pip", "richard": "rick dick rich",
    "robert": "rob bob bobby", "sebastian": "seb bastian", "theodore": "ted teddy theo", "ursula": "uschi ulla", "valentina": "valya tina", "vladislav": "vlad slava", "william": "bill will billy liam",
    "zachary": "zack zach", "joseph": "joe", "thomas": "tom tommy", "james": "jim jimmy", "daniel": "dan danny", "samuel": "sam", "patricia": "pat patty", "susan": "sue", "edward": "ed eddie", "andrew": "andy drew",
}
_GIVEN = {short: full for full, shorts in NICKNAMES.items() for short in shorts.split()}

#: Merges of a round, of two numbers each, that are broadcast; more are joined by exchange.
BROADCAST_ROWS = 200_000
#: Words of a name or description that a type hint weighs as.
HINT = 2.0
#: Bits of a word's letters; a to z have one each.
LETTERS = 29
_WORDS = regex.compile(r"[\p{L}\p{N}]+")
_DOTTED = regex.compile(r"\b(?:\p{L}\.){2,}")
_YEAR = regex.compile(r"\b(1[5-9]\d\d|20\d\d)\b")
_PLACE = regex.compile(r"\b(?:in|at|from|of) (\p{Lu}[\p{L}\-]+)|(\p{Lu}[\p{L}\-]+)(?=-based)|^(\p{Lu}[\p{L}\-]+) body\b|\((\p{Lu}[\p{L}\-]+)\)")
_ALIAS = regex.compile(r"\bshort for ([^.;]+)")
_FORMULA = frozenset("a an in at from of born b worked as lives based mentioned the text person named passage organisation founded established seat body set up short for and chunk with".split())

def plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


def spelling(name: str, kind: str) -> str:
    """The name's words in order of the alphabet, then ``|`` and its initials; without titles, legal forms, accents and case."""
    text = _DOTTED.sub(lambda m: m.group().replace(".", "") if plain(m.group().replace(".", "")) in LEGAL else m.group(), plain(name))
    full, initials = [], []
    for w in _WORDS.findall(text):
        if kind == "person":
            if w in TITLES:
                continue
            (initials if len(w) == 1 else full).append(_GIVEN.get(w, w))
        elif w not in LEGAL and w not in FILLERS:
            for x in ABBREVIATED.get(w, w).split():
                (initials if len(x) == 1 else full).append(x)
    return " ".join(sorted(full)) + "|" + "".join(sorted(initials))


def attributes(description: str, kind: str) -> tuple[list[str], list[str], list[str], list[str]]:
    """(years, places, occupations, other names) that a description states."""
    alias = _ALIAS.findall(description)
    text = _ALIAS.sub("", description)
    years = _YEAR.findall(text)
    places = [plain(next(filter(None, m))) for m in _PLACE.findall(text)]
    rest = [w for w in _WORDS.findall(plain(text)) if w not in _FORMULA and w not in places and not w.isnumeric()]
    jobs = [" ".join(rest)] if rest and kind == "person" else []
    return sorted(set(years)), sorted(set(places)), jobs, alias


def _profiles(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for entity, name, description, kind in zip(frame["entity_id"], frame["name"], frame["description"], frame["kind"], strict=True):
            years, places, jobs, alias = attributes(description or "", kind)
            names = sorted({spelling(n, kind) for n in (alias or [name])} - {"|"})
            if names:
                rows.append((entity, kind, names, years, places, jobs))
        yield pd.DataFrame(rows, columns=["entity_id", "kind", "names", "years", "places", "jobs"])


@lru_cache(1 << 16)
def letters_of(word: str) -> int:
    """Bits of the letters that occur in a word; an edit changes two of them at most."""
    out = 0
    for c in word:
        out |= 1 << ord(c) % LETTERS
    return out


@lru_cache(1 << 16)
def word_distance(a: str, b: str) -> int:
    """Edits from a to b; 3 if there are more than two."""
    return 3 if (letters_of(a) ^ letters_of(b)).bit_count() > 4 else canon.edit_distance(a, b, 2)


def names_agree(a: str, b: str, loose: bool = False) -> int | None:
    """Cost of taking two spellings for the same name (edits and initials), None if they aren't.

    loose: one word of each may differ altogether, as an unlisted nickname does.
    """
    (fa, ia), (fb, ib) = ((s.partition("|")[0].split(), list(s.partition("|")[2])) for s in (a, b))
    if not fa and not fb:  # nothing but initials
        return 2 if ia == ib and len(ia) > 1 else None
    matched, cost = 0, 0
    for w in [*fa]:
        if w in fb:
            fa.remove(w), fb.remove(w)
            matched += 1
    for w in [*fa]:
        best = min(((word_distance(w, v), v) for v in fb), default=(9, ""))
        if best[0] <= (2 if min(len(w), len(best[1])) >= 6 else 1):
            fa.remove(w), fb.remove(best[1])
            matched, cost = matched + 1, cost + best[0]
    if not matched or cost > 4:
        return None
    for full, initials in ((fa, ib), (fb, ia)):
        for w in [*full]:
            if w[0] in initials:
                initials.remove(w[0]), full.remove(w)
                matched, cost = matched + 1, cost + 1
    if loose and len(fa) == len(fb) == 1:
        fa, fb, matched, cost = [], [], matched + 1, cost + 3
    if fa or fb:
        return None
    for c in [*ia]:
        if c in ib:
            ia.remove(c), ib.remove(c)
            matched += 1
    if (ia and ib) or matched < 2:
        return None
    return cost


def near(a: list[str], b: list[str]) -> bool:
    return bool(set(a) & set(b)) or any(canon.edit_distance(x, y, 1) <= 1 for x, y in product(a, b) if len(x) > 4)


def _mask(years: list[str], places: list[str], jobs: list[str]) -> int:
    return (len(years) > 0) + 2 * (len(places) > 0) + 4 * (len(jobs) > 0)


def _verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for a, b, kind, na, nb, ya, yb, pa, pb, ja, jb in frame.itertuples(index=False):
            agree, cost = 0, None
            for x, y, same in ((ya, yb, lambda x, y: bool(set(x) & set(y))), (pa, pb, near), (ja, jb, near)):
                if len(x) and len(y):
                    if not same([*x], [*y]):
                        break
                    agree += 1
            else:
                cost = min((c for x, y in product(na, nb) if (c := names_agree(x, y)) is not None), default=None)
                if cost is None and agree == 3 and kind == "person":  # year, place and occupation are the same
                    cost = min((c for x, y in product(na, nb) if (c := names_agree(x, y, True)) is not None), default=None)
            rows.append((a, b, -1 if cost is None else agree, cost or 0, _mask(ya, pa, ja), _mask(yb, pb, jb)))
        yield pd.DataFrame(rows, columns=["a", "b", "agree", "cost", "ma", "mb"])


@lru_cache(1 << 16)
def word_keys(word: str) -> list[str]:
    """The word with up to one letter left out; of a very long word, thirds: one of them is the same after two edits."""
    return sorted(canon.variants(word, 1)) if len(word) <= 64 else [word[:20], word[len(word) // 2 - 10 : len(word) // 2 + 10], word[-20:]]


#: A block key is made for one side of an abbreviation only (bits): the word written out, or its initial. Two profiles meet
#: if they have no bit in common, as do profiles with different years.
WRITTEN, INITIAL, DATED = 1, 2, 4
#: Names of more full words meet by exact words: an agreement costs four edits or initials at most, so of the words in order
#: of their hashes two of the first six, or one of the first five, are the same on both sides.
MANY = 4


#: A signature holds the letters of up to two words beside those of a key, a word from each of these bits on. Then the bit of
#: names with initials, that of keys whose other words aren't told (none, or more than two), and that of profiles that state all,
#: of which two may agree although a word differs altogether.
SECOND, INITIALS, UNTOLD, STATED = 30, 1 << 60, 1 << 61, 1 << 62


def signature(others: list[str], letters: list[str]) -> int:
    if len(others) > 2:
        return UNTOLD
    return sum(letters_of(w) << SECOND * n for n, w in enumerate(others)) | (INITIALS if letters else 0)


def name_keys(name: str) -> set[tuple[str, int]]:
    """Block keys of a spelling, each with the bits of its side."""
    return {(key, side) for key, side, _ in signed_keys(name)}


def signed_keys(name: str) -> frozenset[tuple[str, int, int]]:
    """Block keys of a spelling, each with the bits of its side and the signature of the words that aren't in it whole (see ``_meet``).

    Any agreement of two names covers all their full words, so a key holds all of them: one as its deletion variants, of
    the others their first letters, or in names of two words also their last ones. Two spellings share a key unless
    edits hit the beginnings of two different words. Words that an initial of the other name stands for are left out.
    """
    left, _, letters = name.partition("|")
    full, letters = left.split(), sorted(set(letters))
    out: set[tuple[str, int, int]] = set()
    if len(full) > MANY:
        by_hash = sorted(set(full), key=xxhash.xxh64_intdigest)
        out |= {(f"w {w}", 0, UNTOLD) for w in by_hash[:5]} | {(f"ww {v} {w}", 0, UNTOLD) for v, w in combinations(by_hash[:6], 2)}
        if len(full) > 2 * MANY:
            out = {k for k in out if k[0].startswith("ww")}
    if 2 <= len(full) <= 2 * MANY:
        for n, w in enumerate(full):
            others = full[:n] + full[n + 1 :]
            sign = signature(others, letters)
            rest = [" ".join(sorted(x[:3] for x in others)), *(["$" + others[0][-3:]] if len(others) == 1 else [])]
            out |= {(f"{len(full)} {v} {r}", 0, sign) for v in word_keys(w) for r in rest}
            if len(others) > 1:
                out.add((f"{len(full)} {w} " + "".join(sorted(x[0] for x in others)), 0, sign))
    if not full:
        out.add((f"o {''.join(letters)}", 0, UNTOLD))
    if len(full) <= MANY:
        for size in range(1, len(full) + 1):
            for kept in combinations(range(len(full)), size):
                words = [full[k] for k in kept]
                others = [full[k] for k in range(len(full)) if k not in kept]
                first, sign = min((w[0] for w in others), default=None), signature(others, letters)
                bases = word_keys(words[0]) if size == 1 else [" ".join(words)]
                for base in bases:
                    if first:
                        out.add((f"i{size} {base} {first}", WRITTEN, sign))
                    out |= {(f"i{size} {base} {c}", INITIAL, sign) for c in letters}
                    if len(full) == 1:
                        out |= {(f"ii {base} {c}", 0, UNTOLD) for c in letters}
    return frozenset(out)


def attribute_keys(kind: str, names: list[str], years: list[str], places: list[str], jobs: list[str]) -> set[tuple[str, int]]:
    """Block keys of a word of the name with the year and the place or occupation, where all kinds of attributes are known."""
    if not len(years) or not len(places) or (kind == "person" and not len(jobs)):
        return set()
    words = {v for name in names for w in name.partition("|")[0].split() for v in word_keys(w)}
    return {(f"a {y} {x} {w}", 0) for y in years for x in (*places, *jobs) for w in words}


def _mixed(keys: np.ndarray, year: str) -> np.ndarray:
    """Keys of the year from keys without one."""
    mixed = (keys ^ np.uint64(xxhash.xxh64_intdigest(year))) * np.uint64(0x9E3779B97F4A7C15)
    return mixed ^ (mixed >> np.uint64(29))


@lru_cache(1 << 12)
def _hashed(kind: str, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found = signed_keys(name)
    keys, sides, signs = zip(*found, strict=True) if found else ((), (), ())
    prefix = kind[0] + " "
    return np.array([xxhash.xxh64_intdigest(prefix + k) for k in keys], np.uint64), np.array(sides, np.int8), np.array(signs, np.int64)


def _keys(attributes_only: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            parts: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
            for pid, kind, names, years, places, jobs in frame.itertuples(index=False):
                stated = len(years) > 0 and len(places) > 0 and len(jobs) > 0
                if found := [xxhash.xxh64_intdigest(f"{kind[0]} {k}") for k, _ in attribute_keys(kind, names, years, places, jobs)]:
                    parts.append((pid, np.array(found, np.uint64), np.zeros(len(found), np.int8), np.full(len(found), UNTOLD, np.int64)))
                for name in () if attributes_only else names:
                    # dated profiles meet those of the same year, and undated ones
                    keys, sides, signs = _hashed(kind, name)
                    signs = signs | np.int64(STATED if stated else 0)
                    parts += [(pid, _mixed(keys, y), sides, signs) for y in years]
                    parts.append((pid, _mixed(keys, "?"), sides | np.int8(DATED if len(years) else 0), signs))
            if parts:
                pids = np.repeat(np.array([p[0] for p in parts], np.int64), [len(p[1]) for p in parts])
                keys, sides, signs = (np.concatenate([p[n] for p in parts]) for n in (1, 2, 3))
                yield pd.DataFrame({"key": keys.view(np.int64), "pid": pids, "side": sides, "sign": signs})

    return run


FIELDS = ("names", "years", "places", "jobs")
_KEYED = "key bigint, pid bigint, side tinyint, sign bigint"
_PAIRS = "a bigint, b bigint, agree int, cost int, ma int, mb int"


def settled(df: DataFrame) -> DataFrame:
    """``cut`` without the estimate of df's size, which a checkpoint keeps.

    An estimate of a join is the product of its inputs', so over rounds of joins its digits grow without bound, and with
    them the driver's memory and time.
    """
    done = cut(df)
    java = df.sparkSession._jsparkSession.internalCreateDataFrame(done._jdf.queryExecution().toRdd(), done._jdf.schema(), False)
    return DataFrame(java, df.sparkSession)


def _spread(df: DataFrame) -> DataFrame:
    """df in as many parts as there are shuffle partitions: a few MB keep Python busy for long."""
    spark = df.sparkSession
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def _verified(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Pairs (a < b) with what they agree in (-1: they don't match), the cost, and the kinds of attributes either has."""
    side = lambda s: profiles.select(F.col("pid").alias(s), F.col("kind").alias(f"k{s}"), *(F.col(f).alias(f"{f}_{s}") for f in FIELDS))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ka", *(f"{f}_{s}" for f in FIELDS for s in "ab"))
    return both.mapInPandas(_verify, _PAIRS)


def _fits(of: str, into: str) -> str:
    """SQL: each word whose letters a signature tells may be a word of the other, within two edits."""
    word = lambda s, n: f"(shiftright({s}.sign, {n * SECOND}) & {(1 << SECOND) - 1})"
    near_one = lambda n: " or ".join(f"bit_count({word(of, n)} ^ {word(into, m)}) <= 4" for m in (0, 1))
    return " and ".join(f"({word(of, n)} = 0 or {near_one(n)})" for n in (0, 1))


def _meet(left: DataFrame, right: DataFrame | None = None) -> DataFrame:
    """Pairs of profiles (of left, or one of left and one of right) that have a key in common and whose words beside it can agree.

    A word that isn't one of the other name's, up to two edits, is only right if the other name has its initial. Beside a key of
    an abbreviation it is that of the written side's initials that counts; beside other keys, where both names have as many
    words, either name then has a word that isn't the other's, so both have initials.
    """
    told = f"(l.sign | r.sign) & {UNTOLD} = 0 and l.sign & r.sign & {STATED} = 0"
    initials = lambda s: f"{s}.sign & {INITIALS} <> 0"
    possible = f"case when l.side & {WRITTEN} <> 0 then {initials('l')} or {_fits('r', 'l')} when r.side & {WRITTEN} <> 0 then {initials('r')} or {_fits('l', 'r')} else {initials('l')} and {initials('r')} or {_fits('l', 'r')} end"
    order, right = ("<", left) if right is None else ("<>", right)
    met = left.alias("l").join(right.alias("r"), F.expr(f"l.key = r.key and l.pid {order} r.pid and l.side & r.side = 0 and (not ({told}) or {possible})"))
    return met.select(F.least("l.pid", "r.pid").alias("a"), F.greatest("l.pid", "r.pid").alias("b")).distinct()


def _merges(pairs: DataFrame) -> tuple[DataFrame, int]:
    """(pid, into): profiles that merge in this round, and their number. No profile is on both sides."""
    edges = pairs.filter("agree >= 0")
    turned = edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "agree", "cost", F.col("mb").alias("ma"), F.col("ma").alias("mb"))
    wider = (F.col("ma").bitwiseAND(F.bitwise_not("mb")) == 0) & ((F.col("ma") != F.col("mb")) | (F.col("b") < F.col("a")))
    pair = F.xxhash64(F.least("a", "b"), F.greatest("a", "b"))
    parent = F.min(F.when(wider, F.struct((-F.col("agree")).alias("x"), (-F.bit_count("mb")).alias("y"), "cost", "b")))
    best = F.min(F.struct((-F.col("agree")).alias("x"), "cost", pair.alias("h"), "b"))
    chosen = edges.unionByName(turned).groupBy("a").agg(parent.alias("p"), best.alias("q")).select("a", F.col("p.b").alias("parent"), F.col("q.b").alias("best"))
    stars = chosen.alias("l").join(chosen.alias("r"), F.expr("l.parent = r.a and r.parent is null")).select(F.col("l.a").alias("pid"), F.col("l.parent").alias("into"), F.lit(True).alias("star"))
    mutual = chosen.alias("l").join(chosen.alias("r"), F.expr("l.best = r.a and r.best = l.a and l.a > r.a")).select(F.col("l.a").alias("pid"), F.col("l.best").alias("into"), F.lit(False).alias("star"))
    either = settled(stars.unionByName(mutual))
    n = {r["star"]: r["count"] for r in either.groupBy("star").count().collect()}
    star = True in n  # pairwise only where none has a wider one
    return either.filter(F.col("star") == star).select("pid", "into"), n.get(star, 0)


def followed(rounds: list[DataFrame]) -> DataFrame:
    """(pid, into) with the end of each profile's moves, which are given by round; a profile moves in one round only. One join a round."""
    roots = rounds[0]
    for later in rounds[1:]:
        roots = roots.join(later.select(F.col("pid").alias("into"), F.col("into").alias("further")), "into", "left").select("pid", F.coalesce("further", "into").alias("into")).unionByName(later)
    return roots


def resolve(profiles: DataFrame) -> DataFrame:
    """(pid, into) of the profiles that merged, by rounds of matching and merging until nothing merges.

    Each round writes three small tables; a candidate pair is kept with its verdict and compared again only when one of
    its profiles has merged.
    """
    current = profiles
    keys = current.mapInPandas(_keys(False), _KEYED)
    pairs = settled(_verified(_meet(keys), current))
    rounds = []
    while True:
        merges, n = _merges(pairs)
        if not n:
            break
        rounds.append(merges)
        moves = merges.unionByName(merges.select(F.col("into").alias("pid"), "into").distinct())
        moves = F.broadcast(moves) if n <= BROADCAST_ROWS else moves  # twice as many rows at most
        moved = current.join(moves, "pid", "left")
        union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
        merged = moved.filter("into is not null").groupBy(F.col("into").alias("pid"), "kind").agg(*(union(c) for c in FIELDS)).withColumn("fresh", F.lit(True))
        current = settled(moved.filter("into is null").select("pid", "kind", *FIELDS, F.lit(False).alias("fresh")).unionByName(merged))
        stale = pairs.join(moves.select(F.col("pid").alias("a"), F.col("into").alias("a_into")), "a", "left").join(moves.select(F.col("pid").alias("b"), F.col("into").alias("b_into")), "b", "left")
        again = stale.filter("a_into is not null or b_into is not null").select(F.coalesce("a_into", "a").alias("a"), F.coalesce("b_into", "b").alias("b")).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        content = current.select("pid", "kind", *FIELDS)
        stated = current.filter("size(years) > 0 and size(places) > 0 and (kind <> 'person' or size(jobs) > 0)")  # others have no such keys
        richer = stated.filter("fresh").select("pid", "kind", *FIELDS).mapInPandas(_keys(True), _KEYED)
        further = _meet(richer, stated.select("pid", "kind", *FIELDS).mapInPandas(_keys(True), _KEYED))
        pairs = settled(stale.filter("a_into is null and b_into is null").select("a", "b", "agree", "cost", "ma", "mb").unionByName(_verified(again.unionByName(further).distinct(), content)))
        current = content
    if not rounds:
        return profiles.select("pid", F.col("pid").alias("into")).limit(0)
    return followed(rounds)


def _plain_label(c: str) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def kinds(nodes: DataFrame, entries: DataFrame, labels: DataFrame) -> DataFrame:
    """(entity_id, name, description, kind) of all nodes: person, organisation, or null for other things.

    A class that is a label of the reference list, but for case and punctuation, decides. Where it isn't, the words of
    name and description and the three-letter parts of the type hint do (which differ little between its spellings),
    weighed by how often they stand with each kind among all rows whose class is known. The parts of a hint, of which
    there are many for one word, together weigh as HINT words. Rows without an id are kept.
    """
    group = F.when(F.col("label").isin(*PERSONS), "person").when(F.col("label").isin(*ORGANISATIONS), "organisation").otherwise("other")
    forms = entries.join(labels, "ref_id").select(_plain_label("name").alias("form"), group.alias("known")).groupBy("form").agg(F.min("known").alias("known"))
    nodes = nodes.select("entity_id", "entity_name", "entity_description", "entity_type_hint", "class_label").distinct()
    hint = F.regexp_replace(F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce("entity_type_hint", F.lit(""))), r"[^\p{L}]+", " "), F.lit(" ")), " +", " ")
    texts = F.array(
        F.concat(F.lit("n "), F.lower(F.coalesce("entity_name", F.lit("")))),
        F.concat(F.lit("d "), F.regexp_replace(F.coalesce("entity_description", F.lit("")), r"\b\p{Lu}[\p{L}]{4,}", "X")),
        F.concat(F.lit("h "), F.col("hint")),
    )
    rows = nodes.withColumn("hint", hint).withColumn("form", _plain_label("class_label"))
    rows = cut(rows.join(F.broadcast(forms), "form", "left").select("entity_id", "entity_name", "entity_description", "known", texts.alias("texts"), F.xxhash64("entity_id", "entity_name", "entity_description", "hint").alias("row")))  # the list is a fixed set of some hundred forms
    names = ("person", "organisation", "other")
    each = [F.sum(F.when(F.col("known") == k, 1).otherwise(0)).alias(k) for k in names]
    # texts recur: each is taken apart once, and counts as often as it stands
    text = F.substring("text", 3, 1 << 30)
    found = lambda c, pattern: F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    prefixed = lambda c, prefix: F.transform(c, lambda w: F.concat(F.lit(prefix), w))
    terms = (
        F.when(F.startswith("text", F.lit("n ")), prefixed(found(text, r"[\p{L}]{2,}|\p{N}"), "n "))
        .when(F.startswith("text", F.lit("d ")), prefixed(F.transform(found(text, r"[\p{L}]+|[*(]"), F.lower), "d "))
        .when(F.length("text") > 4, F.transform(F.sequence(F.lit(3), F.length("text") - 2), lambda i: F.concat(F.lit("h "), F.substring(F.col("text"), i, F.lit(3)))))
    )
    taken = rows.select("known", F.explode("texts").alias("text")).groupBy("text").agg(*each, F.sum(F.when(F.col("known").isNull(), 1).otherwise(0)).alias("unknown"))
    taken = cut(taken.select("text", *names, "unknown", F.array_distinct(terms).alias("terms")))
    counts = cut(taken.select(*names, F.when(F.col("unknown") > 0, 1).otherwise(0).alias("n"), F.explode("terms").alias("term")).groupBy("term").agg(*(F.sum(k).alias(k) for k in (*names, "n"))).filter("person + organisation + other >= 3 and n > 0"))
    size = rows.agg(*each).first() or dict.fromkeys(names, 0)
    evidence = taken.filter("unknown > 0").select("text", "unknown", F.explode("terms").alias("term"))
    weight = F.when(F.startswith("term", F.lit("h ")), HINT / (F.length("text") - 4)).otherwise(1.0)
    # the weighed sum of log((count + 1/2) / (size + 1)) over the terms of a text, then over the texts of a row
    score = [F.sum(weight * F.log((F.col(k) + 0.5) / F.lit((size[k] or 0) + 1.0))).alias(k) for k in names]
    scores = cut(spread_lookup(evidence, counts, "term", "n", "text").groupBy("text").agg(*score, F.first("unknown").alias("unknown")))
    guessed = spread_lookup(rows.filter("known is null").select("row", F.explode("texts").alias("text")), scores, "text", "unknown", "row").groupBy("row").agg(*(F.sum(k).alias(k) for k in names))
    guess = F.when((F.col("person") > F.col("other")) & (F.col("person") >= F.col("organisation")), "person").when(F.col("organisation") > F.col("other"), "organisation")
    decided = rows.join(guessed, "row", "left").select("entity_id", F.col("entity_name").alias("name"), F.col("entity_description").alias("description"), F.when(F.col("known").isNull(), guess).when(F.col("known") != "other", F.col("known")).alias("kind"))
    return decided


def link(entities: DataFrame) -> DataFrame:
    """(entity_id, root) of persons and organisations: ids with the same root mean the same one.

    entities: entity_id, name, description, kind (person, organisation; others are left out). Rows without an id, or
    whose name has no letter or digit (and whose description names no other form), have no root.
    """
    rows = entities.filter("kind is not null and entity_id is not null and (name is not null or description is not null)").select("entity_id", F.coalesce("name", F.lit("")).alias("name"), "description", "kind").distinct()
    parsed = rows.mapInPandas(_profiles, "entity_id string, kind string, names array<string>, years array<string>, places array<string>, jobs array<string>")
    parsed = cut(parsed.withColumn("pid", F.xxhash64("kind", *FIELDS)))
    profiles = cut(parsed.groupBy("pid").agg(*(F.first(c).alias(c) for c in ("kind", *FIELDS)), F.count("*").alias("n")).transform(_spread))  # equal within a pid
    roots = resolve(profiles.select("pid", "kind", *FIELDS))
    known = cut(profiles.select("pid", "n").join(roots, "pid", "left").select("pid", "n", F.coalesce("into", "pid").alias("root")))
    return spread_lookup(parsed.select("entity_id", "pid"), known, "pid", "n", "entity_id").select("entity_id", "root").distinct()


def linked(spark: SparkSession, folder: str) -> DataFrame:
    """p3_links: every person's and organisation's entity_id with the id of its group."""
    nodes = table(spark, folder, "kg_nodes").select("entity_id", "entity_name", "entity_description", "entity_type_hint", "class_label").distinct()
    entries = canon.entries_of(spark, folder).filter("kind = 'concept'")
    labels = table(spark, folder, "ref_concepts").select(F.col("qid").alias("ref_id"), "label")
    return link(kinds(nodes, entries, labels))


def pairs_of(links: DataFrame) -> DataFrame:
    """All pairs of ids within a group, from (entity_id, root), distinct rows.

    Two ids of which one has one group have one pair; only others are made distinct, so most pairs aren't exchanged.
    """
    ids = links.groupBy("entity_id").agg(F.collect_set("root").alias("roots"))
    ids = cut(ids.select("entity_id", F.explode("roots").alias("root"), (F.size("roots") > 1).alias("several")))
    pairs = lambda rows, which: rows.alias("l").join(rows.alias("r"), F.expr(f"l.root = r.root and l.entity_id < r.entity_id and {which}")).select(F.col("l.entity_id").alias("entity_id_a"), F.col("r.entity_id").alias("entity_id_b"))
    return pairs(ids, "not (l.several and r.several)").unionByName(pairs(ids.filter("several"), "true").distinct())


def found(spark: SparkSession, folder: str) -> DataFrame:
    """p3_found: all pairs of ids within a group."""
    return pairs_of(linked(spark, folder))
