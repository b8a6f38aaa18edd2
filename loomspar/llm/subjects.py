"""Subject area of each document (problem 8).

Method: curated weighted subject terms are matched in every sentence with one multi-pattern automaton (longest match
first, so that a term inside a longer one doesn't count). A term weighs by its curated weight, by its rarity in the
corpus and by its reliability: how many of the hand-labelled documents that hold it have its subject among their labels.
A sentence is about a subject if the weights of its terms reach SENTENCE, so a term that is frequent and unreliable needs
company; a document's score is the share of such sentences, which normalises by length. Subjects whose score reaches a
third are assigned, at every size of the input: that share is part of the question.

Each document stays one row: its hits are written once, counted for the weights, and scored where they lie.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspar.llm import sentences
from loomspar.runtime import cut, table

#: The curated terms: subject, language, weight, terms (by |). Another file can be given as a parameter.
TERMS = Path(__file__).with_name("subject_terms.tsv")
#: Least weight of a sentence's terms, and the share of sentences that a document needs.
SENTENCE, SHARE = 0.1, 1.0 / 3.0
#: Least rarity, for corpora of which copies of one document fill much.
COMMON = 0.2
#: Labelled documents that the trust in a curated term counts as.
TRUST = 4
_UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]")
_ENDINGS = regex.compile(r"(?:s|es|n|en|e|ns|\p{Cyrillic}{1,2})?(?![\p{L}\p{N}])")
_PREFIX = frozenset("وفبلك")  # Arabic particles written together with the next word


def load_terms(path: str | Path = TERMS) -> list[tuple[str, str, float]]:
    """(term, subject, weight) of a file of terms."""
    out = []
    with open(path, encoding="utf-8") as lines:
        next(lines)
        for line in lines:
            subject, _, weight, terms = line.rstrip("\n").split("\t")
            out += [(fold(t), subject, float(weight)) for t in terms.split("|") if t]
    return out


def fold(text: str) -> str:
    return " ".join(text.replace("’", "'").lower().split())


def automaton(terms: list[str]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for k, term in enumerate(terms):
        found.add_word(term, (k, len(term)))
    found.make_automaton()
    return found


def matches(text: str, machine, unspaced: list[bool]) -> list[int]:
    """Numbers of the terms in a folded sentence: longest first, none inside another, whole words in spaced scripts."""
    hits = []
    for last, (k, size) in machine.iter(text):
        first = last - size + 1
        if not unspaced[k]:
            if first and text[first - 1].isalnum() and not (text[first - 1] in _PREFIX and (first < 2 or not text[first - 2].isalnum())):
                continue
            if not _ENDINGS.match(text, last + 1):
                continue
        hits.append((first, -size, k))
    out, at = [], -1
    for first, minus, k in sorted(hits):
        if first >= at:
            out.append(k)
            at = first - minus
    return out


_HITS = "doc_id bigint, sentences int, at array<int>, word array<int>"


def _hits(model: sentences.Model, words: list[str]):
    unspaced = [bool(_UNSPACED.search(t)) for t in words]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(words)
        for batch in batches:
            total, at, found = [], [], []
            for text in batch.column(1).to_pylist():
                parts = sentences.spans(text, model)
                pairs = [(n, k) for n, (a, b) in enumerate(parts) for k in sorted(set(matches(fold(text[a:b]), machine, unspaced)))]
                total.append(len(parts)), at.append([n for n, _ in pairs]), found.append([k for _, k in pairs])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(total, pa.int32()), pa.array(at, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "sentences", "at", "word"])

    return run


def _scores(weights: dict[int, list[tuple[str, float]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, subjects, shares = [], [], []
            for doc, total, at, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums: dict[tuple[int, str], float] = {}
                for n, k in zip(at, found, strict=True):
                    for subject, w in weights.get(k, ()):
                        sums[n, subject] = sums.get((n, subject), 0.0) + w
                about = Counter(subject for (_, subject), w in sums.items() if w >= SENTENCE)
                for subject, n in sorted(about.items()):
                    docs.append(doc), subjects.append(subject), shares.append(n / total)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(subjects, pa.string()), pa.array(shares, pa.float64())], names=["doc_id", "subject", "share"])

    return run


def term_weights(hits: DataFrame, terms: list[tuple[str, str, float]], numbers: dict[str, int], labels: DataFrame | None) -> dict[int, list[tuple[str, float]]]:
    """Weights by number of the word and subject. What is collected has a row for each term of the list."""
    total = hits.agg(F.coalesce(F.sum("sentences"), F.lit(0))).first()[0]
    df = {r["word"]: r["n"] for r in hits.select(F.explode("word").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    reliable: dict[tuple[int, str], tuple[int, int]] = {}
    if labels is not None:
        listed = hits.sparkSession.createDataFrame([(numbers[t], s) for t, s, _ in terms], "word int, listed string").distinct()
        known = labels.filter("doc_id is not null and trim(subject) <> ''").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.collect_set(F.lower(F.trim("subject"))).alias("labels"))
        held = hits.join(known, "doc_id").select("labels", F.explode(F.array_distinct("word")).alias("word")).join(F.broadcast(listed), "word")
        right = held.groupBy("word", "listed").agg(F.count("*").alias("n"), F.sum(F.array_contains("labels", F.col("listed")).cast("int")).alias("k"))
        reliable = {(r["word"], r["listed"]): (r["k"], r["n"]) for r in right.collect()}
    out: dict[int, list[tuple[str, float]]] = {}
    for term, subject, weight in sorted(set(terms)):
        word = numbers[term]
        rarity = max(COMMON, 1 - math.log1p(df.get(word, 0)) / math.log1p(max(total, 1)))
        k, n = reliable.get((word, subject), (0, 0))
        out.setdefault(word, []).append((subject, weight * rarity * (k + TRUST) / (n + TRUST)))
    return out


def subject_shares(documents: DataFrame, terms: list[tuple[str, str, float]], model: sentences.Model | None = None, labels: DataFrame | None = None) -> DataFrame:
    """(doc_id, subject, share): the share of a document's sentences that are about the subject, where above 0.

    documents: doc_id (unique), text, and lang where the model is to be learned; labels: doc_id, subject, which may be
    wrong, repeated or missing. Null and empty texts have no rows; equal rows count once.
    """
    rows = documents.filter("text <> '' and doc_id is not null").select(F.col("doc_id").cast("long"), "text", *(c for c in ("lang",) if c in documents.columns))
    model = sentences.learn(rows, lang="lang" if "lang" in rows.columns else None) if model is None else model
    numbers = {t: n for n, t in enumerate(sorted({t for t, _, _ in terms}))}
    hits = cut(rows.select("doc_id", "text").mapInArrow(_hits(model, [*numbers]), _HITS))
    return hits.mapInArrow(_scores(term_weights(hits, terms, numbers, labels)), "doc_id bigint, subject string, share double").distinct()


def assign(shares: DataFrame) -> DataFrame:
    return shares.filter(F.col("share") >= SHARE - 1e-9).select("doc_id", "subject")


def found(spark: SparkSession, folder: str) -> DataFrame:
    """p8_found: the subjects of all documents."""
    codes = {r["subject"] for r in table(spark, folder, "subjects").select("subject").distinct().collect()}  # the list of subjects, a fixed set
    terms = [t for t in load_terms() if t[1] in codes]
    return assign(subject_shares(table(spark, folder, "documents"), terms, labels=table(spark, folder, "subject_labels")))


def quality(spark: SparkSession, folder: str) -> DataFrame:
    """p8_quality: by subject, labels of the half of the labelled documents that the weights don't use, subjects found there, and both."""
    labels = table(spark, folder, "subject_labels").filter("doc_id is not null").withColumn("subject", F.lower(F.trim("subject")))
    half = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(2)) == 0
    codes = table(spark, folder, "subjects").select("subject").distinct()
    held = labels.filter(half).select(F.col("doc_id").cast("long").alias("doc_id"), "subject").distinct().join(F.broadcast(codes), "subject", "left_semi")
    got = assign(subject_shares(table(spark, folder, "documents"), load_terms(), labels=labels.filter(~half))).join(F.broadcast(codes), "subject", "left_semi").join(held.select("doc_id").distinct(), "doc_id", "left_semi")
    both = held.withColumn("labelled", F.lit(1)).join(got.withColumn("assigned", F.lit(1)), ["doc_id", "subject"], "full")
    return both.groupBy("subject").agg(F.count("labelled").alias("labels"), F.count("assigned").alias("found"), F.sum(F.when(F.col("labelled").isNotNull() & F.col("assigned").isNotNull(), 1).otherwise(0)).alias("right"))
