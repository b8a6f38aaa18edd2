"""Evaluation texts leaking into training text (problem 7).

Method: q-gram lemma filter. Texts are reduced to lower-case letters and digits (words apart by one blank; for
languages written without blanks, nothing between characters). Character q-grams that a document shares with an item
are counted in overlapping bands of diagonals. A stretch of w characters that occurs with at most e edits shares at
least w - q + 1 - q * e of them within one band, so bands and then windows below that bound are dropped without loss.
Windows of an item that are left are aligned within their band, and those with more edits than allowed are rejected. Of
the documents that keep a window, the longest unaltered run is measured on each diagonal of the band.

The items are the query side. Their number of characters is counted first; a set beyond BLOCK_CHARS is divided by hash
into blocks of about that size, each collected, searched for in one pass over the corpus and written before the next, so
neither driver nor workers hold more than one block. Documents are never collected or cut.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from loomspar.runtime import cut, table

Q = {"words": 10, "chars": 5}
EDITS = 2
MIN_WORDS, MIN_CHARS = 10, 20
#: Characters of items whose index one pass over the corpus holds on the driver and in each worker (some 40 bytes for each).
BLOCK_CHARS = 2_000_000
#: Languages whose items are compared by characters, not words.
UNSPACED = ("zh", "ja")
_BATCH_CHARS = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)

RESULT = StructType(
    [
        StructField("item_id", LongType()), StructField("doc_id", LongType()), StructField("run_words", IntegerType()), StructField("run_chars", IntegerType()),
        StructField("aligned_chars", IntegerType()), StructField("edits", IntegerType()), StructField("item_chars", IntegerType()), StructField("complete", IntegerType()),
    ]
)


def kept_characters() -> np.ndarray:
    """For each code point, whether it is a letter or digit (marks that belong to letters count with them)."""
    return np.frombuffer(bytes(unicodedata.category(chr(c))[0] in "LN" for c in range(sys.maxunicode + 1)), dtype=np.bool_)


def fold(text: str) -> str:
    return unicodedata.normalize("NFC", text).lower()


def reduce_texts(texts: list[str], kept: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
    """(codes, starts): the texts one after another as code points, each followed by a 0; words apart by one blank if spaced."""
    joined = "\0".join(texts) + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    keep = kept[codes]
    ends = codes == 0
    if spaced:
        gap = ~keep & ~ends
        before = np.empty_like(keep)
        before[0], before[1:] = False, keep[:-1]
        out = np.where(gap, np.uint32(32), codes)[keep | ends | (gap & before)]
        # a blank before the end of a text goes as well
        trailing = (out[:-1] == 32) & (out[1:] == 0)
        out = out[np.append(~trailing, True)]
    else:
        out = codes[keep | ends]
    stops = np.flatnonzero(out == 0)
    return out, np.concatenate(([0], stops + 1))


def grams(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q code points from each position on."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    # hashes of 1, 2, 4, ... code points, put together by the binary digits of q
    part, size, out, covered = codes.astype(np.uint64) * _BASE, 1, None, 0
    while True:
        if q & size:
            out = part[:n].copy() if out is None else _mixed(out, part[covered : covered + n])
            covered += size
        size *= 2
        if size > q:
            return out
        part = _mixed(part[: len(part) - size // 2], part[size // 2 :])


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = (a ^ (b >> np.uint64(31))) * _BASE + b
    out ^= out >> np.uint64(29)
    return out


def words_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last offset of each word of one reduced text."""
    inside = np.concatenate(([False], codes != 32, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


class Index:
    """The q-grams of the items of one kind, and for each item the bound of the lemma."""

    def __init__(self, items: list[tuple[int, str]], spaced: bool, kept: np.ndarray):
        self.spaced, self.q = spaced, Q["words" if spaced else "chars"]
        self.ids = [i for i, _ in items]
        codes, starts = reduce_texts([fold(t) for _, t in items], kept, spaced)
        self.codes = [codes[a : b - 1] for a, b in zip(starts[:-1], starts[1:], strict=True)]
        self.words = [words_of(c) if spaced else (np.arange(len(c)), np.arange(1, len(c) + 1)) for c in self.codes]
        self.needed, self.windows, bounds, keys, where, whose = [], [], [], [], [], []
        for n, (c, (a, b)) in enumerate(zip(self.codes, self.words, strict=True)):
            need = min(MIN_WORDS if spaced else MIN_CHARS, len(a))
            begin, stop = (a[: len(a) - need + 1], b[need - 1 :]) if need else (a[:0], b[:0])
            widths = stop - begin
            width = int(widths.min()) if need else 0
            self.needed.append(need)
            edits = np.clip((widths - self.q) // (2 * self.q), 0, EDITS)  # at least half of the grams must stay
            bound = np.maximum(1, widths - self.q + 1 - self.q * edits)
            self.windows.append((begin, stop, edits, bound))
            bounds.append(int(bound.min()) if need else 1)
            g = grams(c, self.q) if width >= self.q else np.zeros(0, np.uint64)
            keys.append(g), where.append(np.arange(len(g))), whose.append(np.full(len(g), n))
        self.short = [n for n, (c, need) in enumerate(zip(self.codes, self.needed, strict=True)) if need and not len(keys[n])]
        self.bounds = np.array(bounds, np.int64)
        key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(key, kind="stable")
        self.key, self.where, self.whose = key[order], np.concatenate(where)[order] if keys else key, np.concatenate(whose)[order] if keys else key
        self.filter = np.zeros(1 << 22, np.bool_)
        self.filter[(self.key >> np.uint64(42)).astype(np.int64)] = True

    def candidates(self, codes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(document, item, lowest diagonal of the band, windows of the item that meet their bound in it)."""
        g = grams(codes, self.q)
        at = np.flatnonzero(self.filter[(g >> np.uint64(42)).astype(np.int64)])
        low, high = np.searchsorted(self.key, g[at], "left"), np.searchsorted(self.key, g[at], "right")
        count = high - low
        at, low, count = at[count > 0], low[count > 0], count[count > 0]
        if not len(at):
            return
        entry = np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        pos = np.repeat(at, count)
        doc = np.searchsorted(starts, pos, "right") - 1
        item, offset = self.whose[entry], self.where[entry]
        diagonal = pos - starts[doc] - offset
        half = EDITS + 1
        for shift in (0, half):  # bands of 2 * half diagonals that overlap by half: any EDITS + 1 neighbours lie in one
            band = (diagonal + shift) // (2 * half)
            order = np.lexsort((offset, band, item, doc))
            d, i, b, o = doc[order], item[order], band[order], offset[order]
            new = np.concatenate(([True], (d[1:] != d[:-1]) | (i[1:] != i[:-1]) | (b[1:] != b[:-1])))
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(d)))
            for k in np.flatnonzero(size >= self.bounds[i[first]]):
                n = int(i[first[k]])
                begin, stop, _, bound = self.windows[n]
                offsets = np.unique(o[first[k] : first[k] + size[k]])
                shared = np.searchsorted(offsets, stop - self.q, "right") - np.searchsorted(offsets, begin, "left")
                if len(w := np.flatnonzero(shared >= bound)):
                    yield int(d[first[k]]), n, int(b[first[k]]) * 2 * half - shift, w


def longest_run(item: np.ndarray, words: tuple[np.ndarray, np.ndarray], doc: np.ndarray, diagonal: int, spaced: bool) -> tuple[int, int]:
    """(units, characters) of the longest run of whole units of the item that stands unaltered on this diagonal of doc."""
    begin, end = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    if end <= begin:
        return 0, 0
    same = np.zeros(len(item) + 1, np.int64)
    same[begin:end] = item[begin:end] == doc[begin + diagonal : end + diagonal]
    total = np.concatenate(([0], np.cumsum(same)))
    a, b = words
    whole = total[b] - total[a] == b - a
    if spaced:
        left, right = a + diagonal - 1, b + diagonal
        whole &= (left < 0) | (doc[np.clip(left, 0, len(doc) - 1)] == 32)
        whole &= (right >= len(doc)) | (doc[np.clip(right, 0, len(doc) - 1)] == 32)
        linked = np.concatenate(([False], whole[1:] & whole[:-1] & (total[a[1:]] - total[b[:-1]] == a[1:] - b[:-1])))
    else:
        linked = np.concatenate(([False], whole[1:] & whole[:-1]))
    best, chars, run, first = 0, 0, 0, 0
    for k in np.flatnonzero(whole):
        run, first = (run + 1, first) if linked[k] and run else (1, k)
        if run > best:
            best, chars = run, int(b[k] - a[first])
    return best, chars


def banded_edits(item: np.ndarray, begin: np.ndarray, stop: np.ndarray, doc: np.ndarray, low: int, high: int) -> np.ndarray:
    """For each window begin..stop of the item, the edits of aligning it within the diagonals low..high of doc."""
    width, big = high - low + 1, 1 << 20
    offsets, longest = np.arange(width), int((stop - begin).max())
    used = begin[:, None] + low + offsets  # characters of doc before row 0
    now = np.where((used >= 0) & (used <= len(doc)), 0, big)
    out = np.full(len(begin), big)
    for i in range(1, longest + 1):
        j = used + i
        inside = (j >= 1) & (j <= len(doc))
        letter = item[np.minimum(begin + i - 1, len(item) - 1)]
        differs = doc[np.clip(j - 1, 0, len(doc) - 1)] != letter[:, None]
        skipped = np.concatenate((now[:, 1:], np.full((len(begin), 1), big)), 1) + 1
        now = np.minimum(np.where(inside, now + differs, big), skipped)
        now = np.where((j >= 0) & (j <= len(doc)), np.minimum.accumulate(now - offsets, 1) + offsets, big)
        over = begin + i == stop
        out[over] = now[over].min(1)
    return out


def _search(indexes: list[Index], packed: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.unpackbits(packed, count=sys.maxunicode + 1).astype(np.bool_)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            part_ids, part, size = [], [], 0
            rows: list[tuple] = []
            for n, text in zip(ids, texts, strict=True):
                part_ids.append(n), part.append(fold(text).replace("\0", " "))
                size += len(text)
                if size >= _BATCH_CHARS:
                    rows += _match(part_ids, part, indexes, kept)
                    part_ids, part, size = [], [], 0
            if part:
                rows += _match(part_ids, part, indexes, kept)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, [pa.int64()] * 2 + [pa.int32()] * 6, strict=True)], names=RESULT.names)

    return run


def _match(ids: list[int], texts: list[str], indexes: list[Index], kept: np.ndarray) -> list[tuple]:
    rows = []
    for index in indexes:
        codes, starts = reduce_texts(texts, kept, index.spaced)
        best: dict[tuple[int, int], tuple] = {}
        for d, n in _contained(codes, starts, index):
            best[d, n] = (index.needed[n], len(index.codes[n]), len(index.codes[n]), 0)
        for d, n, low, some in index.candidates(codes, starts):
            doc, item, high = codes[starts[d] : starts[d + 1] - 1], index.codes[n], low + 2 * EDITS + 1
            begin, stop, allowed, _ = index.windows[n]
            edits = banded_edits(item, begin[some], stop[some], doc, low, high)
            if not (edits <= allowed[some]).any():
                continue
            k = int(np.argmin(edits))
            units, chars = max(longest_run(item, index.words[n], doc, diagonal, index.spaced) for diagonal in range(low, high + 1))
            row = (units, chars, int(stop[some[k]] - begin[some[k]]), int(edits[k]))
            if row > best.get((d, n), ()):
                best[d, n] = row
        for (d, n), (units, chars, aligned, edits) in best.items():
            rows.append((index.ids[n], ids[d], units, chars, aligned, edits, len(index.codes[n]), int(units >= index.needed[n])))
    return rows


def _contained(codes: np.ndarray, starts: np.ndarray, index: Index) -> Iterator[tuple[int, int]]:
    """(document, item) of the items shorter than a q-gram, which the filter can't see: found as whole words."""
    if not index.short:
        return
    text = codes.tobytes().decode("utf-32-le", "surrogatepass")
    edge = " \0" if index.spaced else None
    for n in index.short:
        item = index.codes[n].tobytes().decode("utf-32-le", "surrogatepass")
        at, seen = text.find(item), -1
        while at >= 0:
            d = int(np.searchsorted(starts, at, "right")) - 1
            end = at + len(item)
            if d != seen and (edge is None or ((at == 0 or text[at - 1] in edge) and text[end : end + 1] in edge)):
                yield d, n
                seen = d
            at = text.find(item, at + 1)


def search(documents: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each (item, document) where a stretch of the item occurs, unaltered or with few edits.

    documents: doc_id, text; items: item_id, text, lang. Out: run_words (units of the longest unaltered run: words, or
    characters in unspaced languages), run_chars, aligned_chars and edits of the region that was aligned, item_chars,
    and complete: 1 if the run has MIN_WORDS words (MIN_CHARS characters), or the whole of a shorter item. Items without
    a letter or digit and null or empty texts match nothing; copies of a document each have their rows; equal rows
    of (doc_id, text) count once.
    """
    listed = items.filter("text is not null and item_id is not null").select("item_id", "text", F.lower(F.coalesce("lang", F.lit(""))).alias("lang")).distinct()
    total = listed.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = -(-total // BLOCK_CHARS)
    kept, out = kept_characters(), []
    packed = np.packbits(kept)
    texts = documents.filter("doc_id is not null and text <> ''").select(F.col("doc_id").cast("long"), F.col("text"))
    for n in range(blocks):
        block = listed.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == n).orderBy("item_id", "text").collect()  # about BLOCK_CHARS characters
        unspaced = [(r["item_id"], r["text"]) for r in block if r["lang"][:2] in UNSPACED]
        spaced = [(r["item_id"], r["text"]) for r in block if r["lang"][:2] not in UNSPACED]
        indexes = [Index(part, kind, kept) for part, kind in ((spaced, True), (unspaced, False)) if part]
        if indexes:
            found = texts.mapInArrow(_search(indexes, packed), RESULT)
            out.append(found if blocks == 1 else cut(found))
    if not out:
        return documents.sparkSession.createDataFrame([], RESULT)
    best = reduce(DataFrame.unionByName, out).groupBy("item_id", "doc_id").agg(F.max(F.struct(*RESULT.names[2:])).alias("best"))
    return best.select("item_id", "doc_id", "best.*")


def leaks(spark: SparkSession, folder: str) -> DataFrame:
    """p7_leaks: every item and document that share a window of words, unaltered or within the edits allowed, with the measures of the match."""
    return search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def found(spark: SparkSession, folder: str) -> DataFrame:
    """p7_found: the pairs with a complete unaltered run."""
    return leaks(spark, folder).filter("complete = 1").select("item_id", "doc_id")
