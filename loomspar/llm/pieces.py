"""Splitting oversized items at natural boundaries (problem 4).

Method: processing by ranges. A value (or file) is taken apart into ranges with halos once, and the ranges are spread over
tasks. Each range is searched on its own for the boundaries it holds (paragraph, sentence, word), of which it keeps those
that a piece could end at. The running sum of the ranges' lengths turns the boundary tables of one value into one table,
which is walked range by range, by offsets alone: each piece ends at the last boundary of the best kind in its whole
span, which reaches from the cut before it to its limit, and at the limit only where the span has no boundary. Pieces are
then cut from the range they begin in. Nobody holds a whole value after it has been taken apart; of files, workers read
no more than a range and its halo.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspar.runtime import table

#: Characters (in files: bytes) of a range, and of its halo on either side. A longer run of blanks counts as a word boundary.
RANGE, HALO = 1 << 16, 1 << 12
#: White space as str.strip() knows it.
BLANKS = "".join(map(chr, (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)))
FENCE = "```"
KINDS = ("paragraph", "sentence", "word")
_PATTERNS = (
    regex.compile(r"\n[^\S\n]*\n\s*"),
    regex.compile(r"(?:[.?!…]+[\"'”’»)\]]*\s+(?=[^\p{Ll}\s])|[。！？।؟]+[\"'”’»」』）)]*\s*|\n\s*)"),
    regex.compile(r"\s+"),
)
_RANGES = "key string, ids string, range_no bigint, n_chars bigint, last boolean, halo int, chunk string, core_start bigint, max_size int, overlap int"
_TABLES = "key string, ids string, range_no bigint, n_chars bigint, last boolean, at array<bigint>, core_start bigint, max_size int, overlap int"
_CUTS = "key string, ids string, piece_no int, range_no bigint, in_range int, piece_start bigint, piece_end bigint, boundary string"


def core(value: str) -> tuple[int, int]:
    """(start, end): offsets of value without outer blanks, one fence at each end and the blanks inside these."""
    left = value.lstrip(BLANKS)
    if left.startswith(FENCE):
        left = left[len(FENCE) :].lstrip(BLANKS)
    right = left.rstrip(BLANKS)
    if right.endswith(FENCE):
        right = right[: -len(FENCE)].rstrip(BLANKS)
    start = len(value) - len(left)
    return start, start + len(right)


def _take_apart(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ranges of the values that exceed their limit; each with its halo before it and behind it all that a piece beginning in it can need."""
    columns = [c.split()[0] for c in _RANGES.split(", ")]
    for frame in frames:
        rows, size = [], 0
        for ids, value, most, overlap in frame.itertuples(index=False):
            start, end = core(value)
            if end - start <= most:
                continue
            key = hashlib.sha256(f"{ids}\x01{value}".encode("utf-8", "surrogatepass")).hexdigest()
            for n, low in enumerate(range(start, end, RANGE)):
                high, halo = min(low + RANGE, end), min(HALO, low - start)
                chunk = value[low - halo : min(high + max(HALO, most), end)]
                rows.append((key, ids, n, high - low, high == end, halo, chunk, start, most, overlap))
                size += len(chunk)
                if size > 1 << 22:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, size = [], 0
        yield pd.DataFrame(rows, columns=columns)


def boundaries(chunk: str, halo: int, n_chars: int, span: int) -> np.ndarray:
    """Boundary table of a range that begins after halo characters of chunk: 4 * offset + number of the kind, offsets 1..n_chars.

    Kept are those a piece can end at: a boundary of a lower kind only if those of the better kinds around it leave a
    span free, as every span reaches over ``span`` characters at least.
    """
    kind: dict[int, int] = {}
    for number in (2, 1, 0):
        for match in _PATTERNS[number].finditer(chunk):
            kind[match.end() - halo] = number
    at = np.fromiter(sorted(kind), np.int64, len(kind))
    number = np.fromiter((kind[a] for a in at.tolist()), np.int64, len(kind))
    keep = np.ones(len(at), np.bool_)
    for low in (1, 2):
        better = np.concatenate(([-(1 << 60)], at[number < low], [1 << 60]))
        place = np.searchsorted(better, at)
        free = better[np.minimum(place, len(better) - 1)] - better[place - 1] > span
        keep &= (number != low) | free
    keep &= (at > 0) & (at <= n_chars)
    return 4 * at[keep] + number[keep]


def _search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        found = [boundaries(c, h, n, m - o) for c, h, n, m, o in zip(frame["chunk"], frame["halo"], frame["n_chars"], frame["max_size"], frame["overlap"], strict=True)]
        yield frame.assign(at=found)[[c.split()[0] for c in _TABLES.split(", ")]]


class Walk:
    """The walk over one value, fed with its ranges in order; it holds the boundaries of one span and one range."""

    def __init__(self, size: int, overlap: int):
        self.size, self.overlap, self.end, self.number = size, overlap, 0, 0
        self.at, self.ranges = np.zeros(0, np.int64), []

    def feed(self, range_no: int, base: int, n_chars: int, at: np.ndarray, last: bool) -> Iterator[tuple[int, int, int, int, int, str]]:
        """(piece_no, range_no, in_range, start, end, boundary) of the pieces that are settled by now."""
        self.ranges.append((base, range_no))
        self.at = np.concatenate((self.at[self.at >> 2 > self.end], at + 4 * base))
        offsets, numbers, covered = self.at >> 2, self.at & 3, base + n_chars
        places = [offsets[numbers <= n] for n in range(len(KINDS))]
        done = False
        while not done:
            begin = self.end - self.overlap if self.number else 0
            limit = begin + self.size
            if limit >= covered:
                if not last:
                    break
                end, boundary, done = covered, "end", True
            else:
                end, boundary = limit, "none"
                for kind, some in zip(KINDS, places, strict=True):
                    k = int(np.searchsorted(some, limit, "right")) - 1
                    if k >= 0 and some[k] > max(self.end, self.overlap):
                        end, boundary = int(some[k]), kind
                        break
            while len(self.ranges) > 1 and self.ranges[1][0] <= begin:
                self.ranges.pop(0)
            yield self.number, self.ranges[0][1], begin - self.ranges[0][0], begin, end, boundary
            self.end, self.number = end, self.number + 1


def _walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ranges come sorted by value and number; a value's may be spread over several frames."""
    now, walk = None, None
    for frame in frames:
        rows = []
        for key, ids, range_no, n_chars, last, at, start, size, overlap, base in frame.itertuples(index=False):
            if key != now:
                now, walk = key, Walk(size, overlap)
            rows += [(key, ids, n, r, i, start + a, start + b, kind) for n, r, i, a, b, kind in walk.feed(range_no, base, n_chars, np.asarray(at, np.int64), last)]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _CUTS.split(", ")])


def _cuts(tables: DataFrame) -> DataFrame:
    """Pieces by offset, of boundary tables of ranges: their lengths are summed up within each value, then it is walked."""
    before = Window.partitionBy("key").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = tables.withColumn("base", F.coalesce(F.sum("n_chars").over(before), F.lit(0)))  # sorted by key and range_no from here on
    return placed.mapInPandas(_walk, _CUTS)


def ranges_of(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    overlap = F.greatest(F.lit(0), F.least(F.coalesce("overlap", F.lit(0)), ((F.col("max_size") - 1) / 2).cast("int"))).cast("int")
    large = values.filter((F.length(value) > F.col("max_size")) & (F.col("max_size") > 0)).select(F.to_json(F.struct(*keys)).alias("ids"), F.col(value).alias("value"), F.col("max_size").cast("int").alias("max_size"), overlap.alias("overlap"))
    # equal rows have equal ranges; the exchange spreads the ranges of one value over the tasks
    return large.mapInPandas(_take_apart, _RANGES).dropDuplicates(["key", "range_no"])


def cut_offsets(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The pieces of ``split_oversized`` without their text."""
    cuts = _cuts(ranges_of(values, keys, value).mapInPandas(_search, _TABLES))
    return cuts.select(F.from_json("ids", values.select(*keys).schema).alias("ids"), "piece_no", "piece_start", "piece_end", "boundary").select("ids.*", "piece_no", "piece_start", "piece_end", "boundary")


def split_oversized(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Pieces of the values that exceed their limit.

    values has the columns ``keys``, ``value``, ``max_size`` and ``overlap``. Out: the keys and piece_no, piece_start,
    piece_end (offsets in the value as stored), boundary (what the piece ends at: paragraph, sentence, word, none, or
    end) and piece. Pieces cover the value without its outer blanks and fences, and consecutive ones share exactly
    ``overlap`` characters. Values within the limit, null or blank values, and values without a limit have no row;
    equal rows count once. An overlap of half the limit or more is lowered to just under half.
    """
    ranges = ranges_of(values, keys, value)
    cuts = _cuts(ranges.mapInPandas(_search, _TABLES))
    texts = ranges.select("key", "range_no", "halo", "chunk")
    whole = cuts.join(texts, ["key", "range_no"])
    piece = F.substring(F.col("chunk"), F.col("halo") + F.col("in_range") + 1, (F.col("piece_end") - F.col("piece_start")).cast("int"))
    out = whole.select(F.from_json("ids", values.select(*keys).schema).alias("ids"), "piece_no", "piece_start", "piece_end", "boundary", piece.alias("piece"))
    return out.select("ids.*", "piece_no", "piece_start", "piece_end", "boundary", "piece")


def _open(path: str):
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def _read_range(path: str, low: int, high: int, before: int, behind: int) -> tuple[str, str, str]:
    """Text of the bytes low..high of a UTF-8 file (characters belong to the range of their first byte), and of the halos around it."""
    with _open(path) as file:
        size, start = file.size(), max(0, low - before)
        stop = min(size, high + behind + 3)
        data = file.read_at(stop - start, start)

    def first(at: int) -> int:  # the first character that begins at or after a byte
        while at < len(data) and data[at] & 0xC0 == 0x80:
            at += 1
        return at

    own, right, end = first(low - start), first(high - start), len(data)
    if stop < size:  # the last character may be cut off, and isn't needed
        while end > right and data[end - 1] & 0xC0 == 0x80:
            end -= 1
        end = max(right, end - 1)
    marks = [first(0) if start else 0, own, right, end]
    return tuple(data[a:b].decode("utf-8", "replace") for a, b in zip(marks, marks[1:], strict=False))


def split_files(spark: SparkSession, path: str, max_size: int, overlap: int = 0) -> DataFrame:
    """(path, piece_no, piece_start, piece_end, boundary, piece) of UTF-8 text files above max_size characters, by byte ranges.

    No worker reads more of a file than a range, its halo and one piece. Offsets are in characters. Files within the
    limit are one piece, empty ones have no row; outer blanks and fences belong to the pieces. Paths are those that
    every executor can open.
    """
    overlap = max(0, min(overlap, (max_size - 1) // 2))
    files = spark.read.format("binaryFile").load(path).select("path", "length").filter("length > 0")
    parts = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(RANGE).cast("bigint"))).alias("low")).repartition("path", "low")

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, length, low in frame.itertuples(index=False):
                high = min(low + RANGE, length)
                left, own, right = _read_range(name, low, high, HALO, HALO)
                rows.append((name, name, low // RANGE, len(own), high == length, boundaries(left + own + right, len(left), len(own), max_size - overlap), 0, max_size, overlap))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _TABLES.split(", ")])

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for (name, number), some in frame.groupby(["key", "range_no"]):
                _, own, right = _read_range(name, number * RANGE, (number + 1) * RANGE, 0, 4 * max_size)
                text = own + right
                rows += [(name, n, a, b, kind, text[i : i + b - a]) for n, i, a, b, kind in some[["piece_no", "in_range", "piece_start", "piece_end", "boundary"]].itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["path", "piece_no", "piece_start", "piece_end", "boundary", "piece"])

    cuts = _cuts(parts.mapInPandas(search, _TABLES))
    return cuts.repartition("key", "range_no").mapInPandas(read, "path string, piece_no int, piece_start bigint, piece_end bigint, boundary string, piece string")


def limited_values(spark: SparkSession, folder: str) -> DataFrame:
    """text and essay_content of in_plain_text as rows with the limit of their kind (``*``: kinds without one, and null)."""
    limits = table(spark, folder, "size_limits").filter("unit = 'characters'").groupBy("used_for").agg(F.min("max_size").alias("max_size"), F.min("overlap").alias("overlap"))
    named = limits.filter("used_for <> '*'").withColumnRenamed("used_for", "kind")
    rest = limits.filter("used_for = '*'")
    fields = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("text", "essay_content")))
    values = table(spark, folder, "in_plain_text").select("id", "kind", F.explode(fields).alias("f")).select("id", "kind", "f.field", "f.value").filter("value is not null")
    return (
        values.join(named, "kind", "left")  # a handful of kinds: the planner sees their size and broadcasts them
        .select("id", "field", "value", F.coalesce("max_size", rest.agg(F.min("max_size")).scalar()).alias("max_size"), F.coalesce("overlap", rest.agg(F.min("overlap")).scalar()).alias("overlap"))
        .filter("max_size is not null")
    )


def pieces(spark: SparkSession, folder: str) -> DataFrame:
    """p4_pieces: all pieces of the oversized values."""
    return split_oversized(limited_values(spark, folder), ["id", "field"], "value")


def cover(spark: SparkSession, folder: str) -> DataFrame:
    """p4_cover: what the pieces of each value cover, the characters that consecutive ones share, and whether each is as long as its offsets say and within its limit."""
    values = limited_values(spark, folder)
    limits = values.groupBy("id", "field").agg(F.max("max_size").alias("max_size"))
    rows = split_oversized(values, ["id", "field"], "value")
    before = Window.partitionBy("id", "field").orderBy("piece_start")
    rows = rows.withColumn("shared", F.lag("piece_end").over(before) - F.col("piece_start"))
    long = F.length("piece").cast("bigint")
    each = rows.groupBy("id", "field").agg(
        F.min("piece_start").alias("covered_from"), F.max("piece_end").alias("covered_to"), F.min("shared").alias("least_shared"), F.max("shared").alias("most_shared"),
        F.max(long).alias("longest"), F.bool_and(long == F.col("piece_end") - F.col("piece_start")).alias("whole"), F.bool_and(F.col("boundary").isin(*KINDS, "none", "end")).alias("named"),
    )
    return each.join(limits, ["id", "field"]).select("id", "field", "covered_from", "covered_to", "least_shared", "most_shared", (F.col("whole") & F.col("named") & (F.col("longest") <= F.col("max_size"))).alias("kept"))


def found(spark: SparkSession, folder: str) -> DataFrame:
    """p4_found: the values that came out in pieces."""
    return cut_offsets(limited_values(spark, folder), ["id", "field"], "value").filter("piece_no > 0").select("id", "field").distinct()
