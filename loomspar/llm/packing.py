"""Filling fixed-capacity containers with items (problem 6).

Method: configuration linear program over the histogram of lengths. A container's configuration says how many items
of each length it holds. Multiplicative weights give each length a price that falls as it is covered; a knapsack
dynamic program finds the configuration worth most at these prices. The fractional solution is rounded down, and what
remains is packed best fit. All of this sees the histogram alone, whose size the capacity bounds, not the items.
Then each item's rank among those of its length tells its container by arithmetic.
"""

from __future__ import annotations

import base64
import bisect
import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspar.runtime import cut, table

TOKENIZER = "byte_bpe_50k.tiktoken"
#: Rounds of multiplicative weights, and how far a length's price falls when a whole share of it is covered.
ROUNDS, RATE = 400, 0.5
#: Buckets over which the ranks within one length are counted, so that a length with many items is not one task.
BUCKETS = 64


def tokenizer_path(name: str = TOKENIZER) -> str:
    """The path of a public tokenizer's vocabulary; the folder is the parameter LOOMSPAR_TOKENIZERS, or the installed one."""
    if folder := os.environ.get("LOOMSPAR_TOKENIZERS"):
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _token_counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            sizes = [len(encode.encode_ordinary(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["doc_id", "tokens"])

    return run


def token_counts(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, tokens) by a public tokenizer; null and empty texts have 0."""
    rows = documents.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(_token_counts(path or tokenizer_path()), "doc_id bigint, tokens bigint")


def best_configuration(prices: np.ndarray, lengths: np.ndarray, most: np.ndarray, capacity: int) -> dict[int, int]:
    """The items of most value that fit (lengths may repeat), by dynamic programming over the capacity."""
    value = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1, np.int64)
    for room in range(1, capacity + 1):
        n = np.searchsorted(lengths, room, "right")
        value[room] = value[room - 1]
        if n:
            gain = value[room - lengths[:n]] + prices[:n]
            k = int(gain.argmax())
            if gain[k] > value[room]:
                value[room], choice[room] = gain[k], k
    out: dict[int, int] = {}
    room = capacity
    while room > 0:
        k = int(choice[room])
        if k < 0:
            room -= 1
            continue
        out[k] = out.get(k, 0) + 1
        room -= int(lengths[k])
    return {k: min(n, int(most[k])) for k, n in out.items()}


@dataclass(slots=True)
class Plan:
    """Where the items of each length go: runs (first rank, first container, items of the length in each container)."""

    containers: int = 0
    runs: dict[int, list[tuple[int, int, int]]] = field(default_factory=dict)

    def place(self, length: int, rank: int) -> int:
        runs = self.runs[length]
        first, container, each = runs[bisect.bisect_right(runs, (rank, float("inf"), 0)) - 1]
        return container + (rank - first) // each


def solve(histogram: dict[int, int], capacity: int, rounds: int = ROUNDS) -> Plan:
    """A plan for a histogram of lengths from 1 to capacity."""
    plan = Plan()
    lengths = np.array(sorted(k for k, n in histogram.items() if n > 0), np.int64)
    if not len(lengths):
        return plan
    count = np.array([histogram[int(k)] for k in lengths], np.int64)
    # multiplicative weights: the price of a length falls with the share of it that the configurations so far cover
    cover, used = np.zeros(len(lengths)), {}
    for _ in range(rounds):
        prices = lengths / capacity * np.exp(-RATE * (cover - cover.min()))
        found = best_configuration(prices, lengths, count, capacity)
        key = tuple(sorted(found.items()))
        # as often as covers a part of its scarcest length, in units of what the whole takes
        step = min(count[k] / n for k, n in key) / 8
        used[key] = used.get(key, 0.0) + step
        for k, n in key:
            cover[k] += 8 * step * n / count[k]
    scale = np.zeros(len(lengths))
    for key, times in used.items():
        for k, n in key:
            scale[k] += times * n
    left = count.copy()
    taken = np.zeros(len(lengths), np.int64)

    def use(key: tuple[tuple[int, int], ...], times: int) -> None:
        for k, n in key:
            plan.runs.setdefault(int(lengths[k]), []).append((int(taken[k]), plan.containers, n))
            taken[k] += n * times
            left[k] -= n * times
        plan.containers += times

    # round: fullest configurations first, each its share of what it was given, as far as the items last
    full = sorted(used, key=lambda key: (-sum(n * int(lengths[k]) for k, n in key), key))
    for part in (1.0, 4.0, np.inf):
        for key in full:
            if sum(n * int(lengths[k]) for k, n in key) < capacity * 0.97:
                continue
            fair = min(count[k] / max(scale[k], 1e-12) for k, n in key) * used[key]
            times = int(min(fair * part if np.isfinite(part) else np.inf, min(left[k] // n for k, n in key)))
            if times > 0:
                use(key, times)
    # what is left: the price of a length is its size, so each further container is filled as far as can be
    while left.any():
        some = np.flatnonzero(left)
        found = fill(lengths[some], left[some], capacity)
        key = tuple(sorted((int(some[k]), n) for k, n in found.items()))
        use(key, int(min(left[k] // n for k, n in key)))
    return plan


def fill(lengths: np.ndarray, left: np.ndarray, capacity: int) -> dict[int, int]:
    """One container: the longest item left, and the fullest completion with items that are left (bounded subset sums)."""
    first = len(lengths) - 1
    room = capacity - int(lengths[first])
    reach = np.full(room + 1, -1, np.int64)  # the last length used to reach a sum
    times = np.zeros(room + 1, np.int64)
    reach[0] = len(lengths)
    for k in range(len(lengths) - 1, -1, -1):
        have, size = int(left[k]) - (k == first), int(lengths[k])
        if have <= 0 or size > room:
            continue
        n = 1
        while have > 0:  # in powers of two
            n = min(n, have)
            span = n * size
            if span > room:
                n = room // size
                span = n * size
                if n == 0:
                    break
            fresh = np.flatnonzero((reach[span:] < 0) & (reach[: room + 1 - span] >= 0))
            reach[fresh + span], times[fresh + span] = k, n
            have -= n
            n *= 2
        if reach[room] >= 0:
            break
    at = int(np.flatnonzero(reach >= 0)[-1])
    out = {first: 1}
    while at > 0:
        k, n = int(reach[at]), int(times[at])
        out[k] = out.get(k, 0) + n
        at -= n * int(lengths[k])
    return {k: min(n, int(left[k])) for k, n in out.items()}


def _assign(plan: Plan, offset: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = batch.column("length").to_pylist(), batch.column("rank").to_pylist()
            places = [offset + plan.place(n, r) if n else 0 for n, r in zip(lengths, ranks, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "token_start", "token_end")), pa.array(places, pa.int64())], names=["doc_id", "token_start", "token_end", "sequence_id"])

    return run


def pack(sizes: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, token_start, token_end, sequence_id): documents in sequences of at most ``capacity`` tokens.

    sizes: doc_id (unique), tokens. A document that exceeds the capacity alone is cut into full sequences of its own
    and a rest, which is packed like a document. Documents without tokens are put into sequence 0. An empty table
    gives an empty result.
    """
    sizes = cut(sizes.filter("doc_id is not null").select("doc_id", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens")))
    rest = sizes.select("doc_id", F.col("tokens"), (F.col("tokens") % capacity).alias("length")).filter(F.expr("length > 0 or tokens = 0"))
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int")
    rest = rest.withColumn("bucket", bucket)
    counted = rest.groupBy("length", "bucket").agg(F.count("*").alias("n"))  # at most capacity * BUCKETS rows
    totals = counted.groupBy("length").agg(F.sum("n").alias("n")).filter("length > 0").collect()  # at most capacity rows
    histogram = {r["length"]: r["n"] for r in totals}
    plan = solve(histogram, capacity)
    before = counted.select("length", "bucket", F.coalesce(F.sum("n").over(_earlier("length", "bucket")), F.lit(0)).alias("before"))
    ranked = rest.withColumn("within", F.row_number().over(_order(["length", "bucket"], "doc_id"))).join(F.broadcast(before), ["length", "bucket"])
    ranked = ranked.select("doc_id", (F.col("tokens") - F.col("length")).alias("token_start"), F.col("tokens").alias("token_end"), "length", (F.col("before") + F.col("within") - 1).alias("rank"))
    placed = ranked.mapInArrow(_assign(plan, 0), "doc_id bigint, token_start bigint, token_end bigint, sequence_id bigint")
    # full sequences of long documents: numbered behind the packed ones, by document within buckets
    long = sizes.filter(F.col("tokens") >= capacity).select("doc_id", F.floor(F.col("tokens") / capacity).alias("full"), bucket.alias("bucket"))
    shares = long.groupBy("bucket").agg(F.sum("full").alias("n"))
    base = shares.select("bucket", F.coalesce(F.sum("n").over(_earlier(None, "bucket")), F.lit(0)).alias("before"))
    behind = F.sum("full").over(_order(["bucket"], "doc_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("full")
    start = long.withColumn("own", behind).join(F.broadcast(base), "bucket").select("doc_id", (F.col("own") + F.col("before") + plan.containers).alias("first"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("k"))
    full = start.select("doc_id", (F.col("k") * capacity).alias("token_start"), ((F.col("k") + 1) * capacity).alias("token_end"), (F.col("first") + F.col("k")).alias("sequence_id"))
    return placed.unionByName(full)


def _order(keys: list[str], by: str):
    return Window.partitionBy(*keys).orderBy(by)


def _earlier(key: str | None, by: str):
    # counts by bucket: at most BUCKETS rows for each length
    return (Window.partitionBy(key) if key else Window.partitionBy(F.lit(0))).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)


def _query(used_for: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        limit = table(spark, folder, "size_limits").filter((F.col("unit") == "tokens") & (F.col("used_for") == used_for)).agg(F.min("max_size")).first()[0]
        return pack(token_counts(table(spark, folder, "documents")), int(limit))

    return run


sequences = _query("training sequence")
long_sequences = _query("long training sequence")
