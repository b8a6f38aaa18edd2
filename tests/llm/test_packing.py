import math
import random

from loomspar.llm import packing


def test_plans():
    rng = random.Random(4)
    for capacity, longest, n in ((100, 100, 500), (2048, 900, 3000), (50, 7, 200), (64, 64, 3), (10, 1, 95)):
        lengths = [rng.randint(1, longest) for _ in range(n)]
        histogram = {k: lengths.count(k) for k in set(lengths)}
        plan = packing.solve(histogram, capacity, rounds=60)
        room = [0] * plan.containers
        for length, count in histogram.items():
            for rank in range(count):
                room[plan.place(length, rank)] += length
        assert max(room) <= capacity and min(room) > 0
        bound = max(math.ceil(sum(lengths) / capacity), sum(x * 2 > capacity for x in lengths))
        assert plan.containers <= bound * 1.06 + 1
    assert packing.solve({}, 10).containers == 0


def test_pack(spark):
    sizes = [(n, s) for n, s in enumerate([0, 5, 100, 101, 250, 99, 1, 1, 60, 40, 300, None])] + [(None, 5)]
    frame = spark.createDataFrame([(*r, "x") for r in sizes], "doc_id bigint, tokens bigint, length string")  # clashing name
    rows = packing.pack(frame, 100).collect()
    used, covered = {}, {}
    for d, a, b, s in rows:
        used[s] = used.get(s, 0) + b - a
        covered.setdefault(d, []).append((a, b))
    assert max(used.values()) <= 100 and set(covered) == set(range(12))
    for d, size in sizes[:12]:
        at = 0
        for a, b in sorted(covered[d]):
            assert a == at and (b - a == 100 or b == (size or 0))
            at = b
        assert at == (size or 0)
    assert sum(v > 0 for v in used.values()) == max(used) + 1


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, tokens bigint"), 100).count() == 0


def test_tokens_round_trip(spark):
    texts = ["", None, "hello world", "<|endoftext|> naïve 漢字", "x" * 20_000]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    encode = packing.encoder(packing.tokenizer_path())
    got = {r["doc_id"]: r["tokens"] for r in packing.token_counts(frame).collect()}
    assert got == {n: len(encode.encode_ordinary(t)) if t else 0 for n, t in enumerate(texts)}
    assert encode.decode(encode.encode_ordinary(texts[3])) == texts[3]
