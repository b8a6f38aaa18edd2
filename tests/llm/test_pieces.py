import random

import numpy as np

from loomspar.llm import pieces


def cut(spark, values, size=50, overlap=7):
    frame = spark.createDataFrame([(n, v, size, overlap, "x", 1) for n, v in enumerate(values)], "id bigint, value string, max_size int, overlap int, step string, piece_no int")  # clashing names
    out = {}
    for r in pieces.split_oversized(frame, ["id"], "value").collect():
        out.setdefault(r["id"], []).append(r)
    return {k: sorted(v, key=lambda r: r["piece_no"]) for k, v in out.items()}


def check(text, got, size, overlap):
    core = text.strip()
    assert got[0]["piece_start"] == text.index(core.strip("`").strip()) if "`" in text else True
    previous = None
    for r in got:
        assert r["piece"] == text[r["piece_start"] : r["piece_end"]] and 0 < len(r["piece"]) <= size
        assert previous is None or r["piece_start"] == previous - overlap
        previous = r["piece_end"]


def test_pieces(spark, monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["ab ", "cde. ", "F ", "\n\n", "ü", "漢字。", "x"]) for _ in range(rng.randint(30, 400))).strip() for _ in range(30)]
    texts += ["x" * 1000, "``` " + "word " * 40 + "\n```", " " * 60 + "short" + " " * 60, "", None, "a" * 50, "b" * 51]
    got = cut(spark, texts)
    for n, t in enumerate(texts):
        if n in got:
            check(t, got[n], 50, 7)
    assert 33 not in got and 34 not in got and 32 not in got and 35 not in got and 36 in got and 31 in got
    assert {r["boundary"] for r in got[30]} == {"none", "end"}
    assert sum(r["boundary"] == "none" for r in got[31]) == 0


def test_ranges_of_giant_values(spark, monkeypatch):
    text = ("Sentence number one is here. " * 12000).strip()
    got = cut(spark, [text, text], 1000, 100)
    assert len(got) == 2 and len(got[0]) == len(got[1]) > 300
    check(text, got[0], 1000, 100)
    assert {r["boundary"] for r in got[0]} == {"sentence", "end"}


def test_empty_and_odd_limits(spark):
    assert cut(spark, []) == {}
    for size, overlap in ((1, 0), (2, 5), (3, 1), (10, 9)):
        got = cut(spark, ["abc def ghi jkl mno pqr"], size, overlap)
        assert max(len(r["piece"]) for r in got[0]) <= size and got[0][-1]["piece_end"] == 23


def test_boundaries_in_the_whole_span(spark, monkeypatch):
    text = "a" * 20 + " " + "b" * 500 + ". C" + "d" * 98
    got = cut(spark, [text], 100, 45)[0]
    check(text, got, 100, 45)
    assert (got[0]["piece_end"], got[0]["boundary"]) == (100, "none")  # a boundary inside the overlap would not let the next piece advance
    text = "One. W" + "w" * 29 + " " + "x" * 68 + " end"
    assert [(r["piece_end"], r["boundary"]) for r in cut(spark, [text], 100, 0)[0]][0] == (5, "sentence")
    text = "a" * 60 + " " + "b" * 80  # half of the limit is overlap
    got = cut(spark, [text], 100, 45)[0]
    check(text, got, 100, 45)
    assert (got[0]["piece_end"], got[0]["boundary"]) == (61, "word")
    monkeypatch.setattr(pieces, "RANGE", 64)
    assert [(r["piece_end"], r["boundary"]) for r in cut(spark, [text], 100, 45)[0]] == [(r["piece_end"], r["boundary"]) for r in got]


def brute(text, size, overlap):
    """(end, boundary) of the pieces, from the boundaries of the whole text."""
    kind = {m.end(): n for n in (2, 1, 0) for m in pieces._PATTERNS[n].finditer(text)}
    out, end = [], 0
    while True:
        limit = (end - overlap if out else 0) + size
        if limit >= len(text):
            return [*out, (len(text), "end")]
        best = max(((-n, a) for a, n in kind.items() if max(end, overlap) < a <= limit), default=None)
        end = best[1] if best else limit
        out.append((end, pieces.KINDS[-best[0]] if best else "none"))


def some_text(rng, n):
    return "".join(rng.choice(["ab ", "cde. ", "F ", "\n\n", "ü", "漢字。", "x", "yyyyyyyyyyyyyyyy", "G\n"]) for _ in range(n)).strip()


def test_ranges_give_the_cuts_of_the_whole_text(spark, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(pieces, "RANGE", 70)
    monkeypatch.setattr(pieces, "HALO", 64)
    texts = [some_text(rng, rng.randint(100, 300)) for _ in range(60)]
    for size, overlap in ((40, 0), (60, 20), (90, 30), (200, 50)):
        got = cut(spark, texts, size, overlap)
        for n, t in enumerate(texts):
            want = brute(t, size, overlap)
            assert [(r["piece_end"], r["boundary"]) for r in got.get(n, [])] == (want if len(t) > size else []), (size, overlap, n)


def test_boundaries_that_no_piece_can_end_at_are_left_out():
    text = "word " * 40 + ("Word " * 3 + "end. ") * 40 + "\n\nNext " + "word " * 100
    many, few = (pieces.boundaries(text, 0, len(text), span) for span in (0, 300))
    assert len(many) > len(few) and set(few.tolist()) <= set(many.tolist()) and np.all(np.diff(few) > 0)


def test_one_value_is_searched_by_many_tasks(spark):
    text = ("Sentence number one is here. " * 60000).strip()
    frame = spark.createDataFrame([(1, text, 1000, 100)], "id bigint, value string, max_size int, overlap int")
    spread = pieces.ranges_of(frame, ["id"], "value")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [n for n in spread.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) > 1 and sum(sizes) == -(-len(text) // pieces.RANGE)


def test_files_by_byte_ranges(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(pieces, "RANGE", 61)
    monkeypatch.setattr(pieces, "HALO", 256)
    texts = {f"f{n}.txt": some_text(rng, 200) for n in range(6)} | {"empty.txt": "", "short.txt": "é"}
    for name, t in texts.items():
        (tmp_path / name).write_bytes(t.encode())
    out = {}
    for r in pieces.split_files(spark, str(tmp_path), 80, 15).collect():
        out.setdefault(r["path"].rsplit("/", 1)[1], []).append(r)
    assert set(out) == set(texts) - {"empty.txt"}
    for name, got in out.items():
        got.sort(key=lambda r: r["piece_no"])
        assert [(r["piece_end"], r["boundary"]) for r in got] == brute(texts[name], 80, 15)
        assert all(r["piece"] == texts[name][r["piece_start"] : r["piece_end"]] for r in got)
