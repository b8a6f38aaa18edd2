from loomspar.llm import identities

PEOPLE = [
    ("a1", "Alexander G. Sevorert", "Goalkeeper from Raleck (b. 1937)."), ("a2", "Sevorért, Sasha", "lives in Raleck"), ("a3", "Dr. A. Sevorret", "Raleck-based goalkeeper, * 1937"), ("a4", "ALEXANDER SEVORERT", None),
    ("b1", "Alexander Moskubex", "notary in Detern, born 1900"), ("b2", "Alexander Moskubex", "Born in 1950; worked as notary at Povant."),
    ("c1", "Kihoplix Manufacturing SA", "Founded in 1986, seat at Meteld."), ("c2", "K.M.", "Established 1986 (Meteld); short for Kihoplix Manufacturing SA"), ("c3", "Mfg Kihoplix", ""),
    ("d1", "", "Person named in the passage."), (None, "Alexander Sevorert", None), ("d2", None, None),
]


def groups(spark, rows, kinds=None):
    kind = lambda i: "organisation" if (i or "").startswith("c") else "person"
    frame = spark.createDataFrame([(i, n, d, kind(i), "x", "y") for i, n, d in rows], "entity_id string, name string, description string, kind string, pid string, root string")  # clashing names
    out = {}
    for r in identities.link(frame).collect():
        out.setdefault(r["root"], set()).add(r["entity_id"])
    return sorted(map(sorted, out.values()))


def test_variants_and_namesakes(spark):
    assert groups(spark, PEOPLE + PEOPLE) == [["a1", "a2", "a3", "a4"], ["b1"], ["b2"], ["c1", "c2", "c3"]]


def test_poor_record_does_not_join_namesakes(spark):
    rows = [("x1", "Anna Brovefant", "notary in Detern, born 1900"), ("x2", "Anna Brovefant", "surgeon in Povant, born 1950"), ("x3", "Anna Brovefant", None)]
    for g in groups(spark, rows):
        assert not {"x1", "x2"} <= set(g)


def test_empty_and_other_kinds(spark):
    assert groups(spark, []) == []
    frame = spark.createDataFrame([("1", "Steam Drum", None, None)], "entity_id string, name string, description string, kind string")
    assert identities.link(frame).count() == 0


def test_long_names(spark):
    assert len(groups(spark, [("z1", "word " * 500, None), ("z2", "Bo " + "x" * 5000, None)])) == 2


def test_names_agree():
    s = lambda n: identities.spelling(n, "person")
    assert identities.names_agree(s("Antony B. Stelevrond"), s("Stelevrond, Tony")) is not None
    assert identities.names_agree(s("William P. Kuguguck"), s("William H. Kuguguck")) is None
    assert identities.names_agree(s("Anna Kuguguck"), s("Benno Kuguguck")) is None
    assert identities.attributes("Born in 1915; worked as bridge designer at Memox.", "person") == (["1915"], ["memox"], ["bridge designer"], [])


def test_common_words_with_typos_and_initials(spark):
    # both words of one person stand beside many others; a typo in one of them is a rare word
    rows = [(f"g{n}", f"Robert {a}{b}", None) for n, (a, b) in enumerate(zip("Bacar Defin Gilom Hupar Jokan Kelit Lumer Moran Nesti Paluk".split() * 5, "ovest ulmer ikson arden olipt".split() * 10))]
    rows += [(f"h{n}", f"{a}{b} Niridal", None) for n, (a, b) in enumerate(zip("Ab Ek Ig Ol Ut Ys Br Cl Dr Fr".split() * 5, "uvar ezin omir akel idos".split() * 10))]
    rows += [("t1", "Robert Niridal", None), ("t2", "Robert Niridel", None), ("t3", "R. Niridal", None), ("t4", "Robart Niridal", None)]
    found = [g for g in groups(spark, rows) if "t1" in g]
    assert found and {"t1", "t2", "t3", "t4"} <= set(found[0])


def test_no_profile_is_dropped(spark):
    assert ["u1"] in groups(spark, [("u1", "R. N.", None), ("u2", "Robert Niridal", None)])


def test_surname_beside_many_first_names(spark):
    # however many first names a surname stands beside, a name of initials and surname meets its written forms
    first = [a + b for a in "Bacar Defin Gilom Hupar Jokan Kelit Lumer Moran Nesti Paluk".split() for b in "ovest ulmer ikson arden olipt ubina".split()]
    for n in (10, 60):
        rows = [(f"g{k}", f"{w} Quillfeather", None) for k, w in enumerate(first[:n])]
        rows += [("t1", "A. B. Quillfeather", None), ("t2", "B. A. QUILLFEATHER", None), ("t3", "Dr. A. B. Quillfeather", None)]
        out = groups(spark, rows)
        assert sum(map(len, out)) == n + 3
        assert any({"t1", "t2", "t3"} <= set(g) for g in out)


def test_equal_initials(spark):
    rows = [("i1", "K.M.", "Established 1986 (Meteld)"), ("i2", "K. M.", "Founded in 1986, seat at Meteld."), ("i3", "K.M.", "Founded in 1931, seat at Povant."), ("i4", "Robert Niridal", None)]
    assert groups(spark, rows) == [["i1", "i2"], ["i3"], ["i4"]]


def keys(name):
    return {k for k, _ in identities.name_keys(identities.spelling(name, "person"))}


def test_keys():
    for a, b in (("Robert Niridal", "Robart Nirdial"), ("Anna Berta Moreno", "Anna Brta Morenno"), ("A. Moreno", "Anna Moreno"), ("A. Moreno", "A. B. Moreno"), ("Anna B. Moreno", "A. Berta Moreno"), ("K. M.", "k.m.")):
        assert keys(a) & keys(b), (a, b)
    # two written names meet by an abbreviation's key from the same side only, which the join leaves out
    sides = lambda n: identities.name_keys(identities.spelling(n, "person"))
    assert not any(s == t == 0 or s & t == 0 for k, s in sides("Robert Niridal") for m, t in sides("Robert Norbital") if k == m)
    many = " ".join(f"word{c}" for c in "abcdefghij")
    assert keys(many) & keys(many.replace("worda", "worta").replace("wordb", "wordbb")) and len(keys(many * 100)) < 1000


def test_plan_of_moves_grows_with_rounds_only(spark):
    # 0 to 1 to 2 ... by rounds, each with a move of its own beside
    rounds = [spark.createDataFrame([(n, n + 1), (100 + n, n + 1), (200 + n, 300 + n)], "pid bigint, into bigint") for n in range(8)]
    out = identities.followed(rounds)
    assert out._jdf.queryExecution().analyzed().collectLeaves().size() < 2 * len(rounds)
    assert {r["pid"]: r["into"] for r in out.collect()} == {**{n: 8 for n in range(8)}, **{100 + n: 8 for n in range(8)}, **{200 + n: 300 + n for n in range(8)}}
    assert out.count() == 24


def test_names_that_meet_can_agree(spark):
    # a frequent word, the same initials and endings beside it, and another word
    rare = [a + b + "irt" for a in "kr kl".split() for b in "bafo cegu dipy humo jaxe neqi sevu zypo tawc gyme".split()]
    profiles = [(n, "organisation", [identities.spelling(f"International {w} Shipping", "organisation")]) for n, w in enumerate(rare)]
    profiles += [(100 + n, "person", [identities.spelling(f"Oswald {w}", "person")]) for n, w in enumerate(rare)]
    profiles += [(200 + n, "person", [identities.spelling(f"Oswald {w[0]}. M{w}", "person")]) for n, w in enumerate(rare[:12])]
    frame = spark.createDataFrame([(*p, [], [], []) for p in profiles], "pid bigint, kind string, names array<string>, years array<string>, places array<string>, jobs array<string>")
    keys = frame.mapInPandas(identities._keys(False), identities._KEYED)
    met = {(r["a"], r["b"]) for r in identities._meet(keys, keys).collect()}
    names = {p[0]: p[2][0] for p in profiles}
    agree = {(a, b) for a in names for b in names if a < b and (a < 100) == (b < 100) and identities.names_agree(names[a], names[b]) is not None}
    assert agree <= met
    assert len(met) < len(agree) + 150  # of some 500 with the word and the initials or the ending in common


def test_stated_persons_meet_with_another_word(spark):
    rows = [("s1", "Anna Brovefant", "notary in Detern, born 1900"), ("s2", "Anna Quillimor", "notary in Detern, born 1900"), ("s3", "Anna Quillimor", "surgeon in Povant, born 1950")]
    assert groups(spark, rows) == [["s1", "s2"], ["s3"]]


def test_tables_of_a_round(spark, monkeypatch):
    written = []
    monkeypatch.setattr(identities, "cut", lambda df, cut=identities.cut: written.append(1) or cut(df))
    pairs = spark.createDataFrame([(1, 2, 1, 0, 1, 1), (3, 4, -1, 0, 1, 1)], identities._PAIRS)
    moves, n = identities._merges(pairs)
    assert ([tuple(r) for r in moves.collect()], n) == ([(2, 1)], 1)
    moves, n = identities._merges(spark.createDataFrame([(1, 2, 1, 0, 1, 2), (2, 3, 1, 1, 2, 4)], identities._PAIRS))  # none is wider
    assert ([tuple(r) for r in moves.collect()], n) == ([(2, 1)], 1)
    assert len(written) == 2


def test_pairs_of_ids_in_several_groups(spark):
    links = spark.createDataFrame([("a", 1), ("b", 1), ("a", 2), ("b", 2), ("c", 2), ("d", 3)], "entity_id string, root bigint")
    assert sorted(map(tuple, identities.pairs_of(links).collect())) == [("a", "b"), ("a", "c"), ("b", "c")]


def test_estimates_do_not_grow_with_rounds(spark):
    df = spark.createDataFrame([(1,), (2,)], "a bigint")
    digits = lambda d: len(str(d._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    first = None
    for _ in range(4):
        df = identities.settled(df.alias("l").join(df.alias("r"), "a").select("a"))
        first = first or digits(df)
    assert digits(df) == first and sorted(r["a"] for r in df.collect()) == [1, 2]
