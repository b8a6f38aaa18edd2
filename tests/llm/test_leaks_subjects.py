import random

from loomspar.llm import leaks, sentences, subjects

ITEM = "The score sheet near Krasild was handed by Lutuld to the Skazister board in 1947."
TEN = "score sheet near Krasild was handed by Lutuld to the"


def searched(spark, docs, items):
    d = spark.createDataFrame([(n, t, "x") for n, t in enumerate(docs)], "doc_id bigint, text string, item_id string")
    i = spark.createDataFrame(items, "item_id bigint, text string, lang string")
    return {(r["item_id"], r["doc_id"]): r for r in leaks.search(d, i).collect()}


def test_search(spark):
    docs = [
        f"Before. {ITEM} After.", f"x {TEN.upper().replace(' ', ' - ')} y", TEN[6:], None, "", ITEM.replace("sheet", "sheets").replace("board", "bord"), f"a{TEN}b", "word " * 300_000 + ITEM, ITEM, ITEM,
        "他说コミデカデロはカカロリカマでキャッシュを、ルロリデトに渡し", "Which second hedge fund did Mekoll show Vreglinox", "which second hedge fund did mekoll show",
    ]
    items = [(1, ITEM, "en"), (1, ITEM, "en"), (2, "コミデカデロはカカロリカマでキャッシュをルロリデトに渡し、その後", "ja"), (3, "Which second hedge fund did Mekoll show Vreglinox?", "en"), (4, None, "en"), (5, "...", None), (6, "ab", "en")]
    got = searched(spark, docs, items)
    complete = {k for k, r in got.items() if r["complete"]}
    assert complete == {(1, 0), (1, 1), (1, 7), (1, 8), (1, 9), (2, 10), (3, 11)}
    assert 0 < got[1, 5]["edits"] <= 4 and got[1, 0]["edits"] == 0


def altered(rng, text, edits):
    letters = list(text)
    for _ in range(edits):
        k = rng.randrange(2, len(letters) - 2)
        letters[k : k + 1] = rng.choice(([], [rng.choice("bcdfgz")], [letters[k], "x"]))
    return "".join(letters)


def test_edits_are_found_and_more_are_rejected(spark):
    # brute force over windows of ten words: found are those within the edits allowed, rejected those with many more
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randrange(5, 10))) for _ in range(400)]
    items = [(n, " ".join(rng.sample(words, 12)), "en") for n in range(40)]
    docs = ["pad word here " + altered(rng, text, n % 3) + " and an end" for n, text, _ in items]
    docs += [" ".join(w[::-1] if k % 2 else w for k, w in enumerate(text.split())) for _, text, _ in items]
    got = searched(spark, docs, items)
    assert {(n, n) for n in range(40)} <= set(got)
    assert not {(n, n + 40) for n in range(40)} & set(got)
    assert all(r["edits"] <= 2 for r in got.values()) and all(got[n, n]["edits"] <= n % 3 for n in range(40))


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    items = [(n, f"{ITEM} number {n} of the list", "en") for n in range(30)]
    docs = [t for _, t, _ in items] + [ITEM]
    one = searched(spark, docs, items)
    monkeypatch.setattr(leaks, "BLOCK_CHARS", 900)
    assert searched(spark, docs, items) == one


def test_empty_tables(spark):
    assert searched(spark, [], [(1, ITEM, "en")]) == {}
    assert searched(spark, [ITEM], []) == {}


def shares(spark, texts):
    d = spark.createDataFrame([(n, t, "x", 1) for n, t in enumerate(texts)], "doc_id bigint, text string, subject string, term int")
    return {(r["doc_id"], r["subject"]): round(r["share"], 3) for r in subjects.subject_shares(d, subjects.load_terms(), sentences.Model()).collect()}


def test_subjects(spark):
    texts = [
        "The referee saw the penalty kick. It rained. Nobody came.", "The heart valve repair went well. A pressure\nvalve leaked!", "He sat in the old court.", None, "", "裁判和教练。下雨了。", "Две эстафеты и вратарь. Дождь.",
        "The jury met. " * 5000, "The coaches left. The coaches left.", "Scoach and coachman.",
    ]
    got = shares(spark, texts)
    assert got[0, "sport"] == 0.333 and got[1, "medicine"] == 0.5 and got[1, "engineering"] == 0.5 and got[5, "sport"] == 0.5 and got[6, "sport"] == 0.5 and got[8, "sport"] == 1.0
    assert not {k for k in got if k[0] in (2, 3, 4, 9)}
    assert got[7, "law"] == 1.0
    assigned = subjects.assign(spark.createDataFrame([(1, "law", 1 / 3), (2, "law", 0.32)], "doc_id bigint, subject string, share double"))
    assert [tuple(r) for r in assigned.collect()] == [(1, "law")]


def test_no_documents(spark):
    assert shares(spark, []) == {}


def test_terms():
    terms = subjects.load_terms()
    assert len({t for t, _, _ in terms}) > 400 and {s for _, s, _ in terms} == {"science", "law", "sport", "software", "medicine", "finance", "engineering", "music"}


def test_labels_do_not_move_the_third(spark, tmp_path):
    law, other = "The jury met the judge in court!", "Nobody came!"
    texts = [f"{law} {law} {other} {other} {other}"] * 300 + [f"{law} {other} {other} {other}"] * 300  # two fifths, a quarter
    save = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    save(list(enumerate(texts)), "doc_id bigint, text string", "documents")
    save([("law", "Law", "")], "subject string, title string, scope_note string", "subjects")
    save([(n, "law", "x") for n in range(600)], "doc_id bigint, subject string, annotator string", "subject_labels")
    assert {r["doc_id"] for r in subjects.found(spark, str(tmp_path)).collect()} == set(range(300))


def test_unreliable_terms_need_company(spark):
    # "orbit" stands in many documents that are labelled otherwise, and is frequent
    texts = ["The orbit was wide. The jury met. The jury met."] * 40 + ["The orbit was wide."] * 3 + ["The orbit of the comet tail was wide."]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    terms = [("orbit", "science", 1.0), ("comet tail", "science", 1.0), ("jury", "law", 1.0), ("orbit", "law", 0.2)]
    labels = spark.createDataFrame([(n, " LAW") for n in range(40)] + [(None, "law"), (1, None)], "doc_id bigint, subject string")
    plain = {(r["doc_id"], r["subject"]) for r in subjects.subject_shares(d, terms, sentences.Model()).collect()}
    learned = {(r["doc_id"], r["subject"]) for r in subjects.subject_shares(d, terms, sentences.Model(), labels).collect()}
    assert (40, "science") in plain and (40, "science") not in learned and (43, "science") in learned and (0, "law") in learned
