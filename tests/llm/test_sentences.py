import random

from loomspar.llm import sentences


def corpus():
    rng = random.Random(1)
    name = lambda: "".join(rng.choice("bdgklmnr") + rng.choice("aeiou") for _ in range(3)).title()
    forms = [
        lambda: f"Mr. {name()} came late.", lambda: f"The meeting with Dr. {name()} was long.", lambda: f"See Fig. {rng.randint(1, 30)} and the pump, the valve, etc.", lambda: f"Prof. {name()} opened at 7 a.m. and left.",
        lambda: "The report was short.", lambda: "Who knew?", lambda: f"{name()} wrote nothing.", lambda: "The value came to approx. 3.5 units.",
    ]
    return [" ".join(rng.choice(forms)() for _ in range(12)) for _ in range(120)]


def split(spark, texts):
    rows = spark.createDataFrame([(n, t, "x") for n, t in enumerate(corpus() + texts)], "id bigint, text string, sent_start string")  # clashing name
    out = {}
    for n, a, b in sentences.sentences(rows).collect():
        out.setdefault(n, []).append((a, b))
    base = len(corpus())
    return [[t[a:b] for a, b in sorted(out.get(base + n, []))] if t is not None else [] for n, t in enumerate(texts)]


CASES = [
    ("Mr. Smith saw Fig. 3 there. The report was short.", ["Mr. Smith saw Fig. 3 there.", "The report was short."]),
    ("He has a pump, a valve, etc. The report was long.", ["He has a pump, a valve, etc.", "The report was long."]),
    ('The report said "Check it. Then go." and nothing else. Who knew?', ['The report said "Check it. Then go." and nothing else.', "Who knew?"]),
    ("“Is it final?” asked Bob. Yes.", ["“Is it final?” asked Bob.", "Yes."]),
    ("``` One line\nwraps here. 3.5 units! ```", ["One line\nwraps here.", "3.5 units!"]),
    ("1.2 Scope\n\nThe text. It ends", ["1.2 Scope", "The text.", "It ends"]),
    ("- first item\n- second. item", ["first item", "second. item"]),
    ("谁能想到呢？林西说：“先看血压。再看疫苗。”然后就离开了。完", ["谁能想到呢？", "林西说：“先看血压。再看疫苗。”然后就离开了。", "完"]),
    ("ที่เมืองฝนตก 27 วัน ทำไมโค้ชจึงสำคัญ", ["ที่เมืองฝนตก 27 วัน", "ทำไมโค้ชจึงสำคัญ"]),
    ("पहले तबला। फिर सितार।", ["पहले तबला।", "फिर सितार।"]),
    ("It went silent... then it stopped.By noon it was over…", ["It went silent... then it stopped.", "By noon it was over…"]),
    ("", []), (None, []), ("``` ```", []), ("...", []),
]


def test_cases(spark):
    got = split(spark, [t for t, _ in CASES])
    assert [(t, g) for (t, _), g in zip(CASES, got, strict=True)] == CASES


def test_empty_table_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "id bigint, text string")
    assert sentences.sentences(empty).count() == 0
    twice = spark.createDataFrame([(1, "One. Two."), (1, "One. Two.")], "id bigint, text string")
    assert sentences.sentences(twice).count() == 2


def test_very_long_texts():
    model = sentences.Model()
    assert sentences.spans("word " * 200_000, model) == [(0, 999_999)]
    assert len(sentences.spans("(" * 20_000 + 'a "b. C. ' * 20_000, model)) >= 1
    assert len(sentences.spans("Yes! " * 100_000, model)) == 100_000


def test_spans_cover_text():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice('ab AB.!?"“”()«»\n。「」1 …กข') for _ in range(rng.randint(0, 60)))
        at = 0
        for a, b in sentences.spans(text, sentences.Model()):
            assert at <= a < b <= len(text) and not text[a:b][0].isspace() and not text[a:b][-1].isspace()
            assert not any(c.isalnum() for c in text[at:a])
            at = b
        assert not any(c.isalnum() for c in text[at:])


def test_many_open_quotations():
    # a closing mark is matched however many other marks are open, and brackets in it don't end sentences
    text = "He said: “" + "( " * 60 + "One. Two.” and left. Yes."
    assert [text[a:b] for a, b in sentences.spans(text, sentences.Model())][-1] == "Yes."
    assert len(sentences.spans(text, sentences.Model())) == 2


def test_long_abbreviations_and_blanks():
    long = "a" * 50
    model = sentences.Model({"und": sentences.Language({long: (False, False), "b": (True, False)})})
    spans = lambda t: [t[a:b] for a, b in sentences.spans(t, model)]
    assert spans(f"The {long}. Thing went. On") == [f"The {long}. Thing went.", "On"]
    assert spans(f"The x{long}. Thing went. On") == [f"The x{long}.", "Thing went.", "On"]
    quoted = "“Is it?" + " " * 40 + "” Yes."
    assert spans(quoted) == [quoted[:-5], "Yes."]
    assert len(sentences.spans("a." * 200_000 + " B", model)) >= 1


def test_languages_are_learned(spark):
    rows = [(n, t, lang) for n, (t, lang) in enumerate([("the cat and the dog in the house", "en"), ("der Hund und die Katze in dem Haus", "DE-de"), ("в доме и на улице", "ru"), ("и на улице", None)] * 30)]
    model = sentences.learn_words(spark.createDataFrame(rows, "id bigint, text string, lang string"), "text", "lang")
    assert [model.local([t])[0] for t in ("The house and dog", "Das Haus und der Weg", "на доме", "xyz")] == [{"latin": "en"}, {"latin": "de"}, {"cyrillic": "ru"}, {}]
    assert model.local(["The house", "xyz"]) == [{"latin": "en"}] * 2
    assert model.of_token("Дом", {"latin": "en"}) == "ru" and model.of_token("Haus", {"latin": "de"}) == "de" and model.of_token("Haus", {}) == "und" and model.of_token("家", {"latin": "de"}) == "cjk"
