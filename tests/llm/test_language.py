"""Language identification: held-out accuracy, profiles and distances against brute force, awkward rows."""
from brute import language_profiles

from sessionloom.llm import language
from sessionloom.llm.queries import QUERIES


def test_held_out_accuracy(session, larger_docs):
    got = QUERIES["op12_language_id"](session, "/root/testdata/sf0.01").join(larger_docs.select("doc_id", "lang"), "doc_id").toPandas()
    test = got[got.held_out]
    assert len(got) == larger_docs.count() and len(test) > 200 and got.score.between(0, 1).all()
    assert (test.lang_pred == test.lang).mean() > 0.99


def test_profiles_and_distances(small_docs):
    train = small_docs.where(~language.held_out())
    want = language_profiles([(r["lang"], r["text"]) for r in train.collect()])
    got = {}
    for lang, gram, rank in language.profiles(train).collect():
        got.setdefault(lang, {})[gram] = rank
    assert got == want
    model = language.Model([(lang, g, r) for lang, p in want.items() for g, r in p.items()])
    for text in [r["text"] for r in small_docs.limit(40).collect()] + ["one", "the THE the of"]:
        mine = language_profiles([("x", text)])["x"]
        counts = language_profiles([("x", text)], size=10**9)["x"]
        distances, most = model.distances(text)
        assert most == 400 * len(mine)
        if len(counts) <= 2:  # only without ties are ranks the same in both
            continue
        # The order among equal counts is by hash, so hold the distance against ranks in that order.
        tally = {}
        for w in language.letter_words(text):
            for g in language.grams(w):
                tally[g] = tally.get(g, 0) + 1
        ordered = sorted(tally, key=lambda g: (-tally[g], language._number(g)))[:400]
        for lang, d in zip(model.languages, distances):
            assert d == sum(abs(k - want[lang][g]) if g in want[lang] else 400 for k, g in enumerate(ordered))


def test_n_grams_of_any_word(session):
    words = ["a", "ab", "straße", "日本語", "𝒳𝒴z", "x" * 50_000]
    rows = session.createDataFrame([(w,) for w in words], "word string")
    for r in rows.select("word", language._grams_column("word", 5).alias("g")).collect():
        assert sorted(r["g"]) == sorted(language.grams(r["word"]))


def test_numbers_of_a_text():
    for text in ("", "a", "The cat, the 2nd cat_flap.", "straße 日本語 𝒳𝒴z", "x" * 300):
        want = [language._number(g) for w in language.letter_words(text) for g in language.grams(w)]
        assert sorted(language.gram_numbers(text).tolist()) == sorted(want)


def test_short_rules(session):
    rows = [("en", "the cat and the dog"), ("de", "der Hund und die Katze"), (None, "nothing"), ("de", None)]
    model = language.fit(session.createDataFrame(rows, "lang string, text string"))
    assert model.languages == ["de", "en"]
    assert model.predict("THE DOG")[0] == "en" and model.predict("die Hunde")[0] == "de"
    assert model.predict("") == model.predict("123 _ 4!") == ("und", 0.0)
    assert model.predict("日本語") == ("de", 0.0)
    one = language.fit(session.createDataFrame(rows[:1], "lang string, text string"))
    assert one.predict("the")[0] == "en" and 0 < one.predict("the")[1] <= 1 and one.predict("zzz") == ("en", 0.0)


def test_awkward_rows(table, awkward):
    docs = table([*awkward, (30, "42 + 17"), (31, "z" * 5000)]).selectExpr("*", "9 as lang_pred", "'n' as `text_to_read`", "1 as gram", "1 as word")
    model = language.fit(docs.where(~language.held_out()))
    out = language.predict(docs, model)
    assert out.count() == docs.count() and set(docs.columns) <= set(out.columns)
    for r in out.collect():
        bare = r["text"] is None or not any(map(str.isalpha, r["text"]))
        assert 0 <= r["score"] <= 1 and (r["lang_pred"] == "und") == bare and (r["lang_pred"] in ("en", "und"))
    nothing = language.fit(table([]))
    assert language.predict(table([]), nothing).count() == 0 and {r["lang_pred"] for r in language.predict(docs, nothing).collect()} == {"und"}
