import random

from vellumine.llm.langid import LANGUAGES, declared, identify, language_sets, mislabelled, segments, words

SUBJECTS = {
    "en": ("The editor", "The old server", "Our little library", "The choir", "A quiet reader"),
    "de": ("Die Redakteurin", "Der alte Server", "Unsere kleine Bücherei", "Der Chor", "Eine stille Leserin"),
    "es": ("La editora", "El viejo servidor", "Nuestra pequeña biblioteca", "El coro", "Una lectora callada"),
    "fr": ("La rédactrice", "Le vieux serveur", "Notre petite médiathèque", "La chorale", "Une lectrice discrète"),
    "it": ("La redattrice", "Il vecchio server", "La nostra piccola biblioteca", "Il coro", "Una lettrice silenziosa"),
    "nl": ("De redacteur", "De oude server", "Onze kleine bibliotheek", "Het koor", "Een stille lezer"),
    "pt": ("A redatora", "O velho servidor", "A nossa pequena biblioteca", "O coro", "Uma leitora discreta"),
    "ja": ("編集者は", "古い保管庫は", "小さな図書室は", "合唱団は", "静かな読者は"),
}
VERBS = {
    "en": ("has forgotten", "describes", "keeps", "wants to replace"),
    "de": ("vergisst", "beschreibt", "bewahrt", "möchte ersetzen"),
    "es": ("ya olvidó", "describe", "conserva", "quiere reemplazar"),
    "fr": ("a oublié", "décrit", "conserve", "voudrait remplacer"),
    "it": ("ha dimenticato", "descrive", "conserva", "vuole sostituire"),
    "nl": ("vergeet", "beschrijft", "bewaart", "wil vervangen"),
    "pt": ("já esqueceu", "descreve", "guarda", "quer substituir"),
    "ja": ("忘れてしまった", "説明した", "守っている", "取り替えたい"),
}
OBJECTS = {
    "en": ("the missing chapter", "the price of paper", "three unread letters"),
    "de": ("das fehlende Kapitel", "die Papierpreise", "drei ungelesene Briefe"),
    "es": ("el capítulo que faltaba", "el precio del papel", "tres cartas sin leer"),
    "fr": ("le chapitre manquant", "le prix du papier", "trois lettres non lues"),
    "it": ("il capitolo mancante", "il prezzo della carta", "tre lettere non lette"),
    "nl": ("het ontbrekende hoofdstuk", "de prijs van papier", "drie ongelezen brieven"),
    "pt": ("o capítulo que faltava", "o preço do papel", "três cartas não lidas"),
    "ja": ("抜けていた章を", "紙の値段を", "三通の手紙を"),
}


def sentence(r, lang):
    s, v, o = (r.choice(x[lang]) for x in (SUBJECTS, VERBS, OBJECTS))
    return f"{s}{o}{v}。" if lang == "ja" else f"{s} {v} {o}."


def corpus(r, n):
    rows, truth = [], {}
    for i in range(n):
        lang = r.choice(LANGUAGES)
        text = [sentence(r, lang) for _ in range(r.randrange(2, 8))]
        langs = {lang}
        if r.random() < 0.15:
            other = r.choice(LANGUAGES)
            text.insert(r.randrange(len(text)), "\n\n> " + sentence(r, other) + "\n")
            langs.add(other)
        if r.random() < 0.2 and lang != "en":
            text.append("\n" + sentence(r, lang)[:-1] + " (“the price”).")
        k = r.random()
        label = None if k < 0.1 else r.choice(LANGUAGES) if k < 0.2 else lang
        rows.append((i, f"did:web:h{i % 7}.example", "c", label, "de" if i % 50 == 0 else "example", (" " if lang != "ja" else "").join(text)))
        if label not in langs or len(langs) > 1:
            truth[i] = langs
    return rows, truth


SCHEMA = "record_id long, host string, collection string, label string, suffix string, text string"


def test_mislabelled_texts_and_mixed_languages(spark):
    rows, truth = corpus(random.Random(11), 600)
    odd = [(9001, None, None, None, None, None), (9002, None, None, "en", None, ""), (9003, None, None, None, None, "```\nfor x in y\n```\nhttps://a.example/b?c=1\n* * *\n12 Zuxu 9."), (9004, None, None, None, None, rows[0][5]), rows[1]]
    found = identify(spark.createDataFrame(rows + odd, SCHEMA).selectExpr("*", "1 as l", "2 as segs"))
    got = {}
    for x in mislabelled(found).collect():
        got.setdefault(x.record_id, set()).add(x.lang)
    assert 9001 not in got and 9002 not in got and 9003 not in got and 9004 in got
    wrong = sum(got.get(i) != truth.get(i) for i in range(600))
    assert wrong <= 12
    assert all(0.95 <= x.confidence <= 1 for x in language_sets(found).collect())


def test_no_rows_and_no_labels(spark):
    rows, _ = corpus(random.Random(12), 5)
    df = spark.createDataFrame(rows, SCHEMA)
    assert identify(df.limit(0)).count() == 0
    assert identify(df.selectExpr("record_id", "host", "collection", "cast(null as string) as label", "suffix", "text")).count() == 0


def test_segments_and_words():
    text = "# A title\r\n\nOne. Two?  “Three.” Four\n```\ncode. here\n```\n日本。語です。"
    assert [text[a:b].strip() for a, b in segments(text)] == ["# A title", "One.", "Two?", "“Three.”", "Four", "日本。", "語です。"]
    assert words("The cat's `code` 12 日本 " + "x" * 40) == ["the", "cat", "s", "日", "本"]


def test_labels(spark):
    rows = [(" EN-us", "en"), ("pt_BR", "pt"), ("xx", None), ("", None), (None, None), ("English", None), ("ja", "ja")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert all(x.c == x.b for x in df.select(declared(df.a).alias("c"), "b").collect())
