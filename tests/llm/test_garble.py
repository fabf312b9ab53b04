import pytest

from vellumine.llm.garble import _LETTERS, _MARKS, BYTES_READ_AS, _bytes_of, _suspect, garbled_texts, label, restored_text, words_after_dashes

SOUND = {
    "fr": "L'été dernier, la bibliothèque a prêté « trois lettres » à un élève, et l'hôtel était fermé après la fête.",
    "de": "Die Bücherei prüft „einige Fußnoten“ über die größere Fläche – und die Lösung wäre schön.",
    "es": "¿Por qué el índice todavía no encontró la canción? El niño preguntó mañana también.",
    "pt": "A publicação não está à venda; o coração da cidade já esqueceu a edição, e ninguém vê.",
    "en": "“It’s noisy,” wrote the editor — and that’s why we didn’t stop… the reader’s question.",
    "ja": "検索の画面は抜けていた章をようやく公開したらしい。図書室も読者の質問を借りてきた。",
}
DECOYS = [
    "Wer `Ã¼` statt ü sieht, fragt Ada.",
    "The sequence “Ã©” shows up wherever Ada forgot the charset.",
    "The old terminal prints � in its font sample, says Ada.",
    "NÃO É ASSIM, DIZ A SÃO BENTO.",
    "├── src\n│   └── a.md\n└── README",
    "√60 ≈ 8.649, Θ = 7°, ±5 µm",
    "Привет из Мирнска, всё работает.",
    "Ada ¶ §6 · ¿qué? ¡vale! €6 £8 ½ x² №4 100 °C",
    "a\xa0b\xa0c co\xadop 🗃️ ✨ → ok",
    "« CAFÉ », À LA CARTE, ŒUVRE D'ÂGE",
    *SOUND.values(),
]


@pytest.mark.parametrize("text", DECOYS)
def test_sound_text_and_specimens_are_left_alone(text):
    assert label(text) == []


def misread(text, written, *read):
    for codec in read:
        raw = text.encode(written)
        text = "".join(bytes([b]).decode(codec, "ignore") or chr(b) for b in raw) if codec not in ("cp932",) else raw.decode(codec, "replace")
    return text


CASES = [(lang, "utf-8", read) for lang in ("fr", "de", "es", "pt", "en") for read in (("latin-1",), ("cp1252",), ("cp1252", "cp1252"), ("mac_roman",), ("cp437",), ("cp850",), ("cp1251",))]
CASES += [("ja", "utf-8", ("latin-1",)), ("ja", "utf-8", ("cp1252",)), ("ja", "cp932", ("latin-1",)), ("ja", "euc_jp", ("latin-1",))]
CASES += [(lang, "cp1252", (read,)) for lang in ("fr", "de", "es", "pt") for read in ("mac_roman", "cp437", "cp850")]


@pytest.mark.parametrize("lang,written,read", CASES)
def test_a_garbled_passage_is_found_and_restored(lang, written, read):
    whole = f"A sound line before.\n\n{misread(SOUND[lang], written, *read)}\n\nAnother sound line."
    spans = label(whole)
    assert spans
    if written == "utf-8" or lang == "ja":
        assert all(s.restored is not None for s in spans)
        assert restored_text(whole, spans) == f"A sound line before.\n\n{SOUND[lang]}\n\nAnother sound line."


@pytest.mark.parametrize("lang", ["fr", "de", "es", "pt", "en"])
def test_lost_bytes_are_found(lang):
    text = SOUND[lang].replace("—", "-").encode("cp1252").decode("utf-8", "replace")
    assert label(text) and all(s.restored is None for s in label(text))


def test_operator_rows(spark):
    good = misread(SOUND["fr"], "utf-8", "cp1252")
    rows = [(1, good), (2, "plain"), (3, None), (4, ""), (5, "x " * 100_000 + good), (1, good), (None, good), (7, DECOYS[0])]
    out = garbled_texts(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "text as restored"))
    got = out.collect()
    assert sorted((x.doc_id for x in got), key=str) == [1, 1, 5, None]
    assert all(x.whole and SOUND["fr"] in x.restored for x in got)
    assert garbled_texts(spark.createDataFrame(rows, "doc_id long, text string").limit(0)).count() == 0


def test_the_filter_passes_every_unit_that_is_found():
    found = set()
    for written, read in BYTES_READ_AS:
        shown = {b: c for c, b in _bytes_of(read).items()}
        for c in _LETTERS | _MARKS:
            try:
                x = shown[c.encode(written)]
            except (UnicodeEncodeError, KeyError):
                continue
            for before in ("ab", "AB", "é", "É", "ø", "º", " ", ""):
                for after in ("cd", "CD", "é", "É", "ø", " ", ""):
                    text = f"One {before}{x}{after} two"
                    if label(text):
                        assert _suspect(text), (written, read, c, text)
                        found.add(x)
    assert {"³", "·", "™", "°", "€"} <= found


@pytest.mark.parametrize("text,read", [("é à ü ô " * 8, "cp932"), ("日本語検索画面", "euc"), ("検索画面図書室", "sjis")])
def test_the_filter_passes_garbling_without_kana(text, read):
    text = text.encode("utf-8").decode(read) if read == "cp932" else text.encode("euc_jp").decode("cp1252") if read == "euc" else "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in text.encode("cp932"))
    assert label(text) and _suspect(text)


def test_word_endings_are_no_japanese():
    text = "A publicação traduziu a segunda edição. Esta publicação verifica a segunda edição. MAÇÃ, maçã"
    assert label(text) == []


def test_operator_finds_a_single_mark(spark):
    rows = [(1, "Er liest, wer die B³cherei leitet."), (2, "L'aire de 30 m² et de 20 °C."), (3, "The h™tel is closed.")]
    got = {x.doc_id: x.restored for x in garbled_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == "Er liest, wer die Bücherei leitet." and set(got) == {1, 3}


LINES = [
    "The price is 5 â‚¬ instead of 6 today",
    "Nimm 5 â‚¬ statt 6 mit",
    "La police dit 5 â‚¬ par jour",
    "The main character paid 5 â‚¬ for it",
]


@pytest.mark.parametrize("text", LINES)
def test_no_word_of_a_line_hides_a_unit(text):
    assert "€" in restored_text(text, label(text)) and _suspect(text)


LATIN = [
    ("Die Straße über München führt nach Köln und Düsseldorf", "gbk"),
    ("Die Straße über München führt nach Köln", "cp932"),
    ("Le café est fermé, déjà vu à Paris", "gbk"),
    ("Le café est fermé, déjà vu à Paris où l’été était très chaud", "gbk"),
    ("The café is closed", "gbk"),
]


@pytest.mark.parametrize("sound,read", LATIN)
def test_latin_text_read_as_two_byte_characters(sound, read):
    text = sound.encode("utf-8").decode(read, "replace")
    assert _suspect(text) and label(text)
    if "�" not in text:
        assert restored_text(text, label(text)) == sound


@pytest.mark.parametrize("text", ["Python没有 x, 么Go, Rust製のIT业 A股 T恤 Q版 B楼", "Wi-Fiの設定をＡＢＣで、ﾃｽﾄ中 test ｱ", "Le calendrier partagé\xa0», écrit-il, «\xa0été\xa0»", "dos ó tres, el señor", "París is a song; País too"])
def test_mixed_scripts_are_sound(text):
    assert label(text) == []


MARKED = [
    ("# Ostara – the script\n\nOur newsletter — and more", "mac_roman"),
    ("“Our little newsletter,” wrote Ada", "mac_roman"),
    ("“The script,” wrote Ada", "cp437"),
    ("‘De redacteur gebruikt de versie’, schreef Ada", "cp437"),
    ("«L'indice chiede ogni pagina cancellata», scrisse Ada", "cp437"),
    ("It was the draft — because nobody else would", "cp850"),
    ("I don’t know", "mac_roman"),
]


@pytest.mark.parametrize("sound,read", MARKED)
def test_marks_read_as_letters(sound, read):
    text = sound.encode("cp1252").decode(read)
    assert _suspect(text) and restored_text(text, label(text)) == sound


def test_a_lone_replacement_character_counts_by_the_word_after_it(spark):
    sound = [(i, f"The town keeps every old page of its long story in a quiet room and the notice {w} – because nobody {w} it.") for i, w in enumerate(("opened", "closed", "read", "saw") * 5)]
    rows = [*sound, (100, "The gate was shut � because nobody came."), (101, "The old printer shows � in its sample."), (102, "one � two � three")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id for x in garbled_texts(df).collect()} == {100}
    assert label("one � two � three") and not label("one � two")
    assert words_after_dashes(df.limit(0)) == {}
    assert words_after_dashes(df)["because"] > 2


def test_words_after_dashes_are_counted_in_all_texts(spark):
    """60,000 texts, each with a word of its own after a dash and asked for after a replacement character."""
    word = "translate(cast(id + 100000 as string), '0123456789', 'abcdefghij')"
    df = spark.range(60_000).selectExpr(f"concat('so – w', {word}, ' and � W', {word}) as text")
    got = words_after_dashes(df)
    assert len(got) == 60_000 and min(got.values()) > 0.5
    none = spark.createDataFrame([("a – b � zzz and � c1 zzz zzz",)], "text string")
    assert words_after_dashes(none)["zzz"] == -4.0 and set(words_after_dashes(none)) == {"zzz", "c"}
