import unicodedata

import pytest
from pyspark.sql import functions as F

from averis.llm import leakage as L
from averis.llm import lookalike as K

SPELLER = K.Speller({"рейки": 5, "сегодня": 4, "столы": 3, "Σήμερα": 3})
ALIKE = [("Das Haus", "Dаs Ηаus"), ("grün", unicodedata.normalize("NFD", "grün")), ("firm fine", "ﬁrm ﬁne"), ("Wer mag", "Ｗｅｒ ｍａｇ"), ("heute", "h​e­u⁠te"), ("рейки", "рeйки"), ("Flächen", "Flӓchen"), ("で", "で"), ("είναι", "είvαι"), ("a b", "a　　b"), ("x.", "x．"), ("столы", "cтoлы")]
DIFFERENT = [("Kräuter", "Krauter"), ("gut.", "gut!"), ("4", "7"), ("so", "So"), ("a\nb", "a b"), ("Haus", "Maus"), ("²", "2"), ("ss", "ß"), ("l", "1")]


@pytest.mark.parametrize(("a", "b"), ALIKE)
def test_alike(a, b):
    assert SPELLER.form(a) == SPELLER.form(b)


@pytest.mark.parametrize(("a", "b"), DIFFERENT)
def test_different(a, b):
    assert SPELLER.form(a) != SPELLER.form(b)


def test_vocabulary_gives_the_spelling():
    assert SPELLER.form("рeйки сeгoдня") == "рейки сегодня"
    assert SPELLER.form("Dаs") == "Das"
    assert SPELLER.form("") == "" and SPELLER.form("plain text") == "plain text"


def test_automaton_budget():
    s = K.Speller({"столы": 2, "столб": 1}, budget=1)
    assert {w for _, w in s.reach("столы")} == {"столы", "столб"}
    assert s.spell("стoлы") == "столы"


def test_form_is_idempotent():
    for pair in ALIKE:
        for t in pair:
            assert SPELLER.form(SPELLER.form(t)) == SPELLER.form(t)


def test_pairs_frame(spark):
    rows = [(1, "Das Haus", "x"), (2, "Dаs Haus", "x"), (3, "Das Haus", None), (4, "Das Maus", None), (5, None, None), (6, "", None), (7, "", None), (8, "Das Haus", "f")]
    df = spark.createDataFrame(rows, "id bigint, text string, f string")
    sp = K.fit_speller(df, "text")
    got = {(r.doc_lo, r.doc_hi) for r in K.alike_pairs(df, "id", "text", sp).collect()}
    assert got == {(1, 2), (2, 3), (1, 8), (2, 8), (3, 8)}
    assert K.alike_pairs(df.limit(0), "id", "text", sp).count() == 0
    assert K.with_form(df, "text", "form", sp).columns == ["id", "text", "f", "form"]


WORDS = "eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn".split()


def test_leaks(spark):
    item = " ".join(WORDS)
    docs = [(1, "Vorher. " + item.upper().replace(" ", ", ") + " nachher."), (2, " ".join(WORDS[:11])), (3, "x " + item.replace("e", "е") + " y"), (4, None), (5, ""), (6, " ".join(WORDS[1:]) + " " + " ".join(WORDS[1:])), (7, "wort " * 50_000)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(0))
    items = spark.createDataFrame([(10, item), (11, item + " extra"), (12, " ".join(WORDS[:5])), (13, None)], "item_id bigint, text string")
    found = L.leaks(df, "doc_id", "text", items, "item_id", "text").cache()
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(d, i) for d in (1, 3, 6) for i in (10, 11)}
    clean = {r.doc_id: r.text for r in L.without_spans(df, "doc_id", "text", found).collect()}
    assert clean[1] == "Vorher.  nachher." and clean[3] == "x  y" and clean[2] == docs[1][1] and clean[4] is None and clean[6].strip() == ""
    assert L.leaks(df.limit(0), "doc_id", "text", items, "item_id", "text").count() == 0
    assert L.leaks(df, "doc_id", "text", items.limit(0), "item_id", "text").count() == 0


def test_leaks_by_join_and_letter_by_letter(spark, monkeypatch):
    item = "Die " + " ".join(WORDS)
    hard = item.replace("drei", "wolle").replace("eins", "Insel")
    docs = [(1, item), (2, hard.replace("wolle", "wo\u04cf\u04c0e").replace("Insel", "\u04c0nsel")), (3, hard.replace("wolle", "woIIe"), ), (4, "kurz")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    items = spark.createDataFrame([(10, item), (11, hard)], "item_id bigint, text string")
    want = {(1, 10), (2, 11)}
    assert {(r.doc_id, r.item_id) for r in L.leaks(df, "doc_id", "text", items, "item_id", "text").collect()} == want
    monkeypatch.setattr(L, "MAX_GRAMS", 0)
    assert {(r.doc_id, r.item_id) for r in L.leaks(df, "doc_id", "text", items, "item_id", "text").collect()} == want


def test_windows_against_brute_force():
    texts = [["a", "b", "c", "d"], [], ["b", "c"], ["a", "b", "c"], ["x"]]
    h, owner, first = L.windows(texts, 3, L._Hashes())
    assert list(zip(owner, first)) == [(0, 0), (0, 1), (3, 0)] and h[0] == h[2] != h[1]
    assert all(len(x) == 0 for x in L.windows([["a"]], 3, L._Hashes()))


def test_words_and_places_agree():
    for t in ("Ein  Wort_und 12 mehr.", "h\u200beu\u0308te ｆｕｌｌ ﬁrm", "рeйки ​ \u200b- x", "はい 漢字と で"):
        assert [w for w, _, _ in L.placed(t)] == L.words(t)


def test_the_vocabulary_decides_ambiguous_letters(spark, monkeypatch):
    """The palochka is drawn like I and l: the trie tells which, the table alone could not."""
    rows = [(1, "Der Wolf kam"), (2, "Der Wo\u04c0f kam"), (3, "Eine Insel"), (4, "Eine \u04c0nsel"), (5, "столы и стулья"), (6, "cтoлы и cтулья"), (7, "wo\u04cff"), (8, "столы")]
    df = spark.createDataFrame(rows, "id bigint, text string")
    pairs = lambda sp: {(r.doc_lo, r.doc_hi) for r in K.alike_pairs(df, "id", "text", sp).collect()}
    sp = K.fit_speller(df, "text")
    assert pairs(sp) == {(1, 2), (3, 4), (5, 6)}
    off = K.Spelling(sp.table.limit(0), 0)
    assert pairs(off) == {(3, 4), (5, 6)}
    forms = {r.id: r.form for r in K.with_form(df, "text", "form", sp).collect()}
    assert forms[2] == "Der Wolf kam" and forms[6] == "столы и стулья"
    monkeypatch.setattr(K, "MAX_SPELLINGS", 0)
    assert {r.id: r.form for r in K.with_form(df, "text", "form", sp).collect()} == forms
    monkeypatch.setattr(K, "BUCKET", 2)
    assert pairs(K.fit_speller(df, "text")) == {(1, 2), (3, 4), (5, 6)}


def test_blanks_before_a_break():
    assert SPELLER.form("a  \nb") == SPELLER.form("a\n   b") == SPELLER.form("a\nb") != SPELLER.form("a b")
