import pytest

from averis.llm import sentences as S

TRAIN = [
    "Das geht so. Wir nehmen Nägel.\nDie Bretter sind da. Das kostet ca. 8.30 Euro, d. h. fast nichts.\nSiehe Abb. 7 im Heft. Am 8. Mai war das.\nDas ist klar. Die Nägel sind alt.\n",
    "It works. We take pots.\nSee Fig. 4 in the notes. That is all.\nWe met at 10 a.m. near the mill. It works.\n",
    "Dafür braucht ihr Bretter usw.\nWir prüfen alles. Das war im Jahr 2018.\nDas sind 9,7 Mio. Euro mehr. Das passt.\nDas kommt von A. Berg und K. Ost.\n",
] * 5


@pytest.fixture(scope="module")
def splitter():
    return S.Splitter(S.train(TRAIN))


@pytest.mark.parametrize("parts", [
    ["Das geht so.", "Wir nehmen Nägel."], ["Das kostet ca. 8.30 Euro, d. h. nichts.", "Gut."], ["„Die Soßen sind weg. Das ist klar“, dachte ich.", "Ja."], ["Mein Nachbar meinte: „Das hält nie.“", "Die Kräuter sind da."],
    ["Er rief: „Halt!“ und lief weg.", "Ja."], ["(Das zeige ich noch.)", "Gut."], ["Die Kräuter (siehe Teil 8!) liegen da.", "Gut."], ["Na ja ... das dauert.", "Hm … vielleicht."], ["Wirklich?!", "Er kam."], ["Siehe Abb. 7 und Tab. 4 hier.", "Das sind 9 Mio. Euro."],
    ["Am 8. Mai kam Nr. 3 an.", "Ja."], ["Mehr unter www.a-4.example/teil.4 im Netz.", "Gut."], ["Das Holz stammt von H. Brummelsko hier.", "Ja."], ["长度是3.2厘米。", "他说：“这样不行。”", "账户够不够？"], ["「これで大丈夫です。」と先生が言いました。", "次です。"],
    ["डॉ. साहब ने देखा।", "यह 4.5 मीटर है।"], ["M. le voisin dit : « C'est trop cher. »", "On garde les vis au sec."], ["¿Están listas?", "¡Qué bien!"], ['"Does that work?" someone asked me.', "It works."], ["Все на столе!", "Это стоит 7,8 руб. за штуку."],
])
def test_sentences(splitter, parts):
    text, ends = "", []
    for p in parts:
        text += (" " if text and not any("぀" <= c <= "鿿" for c in p[:1] + text[-2:-1]) else "") + p
        ends.append(len(text))
    assert splitter.ends(text) == ends


def test_no_blank_after_the_period(splitter):
    assert splitter.ends("Das ist weit.Warum sind die da?") == [13, 31]


def test_thai_blanks_and_lines(splitter):
    t = "ราคา2.8บาท  เราต้องวัด\nลองดู"
    assert splitter.ends(t) == [10, 22, 28]
    assert splitter.ends("ohne zeichen und klein \n zweite zeile") == [22, 37]
    assert splitter.ends("") == [] and splitter.ends(" \n ") == []


def test_frame(spark):
    df = spark.createDataFrame([(1, "A b. C d.", 5), (2, None, 5), (3, "", 5), (4, "   ", 5), (1, "A b. C d.", 5), (6, "x" * 200_000, None)], "id bigint, text string, sent_end int")
    got = S.sentence_ends(df.drop("sent_end"), ["id"], "text", {"bias": 1.0}).groupBy("id", "sent_end").count().collect()
    assert {(r.id, r.sent_end): r["count"] for r in got} == {(1, 4): 2, (1, 9): 2, (6, 200_000): 1}
    assert [r.sentences for r in S.sentences(df, ["id"], "text", {"bias": 1.0}).where("id = 1").collect()] == [["A b.", "C d."]] * 2
    assert S.sentence_ends(df.limit(0), ["id"], "text", S.fit(df.limit(0), "id", "text")).count() == 0


def test_order_of_rows_is_without_effect():
    w = {"bias": -1.0, "chain": 3.0, "month": 3.0, "suffix|upper": 4.0}
    for pairs in (["Es war z. B., so.", "Es war z. Banane so."], ["Am (12). Mai kam er.", "Am (12). Mond kam er."], ["Nr 5 b. Das geht.", "Und b. Das geht."]):
        there, back = S.Splitter(w), S.Splitter(w)
        a = [there.ends(t) for t in pairs]
        assert [back.ends(t) for t in pairs[::-1]][::-1] == a == [S.Splitter(w).ends(t) for t in pairs]


def test_tags_count_where_they_stand(splitter):
    plain, tagged = "Wir nehmen die Bretter und Nägel dazu. " * 40, "N V die N. Die N sind A. Wir V N V. N V da. " * 4
    w = S.Splitter(S.train([*TRAIN, tagged * 3, plain]))
    early, late = w.ends(tagged + plain), w.ends(plain + tagged)
    assert len(early) == len(late)
    assert [e for e in early if e <= len(tagged)] == w.ends(tagged.strip())


def test_unclosed_openers_have_no_limit():
    line = "( " * 50 + "er sagte „Ja. Gut.“ dazu. Das ist es."
    a = line.index("„")
    assert S.spans(line) == [(a, line.index("“"))]
    assert S.spans('(a „b“ c) "d" [e') == [(0, 8), (10, 12)]
    assert S.spans("(" * 100_000 + "“" * 10) == []


def test_every_kind_of_mark_is_classified():
    with_ = S.Splitter(S.train([]))
    assert with_.ends("Ja! Nein? Ob das so ist! und weiter. 好。好") == [3, 9, 36, 39, 40]
    assert S.Splitter({}).ends("Ja! Nein? Gut. 好。好") == [18]


def test_long_texts_train_too(spark):
    df = spark.createDataFrame([(1, "Das geht ganz gut. Wir nehmen Nägel.\n" * 2000), (2, "ca. 8 Stück.\nJa. Ja."), (3, None), (4, "")], "id bigint, text string")
    w = S.fit(df, "id", "text")
    assert w == S.train([r.text for r in df.collect() if r.text])
    assert S.Splitter(w).ends("Das passt gut. Die Nägel auch.") == [14, 30]
