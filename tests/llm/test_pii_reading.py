import pytest
from pyspark.sql import functions as F

from averis.llm import pii, reading

GOOD = {
    "email": ["a.berg@mail.example", "timo.x (at) post.y (punkt) example", "j punkt berg ät post-nord punkt test", "anna dot b at mx1 dot example", "ANKE.X@MAIL.TEST"],
    "phone": ["+49 (0)40 66969-190", "0171-3920052", "(212) 555-0102", "0221/4710314", "030 23125 750", "null drei null zwei drei eins zwei fünf zwei drei"],
    "idnum": ["65 170839 K 299", "65120645K871", "L0J72L843", "987-65-4325", "68 661 596 057"],
    "address": ["Ulminweg 64a in 00565 Quendau", "Torvenstraße 74 b", "Am Mühlinteich 10, 00889 Ober Kallnitz", "Kolder-Platz 43", "53b Distel Lane, Quendau"],
    "name": ["Zoé Gnadt-Brummel", "H. Brummelsko", "Karsten-Henrik Jösk"],
}
FRAMES = {"email": "Schreibt an {} oder so.", "phone": "Tel. {}, fragt nach mir.", "idnum": "Meine Nummer ist {}, ja.", "address": "Adresse {}, gleich links.", "name": "Danke an {} für den Tipp."}
PLAIN = ["Mein Name ist hier nicht wichtig.", "Genau 932.28 Einheiten, 2083-2042, ergeben 65 941 46.", "Mehr unter www.werkbank-4.example/teil.4 im Netz.", "We met at 10 a.m. near the mill.", "Die Holzwerk & Co. KG liefert 9 Stück.", "Das steht in der Hauptstraße auf jedem Schild.", "points. At 6.30 p.m. the team left."]


@pytest.mark.parametrize(("kind", "span"), [(k, s) for k, v in GOOD.items() for s in v])
def test_candidates_take_the_whole_passage(kind, span):
    text = FRAMES[kind].format(span)
    assert (kind, span) in {(k, text[a:b]) for k, a, b, _ in pii.candidates_of(text)}


def test_em_and_masking(spark):
    rows = [(i, FRAMES[k].format(s) + " " + PLAIN[i % len(PLAIN)], "n") for i, (k, s) in enumerate((k, s) for _ in range(3) for k, v in GOOD.items() for s in v)]
    rows += [(900 + i, p, None) for i, p in enumerate(PLAIN * 6)] + [(990, None, None), (991, "", None)]
    df = spark.createDataFrame(rows, "id bigint, text string, kind string")
    spans = pii.personal_data(df, ["id"], "text").select("id", F.explode("spans").alias("s")).select("id", "s.kind", "s.pii").collect()
    want = {(i, k, s) for i, (k, s) in enumerate((k, s) for _ in range(3) for k, v in GOOD.items() for s in v)}
    assert {(r.id, r.kind, r.pii) for r in spans} == want
    out = {r.id: r.text for r in pii.masked(df, ["id"], "text").collect()}
    assert len(out) == len(rows) and out[990] is None and out[991] == ""
    for i, t, _ in rows:
        if i < 900:
            k, s = next((k, s) for j, k, s in want if j == i)
            assert out[i] == t.replace(s, f"[{k.upper()}]")


def test_names_no_list_holds_are_found_by_their_place(spark):
    """Places of names are learned from names that a list holds; nothing about the wording is given."""
    known = ["Anna", "Karsten", "Paula", "Björn", "Maren", "Jana", "Lutz", "Silke"]
    rows = [f"Gestern rief {a} {b} an und lachte." for a in known for b in ("Dremmley", "Voskenrath", "Natzano")]
    rows += ["Gestern rief Xandor Quibbel an und lachte.", "Gestern rief Yorrick Dremmley an und lachte."]
    rows += [f"Dort liegt {a} neben dem Tisch." for a in ("Altes Holz", "Neue Farbe", "Grobes Papier", "Feines Garn")] * 6
    rows += ["Dort liegt Xandor Holz neben dem Tisch."]
    df = spark.createDataFrame(list(enumerate(rows)), "id bigint, text string")
    found = {(r.id, r.pii) for r in pii.personal_data(df, ["id"], "text").select("id", F.explode("spans").alias("s")).select("id", "s.pii").collect()}
    assert found == {(i, " ".join(t.split(" ")[2:4])) for i, t in enumerate(rows) if t.startswith("Gestern")}


def test_candidates_in_other_scripts_and_short_numbers():
    spans = lambda t: {(k, t[a:b]) for k, a, b, _ in pii.candidates_of(t)}
    assert ("name", "Анна Каренина") in spans("Меня зовут Анна Каренина.") and ("name", "Μαρία Παππά") in spans("Με λένε Μαρία Παππά.")
    assert ("name", "田中") in spans("昨日、田中さんが来ました。") and not spans("先生と言いました。")
    assert ("phone", "0171-39") in spans("Ruf an: 0171-39, ja.")


def test_no_candidates(spark):
    df = spark.createDataFrame([(1, "nichts hier")], "id bigint, text string")
    assert pii.personal_data(df, ["id"], "text").count() == 0
    assert pii.masked(df, ["id"], "text").collect()[0].text == "nichts hier"


def test_levels_held_out(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/reading_labels.parquet").orderBy("sample_id").collect()
    samples = [(r.lang, r.level, r.text) for r in rows]
    right = 0
    for fold in range(5):
        m = reading.Levels([s for i, s in enumerate(samples) if i % 5 != fold])
        right += sum(m.levels[int(m.posterior(s[0], s[2]).argmax())] == s[1] for i, s in enumerate(samples) if i % 5 == fold)
    assert right / len(samples) >= 0.97


def test_levels_frame(spark):
    samples = [("de", 1, "das ist gut"), ("de", 2, "verhältnismäßigkeit gleichwohl")]
    df = spark.createDataFrame([(1, "DE ", "das gut", 7), (2, "de-AT", "gleichwohl", 7), (3, "fr", "das", 7), (4, None, "das", 7), (5, "de", None, 7), (6, "de", "", 7), (7, "de", "123 !", 7), (8, "de", "unbekannt", 7), (1, "de", "das gut", 7)], "id bigint, lang string, text string, level int")
    got = sorted((r.id, r.level) for r in reading.with_level(df, ["id"], "lang", "text", samples).collect())
    assert got == [(1, 1), (1, 1), (2, 2), (8, 1)]


def test_levels_of_every_text(spark, tmp_path):
    from averis.llm import queries as Q

    rows = [(i, m, l, "Das ist ein Text.", u) for i, (m, l, u) in enumerate([("original", "de", ""), ("posnoised", "de_AT", "Der Text N V."), ("original", "fr", "Bonjour."), ("posnoised", None, None), ("original", "de", "123")])]
    spark.createDataFrame(rows, "case_id bigint, masking string, lang string, known string, unknown string").write.parquet(f"{tmp_path}/read_corpus_sorted.parquet")
    spark.createDataFrame([(1, "de", 1, "das ist ein text"), (2, "de", 4, "der erörterte sachverhalt")], "sample_id bigint, lang string, level int, text string").write.parquet(f"{tmp_path}/reading_labels.parquet")
    got = {(r.case_id, r.side): r.level for r in Q.p7_levels(spark, str(tmp_path)).collect()}
    assert len(got) == 8 and (0, "unknown") not in got and (3, "unknown") not in got
    assert got[0, "known"] == 1 and got[1, "known"] == 1 and got[1, "unknown"] is not None
    assert got[2, "known"] is None and got[3, "known"] is None and got[4, "unknown"] is None
