import pytest
from pyspark.sql import functions as F

from averis.functions import text as T
from averis.functions import udfs as U
from averis.operators import corpus as C
from averis.operators import features as FE
from averis.operators import vectorize as V


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "t string").select(f("t").alias("x")).collect()[0].x


@pytest.mark.parametrize(("f", "given", "want"), [
    (T.tidy_punct, " a , b  .c ", "a, b.c"), (T.normalize_text, "hallo...welt.gut", "Hallo welt. gut"), (T.strip_foreign, "a漢b ж c", "a b c"),
    (T.strip_fillers, "ähm, ja ähm so hm", "Ja so"), (T.drop_repeated_sentences, "Ja. ja. Nein.", "Ja. Nein."), (T.normal_form, "Ähm, JA!", "ähm ja"), (T.tidy_punct, "", ""), (T.normalize_text, None, None),
])
def test_cleaning(spark, f, given, want):
    assert one(spark, f, given) == want


@pytest.mark.parametrize(("n", "want"), [(5, "ja"), (6, "ja ja"), (10, "ja ja ja ja"), (4, "ja ja ja ja")])
def test_collapse_golden(n, want):
    assert U.collapse_runs(" ".join(["ja"] * n)) == want


def test_similarity_and_trim_golden():
    assert U.similarity("hallo und herzlich willkommen", "hallo und willkommen") == pytest.approx(0.816327, abs=1e-6)
    a = "A b. C d. Eins zwei. X y."
    b = "A b. C d. Drei vier. X y."
    assert U.trimmed(a, b)[2:] == (1, 0)


def test_excerpt_grows_forward_first():
    text = " ".join(f"S{i}." for i in range(9))
    assert U.excerpt(text, 6) == "S4. S5." or U.excerpt(text, 6).startswith("S4.")
    assert U.excerpt("kurz", 100) == "kurz"


def test_decode():
    assert U.decoded("ä".encode()) == "ä" and U.decoded("ä".encode("cp1252")) == "ä"


def test_redact(spark):
    df = spark.createDataFrame([("Ich bin Anna Berg vom Kanal Holz.", "Kanal Holz (Werk)"), (None, "x")], "t string, n string")
    got = [r.x for r in df.select(T.anonymize("t", "n").alias("x")).collect()]
    assert got == ["Ich bin [NAME] vom [KANAL].", None]


def test_grams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), ([],), (["a"],)], "t array<string>")
    assert [r.x for r in df.select(V.array_grams(F.col("t"), 1, 2).alias("x")).collect()] == [["a", "b", "c", "a b", "b c"], [], ["a"]]
    assert one(spark, lambda c: V.char_wb(F.col(c), 3, 3), "ab c") == [" ab", "ab ", " c "]


def test_combinations(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 1.0])], "a array<double>, b array<double>")
    get = lambda how: df.select(V.combine(F.col("a"), F.col("b"), how).alias("x")).collect()[0].x
    assert get("diffabs") == [2.0, 1.0] and get("featsdiffprod") == [1.0, 2.0, 3.0, 1.0, -2.0, 1.0, 3.0, 2.0]
    with pytest.raises(ValueError):
        V.combine(F.col("a"), F.col("b"), "nope")


def test_capital_ratio_golden(spark):
    tok = FE.token_table(spark.createDataFrame([(1, "Das Haus Garten")], "doc_id int, text string"))
    assert FE.word_properties(tok).collect()[0].capital_ratio == pytest.approx(1 / 3, abs=1e-6)


def test_splits_and_rings(spark):
    rows = [(i, f"a{i // 2}", "t") for i in range(20)] + [(99, "solo", "t")]
    docs = spark.createDataFrame(rows, "doc_id int, author string, topic string")
    cases = C.build_cases(docs).collect()
    side = {}
    for c in cases:
        for a in (c.known_author, c.unknown_author):
            assert side.setdefault(a, c.split) == c.split
    assert sum(c.label for c in cases) == 10 and sum(1 - c.label for c in cases) == 10
    assert sorted(c.known_author for c in cases if not c.label) == sorted(c.unknown_author for c in cases if not c.label)
    assert sum(1 for c in cases if c.label and c.split == "train") == 4
    folds = C.kfold(C.two_documents(docs), 3).groupBy("fold").count().orderBy("fold").collect()
    assert [r["count"] for r in folds] == [4, 3, 3]


def test_collapse_by_hand():
    from averis.functions.udfs import collapse_runs

    ja = lambda k: " ".join(["ja"] * k)
    assert [collapse_runs(ja(k)) for k in (5, 6, 10, 4)] == ["ja", "ja ja", "ja ja ja ja", ja(4)]
    assert collapse_runs("a b a b a b c") == "a b c" and collapse_runs("a b a b c") == "a b a b c"
    assert collapse_runs("") == "" and collapse_runs("x") == "x"
    assert collapse_runs("x " * 3 + "a b c " * 4 + "a b") == "x x x a b c a b"


def test_excerpt_by_hand():
    from averis.functions.udfs import excerpt

    t = "Aa. Bb. Cc. Dd. Ee. Ff. Gg."
    assert excerpt(t, 3) == "Dd." and excerpt(t, 4) == "Dd. Ee." and excerpt(t, 8) == "Cc. Dd. Ee." and excerpt(t, 100) == t
    assert excerpt("x" * 50, 5) == "x" * 50 and excerpt("A. " + "b" * 90 + ". C.", 10) == "b" * 90 + "."
