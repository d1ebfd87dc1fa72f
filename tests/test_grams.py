import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from averis.functions import text as T
from averis.operators import features as FE
from averis.operators import grams as G
from averis.operators import linear as L
from averis.operators import scorers as S
from averis.operators import vectorize as V
from averis.plans import vectors as P

TEXTS = [
    "Der alte Mann hat 3 Äpfel -- und die schöne Frau... Das ist wunderbar! Ihr  geht\n\nheute % & nach Köln?", "a", "", "  ", "!!", "Ich habe das gesehen, weil ÉTÉ-Reihen x² und Ⅷ kosten: 5 € §3 _so_ [da] \"Mut\".",
    "ΣΑΣ die DIE Die gegangen tanzten liebevolle. " * 60, "😀 ja nein so ist das, am Ende gut.", "of the with that running lovely useful notoriously a the",
]


def parts(df):
    """(doc_id, sources of its text as a dict)."""
    x = df.select("doc_id", F.struct(*[f(F.col("text")).alias(n) for n, f in G.SOURCES.items()]).alias("p")).collect()
    return {r.doc_id: r.p.asDict() for r in x}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")


def test_blocks_are_the_columns(spark, docs):
    tags = F.transform(T.tokens("text"), FE.tag)
    marked = F.transform(T.tokens("text"), lambda t: F.when(FE.tag(t).isin("PUNCT", "SYM"), t).otherwise(FE.tag(t)))
    masked = F.transform(T.tokens("text"), lambda t: F.when(F.lower(t).isin(*FE.FUNCTION_WORDS), F.lower(t)).otherwise(FE.tag(t)))
    want = {
        "char": (V.char_grams(F.col("text"), 3, 6), G.characters(3, 6)), "inside": (V.char_wb(F.col("text"), 1, 3), G.inside_words(1, 3)), "tags": (tags, G.tags), "chunks": (V.array_grams(FE.chunks(tags), 1, 3), lambda d: G.grams(G.chunks(d), 1, 3)),
        "subtrees": (FE.subtrees(tags), G.subtrees), "marked": (marked, G.marked_tags), "word_tags": (F.filter(marked, lambda x: x.rlike("^[A-Z]{2,}$")), G.word_tags), "masked": (masked, G.masked),
    }
    got = docs.select("doc_id", *[c.alias(k) for k, (c, _) in want.items()]).collect()
    for d, r in zip([parts(docs)[r.doc_id] for r in got], got):
        for k, (_, make) in want.items():
            assert sorted(make(d)) == sorted(r[k]), (k, d["text"])


def test_values_are_the_tables(spark, docs):
    tok = FE.token_table(docs)
    for table, make in ((FE.richness(tok), G.richness), (FE.length_histogram(tok), G.length_histogram)):
        rows = {r.doc_id: r.asDict() for r in table.collect()}
        for k, d in parts(docs).items():
            want = {n: v for n, v in rows.get(k, {}).items() if n != "doc_id" and v}
            assert {n: v for n, v in make(d).items() if v} == pytest.approx(want, abs=2e-6), (k, d["text"])
    want = {(r.doc_id, str(r.i)): r.share for r in FE.sentence_lengths(docs).collect()}
    assert {(k, i): v for k, d in parts(docs).items() for i, v in G.sentence_lengths(d).items()} == pytest.approx(want)


def test_ngram_union_explodes_no_text(spark, docs):
    """A row of doc_id and n-gram each took longer than the texts: nothing is exploded now, and copies of a doc_id are one."""
    d = docs.where("length(text) > 20").withColumn("topic", F.lit("t"))
    made = P.ngram_blocks(d.unionByName(d.where("doc_id = 0")))
    assert "Generate" not in made._jdf.queryExecution().executedPlan().toString()
    c = V.counted(d.unionByName(d.where("doc_id = 0")), V.char_grams(F.col("text"), 3, 6))
    want = {(r.doc_id, "char:" + r.feature): r.value for r in V.tfidf(c, V.vocabulary(c, d.count() + 1, max_features=2000)).collect()}
    assert {(r.doc_id, r.feature): r.value for r in made.where("feature LIKE 'char:%'").collect()} == pytest.approx(want)


def test_likelihood_ratio_broadcasts_no_sentences(spark):
    cases = spark.createDataFrame([(1, "g", "a", "b", [["x", "y"]], [["x"]])], "case_id bigint, group string, ka string, ua string, known array<array<string>>, unknown array<array<string>>")
    pool = spark.createDataFrame([("g", a, [a, "x"]) for a in "abcde"], "group string, author string, sentence array<string>")
    got = S.lambda_g(cases, pool, references=2, order=2)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") <= 1  # the number of sentences of each group
    assert got.count() == 1


@pytest.mark.parametrize("blocks, reads", [(L.SPEAKER, ["chars", "word2", "toks"]), (L.VECTOR, ["text", "blanked", "toks", "lettered"]), (L.BINARY, ["text", "chars", "toks", "words", "lens"])])
def test_a_document_is_a_row_of_unit_blocks(spark, docs, blocks, reads):
    d = docs.select(F.lit("c").alias("corpus"), F.col("doc_id").cast("string").alias("doc_id"), "text", (F.col("doc_id") < 7).alias("train"))
    x, v, size = L.learned(d, blocks, reads)
    rows = x.collect()
    assert len(rows) == len(TEXTS) and size == {"c": 7} and len(set(zip(v.corpus, v.name))) == len(v)
    for r in rows:
        assert list(r.i) == sorted(set(r.i)) and len(r.i) == len(r.v)
        for k in (k for k, b in blocks.items() if not b.plain):
            q = sum(w * w for i, w in zip(r.i, r.v) if v.name[i].startswith(k + ":"))
            assert q == pytest.approx(1) or q == 0


def test_all_pairs_of_an_author_and_as_many_of_two(spark):
    who = {"a": 5, "b": 3, "c": 1}
    rows = [("k", f"{a}{i}", a, True) for a, n in who.items() for i in range(n)] + [("k", "test", "a", False), ("k", "none", None, True), ("alone", "x0", "x", True), ("alone", "x1", "x", True)]
    got = L._training_pairs(spark.createDataFrame(rows, "corpus string, doc_id string, author string, train boolean")).collect()
    same = {frozenset((r.a, r.b)) for r in got if r.label == 1.0 and r.corpus == "k"}
    other = {frozenset((r.a, r.b)) for r in got if r.label == 0.0}
    assert same == {frozenset(p) for a, n in who.items() for p in itertools.combinations([f"{a}{i}" for i in range(n)], 2)}
    assert len(other) == len(same) == 13 and all(len({x[0] for x in p}) == 2 for p in other) and len(got) == 27


def test_pair_numbers():
    n = np.array([4, 1, 3, 2])
    first = np.cumsum(n) - n
    of = np.repeat(np.arange(4), n)
    for make, same in ((L.same_author, True), (L.other_author, False)):
        k, i, j = make(n, first, 10**6, "k")
        want = {(p, q) for p, q in itertools.combinations(range(10), 2) if (of[p] == of[q]) == same}
        assert set(zip(i.tolist(), j.tolist())) == want and k == len(want)
        k, i, j = make(n, first, 5, "k")
        assert k == len(set(zip(i.tolist(), j.tolist())) & want) == 5
