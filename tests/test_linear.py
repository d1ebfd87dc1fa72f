import hashlib

import numpy as np
import pytest

from averis.operators import linear as L

CASES = "case_id bigint, masking string, topic string, split string, known_author string, unknown_author string, known string, unknown string, y_true int"


def rows():
    out = []
    for i in range(24):
        topic, same = ("math", "diy")[i % 2], i % 4 < 2
        a = f"Die Reihe {i} ist gut. Und so ist das: wir sehen {'alles, ' * (1 + i % 3)}ja."
        b = a.replace("Reihe", "Folge") if same else f"Nun! Wer {i} will; der kann -- vielleicht -- nicht?"
        out.append((i, "original", topic, "train" if i < 16 else "test", f"s{i % 5}", f"s{i % 5}" if same else f"t{i % 3}", a, b, int(same)))
    return [*out, (90, "original", "math", "test", "s1", "s2", None, "x", 0), (91, "original", "neu", "test", "s1", "s2", "Ein Text.", "Noch ein Text.", 0)]


@pytest.mark.parametrize("name", ["stylospeaker", "fevec", "dv"])
def test_methods_end_to_end(spark, name):
    df = spark.createDataFrame(rows(), CASES)
    got = {r.case_id: r.score for r in L.SCORERS[name](df, 1).collect()}
    assert len(got) == len(rows()) and got[90] is None and got[91] == pytest.approx(0.5)
    if name != "dv":
        assert all((got[r[0]] >= 0.5) == bool(r[8]) for r in rows()[:24])


def test_one_fit_is_a_fit_of_each_corpus(spark):
    """Against Newton steps in numpy on each corpus alone, its constant being a column of CONSTANT."""
    rng = np.random.default_rng(3)
    pairs, entries, want = [], [], {}
    for c in ("a", "b"):
        x = rng.normal(size=(30, 2)) + (c == "b")
        y = (x[:, 0] + rng.normal(size=30) > 0.5).astype(float)
        for i in range(30):
            pairs.append((c, ord(c) * 100 + i, True, float(y[i])))
            entries += [(c, ord(c) * 100 + i, f"f{j}", float(x[i, j])) for j in range(2)]
        xx, w = np.column_stack([x, np.full(30, L.CONSTANT)]), np.zeros(3)
        for _ in range(50):
            p = 1 / (1 + np.exp(-xx @ w))
            w -= np.linalg.solve(xx.T @ (xx * (p * (1 - p))[:, None]) + np.eye(3), xx.T @ (p - y) + w)
        want |= {ord(c) * 100 + i: v for i, v in enumerate(1 / (1 + np.exp(-xx @ w)))}
    df = spark.createDataFrame(pairs, "corpus string, pair_id bigint, train boolean, label double")
    v = L.vectors(df, spark.createDataFrame(entries, "corpus string, pair_id bigint, feature string, value double"))
    got = {r.pair_id: r.score for r in L.scored(L.fit(v, max_iter=500), v).collect()}
    assert all(got[k] == pytest.approx(want[k], abs=2e-3) for k in want)


def test_differences_by_hand(spark):
    pairs = spark.createDataFrame([("c", 1, "x", "y", True), ("c", 2, "x", "x", True)], "corpus string, pair_id bigint, a string, b string, train boolean")
    x = spark.createDataFrame([("c", "x", "f", 3.0), ("c", "y", "f", 1.0), ("c", "y", "g", 2.0)], "corpus string, doc_id string, feature string, value double")
    assert {(r.pair_id, r.feature, r.value) for r in L.differences(pairs, x).collect()} == {(1, "f", 2.0), (1, "g", 2.0)}
    docs = spark.createDataFrame([("c", "x", True), ("c", "y", True)], "corpus string, doc_id string, train boolean")
    assert {(r.doc_id, r.feature): round(r.value, 9) for r in L.scaled(x, docs).collect()} == {("x", "f"): 3.0, ("y", "f"): 1.0, ("y", "g"): 2.0}


def test_a_text_of_two_authors_is_a_document_of_each(spark):
    """The text "w" is of s1 and s2: two pairs of one author, and as many of two; a corpus of one author has none."""
    cases = [(1, "original", "math", "train", "s1", "s2", "w", "w", 0), (2, "original", "math", "train", "s1", "s2", "x", "y", 0), (3, "original", "math", "test", "s1", "s3", "x", "z", 0)]
    cases += [(4, "original", "diy", "train", "s1", "s1", "x", "y", 1), (5, "original", "math", "train", "s1", None, "x", None, 0)]
    e = L.authored(spark.createDataFrame(cases, CASES))
    assert sorted((r.corpus, r.author) for r in e.collect()) == [("original|diy", "s1")] * 2 + [("original|math", "s1")] * 2 + [("original|math", "s2")] * 2
    got = L.own_pairs(e).collect()
    key = {t: "original|math|" + hashlib.md5(t.encode()).hexdigest() for t in "wxy"}
    assert sorted(r.label for r in got) == [0.0, 0.0, 1.0, 1.0] and {r.corpus for r in got} == {"original|math"}
    assert {frozenset((r.a, r.b)) for r in got if r.label} == {frozenset((key["w"], key["x"])), frozenset((key["w"], key["y"]))}
