import math

import pytest

from averis.operators import scorers as S


def test_ppm_golden():
    assert [math.exp(-x) for x in S.PPM().code("aab")] == pytest.approx([1 / 256, 1 / 2, 1 / 2048])
    assert sum(S.PPM().code("abab")) == pytest.approx(13.862944)
    m = S.PPM()
    m.code("abab")
    assert sum(m.code("abab")) == pytest.approx(2.654806)
    assert -S.compression_score("abab", "abab") == pytest.approx(0.191504, abs=1e-6)
    assert -S.compression_score("abab", "cdcd") == pytest.approx(1.216096, abs=1e-6)


def _brute(text, order=5):
    """Variant d from raw substring counts over the prefix."""
    out = []
    for i, s in enumerate(text):
        p = 1.0
        for o in range(min(order, i), -1, -1):
            h = text[i - o : i]
            nxt = [text[j + o] for j in range(i - o) if text[j : j + o] == h] if o else list(text[:i])
            if not nxt:
                continue
            if s in nxt:
                p *= (2 * nxt.count(s) - 1) / (2 * len(nxt))
                break
            p *= len(set(nxt)) / (2 * len(nxt))
        else:
            p /= 256
        out.append(-math.log(p))
    return out


@pytest.mark.parametrize("text", ["abracadabra", "aaaaaa", "ab ab ab ä😀", "x"])
def test_ppm_brute_force(text):
    assert S.PPM().code(text) == pytest.approx(_brute(text))


@pytest.mark.parametrize("variant", S.VARIANTS)
@pytest.mark.parametrize("exclusion", [False, True])
def test_variants_give_probabilities(variant, exclusion):
    m = S.PPM(3, variant, exclusion)
    m.code("abracadabra abracadabra")
    assert all(x >= -1e-12 for x in m.code("abrakadabra"))


def test_contributions_sum_to_distance():
    a, b = S.compression_distances("das ist ein Text", "das war ein Text")
    assert -(sum(a) + sum(b)) / 2 == pytest.approx(S.compression_score("das ist ein Text", "das war ein Text"))
    assert S.compression_score("", "x") is None and S.compression_score(None, "x") is None


def test_kneser_ney_sums_to_one():
    m = S.KneserNey([("a", "b", "a"), ("b", "b")], order=3)
    words = ["a", "b", "</s>", "<unk>"]
    for h in [("<s>", "<s>"), ("<s>", "a"), ("a", "b"), ("z", "z")]:
        assert sum(m.prob(h, w) for w in words) == pytest.approx(1.0)


def test_calibration_matches_newton(spark):
    rows = [("g", s, y) for s, y in [(.9, 1), (.8, 1), (.3, 1), (.7, 0), (.2, 0), (.1, 0), (.15, 0), (.5, 1)]]
    r = S.calibrate(spark.createDataFrame(rows, "g string, score double, y_true int"), ["g"]).collect()[0]
    n, p = len(rows), sum(y for *_, y in rows)
    res = [(1 / (1 + math.exp(-(r.w * s + r.b))) - y) * (n / (2 * p) if y else n / (2 * (n - p))) for _, s, y in rows]
    assert sum(res) == pytest.approx(0, abs=1e-6)
    assert sum(x * s for x, (_, s, _) in zip(res, rows)) + r.w == pytest.approx(0, abs=1e-6)


def test_scores_keep_rows(spark):
    df = spark.createDataFrame([(1, "abab", "abab"), (2, None, "x"), (3, "", "x")], "id int, a string, b string")
    got = {r.id: r.s for r in df.select("id", S.coav(df.a, df.b).alias("s")).collect()}
    assert got[1] == pytest.approx(-0.191504, abs=1e-6) and got[2] is None and got[3] is None


def test_lambda_g_whole_pool(spark):
    """Known texts longer than any bounded pool keep their score; samples come from the others' sentences only."""
    say = lambda who, n: [[who, str(i % 7), str(i % 11), "."] for i in range(n)]
    cs = [(1, "t", "a", "b", say("a", 600), say("b", 5)), (2, "t", "a", "a", say("a", 600), say("a", 5)), (3, "t", "c", "d", say("c", 900), say("d", 5)), (4, "t", "a", "b", [], say("b", 5)), (5, "t", "c", "c", say("c", 1300), say("c", 5))]
    df = spark.createDataFrame(cs, "case_id bigint, group string, ka string, ua string, known array<array<string>>, unknown array<array<string>>")
    pool = [("t", w, s) for w, n in (("a", 600), ("b", 300), ("c", 900), ("d", 400)) for s in say(w, n)]
    p = spark.createDataFrame(pool, "group string, author string, sentence array<string>")
    got = {r.case_id: r.score for r in S.lambda_g(df, p, references=2, order=3).collect()}
    assert set(got) == {1, 2, 3, 4, 5} and got[4] is None
    assert got[1] is not None and got[2] > 0 and got[3] is not None  # 1,300, 1,600 and 900 sentences of others
    assert got[5] is not None  # exactly as many as needed
    every = [tuple(s) for _, w, s in pool if w != "c"]
    assert got[5] == pytest.approx(S.likelihood_ratio([tuple(s) for s in cs[4][4]], [tuple(s) for s in cs[4][5]], [every], 3))


def test_reference_numbers(spark):
    p = spark.createDataFrame([("t", w, [w, str(i % 50)]) for w, n in (("a", 90), ("b", 3), ("c", 70)) for i in range(n)], "group string, author string, sentence array<string>")
    numbered, runs = S._numbered(p, 1)
    at = {r.i: r.sentence[0] for r in numbered.collect()}
    assert sorted(at) == list(range(163)) and all(at[i] == r.author for r in runs.collect() for i in range(r.start, r.start + r.n))
    assert sorted(S.drawn(9, 9, "x")) == list(range(9)) and len(set(S.drawn(50, 20, "x"))) == 20


def test_kneser_ney_within():
    s, u = [("a", "b", "a", "c"), ("b", "b"), ("c", "a", "b")], [("a", "b", "z"), ("b", "a", "b")]
    assert S.KneserNey(s, 4, within=S.histories(u, 4)).bits(u) == pytest.approx(S.KneserNey(s, 4).bits(u))
