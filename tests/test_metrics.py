import math
import random

import pytest
from pyspark.sql import functions as F

from averis.operators import metrics as M
from averis.operators import resampling as B


def scores(spark, rows):
    return spark.createDataFrame([("g", float(s), int(y)) for s, y in rows], "g string, score double, y_true int")


@pytest.mark.parametrize(("rows", "want"), [
    (zip([.9, .8, .4, .3], [1, 0, 1, 0]), 0.8), (zip([.9, .8, .7, .6, .5, .4], [1, 1, 0, 1, 0, 0]), 0.7), (zip([.9, .1], [1, 0]), 0.9), (zip([5, 4, 3, 2, 1], [1, 0, 1, 1, 0]), 4.0),
])
def test_eer_golden(spark, rows, want):
    assert M.eer_threshold(scores(spark, rows), ["g"]).collect()[0].threshold == pytest.approx(want, abs=1e-6)


def test_auc_ties_and_degenerate(spark):
    assert M.auc(scores(spark, zip([.5, .5, .2, .5], [1, 0, 0, 1])), ["g"]).collect()[0].auc == 0.75
    assert M.auc(scores(spark, zip([.5, .5], [1, 0])), ["g"]).collect()[0].auc == 0.5
    assert M.auc(scores(spark, zip([.5, .7], [1, 1])), ["g"]).collect()[0].auc == 0.5
    assert M.auc(scores(spark, []), ["g"]).count() == 0


def test_confusion_empty_denominators(spark):
    df = spark.createDataFrame([("g", 0, 0), ("g", 0, 0), ("g", None, 1)], "g string, y_true int, y_pred int")
    r = M.confusion(df, ["g"]).collect()[0]
    assert (r.tp, r.fn, r.fp, r.tn, r.n, r.acc, r.prec, r.rec, r.f1) == (0, 0, 0, 2, 2, 1.0, 0.0, 0.0, 0.0)


def test_accuracy_threshold_brute(spark):
    rng = random.Random(3)
    rows = [(round(rng.uniform(-1.5, 1.5), 2), rng.randint(0, 1)) for _ in range(60)]
    got = M.accuracy_threshold(scores(spark, rows), ["g"]).collect()[0]
    pts = sorted({-1.0, 1.0, *[s for s, _ in rows]})
    cand = sorted([-1.0, 1.0, *[(a + b) / 2 for a, b in zip(pts, pts[1:])]])
    best = max(cand, key=lambda t: (sum((s > t) == (y == 1) for s, y in rows), -t))
    assert got.threshold == pytest.approx(best, abs=1e-9)


def test_bootstrap_bounds(spark):
    df = spark.createDataFrame([("g", i, i % 3 > 0) for i in range(30)], "g string, pair int, ok boolean")
    r = B.bootstrap(df, ["g"], ["pair"], "ok", b=200).collect()[0]
    assert r.n == 30 and r.lo <= r.acc <= r.hi and r.acc == pytest.approx(2 / 3, abs=1e-4)


def test_paired_exact(spark):
    rows = [("t", "a", "b", True, False)] * 5 + [("t", "a", "b", False, True)] + [("t", "a", "b", True, True)] * 4
    df = spark.createDataFrame(rows, "t string, a string, b string, ok_a boolean, ok_b boolean")
    r = B.paired_randomization(df, ["t"]).collect()[0]
    want = sum(math.comb(6, k) for k in range(7) if abs(6 - 2 * k) >= 4) / 2**6
    assert r.p == pytest.approx(want) and r.stars == "="


def test_stars(spark):
    df = spark.createDataFrame([(.0009,), (.009,), (.049,), (.05,)], "p double")
    assert [r.s for r in df.select(B.stars(F.col("p")).alias("s")).collect()] == ["***", "**", "*", "="]


def test_threshold_ends_from_the_data(spark):
    """No positive: every threshold above all scores is right, the first is half a thousandth above the largest."""
    from averis.operators import metrics as M

    rows = [("a", 0.1, 0), ("a", 0.2, 0), ("a", 0.3, 0), ("b", 0.1, 1), ("b", 0.2, 1)]
    got = {r.g: (r.threshold, r.acc) for r in M.accuracy_threshold(spark.createDataFrame(rows, "g string, score double, y_true int"), ["g"], ends=None).collect()}
    assert got == {"a": (0.3005, 1.0), "b": (0.099, 1.0)}


def test_interpretability_by_hand(spark):
    from pyspark.sql import functions as F

    from averis.operators import metrics as M

    rows = [(0.5, 0.5, True, 0.75), (1.0, 0.0, False, 0.0), (-1.0, 0.0, True, 0.0), (0.2, -0.4, False, 0.8 / 1.2)]
    df = spark.createDataFrame(rows, "s double, r double, same boolean, want double")
    assert all(abs(x.got - x.want) < 1e-12 for x in df.withColumn("got", M.interpretability(F.col("s"), F.col("r"), F.col("same"))).collect())
