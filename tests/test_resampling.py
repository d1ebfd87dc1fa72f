import math

import random

import pytest

from averis.operators import resampling as B
from averis.plans import evaluation as E


def write(spark, folder, rows):
    """rows: topic, masking, model, run, pair number, right."""
    cols = "row_id bigint, topic string, masking string, model string, run int, split string, pair string, y_true int, y_pred int, score double, aligned int"
    data = [(i, t, m, k, r, "test", f"[Y] a{p} vs. a{p}", 1, int(ok), 0.5, 1) for i, (t, m, k, r, p, ok) in enumerate(rows)]
    spark.createDataFrame(data, cols).write.parquet(f"{folder}/predictions.parquet")
    return str(folder)


def test_b02_thousand_replicates_and_exact_to_twenty(spark, tmp_path):
    rows = [("diy", "original", k, 1, p, k == "coav") for k in ("coav", "css") for p in range(30)]
    rows += [("math", "original", k, 1, p, (k == "coav") == (p < 13)) for k in ("coav", "css") for p in range(18)]
    got = {r.topic: r for r in E.b02_paired_randomization(spark, write(spark, tmp_path, rows)).collect()}
    assert got["diy"].p == pytest.approx(1 / 1001, abs=1e-6) and got["diy"].stars == "***"
    want = sum(math.comb(18, k) for k in range(19) if abs(18 - 2 * k) >= 8) / 2**18
    assert got["math"].p == pytest.approx(want, abs=1e-6)


def test_b01_both_maskings_thousand_resamples(spark, tmp_path):
    rows = [("diy", m, "coav", 1, p, p % 4 > 0) for m in ("original", "posnoised") for p in range(40)]
    rows += [("math", "posnoised", "css", r, p, r == 1) for r in (1, 2) for p in range(5)]
    got = {(r.topic, r.masking, r.run): r for r in E.b01_bootstrap_ci(spark, write(spark, tmp_path, rows)).collect()}
    assert len(got) == 4 and (got["math", "posnoised", 1].lo, got["math", "posnoised", 2].hi) == (1.0, 0.0)
    rng = random.Random(1)
    accs = sorted(sum(rng.random() < 0.75 for _ in range(40)) / 40 for _ in range(20000))
    for m in ("original", "posnoised"):
        r = got["diy", m, 1]
        assert (r.n, r.acc) == (40, 0.75) and abs(r.lo - accs[500]) <= 1 / 40 + 1e-9 and abs(r.hi - accs[19500]) <= 1 / 40 + 1e-9


def test_b01_order_statistics(spark):
    """The 25th and 975th of 1,000 sorted resamples, by the streams the operator draws from."""
    df = spark.createDataFrame([("g", i < 30) for i in range(37)], "g string, ok boolean")
    r = B.bootstrap(df, ["g"], [], "ok").collect()[0]
    cdf = [sum(math.comb(37, i) * (30 / 37) ** i * (7 / 37) ** (37 - i) for i in range(h + 1)) for h in range(38)]
    hits = sorted(next(h for h in range(38) if u < cdf[h] or h == 37) for u in B._uniforms("1|g", 1000))
    assert (r.lo, r.hi) == (pytest.approx(hits[25] / 37), pytest.approx(hits[975] / 37))


def test_b03_all_pairs_of_sources(spark, tmp_path):
    """Three sources, two maskings: three comparisons each; p near that of the whole permutation distribution."""
    rows = [(f"{s}2diy", m, "coav", r, p, p < k) for m in ("original", "posnoised") for r in (1, 2) for s, k in (("cooking", 20), ("finance", 12), ("math", 2)) for p in range(20)]
    got = {(r.masking, r.source_a, r.source_b): r for r in E.b03_stratified_randomization(spark, write(spark, tmp_path, rows)).collect()}
    assert set(got) == {(m, *s) for m in ("original", "posnoised") for s in (("cooking", "finance"), ("cooking", "math"), ("finance", "math"))}
    assert got["original", "cooking", "math"].diff == 0.9 and got["original", "cooking", "math"].p == pytest.approx(1 / 1001, abs=1e-6)


def test_stratified_accuracy_distribution(spark):
    rows = [("t", s, "a" if i < na else "b", int((i * 7) % n < k)) for s, n, na, k in ((1, 9, 4, 5), (2, 6, 3, 2)) for i in range(n)]
    df = spark.createDataFrame(rows, "t string, s int, g string, ok int")
    got = B.stratified_accuracy(df, ["t"], "s", "g", "ok", r=20000).collect()[0]
    na, n = sum(x[2] == "a" for x in rows), len(rows)
    k, ka = sum(x[3] for x in rows), sum(x[3] for x in rows if x[2] == "a")
    far = lambda h: round(abs(h / na - (k - h) / (n - na)), 9)
    want = 0
    for x in range(5):
        for y in range(4):
            if far(x + y) >= far(ka):
                want += math.comb(5, x) * math.comb(4, 4 - x) / math.comb(9, 4) * math.comb(2, y) * math.comb(4, 3 - y) / math.comb(6, 3)
    assert got.diff == pytest.approx(far(ka), abs=1e-6) and got.p == pytest.approx(want, abs=0.015)
