import numpy as np
import pytest

from averis.operators import grams as G
from averis.operators import logistic as LR


def newton(x, y, p):
    """Weights and intercept of least loss + p |w|^2 / 2, the intercept free."""
    x, w = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    penalty = np.diag([p] * (len(w) - 1) + [1e-9])
    for _ in range(60):
        q = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(x.T @ (x * (q * (1 - q))[:, None]) + penalty, x.T @ (q - y) + penalty @ w)
    return w


def drawn(n, width, seed):
    rng = np.random.default_rng(seed)
    x = np.abs(rng.normal(size=(n, width))) * (rng.random((n, width)) < 0.6)
    x[3] = 0
    return x, (x[:, 0] - x[:, 1] + rng.normal(size=n) > 0.2).astype(float)


@pytest.mark.parametrize("held", [LR.HELD, 2000, 0])
def test_minima_are_those_of_newton_steps(monkeypatch, held):
    """With all blocks in memory, some and none."""
    monkeypatch.setattr(LR, "HELD", held)
    monkeypatch.setattr(LR, "CELLS", 70)
    x, y = drawn(80, 6, 5)
    rows = LR.Rows(6)
    for r in x:
        at = np.flatnonzero(r)
        rows.add(at, r[at])
    rows.close()
    some = np.arange(80) % 5 > 0
    fits = [(p, m) for p in (0.01, 1.0, 50.0) for m in (np.ones(80, bool), some)]
    for (p, m), got in zip(fits, LR.minima(rows, y, fits, 1000)):
        assert got == pytest.approx(newton(x[m], y[m], p), abs=1e-3)


def test_each_corpus_by_itself(spark):
    """Two corpora whose features lie one behind the other, values over a deviation, a feature left out, held-out rows."""
    v = G.Vocabulary(["a"] * 3 + ["b"] * 3, [f"f:{k}" for k in (0, 1, 2, 0, 1, 2)])
    over, rows, want, given = np.array([2.0, 1.0, np.inf, 1.0, 0.5, 1.0]), [], {}, {}
    for c, start in (("a", 0), ("b", 3)):
        x, y = drawn(60, 3, ord(c))
        for k in range(60):
            at = np.flatnonzero(x[k])
            rows.append((c, ord(c) * 100 + k, float(y[k]), k % 5 == 0, [int(start + i) for i in at], [float(t) for t in x[k, at]]))
        use = np.isfinite(over[start : start + 3])
        z = (x / over[start : start + 3])[:, use]
        w, part, held = newton(z, y, 2.0), newton(z[np.arange(60) % 5 > 0], y[np.arange(60) % 5 > 0], 3.0), np.arange(60) % 5 == 0
        want[c] = w, int((((z @ part[:-1] + part[-1] > 0) == (y == 1)) & held).sum())
        given |= {ord(c) * 100 + k: s for k, s in enumerate(1 / (1 + np.exp(-(z @ w[:-1] + w[-1]))))}
    df = spark.createDataFrame([*rows], "corpus string, pair_id bigint, label double, held boolean, i array<int>, v array<double>").repartition(5)
    found = LR.each(df, v, over, [2.0], 1000, [3.0])
    assert set(found) == {("a", 0), ("b", 0)}
    for c, (w, right) in want.items():
        assert found[c, 0][0] == pytest.approx(w, abs=1e-3) and found[c, 0][1] == right
    w, start = LR.spread_out({c: f for (c, _), (f, _) in found.items()}, v, over)
    got = {r.pair_id: r.score for r in LR.probabilities(df, w, start).collect()}
    assert set(got) == set(given) and all(got[k] == pytest.approx(given[k], abs=1e-3) for k in given)


def test_rows_without_features_and_corpora_without_rows(spark):
    v, rows = G.Vocabulary([], []), "corpus string, pair_id bigint, label double, held boolean, i array<int>, v array<double>"
    none = spark.createDataFrame([], rows)
    assert LR.each(none, v, np.zeros(0), [1.0], 100) == {}
    one = spark.createDataFrame([("c", k, float(k < 3), False, [], []) for k in range(4)], rows)
    f, _ = LR.each(one, v, np.zeros(0), [1.0], 100)["c", 0]
    assert f == pytest.approx([np.log(3)], abs=1e-3)
    assert [r.score for r in LR.probabilities(one, np.zeros(0), {}).collect()] == [0.5] * 4
