"""Resampling statistics whose random draws are hashes, so results do not depend on partitioning.

A draw for (key, replicate, position) is the first 32 bits of an MD5 digest; the same numbers come out anywhere.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def draw(*parts: Column) -> Column:
    """BIGINT in [0, 2**32) from the digest of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary")), 1, 8), 16, 10).cast("bigint")


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("=")


def _dealt(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows that are about to be multiplied, in a fixed number of partitions: by their present size they would be
    coalesced into one task."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *by)


def bootstrap(df: DataFrame, by: list[str], order: list[str], correct: str, b: int = 1000, alpha: float = 0.05, seed: int = 1) -> DataFrame:
    """n, acc and percentile interval (lo, hi) of the accuracy over ``b`` resamples of each group.

    Only the number of right answers matters, and it is binomial: each replicate is one number of the group's stream, put
    through the inverse distribution. No case is joined to its draws; a group is one row and is worked on where it is."""
    g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col(correct).cast("bigint")), F.lit(0)).alias("k"))
    lo, hi = int(alpha / 2 * b), min(b - 1, int((1 - alpha / 2) * b))

    @F.pandas_udf("struct<lo:double,hi:double>")
    def interval(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ks, ns, rights in batches:
            hits = [np.sort(_binomial(int(n), int(k), _uniforms(x, b))) / n for x, n, k in zip(ks, ns, rights)]
            yield pd.DataFrame([(h[lo], h[hi]) for h in hits], columns=["lo", "hi"]).astype("float64")

    got = _dealt(g, by).withColumn("ci", interval(F.concat_ws("|", F.lit(str(seed)), *by), "n", "k"))
    return got.select(*by, "n", F.round(F.col("k") / F.col("n"), 9).alias("acc"), F.round("ci.lo", 9).alias("lo"), F.round("ci.hi", 9).alias("hi"))


def _uniforms(key: str, n: int) -> np.ndarray:
    """``n`` numbers in [0, 1): splitmix64 of a counter that starts at the digest of ``key``."""
    z = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(int.from_bytes(hashlib.md5(key.encode()).digest()[:8], "big"))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype("float64") * 2.0**-53


def _quantiles(logs: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Places in a distribution of these log weights at which its cumulated share passes ``u``."""
    c = np.cumsum(np.exp(logs - logs.max()))
    return np.minimum(np.searchsorted(c / c[-1], u, side="right"), len(c) - 1)


def _log_choose(n: int) -> np.ndarray:
    f = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])
    return f[n] - f - f[::-1]


def _binomial(n: int, k: int, u: np.ndarray) -> np.ndarray:
    """Right answers among ``n`` draws with replacement from ``n`` answers of which ``k`` are right."""
    if k in (0, n):
        return np.full(len(u), k)
    i = np.arange(n + 1)
    return _quantiles(_log_choose(n) + i * math.log(k / n) + (n - i) * math.log(1 - k / n), u)


def _paired_p(key: str, d: int, s: int, r: int, exact_threshold: int) -> float:
    if d <= exact_threshold:
        return sum(math.comb(d, k) for k in range(d + 1) if abs(d - 2 * k) >= s) / 2**d
    t = np.abs(d - 2 * _quantiles(_log_choose(d), _uniforms(key, r)))
    return (int((t >= s).sum()) + 1) / (r + 1)


def paired_randomization(pairs: DataFrame, by: list[str], a: str = "a", b: str = "b", ok_a: str = "ok_a", ok_b: str = "ok_b", r: int = 1000, exact_threshold: int = 20, seed: int = 1) -> DataFrame:
    """Two-sided paired approximate randomization on accuracy for each (by, a, b).

    Only cases where the systems differ matter. With d such cases, s = |right(a) - right(b)| becomes |d - 2 x wins| when
    each is swapped at random, and the wins are binomial; up to ``exact_threshold`` differing cases their sum is exact,
    beyond it ``r`` of them are drawn and p = (nge + 1) / (r + 1)."""
    keys = [*by, a, b]
    g = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(ok_a).cast("bigint")).alias("ra"), F.sum(F.col(ok_b).cast("bigint")).alias("rb"), F.count_if(F.col(ok_a) != F.col(ok_b)).alias("d"))

    @F.pandas_udf("double")
    def p_of(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for ks, ds, ss in batches:
            yield pd.Series([_paired_p(k, int(d), int(s), r, exact_threshold) for k, d, s in zip(ks, ds, ss)], dtype="float64")

    both = _dealt(g, keys).withColumn("p", p_of(F.concat_ws("|", F.lit(str(seed)), *keys), "d", F.abs(F.col("ra") - F.col("rb"))))
    return both.select(*keys, "n", F.round(F.col("ra") / F.col("n"), 9).alias("acc_a"), F.round(F.col("rb") / F.col("n"), 9).alias("acc_b"), F.round("p", 6).alias("p"), stars(F.col("p")).alias("stars"))


def stratified_randomization(df: DataFrame, by: list[str], stratum: str, group: str, value: str, r: int = 200, seed: int = 1) -> DataFrame:
    """Difference of means of two groups ('a', 'b'), values shuffled within strata: per replicate and stratum the rows are
    put in hash order and the first n_a of them are called 'a'. Rows need a unique ``_id``."""
    d = df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(r - 1))))
    na = F.count_if(F.col(group) == "a").over(Window.partitionBy(*by, "rep", stratum))
    pos = F.row_number().over(Window.partitionBy(*by, "rep", stratum).orderBy(draw(F.lit(str(seed)), F.col("rep"), F.col("_id")), "_id"))
    d = d.select(*by, "rep", F.col(group).alias("g"), F.col(value).cast("double").alias("v"), F.when(pos <= na, "a").otherwise("b").alias("h"))
    mean = lambda c, x: F.avg(F.when(F.col(c) == x, F.col("v")))
    reps = d.groupBy(*by, "rep").agg(F.round(F.abs(mean("g", "a") - mean("g", "b")), 9).alias("real"), F.round(F.abs(mean("h", "a") - mean("h", "b")), 9).alias("drawn"))
    return reps.groupBy(*by).agg(F.round(F.max("real"), 6).alias("diff"), F.round((F.count_if(F.col("drawn") >= F.col("real")) + 1) / (r + 1), 6).alias("p"))


def _hypergeometric(n: int, k: int, na: int, u: np.ndarray) -> np.ndarray:
    """Right answers among ``na`` of ``n`` answers, of which ``k`` are right, drawn without replacement."""
    low, high = max(0, na - (n - k)), min(k, na)
    i = np.arange(low, high + 1)
    return low + _quantiles(_log_choose(k)[i] + _log_choose(n - k)[na - i], u)


def stratified_accuracy(df: DataFrame, by: list[str], stratum: str, group: str, right: str, weight: str | None = None, r: int = 1000, seed: int = 1) -> DataFrame:
    """``stratified_randomization`` of answers that are right (1) or wrong (0): after a shuffle within a stratum the right
    ones of group 'a' are hypergeometric, so each replicate is one number a stratum and no row is multiplied. A row
    stands for ``weight`` answers."""
    is_a, ok, c = F.col(group) == "a", F.col(right).cast("bigint"), F.col(weight) if weight else F.lit(1).cast("bigint")
    g = df.where(ok.isNotNull()).groupBy(*by, F.col(stratum).cast("string").alias("_s")).agg(F.sum(c).alias("n"), F.sum(ok * c).alias("k"), F.coalesce(F.sum(F.when(is_a, c)), F.lit(0)).alias("na"), F.coalesce(F.sum(F.when(is_a, ok * c)), F.lit(0)).alias("ka"))
    g = g.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_s", "n", "k", "na", "ka"))).alias("x"))
    g = g.where("aggregate(x, 0L, (t, y) -> t + y.na) > 0 AND aggregate(x, 0L, (t, y) -> t + y.n - y.na) > 0")

    @F.pandas_udf("struct<diff:double,p:double>")
    def test(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for keys, strata in batches:
            out = []
            for key, xs in zip(keys, strata):
                n, k, na, ka = (sum(x[f] for x in xs) for f in ("n", "k", "na", "ka"))
                far = lambda h: np.round(np.abs(h / na - (k - h) / (n - na)), 9)  # noqa: B023, E731
                h = sum(_hypergeometric(x["n"], x["k"], x["na"], _uniforms(f"{key}|{x['_s']}", r)) for x in xs)
                real = far(np.array([ka]))[0]
                out.append((float(real), (int((far(h) >= real).sum()) + 1) / (r + 1)))
            yield pd.DataFrame(out, columns=["diff", "p"]).astype("float64")

    got = _dealt(g, by).withColumn("t", test(F.concat_ws("|", F.lit(str(seed)), *by), "x"))
    return got.select(*by, F.round("t.diff", 6).alias("diff"), F.round("t.p", 6).alias("p"))
