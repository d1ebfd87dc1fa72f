"""Pair scorers: prediction by partial matching, likelihood ratios of Kneser-Ney models, calibrated models.

The text models are sequential, so they run as Arrow-batched pandas UDFs over pairs; every pair is scored within its
row and nothing is gathered. Null or empty texts give a null score, the row stays.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from averis.operators.metrics import by_score
from averis.session import store

VARIANTS = ("a", "b", "c", "d", "e")


class PPM:
    """Adaptive order-k character model. Contexts are the nodes of a trie that grows to the right: the child of a context by
    a symbol is the context one symbol on, and how often it was entered is the symbol's count. So one lookup gives a
    symbol's count in a context and the context that follows. Node: [times entered, symbols coded in it, children]."""

    def __init__(self, order: int = 5, variant: str = "d", exclusion: bool = False, alphabet: int = 256):
        if variant not in VARIANTS:
            raise ValueError(f"unknown variant {variant!r}")
        self.order, self.variant, self.exclusion, self.alphabet = order, variant, exclusion, alphabet
        self.root: list = [0, 0, {}]

    def _shares(self, ns: int, n: int, u: int) -> tuple[float | None, float]:
        """Probability of a symbol seen ns times (None: it does not qualify) and of escaping, n in all, u distinct."""
        v = self.variant
        if v == "a":
            return (ns / (1 + n) if ns else None), 1 / (1 + n)
        if v == "b":
            return ((ns - 1) / n if ns > 1 else None), u / n
        if v == "c":
            return (ns / (n + u) if ns > 1 else None), u / (n + u)
        if v == "d":
            return ((2 * ns - 1) / (2 * n) if ns else None), u / (2 * n)
        return ((4 * ns - 2) / (4 * n - 1) if ns else None), (2 * u - 1) / (4 * n - 1)

    def code(self, text: str) -> np.ndarray:
        """-ln p of each symbol; the model has learned the text afterwards. Contexts start anew with each text."""
        return -np.log(np.array(self._plain(text) if self.variant == "d" and not self.exclusion else self._general(text), dtype=float))

    def _plain(self, text: str) -> list[float]:
        out, root, depth, last = [], self.root, self.order + 1, 1 / self.alphabet
        live = [root]  # contexts of the place, longest first
        for s in text:
            p, open_, after = 1.0, True, []
            for node in live:
                kids, n = node[2], node[1]
                kid = kids.get(s)
                if kid is None:
                    if open_ and n:
                        p *= len(kids) / (2 * n)
                    kids[s] = kid = [1, 0, {}]
                else:
                    if open_:
                        p *= (2 * kid[0] - 1) / (2 * n)
                        open_ = False
                    kid[0] += 1
                node[1] = n + 1
                after.append(kid)
            out.append(p * last if open_ else p)
            after.append(root)
            live = after if len(after) <= depth else after[1:]
        return out

    def _general(self, text: str) -> list[float]:
        out, root, depth = [], self.root, self.order + 1
        live = [root]
        floor = 1 if self.variant in "bc" else 0
        for s in text:
            p, open_, barred, after = 1.0, True, set(), []
            for node in live:
                kids, n = node[2], node[1]
                kid = kids.get(s)
                if open_ and n:
                    u = len(kids)
                    if barred:
                        left = [k[0] for c, k in kids.items() if c not in barred]
                        n, u = sum(left), len(left)
                    if n:
                        hit, escape = self._shares(kid[0] if kid else 0, n, u)
                        open_ = hit is None
                        p *= escape if open_ else hit
                        if open_ and self.exclusion:
                            barred.update(c for c, k in kids.items() if k[0] > floor)
                if kid is None:
                    kids[s] = kid = [0, 0, {}]
                kid[0] += 1
                node[1] += 1
                after.append(kid)
            out.append(p / self.alphabet if open_ else p)
            after.append(root)
            live = after if len(after) <= depth else after[1:]
        return out


def compression_distances(x: str, y: str, measure: str = "cbc", order: int = 5, variant: str = "d") -> tuple[np.ndarray, np.ndarray]:
    """Per-symbol contributions to the distance in both directions; each sums to the distance of its direction."""
    mx, my = PPM(order, variant), PPM(order, variant)
    cx, cy = mx.code(x), my.code(y)
    cyx, cxy = mx.code(y), my.code(x)
    sx, sy = float(cx.sum()), float(cy.sum())
    norm = {"cbc": math.sqrt(sx * sy), "ncd": max(sx, sy), "cdm": sx + sy}[measure]
    return 1 / len(y) - (cy - cyx) / norm, 1 / len(x) - (cx - cxy) / norm


def compression_score(x: str | None, y: str | None, measure: str = "cbc", order: int = 5, variant: str = "d", symmetric: bool = True) -> float | None:
    if not x or not y:
        return None
    a, b = compression_distances(x, y, measure, order, variant)
    return -float(a.sum() + b.sum()) / 2 if symmetric else -float(a.sum())


def coav(known: Column, unknown: Column, **kw) -> Column:
    from pyspark.sql.types import DoubleType

    @F.pandas_udf(DoubleType())
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([compression_score(x, y, **kw) for x, y in zip(a, b)], dtype="float64")

    return score(known, unknown)


class KneserNey:
    """Interpolated Kneser-Ney model over token sentences; lower orders count distinct left neighbours, histories that
    start with the padding count plainly; the recursion ends in a uniform share of the vocabulary plus one unknown.
    With ``within`` (a set of histories, see ``histories``) only these are kept: the same probabilities behind them."""

    def __init__(self, sentences: list[tuple[str, ...]], order: int = 10, discount: float = 0.75, within: set | None = None):
        self.order, self.d = order, discount
        raw: list[dict[tuple, int]] = [defaultdict(int) for _ in range(order + 1)]
        left: list[dict[tuple, set]] = [defaultdict(set) for _ in range(order + 1)]
        vocab = {"</s>"}
        for s in sentences:
            t = ("<s>",) * (order - 1) + tuple(s) + ("</s>",)
            vocab.update(s)
            for i in range(order - 1, len(t)):
                for n in range(1, order + 1):
                    if within is not None and t[i - n + 1 : i] not in within:
                        break  # nor is any longer history
                    g = t[i - n + 1 : i + 1]
                    raw[n][g] += 1
                    if n < order:
                        left[n][g].add(t[i - n])
        self.rows: list[dict[tuple, dict[str, int]]] = [defaultdict(dict) for _ in range(order)]
        for n in range(1, order + 1):
            for g, c in raw[n].items():
                self.rows[n - 1][g[:-1]][g[-1]] = c if n == order or g[0] == "<s>" else len(left[n][g])
        self.sums = [{h: (sum(r.values()), len(r)) for h, r in rows.items()} for rows in self.rows]
        self.floor = 1 / (len(vocab) + 1)

    def prob(self, history: tuple[str, ...], w: str) -> float:
        p = self.floor
        for n in range(self.order):
            h = history[len(history) - n :] if n else ()
            got = self.sums[n].get(h)
            if got is None:
                break
            total, kinds = got
            p = max(self.rows[n][h].get(w, 0) - self.d, 0) / total + self.d * kinds / total * p
        return p

    def bits(self, sentences: list[tuple[str, ...]]) -> float:
        out = 0.0
        for s in sentences:
            t = ("<s>",) * (self.order - 1) + tuple(s) + ("</s>",)
            for i in range(self.order - 1, len(t)):
                out += math.log2(self.prob(t[i - self.order + 1 : i], t[i]))
        return out


def histories(sentences: list[tuple[str, ...]], order: int) -> set:
    """Every history that ``KneserNey.bits`` looks up for these sentences; with each also its suffixes."""
    out = set()
    for s in sentences:
        t = ("<s>",) * (order - 1) + tuple(s) + ("</s>",)
        out.update(t[i - n : i] for i in range(order - 1, len(t)) for n in range(order))
    return out


def drawn(m: int, k: int, key: str) -> list[int]:
    """``k`` of the numbers below ``m`` without replacement, all subsets alike (Floyd), by digests of ``key``."""
    out: dict[int, None] = {}
    for j in range(m - k, m):
        t = int.from_bytes(hashlib.md5(f"{key}|{j}".encode()).digest()[:8], "big") % (j + 1)
        out[j if t in out else t] = None
    return list(out)


def likelihood_ratio(known: list[tuple], unknown: list[tuple], samples: list[list[tuple]], order: int) -> float | None:
    """Mean over reference samples of log2 P(unknown | known model) - log2 P(unknown | reference model)."""
    if not known or not unknown or not samples:
        return None
    within = histories(unknown, order)
    base = KneserNey(known, order, within=within).bits(unknown)
    return sum(base - KneserNey(s, order, within=within).bits(unknown) for s in samples) / len(samples)


def _numbered(pool: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """(group, i, sentence): the sentences of each group numbered from 0, those of an author in one run; and
    (group, author, start, n): these runs. Ranks come from counts per hash range, no window runs over an author's rows. Joins
    are by merging: a compressed table looks small enough to broadcast when its sentences would fill the driver."""
    h = F.xxhash64("author", "sentence", F.lit(seed))
    near = store(pool.select("group", "author", "sentence", h.alias("h"), F.shiftrightunsigned(h, 54).alias("cell")), "pool")
    cells = near.groupBy("group", "author", "cell").agg(F.count(F.lit(1)).alias("c"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    runs = cells.groupBy("group", "author").agg(F.sum("c").alias("n"))
    runs = store(runs.select("group", "author", F.coalesce(F.sum("n").over(before(Window.partitionBy("group").orderBy("author"))), F.lit(0)).alias("start"), "n"), "runs")
    cells = cells.select("group", "author", "cell", F.coalesce(F.sum("c").over(before(Window.partitionBy("group", "author").orderBy("cell"))), F.lit(0)).alias("skip"))
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("group", "author", "cell").orderBy("h", "sentence")) - 1)
    numbered = near.join(cells.hint("merge"), ["group", "author", "cell"]).join(runs.hint("merge"), ["group", "author"])
    return numbered.select("group", (F.col("start") + F.col("skip") + F.col("r")).alias("i"), "sentence"), runs


def lambda_g(cases: DataFrame, pool: DataFrame, references: int = 100, order: int = 10, seed: int = 1) -> DataFrame:
    """(case_id, score). ``cases``: case_id, group, ka, ua, known, unknown (ARRAY<ARRAY<STRING>>). ``pool``: group, author,
    sentence (ARRAY<STRING>). Each sample of a case is drawn from all sentences of its group that are by neither of its
    speakers; the score is null where these are fewer than the known sentences, or a text is empty."""
    spark = cases.sparkSession
    named = lambda x: F.coalesce(F.col(x), F.lit("")).alias(x)
    numbered, runs = _numbered(pool.select("group", named("author"), "sentence"), seed)
    joined = lambda s: F.transform(s, lambda x: F.array_join(x, "\u001f"))
    c = store(cases.select("case_id", "group", named("ka"), named("ua"), joined("known").alias("known"), joined("unknown").alias("unknown")), "cases")
    own = lambda side, s, n: runs.select("group", F.col("author").alias(side), F.col("start").alias(s), F.col("n").alias(n))
    ask = c.where("size(known) > 0 AND size(unknown) > 0").select("case_id", "group", "ka", "ua", F.size("known").alias("k"))
    ask = ask.join(F.broadcast(runs.groupBy("group").agg(F.sum("n").alias("m"))), "group")
    ask = ask.join(own("ka", "s1", "n1").hint("merge"), ["group", "ka"], "left").join(own("ua", "s2", "n2").hint("merge"), ["group", "ua"], "left")
    ask = ask.select("case_id", "group", "k", "m", F.coalesce("s1", F.lit(0)).alias("s1"), F.coalesce("n1", F.lit(0)).alias("n1"), F.coalesce("s2", F.lit(0)).alias("s2"), F.when(F.col("ka") == F.col("ua"), 0).otherwise(F.coalesce("n2", F.lit(0))).alias("n2"))

    def draws(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for x in b.itertuples(index=False):
                others = x.m - x.n1 - x.n2
                if others < x.k:
                    continue
                skipped = sorted(((x.s1, x.n1), (x.s2, x.n2)))
                at = []
                for r in range(references):
                    for t in drawn(others, x.k, f"{seed}|{x.case_id}|{r}"):
                        for s, n in skipped:
                            t += n if t >= s else 0
                        at.append(t)
                yield pd.DataFrame({"case_id": x.case_id, "group": x.group, "rep": np.repeat(np.arange(references, dtype="int32"), x.k), "i": at})

    def score(cs: pd.DataFrame, rs: pd.DataFrame) -> pd.DataFrame:
        split = lambda xs: [tuple(x.split("\u001f")) for x in xs]
        samples = [split(g) for _, g in rs.groupby("rep")["sentence"]]
        out = [(x.case_id, None if x.known is None or x.unknown is None else likelihood_ratio(split(x.known), split(x.unknown), samples, order)) for x in cs.itertuples(index=False)]
        return pd.DataFrame(out, columns=["case_id", "score"]).astype({"score": "float64"})

    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    wanted = ask.repartition(tasks, "case_id").mapInPandas(draws, "case_id bigint, group string, rep int, i bigint")
    found = wanted.join(numbered.hint("merge"), ["group", "i"]).select("case_id", "rep", F.array_join("sentence", "\u001f").alias("sentence"))
    left = c.select("case_id", "known", "unknown").repartition(tasks, "case_id").groupBy("case_id")
    return left.cogroup(found.repartition(tasks, "case_id").groupBy("case_id")).applyInPandas(score, "case_id bigint, score double")


def calibrate(df: DataFrame, by: list[str], score: str = "score", truth: str = "y_true", c: float = 1.0, steps: int = 12) -> DataFrame:
    """(by, w, b): class-balanced logistic regression on one score, L2 on w, by Newton steps that are aggregations over
    the distinct scores of each group; no group is gathered and all groups are fitted at once."""
    d = by_score(df, by, score, truth)
    n = d.groupBy(*by).agg(F.sum("pos").alias("p"), F.sum("neg").alias("q")).where("p > 0 AND q > 0")
    d = store(d.join(n, by).select(*by, F.col("score").alias("x"), ((F.col("p") + F.col("q")) / (2 * F.col("p")) * F.col("pos")).alias("wp"), ((F.col("p") + F.col("q")) / (2 * F.col("q")) * F.col("neg")).alias("wn")), "cal")
    fit = n.select(*by, F.lit(0.0).alias("w"), F.lit(0.0).alias("b"))
    for i in range(steps):
        j = d.join(fit, by)
        z = 1 / (1 + F.exp(-(F.col("w") * F.col("x") + F.col("b"))))
        m = F.col("wp") + F.col("wn")
        j = j.select(*by, "w", "b", "x", (z * m - F.col("wp")).alias("r"), (z * (1 - z) * m).alias("h"))
        g = j.groupBy(*by, "w", "b").agg(F.sum(F.col("r") * F.col("x")).alias("gw"), F.sum("r").alias("gb"), F.sum(F.col("h") * F.col("x") * F.col("x")).alias("hww"), F.sum(F.col("h") * F.col("x")).alias("hwb"), F.sum("h").alias("hbb"))
        gw, hww = F.col("gw") + F.col("w") / c, F.col("hww") + 1 / c
        det = hww * F.col("hbb") - F.col("hwb") * F.col("hwb")
        fit = g.select(*by, (F.col("w") - (F.col("hbb") * gw - F.col("hwb") * F.col("gb")) / det).alias("w"), (F.col("b") - (hww * F.col("gb") - F.col("hwb") * gw) / det).alias("b"))
        if i % 3 == 2:
            fit = store(fit, "fit")
    return fit
