"""Thresholds and metrics per group, as aggregates and windows over distinct scores (never over single rows).

Rows of a group with the same score are merged first, so a hot score costs one row, and windows are partitioned by
group. Groups without rows give none; a metric with an empty denominator is 0; AUC is 0.5 where one class is missing
or all scores are equal; rows with a null score or label do not count for AUC and thresholds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def confusion(df: DataFrame, by: list[str], truth: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """tp, fn, fp, tn, n, acc, prec, rec, f1 by group."""
    n = lambda t, p: F.count_if((F.col(truth) == t) & (F.col(pred) == p))
    c = df.where(F.col(truth).isNotNull() & F.col(pred).isNotNull()).groupBy(*by).agg(n(1, 1).alias("tp"), n(1, 0).alias("fn"), n(0, 1).alias("fp"), n(0, 0).alias("tn"), F.count(F.lit(1)).alias("n"))
    tp, fn, fp, tn = (F.col(x).cast("double") for x in ("tp", "fn", "fp", "tn"))
    return c.withColumns({
        "acc": F.round(_ratio(tp + tn, F.col("n")), 9), "prec": F.round(_ratio(tp, tp + fp), 9),
        "rec": F.round(_ratio(tp, tp + fn), 9), "f1": F.round(_ratio(2 * tp, 2 * tp + fp + fn), 9),
    })


def by_score(df: DataFrame, by: list[str], score: str = "score", truth: str = "y_true") -> DataFrame:
    """One row per group and distinct score with its positives and negatives."""
    ok = df.where(F.col(score).isNotNull() & ~F.isnan(score) & F.col(truth).isNotNull())
    return ok.groupBy(*by, F.col(score).alias("score")).agg(F.sum(F.col(truth).cast("bigint")).alias("pos"), F.sum(1 - F.col(truth).cast("bigint")).alias("neg"))


def auc(df: DataFrame, by: list[str], score: str = "score", truth: str = "y_true") -> DataFrame:
    d = by_score(df, by, score, truth)
    below = F.sum("neg").over(Window.partitionBy(*by).orderBy("score").rowsBetween(Window.unboundedPreceding, 0)) - F.col("neg")
    d = d.withColumn("u", F.col("pos") * (below + F.col("neg") / 2))
    g = d.groupBy(*by).agg(F.sum("u").alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    return g.select(*by, F.when((F.col("p") == 0) | (F.col("q") == 0), 0.5).otherwise(F.round(F.col("u") / (F.col("p") * F.col("q")), 9)).alias("auc"))


def metrics(df: DataFrame, by: list[str]) -> DataFrame:
    return confusion(df, by).join(auc(df, by), by, "left").withColumn("auc", F.coalesce("auc", F.lit(0.5)))


def eer_threshold(df: DataFrame, by: list[str], score: str = "score", truth: str = "y_true") -> DataFrame:
    """Threshold where false positive and false negative rate meet, interpolated between neighbouring ROC points.

    The ROC keeps its first and last point and every point where the slope changes, as the published curve does; the
    interpolation with the previous point applies only where its share lies in [0, 1] and its threshold is finite."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    d = by_score(df, by, score, truth).select(*by, "score", F.sum("neg").over(run).alias("fp"), F.sum("pos").over(run).alias("tp"))
    whole = Window.partitionBy(*by)
    d = d.withColumns({x: F.lag(c).over(w) for x, c in (("fp0", "fp"), ("tp0", "tp"))} | {x: F.lead(c).over(w) for x, c in (("fp1", "fp"), ("tp1", "tp"))} | {"p": F.max("tp").over(whole), "q": F.max("fp").over(whole), "m": F.count(F.lit(1)).over(whole)})
    turn = (F.col("fp1") - 2 * F.col("fp") + F.col("fp0") != 0) | (F.col("tp1") - 2 * F.col("tp") + F.col("tp0") != 0)
    d = d.where((F.col("m") <= 2) | F.col("fp0").isNull() | F.col("fp1").isNull() | turn).where("p > 0 AND q > 0")
    d = d.select(*by, "score", (F.col("fp") / F.col("q")).alias("x2"), (1 - F.col("tp") / F.col("p")).alias("y2"))
    d = d.withColumns({"x1": F.lag("x2").over(w), "y1": F.lag("y2").over(w), "t1": F.lag("score").over(w)})
    # the prepended point (0, 1, infinity) is never the nearest but at a gap of exactly 1
    d = d.withColumn("gap", F.round(F.abs(F.col("x2") - F.col("y2")), 12))
    best = d.groupBy(*by).agg(F.min_by(F.struct("score", "x1", "y1", "x2", "y2", "t1"), F.struct("gap", -F.col("score"))).alias("b"))
    b = lambda c: F.col("b." + c)
    den = (b("x2") - b("x1")) - (b("y2") - b("y1"))
    alpha = (b("y1") - b("x1")) / F.nullif(den, F.lit(0.0))
    t = F.when(alpha.between(0.0, 1.0), b("t1") + alpha * (b("score") - b("t1"))).otherwise(b("score"))
    return best.select(*by, F.round(t, 6).alias("threshold"))


def accuracy_threshold(df: DataFrame, by: list[str], ends: tuple[float, float] | None = (-1.0, 1.0), score: str = "score", truth: str = "y_true") -> DataFrame:
    """First candidate with the best accuracy for ``score > t``; candidates are midpoints of neighbouring distinct scores
    and two ends: the fixed ones, or (``ends=None``) 0.001 below the smallest score and half of that above the largest,
    the first midpoint beyond all scores where 0.001 above the largest is an end too."""
    d = by_score(df, by, score, truth)
    if ends:
        low = d.select(*by).distinct()
        extra = [low.select(*by, F.lit(float(e)).alias("score"), F.lit(0).cast("bigint").alias("pos"), F.lit(0).cast("bigint").alias("neg")) for e in ends]
        d = d.unionByName(extra[0]).unionByName(extra[1]).groupBy(*by, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    w = Window.partitionBy(*by).orderBy("score")
    run, whole = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*by)
    d = d.select(*by, "score", F.lead("score").over(w).alias("next"), F.row_number().over(w).alias("i"), F.sum("neg").over(run).alias("tn"), F.sum("pos").over(run).alias("fn"), F.sum("pos").over(whole).alias("p"), F.sum(F.col("pos") + F.col("neg")).over(whole).alias("n"), (F.col("pos") + F.col("neg")).alias("own"), "pos", "neg")
    right = F.col("tn") + F.col("p") - F.col("fn")
    cand = F.struct((-right).alias("loss"), ((F.col("score") + F.col("next")) / 2 if ends else F.coalesce((F.col("score") + F.col("next")) / 2, F.col("score") + 0.0005)).alias("t"))
    first = F.struct((-(F.col("tn") - F.col("neg") + F.col("p") - F.col("fn") + F.col("pos"))).alias("loss"), (F.lit(ends[0]) if ends else F.col("score") - 0.001).alias("t"))
    firsts = [first]
    if ends:  # each fixed end is a candidate wherever the scores lie: rows at or below it are called negative
        at = lambda e: F.struct((-(F.sum(F.when(F.col("score") <= e, F.col("neg")).otherwise(F.col("pos"))).over(whole))).alias("loss"), F.lit(e).alias("t"))
        firsts = [at(e) for e in ends]
    d = d.select(*by, "n", "i", F.array(*firsts).alias("first"), cand.alias("cand"))
    both = d.select(*by, "n", F.explode(F.when(F.col("i") == 1, F.concat("first", F.array("cand"))).otherwise(F.array("cand"))).alias("c")).where("c.t IS NOT NULL")
    g = both.groupBy(*by).agg(F.min("c").alias("c"), F.max("n").alias("n"))
    return g.select(*by, F.round("c.t", 9).alias("threshold"), F.round(-F.col("c.loss") / F.col("n"), 9).alias("acc"))


def decide(df: DataFrame, thresholds: DataFrame, by: list[str], strict: bool = False, score: str = "score") -> DataFrame:
    """``y_hat`` by the group's threshold: ``>=`` or, if ``strict``, ``>``; null without a threshold or score."""
    d = df.join(thresholds.select(*by, "threshold"), by, "left")
    return d.withColumn("y_hat", ((F.col(score) > F.col("threshold")) if strict else (F.col(score) >= F.col("threshold"))).cast("int"))


def interpretability(s: Column, residual: Column, same: Column) -> Column:
    """Share of a decision that rests on the interpretable similarity ``s``: (1 + s or 1 - s) over itself and the size of the
    predicted residual, by the predicted class; 0 where both are 0."""
    num = F.when(same, 1 + s).otherwise(1 - s)
    den = num + F.abs(residual)
    return F.when(den == 0, 0.0).otherwise(num / den)
