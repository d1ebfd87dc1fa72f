"""Scorers over whole tables. Text models have no SQL; they are tested against golden values and brute force."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from averis.functions import text as T
from averis.operators import linear
from averis.operators import metrics as M
from averis.operators import scorers as S
from averis.plans.corpora import cases
from averis.plans.evaluation import RUN, base_preds
from averis.session import store, table

QUERIES: dict = {}
SQL: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def m04_coav(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1-M4: compression distance of every case, both whole texts."""
    c = table(spark, sf_dir, "read_corpus_sorted").select("case_id", "masking", "topic", "known", "unknown", "label")
    c = c.repartition(max(c.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism * 4))  # small even tasks: the cost of a row is the length of its texts
    return c.select("case_id", "masking", "topic", F.col("label").cast("int").alias("y_true"), S.coav(F.col("known"), F.col("unknown")).alias("score"))


@query
def m05_symbol_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5: what each symbol of the unknown text contributes to the distance; a case's shares sum to it."""
    @F.pandas_udf("array<double>")
    def shares(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([None if not x or not y else S.compression_distances(x, y)[0] for x, y in zip(a, b)], dtype=object)

    c = table(spark, sf_dir, "read_corpus_sorted").select("case_id", "known", "unknown")
    c = c.repartition(max(c.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism * 4))
    return c.select("case_id", F.posexplode(shares("known", "unknown")).alias("place", "share"))


@query
def m07_lambdag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7, M8: likelihood ratio of every case of both maskings, 5 reference models of order 5."""
    c = cases(spark, sf_dir)
    k = c.select("case_id", F.concat_ws("|", "masking", "topic").alias("group"), "ka", "ua", T.token_sentences("known").alias("known"), T.token_sentences("unknown").alias("unknown"))
    pool = k.select("group", F.col("ka").alias("author"), "known").distinct().select("group", "author", F.explode("known").alias("sentence"))
    return S.lambda_g(k, pool, references=5, order=5)


@query
def m09_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9: balanced logistic calibration per corpus and run, fitted on train."""
    f = S.calibrate(base_preds(spark, sf_dir).where("split = 'train'"), RUN)
    return f.select(*RUN, F.round("w", 5).alias("w"), F.round("b", 5).alias("b"))


@query
def m09_calibrated_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = store(base_preds(spark, sf_dir), "preds")
    f = S.calibrate(p.where("split = 'train'"), RUN)
    t = p.where("split = 'test' AND score IS NOT NULL").join(f, RUN)
    y = (F.col("w") * F.col("score") + F.col("b") >= 0).cast("int")
    return M.confusion(t.withColumn("y_pred", y), RUN)


def run_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of all corpora, split by known speaker."""
    c = cases(spark, sf_dir)
    return c.select("case_id", "masking", "topic", F.when(F.pmod(F.xxhash64("ka"), F.lit(10)) < 4, "train").otherwise("test").alias("split"), F.concat("ka", F.lit("\u0001"), "ua").alias("pair"), F.col("ka").alias("known_author"), F.col("ua").alias("unknown_author"), "known", "unknown", F.col("label").cast("int").alias("y_true"))


def _linear(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    s = linear.SCORERS[name](run_cases(spark, sf_dir), 1)
    return s.select("case_id", "masking", "topic", "split", "y_true", F.round("score", 4).alias("score"), (F.col("score") >= 0.5).cast("int").alias("y_pred"))


@query
def m10_stylospeaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8 blocks, |x1 - x2|, logistic regression, cut at 0.5."""
    return _linear(spark, sf_dir, "stylospeaker")


@query
def m11_fevec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7 blocks, scaled, |x1 - x2| scaled again, penalty chosen on held-out pairs, refit."""
    return _linear(spark, sf_dir, "fevec")


@query
def m12_dv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F21 blocks, best by chi2, trained on pairs of the distinct training documents."""
    return _linear(spark, sf_dir, "dv")


@query
def o01_run_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two methods over all corpora, split by known speaker, thresholds per corpus, metrics of both splits; a method
    that failed is a row with its reason."""
    from averis.operators import pipeline as P

    out, failed = P.run(run_cases(spark, sf_dir), [P.build("coav"), P.build("lambdag", references=3, order=4)])
    reasons = spark.createDataFrame([(m, r, why) for m, r, why in failed], "method string, run int, failure string")
    if out is None:
        return reasons
    scored = M.metrics(out.where("y_pred IS NOT NULL"), [*RUN, "split"])
    return scored.withColumn("failure", F.lit(None).cast("string")).unionByName(reasons, allowMissingColumns=True)
