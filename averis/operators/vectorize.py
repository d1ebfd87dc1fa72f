"""Vector space operators over long tables (doc_id, feature, n): TF-IDF, selection, scaling, pair combinations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def char_wb(text: Column, lo: int, hi: int) -> Column:
    """Character n-grams inside blank-delimited tokens, one blank of padding on either side; a token shorter than n is
    its own n-gram once."""
    toks = F.filter(F.split(F.lower(text), r"[ \t\n\r\x{0b}\f\x{85}\x{a0}\x{2000}-\x{200a}\x{202f}\x{3000}]+"), lambda t: t != "")
    def grams(t: Column) -> Column:
        p = F.concat(F.lit(" "), t, F.lit(" "))
        parts = []
        for n in range(lo, hi + 1):
            many = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(p) - (n - 1))), lambda i: F.substring(p, i, F.lit(n)))  # noqa: B023
            parts.append(many if n == lo else F.when(F.length(p) >= n, many).otherwise(F.array().cast("array<string>")))
        return F.concat(*parts)
    return F.flatten(F.transform(toks, grams))


def char_grams(text: Column, lo: int, hi: int) -> Column:
    """Character n-grams of the whole lower-cased text, two or more blanks in a row counting as one."""
    x = F.regexp_replace(F.lower(text), r"[ \t\n\r\x{0b}\f\x{85}\x{a0}\x{2000}-\x{200a}\x{202f}\x{3000}]{2,}", " ")
    def grams(t: Column) -> Column:
        return F.concat(*[F.when(F.length(t) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(t) - (n - 1))), lambda i: F.substring(t, i, F.lit(n)))).otherwise(F.array().cast("array<string>")) for n in range(lo, hi + 1)])  # noqa: B023
    return F.transform(F.array(x), grams)[0]


def array_grams(tokens: Column, lo: int, hi: int, joint: str = " ") -> Column:
    """n-grams over an array of tokens."""
    def grams(a: Column) -> Column:
        return F.concat(*[F.when(F.size(a) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(a) - (n - 1))), lambda i: F.array_join(F.slice(a, i, F.lit(n)), joint))).otherwise(F.array().cast("array<string>")) for n in range(lo, hi + 1)])
    return F.transform(F.array(tokens), grams)[0]


def counted(docs: DataFrame, grams: Column) -> DataFrame:
    return docs.select("doc_id", F.explode(grams).alias("feature")).groupBy("doc_id", "feature").agg(F.count(F.lit(1)).alias("n"))


def vocabulary(c: DataFrame, n_docs: int, min_df: float = 0.1, max_features: int | None = None) -> DataFrame:
    """(feature, df, idf) of the features in at least ``min_df`` of the documents; the ``max_features`` of highest total
    frequency (ties by name) where a limit is asked for."""
    v = c.groupBy("feature").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("total")).where(F.col("df") >= min_df * n_docs)
    if max_features:
        v = v.orderBy(F.desc("total"), "feature").limit(max_features)
    return v.select("feature", "df", (F.log((F.lit(1.0) + n_docs) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf(c: DataFrame, vocab: DataFrame, norm: bool = True) -> DataFrame:
    """(doc_id, feature, value). A vocabulary cut by ``min_df`` holds at most 1/min_df x (mean features of a document)
    features, so it is joined as the optimizer finds its size."""
    v = c.join(vocab.select("feature", "idf"), "feature").select("doc_id", "feature", (F.col("n") * F.col("idf")).alias("value"))
    if not norm:
        return v
    length = v.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("l"))
    return v.join(length, "doc_id").select("doc_id", "feature", (F.col("value") / F.col("l")).alias("value"))


def scaler(x: DataFrame, n_docs: int) -> DataFrame:
    """(feature, mean, sd) over all documents, absent values counting 0, from sums alone; sd 0 becomes 1."""
    g = x.groupBy("feature").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    var = F.greatest(F.lit(0.0), F.col("q") / n_docs - F.pow(F.col("s") / n_docs, 2))
    return g.select("feature", (F.col("s") / n_docs).alias("mean"), F.when(var < 1e-18, 1.0).otherwise(F.sqrt(var)).alias("sd"))


def scaled(x: DataFrame, s: DataFrame) -> DataFrame:
    """Scaled values of the stored entries; an absent entry stands for -mean/sd."""
    return x.join(s, "feature").select("doc_id", "feature", ((F.col("value") - F.col("mean")) / F.col("sd")).alias("value"))


def chi2(x: DataFrame, classes: DataFrame, n_docs: int) -> DataFrame:
    """(feature, chi2) of non-negative values against ``classes`` (doc_id, label)."""
    lab = x.join(classes, "doc_id").groupBy("feature", "label").agg(F.sum("value").alias("o"))
    total = lab.groupBy("feature").agg(F.sum("o").alias("t"))
    share = classes.groupBy("label").agg((F.count(F.lit(1)) / n_docs).alias("p"))
    shares = share.agg(F.collect_list(F.struct("label", "p")).alias("s"))  # one row: the classes with their shares
    full = total.join(F.broadcast(shares)).select("feature", "t", F.inline("s")).join(lab, ["feature", "label"], "left").withColumn("e", F.col("t") * F.col("p"))
    return full.groupBy("feature").agg(F.sum(F.pow(F.coalesce("o", F.lit(0.0)) - F.col("e"), 2) / F.col("e")).alias("chi2"))


def best(chi: DataFrame, top: int = 50_000) -> DataFrame:
    """The ``top`` features of highest chi2, ties by name."""
    return chi.orderBy(F.desc("chi2"), "feature").limit(top)


def pair_difference(pairs: DataFrame, x: DataFrame) -> DataFrame:
    """(pair_id, feature, value) with |a - b| over the union of both sides' features; zero differences are dropped.

    Both sides are gathered by one aggregation with signs instead of a full outer join."""
    long = pairs.select("pair_id", F.explode(F.array(F.struct(F.col("a").alias("doc_id"), F.lit(1.0).alias("sign")), F.struct(F.col("b").alias("doc_id"), F.lit(-1.0).alias("sign")))).alias("s")).select("pair_id", "s.*")
    j = long.join(x, "doc_id").groupBy("pair_id", "feature").agg(F.abs(F.sum(F.col("sign") * F.col("value"))).alias("value"))
    return j.where("value > 1e-12")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, t: s + t)
    den = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return dot(a, b) / F.when(den == 0, F.lit(1e-9)).otherwise(den)


COMBINATIONS = ("feats", "diff", "diffabs", "featsdiffabs", "diffprod", "diffabsprod", "featsdiffprod")


def combine(a: Column, b: Column, how: str = "diffabs") -> Column:
    """The pair vector of two feature arrays."""
    diff = F.zip_with(a, b, lambda p, q: p - q)
    absd = F.zip_with(a, b, lambda p, q: F.abs(p - q))
    prod = F.zip_with(a, b, lambda p, q: p * q)
    made = {"feats": [a, b], "diff": [diff], "diffabs": [absd], "featsdiffabs": [a, b, absd], "diffprod": [diff, prod], "diffabsprod": [absd, prod], "featsdiffprod": [a, b, diff, prod]}
    if how not in made:
        raise ValueError(f"unknown combination {how!r}; one of {', '.join(COMBINATIONS)}")
    return F.concat(*made[how]) if len(made[how]) > 1 else made[how][0]


def l2_normalized(a: Column) -> Column:
    n = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(a, lambda x: x / F.when(n == 0, 1.0).otherwise(n))


def union_blocks(blocks: dict[str, DataFrame]) -> DataFrame:
    """One long table of several feature blocks, each feature named ``block:feature``."""
    out = None
    for name, x in blocks.items():
        part = x.select("doc_id", F.concat(F.lit(name + ":"), F.col("feature")).alias("feature"), F.col(x.columns[-1]).cast("double").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def aligned(x: DataFrame, vocab: DataFrame) -> DataFrame:
    """Entries of features the fitted vocabulary has; features it lacks are dropped, absent ones stand for 0."""
    return x.join(vocab.select("feature").distinct(), "feature", "left_semi")
