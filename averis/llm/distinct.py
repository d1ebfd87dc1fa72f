"""Problem 3: how much a term marks a record, by log-entropy weighting.

weight(term, record) = log2(1 + tf) * (1 - H(term) / log2(N)), H the entropy of the term's spread over the N records.
With G = sum tf and S = sum tf*log2(tf) over records, H = log2(G) - S/G, so one aggregation by term gives all of it and
the entropy never needs the pairs again. The aggregations: (1) terms within a record, counted in the row itself by
sorting its words, so no shuffle; (2) G, S and df by term with map-side combine. Pairs then meet their term's numbers:
terms in more than ``hot`` records and more than one in ``HOT_TERMS`` of all pairs are broadcast, and there are at most
``HOT_TERMS`` of them; the rest is joined by shuffle.

Defined results: null and empty texts have no terms but a non-null text counts in N; N of 1 gives entropy share 0;
repeated rows are records of their own; letters are Unicode letters, a term the longest run of them of at least
``min_letters``, lower-cased.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from averis.session import store

#: Terms whose numbers are broadcast, at most.
HOT_TERMS = 100_000


def row_counts(text: Column, min_letters: int = 4) -> Column:
    """ARRAY<STRUCT<term, tf>> of one text: sort the words, keep where each run of equal words starts."""
    ws = F.array_sort(F.regexp_extract_all(F.lower(text), F.lit(rf"\p{{L}}{{{min_letters},}}"), F.lit(0)))
    return _runs(ws)


def _runs(ws: Column) -> Column:
    starts = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    return F.when(F.size(ws) > 0, F.transform(F.array(ws), lambda s: F.transform(F.array(starts(s)), lambda st: F.transform(st, lambda p, k: F.struct(F.get(s, p).alias("term"), (F.coalesce(F.get(st, k + 1), F.size(s)) - p).alias("tf"))))[0])[0])


def log_entropy(records: DataFrame, keys: list[str], text: str, min_letters: int = 4, min_tf: int = 1, hot: int = 10_000) -> DataFrame:
    """(keys, term, tf, df, weight) for every term of every record with tf >= ``min_tf``; statistics are over all terms."""
    base = records.where(F.col(text).isNotNull())
    pairs = store(base.select(*keys, row_counts(F.col(text), min_letters).alias("terms")), "terms")
    n = pairs.count()
    each = pairs.select(*keys, F.explode("terms").alias("t")).select(*keys, "t.term", "t.tf")
    tf = F.col("tf").cast("double")
    stats = each.groupBy("term").agg(F.sum("tf").alias("gf"), F.sum(tf * F.log2(tf)).alias("s"), F.count(F.lit(1)).alias("df"))
    entropy = F.log2(F.col("gf")) - F.col("s") / F.col("gf")
    share = entropy / F.lit(_log2(n)) if n > 1 else F.lit(0.0)
    stats = store(stats.select("term", "df", F.greatest(F.lit(0.0), 1 - share).alias("g")), "termstats")
    strong = each.where(F.col("tf") >= min_tf) if min_tf > 1 else each
    often = stats.where(F.col("df") > F.lit(max(hot, int(stats.agg(F.sum("df")).first()[0] or 0) // HOT_TERMS)))
    cold = strong.join(F.broadcast(often.select("term")), "term", "left_anti").join(stats, "term")
    met = cold.unionByName(strong.join(F.broadcast(often), "term"))
    return met.select(*keys, "term", "tf", "df", (F.log2(1 + F.col("tf")) * F.col("g")).alias("weight"))


def _log2(n: int) -> float:
    import math

    return math.log2(n)
