import random

from pyspark.sql import functions as F

from averis.functions.names import method_key, pair_key, split_key
from averis.operators.dedup import deduplicated, permuted, quotient_table, redelivered, unpermuted

SCHEMA = "row_id bigint, model string, run int, pair string, quotient string"


def keys():
    return [method_key("model"), F.col("run"), pair_key("pair")]


def test_keeps_one_of_each_and_the_last(spark):
    rows = [(1, "coav", 1, "[Y] A B vs. A B", "x"), (2, "COAV", 1, "A B vs A B", "x"), (3, "coav", 2, "A B vs A B", "x"), (4, None, None, None, None), (5, None, None, None, None), (6, "coav", 1, "case003", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.row_id for r in redelivered(df, keys(), "row_id").collect()} == {1, 4}
    assert {r.row_id for r in deduplicated(df, keys(), "row_id").collect()} == {2, 3, 5, 6}
    assert deduplicated(df, keys(), "row_id").columns == df.columns


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["coav", "COAV", "css", None]), rng.choice([1, 2, None]), rng.choice(["A vs. B", "[N] A  vs B", "B vs A", ""]), "q") for i in range(500)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    norm = {"[N] A  vs B": "A vs. B"}
    last = {}
    for r in rows:
        last[(r[1] and r[1].lower(), r[2], norm.get(r[3], r[3]))] = r[0]
    assert {r.row_id for r in deduplicated(df, keys(), "row_id").collect()} == set(last.values())


def test_fields_cannot_run_together(spark):
    df = spark.createDataFrame([(1, "a", "bc"), (2, "ab", "c"), (3, None, ""), (4, "", None)], "row_id int, x string, y string")
    assert quotient_table(df, [F.col("x"), F.col("y")], "row_id").count() == 4


def test_permutation_is_a_bijection(spark):
    df = spark.range(1000).select((F.col("id") * 7919 - 3).alias("h"), F.col("id").alias("l"))
    p = permuted(F.col("h"), F.col("l"))
    back = df.select("h", "l", p[0].alias("a"), p[1].alias("b"))
    u = unpermuted(F.col("a"), F.col("b"))
    assert back.where((u[0] != F.col("h")) | (u[1] != F.col("l"))).count() == 0


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert redelivered(df, keys(), "row_id").count() == 0


def test_names(spark):
    df = spark.createDataFrame([("[Y]Jürgen  X  vs.  B (C) ", "DV-BIN-DE", "Testing"), ("case001", "css", "train"), (None, None, None)], "p string, m string, s string")
    got = df.select(pair_key("p").alias("p"), method_key("m").alias("m"), split_key("s").alias("s")).collect()
    assert tuple(got[0]) == ("Jürgen X\u0001B (C)", "dv", "test")
    assert tuple(got[1]) == ("case001", "css", "train") and tuple(got[2]) == (None, None, None)


def test_identifiers_of_one_digest_stay_apart(spark, monkeypatch):
    """With a digest that is the same for all rows only the identifier in the slot tells them apart."""
    from pyspark.sql import functions as F

    from averis.operators import dedup as D

    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, None)], "row_id bigint, k string")
    monkeypatch.setattr(D.F, "md5", lambda c: F.lit("0" * 32))
    assert sorted(r.row_id for r in D.deduplicated(df, [F.col("k")], "row_id").collect()) == [2, 3, 5]
    assert [r.row_id for r in D.deduplicated(df, [F.col("k")], "row_id", exact=False).collect()] == [5]
