import random

from pyspark.sql import functions as F

from averis.llm import splits as S

SCHEMA = "id bigint, keys array<string>, root string, u int"


def groups(df):
    keys = F.transform(F.filter(F.coalesce("keys", F.array().cast("array<string>")), lambda x: x.isNotNull()), lambda x: S.vertex("k", x))
    return S.components(df, "id", keys)


def brute(rows):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for i, ks, *_ in rows:
        for k in ks or []:
            if k is not None:
                up[find(("r", i))] = find(("k", k))
    out = {}
    for i, *_ in rows:
        out.setdefault(find(("r", i)), set()).add(i)
    return {frozenset(v) for v in out.values()}


def test_components_against_union_find(spark):
    rng = random.Random(2)
    rows = [(i, [f"s{rng.randint(0, 120)}", "hub" if i % 9 == 0 else f"v{i}"], "x", 1) for i in range(150)]
    rows += [(200, None, None, None), (201, [], None, None), (202, [None, "s1"], None, None), (203, ["p1", "p2"], None, 1), (204, ["p2", "p3"], None, 1), (205, ["p3", "p4"], None, 1)]
    got = {}
    for r in groups(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r.root, set()).add(r.id)
    assert {frozenset(v) for v in got.values()} == brute(rows)


def test_chain_of_length_forty(spark):
    rows = [(i, [f"c{i}", f"c{i + 1}"], None, None) for i in range(40)]
    assert groups(spark.createDataFrame(rows, SCHEMA)).select("root").distinct().count() == 1


def test_empty(spark):
    assert groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_assignment_keeps_groups_and_proportions(spark):
    rows = [(i, f"g{i % 200}" if i > 300 else "giant") for i in range(1000)]
    g = spark.createDataFrame(rows, "id bigint, root string")
    a = S.assign(g, "id", {"train": 8, "validation": 1, "test": 1}).cache()
    assert a.groupBy("root").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    n = {r["split"]: r["count"] for r in a.groupBy("split").count().collect()}
    assert a.count() == 1000 and abs(n["train"] - 800) < 40 and abs(n["test"] - 100) < 40


def test_many_seeds_and_a_hub(spark):
    rng = random.Random(5)
    edges = [("hub", f"x{i}") for i in range(300)] + [(f"a{i}", f"a{rng.randint(0, i - 1)}") for i in range(1, 60)]
    df = spark.createDataFrame(edges, "u string, v string")
    for seed in (1, 2):
        roots = {r.v: r.root for r in S.contract(df, seed).collect()}
        assert len({roots.get(v, v) for v in ["hub", *[f"x{i}" for i in range(300)]]}) == 1
        assert len({roots.get(f"a{i}", f"a{i}") for i in range(60)}) == 1
