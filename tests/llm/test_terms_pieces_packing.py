import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from averis.llm import distinct, packing, pieces

SCHEMA = "id bigint, text string, term string, tf int, piece int"


def test_log_entropy_brute(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["alpha", "Beta", "gamma", "deltas", "xy", "ärger"], k=rng.randint(0, 30))) for _ in range(20)] + [None, "", "alpha alpha alpha", texts_dup := "Beta Beta", texts_dup]
    rows = [(i, t, "c", 1, 1) for i, t in enumerate(texts)]
    got = {(r.id, r.term): (r.tf, r.df, r.weight) for r in distinct.log_entropy(spark.createDataFrame(rows, SCHEMA), ["id"], "text").collect()}
    counts = {i: Counter(w.lower() for w in t.split() if len(w) >= 4) for i, t in enumerate(texts) if t is not None}
    n = len(counts)
    want = {}
    for term in {t for c in counts.values() for t in c}:
        tfs = {i: c[term] for i, c in counts.items() if c[term]}
        g = sum(tfs.values())
        h = -sum(x / g * math.log2(x / g) for x in tfs.values())
        for i, x in tfs.items():
            want[(i, term)] = (x, len(tfs), math.log2(1 + x) * (1 - h / math.log2(n)))
    assert got.keys() == want.keys()
    for k in want:
        assert got[k][:2] == want[k][:2] and got[k][2] == pytest.approx(want[k][2], abs=1e-9)


def test_terms_hot_path_and_min_tf(spark):
    df = spark.createDataFrame([(i, "common common rare" + str(i) if i % 2 else "common", None, None, None) for i in range(12)], SCHEMA)
    a = {(r.id, r.term, round(r.weight, 9)) for r in distinct.log_entropy(df, ["id"], "text").where("tf >= 2").collect()}
    b = {(r.id, r.term, round(r.weight, 9)) for r in distinct.log_entropy(df, ["id"], "text", min_tf=2, hot=3).collect()}
    assert a == b and len(a) == 6


def test_terms_empty(spark):
    assert distinct.log_entropy(spark.createDataFrame([], SCHEMA), ["id"], "text").count() == 0
    assert distinct.log_entropy(spark.createDataFrame([(1, None, None, None, None)], SCHEMA), ["id"], "text").count() == 0


@pytest.mark.parametrize("text", ["wort " * 2000, "x" * 10000, "Satz eins. Satz zwei!\n\n" * 400, "é" * 3001, "a" * 3000, "。".join(["漢字" * 30] * 90), "a " * 20000, "\n" * 7000])
def test_pieces_cover_and_overlap(text):
    ends = pieces.cut_points(text, 3000, 200)
    starts = [0] + [e - 200 for e in ends[:-1]]
    assert ends[-1] == len(text) and all(0 < e - s <= 3000 for s, e in zip(starts, ends)) and all(b > a for a, b in zip(ends, ends[1:]))


def test_pieces_prefer_natural_boundaries():
    text = ("Ein Satz mit Worten. " * 200).strip()
    assert all(text[:e].rstrip().endswith(".") for e in pieces.cut_points(text, 1000, 100))


@pytest.mark.parametrize("text", ["ab cd. ef, gh ij. kl mn op. qr", "abcdefghijklm\nop qrst, uvwx yz. ab", "aa bb cc dd ee ff gg hh ii jj"])
def test_pieces_optimal_on_small_input(text):
    """The search finds the cheapest cuts over all sets of cuts, whatever their number."""
    from itertools import combinations

    limit, overlap = 14, 2
    pos, pen = pieces.boundaries(text, limit, overlap)
    n, step = len(text), limit - overlap
    price, ideal = dict(zip(pos, pen)), (n - overlap) / -(-(n - overlap) // step)
    best = math.inf
    for k in range(1, 6):
        for cuts in combinations(pos, k):
            sizes = [b - a for a, b in zip([overlap, *cuts], [*cuts, n])]
            if all(2 <= s <= step for s in sizes[:-1]) and sizes[-1] <= step:
                best = min(best, sum(1 + 4 * (s / ideal - 1) ** 2 for s in sizes) + sum(price[c] for c in cuts))
    cost, cuts = pieces.cheapest_cuts(pos, pen, n, limit, overlap)
    assert cost == pytest.approx(best) and cuts[-1] == n


def test_every_boundary_is_a_candidate():
    text = "ab " * 2000
    assert pieces.boundaries(text, 3000, 200)[0] == list(range(3, 6000, 3))


@pytest.mark.parametrize(("limit", "overlap"), [(15, 6), (101, 49), (10, 0), (21, 9), (3, 0)])
def test_pieces_of_any_limit(limit, overlap):
    for text in ("x" * 500, "a\u0301" * 400, "\u0301" * 300, "wort " * 90, "ab\n\n" * 80):
        ends = pieces.cut_points(text, limit, overlap)
        starts = [0] + [e - overlap for e in ends[:-1]]
        assert ends[-1] == len(text) and all(0 < e - s <= limit for s, e in zip(starts, ends))


def test_pieces_frame(spark):
    df = spark.createDataFrame([(1, None, "x", 1, 9), (2, "", "x", 1, 9), (3, "kurz", None, None, None), (4, "wort " * 1000, "x", 1, 9), (4, "wort " * 1000, "x", 1, 9)], SCHEMA)
    got = pieces.pieces(df.withColumnRenamed("id", "key"), ["key"], "text").groupBy("key", "piece").count().collect()
    assert {(r.key, r.piece): r["count"] for r in got} == {(3, 1): 1, (4, 1): 2, (4, 2): 2}
    with pytest.raises(ValueError):
        pieces.pieces(df, ["id"], "text", 10, 9)


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_everything_and_fits(seed):
    rng = random.Random(seed)
    counts = Counter(rng.choices(range(1, 65), k=500))
    plan = packing.pack_plan(dict(counts), 64)
    used = Counter()
    for sizes, times in plan:
        assert times > 0 and sum(s * k for s, k in sizes) <= 64
        for s, k in sizes:
            used[s] += k * times
    assert used == counts
    boxes, total = sum(t for _, t in plan), sum(s * c for s, c in counts.items())
    assert boxes <= math.ceil(total / 64) * 1.05 + 1


def test_packed_frame(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["wort"] * rng.randint(1, 20)), None, None, None) for i in range(300)] + [(900, None, None, None, None), (901, "", None, None, None), (902, "wort " * 50, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    p = packing.packed(df, "id", "text", capacity=16, shards=4).cache()
    assert p.groupBy("container").agg(F.sum("size").alias("s")).where("s > 16").count() == 0
    sizes = {r.id: r.n for r in df.select("id", packing.token_count(F.col("text")).alias("n")).where("n > 0").collect()}
    assert {r.id: r.s for r in p.groupBy("id").agg(F.sum("size").alias("s")).collect()} == sizes
    assert p.groupBy("id", "piece").count().where("count > 1").count() == 0
    assert packing.packed(spark.createDataFrame([], SCHEMA), "id", "text").count() == 0


def test_token_count_against_regex(spark):
    import regex

    pat = regex.compile(packing.GPT2_SPLIT)
    texts = ["It's  fine , 12ab  x", "　　a", "  ", "don'T we're", "漢字と かな。\n\nx", "à é"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.n for r in df.select(packing.token_count(F.col("t")).alias("n")).collect()] == [len(pat.findall(t)) for t in texts]
