"""Problem 8: documents put into containers of fixed capacity.

Sizes are tokens. A document larger than the capacity is split into full containers and a rest; everything else stays
whole. What remains to be packed is a histogram of sizes (at most ``capacity`` rows), which the driver turns into a
plan by exact-complement hashing: sizes are indexed by single, pair and triple sums, combinations that fill a container
exactly are consumed as often as the counts of their sizes allow, and what is left is filled best fit, again as whole
patterns with multiplicities. The plan is a list of patterns, at most a few thousand, however many documents there
are. Documents learn their container by their rank within their size, found by two-level counting (no size, however
hot, is ranked in one task), and a join with the rank intervals of the plan.

Defined results: null or empty texts have size 0 and take no container (none is returned for them); ties are broken by
id; repeated rows are packed each; no two pieces of different containers share a slot.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from averis.session import store

# Fixed value: the published split pattern of GPT-2, with \s as any Unicode white space.
GPT2_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("(?U)" + GPT2_SPLIT))


def pack_plan(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns ([(size, copies in one container)], containers) that use up ``counts``."""
    left = {s: c for s, c in sorted(counts.items()) if c > 0}
    plan: list[tuple[list[tuple[int, int]], int]] = []

    def use(sizes: tuple[int, ...]) -> None:
        need: dict[int, int] = {}
        for s in sizes:
            need[s] = need.get(s, 0) + 1
        times = min(left.get(s, 0) // k for s, k in need.items())
        if times > 0:
            plan.append((sorted(need.items()), times))
            for s, k in need.items():
                left[s] -= k * times
                if not left[s]:
                    del left[s]

    if capacity in left:
        use((capacity,))
    for a in sorted(left, reverse=True):  # pairs: the complement of a is looked up
        if a in left and capacity - a in left:
            use((a, capacity - a))
    for a in sorted(left, reverse=True):  # triples: for the gap that a leaves, pairs are looked up
        gap = capacity - a
        for b in [x for x in sorted(left, reverse=True) if x <= gap]:
            if a not in left:
                break
            if b in left and gap - b in left:
                use((a, b, gap - b))
    sizes = sorted(left)
    while sizes:  # best fit: largest size first, then the largest that still fits, whole patterns at a time
        need: dict[int, int] = {}
        gap = capacity
        while True:
            i = bisect_right(sizes, gap)
            while i and need.get(sizes[i - 1], 0) >= left[sizes[i - 1]]:
                i -= 1
            if not i:
                break
            s = sizes[i - 1]
            k = min(gap // s, left[s] - need.get(s, 0))
            need[s] = need.get(s, 0) + k
            gap -= k * s
        times = min(left[s] // k for s, k in need.items())
        plan.append((sorted(need.items()), times))
        for s, k in need.items():
            left[s] -= k * times
            if not left[s]:
                del left[s]
        sizes = sorted(left)
    return plan


def sized_pieces(df: DataFrame, row_id: str, text: str, capacity: int) -> DataFrame:
    """(id, piece, n_pieces, size): one row per piece; only documents above the capacity have several."""
    n = df.select(F.col(row_id).alias("id"), token_count(F.col(text)).alias("n")).where("n > 0")
    parts = F.ceil(F.col("n") / capacity).cast("int")
    each = n.withColumn("n_pieces", parts).withColumn("piece", F.explode(F.sequence(F.lit(1), F.col("n_pieces"))))
    size = F.when(F.col("piece") < F.col("n_pieces"), capacity).otherwise(F.col("n") - capacity * (F.col("n_pieces") - 1)).cast("int")
    return each.select("id", "piece", "n_pieces", size.alias("size"))


def packed(df: DataFrame, row_id: str, text: str, capacity: int = 1024, shards: int = 256) -> DataFrame:
    """(id, piece, n_pieces, size, container BIGINT)."""
    spark = df.sparkSession
    items = store(sized_pieces(df, row_id, text, capacity).withColumn("shard", F.pmod(F.xxhash64("id", "piece"), F.lit(shards)).cast("int")), "sizes")
    cells = items.groupBy("size", "shard").agg(F.count(F.lit(1)).alias("c"))  # at most capacity x shards rows
    before = cells.withColumn("base", F.sum("c").over(Window.partitionBy("size").orderBy("shard")) - F.col("c"))
    counts = {r["size"]: r["c"] for r in cells.groupBy("size").agg(F.sum("c").alias("c")).collect()}
    rows, first, at = [], 0, dict.fromkeys(counts, 0)
    for sizes, times in pack_plan(counts, capacity):
        for s, k in sizes:
            rows.append((s, at[s], at[s] + k * times, k, first))
            at[s] += k * times
        first += times
    plan = spark.createDataFrame(rows, "size int, lo bigint, hi bigint, k int, first bigint")
    local = F.row_number().over(Window.partitionBy("size", "shard").orderBy("id", "piece")) - 1
    ranked = items.withColumn("r", local).join(F.broadcast(before.drop("c")), ["size", "shard"]).withColumn("rank", F.col("r") + F.col("base"))
    met = ranked.join(F.broadcast(plan), (ranked["size"] == plan["size"]) & (ranked["rank"] >= plan["lo"]) & (ranked["rank"] < plan["hi"])).drop(plan["size"])
    box = F.col("first") + F.floor((F.col("rank") - F.col("lo")) / F.col("k"))
    return met.select("id", "piece", "n_pieces", "size", box.cast("bigint").alias("container"))
