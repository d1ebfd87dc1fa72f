"""Problem 1: splits that keep related records together.

Records that share a key (a speaker on either side, a video) belong together. Keys are the vertices of a graph, a
record joins its keys in a star, and random-mate contraction finds the components: each round every vertex draws a coin
from a hash, tails collapse into their smallest head neighbour, edges are relabelled, loops and copies go, until no
edge is left. The collapses of a round follow from its edges; unwinding follows them back by pointer doubling. All of it
is SQL joins; the edges of each round are written to a table in the shared folder and counted as they are written. A key in a third of all records is one vertex; its edges are
made distinct before the first join and those of one side collapse as soon as it draws heads. Skewed join sides are
left to adaptive skew handling, whose other side is unique here.

Vertices are the keys themselves, "kind:key", so groups are exact.

Splits: components in the order of falling size class and hash are cut where their cumulative weight passes the given
proportions. The cumulative weight is computed in two levels (sums of at most ``2**12`` hash ranges per size class, then
a window within each range), so no task holds all components.

Defined results: records whose keys are all null are components of their own; repeated rows share their group; an
empty table gives an empty result; the proportions are normalised by their sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from averis.session import store, store_counted

MAX_ROUNDS = 200


def contract(edges: DataFrame, seed: int = 1) -> DataFrame:
    """(v, root) for every vertex that was collapsed; vertices not listed are roots. ``edges``: STRING u, v."""
    lo, hi = F.least("u", "v"), F.greatest("u", "v")
    edges, n = store_counted(edges.select(lo.alias("u"), hi.alias("v")).where("u <> v").distinct(), "edges")
    rounds = []
    while n:
        if len(rounds) == MAX_ROUNDS:
            raise RuntimeError(f"edges are left after {MAX_ROUNDS} rounds")
        heads = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(seed * 1000 + len(rounds))), F.lit(2)) == 1  # noqa: B023, E731
        tail = F.when(heads("u") & ~heads("v"), F.col("v")).when(heads("v") & ~heads("u"), F.col("u"))
        head = F.when(tail == F.col("u"), F.col("v")).otherwise(F.col("u"))
        moves = edges.select(tail.alias("t"), head.alias("h")).where("t IS NOT NULL").groupBy("t").agg(F.min("h").alias("h"))
        a, b = moves.select(F.col("t").alias("u"), F.col("h").alias("hu")), moves.select(F.col("t").alias("v"), F.col("h").alias("hv"))
        new = edges.join(a, "u", "left").join(b, "v", "left").select(F.coalesce("hu", "u").alias("u"), F.coalesce("hv", "v").alias("v"))
        edges, n = store_counted(new.where("u <> v").select(lo.alias("u"), hi.alias("v")).distinct(), "edges")
        rounds.append(moves)
    if not rounds:
        return edges.select(F.col("u").alias("v"), F.col("v").alias("root")).limit(0)
    moved = rounds[0]
    for m in rounds[1:]:
        moved = moved.unionByName(m)
    at = store(moved.select(F.col("t").alias("v"), F.col("h").alias("root")))
    reach = 1
    while reach < len(rounds):  # a chain is at most as long as there were rounds
        up = at.select(F.col("v").alias("root"), F.col("root").alias("above"))
        at = store(at.join(up, "root", "left").select("v", F.coalesce("above", "root").alias("root")))
        reach *= 2
    return at


def vertex(kind: str, key: Column) -> Column:
    return F.concat(F.lit(kind + ":"), key)


def components(records: DataFrame, row_id: str, keys: Column) -> DataFrame:
    """(row_id, root): the group of each record. ``keys``: ARRAY<STRING> of vertices, without nulls; a record without
    keys has its own id as group."""
    own = F.concat(F.lit("row:"), F.col(row_id).cast("string"))
    k = records.select(F.col(row_id), F.array_sort(F.array_distinct(keys)).alias("k")).select(row_id, F.when(F.size("k") > 0, F.col("k")).otherwise(F.array(own)).alias("k"))
    k = store(k)
    stars = k.select("k").distinct().where(F.size("k") > 1).select(F.col("k")[0].alias("u"), F.explode(F.slice("k", 2, 1 << 30)).alias("v"))
    roots = contract(stars)
    first = k.select(row_id, F.col("k")[0].alias("v"))
    return first.join(roots, "v", "left").select(row_id, F.coalesce("root", "v").alias("root"))


def assign(groups: DataFrame, row_id: str, proportions: dict[str, float], seed: int = 1, ranges: int = 12) -> DataFrame:
    """(row_id, root, split): whole groups to splits by cumulative weight."""
    weight = groups.groupBy("root").agg(F.count(F.lit(1)).alias("w"))
    h = F.xxhash64("root", F.lit(seed))
    w = store(weight.select("root", "w", (-F.floor(F.log2("w"))).cast("int").alias("class"), F.shiftrightunsigned(h, 64 - ranges).alias("range"), h.alias("h")))
    sums = w.groupBy("class", "range").agg(F.sum("w").alias("s"))  # at most 63 x 2**ranges rows
    base = sums.withColumn("base", F.sum("s").over(Window.orderBy("class", "range")) - F.col("s"))
    total = w.agg(F.sum("w")).first()[0] or 1
    inside = Window.partitionBy("class", "range").orderBy("h", "root").rowsBetween(Window.unboundedPreceding, 0)
    placed = w.withColumn("c", F.sum("w").over(inside)).join(F.broadcast(base.select("class", "range", "base")), ["class", "range"])
    middle = (F.col("base") + F.col("c") - F.col("w") / 2) / F.lit(float(total))
    whole, upto, split = sum(proportions.values()), 0.0, None
    names = list(proportions)
    for name in names[:-1]:
        upto += proportions[name] / whole
        split = F.when(middle < upto, name) if split is None else split.when(middle < upto, name)
    split = F.lit(names[-1]) if split is None else split.otherwise(names[-1])
    return groups.join(placed.select("root", split.alias("split")), "root").select(row_id, "root", "split")
