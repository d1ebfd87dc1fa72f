"""Building verification cases from documents: pairing, splitting, rings, folds, subsamples.

Every random order is the order of an MD5 digest of (seed, key), so results do not depend on partitioning. Windows run
over authors of a topic, never over documents: the two documents of an author are found by two minimum aggregations,
so an author with a third of all documents is merged map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from averis.session import store


def order_key(seed: int | str, *parts: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(p).cast("string") for p in parts]).cast("binary"))


def two_documents(docs: DataFrame, seed: int = 42) -> DataFrame:
    """(topic, author, doc1, doc2): authors of at least two documents, two of them in hash order. Columns topic, author, doc_id."""
    d = docs.where("topic IS NOT NULL AND author IS NOT NULL").select("topic", "author", F.struct(order_key(seed, "doc_id").alias("h"), "doc_id").alias("d"))
    first = d.groupBy("topic", "author").agg(F.min("d").alias("a"), F.max("d").alias("z")).where("a < z")
    second = d.join(first.select("topic", "author", "a"), ["topic", "author"]).where("d > a").groupBy("topic", "author").agg(F.min("a").alias("a"), F.min("d").alias("b"))
    return second.select("topic", "author", F.col("a.doc_id").alias("doc1"), F.col("b.doc_id").alias("doc2"))


def split_authors(authors: DataFrame, train: float = 0.4, seed: int = 42, by: list[str] | None = None) -> DataFrame:
    """``pos`` in hash order and ``split``: the first ``bround(n * train)`` authors of a topic train, the rest test."""
    by = by or ["topic"]
    w = Window.partitionBy(*by).orderBy(order_key(seed, *by, "author"), "author")
    d = authors.withColumns({"pos": F.row_number().over(w) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy(*by))})
    return d.withColumn("split", F.when(F.col("pos") < F.bround(F.col("n") * train), "train").otherwise("test")).drop("n")


def same_author_cases(a: DataFrame) -> DataFrame:
    return a.select("topic", "split", F.col("author").alias("known_author"), F.col("author").alias("unknown_author"), F.col("doc1").alias("known"), F.col("doc2").alias("unknown"), F.lit(1).alias("label"))


def ring_cases(a: DataFrame, seed: int = 42, whole_topic: bool = False, convention: str = "doc1_doc2") -> DataFrame:
    """Different-author cases: each author of a ring with its successor; within the split in a second hash order, or over
    the whole topic in the given order, where the side of the left author decides. A ring of one gives none."""
    if whole_topic:
        w, whole = Window.partitionBy("topic").orderBy("pos"), Window.partitionBy("topic")
    else:
        w, whole = Window.partitionBy("topic", "split").orderBy(order_key(f"{seed}n", "topic", "author"), "author"), Window.partitionBy("topic", "split")
    nxt = F.struct("author", "doc1", "doc2")
    first = F.first(nxt).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    d = a.withColumns({"right": F.coalesce(F.lead(nxt).over(w), first), "m": F.count(F.lit(1)).over(whole)}).where("m > 1")
    k, u = ("doc1", "right.doc2") if convention == "doc1_doc2" else ("doc2", "right.doc1")
    return d.select("topic", "split", F.col("author").alias("known_author"), F.col("right.author").alias("unknown_author"), F.col(k).alias("known"), F.col(u).alias("unknown"), F.lit(0).alias("label"))


def build_cases(docs: DataFrame, train: float = 0.4, seed: int = 42, convention: str = "doc1_doc2") -> DataFrame:
    a = split_authors(two_documents(docs, seed), train, seed)
    return same_author_cases(a).unionByName(ring_cases(a, seed, convention=convention))


def resplit(docs: DataFrame, seeds: list[int], train: float = 0.4) -> DataFrame:
    """One ring per topic and seed over all authors, cut by position; different-author cases may straddle the cut."""
    out = None
    for s in seeds:
        a = split_authors(two_documents(docs, 42), train, s)
        c = same_author_cases(a).unionByName(ring_cases(a, s, whole_topic=True, convention="doc2_doc1")).withColumn("seed", F.lit(s))
        out = c if out is None else out.unionByName(c)
    return out


def kfold(authors: DataFrame, k: int = 5, seed: int = 7) -> DataFrame:
    """(topic, author, pos, fold): contiguous blocks of the ring, the first n mod k one larger."""
    w = Window.partitionBy("topic").orderBy(order_key(seed, "topic", "author"), "author")
    return authors.select("topic", "author", (F.row_number().over(w) - 1).alias("pos"), (F.ntile(k).over(w) - 1).alias("fold"))


def learning_curve(cases: DataFrame, sizes: list[int], draws: int, seed: int = 11) -> DataFrame:
    """Draws 1..``draws`` of ``n`` training cases per (masking, topic), n up to the number there is. Ranks come from counts
    per hash range, so no topic sits in one task."""
    key = ["masking", "topic"]
    n = cases.groupBy(*key).agg(F.count(F.lit(1)).alias("total"))
    grid = n.withColumn("n", F.explode(F.array(*[F.lit(s) for s in sizes]))).where("n <= total").withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    tag = F.crc32(F.concat_ws("|", F.lit(str(seed)), "masking", "topic", F.col("n").cast("string"), F.col("draw").cast("string")).cast("binary"))
    d = cases.join(F.broadcast(grid.withColumn("tag", tag)), key)
    h = F.md5(F.concat_ws("|", F.col("tag").cast("string"), F.col("case_id").cast("string")).cast("binary"))
    d = d.select(*key, "n", "draw", "case_id", h.alias("h"), F.substring(h, 1, 2).alias("range"))
    cell = [*key, "n", "draw"]
    counts = d.groupBy(*cell, "range").agg(F.count(F.lit(1)).alias("c"))
    before = counts.select(*cell, "range", (F.sum("c").over(Window.partitionBy(*cell).orderBy("range")) - F.col("c")).alias("base")).where(F.col("base") < F.col("n"))
    r = F.row_number().over(Window.partitionBy(*cell, "range").orderBy("h", "case_id"))
    return d.join(before, [*cell, "range"]).withColumn("r", r + F.col("base")).where("r <= n").select(*cell, "case_id")


def structure(cases: DataFrame) -> DataFrame:
    """Per topic and split: same- and different-author cases, speakers, and different-author cases with a speaker whose
    same-author case lies in another split. Columns topic, split, known_author, unknown_author."""
    c = cases.withColumn("y", F.col("known_author") == F.col("unknown_author"))
    home = c.where("y").groupBy("topic", F.col("known_author").alias("s")).agg(F.min("split").alias("home"))
    counts = c.groupBy("topic", "split").agg(F.count_if("y").alias("y_cases"), F.count_if(~F.col("y")).alias("n_cases"))
    who = c.select("topic", "split", F.explode(F.array("known_author", "unknown_author")).alias("s")).groupBy("topic", "split").agg(F.countDistinct("s").alias("speakers"))
    j = c.where(~F.col("y")).alias("c").join(home.select("topic", F.col("s").alias("known_author"), F.col("home").alias("hk")), ["topic", "known_author"], "left").join(home.select("topic", F.col("s").alias("unknown_author"), F.col("home").alias("hu")), ["topic", "unknown_author"], "left")
    far = j.groupBy("topic", "split").agg(F.count_if((F.col("hk") != F.col("split")) | (F.col("hu") != F.col("split"))).alias("straddling"))
    return counts.join(who, ["topic", "split"]).join(far, ["topic", "split"], "left").fillna(0, ["straddling"])


def rotations(authors: DataFrame, k: int = 5, seed: int = 7) -> DataFrame:
    """(topic, fold, kind, known_author, unknown_author, split): per fold the same-author cases of its authors to test and
    of all others to train, and the different-author cases of the ring, to test where the left author is of the fold."""
    f = kfold(authors, k, seed)
    ring = Window.partitionBy("topic").orderBy("pos")
    nxt = F.coalesce(F.lead("author").over(ring), F.first("author").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    f = f.withColumns({"right": nxt, "m": F.count(F.lit(1)).over(Window.partitionBy("topic"))})
    kinds = F.array(F.struct(F.lit("Y").alias("kind"), F.col("author").alias("unknown_author")), F.struct(F.lit("N").alias("kind"), F.col("right").alias("unknown_author")))
    each = f.select("topic", F.col("author").alias("known_author"), F.col("fold").alias("own"), "m", F.inline(kinds)).where("kind = 'Y' OR m > 1")
    each = each.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return each.select("topic", "fold", "kind", "known_author", "unknown_author", F.when(F.col("own") == F.col("fold"), "test").otherwise("train").alias("split"))


def harvested(cases: DataFrame, least: int = 4) -> DataFrame:
    """(topic, speaker, known, unknown, fault) from same-author cases: each speaker must have exactly one case with both
    texts and a topic at least ``least`` speakers; what breaks this is named in ``fault`` (``harvest`` raises on it)."""
    y = cases.where(F.col("known_author") == F.col("unknown_author"))
    g = y.groupBy("topic", F.col("known_author").alias("speaker")).agg(F.count(F.lit(1)).alias("n"), F.max("known").alias("known"), F.max("unknown").alias("unknown"))
    few = g.groupBy("topic").agg((F.count(F.lit(1)) < least).alias("few"))
    fault = F.when(F.col("n") > 1, "several cases").when(F.col("known").isNull() | F.col("unknown").isNull(), "a side without text").when(F.col("few"), "too few speakers")
    return g.join(few, "topic").select("topic", "speaker", "known", "unknown", fault.alias("fault"))


def harvest(cases: DataFrame, least: int = 4) -> DataFrame:
    h = harvested(cases, least)
    bad = h.where("fault IS NOT NULL").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['topic']}, {bad[0]['speaker']}: {bad[0]['fault']}")
    return h.drop("fault")


def crossed(cases: DataFrame, topics: DataFrame | None = None) -> DataFrame:
    """(topic, source, target, split, known_author, unknown_author, copies) for all ordered pairs of topics: training
    cases of the source, test cases of the target. ``copies`` above 1 tells a case that two splits of a topic share."""
    t = (topics or cases.select("topic")).select("topic").distinct()
    lists = t.agg(F.sort_array(F.collect_set("topic")).alias("all"))  # the names of the topics alone
    kinds = cases.groupBy("topic", "known_author", "unknown_author").agg(F.collect_set("split").alias("splits")).withColumn("split", F.explode("splits"))
    other = kinds.join(F.broadcast(lists)).withColumn("other", F.explode("all")).where("other <> topic")
    train = F.col("split") == "train"
    source, target = F.when(train, F.col("topic")).otherwise(F.col("other")), F.when(train, F.col("other")).otherwise(F.col("topic"))
    return other.select(F.concat(source, F.lit("2"), target).alias("topic"), source.alias("source"), target.alias("target"), "split", "known_author", "unknown_author", F.size("splits").alias("copies"))


def connected(edges: DataFrame, by: str = "topic", most: int = 60) -> DataFrame:
    """(by, s, root): the component of every end of an edge (u, v), named by its smallest member. Smallest labels spread
    along edges and each label is replaced by its own label, so a chain halves with every round."""
    both = store(edges.select(by, F.inline(F.array(F.struct(F.col("u").alias("s"), F.col("v").alias("t")), F.struct(F.col("v").alias("s"), F.col("u").alias("t"))))).distinct(), "edges")
    label = store(both.groupBy(by, "s").agg(F.least(F.min("t"), F.col("s")).alias("root")), "labels")
    for _ in range(most):
        near = both.join(label.select(by, F.col("s").alias("t"), F.col("root").alias("r")), [by, "t"]).groupBy(by, "s").agg(F.min("r").alias("r"))
        new = label.join(near, [by, "s"]).select(by, "s", "root", F.least("root", "r").alias("low"))
        up = label.select(by, F.col("s").alias("low"), F.col("root").alias("above"))
        new = store(new.join(up, [by, "low"]).select(by, "s", F.least("low", "above").alias("root"), (F.least("low", "above") < F.col("root")).alias("moved")), "labels")
        label = new.drop("moved")
        if new.where("moved").isEmpty():
            return label
    raise RuntimeError(f"labels still move after {most} rounds")
