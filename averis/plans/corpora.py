"""Case building and corpus readers over documents and read_corpus_sorted, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from averis.functions.names import pair_side, speaker_key
from averis.operators import corpus as C
from averis.plans.delivery import sql_side
from averis.session import table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("author"), "topic")


_DOCS = """d AS (SELECT doc_id, source AS author, topic, md5('42|' || doc_id) AS h FROM documents WHERE topic IS NOT NULL AND source IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY topic, author ORDER BY h, doc_id) AS o FROM d),
a AS (SELECT topic, author, max(CASE WHEN o=1 THEN doc_id END) AS doc1, max(CASE WHEN o=2 THEN doc_id END) AS doc2 FROM o GROUP BY ALL HAVING count(*) >= 2)"""


def _split(seed: int, train: float = 0.4) -> str:
    return f"""s AS (SELECT *, CASE WHEN pos < round_even(n * {train}::DOUBLE, 0) THEN 'train' ELSE 'test' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY md5('{seed}|' || topic || '|' || author), author) - 1 AS pos, count(*) OVER (PARTITION BY topic) AS n FROM a))"""


_Y = "SELECT topic, split, author AS known_author, author AS unknown_author, doc1 AS known, doc2 AS unknown, 1 AS label FROM s"


@query(f"WITH {_DOCS} SELECT * FROM a")
def r02_two_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1 and R2."""
    return C.two_documents(docs(spark, sf_dir))


@query(f"WITH {_DOCS}, {_split(42)} SELECT topic, author, doc1, doc2, pos, split FROM s")
def r03_author_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.split_authors(C.two_documents(docs(spark, sf_dir)))


@query(f"""WITH {_DOCS}, {_split(42)}, w AS (SELECT *, row_number() OVER (PARTITION BY topic, split ORDER BY md5('42n|' || topic || '|' || author), author) AS i, count(*) OVER (PARTITION BY topic, split) AS m FROM s)
{_Y} UNION ALL SELECT l.topic, l.split, l.author, r.author, l.doc1, r.doc2, 0 FROM w l JOIN w r ON l.topic=r.topic AND l.split=r.split AND r.i = l.i % l.m + 1 WHERE l.m > 1""")
def r05_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Author-disjoint splits, same-author cases and rings inside the splits."""
    return C.build_cases(docs(spark, sf_dir))


@query(" UNION ALL ".join(f"""SELECT * FROM (WITH {_DOCS}, {_split(s)} SELECT *, {s} AS seed FROM ({_Y}) UNION ALL SELECT l.topic, l.split, l.author, r.author, l.doc2, r.doc1, 0, {s} FROM s l JOIN s r ON l.topic=r.topic AND r.pos = (l.pos + 1) % l.n WHERE l.n > 1)""" for s in (42, 43)))
def r06_resplit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.resplit(docs(spark, sf_dir), [42, 43])


@query(f"WITH {_DOCS} SELECT topic, author, row_number() OVER w - 1 AS pos, ntile(5) OVER w - 1 AS fold FROM a WINDOW w AS (PARTITION BY topic ORDER BY md5('7|' || topic || '|' || author), author)")
def r07_kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.kfold(C.two_documents(docs(spark, sf_dir)))


@query("""WITH d AS (SELECT doc_id, topic, row_number() OVER (PARTITION BY topic ORDER BY md5('42|' || topic || '|' || doc_id), doc_id) - 1 AS pos, count(*) OVER (PARTITION BY topic) AS n FROM documents WHERE topic IS NOT NULL)
SELECT doc_id, topic, CASE WHEN pos < round_even(n * 0.6::DOUBLE, 0) THEN 'test' ELSE 'train' END AS split FROM d""")
def r10_split_by_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in hash order, the first 60 % to test. Ranks come from counts per hash range, so no topic sits in one task."""
    d = table(spark, sf_dir, "documents").where("topic IS NOT NULL").select("doc_id", "topic")
    d = d.withColumn("h", C.order_key(42, "topic", "doc_id")).withColumn("range", F.substring("h", 1, 2))
    cells = d.groupBy("topic", "range").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("topic").orderBy("range")
    base = cells.select("topic", "range", (F.sum("c").over(w) - F.col("c")).alias("base"), F.sum("c").over(Window.partitionBy("topic")).alias("n"))
    local = F.row_number().over(Window.partitionBy("topic", "range").orderBy("h", "doc_id")) - 1
    d = d.withColumn("r", local).join(F.broadcast(base), ["topic", "range"])
    return d.select("doc_id", "topic", F.when(F.col("r") + F.col("base") < F.bround(F.col("n") * 0.6), "test").otherwise("train").alias("split"))


@query(f"""WITH {_DOCS}, {_split(42)}, c AS ({_Y}), t AS (SELECT DISTINCT topic FROM c)
SELECT x.topic || '2' || y.topic AS topic, x.topic AS source, y.topic AS target, split, count(*) AS cases FROM (SELECT topic AS src, split FROM c) c, t x, t y WHERE x.topic <> y.topic AND c.src = CASE WHEN split = 'train' THEN x.topic ELSE y.topic END GROUP BY ALL""")
def r11_cross_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ordered topic pairs: training cases of the source, test cases of the target; counted before they are paired,
    and the pairs are made from the list of topics alone."""
    c = C.same_author_cases(C.split_authors(C.two_documents(docs(spark, sf_dir)))).groupBy("topic", "split").agg(F.count(F.lit(1)).alias("cases"))
    topics = [r["topic"] for r in c.select("topic").distinct().orderBy("topic").collect()]
    pairs = spark.createDataFrame([(s, t) for s in topics for t in topics if s != t], "source string, target string")
    tr = c.where("split = 'train'").withColumnRenamed("topic", "source").join(pairs, "source")
    te = c.where("split = 'test'").withColumnRenamed("topic", "target").join(pairs, "target")
    both = tr.select("source", "target", "split", "cases").unionByName(te.select("source", "target", "split", "cases"))
    return both.select(F.concat("source", F.lit("2"), "target").alias("topic"), "source", "target", "split", "cases")


# CRC-32 has no SQL here; the order within a draw follows from it, so only sizes and draw numbers have
@query("WITH n AS (SELECT masking, topic, count(*) AS total FROM read_corpus_sorted GROUP BY ALL) SELECT masking, topic, n, draw, n AS cases FROM (SELECT *, unnest([5, 10, 20, 30, 40]) AS n FROM n), (SELECT unnest(range(1, 11)) AS draw) WHERE n <= total")
def r12_draw_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r12_learning_curve(spark, sf_dir).groupBy("masking", "topic", "n", "draw").agg(F.countDistinct("case_id").alias("cases"))


@query(None)
def r12_learning_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "read_corpus_sorted").select("masking", "topic", "case_id")
    return C.learning_curve(c, [5, 10, 20, 30, 40], 10)


@query("SELECT source AS author, md5(text) AS text_key, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY ALL")
def r13_distinct_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First occurrence of each (text, author); the text travels as its digest."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.groupBy(F.col("source").alias("author"), F.md5(F.col("text").cast("binary")).alias("text_key")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


_NAME = lambda c, n: f"lower(coalesce(nullif(trim(regexp_replace(nfc_normalize({c}), '[\\s\\x{{a0}}]+', ' ', 'g')), ''), {sql_side('pair', n)}))"
_CASES = f"c AS (SELECT case_id, masking, topic, {_NAME('known_author', 1)} AS ka, {_NAME('unknown_author', 2)} AS ua, known, unknown, label FROM read_corpus_sorted)"


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases with canonical speakers: the author fields, or the folder name where they are missing."""
    c = table(spark, sf_dir, "read_corpus_sorted")
    name = lambda a, n: F.coalesce(F.nullif(speaker_key(a), F.lit("")), F.lower(pair_side("pair", n)))
    return c.select("case_id", "masking", "topic", name("known_author", 1).alias("ka"), name("unknown_author", 2).alias("ua"), "known", "unknown", "label")


@query(f"WITH {_CASES} SELECT case_id, masking, topic, ka AS known_author, ua AS unknown_author, CASE WHEN ka = ua THEN 1 ELSE 0 END AS y, label::INT AS label FROM c")
def s02_case_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label by equality of the speakers, folder name where a field is missing."""
    return cases(spark, sf_dir).select("case_id", "masking", "topic", F.col("ka").alias("known_author"), F.col("ua").alias("unknown_author"), (F.col("ka") == F.col("ua")).cast("int").alias("y"), F.col("label").cast("int").alias("label"))


@query(f"WITH {_CASES} SELECT ka AS author, count(*) AS n_cases, count(DISTINCT md5(known)) AS n_texts FROM c WHERE known IS NOT NULL GROUP BY ka")
def d06_author_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct known texts of each author, by digest."""
    c = cases(spark, sf_dir).where("known IS NOT NULL").select(F.col("ka").alias("author"), F.md5(F.col("known").cast("binary")).alias("k"))
    per = c.groupBy("author", "k").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("author").agg(F.sum("n").alias("n_cases"), F.count(F.lit(1)).alias("n_texts"))


@query("SELECT masking, topic, count(*) AS cases, count_if(label = 1)::BIGINT AS y, count_if(label = 0)::BIGINT AS n FROM read_corpus_sorted GROUP BY ALL")
def s01_corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "read_corpus_sorted").groupBy("masking", "topic").agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.col("label") == 1).alias("y"), F.count_if(F.col("label") == 0).alias("n"))


@query(f"""WITH {_CASES}, m AS (SELECT DISTINCT masking, topic, ka AS s FROM c UNION SELECT DISTINCT masking, topic, ua FROM c)
SELECT topic, s AS speaker, count_if(masking='original')::BIGINT AS in_original, count_if(masking='posnoised')::BIGINT AS in_posnoised FROM m GROUP BY ALL HAVING count(DISTINCT masking) < 2""")
def r09_maskings_differ(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speakers of a topic that one masking has and the other lacks."""
    m = cases(spark, sf_dir).select("masking", "topic", F.explode(F.array("ka", "ua")).alias("speaker")).distinct()
    g = m.groupBy("topic", "speaker").agg(F.count_if(F.col("masking") == "original").alias("in_original"), F.count_if(F.col("masking") == "posnoised").alias("in_posnoised"))
    return g.where("in_original + in_posnoised < 2")


@query(f"""WITH {_DOCS}, {_split(42)}, w AS (SELECT *, (pos + 1) % n AS nx FROM s), k AS ({_Y} UNION ALL SELECT l.topic, l.split, l.author, r.author, l.doc2, r.doc1, 0 FROM w l JOIN w r ON l.topic=r.topic AND r.pos=l.nx WHERE l.n>1),
h AS (SELECT topic, author AS s, split AS home FROM s)
SELECT topic, split, count_if(label=1)::BIGINT AS y_cases, count_if(label=0)::BIGINT AS n_cases, max(sp) AS speakers, count_if(label=0 AND (hk<>split OR hu<>split))::BIGINT AS straddling
FROM (SELECT k.*, a.home AS hk, b.home AS hu FROM k JOIN h a ON a.topic=k.topic AND a.s=known_author JOIN h b ON b.topic=k.topic AND b.s=unknown_author)
JOIN (SELECT topic, split, count(DISTINCT s) AS sp FROM (SELECT topic, split, known_author AS s FROM k UNION SELECT topic, split, unknown_author FROM k) GROUP BY ALL) USING (topic, split) GROUP BY ALL""")
def r17_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = C.split_authors(C.two_documents(docs(spark, sf_dir)))
    return C.structure(C.same_author_cases(a).unionByName(C.ring_cases(a, 42, whole_topic=True, convention="doc2_doc1")))


@query(f"""WITH {_CASES}, e AS (SELECT DISTINCT topic, least(ka, ua) AS u, greatest(ka, ua) AS v FROM c WHERE ka <> ua), d AS (SELECT topic, s, count(*) AS degree FROM (SELECT topic, u AS s FROM e UNION ALL SELECT topic, v FROM e) GROUP BY ALL)
SELECT topic, count(*) AS speakers, any_value(edges) AS edges, max(degree) AS max_degree, count_if(degree = 2)::BIGINT AS of_degree_2, (min(degree) = 2 AND max(degree) = 2 AND any_value(edges) = count(*)) AS all_rings FROM d JOIN (SELECT topic, count(*) AS edges FROM e GROUP BY topic) USING (topic) GROUP BY topic""")
def r18_graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = cases(spark, sf_dir).where("ka <> ua").select("topic", F.least("ka", "ua").alias("u"), F.greatest("ka", "ua").alias("v")).distinct()
    d = e.select("topic", F.explode(F.array("u", "v")).alias("s")).groupBy("topic", "s").agg(F.count(F.lit(1)).alias("degree"))
    g = d.groupBy("topic").agg(F.count(F.lit(1)).alias("speakers"), F.max("degree").alias("max_degree"), F.min("degree").alias("lo"), F.count_if(F.col("degree") == 2).alias("of_degree_2"))
    return g.join(e.groupBy("topic").agg(F.count(F.lit(1)).alias("edges")), "topic").select("topic", "speakers", "edges", "max_degree", "of_degree_2", ((F.col("lo") == 2) & (F.col("max_degree") == 2) & (F.col("edges") == F.col("speakers"))).alias("all_rings"))


@query(f"""WITH {_CASES}, t AS (SELECT masking, topic, ka AS s, count(DISTINCT md5(known)) AS texts FROM c WHERE known IS NOT NULL GROUP BY ALL), a AS (SELECT masking, topic, sum(texts) AS total FROM t GROUP BY ALL)
SELECT case_id, (total - coalesce(x.texts, 0) - CASE WHEN ka <> ua THEN coalesce(y.texts, 0) ELSE 0 END)::BIGINT AS reference_texts FROM c JOIN a ON a.masking=c.masking AND a.topic=c.topic LEFT JOIN t x ON x.masking=c.masking AND x.topic=c.topic AND x.s=ka LEFT JOIN t y ON y.masking=c.masking AND y.topic=c.topic AND y.s=ua""")
def r16_reference_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of each case's reference population (texts of all other speakers), by subtraction instead of a theta join."""
    c, k = cases(spark, sf_dir), ["masking", "topic"]
    t = c.where("known IS NOT NULL").select(*k, F.col("ka").alias("s"), F.md5(F.col("known").cast("binary")).alias("k")).distinct().groupBy(*k, "s").agg(F.count(F.lit(1)).alias("texts"))
    a = t.groupBy(*k).agg(F.sum("texts").alias("total"))
    own = lambda side, out: t.select(*k, F.col("s").alias(side), F.col("texts").alias(out))
    j = c.join(a, k).join(own("ka", "x"), [*k, "ka"], "left").join(own("ua", "y"), [*k, "ua"], "left")
    return j.select("case_id", (F.col("total") - F.coalesce("x", F.lit(0)) - F.when(F.col("ka") != F.col("ua"), F.coalesce("y", F.lit(0))).otherwise(0)).alias("reference_texts"))


@query(f"""WITH {_DOCS}, p AS (SELECT topic, author, doc1 AS x, doc2 AS y FROM a), s AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY md5('5|' || topic || '|' || author), author) AS i, count(*) OVER (PARTITION BY topic) AS m FROM p)
SELECT topic, x AS doc_a, y AS doc_b, 1 AS label FROM p UNION ALL SELECT l.topic, l.x, r.y, 0 FROM s l JOIN s r ON l.topic=r.topic AND r.i = l.i % l.m + 1 WHERE l.m > 1""")
def r15_training_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same-author pairs and as many different-author ones, matched along a hash ring instead of a theta join."""
    a = C.two_documents(docs(spark, sf_dir))
    w = Window.partitionBy("topic").orderBy(C.order_key(5, "topic", "author"), "author")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n = a.withColumns({"nx": F.coalesce(F.lead("doc2").over(w), F.first("doc2").over(whole)), "m": F.count(F.lit(1)).over(Window.partitionBy("topic"))}).where("m > 1")
    return a.select("topic", F.col("doc1").alias("doc_a"), F.col("doc2").alias("doc_b"), F.lit(1).alias("label")).unionByName(n.select("topic", F.col("doc1").alias("doc_a"), F.col("nx").alias("doc_b"), F.lit(0).alias("label")))


@query(f"""WITH {_DOCS}, k AS (SELECT topic, author, row_number() OVER w - 1 AS pos, ntile(5) OVER w - 1 AS own, count(*) OVER (PARTITION BY topic) AS m FROM a WINDOW w AS (PARTITION BY topic ORDER BY md5('7|' || topic || '|' || author), author)),
e AS (SELECT topic, author AS l, author AS r, own, 'Y' AS kind FROM k UNION ALL SELECT x.topic, x.author, y.author, x.own, 'N' FROM k x JOIN k y ON x.topic = y.topic AND y.pos = (x.pos + 1) % x.m WHERE x.m > 1)
SELECT topic, fold::INT AS fold, kind, l AS known_author, r AS unknown_author, CASE WHEN own = fold THEN 'test' ELSE 'train' END AS split FROM e, (SELECT unnest(range(0, 5)) AS fold)""")
def r07_rotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.rotations(C.two_documents(docs(spark, sf_dir)))


@query(f"""WITH {_CASES}, g AS (SELECT topic, ka AS speaker, count(*) AS n, max(known) AS k, max(unknown) AS u FROM c WHERE ka = ua AND masking = 'original' GROUP BY ALL), f AS (SELECT topic, count(*) < 4 AS few FROM g GROUP BY topic)
SELECT topic, speaker, CASE WHEN n > 1 THEN 'several cases' WHEN k IS NULL OR u IS NULL THEN 'a side without text' WHEN few THEN 'too few speakers' END AS fault FROM g JOIN f USING (topic)""")
def r08_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speakers of the unmasked same-author cases with what keeps each from being used."""
    c = cases(spark, sf_dir).where("masking = 'original'").select("topic", F.col("ka").alias("known_author"), F.col("ua").alias("unknown_author"), "known", "unknown")
    return C.harvested(c).select("topic", "speaker", "fault")


@query(f"""WITH {_DOCS}, d2 AS (SELECT DISTINCT topic, author FROM d), o2 AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY md5('42|' || topic || '|' || author), author) - 1 AS pos, count(*) OVER (PARTITION BY topic) AS n FROM d2)
SELECT doc_id, d.topic, CASE WHEN pos < round_even(n * 0.6::DOUBLE, 0) THEN 'test' ELSE 'train' END AS split FROM d JOIN o2 USING (topic, author)""")
def r10_split_by_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors in hash order, the first 60 % with all their texts to test."""
    d = docs(spark, sf_dir).where("topic IS NOT NULL AND author IS NOT NULL")
    a = C.split_authors(d.select("topic", "author").distinct(), 0.6)
    return d.join(a.select("topic", "author", F.when(F.col("split") == "train", "test").otherwise("train").alias("split")), ["topic", "author"]).select("doc_id", "topic", "split")


@query(f"""WITH {_DOCS}, {_split(42)}, w AS (SELECT *, row_number() OVER (PARTITION BY topic, split ORDER BY md5('42n|' || topic || '|' || author), author) AS i, count(*) OVER (PARTITION BY topic, split) AS m FROM s),
k AS ({_Y} UNION ALL SELECT l.topic, l.split, l.author, r.author, l.doc1, r.doc2, 0 FROM w l JOIN w r ON l.topic=r.topic AND l.split=r.split AND r.i = l.i % l.m + 1 WHERE l.m > 1),
g AS (SELECT topic, known_author, unknown_author, split, count(*) OVER (PARTITION BY topic, known_author, unknown_author) AS copies FROM (SELECT DISTINCT topic, known_author, unknown_author, split FROM k)), t AS (SELECT DISTINCT topic AS other FROM k)
SELECT CASE WHEN split = 'train' THEN topic || '2' || other ELSE other || '2' || topic END AS topic, CASE WHEN split = 'train' THEN topic ELSE other END AS source, CASE WHEN split = 'train' THEN other ELSE topic END AS target, split, known_author, unknown_author, copies::INT AS copies FROM g, t WHERE other <> topic""")
def r11_crossed_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.crossed(C.build_cases(docs(spark, sf_dir)))


@query(f"""WITH RECURSIVE {_CASES}, e AS (SELECT DISTINCT topic, ka AS u, ua AS v FROM c WHERE ka <> ua UNION SELECT DISTINCT topic, ua, ka FROM c WHERE ka <> ua), r(topic, s, t) AS (SELECT topic, u, v FROM e UNION SELECT r.topic, r.s, e.v FROM r JOIN e ON r.topic = e.topic AND r.t = e.u)
SELECT topic, s AS speaker, least(s, min(t)) AS root FROM r GROUP BY topic, s""")
def r18_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = cases(spark, sf_dir).where("ka <> ua").select("topic", F.least("ka", "ua").alias("u"), F.greatest("ka", "ua").alias("v")).distinct()
    return C.connected(e).select("topic", F.col("s").alias("speaker"), "root")
