"""Stylometric features, vectorisers, pair algebra and embedding scores, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from averis.operators import features as FE
from averis.operators import grams as G
from averis.operators import metrics as M
from averis.operators import vectorize as V
from averis.operators.corpus import order_key
from averis.functions import text as T
from averis.plans.texts import _TOKEN, sql_sents
from averis.session import spread, store, table

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
    return spread(table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text", "topic"))


def tok(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FE.token_table(docs(spark, sf_dir))


_quote = lambda ws: ", ".join("'" + w.replace("'", "''") + "'" for w in ws)
_FW = _quote(FE.FUNCTION_WORDS)
_TAG = " ".join([r"CASE WHEN regexp_matches(token, '^\p{N}') THEN 'NUM' WHEN regexp_matches(token, '^[%&+=€$@#§°]$') THEN 'SYM' WHEN NOT regexp_matches(token, '[\p{L}\p{N}_]') THEN 'PUNCT'", *[f"WHEN lower(token) IN ({_quote(ws)}) THEN '{k}'" for k, ws in FE.CLASSES.items()], *[f"WHEN regexp_matches(token, '{r}') THEN '{k}'" for r, k in FE.SHAPES], "ELSE 'X' END"])
_TOK = rf"""t0 AS MATERIALIZED (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS pos FROM (SELECT doc_id, regexp_extract_all(text, '{_TOKEN}') AS t FROM documents WHERE text IS NOT NULL)),
t AS MATERIALIZED (SELECT *, lower(token) AS low, {_TAG} AS tag FROM t0)"""
_MARK_N = f"(SELECT doc_id, feature, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{FE.MARK_TOKEN.replace(chr(39), chr(39) * 2)}')) AS feature FROM documents WHERE text IS NOT NULL) WHERE feature IN ({_quote(FE.MARKS)}) GROUP BY ALL)"


@query(f"SELECT * FROM {_MARK_N}")
def f01_punctuation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FE.mark_counts(docs(spark, sf_dir))


@query(f"WITH {_TOK} SELECT doc_id, tag AS feature, count(*) AS n FROM t GROUP BY ALL")
def f02_tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FE.counts(tok(spark, sf_dir), "tag")


@query(rf"WITH {_TOK}, w AS (SELECT *, length(token) AS n FROM t WHERE tag NOT IN ('NUM', 'PUNCT', 'SYM')) SELECT doc_id, count(*) AS words, count(DISTINCT low) AS types, round(sum(n)/count(*), 9) AS avg_length, round(count_if(n<5)::BIGINT/count(*), 9) AS short_ratio, round(count_if(n>=8)::BIGINT/count(*), 9) AS long_ratio, round(count_if(n>=5 AND regexp_matches(token, '^\p{{Lu}}'))::BIGINT/count(*), 9) AS capital_ratio, round(count(DISTINCT low)/count(*), 9) AS type_ratio FROM w GROUP BY doc_id")
def f03_word_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FE.word_properties(tok(spark, sf_dir))


@query(f"SELECT doc_id, greatest(1, len({sql_sents('text')})) AS sentences, round(len(regexp_extract_all(text, '{_TOKEN}')) / greatest(1, len({sql_sents('text')})), 9) AS mean_length FROM documents WHERE text IS NOT NULL")
def f05_sentence_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.greatest(F.lit(1), F.size(T.sentences("text")))
    return docs(spark, sf_dir).select("doc_id", s.alias("sentences"), F.round(F.size(T.tokens("text")) / s, 9).alias("mean_length"))


@query(f"WITH {_TOK} SELECT doc_id, low AS feature, count(*) AS n FROM t WHERE low IN ({_FW}) GROUP BY ALL")
def f06_function_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spark.createDataFrame([(w,) for w in FE.FUNCTION_WORDS], "word string")
    return FE.listed(tok(spark, sf_dir), words)


_TERMS = list(dict.fromkeys([*FE.PHRASES, *[x for pair in FE.CONTRACTIONS for x in pair]]))
_COUNTS = lambda ps: ", ".join("len(regexp_extract_all(x, '(?:^|[^\\p{L}\\p{N}_])" + p.replace(" ", "  ") + "(?:$|[^\\p{L}\\p{N}_])'))::INT" for p in ps)
_MARKED = "(SELECT doc_id, regexp_replace(lower(text), '([^\\p{L}\\p{N}_])', '\\1\\1', 'g') AS x FROM documents WHERE text IS NOT NULL)"


@query(f"SELECT doc_id, feature, n FROM (SELECT doc_id, unnest([{_quote(_TERMS)}]) AS feature, unnest([{_COUNTS(_TERMS)}]) AS n FROM {_MARKED}) WHERE n > 0")
def f07_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """phrases and contractions as whole words, not overlapping."""
    return FE.phrase_counts(docs(spark, sf_dir), _TERMS)


@query("SELECT doc_id, feature, n FROM (SELECT doc_id, unnest([" + _quote(FE.PHRASES) + "]) AS feature, unnest([" + ", ".join(f"((length(text) - length(replace(lower(text), '{p}', ''))) // {len(p)})::INT" for p in FE.PHRASES) + "]) AS n FROM documents WHERE text IS NOT NULL) WHERE n > 0")
def f07_phrases_as_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FE.phrase_counts(docs(spark, sf_dir), list(FE.PHRASES), whole=False)


@query(f"SELECT doc_id, list_sum([{_COUNTS([a for a, _ in FE.CONTRACTIONS])}])::BIGINT AS contracted, list_sum([{_COUNTS([b for _, b in FE.CONTRACTIONS])}])::BIGINT AS expanded FROM {_MARKED}")
def f08_contractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FE.contraction_totals(docs(spark, sf_dir), list(FE.CONTRACTIONS))


_SPEC = r"s AS (SELECT doc_id, i, count(*) AS f FROM (SELECT doc_id, low, count(*) AS i FROM t WHERE regexp_matches(token, '\p{L}') GROUP BY ALL) GROUP BY ALL)"


@query(f"WITH {_TOK}, {_SPEC}, g AS (SELECT doc_id, sum(i*f) AS n, sum(f) AS v, sum(i*i*f) AS m2, sum(CASE WHEN i=1 THEN f ELSE 0 END) AS v1, sum(CASE WHEN i=2 THEN f ELSE 0 END) AS v2 FROM s GROUP BY doc_id) SELECT doc_id, round(CASE WHEN m2>v THEN v*v/(m2-v) ELSE 0.0 END, 9) AS yule_i, round(v1/n, 9) AS hapax, round(v2/n, 9) AS dis FROM g")
def f09_yule_hapax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FE.yule_hapax(tok(spark, sf_dir))


_Z = lambda ok, x: f"coalesce(CASE WHEN {ok} THEN CASE WHEN isnan({x}) THEN 0.0 ELSE {x} END END, 0.0)"
_RICH = {
    "ttr": "v/n", "guiraud_r": "v/sqrt(n)", "herdan_c": _Z("n > 1", "(lv/ln)"), "dugast_k": _Z("ln > 1", "(lv/ln(ln))"), "maas_a2": _Z("n > 1", "((ln-lv)/(ln*ln))"), "dugast_u": _Z("n > v", "(ln*ln/(ln-lv))"),
    "tuldava_ln": _Z("n > 1", "((1-v*v)/(v*v*ln))"), "brunet_w": "pow(n, pow(v, -0.172::DOUBLE))", "cttr": "v/sqrt(2*n)", "summer_s": _Z("lv > 0 AND ln > 1", "(ln(lv)/ln(ln))"), "sichel_s": "v2/v", "michea_m": _Z("v2 > 0", "(v/v2)"),
    "honore_h": _Z("v > v1", "(100*ln/(1-v1/v))"), "herdan_vm": _Z("sp2 >= 1/v", "sqrt(sp2-1/v)"), "entropy": "entropy", "yule_k": "10000*(s2-n)/(n*n)", "simpson_d": _Z("n > 1", "(si/(n-1))"),
}


@query(rf"""WITH {_TOK}, q AS (SELECT doc_id, low, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1) // 1000 AS w FROM t WHERE regexp_matches(token, '\p{{L}}')),
s AS (SELECT doc_id, w, i::DOUBLE AS i, count(*)::DOUBLE AS f FROM (SELECT doc_id, w, low, count(*) AS i FROM q GROUP BY ALL) GROUP BY ALL), s2 AS (SELECT *, sum(i*f) OVER (PARTITION BY doc_id, w) AS n FROM s),
g AS (SELECT doc_id, w, max(n) AS n, sum(f) AS v, sum(CASE WHEN i=1 THEN f ELSE 0 END) AS v1, sum(CASE WHEN i=2 THEN f ELSE 0 END) AS v2, sum(i*i*f) AS s2, sum(f*(i/n)*(i/n)) AS sp2, sum(-f*(i/n)*ln(i/n)) AS entropy, sum(f*(i/n)*(i-1)) AS si, ln(max(n)) AS ln, ln(sum(f)) AS lv FROM s2 GROUP BY ALL),
e AS (SELECT doc_id, {', '.join(f'{x} AS {k}' for k, x in _RICH.items())} FROM g) SELECT doc_id, {', '.join(f'round(avg({k}), 6) AS {k}' for k in _RICH)} FROM e GROUP BY doc_id""")
def f16_richness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FE.richness(tok(spark, sf_dir))


@query(rf"""WITH b AS (SELECT doc_id, list_filter(regexp_extract_all(text, '{_TOKEN}'), lambda x: regexp_matches(x, '\p{{L}}')) AS w, greatest(1, len({sql_sents('text')}))::DOUBLE AS s FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, s, len(w)::DOUBLE AS n, list_sum(list_transform(w, lambda x: length(x)))::DOUBLE AS c, list_transform(w, lambda x: greatest(1, len(regexp_extract_all(lower(x), '[aeiouyäöüáàâéèêíìîóòôúùû]+')))) AS y FROM b WHERE len(w) > 0),
d AS (SELECT *, list_sum(y)::DOUBLE AS syl, len(list_filter(y, lambda x: x >= 3))::DOUBLE AS poly FROM c)
SELECT doc_id, round(206.835::DOUBLE - 1.015::DOUBLE*n/s - 84.6::DOUBLE*syl/n, 6) AS flesch_en, round(180 - n/s - 58.5::DOUBLE*syl/n, 6) AS amstad_de, round(0.39::DOUBLE*n/s + 11.8::DOUBLE*syl/n - 15.59::DOUBLE, 6) AS kincaid, round(1.043::DOUBLE*sqrt(poly*30/s) + 3.1291::DOUBLE, 6) AS smog, round(5.88::DOUBLE*c/n - 29.6::DOUBLE*s/n - 15.8::DOUBLE, 6) AS coleman_liau, round(4.71::DOUBLE*c/n + 0.5::DOUBLE*n/s - 21.43::DOUBLE, 6) AS ari, round(0.4::DOUBLE*(n/s + 100*poly/n), 6) AS fog, round(CASE WHEN li > 20 THEN li/2 ELSE (li-2)/2 END, 6) AS linsear, poly AS difficult_words, round(0.1579::DOUBLE*100*poly/n + 0.0496::DOUBLE*n/s + CASE WHEN 100*poly/n > 5 THEN 3.6365::DOUBLE ELSE 0 END, 6) AS dale_chall
FROM (SELECT *, (len(y[1:100]) + 2*len(list_filter(y[1:100], lambda x: x >= 3))) / greatest(1.0::DOUBLE, s * least(1.0::DOUBLE, 100/n)) AS li FROM d)""")
def f11_readability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FE.readability(docs(spark, sf_dir))


@query(f"WITH {_TOK} SELECT doc_id, sum(length(token))::BIGINT AS chars, round(sum(length(token))/count(*), 9) AS avg_chars, " + ", ".join(f"round(count_if(length(token)={k})::BIGINT/count(*), 9) AS len_{k}" for k in range(1, 11)) + " FROM t GROUP BY doc_id")
def f15_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FE.length_histogram(tok(spark, sf_dir))


@query(f"WITH {_TOK}, g AS (SELECT doc_id, tag, count(DISTINCT low) AS types, avg(length(token)) AS len FROM t GROUP BY ALL) SELECT doc_id, tag, round(types / sum(types) OVER (PARTITION BY doc_id), 9) AS share, round(len, 9) AS avg_length FROM g")
def f18_tag_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = tok(spark, sf_dir).groupBy("doc_id", "tag", "low").agg(F.sum(F.length("token")).alias("c"), F.count(F.lit(1)).alias("n"))
    g = types.groupBy("doc_id", "tag").agg(F.count(F.lit(1)).alias("types"), (F.sum("c") / F.sum("n")).alias("len"))
    return g.select("doc_id", "tag", F.round(F.col("types") / F.sum("types").over(Window.partitionBy("doc_id")), 9).alias("share"), F.round("len", 9).alias("avg_length"))


@query(f"""WITH l AS (SELECT doc_id, list_transform({sql_sents('text')}, lambda s: len(regexp_extract_all(s, '{_TOKEN}'))) AS l FROM documents WHERE text IS NOT NULL), e AS (SELECT doc_id, l, unnest(range(3, least(69, greatest(3, list_max(l))) + 1)) AS i FROM l WHERE len(l) > 0)
SELECT doc_id, i::INT AS i, round(len(list_filter(l, lambda x: x >= i)) / len(l), 9) AS share FROM e WHERE len(list_filter(l, lambda x: x >= i)) > 0""")
def f20_sentence_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FE.sentence_lengths(docs(spark, sf_dir))


# ---- vectorisers ----
def _counted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Word 1- and 2-grams of every document, default token pattern (two word characters at least)."""
    d = docs(spark, sf_dir)
    w = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    return store(V.counted(d, V.array_grams(w, 1, 2)), "grams"), d.count()


_GRAMS = r"""w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS w FROM documents WHERE text IS NOT NULL), nd AS (SELECT count(*) AS nd FROM w),
c AS (SELECT doc_id, feature, count(*) AS n FROM (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1]))) AS feature FROM w) GROUP BY ALL),
v AS (SELECT feature, count(*) AS df, sum(n)::BIGINT AS total, ln((1.0::DOUBLE + any_value(nd)) / (1 + count(*))) + 1 AS idf FROM c, nd GROUP BY feature HAVING count(*) >= 0.1::DOUBLE * any_value(nd)),
x AS (SELECT doc_id, feature, n * idf AS value FROM c JOIN v USING (feature)),
y AS (SELECT doc_id, feature, value / sqrt(sum(value*value) OVER (PARTITION BY doc_id)) AS value FROM x)"""


@query(f"WITH {_GRAMS} SELECT doc_id, feature, round(value, 6) AS value FROM y")
def v01_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = _counted(spark, sf_dir)
    return V.tfidf(c, V.vocabulary(c, n)).select("doc_id", "feature", F.round("value", 6).alias("value"))


_BLANK = r"[ \t\n\r\x{0b}\f\x{85}\x{a0}\x{2000}-\x{200a}\x{202f}\x{3000}]"
_WEIGHTED = "{0}v AS (SELECT feature, count(*) AS df, sum(n) AS total, ln((1.0::DOUBLE + any_value(nd)) / (1 + count(*))) + 1 AS idf FROM {0}c, nd GROUP BY feature HAVING count(*) >= 0.1::DOUBLE * any_value(nd){1}), {0}y AS (SELECT doc_id, feature, value / sqrt(sum(value*value) OVER (PARTITION BY doc_id)) AS value FROM (SELECT doc_id, feature, n * idf AS value FROM {0}c JOIN {0}v USING (feature)))"
_ND = "nd AS (SELECT count(*) AS nd FROM documents WHERE text IS NOT NULL)"


@query(rf"""WITH {_ND}, w AS (SELECT doc_id, ' ' || unnest(list_filter(regexp_split_to_array(lower(text), '{_BLANK}+'), lambda x: x <> '')) || ' ' AS p FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, feature, count(*) AS n FROM (SELECT doc_id, unnest(list_concat(list_transform(range(1, length(p) + 1), lambda i: substr(p, i, 1)), list_concat(list_transform(range(1, length(p)), lambda i: substr(p, i, 2)), list_transform(range(1, length(p) - 1), lambda i: substr(p, i, 3))))) AS feature FROM w) GROUP BY ALL),
{_WEIGHTED.format('', '')} SELECT doc_id, feature, round(value, 6) AS value FROM y""")
def v01_char_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character 1- to 3-grams inside words; features in a tenth of the documents at least."""
    d = docs(spark, sf_dir)
    c = store(V.counted(d, V.char_wb(F.col("text"), 1, 3)), "chars")
    return V.tfidf(c, V.vocabulary(c, d.count())).select("doc_id", "feature", F.round("value", 6).alias("value"))


_TOP = " ORDER BY total DESC, feature LIMIT 2000"
_N_GRAMS = lambda w, lo, hi: "list_concat(" + f"list_transform(range(1, len({w}) + 1), lambda i: {w}[i]), " + "list_concat(" + ", ".join(f"list_transform(range(1, greatest(1, len({w}) - {n - 2})), lambda i: array_to_string({w}[i:i+{n - 1}], ' '))" for n in (2, 3)) + "))"


@query(rf"""WITH {_TOK}, {_ND}, x AS (SELECT doc_id, regexp_replace(lower(text), '{_BLANK}{{2,}}', ' ', 'g') AS x, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}') AS w FROM documents WHERE text IS NOT NULL),
cc AS (SELECT doc_id, feature, count(*) AS n FROM (SELECT doc_id, unnest({' || '.join(f'list_transform(range(1, greatest(1, length(x) - {n - 2})), lambda i: substr(x, i, {n}))' for n in (3, 4, 5, 6))}) AS feature FROM x) GROUP BY ALL),
wc AS (SELECT doc_id, feature, count(*) AS n FROM (SELECT doc_id, unnest({_N_GRAMS('w', 1, 3)}) AS feature FROM x) GROUP BY ALL),
q AS (SELECT doc_id, list(lower(tag) ORDER BY pos) AS w FROM t WHERE tag NOT IN ('PUNCT', 'SYM', 'X') GROUP BY doc_id),
pc AS (SELECT doc_id, feature, count(*) AS n FROM (SELECT doc_id, unnest({_N_GRAMS('w', 1, 3)}) AS feature FROM q) GROUP BY ALL),
{', '.join(_WEIGHTED.format(k, _TOP) for k in 'cwp')} SELECT doc_id, 'char:' || feature AS feature, round(value, 6) AS value FROM cy UNION ALL SELECT doc_id, 'word:' || feature, round(value, 6) FROM wy UNION ALL SELECT doc_id, 'pos:' || feature, round(value, 6) FROM py""")
def v08_ngram_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8, V9: characters 3..6, words 1..3 and tags 1..3, each with its 2,000 features of highest total."""
    return ngram_blocks(docs(spark, sf_dir)).select("doc_id", "feature", F.round("value", 6).alias("value"))


def ngram_blocks(d: DataFrame) -> DataFrame:
    """Counted and weighed a document at a time (``operators.grams``); rows of one doc_id are one document."""
    spark = d.sparkSession
    blocks = {"char": G.Block(G.characters(3, 6), top=2000), "word": G.Block(lambda p: G.grams(p["word2"], 1, 3), top=2000), "pos": G.Block(lambda p: G.grams([k.lower() for k in G.word_tags(p)], 1, 3), top=2000)}
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    x = d.repartition(tasks, "doc_id").groupBy("doc_id").agg(F.collect_list("text").alias("texts"))
    x = x.select(F.lit("").alias("corpus"), "doc_id", F.transform("texts", lambda t: F.struct(*[G.SOURCES[n](t).alias(n) for n in ("chars", "word2", "toks")])).alias("parts"))
    size = spark.range(1).select(F.lit("").alias("corpus"), F.lit(d.count()).alias("docs"))
    v = G.vocabulary(G.counted(x.select("corpus", "parts"), blocks), size, blocks)
    return G.rows(x.where("doc_id IS NOT NULL"), blocks, v)


@query(f"WITH {_GRAMS} SELECT feature, round(sum(value)/any_value(nd), 6) AS mean, round(CASE WHEN greatest(0, sum(value*value)/any_value(nd) - pow(sum(value)/any_value(nd), 2)) < 1e-18 THEN 1.0 ELSE sqrt(greatest(0, sum(value*value)/any_value(nd) - pow(sum(value)/any_value(nd), 2))) END, 6) AS sd FROM y, nd GROUP BY feature")
def v10_scaler(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = _counted(spark, sf_dir)
    return V.scaler(V.tfidf(c, V.vocabulary(c, n)), n).select("feature", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query(f"""WITH {_GRAMS}, k AS (SELECT doc_id, topic AS label FROM documents WHERE topic IS NOT NULL AND text IS NOT NULL), m AS (SELECT count(*) AS m FROM k), p AS (SELECT label, count(*)/any_value(m) AS p FROM k, m GROUP BY label),
o AS (SELECT feature, label, sum(n)::DOUBLE AS o FROM c JOIN v USING (feature) JOIN k USING (doc_id) GROUP BY ALL), s AS (SELECT feature, sum(o) AS t FROM o GROUP BY feature)
SELECT feature, round(sum(pow(coalesce(o, 0) - t*p, 2)/(t*p)), 6) AS chi2 FROM s CROSS JOIN p LEFT JOIN o USING (feature, label) GROUP BY feature""")
def v13_chi2(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = _counted(spark, sf_dir)
    lab = docs(spark, sf_dir).where("topic IS NOT NULL").select("doc_id", F.col("topic").alias("label"))
    x = c.join(V.vocabulary(c, n).select("feature"), "feature").select("doc_id", "feature", F.col("n").cast("double").alias("value"))
    return V.chi2(x, lab, lab.count()).select("feature", F.round("chi2", 6).alias("chi2"))


# ---- pairs and embeddings ----
_EMB = "e AS (SELECT vec_id, embedding AS v, label AS author, md5('42|' || vec_id) AS h FROM embeddings), o AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY h, vec_id) AS o FROM e), k AS (SELECT a.author AS ka, b.author AS ua, a.vec_id AS x, b.vec_id AS y, a.v AS p, b.v AS q, (a.author = b.author)::INT AS label, a.o AS pos FROM o a JOIN o b ON a.o % 2 = 1 AND b.o = a.o + 1 AND (a.author = b.author OR b.author = (a.author + 1) % 10))"


def embedding_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases from embeddings: the (2i-1)-th vector of an author with the 2i-th of the same and of the next author."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"), F.col("label").alias("author"))
    o = e.withColumn("o", F.row_number().over(Window.partitionBy("author").orderBy(order_key(42, "vec_id"), "vec_id")))
    a = o.where("o % 2 = 1").select(F.col("author").alias("ka"), F.col("vec_id").alias("x"), F.col("v").alias("p"), F.col("o").alias("pos"), (F.col("o") + 1).alias("o2"), F.explode(F.array("author", (F.col("author") + 1) % 10)).alias("ua"))
    b = o.select(F.col("author").alias("ua"), F.col("vec_id").alias("y"), F.col("v").alias("q"), F.col("o").alias("o2"))
    return a.join(b, ["ua", "o2"]).withColumn("label", (F.col("ka") == F.col("ua")).cast("int"))


@query(f"WITH {_EMB} SELECT x, y, ka, ua, label, round(list_cosine_similarity(p::DOUBLE[], q::DOUBLE[]), 6) AS score FROM k")
def m06_embedding_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frozen encoder vectors, cosine of each case."""
    return embedding_cases(spark, sf_dir).select("x", "y", "ka", "ua", "label", F.round(V.cosine(F.col("p"), F.col("q")), 6).alias("score"))


# the embeddings are not z-scored features of texts; they stand in for the interpretable vectors
_RSP = f"""{_EMB}, s AS (SELECT x, y, label, pos % 5 < 2 AS train, list_cosine_similarity(p::DOUBLE[], q::DOUBLE[]) AS s FROM k), r AS (SELECT *, CASE WHEN label=1 THEN 1 ELSE -1 END - s AS target FROM s),
f AS (SELECT regr_slope(target, s) AS w, regr_intercept(target, s) AS b FROM r WHERE train), h AS (SELECT r.*, b + w * s AS residual, s + b + w * s AS score FROM r, f),
tr AS (SELECT score, label FROM h WHERE train), xx AS (SELECT DISTINCT score AS x FROM tr), mid AS (SELECT (x + lead(x) OVER (ORDER BY x))/2 AS t FROM xx),
cc AS (SELECT t FROM mid WHERE t IS NOT NULL UNION ALL SELECT min(x)-0.001 FROM xx UNION ALL SELECT max(x)+0.0005 FROM xx),
th AS (SELECT t FROM (SELECT t, sum(CASE WHEN (score > t) = (label = 1) THEN 1 ELSE 0 END) AS good FROM cc, tr GROUP BY t) ORDER BY good DESC, t LIMIT 1),
z AS (SELECT h.*, score > round(t, 9) AS same, CASE WHEN score > round(t, 9) THEN 1 + s ELSE 1 - s END AS num FROM h, th), zz AS (SELECT *, CASE WHEN num + abs(residual) = 0 THEN 0.0 ELSE num / (num + abs(residual)) END AS confidence FROM z)"""


def _residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base similarity s, its residual target, the residual predicted by a line fitted on the training cases, the class
    predicted by the accuracy threshold of s + residual, and the confidence."""
    r = embedding_cases(spark, sf_dir).select("x", "y", "label", (F.col("pos") % 5 < 2).alias("train"), V.cosine(F.col("p"), F.col("q")).alias("s"))
    r = store(r.withColumn("target", F.when(F.col("label") == 1, 1.0).otherwise(-1.0) - F.col("s")), "residuals")
    f = r.where("train").agg(F.regr_slope("target", "s").alias("w"), F.regr_intercept("target", "s").alias("b"))
    h = r.join(F.broadcast(f)).withColumn("residual", F.col("b") + F.col("w") * F.col("s")).withColumn("score", F.col("s") + F.col("residual")).withColumn("corpus", F.lit("emb"))
    t = M.accuracy_threshold(h.where("train"), ["corpus"], ends=None, truth="label")
    d = M.decide(h, t, ["corpus"], strict=True)
    return d.withColumn("confidence", M.interpretability(F.col("s"), F.col("residual"), F.col("y_hat") == 1))


@query(f"WITH {_RSP} SELECT x, y, round(s, 6) AS s, round(target, 6) AS target, round(residual, 5) AS residual, same::INT AS y_pred, round(confidence, 5) AS confidence FROM zz")
def m15_residual_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base similarity, residual target and prediction, interpretability confidence of the predicted class."""
    return _residuals(spark, sf_dir).select("x", "y", F.round("s", 6).alias("s"), F.round("target", 6).alias("target"), F.round("residual", 5).alias("residual"), F.col("y_hat").alias("y_pred"), F.round("confidence", 5).alias("confidence"))


@query(f"WITH {_RSP} SELECT round(avg(confidence), 5) AS mean, round(median(confidence), 5) AS median, round(avg((confidence >= 0.5)::INT), 5) AS share FROM zz WHERE NOT train")
def m16_confidence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("confidence")
    return _residuals(spark, sf_dir).where("NOT train").agg(F.round(F.avg(c), 5).alias("mean"), F.round(F.median(c), 5).alias("median"), F.round(F.avg((c >= 0.5).cast("int")), 5).alias("share"))


@query(f"WITH {_GRAMS}, p AS (SELECT doc_id AS pair_id, doc_id AS a, lead(doc_id) OVER (PARTITION BY topic ORDER BY doc_id) AS b FROM documents WHERE topic = 'math' AND text IS NOT NULL), l AS (SELECT pair_id, a AS doc_id, 1.0::DOUBLE AS s FROM p WHERE b IS NOT NULL UNION ALL SELECT pair_id, b, -1.0::DOUBLE FROM p WHERE b IS NOT NULL) SELECT pair_id, round(sum(abs(d)), 5) AS l1, round(max(abs(d)), 6) AS top, count(*) AS features FROM (SELECT pair_id, feature, sum(s*value) AS d FROM l JOIN y USING (doc_id) GROUP BY ALL) WHERE abs(d) > 1e-12 GROUP BY pair_id")
def p01_pair_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring documents of a topic; |x1 - x2| over the union of their features."""
    c, n = _counted(spark, sf_dir)
    d = docs(spark, sf_dir).where("topic = 'math'").select("doc_id", "topic")
    p = d.select(F.col("doc_id").alias("pair_id"), F.col("doc_id").alias("a"), F.lead("doc_id").over(Window.partitionBy("topic").orderBy("doc_id")).alias("b")).where("b IS NOT NULL")
    v = V.pair_difference(p, V.tfidf(c, V.vocabulary(c, n)))
    return v.groupBy("pair_id").agg(F.round(F.sum("value"), 5).alias("l1"), F.round(F.max("value"), 6).alias("top"), F.count(F.lit(1)).alias("features"))


@query(f"WITH {_EMB} SELECT x, y, round(list_sum(list_transform(range(1, 65), lambda i: abs(p[i]::DOUBLE - q[i]::DOUBLE))), 6) AS l1, 192 AS width FROM k")
def p02_combination(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = embedding_cases(spark, sf_dir).select("x", "y", F.transform("p", lambda v: v.cast("double")).alias("p"), F.transform("q", lambda v: v.cast("double")).alias("q"))
    m = V.combine(F.col("p"), F.col("q"), "featsdiffabs")
    return c.select("x", "y", F.round(F.aggregate(F.slice(m, 129, 64), F.lit(0.0), lambda a, v: a + v), 6).alias("l1"), F.size(m).alias("width"))


@query(f"WITH {_EMB}, s AS (SELECT 'emb' AS topic, CASE WHEN pos % 5 < 2 THEN 'train' ELSE 'test' END AS split, label AS y_true, list_cosine_similarity(p::DOUBLE[], q::DOUBLE[]) AS score FROM k) SELECT split, count(*) AS n, sum(y_true)::BIGINT AS y, round(avg(score), 6) AS mean_score FROM s GROUP BY split")
def flagship_embedding_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = embedding_cases(spark, sf_dir).select(F.when(F.col("pos") % 5 < 2, "train").otherwise("test").alias("split"), "label", V.cosine(F.col("p"), F.col("q")).alias("score"))
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("y"), F.round(F.avg("score"), 6).alias("mean_score"))


@query(None)
def flagship_embedding_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frozen-encoder method end to end: cases, cosine, threshold on train, metrics on test."""
    s = embedding_cases(spark, sf_dir).select(F.lit("emb").alias("topic"), F.when(F.col("pos") % 5 < 2, "train").otherwise("test").alias("split"), F.col("label").alias("y_true"), V.cosine(F.col("p"), F.col("q")).alias("score"))
    t = M.eer_threshold(s.where("split = 'train'"), ["topic"])
    return M.metrics(M.decide(s.where("split = 'test'"), t, ["topic"]).withColumnRenamed("y_hat", "y_pred"), ["topic"])


# ---- further blocks ----
#: Example dictionaries; readers.misspellings reads whole ones from files in the four usual formats.
DICTIONARIES = {"misspelled": ("nähmlich", "standart", "vorraus", "recieve"), "typos": ("teh", "adn", "wier", "udn"), "british": ("colour", "centre", "favourite", "metre"), "determiner": ("te", "th", "thee", "dei")}


@query(f"WITH {_TOK}, x(dictionary, low) AS (VALUES {', '.join(f'({chr(39)}{d}{chr(39)}, {chr(39)}{w}{chr(39)})' for d, ws in DICTIONARIES.items() for w in ws)}), l AS (SELECT doc_id, count(*) AS l FROM t GROUP BY doc_id) SELECT doc_id, dictionary, count(*) AS hits, round(count(*) / any_value(l), 9) AS ratio FROM t JOIN x USING (low) JOIN l USING (doc_id) GROUP BY ALL")
def f17_misspelling_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the tokens that each dictionary holds, where it holds any."""
    words = spark.createDataFrame([(d, w) for d, ws in DICTIONARIES.items() for w in ws], "dictionary string, word string")
    t = tok(spark, sf_dir)
    l = t.groupBy("doc_id").agg(F.count(F.lit(1)).alias("l"))
    return FE.listed(t, words, by="dictionary").join(l, "doc_id").select("doc_id", F.col("feature").alias("dictionary"), F.col("n").alias("hits"), F.round(F.col("n") / F.col("l"), 9).alias("ratio"))


@query(rf"""WITH {_TOK} SELECT doc_id, count_if(tag='NOUN')::BIGINT AS nouns, round(count_if(low IN ({_FW}))/count(*), 9) AS function_ratio, count_if(tag='VERB')::BIGINT AS verbs, round(sum(CASE WHEN regexp_matches(token, '^\p{{L}}+$') THEN length(token) ELSE 0 END)/greatest(1, count_if(regexp_matches(token, '^\p{{L}}+$'))), 9) AS alpha_length FROM t GROUP BY doc_id""")
def f19_style_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    alpha = F.col("token").rlike(r"^\p{L}+$")
    return tok(spark, sf_dir).groupBy("doc_id").agg(
        F.count_if(F.col("tag") == "NOUN").alias("nouns"), F.round(F.count_if(F.col("low").isin(*FE.FUNCTION_WORDS)) / F.count(F.lit(1)), 9).alias("function_ratio"), F.count_if(F.col("tag") == "VERB").alias("verbs"),
        F.round(F.sum(F.when(alpha, F.length("token")).otherwise(0)) / F.greatest(F.lit(1), F.count_if(alpha)), 9).alias("alpha_length"),
    )


def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, tags): the tag of every token, in order, marks and symbols as themselves."""
    d = docs(spark, sf_dir)
    return d.select("doc_id", F.transform(T.tokens("text"), lambda t: F.when(FE.tag(t).isin("PUNCT", "SYM"), t).otherwise(FE.tag(t))).alias("tags"), "text")


_TAGS = f"g0 AS (SELECT doc_id, list(CASE WHEN tag IN ('PUNCT', 'SYM') THEN token ELSE tag END ORDER BY pos) AS w FROM t GROUP BY doc_id), c AS (SELECT doc_id, feature, count(*) AS n FROM (SELECT doc_id, unnest({_N_GRAMS('w', 1, 3)}) AS feature FROM g0) GROUP BY ALL)"
_IDF = "nd AS (SELECT count(*) AS nd FROM documents WHERE text IS NOT NULL), v AS (SELECT feature, ln((1.0::DOUBLE + any_value(nd)) / (1 + count(*))) + 1 AS idf FROM c, nd GROUP BY feature HAVING count(*) >= {} * any_value(nd))"


@query(f"WITH {_TOK}, {_TAGS}, {_IDF.format('0.1::DOUBLE')} SELECT doc_id, feature, round(value / sqrt(sum(value*value) OVER (PARTITION BY doc_id)), 6) AS value FROM (SELECT doc_id, feature, n * idf AS value FROM c JOIN v USING (feature))")
def v02_tag_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tags(spark, sf_dir)
    c = store(V.counted(t, V.array_grams(F.col("tags"), 1, 3)), "tags")
    return V.tfidf(c, V.vocabulary(c, t.count())).select("doc_id", "feature", F.round("value", 6).alias("value"))


#: The special characters counted one by one.
SPECIAL_CHARS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{¦}~"
_SPECIAL = "[" + "".join("\\" + c if c in "\\]^-[" else c for c in SPECIAL_CHARS) + "]"


@query(f"WITH c AS (SELECT doc_id, feature, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_SPECIAL.replace(chr(39), chr(39) * 2)}')) AS feature FROM documents WHERE text IS NOT NULL) GROUP BY ALL), {_IDF.format('0::DOUBLE')}, y AS (SELECT doc_id, feature, n * idf AS value FROM c JOIN v USING (feature)) SELECT doc_id, feature, round(value / sqrt(sum(value*value) OVER (PARTITION BY doc_id)), 6) AS value FROM y")
def v03_special_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed vocabulary of characters, no pruning, unit length."""
    d = docs(spark, sf_dir)
    c = store(V.counted(d, F.regexp_extract_all(F.col("text"), F.lit(_SPECIAL), F.lit(0))), "special")
    return V.tfidf(c, V.vocabulary(c, d.count(), min_df=0.0)).select("doc_id", "feature", F.round("value", 6).alias("value"))


@query(f"WITH {_TOK}, c AS (SELECT doc_id, low AS feature, count(*) AS n FROM t WHERE low IN ({_FW}) GROUP BY ALL), {_IDF.format('0::DOUBLE')}, l AS (SELECT doc_id, count(*) AS l FROM t GROUP BY doc_id) SELECT doc_id, feature, round(n * idf / (1 + l), 9) AS value FROM c JOIN v USING (feature) JOIN l USING (doc_id)")
def v04_function_word_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tf x idf of function words over one plus the number of tokens, no norm."""
    t = tok(spark, sf_dir)
    c = store(FE.counts(t.where(F.col("low").isin(*FE.FUNCTION_WORDS)), "low"), "fw")
    l = t.groupBy("doc_id").agg(F.count(F.lit(1)).alias("l"))
    v = V.tfidf(c, V.vocabulary(c, docs(spark, sf_dir).count(), min_df=0.0), norm=False)
    return v.join(l, "doc_id").select("doc_id", "feature", F.round(F.col("value") / (1 + F.col("l")), 9).alias("value"))


@query(f"WITH {_TOK}, g0 AS (SELECT doc_id, list(CASE WHEN low IN ({_FW}) THEN low ELSE tag END ORDER BY pos) AS w FROM t GROUP BY doc_id), c AS (SELECT doc_id, feature, count(*) AS n FROM (SELECT doc_id, unnest({_N_GRAMS('w', 1, 3)}) AS feature FROM g0) GROUP BY ALL), {_IDF.format('0.1::DOUBLE')} SELECT doc_id, feature, round(value / sqrt(sum(value*value) OVER (PARTITION BY doc_id)), 6) AS value FROM (SELECT doc_id, feature, n * idf AS value FROM c JOIN v USING (feature))")
def v05_masked_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Function words as themselves, everything else as its tag; TF-IDF of the 1- to 3-grams."""
    d = docs(spark, sf_dir)
    masked = F.transform(T.tokens("text"), lambda t: F.when(F.lower(t).isin(*FE.FUNCTION_WORDS), F.lower(t)).otherwise(FE.tag(t)))
    c = store(V.counted(d, V.array_grams(masked, 1, 3)), "masked")
    return V.tfidf(c, V.vocabulary(c, d.count())).select("doc_id", "feature", F.round("value", 6).alias("value"))


@query(f"WITH {_TOK}, g AS (SELECT doc_id, string_agg(tag || ' ', '' ORDER BY pos) AS s FROM t GROUP BY doc_id), c AS (SELECT doc_id, unnest(list_filter(string_split(regexp_replace(s, '{FE.CHUNK}', 'NP ', 'g'), ' '), lambda x: x <> '')) AS feature FROM g) SELECT doc_id, feature, count(*) AS n FROM c GROUP BY ALL")
def n06_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags with noun chunks merged."""
    tags = F.transform(T.tokens("text"), FE.tag)
    return V.counted(docs(spark, sf_dir), FE.chunks(tags))


@query(f"WITH {_TOK}, g AS (SELECT doc_id, string_agg(tag || ' ', '' ORDER BY pos) AS s FROM t GROUP BY doc_id), c AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(s, '{FE.CHUNK}'), lambda x: 'NP[' || trim(x) || ']')) AS feature FROM g) SELECT doc_id, feature, count(*) AS n FROM c GROUP BY ALL")
def n08_subtrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noun chunks with what they hold."""
    tags = F.transform(T.tokens("text"), FE.tag)
    return V.counted(docs(spark, sf_dir), F.filter(FE.subtrees(tags), lambda x: x.startswith("NP[")))


@query(f"WITH {_EMB}, l AS (SELECT x, y, unnest(range(1, 65)) AS i, unnest(list_transform(range(1, 65), lambda i: abs(p[i]::DOUBLE - q[i]::DOUBLE))) AS d FROM k), s AS (SELECT i, avg(d) AS m, stddev_pop(d) AS sd FROM l GROUP BY i) SELECT x, y, round(sum((d - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END), 6) AS total FROM l JOIN s USING (i) GROUP BY x, y")
def v11_scaled_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second scaler, fitted on |x1 - x2|."""
    c = embedding_cases(spark, sf_dir).select("x", "y", F.posexplode(F.zip_with("p", "q", lambda a, b: F.abs(a.cast("double") - b.cast("double")))).alias("i", "d"))
    s = c.groupBy("i").agg(F.avg("d").alias("m"), F.stddev_pop("d").alias("sd"))
    z = (F.col("d") - F.col("m")) / F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd"))
    return c.join(F.broadcast(s), "i").groupBy("x", "y").agg(F.round(F.sum(z), 6).alias("total"))


@query("WITH e AS (SELECT label, unnest(range(0, 64)) AS dim, unnest(embedding)::DOUBLE AS v, vec_id % 3 AS chunk FROM embeddings), c AS (SELECT label, chunk, dim, avg(v) AS v FROM e GROUP BY ALL) SELECT label, dim, round(avg(v), 6) AS v FROM c GROUP BY ALL")
def p04_mean_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over the vectors of a chunk, then over the chunks of an author."""
    e = table(spark, sf_dir, "embeddings").select("label", (F.col("vec_id") % 3).alias("chunk"), F.posexplode("embedding").alias("dim", "v"))
    c = e.groupBy("label", "chunk", "dim").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return c.groupBy("label", "dim").agg(F.round(F.avg("v"), 6).alias("v"))


@query("WITH e AS (SELECT vec_id, list_avg(embedding::DOUBLE[]) AS a, list_max(embedding::DOUBLE[]) AS m FROM embeddings), s AS (SELECT avg(a) AS aa, stddev_pop(a) AS sa, avg(m) AS am, stddev_pop(m) AS sm FROM e) SELECT vec_id, 66 AS width, 1.0 AS norm, round((a - aa) / CASE WHEN sa = 0 THEN 1 ELSE sa END, 5) AS style_1, round((m - am) / CASE WHEN sm = 0 THEN 1 ELSE sm END, 5) AS style_2 FROM e, s")
def p06_concatenated_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit-length embedding with a scaled style vector behind it (here mean and maximum of the embedding)."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", V.l2_normalized(F.col("embedding")).alias("u"), (F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x) / F.size("embedding")).alias("a"), F.array_max("embedding").cast("double").alias("m"))
    sd = lambda c: F.when(F.stddev_pop(c) == 0, 1.0).otherwise(F.stddev_pop(c))
    f = e.agg(F.avg("a").alias("aa"), sd("a").alias("sa"), F.avg("m").alias("am"), sd("m").alias("sm"))
    both = F.concat("u", F.array((F.col("a") - F.col("aa")) / F.col("sa"), (F.col("m") - F.col("am")) / F.col("sm")))
    v = e.join(F.broadcast(f)).select("vec_id", both.alias("v"))
    return v.select("vec_id", F.size("v").alias("width"), F.round(F.aggregate(F.slice("v", 1, 64), F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm"), F.round(F.get("v", F.lit(64)), 5).alias("style_1"), F.round(F.get("v", F.lit(65)), 5).alias("style_2"))


_BLOCKS = f"""b AS MATERIALIZED (SELECT doc_id, 'mark:' || feature AS feature, n::DOUBLE AS value FROM {_MARK_N} UNION ALL SELECT doc_id, 'tag:' || tag, count(*) FROM t GROUP BY ALL UNION ALL SELECT doc_id, 'word:' || low, count(*) FROM t WHERE low IN ({_FW}) GROUP BY ALL)"""


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tok(spark, sf_dir)
    return V.union_blocks({"mark": FE.mark_counts(docs(spark, sf_dir)), "tag": FE.counts(t, "tag"), "word": FE.counts(t.where(F.col("low").isin(*FE.FUNCTION_WORDS)), "low")})


@query(f"WITH {_TOK}, {_BLOCKS} SELECT * FROM b")
def v07_feature_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir)


@query(f"WITH {_TOK}, {_BLOCKS}, d AS (SELECT DISTINCT feature FROM b JOIN documents USING (doc_id) WHERE topic = 'math') SELECT b.* FROM b JOIN documents USING (doc_id) JOIN d USING (feature) WHERE topic = 'diy'")
def v12_aligned_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vocabulary of one topic applied to another."""
    b = store(_blocks(spark, sf_dir), "blocks")
    topics = table(spark, sf_dir, "documents").select("doc_id", "topic")
    fitted = b.join(topics.where("topic = 'math'"), "doc_id", "left_semi")
    return V.aligned(b.join(topics.where("topic = 'diy'"), "doc_id", "left_semi"), fitted).select("doc_id", "feature", "value")
