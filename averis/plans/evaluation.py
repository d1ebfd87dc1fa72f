"""Metrics, thresholds, resampling, deduplication and summaries over predictions and test_runs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from averis.functions.names import method_key, pair_key, split_key
from averis.operators import metrics as M
from averis.operators import resampling as B
from averis.operators.dedup import deduplicated
from averis.plans.delivery import _METHOD, _SPLIT, prediction_keys, run_keys, sql_pair
from averis.session import store, table

RUN = ["topic", "masking", "method", "run"]
KEY = [*RUN, "split"]


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = deduplicated(table(spark, sf_dir, "predictions"), prediction_keys(), "row_id")
    return p.select("row_id", "topic", "masking", method_key("model").alias("method"), "run", split_key("split").alias("split"), pair_key("pair").alias("pair"), "y_true", "y_pred", "score", F.coalesce("aligned", F.lit(1)).alias("aligned"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = deduplicated(table(spark, sf_dir, "test_runs"), run_keys(), "row_id")
    return r.select("row_id", "topic", "masking", method_key("model").alias("method"), "run", "acc", "auc", "f1", "prec", "rec", "tp", "fn", "fp", "tn", "n")


def base_preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of whole topics: no cross-topic, learning-curve or fold name."""
    return predictions(spark, sf_dir).where(~F.col("topic").rlike("2|__"))


P = f"""p AS (SELECT row_id, topic, masking, {_METHOD} AS method, run, {_SPLIT} AS split, {sql_pair('pair')} AS pair, y_true, y_pred, score, coalesce(aligned, 1) AS aligned
FROM (SELECT *, max(row_id) OVER (PARTITION BY topic, masking, {_METHOD}, run, {_SPLIT}, {sql_pair('pair')}) AS kept FROM predictions) WHERE row_id = kept)"""
R = f"""r AS (SELECT row_id, topic, masking, {_METHOD} AS method, run, acc, auc, f1, prec, rec, tp, fn, fp, tn, n
FROM (SELECT *, max(row_id) OVER (PARTITION BY topic, masking, {_METHOD}, run) AS kept FROM test_runs) WHERE row_id = kept)"""
BASE = f"{P}, bp AS (SELECT * FROM p WHERE NOT regexp_matches(topic, '2|__'))"

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_CONF = """count_if(y_true=1 AND y_pred=1)::BIGINT AS tp, count_if(y_true=1 AND y_pred=0)::BIGINT AS fn, count_if(y_true=0 AND y_pred=1)::BIGINT AS fp, count_if(y_true=0 AND y_pred=0)::BIGINT AS tn, count(*) AS n"""
_RATIOS = """round((tp+tn)/n, 9) AS acc, CASE WHEN tp+fp=0 THEN 0.0 ELSE round(tp/(tp+fp), 9) END AS prec, CASE WHEN tp+fn=0 THEN 0.0 ELSE round(tp/(tp+fn), 9) END AS rec, CASE WHEN 2*tp+fp+fn=0 THEN 0.0 ELSE round(2*tp/(2*tp+fp+fn), 9) END AS f1"""


def _auc_sql(src: str, by: str) -> str:
    return f"""a AS (SELECT {by}, CASE WHEN sum(y_true)=0 OR sum(y_true)=count(*) THEN 0.5 ELSE round((sum(CASE WHEN y_true=1 THEN ar END) - sum(y_true)*(sum(y_true)+1)/2)/(sum(y_true)*(count(*)-sum(y_true))), 9) END AS auc
FROM (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY score) + (count(*) OVER (PARTITION BY {by}, score) - 1)/2 AS ar FROM {src} WHERE score IS NOT NULL AND y_true IS NOT NULL) GROUP BY {by})"""


_K = "topic, masking, method, run, split"


@query(f"WITH {P}, {_auc_sql('p', _K)} SELECT * REPLACE (coalesce(auc, 0.5) AS auc), {_RATIOS} FROM (SELECT {_K}, {_CONF} FROM p WHERE y_true IS NOT NULL AND y_pred IS NOT NULL GROUP BY {_K}) LEFT JOIN (SELECT {_K}, auc FROM a) USING ({_K})")
def flagship_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1-E3 of every run and split, redeliveries removed."""
    return M.metrics(store(predictions(spark, sf_dir).select(*KEY, "y_true", "y_pred", "score"), "preds"), KEY)


@query(f"WITH {P} SELECT {_K}, {_CONF}, round(avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM p WHERE aligned = 1 GROUP BY {_K}")
def e05_aligned_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir).where("aligned = 1")
    n = lambda t, q: F.count_if((F.col("y_true") == t) & (F.col("y_pred") == q))
    return p.groupBy(*KEY).agg(n(1, 1).alias("tp"), n(1, 0).alias("fn"), n(0, 1).alias("fp"), n(0, 0).alias("tn"), F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")), 9).alias("accuracy"))


_ROC = """s AS (SELECT topic, masking, method, run, score, sum(y_true) AS pos, sum(1-y_true) AS neg FROM bp WHERE split='train' AND score IS NOT NULL GROUP BY ALL),
c AS (SELECT *, sum(neg) OVER w AS fp, sum(pos) OVER w AS tp, sum(pos) OVER g AS p, sum(neg) OVER g AS q, count(*) OVER g AS m FROM s WINDOW w AS (PARTITION BY topic, masking, method, run ORDER BY score DESC ROWS UNBOUNDED PRECEDING), g AS (PARTITION BY topic, masking, method, run)),
n AS (SELECT *, lag(fp) OVER w AS fp0, lag(tp) OVER w AS tp0, lead(fp) OVER w AS fp1, lead(tp) OVER w AS tp1 FROM c WINDOW w AS (PARTITION BY topic, masking, method, run ORDER BY score DESC)),
k AS (SELECT topic, masking, method, run, score, fp/q AS x2, 1-tp/p AS y2 FROM n WHERE (m<=2 OR fp0 IS NULL OR fp1 IS NULL OR fp1-2*fp+fp0<>0 OR tp1-2*tp+tp0<>0) AND p>0 AND q>0),
l AS (SELECT *, lag(x2) OVER w AS x1, lag(y2) OVER w AS y1, lag(score) OVER w AS t1 FROM k WINDOW w AS (PARTITION BY topic, masking, method, run ORDER BY score DESC)),
z AS (SELECT *, (y1-x1)/nullif((x2-x1)-(y2-y1), 0) AS alpha, row_number() OVER (PARTITION BY topic, masking, method, run ORDER BY round(abs(x2-y2), 12), score DESC) AS o FROM l),
t AS (SELECT topic, masking, method, run, round(CASE WHEN alpha BETWEEN 0 AND 1 THEN t1+alpha*(score-t1) ELSE score END, 6) AS threshold FROM z WHERE o=1)"""


@query(f"WITH {BASE}, {_ROC} SELECT * FROM t")
def t01_eer_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.eer_threshold(base_preds(spark, sf_dir).where("split = 'train'"), RUN)


@query(f"WITH {BASE}, {_ROC}, u AS (SELECT bp.topic, bp.masking, bp.method, bp.run, y_true, CASE WHEN score >= threshold THEN 1 ELSE 0 END AS y_pred FROM bp JOIN t USING (topic, masking, method, run) WHERE split='test' AND score IS NOT NULL) SELECT *, {_RATIOS} FROM (SELECT topic, masking, method, run, {_CONF} FROM u GROUP BY ALL)")
def t01_eer_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold fitted on train scores, applied to test, per corpus and run (no leakage between groups)."""
    p = store(base_preds(spark, sf_dir), "preds")
    t = M.eer_threshold(p.where("split = 'train'"), RUN)
    hit = M.decide(p.where("split = 'test' AND score IS NOT NULL"), t, RUN).where("y_hat IS NOT NULL")
    return M.confusion(hit.drop("y_pred").withColumnRenamed("y_hat", "y_pred"), RUN)


def _acc_sql(ends: bool) -> str:
    cands = "SELECT DISTINCT topic, masking, method, run, score AS x FROM o" + (" UNION SELECT DISTINCT topic, masking, method, run, -1.0 FROM o UNION SELECT DISTINCT topic, masking, method, run, 1.0 FROM o" if ends else "")
    more = "UNION ALL SELECT topic, masking, method, run, -1.0 FROM x GROUP BY ALL UNION ALL SELECT topic, masking, method, run, 1.0 FROM x GROUP BY ALL" if ends else "UNION ALL SELECT topic, masking, method, run, min(x)-0.001 FROM x GROUP BY ALL UNION ALL SELECT topic, masking, method, run, max(x)+0.0005 FROM x GROUP BY ALL"
    return f"""WITH {BASE}, o AS (SELECT * FROM bp WHERE split='train' AND score IS NOT NULL), x AS ({cands}),
mid AS (SELECT topic, masking, method, run, (x + lead(x) OVER (PARTITION BY topic, masking, method, run ORDER BY x))/2 AS t FROM x),
cc AS (SELECT * FROM mid WHERE t IS NOT NULL {more}),
ac AS (SELECT topic, masking, method, run, t, sum(CASE WHEN (score > t) = (y_true = 1) THEN 1 ELSE 0 END) AS good, count(*) AS n FROM cc JOIN o USING (topic, masking, method, run) GROUP BY ALL)
SELECT topic, masking, method, run, round(t, 9) AS threshold, round(good/n, 9) AS acc FROM (SELECT *, row_number() OVER (PARTITION BY topic, masking, method, run ORDER BY good DESC, t) AS o1 FROM ac) WHERE o1=1"""


@query(_acc_sql(True))
def t02_accuracy_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.accuracy_threshold(base_preds(spark, sf_dir).where("split = 'train'"), RUN)


@query(_acc_sql(False))
def t03_accuracy_threshold_data_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.accuracy_threshold(base_preds(spark, sf_dir).where("split = 'train'"), RUN, ends=None)


@query(f"WITH {BASE} SELECT *, {_RATIOS} FROM (SELECT {_K}, {_CONF} FROM (SELECT * REPLACE (CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS y_pred) FROM bp WHERE score IS NOT NULL) GROUP BY {_K})")
def t04_fixed_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = base_preds(spark, sf_dir).where("score IS NOT NULL").withColumn("y_pred", (F.col("score") >= 0.5).cast("int"))
    return M.confusion(p, KEY)


# ---- resampling ----
def _stream(src: str, key: str, reps: int = 1000) -> str:
    """Clauses that end in ``u``: each row of ``src`` with ``rep`` numbers u in [0, 1), a splitmix64 stream that starts at the
    digest of ``key``."""
    wide = lambda a, b: f"(({a})::UHUGEINT * {b}::UHUGEINT)"
    cut = lambda x: f"(({x}) % 18446744073709551616::UHUGEINT)::UBIGINT"
    return f"""u0 AS (SELECT *, {cut(wide('rep', 11400714819323198485) + f" + ('0x' || substr(md5({key}), 1, 16))::UBIGINT::UHUGEINT")} AS z FROM (SELECT *, unnest(range(1, {reps + 1})) AS rep FROM {src})),
u1 AS (SELECT * REPLACE ({cut(wide('xor(z, z >> 30::UBIGINT)', 13787848793156543929))} AS z) FROM u0),
u2 AS (SELECT * REPLACE ({cut(wide('xor(z, z >> 27::UBIGINT)', 10723151780598845931))} AS z) FROM u1),
u AS (SELECT * EXCLUDE (z), (xor(z, z >> 31::UBIGINT) >> 11::UBIGINT)::DOUBLE * pow(2::DOUBLE, -53) AS u FROM u2)"""


def _cumulated(src: str, keys: str, lo: str, hi: str, logs: str) -> str:
    """Clauses that end in ``cum``: for each distinct ``keys`` of ``src`` the cumulated shares c of i in lo..hi, by log weights."""
    return f"""w0 AS (SELECT *, {logs} AS l FROM (SELECT *, unnest(range({lo}, {hi} + 1)) AS i FROM (SELECT DISTINCT {keys} FROM {src}))),
w1 AS (SELECT *, exp(l - max(l) OVER (PARTITION BY {keys})) AS e FROM w0),
cum AS (SELECT *, sum(e) OVER (PARTITION BY {keys} ORDER BY i) / sum(e) OVER (PARTITION BY {keys}) AS c FROM w1)"""


_LOG = lambda n, k: f"(lgamma({n} + 1.0::DOUBLE) - lgamma({k} + 1.0::DOUBLE) - lgamma({n} - {k} + 1.0::DOUBLE))"
_STARS = "CASE WHEN p<0.001 THEN '***' WHEN p<0.01 THEN '**' WHEN p<0.05 THEN '*' ELSE '=' END"


@query(f"""WITH {BASE}, g AS (SELECT topic, masking, method, run, count(*) AS n, coalesce(sum(CASE WHEN y_true=y_pred THEN 1 ELSE 0 END), 0)::BIGINT AS k FROM bp WHERE split='test' AND aligned=1 GROUP BY ALL),
{_stream('g', "concat_ws('|', '1', topic, masking, method, run)")},
{_cumulated('(FROM g WHERE k > 0 AND k < n)', 'n, k', '0', 'n', _LOG('n', 'i') + " + i * ln(k / n) + (n - i) * ln(1 - k / n)")},
h AS (SELECT u.topic, u.masking, u.method, u.run, u.n, u.k, rep, i AS h FROM u ASOF JOIN cum ON u.n = cum.n AND u.k = cum.k AND u.u < cum.c UNION ALL SELECT topic, masking, method, run, n, k, rep, k FROM u WHERE k = 0 OR k = n),
o AS (SELECT *, row_number() OVER (PARTITION BY topic, masking, method, run ORDER BY h, rep)-1 AS o FROM h)
SELECT topic, masking, method, run, n, round(k/n, 9) AS acc, round(max(CASE WHEN o=25 THEN h/n END), 9) AS lo, round(max(CASE WHEN o=975 THEN h/n END), 9) AS hi FROM o GROUP BY topic, masking, method, run, n, k""")
def b01_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = base_preds(spark, sf_dir).where("split = 'test' AND aligned = 1")
    return B.bootstrap(p.withColumn("ok", (F.col("y_true") == F.col("y_pred"))), RUN, ["pair"], "ok")


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every two methods on their common pairs of run 1. ``conflict``: the two have different labels for the pair."""
    p = store(base_preds(spark, sf_dir).where("split = 'test' AND aligned = 1 AND run = 1").select("topic", "masking", "pair", "method", "y_true", "y_pred"), "preds")
    a = p.select("topic", "masking", "pair", F.col("method").alias("a"), F.col("y_true").alias("ya"), (F.col("y_true") == F.col("y_pred")).alias("ok_a"))
    b = p.select("topic", "masking", "pair", F.col("method").alias("b"), F.col("y_true").alias("yb"), (F.col("y_true") == F.col("y_pred")).alias("ok_b"))
    # methods meet only on their common pair; there are ten methods, so a pair has at most 45 of these rows
    return a.join(b, ["topic", "masking", "pair"]).where("a < b").withColumn("conflict", F.col("ya") != F.col("yb"))


_PAIRED = f"""{BASE}, e AS (SELECT topic, masking, pair, method, y_true, y_true=y_pred AS ok FROM bp WHERE split='test' AND aligned=1 AND run=1),
j AS (SELECT x.topic, x.masking, x.method AS a, y.method AS b, x.ok AS ok_a, y.ok AS ok_b, x.y_true <> y.y_true AS conflict FROM e x JOIN e y ON x.topic=y.topic AND x.masking=y.masking AND x.pair=y.pair AND x.method<y.method),
g AS (SELECT topic, masking, a, b, count(*) AS n, count_if(ok_a)::BIGINT AS ra, count_if(ok_b)::BIGINT AS rb, count_if(ok_a<>ok_b)::BIGINT AS d FROM j WHERE NOT conflict GROUP BY ALL)"""
_ART = f"""{_PAIRED}, f AS (SELECT *, abs(ra-rb) AS s FROM g), {_stream('(FROM f WHERE d > 20)', "concat_ws('|', '1', topic, masking, a, b)")},
{_cumulated('f', 'd', '0', 'd', _LOG('d', 'i'))},
ex AS (SELECT topic, masking, a, b, n, ra, rb, f.d, sum(CASE WHEN abs(f.d-2*i) >= s THEN e ELSE 0 END)/sum(e) AS p FROM f JOIN cum ON f.d = cum.d WHERE f.d <= 20 GROUP BY ALL),
ap AS (SELECT topic, masking, a, b, n, ra, rb, u.d, (count_if(abs(u.d-2*i)>=s)::BIGINT+1)/1001 AS p FROM u ASOF JOIN cum ON u.d = cum.d AND u.u < cum.c GROUP BY ALL),
art AS (SELECT topic, masking, a, b, n, round(ra/n, 9) AS acc_a, round(rb/n, 9) AS acc_b, round(p, 6) AS p, {_STARS} AS stars FROM (FROM ex UNION ALL FROM ap))"""


@query(f"WITH {_ART} SELECT * FROM art")
def b02_paired_randomization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs whose label the two methods do not agree on are left out here and counted by ``r21_aligned_pairs``."""
    return B.paired_randomization(_paired(spark, sf_dir).where("NOT conflict"), ["topic", "masking"])


@query(f"WITH {_PAIRED}, k AS (SELECT topic, masking, a, b, count_if(conflict)::BIGINT AS conflicts FROM j GROUP BY ALL) SELECT topic, masking, a, b, coalesce(n, 0) AS n, round(ra/n, 9) AS acc_a, round(rb/n, 9) AS acc_b, coalesce(d, 0) AS d, conflicts FROM k LEFT JOIN g USING (topic, masking, a, b)")
def r21_aligned_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conflicts``: pairs with different labels, which count for nothing else; whoever must not have any checks for 0."""
    both = F.when(~F.col("conflict"), F.lit(1))
    right = lambda c: F.round(F.avg(F.when(~F.col("conflict"), F.col(c).cast("double"))), 9)
    return _paired(spark, sf_dir).groupBy("topic", "masking", "a", "b").agg(F.count(both).alias("n"), right("ok_a").alias("acc_a"), right("ok_b").alias("acc_b"), F.count_if(~F.col("conflict") & (F.col("ok_a") != F.col("ok_b"))).alias("d"), F.count_if("conflict").alias("conflicts"))


def _compared(v: DataFrame, by: list[str]) -> DataFrame:
    """Every two ``side``s of a group by stratified randomization. ``v``: by, side, stratum, ok; counted before it meets."""
    v = store(v.groupBy(*by, "side", "stratum", "ok").agg(F.count(F.lit(1)).alias("c")), "sides")
    m = v.select(*by, "side").distinct()
    m = m.withColumnRenamed("side", "side_a").join(m.withColumnRenamed("side", "side_b"), by).where("side_a < side_b")
    w = v.join(m, by).where("side = side_a OR side = side_b").withColumn("g", F.when(F.col("side") == F.col("side_a"), "a").otherwise("b"))
    return B.stratified_accuracy(w, [*by, "side_a", "side_b"], "stratum", "g", "ok", weight="c")


def _compared_sql(v: str, by: str) -> str:
    k = f"{by}, side_a, side_b"
    return f"""v AS ({v}), m AS (SELECT DISTINCT {by}, side FROM v), mm AS (SELECT {by}, x.side AS side_a, y.side AS side_b FROM m x JOIN m y USING ({by}) WHERE x.side < y.side),
t0 AS (SELECT {k}, stratum, count(*) AS n, sum(ok)::BIGINT AS k, count_if(side = side_a)::BIGINT AS na, coalesce(sum(CASE WHEN side = side_a THEN ok END), 0)::BIGINT AS ka FROM v JOIN mm USING ({by}) WHERE ok IS NOT NULL AND side IN (side_a, side_b) GROUP BY ALL),
tt AS (SELECT {k}, sum(n) AS sn, sum(k) AS sk, sum(na) AS sna, sum(ka) AS ska FROM t0 GROUP BY ALL HAVING sum(na) > 0 AND sum(n - na) > 0),
{_stream('t0', f"concat_ws('|', '1', {k}, stratum::VARCHAR)")},
{_cumulated('t0', 'n, k, na', 'greatest(0, na - (n - k))', 'least(k, na)', _LOG('k', 'i') + ' + ' + _LOG('(n - k)', '(na - i)'))},
x AS (SELECT {k}, rep, sum(i) AS h FROM u ASOF JOIN cum ON u.n = cum.n AND u.k = cum.k AND u.na = cum.na AND u.u < cum.c GROUP BY ALL),
y AS (SELECT {k}, round(abs(ska/sna - (sk-ska)/(sn-sna)), 9) AS real, round(abs(h/sna - (sk-h)/(sn-sna)), 9) AS drawn FROM x JOIN tt USING ({k}))
SELECT {k}, round(max(real), 6) AS diff, round((count_if(drawn >= real)::BIGINT + 1)/1001, 6) AS p FROM y GROUP BY ALL"""


_CROSS = r"regexp_extract(topic, '^([a-z]+)2([a-z]+)$', {})"


@query(f"WITH {P}, " + _compared_sql(f"SELECT masking, method, {_CROSS.format(2)} AS target, {_CROSS.format(1)} AS side, run AS stratum, (y_true = y_pred)::INT AS ok FROM p WHERE split='test' AND regexp_matches(topic, '^[a-z]+2[a-z]+$')", "masking, method, target").replace(f"SELECT masking, method, target, side_a, side_b, round(max(real)", "SELECT masking, method, target, side_a AS source_a, side_b AS source_b, round(max(real)"))
def b03_stratified_randomization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every two sources of each cross-topic target, compared within runs."""
    c = r"^([a-z]+)2([a-z]+)$"
    v = predictions(spark, sf_dir).where((F.col("split") == "test") & F.col("topic").rlike(c))
    v = v.select("masking", "method", F.regexp_extract("topic", c, 2).alias("target"), F.regexp_extract("topic", c, 1).alias("side"), F.col("run").alias("stratum"), (F.col("y_true") == F.col("y_pred")).cast("int").alias("ok"))
    return _compared(v, ["masking", "method", "target"]).withColumnsRenamed({"side_a": "source_a", "side_b": "source_b"})


_LC = r"^(.+)__lc_n(\d+)_d(\d+)$"


@query(f"WITH {P}, " + _compared_sql(f"SELECT regexp_extract(topic, '{_LC}', 1) AS base, masking, method, regexp_extract(topic, '{_LC}', 2)::INT AS side, regexp_extract(topic, '{_LC}', 3)::INT AS stratum, (y_true = y_pred)::INT AS ok FROM p WHERE split='test' AND regexp_matches(topic, '{_LC}')", "base, masking, method"))
def b05_training_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every two training sizes of a corpus, compared within the draws they share."""
    part = lambda i: F.regexp_extract("topic", _LC, i)
    v = predictions(spark, sf_dir).where((F.col("split") == "test") & F.col("topic").rlike(_LC))
    v = v.select(part(1).alias("base"), "masking", "method", part(2).cast("int").alias("side"), part(3).cast("int").alias("stratum"), (F.col("y_true") == F.col("y_pred")).cast("int").alias("ok"))
    return _compared(v, ["base", "masking", "method"])


_FOLD = r"^([^_2]+)(?:__cv(\d+))?$"


@query(f"WITH {P}, " + _compared_sql(f"SELECT regexp_extract(topic, '{_FOLD}', 1) AS base, masking, method, CASE WHEN regexp_extract(topic, '{_FOLD}', 2) = '' THEN 'orig' ELSE regexp_extract(topic, '{_FOLD}', 2) END AS side, run AS stratum, (y_true = y_pred)::INT AS ok FROM p WHERE split='test' AND regexp_matches(topic, '{_FOLD}')", "base, masking, method"))
def b05_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every two folds of a corpus and each fold with the corpus itself (``orig``), compared within runs."""
    part = lambda i: F.regexp_extract("topic", _FOLD, i)
    v = predictions(spark, sf_dir).where((F.col("split") == "test") & F.col("topic").rlike(_FOLD))
    v = v.select(part(1).alias("base"), "masking", "method", F.coalesce(F.nullif(part(2), F.lit("")), F.lit("orig")).alias("side"), F.col("run").alias("stratum"), (F.col("y_true") == F.col("y_pred")).cast("int").alias("ok"))
    return _compared(v, ["base", "masking", "method"])


# ---- deduplication and reports ----
@query(f"WITH {R} SELECT * FROM r")
def r22_dedupe_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir)


@query(f"""WITH {R}, o AS (SELECT *, {_METHOD} AS method, {_SPLIT} AS sp FROM predictions),
i AS (SELECT *, row_id - row_number() OVER (PARTITION BY topic, masking, method, run, sp ORDER BY row_id) AS island FROM o),
b AS (SELECT topic, masking, method, run, sp AS split, island, min(row_id) AS first, max(row_id) AS last, count(*) AS n, avg(CASE WHEN y_true=y_pred THEN 1.0 ELSE 0.0 END) AS acc FROM i GROUP BY ALL),
c AS (SELECT b.*, row_number() OVER (PARTITION BY topic, masking, method, run, split ORDER BY CASE WHEN abs(b.acc-r.acc) < 0.0005 THEN 0 ELSE 1 END, last DESC) AS o, count(*) OVER (PARTITION BY topic, masking, method, run, split) AS blocks FROM b LEFT JOIN (SELECT topic, masking, method, run, acc FROM r) r USING (topic, masking, method, run))
SELECT topic, masking, method, run, split, first, last, n, blocks, round(acc, 9) AS acc FROM c WHERE o=1""")
def r23_dedupe_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contiguous blocks of each key (gaps and islands); the last block whose accuracy is the recorded one, else the last."""
    o = table(spark, sf_dir, "predictions").select("row_id", "topic", "masking", method_key("model").alias("method"), "run", split_key("split").alias("split"), (F.col("y_true") == F.col("y_pred")).cast("double").alias("ok"))
    w = Window.partitionBy(*KEY).orderBy("row_id")
    b = o.withColumn("island", F.col("row_id") - F.row_number().over(w)).groupBy(*KEY, "island").agg(F.min("row_id").alias("first"), F.max("row_id").alias("last"), F.count(F.lit(1)).alias("n"), F.avg(F.coalesce("ok", F.lit(0.0))).alias("acc"))
    ref = runs(spark, sf_dir).select(*RUN, F.col("acc").alias("ref"))
    j = b.join(ref, RUN, "left").withColumn("near", F.when(F.abs(F.col("acc") - F.col("ref")) < 0.0005, 0).otherwise(1))
    best = j.groupBy(*KEY).agg(F.min_by(F.struct("first", "last", "n", "acc"), F.struct("near", -F.col("last"))).alias("b"), F.count(F.lit(1)).alias("blocks"))
    return best.select(*KEY, "b.first", "b.last", "b.n", "blocks", F.round("b.acc", 9).alias("acc"))


@query(f"WITH {R} SELECT topic, masking, method, run, acc, auc FROM (SELECT *, row_number() OVER (PARTITION BY topic, masking, method ORDER BY acc, auc, run) AS o, count(*) OVER (PARTITION BY topic, masking, method) AS c FROM r WHERE acc IS NOT NULL AND auc IS NOT NULL) WHERE o = (c + 1) // 2")
def r24_median_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = ["topic", "masking", "method"]
    r = runs(spark, sf_dir).where("acc IS NOT NULL AND auc IS NOT NULL")
    r = r.withColumns({"o": F.row_number().over(Window.partitionBy(*k).orderBy("acc", "auc", "run")), "c": F.count(F.lit(1)).over(Window.partitionBy(*k))})
    return r.where("o = (c + 1) DIV 2").select(*k, "run", "acc", "auc")


@query(rf"""WITH {R}, c AS (SELECT *, regexp_extract(topic, '^([a-z]+)2([a-z]+)$', 1) AS source, regexp_extract(topic, '^([a-z]+)2([a-z]+)$', 2) AS target FROM r WHERE run=1 AND regexp_matches(topic, '^[a-z]+2[a-z]+$'))
SELECT c.masking, c.method, source, target, c.acc, m.acc AS indomain_acc, c.f1, m.f1 AS indomain_f1, c.auc, m.auc AS indomain_auc FROM c LEFT JOIN (SELECT * FROM r WHERE run=1) m ON m.topic=target AND m.masking=c.masking AND m.method=c.method""")
def a04_cross_domain_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir).where("run = 1")
    pat = r"^([a-z]+)2([a-z]+)$"
    c = r.where(F.col("topic").rlike(pat)).select("masking", "method", F.regexp_extract("topic", pat, 1).alias("source"), F.regexp_extract("topic", pat, 2).alias("target"), "acc", "f1", "auc")
    m = r.select(F.col("topic").alias("target"), "masking", "method", F.col("acc").alias("indomain_acc"), F.col("f1").alias("indomain_f1"), F.col("auc").alias("indomain_auc"))
    return c.join(m, ["target", "masking", "method"], "left").select("masking", "method", "source", "target", "acc", "indomain_acc", "f1", "indomain_f1", "auc", "indomain_auc")


_STAT = "round(avg({0}), 9) AS {0}_mean, round(coalesce(stddev_pop({0}), 0), 9) AS {0}_sd"


@query(rf"WITH {_ART.replace(BASE, BASE + ', ' + R)} , s AS (SELECT topic AS domain, masking, method, count(*) AS n_splits, {', '.join(_STAT.format(x) for x in ('acc', 'f1', 'auc'))} FROM r WHERE NOT regexp_matches(topic, '2|__') GROUP BY ALL), q AS (SELECT topic AS domain, masking, m AS method, count_if(p < 0.05)::BIGINT AS sig_pairs, count(*) AS n_pairs, min(p) AS p_min FROM (SELECT topic, masking, a AS m, p FROM art UNION ALL SELECT topic, masking, b, p FROM art) GROUP BY ALL) SELECT s.*, coalesce(sig_pairs, 0) AS sig_pairs, coalesce(n_pairs, 0) AS n_pairs, p_min FROM s LEFT JOIN q USING (domain, masking, method)")
def a01_split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = ["domain", "masking", "method"]
    r = runs(spark, sf_dir).where(~F.col("topic").rlike("2|__")).withColumnRenamed("topic", "domain")
    stat = lambda x: [F.round(F.avg(x), 9).alias(x + "_mean"), F.round(F.coalesce(F.stddev_pop(x), F.lit(0.0)), 9).alias(x + "_sd")]
    s = r.groupBy(*k).agg(F.count(F.lit(1)).alias("n_splits"), *stat("acc"), *stat("f1"), *stat("auc"))
    art = b02_paired_randomization(spark, sf_dir).withColumnRenamed("topic", "domain").withColumn("method", F.explode(F.array("a", "b")))
    q = art.groupBy(*k).agg(F.count_if(F.col("p") < 0.05).alias("sig_pairs"), F.count(F.lit(1)).alias("n_pairs"), F.min("p").alias("p_min"))
    return s.join(q, k, "left").fillna(0, ["sig_pairs", "n_pairs"])


@query(rf"WITH {R}, l AS (SELECT regexp_extract(topic, '{_LC}', 1) AS base, regexp_extract(topic, '{_LC}', 2)::INT AS n_train_pairs, masking, method, acc FROM r WHERE regexp_matches(topic, '{_LC}') AND acc IS NOT NULL) SELECT base AS topic, masking, method, n_train_pairs, count(*) AS draws, round(avg(acc), 9) AS acc_mean, round(stddev_pop(acc), 9) AS acc_std, min(acc) AS acc_min, max(acc) AS acc_max FROM l GROUP BY ALL")
def a03_learning_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = runs(spark, sf_dir).where(F.col("topic").rlike(_LC) & F.col("acc").isNotNull())
    l = l.select(F.regexp_extract("topic", _LC, 1).alias("topic"), "masking", "method", F.regexp_extract("topic", _LC, 2).cast("int").alias("n_train_pairs"), "acc")
    return l.groupBy("topic", "masking", "method", "n_train_pairs").agg(F.count(F.lit(1)).alias("draws"), F.round(F.avg("acc"), 9).alias("acc_mean"), F.round(F.stddev_pop("acc"), 9).alias("acc_std"), F.min("acc").alias("acc_min"), F.max("acc").alias("acc_max"))


@query(rf"WITH {R}, l AS (SELECT regexp_extract(topic, '{_LC}', 1) AS domain, regexp_extract(topic, '{_LC}', 2)::INT AS size, regexp_extract(topic, '{_LC}', 3)::INT AS d, masking, method, acc, n, row_id FROM r WHERE regexp_matches(topic, '{_LC}')), t AS (SELECT size, arg_max(n, row_id) AS n_test FROM l WHERE n IS NOT NULL GROUP BY size) SELECT l.size, domain, masking, method, count(*) AS n_splits, any_value(n_test) AS n_test, round(avg(acc), 9) AS acc_mean, round(stddev_pop(acc), 9) AS acc_sd FROM l JOIN t USING (size) WHERE d <= 3 GROUP BY l.size, domain, masking, method")
def a02_split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = runs(spark, sf_dir).where(F.col("topic").rlike(_LC))
    l = l.select(F.regexp_extract("topic", _LC, 1).alias("domain"), F.regexp_extract("topic", _LC, 2).cast("int").alias("size"), F.regexp_extract("topic", _LC, 3).cast("int").alias("d"), "masking", "method", "acc", "n", "row_id")
    t = l.where("n IS NOT NULL").groupBy("size").agg(F.max_by("n", "row_id").alias("n_test"))
    g = l.where("d <= 3").join(t, "size").groupBy("size", "domain", "masking", "method")
    return g.agg(F.count(F.lit(1)).alias("n_splits"), F.first("n_test").alias("n_test"), F.round(F.avg("acc"), 9).alias("acc_mean"), F.round(F.stddev_pop("acc"), 9).alias("acc_sd"))


@query(f"WITH {_ART} SELECT topic, masking, a, max(acc_a) AS acc, " + ", ".join(f"max(CASE WHEN b='{m}' THEN stars END) AS {m}" for m in ("coav", "css", "dv", "fevec", "lambdag", "mlsr", "mstyledistance", "rsp", "siambert", "stylospeaker")) + " FROM art GROUP BY topic, masking, a")
def a05_pvalue_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    art = b02_paired_randomization(spark, sf_dir)
    g = art.groupBy("topic", "masking", "a").pivot("b", ["coav", "css", "dv", "fevec", "lambdag", "mlsr", "mstyledistance", "rsp", "siambert", "stylospeaker"]).agg(F.max("stars"))
    return g.join(art.groupBy("topic", "masking", "a").agg(F.max("acc_a").alias("acc")), ["topic", "masking", "a"])


@query(rf"WITH {R} SELECT topic, CASE WHEN regexp_matches(topic, '{_LC}') THEN 'curve' WHEN regexp_matches(topic, '__cv\d+$') THEN 'fold' WHEN regexp_matches(topic, '^[^2]+2.+$') THEN 'cross' ELSE 'base' END AS kind, split_part(split_part(topic, '__', 1), '2', 1) AS source, count(*) AS n_runs FROM r GROUP BY ALL")
def r19_topic_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("topic")
    kind = F.when(t.rlike(_LC), "curve").when(t.rlike(r"__cv\d+$"), "fold").when(t.rlike("^[^2]+2.+$"), "cross").otherwise("base")
    source = F.split_part(F.split_part(t, F.lit("__"), F.lit(1)), F.lit("2"), F.lit(1))
    return runs(spark, sf_dir).groupBy("topic").agg(F.count(F.lit(1)).alias("n_runs")).select("topic", kind.alias("kind"), source.alias("source"), "n_runs")


@query(f"WITH {P} SELECT topic, masking, method, pair, y_true, y_pred, aligned FROM (SELECT *, row_number() OVER (PARTITION BY topic, masking, method, pair ORDER BY row_id DESC) AS o FROM p WHERE split='test' AND run=1) WHERE o=1")
def s08_load_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir).where("split = 'test' AND run = 1")
    g = p.groupBy("topic", "masking", "method", "pair").agg(F.max_by(F.struct("y_true", "y_pred", "aligned"), "row_id").alias("v"))
    return g.select("topic", "masking", "method", "pair", "v.*")
