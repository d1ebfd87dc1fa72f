"""Text functions over all documents, with their SQL; results travel as digests where the text itself is long."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from averis.functions import text as T
from averis.functions import udfs as U
from averis.session import spread, table

QUERIES: dict = {}
SQL: dict = {}
_MARK = "chr(3)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text", "source", "topic"))


def _r(c: str, p: str, to: str) -> str:
    return f"regexp_replace({c}, '{p.replace(chr(39), chr(39) * 2)}', '{to}', 'g')"


WS, LATIN, WORD = T.WS, T.LATIN, T.WORD
sql_squeeze = lambda c: f"trim({_r(c, WS + '+', ' ')})"
sql_tidy = lambda c: sql_squeeze(_r(c, WS + r"+([,.!?;:])", r"\1"))
sql_capital = lambda c: f"(SELECT upper(substr(x, 1, 1)) || substr(x, 2) FROM (SELECT {c} AS x))"
sql_ellipsis = lambda c: _r(c, rf"…|(?:\.{WS}*){{3,}}", " ")
_NOT_LATIN = r"[^0-9A-Za-z\x{c0}-\x{24f}\t\n\x{0b}\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}.,!?;:\-–—'\"„“”()\[\]%&/+=€$@#]"
_NOT_NORMAL = r"[^0-9a-z\x{c0}-\x{24f}\t\n\x{0b}\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_TOKEN = WORD + r"+|[^\p{L}\p{N}_\t\n\x{0b}\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_D = "documents WHERE text IS NOT NULL"
sql_sents = lambda c: f"list_filter(list_transform(string_split({_r(c, rf'([.!?]){WS}+', chr(92) + '1' + chr(3))}, chr(3)), lambda s: {_r('s', f'^{WS}+|{WS}+$', '')}), lambda s: s <> '')"


def _scalar(name: str, f, sql: str) -> None:
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _docs(spark, sf_dir).select("doc_id", f("text").alias("text"))

    q.__name__ = name
    query(f"SELECT doc_id, {sql} AS text FROM {_D}")(q)


_scalar("c01_tidy_punctuation", T.tidy_punct, sql_tidy("text"))
_scalar("c02_normalize_text", T.normalize_text, sql_capital(sql_tidy(_r(sql_ellipsis("text"), rf"([.!?])([{LATIN}])", r"\1 \2"))))
_scalar("c03_strip_foreign", T.strip_foreign, sql_tidy(_r("text", _NOT_LATIN, " ")))
_fill = "list_aggregate(list_transform(regexp_extract_all(text, '" + WORD + r"+|[^\p{L}\p{N}_]+" + "'), lambda t: CASE WHEN lower(t) IN (" + ", ".join(f"'{x}'" for x in T.FILLERS) + ") THEN ' ' ELSE t END), 'string_agg', '')"
_scalar("c04_strip_fillers", T.strip_fillers, sql_capital("trim(" + _r(_r(_r(_r(_r(_fill, WS + r"+([,.!?;:])", r"\1"), r"([.!?])[,;:]+", r"\1"), rf"(?:[,;:]{WS}*){{2,}}", ", "), WS + "+", " "), r"^[ ,;:.]+", "") + ")"))
_scalar("c19_normal_form", T.normal_form, sql_squeeze(_r("lower(text)", _NOT_NORMAL, " ")))
_scalar("c24_whitespace", T.squeeze_ws, sql_squeeze("text"))
_scalar("c25_urls", T.replace_urls, _r("lower(text)", r"(?:https?://|www\.)[^ \t\n\r]+", " URL "))


@query(f"SELECT doc_id, len({sql_sents('text')}) AS n, array_to_string({sql_sents('text')}, '|') AS joined FROM {_D}")
def c18_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C14 and C18."""
    s = T.sentences("text")
    return _docs(spark, sf_dir).select("doc_id", F.size(s).alias("n"), F.array_join(s, "|").alias("joined"))


@query(f"""WITH p AS (SELECT doc_id, unnest(s) AS s, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, string_split({_r('text', rf'([.!?]){WS}+', chr(92) + '1' + chr(3))}, chr(3)) AS s FROM {_D})),
k AS (SELECT *, lower({_r('s', f'^{WS}+|{WS}+$', '')}) AS k FROM p), l AS (SELECT *, lag(k) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM k)
SELECT doc_id, {_r("string_agg(s, ' ' ORDER BY i)", f'^{WS}+|{WS}+$', '')} AS text FROM l WHERE b IS NULL OR k = '' OR k <> b GROUP BY doc_id""")
def c06_drop_repeated_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.drop_repeated_sentences("text").alias("text"))


@query(f"""SELECT source, list_sort(list_distinct(list_filter(list_concat([trim(source)], list_transform(string_split(source, ' - '), lambda p: trim(p)), list_transform(regexp_extract_all(source, '\\(([^)]+)\\)', 1), lambda p: trim(p)), [trim({_r('source', WS + chr(42) + chr(92) + '([^)]*' + chr(92) + ')', '')})]), lambda p: length(p) >= 4))) AS aliases FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)""")
def c08_channel_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("source IS NOT NULL").select("source").distinct().select("source", T.channel_aliases("source").alias("aliases"))


@query(None)
def c13_anonymized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C7-C13."""
    return _docs(spark, sf_dir).select("doc_id", T.anonymize("text", F.coalesce("source", F.lit(""))).alias("text"))


@query(None)
def c16_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excerpt, redaction with terms of the whole text, normalised, fillers dropped."""
    d = _docs(spark, sf_dir).withColumn("e", U.middle_excerpt("text"))
    red = T.redact(T.redact("e", T.channel_aliases(F.coalesce("source", F.lit(""))), "[KANAL]"), T.expand_tokens(T.intro_names("text")), "[NAME]")
    return d.select("doc_id", T.strip_fillers(T.normalize_text(red)).alias("text"))


@query(None)
def c17_mechanical_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C5, C6, C17."""
    d = _docs(spark, sf_dir).select("doc_id", U.collapse_word_runs(T.strip_foreign(T.drop_ellipsis("text"))).alias("text"))
    return d.select("doc_id", T.drop_repeated_sentences("text").alias("text"))


@query(None)
def c22_trimmed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of authors with exactly two texts in a topic, shared boundary sentences cut."""
    d = _docs(spark, sf_dir).where("topic IS NOT NULL AND source IS NOT NULL")
    two = d.groupBy("topic", "source").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("n = 2")
    a, b = d.select(F.col("doc_id").alias("x"), F.col("text").alias("ta")), d.select(F.col("doc_id").alias("y"), F.col("text").alias("tb"))
    j = two.join(a, "x").join(b, "y").withColumn("t", U.trim_pair("ta", "tb"))
    return j.select("topic", "source", "x", "y", "t.a", "t.b", "t.prefix", "t.suffix")


@query(rf"SELECT doc_id, len(t) AS n_tokens, len(list_filter(t, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_words FROM (SELECT doc_id, regexp_extract_all(text, '{_TOKEN}') AS t FROM {_D})")
def n01_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.size(T.tokens("text")).alias("n_tokens"), F.size(F.filter(T.tokens("text"), lambda t: t.rlike(r"\p{L}"))).alias("n_words"))


@query(rf"SELECT doc_id, len(s) AS n_sentences, list_sum(list_transform(s, lambda x: len(regexp_split_to_array(x, '{WS}+'))))::BIGINT AS n_tokens FROM (SELECT doc_id, list_filter(list_transform(regexp_extract_all(lower(text), '[^.!?\n]+(?:[.!?\n]+|$)|[.!?\n]+'), lambda x: {_r('x', f'^{WS}+|{WS}+$', '')}), lambda x: x <> '') AS s FROM {_D})")
def c26_token_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T.token_sentences("text")
    return _docs(spark, sf_dir).select("doc_id", F.size(s).alias("n_sentences"), F.when(F.size(s) > 0, F.aggregate(s, F.lit(0).cast("bigint"), lambda a, x: a + F.size(x))).alias("n_tokens"))
