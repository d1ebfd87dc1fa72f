"""Readers of the file formats: transcripts, case corpora, word lists, contraction and misspelling lists, result CSVs.

Files are read as distributed rows (path, content); nothing is listed or opened on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from averis.functions import text as T
from averis.functions import udfs as U
from averis.functions.names import split_key

RUNS = "topic string, masking string, model string, run int, acc double, auc double, f1 double, prec double, rec double, tp int, fn int, fp int, tn int, N int"
PREDICTIONS = "topic string, masking string, model string, run int, split string, pair string, y_true int, y_pred int, score double, aligned int"


def _path(c: Column, back: int) -> Column:
    """The ``back``-th part of a path from its end, percent-decoding undone."""
    return F.url_decode(F.regexp_replace(F.element_at(F.split(c, "/"), -back), r"\+", "%2B"))


def files(spark: SparkSession, root: str, glob: str = "*.txt") -> DataFrame:
    """(path, content): every file below ``root``, decoded with the fallback chain."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return raw.select("path", U.decode("content").alias("content"))


def transcripts(spark: SparkSession, root: str, strict: bool = False) -> DataFrame:
    """(topic, author, video_id, text) of ``<topic>/<author> - <id>.txt``; ``strict`` keeps only 11-character ids."""
    d = files(spark, root).select(_path(F.col("path"), 2).alias("topic"), F.regexp_replace(_path(F.col("path"), 1), r"\.txt$", "").alias("stem"), F.col("content").alias("text"))
    vid = F.nullif(F.regexp_extract("stem", r" - ([A-Za-z0-9_-]{11})$", 1), F.lit(""))
    d = d.select("topic", T.author_of("stem").alias("author"), vid.alias("video_id"), "text")
    return d.where("video_id IS NOT NULL") if strict else d


def case_corpus(spark: SparkSession, root: str, joint: str = " ") -> DataFrame:
    """(masking, topic, split, pair, known_author, unknown_author, known, unknown, label) of a tree
    ``<masking>/<topic>/<split>/<case>/*.txt``. Files that do not start with ``unknown`` are known; several files of a
    side are joined in name order by ``joint``; cases with a missing side are dropped; the label is equality of the
    authors named by the folder. Directory aliases of the splits are resolved (S20)."""
    p = F.col("path")
    d = files(spark, root).select(
        _path(p, 5).alias("masking"), _path(p, 4).alias("topic"), split_key(_path(p, 3)).alias("split"), _path(p, 2).alias("pair"), _path(p, 1).alias("file"), "content"
    ).where("file <> 'truth.txt'")
    side = F.when(F.col("file").startswith("unknown"), "unknown").otherwise("known")
    texts = d.groupBy("masking", "topic", "split", "pair", side.alias("side")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file", "content"))), lambda x: x["content"]), joint).alias("text"))
    both = texts.groupBy("masking", "topic", "split", "pair").agg(F.max(F.when(F.col("side") == "known", F.col("text"))).alias("known"), F.max(F.when(F.col("side") == "unknown", F.col("text"))).alias("unknown"))
    name = lambda i: F.regexp_extract("pair", r"^(?:\[[A-Za-z]\]\s*)?(.+?)\s+vs\.?\s+(.+?)\s*$", i)
    both = both.where("known IS NOT NULL AND unknown IS NOT NULL").withColumns({"known_author": name(1), "unknown_author": name(2)})
    return both.withColumn("label", (F.col("known_author") == F.col("unknown_author")).cast("int"))


def truth_lines(cases: DataFrame) -> DataFrame:
    """The lines of truth.txt."""
    return cases.select("masking", "topic", "split", F.concat("pair", F.lit(" "), F.when(F.col("label") == 1, "Y").otherwise("N")).alias("line"))


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """One entry a line, blank lines and # comments skipped, lower-cased."""
    w = spark.read.text(path).select(F.lower(T.strip("value")).alias("word"))
    return w.where("word <> '' AND NOT startswith(word, '#')")


def contraction_list(spark: SparkSession, path: str) -> DataFrame:
    """(short, long) of a tab-separated list."""
    return word_list(spark, path).where("contains(word, '\t')").select(T.strip(F.split_part("word", F.lit("\t"), F.lit(1))).alias("short"), T.strip(F.split_part("word", F.lit("\t"), F.lit(2))).alias("long"))


def json_word_lists(spark: SparkSession, path: str) -> DataFrame:
    """(kind, word) of a JSON object of word lists, as ``{"words": [...], "phrases": [...]}``; lower-cased."""
    lists = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("kind", "words"))
    return lists.select("kind", F.explode("words").alias("word")).select("kind", F.lower(T.strip("word")).alias("word")).where("word <> ''")


def json_contractions(spark: SparkSession, path: str, field: str = "contractions") -> DataFrame:
    """(short, long) of a JSON object that holds two lists under ``field``, the i-th entries of which belong together; what
    has no partner is left out."""
    lists = spark.read.text(path, wholetext=True).select(F.get_json_object("value", "$." + field).alias("v")).select(F.from_json("v", "array<array<string>>").alias("v"))
    pairs = lists.select(F.explode(F.arrays_zip(F.col("v")[0].alias("short"), F.col("v")[1].alias("long"))).alias("p"))
    return pairs.select(F.lower(T.strip("p.short")).alias("short"), F.lower(T.strip("p.long")).alias("long")).where("short IS NOT NULL AND long IS NOT NULL")


def misspellings(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """One column ``word`` of a list of the kind ``mis_words`` (behind //, comma separated), ``common_typos`` (last
    word of a line), ``brit_spelling`` (words of the first tab field) or ``determiner`` (first word)."""
    v = T.squeeze_ws(F.lower("value"))
    raw = spark.read.text(path).where(F.trim("value") != "")
    made = {
        "mis_words": F.transform(F.split(F.split_part(v, F.lit("//"), F.lit(2)), ","), lambda x: F.trim(x)),
        "common_typos": F.array(F.element_at(F.split(v, " "), -1)),
        "brit_spelling": F.split(F.trim(F.split_part(F.lower("value"), F.lit("\t"), F.lit(1))), r"\s+"),
        "determiner": F.array(F.element_at(F.split(v, " "), 1)),
    }
    if kind not in made:
        raise ValueError(f"unknown kind {kind!r}")
    return raw.select(F.explode(made[kind]).alias("word")).where("word <> ''").distinct()


def result_csv(spark: SparkSession, path: str, schema: str = PREDICTIONS) -> DataFrame:
    """Result files with a header; a missing ``aligned`` counts as 1."""
    d = spark.read.schema(schema).option("header", "true").csv(path)
    return d.fillna({"aligned": 1}) if "aligned" in d.columns else d
