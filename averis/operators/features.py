"""Stylometric features as aggregates over a token table (doc_id, pos, token, low, tag), one row per token.

A document's tokens leave one task in order, so the per-document aggregations combine map-side to a row per document
and value before anything is shuffled. Documents without tokens keep a row where a feature is defined for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from averis.functions import text as T

# The marks that are counted as whole tokens.
MARKS = (".", "?", "!", ",", ";", ":", "-", "--", "---", "..", "...", "(", ")", "[", "]", "'", '"', "`")
#: Tokens among which they are counted: a run of periods or hyphens is one token, any other mark stands alone.
MARK_TOKEN = r"""\.+|-+|[?!,;:()\[\]'"`]"""
#: Closed word classes of the stand-in tagger (de, en); a ``tags`` column of the documents replaces the tagger as a whole.
CLASSES = {
    "DET": ("der", "die", "das", "den", "dem", "des", "ein", "eine", "einen", "einem", "einer", "kein", "keine", "the", "a"),
    "ADP": ("in", "im", "an", "am", "auf", "aus", "bei", "mit", "nach", "von", "vor", "zum", "zur", "über", "unter", "durch", "für", "gegen", "ohne", "um", "of", "with"),
    "CCONJ": ("und", "oder", "aber", "denn", "and"),
    "SCONJ": ("weil", "dass", "wenn", "als", "ob", "that"),
    "PRON": ("ich", "du", "er", "sie", "es", "wir", "ihr", "mich", "dich", "sich", "uns", "euch", "mir", "dir", "ihm", "was", "wer", "it"),
    "AUX": ("ist", "sind", "war", "hat", "haben", "wird", "werden", "kann", "können", "is", "are"),
    "PART": ("zu", "nicht", "to"),
    "ADV": ("auch", "nur", "noch", "schon", "so", "wie", "wo", "hier", "da", "dann"),
    "INTJ": ("ja", "nein", "na", "ach", "äh", "oh"),
}
#: Function words: the closed classes but interjections. Any list, also one read from a file, may be passed instead.
FUNCTION_WORDS = tuple(w for k, ws in CLASSES.items() if k != "INTJ" for w in ws)
PHRASES = ("so ist das", "am ende", "das geht", "ich habe", "in der", "wir wollen", "of the", "in the")
CONTRACTIONS = (("im", "in dem"), ("am", "an dem"), ("zum", "zu dem"), ("zur", "zu der"), ("vom", "von dem"), ("beim", "bei dem"), ("ins", "in das"), ("ans", "an das"))
#: Shape rules for what no list holds, in order, after numbers and symbols: pattern of the token and its tag.
SHAPES = ((r"^\p{Lu}\p{Ll}", "NOUN"), (r"(lich|ig|isch|bar|sam|los|haft|ful|ous|ive)(e|en|er|es|em)?$", "ADJ"), (r"\p{Ll}{2}(en|ern|eln|ing|te|ten|tet|ed)$", "VERB"))
#: The tags counted, proper nouns being nouns.
TAGS = ("ADJ", "ADP", "ADV", "AUX", "CCONJ", "DET", "INTJ", "NOUN", "NUM", "PART", "PRON", "PUNCT", "SCONJ", "SYM", "VERB", "X")
#: A noun chunk as a pattern over tags that are each followed by a blank.
CHUNK = "(?:DET )?(?:ADJ )*(?:(?:NOUN|PROPN) )+"


def tag(token: Column) -> Column:
    """Deterministic stand-in tagger: numbers, symbols, marks, closed classes, shapes, else X."""
    low = F.lower(token)
    t = F.when(token.rlike(r"^\p{N}"), "NUM").when(token.rlike(r"^[%&+=€$@#§°]$"), "SYM").when(~token.rlike(r"[\p{L}\p{N}_]"), "PUNCT")
    for name, ws in CLASSES.items():
        t = t.when(low.isin(*ws), name)
    for pattern, name in SHAPES:
        t = t.when(token.rlike(pattern), name)
    return t.otherwise("X")


def chunks(tags: Column) -> Column:
    """ARRAY<STRING>: the tags, each noun chunk as one ``NP``."""
    s = F.regexp_replace(F.concat(F.array_join(tags, " "), F.lit(" ")), CHUNK, "NP ")
    return F.filter(F.split(s, " "), lambda x: x != "")


def subtrees(tags: Column) -> Column:
    """ARRAY<STRING>: the tags, each noun chunk with what it holds, as ``NP[DET NOUN]``."""
    s = F.regexp_replace(F.concat(F.array_join(tags, " "), F.lit(" ")), f"({CHUNK})", "\u0001NP[$1]\u0001")
    parts = F.flatten(F.transform(F.split(s, "\u0001"), lambda x: F.when(x.startswith("NP["), F.array(x)).otherwise(F.split(x, " "))))
    return F.filter(F.transform(parts, lambda x: F.replace(x, F.lit(" ]"), F.lit("]"))), lambda x: x != "")


def mark_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, feature, n) of the marks, counted as whole tokens."""
    t = docs.select("doc_id", F.explode(F.regexp_extract_all(F.col(text), F.lit(MARK_TOKEN), F.lit(0))).alias("feature"))
    return t.where(F.col("feature").isin(*MARKS)).groupBy("doc_id", "feature").agg(F.count(F.lit(1)).alias("n"))


def listed(tok: DataFrame, words: DataFrame, word: str = "word", by: str | None = None) -> DataFrame:
    """(doc_id, feature, n): tokens that a list holds. ``words`` is a table of lower-cased words, of any size; ``by`` counts by
    another of its columns (the dictionary a word stands in) instead of by word."""
    w = words.select(F.lower(word).alias("low"), F.col(by or word).alias("feature")).distinct()
    return tok.select("doc_id", "low").groupBy("doc_id", "low").agg(F.count(F.lit(1)).alias("n")).join(w, "low").groupBy("doc_id", "feature").agg(F.sum("n").alias("n"))


def phrase_counts(docs: DataFrame, phrases: list[str], whole: bool = True, text: str = "text") -> DataFrame:
    """(doc_id, feature, n), not overlapping, case aside; as whole words, or (``whole=False``) as substrings."""
    quoted = lambda p: "\\Q" + p.replace("\\E", "") + "\\E"
    pattern = lambda p: rf"(?<![\p{{L}}\p{{N}}_]){quoted(p)}(?![\p{{L}}\p{{N}}_])" if whole else quoted(p)
    low = docs.select("doc_id", F.lower(text).alias("x"))
    n = [F.struct(F.lit(p).alias("feature"), F.regexp_count("x", F.lit(pattern(p))).alias("n")) for p in phrases]
    return low.select("doc_id", F.inline(F.array(*n))).where("n > 0")


def contraction_totals(docs: DataFrame, pairs: list[tuple[str, str]], whole: bool = True, text: str = "text") -> DataFrame:
    """F8: (doc_id, contracted, expanded): how often any short and any long form occurs."""
    short, long = dict.fromkeys(p[0] for p in pairs), dict.fromkeys(p[1] for p in pairs)
    n = phrase_counts(docs, [*short, *[p for p in long if p not in short]], whole, text)
    total = lambda ps: F.coalesce(F.sum(F.when(F.col("feature").isin(*ps), F.col("n"))), F.lit(0))
    g = n.groupBy("doc_id").agg(total(short).alias("contracted"), total(long).alias("expanded"))
    return docs.select("doc_id").join(g, "doc_id", "left").fillna(0, ["contracted", "expanded"])


def token_table(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, pos, token, low, tag); with columns ``tokens`` and ``tags`` in ``docs`` those of a tagger outside."""
    if "tags" in docs.columns:
        t = docs.select("doc_id", F.posexplode(F.arrays_zip("tokens", "tags")).alias("pos", "t")).select("doc_id", "pos", F.col("t.tokens").alias("token"), F.col("t.tags").alias("tag"))
        return t.select("doc_id", "pos", "token", F.lower("token").alias("low"), "tag")
    t = docs.select("doc_id", F.posexplode(T.tokens(text)).alias("pos", "token"))
    return t.select("doc_id", "pos", "token", F.lower("token").alias("low"), tag(F.col("token")).alias("tag"))


def counts(tok: DataFrame, what: str) -> DataFrame:
    return tok.groupBy("doc_id", F.col(what).alias("feature")).agg(F.count(F.lit(1)).alias("n"))


def word_properties(tok: DataFrame) -> DataFrame:
    """over tokens that are no number, mark or symbol; capitals count only in words of five letters or more."""
    w = tok.where(~F.col("tag").isin("NUM", "PUNCT", "SYM"))
    n = F.length("token")
    types = w.groupBy("doc_id", "low").agg(F.count(F.lit(1)).alias("c"), F.sum(n).alias("chars"), F.count_if(n < 5).alias("short"), F.count_if(n >= 8).alias("long"), F.count_if((n >= 5) & F.col("token").rlike(r"^\p{Lu}")).alias("cap"))
    g = types.groupBy("doc_id").agg(F.sum("c").alias("words"), F.count(F.lit(1)).alias("types"), F.sum("chars").alias("chars"), F.sum("short").alias("s"), F.sum("long").alias("l"), F.sum("cap").alias("k"))
    r = lambda a: F.round(F.col(a) / F.col("words"), 9)
    return g.select("doc_id", "words", "types", r("chars").alias("avg_length"), r("s").alias("short_ratio"), r("l").alias("long_ratio"), r("k").alias("capital_ratio"), r("types").alias("type_ratio"))


def spectrum(tok: DataFrame, window: int | None = None) -> DataFrame:
    """Frequency spectrum: (doc_id[, w], i, f) with f types that occur i times, over lower-cased words."""
    w = tok.where(F.col("token").rlike(r"\p{L}"))
    by = ["doc_id"]
    if window:
        w = w.withColumn("w", F.floor((F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1) / window).cast("int"))
        by = ["doc_id", "w"]
    return w.groupBy(*by, "low").agg(F.count(F.lit(1)).alias("i")).groupBy(*by, "i").agg(F.count(F.lit(1)).alias("f"))


def yule_hapax(tok: DataFrame) -> DataFrame:
    """Yule's I (0 where undefined), shares of words that occur once and twice."""
    i, f = F.col("i"), F.col("f")
    g = spectrum(tok).groupBy("doc_id").agg(F.sum(i * f).alias("n"), F.sum(f).alias("v"), F.sum(i * i * f).alias("m2"), F.sum(F.when(i == 1, f).otherwise(0)).alias("v1"), F.sum(F.when(i == 2, f).otherwise(0)).alias("v2"))
    v, m2, n = F.col("v"), F.col("m2"), F.col("n")
    return g.select("doc_id", F.round(F.when(m2 > v, v * v / (m2 - v)).otherwise(0.0), 9).alias("yule_i"), F.round(F.col("v1") / n, 9).alias("hapax"), F.round(F.col("v2") / n, 9).alias("dis"))


def richness(tok: DataFrame, window: int = 1000) -> DataFrame:
    """F16: vocabulary measures per window of 1000 words, undefined ones 0, averaged over the windows of a document."""
    i, f = F.col("i").cast("double"), F.col("f").cast("double")
    n_all = F.sum(i * f).over(Window.partitionBy("doc_id", "w"))
    s = spectrum(tok, window).withColumn("nn", n_all)
    p = i / F.col("nn")
    g = s.groupBy("doc_id", "w").agg(
        F.max("nn").alias("n"), F.sum(f).alias("v"), F.sum(F.when(i == 1, f).otherwise(0.0)).alias("v1"), F.sum(F.when(i == 2, f).otherwise(0.0)).alias("v2"), F.sum(i * i * f).alias("s2"),
        F.sum(f * p * p).alias("sp2"), F.sum(-f * p * F.ln(p)).alias("entropy"), F.sum(f * p * (i - 1)).alias("si"),
    )
    n, v, v1, v2 = (F.col(x) for x in ("n", "v", "v1", "v2"))
    ln, lv = F.ln(n), F.ln(v)
    zero = lambda ok, x: F.coalesce(F.when(ok, F.nanvl(x, F.lit(0.0))), F.lit(0.0))
    m = {
        "ttr": v / n, "guiraud_r": v / F.sqrt(n), "herdan_c": zero(n > 1, lv / ln), "dugast_k": zero(ln > 1, lv / F.ln(ln)), "maas_a2": zero(n > 1, (ln - lv) / (ln * ln)),
        "dugast_u": zero(n > v, ln * ln / (ln - lv)), "tuldava_ln": zero(n > 1, (1 - v * v) / (v * v * ln)), "brunet_w": F.pow(n, F.pow(v, F.lit(-0.172))), "cttr": v / F.sqrt(2 * n),
        "summer_s": zero((lv > 0) & (ln > 1), F.ln(lv) / F.ln(ln)), "sichel_s": v2 / v, "michea_m": zero(v2 > 0, v / v2), "honore_h": zero(v > v1, 100 * ln / (1 - v1 / v)),
        "herdan_vm": zero(F.col("sp2") >= 1 / v, F.sqrt(F.col("sp2") - 1 / v)), "entropy": F.col("entropy"), "yule_k": 10000 * (F.col("s2") - n) / (n * n), "simpson_d": zero(n > 1, F.col("si") / (n - 1)),
    }
    each = g.select("doc_id", *[e.alias(k) for k, e in m.items()])
    return each.groupBy("doc_id").agg(*[F.round(F.avg(k), 6).alias(k) for k in m])


def readability(docs: DataFrame, text: str = "text") -> DataFrame:
    """published formulas over characters, words, sentences and vowel-group syllables; no words, no row. Difficult words
    are those of three syllables or more; the Linsear formula takes the first 100 words and their share of the sentences."""
    w = F.filter(T.tokens(text), lambda t: t.rlike(r"\p{L}"))
    d = docs.select("doc_id", w.alias("w"), F.greatest(F.lit(1), F.size(T.sentences(text))).cast("double").alias("s")).where(F.size("w") > 0)
    d = d.select("doc_id", "s", F.size("w").cast("double").alias("n"), F.aggregate("w", F.lit(0), lambda a, t: a + F.length(t)).cast("double").alias("c"), F.transform("w", T.syllables).alias("y"))
    d = d.select("*", F.aggregate("y", F.lit(0), lambda a, x: a + x).cast("double").alias("syl"), F.size(F.filter("y", lambda x: x >= 3)).cast("double").alias("poly"))
    n, s, c, syl, poly = (F.col(x) for x in ("n", "s", "c", "syl", "poly"))
    asl, asw = n / s, syl / n
    first = F.slice("y", 1, 100)
    hard = F.size(F.filter(first, lambda x: x >= 3))
    linsear = (F.size(first) + 2 * hard) / F.greatest(F.lit(1.0), s * F.least(F.lit(1.0), 100 / n))
    share = 100 * poly / n
    m = {
        "linsear": F.when(linsear > 20, linsear / 2).otherwise((linsear - 2) / 2), "difficult_words": poly, "dale_chall": 0.1579 * share + 0.0496 * asl + F.when(share > 5, 3.6365).otherwise(0.0),
        "flesch_en": 206.835 - 1.015 * asl - 84.6 * asw, "amstad_de": 180 - asl - 58.5 * asw, "kincaid": 0.39 * asl + 11.8 * asw - 15.59, "smog": 1.043 * F.sqrt(poly * 30 / s) + 3.1291,
        "coleman_liau": 5.88 * c / n - 29.6 * s / n - 15.8, "ari": 4.71 * c / n + 0.5 * asl - 21.43, "fog": 0.4 * (asl + 100 * poly / n),
    }
    return d.select("doc_id", *[F.round(e, 6).alias(k) for k, e in m.items()])


def length_histogram(tok: DataFrame) -> DataFrame:
    """Characters without white space, mean token length, shares of tokens of 1..10 characters."""
    n = F.length("token")
    g = tok.groupBy("doc_id").agg(F.sum(n).alias("chars"), F.count(F.lit(1)).alias("tokens"), *[F.count_if(n == k).alias(f"c{k}") for k in range(1, 11)])
    return g.select("doc_id", "chars", F.round(F.col("chars") / F.col("tokens"), 9).alias("avg_chars"), *[F.round(F.col(f"c{k}") / F.col("tokens"), 9).alias(f"len_{k}") for k in range(1, 11)])


def sentence_lengths(docs: DataFrame, text: str = "text", top: int = 69) -> DataFrame:
    """(doc_id, i, share) of sentences with at least i tokens, i in 3..69, where the share is above 0."""
    lens = F.transform(T.sentences(text), lambda s: F.size(T.tokens(s)))
    d = docs.select("doc_id", lens.alias("l")).where(F.size("l") > 0)
    e = d.select("doc_id", "l", F.explode(F.sequence(F.lit(3), F.least(F.lit(top), F.greatest(F.lit(3), F.array_max("l"))))).alias("i"))
    return e.select("doc_id", "i", F.round(F.size(F.filter("l", lambda x: x >= F.col("i"))) / F.size("l"), 9).alias("share")).where("share > 0")
