"""The queries of the training-data operators over whole tables, and SQL for those that have any."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from averis.functions.names import pair_key, pair_side, speaker_key, split_key
from averis.llm import distinct, leakage, lookalike, packing, pieces, pii, reading, sentences, splits
from averis.plans.delivery import _SPLIT, sql_side
from averis.session import store, table

PROPORTIONS = {"train": 0.8, "validation": 0.1, "test": 0.1}


def sides(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """(case_id, side, text): every known and unknown text as a row of its own, read in one scan."""
    c = table(spark, sf_dir, "read_corpus_sorted")
    both = F.array(F.struct(F.lit("known").alias("side"), F.col("known").alias("text")), F.struct(F.lit("unknown").alias("side"), F.col("unknown").alias("text")))
    return c.select("case_id", *more, F.inline(both))


# ---- 1 ----
def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "read_corpus_sorted").select("case_id", "pair", "known_author", "unknown_author", "known_videos", "unknown_videos")
    name = lambda author, n: F.coalesce(F.nullif(speaker_key(author), F.lit("")), F.lower(F.nullif(pair_side("pair", n), F.lit(""))))
    speakers = F.transform(F.filter(F.array(name("known_author", 1), name("unknown_author", 2)), lambda x: x.isNotNull()), lambda x: splits.vertex("speaker", x))
    videos = F.concat(F.coalesce("known_videos", F.array().cast("array<string>")), F.coalesce("unknown_videos", F.array().cast("array<string>")))
    keys = F.concat(speakers, F.transform(F.filter(videos, lambda x: x.isNotNull()), lambda x: splits.vertex("video", x)))
    return splits.components(c, "case_id", keys)


def p1_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.assign(_grouped(spark, sf_dir), "case_id", PROPORTIONS).select("case_id", "split")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = _grouped(spark, sf_dir)
    pairs = table(spark, sf_dir, "read_corpus_sorted").select("case_id", F.lower(pair_key("pair")).alias("p"))
    seen = table(spark, sf_dir, "predictions").select("pair", split_key("split").alias("s")).where("s IN ('train', 'test')").distinct()
    seen = seen.select(F.lower(pair_key("pair")).alias("p"), F.when(F.col("s") == "train", 1).otherwise(2).alias("s"))
    seen = seen.where(F.contains("p", F.lit("\u0001"))).groupBy("p").agg(F.bit_or("s").alias("s"))
    torn = groups.join(pairs, "case_id").join(seen, "p").groupBy("root").agg(F.bit_or("s").alias("s")).where("s = 3").select("root")
    return groups.join(torn, "root", "left_semi").select("case_id")


# ---- 3 ----
def p3_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = distinct.log_entropy(sides(spark, sf_dir), ["case_id", "side"], "text")
    return w.select("case_id", "side", "term", "tf", F.round("weight", 6).alias("weight"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = distinct.log_entropy(sides(spark, sf_dir), ["case_id", "side"], "text", min_tf=4)
    return w.where("df <= 8").select("case_id", "side", "term")


# ---- 4 ----
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = sides(spark, sf_dir)
    return sentences.sentence_ends(texts, ["case_id", "side"], "text", sentences.fit(texts, "case_id", "text"))


def p4_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = sides(spark, sf_dir)
    return sentences.sentences(texts, ["case_id", "side"], "text", sentences.fit(texts, "case_id", "text"))


# ---- 5 ----
def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.pieces(sides(spark, sf_dir), ["case_id", "side"], "text")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_pieces(spark, sf_dir).where("piece = 2").select("case_id", "side")


# ---- 6 ----
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = sides(spark, sf_dir, "masking").where("masking = 'original'")
    spans = pii.personal_data(texts, ["case_id", "side"], "text")
    return spans.select("case_id", "side", F.explode(F.array_distinct(F.transform("spans", lambda x: F.struct(x["kind"].alias("kind"), x["pii"].alias("pii"))))).alias("s")).select("case_id", "side", "s.kind", "s.pii")


def p6_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.masked(sides(spark, sf_dir), ["case_id", "side"], "text")


# ---- 7 ----
def p7_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every non-empty text of both maskings; the level is null where no graded sample has a word of it in its language."""
    samples = reading.read_samples(table(spark, sf_dir, "reading_labels"))
    return reading.with_level(sides(spark, sf_dir, "masking", "lang"), ["case_id", "side"], "lang", "text", samples, keep=True).select("case_id", "side", "level")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = reading.read_samples(table(spark, sf_dir, "reading_labels"))
    texts = sides(spark, sf_dir, "masking", "lang").where("masking = 'original'")
    return reading.with_level(texts, ["case_id", "side"], "lang", "text", samples).where("level = 4").select("case_id", "side")


# ---- 8 ----
def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_packed(spark, sf_dir).where("n_pieces > 1 AND piece = 1").select(F.col("id").alias("doc_id"))


# ---- 9, 10 ----
def _leaks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    return docs, leakage.leaks(docs, "doc_id", "text", table(spark, sf_dir, "heldout_items"), "item_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir)[1].select("doc_id", "item_id")


def p9_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, found = _leaks(spark, sf_dir)
    return leakage.without_spans(docs, "doc_id", "text", found)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lookalike.alike_pairs(docs, "doc_id", "text", lookalike.fit_speller(docs, "text"))


def p10_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of alike texts and its class of equal texts, each named by its smallest id."""
    docs = table(spark, sf_dir, "documents")
    c = store(lookalike.alike_classes(docs, "doc_id", "text", lookalike.fit_speller(docs, "text")), "classes")
    first = lambda k, out: c.groupBy(k).agg(F.min("id").alias(out))
    return c.join(first("form", "form_id"), "form").join(first("text", "text_id"), "text").select(F.col("id").alias("doc_id"), "form_id", "text_id")


def p10_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lookalike.with_form(docs, "text", "form", lookalike.fit_speller(docs, "text")).select("doc_id", "form")


QUERIES = {f.__name__: f for f in (p1_found, p1_splits, p3_found, p3_weights, p4_found, p4_sentences, p5_found, p5_pieces, p6_found, p6_masked, p7_found, p7_levels, p8_found, p8_packed, p9_found, p9_clean, p10_found, p10_classes, p10_forms)}

_SIDES = "(SELECT case_id, 'known' AS side, known AS text FROM read_corpus_sorted UNION ALL SELECT case_id, 'unknown', unknown FROM read_corpus_sorted)"
_TERMS = f"""t AS (SELECT case_id, side, unnest(regexp_extract_all(lower(text), '\\p{{L}}{{4,}}')) AS term FROM {_SIDES} WHERE text IS NOT NULL),
c AS (SELECT case_id, side, term, count(*) AS tf FROM t GROUP BY ALL)"""
SQL = {
    "p3_found": f"WITH {_TERMS} SELECT case_id, side, term FROM (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM c) WHERE tf >= 4 AND df <= 8",
    "p3_weights": f"""WITH {_TERMS}, n AS (SELECT log2(count(*)) AS n FROM {_SIDES} WHERE text IS NOT NULL),
s AS (SELECT term, sum(tf) AS g, sum(tf * log2(tf)) AS s FROM c GROUP BY term)
SELECT case_id, side, term, tf, round(log2(1 + tf) * greatest(0, 1 - (log2(g) - s / g) / n), 6) AS weight FROM c JOIN s USING (term), n""",
    "p5_found": f"SELECT case_id, side FROM {_SIDES} WHERE length(text) > 3000",
}


def _form_sql(c: str) -> str:
    """The form of problem 10 by table alone: equal exactly where the spelled forms are."""
    pairs = []
    for code in [*range(0xA0, 0x3100), *range(0xFF00, 0xFFF0)]:
        to = unicodedata.normalize("NFC", lookalike.PROTO[code])
        if len(to) == 1 and to != chr(code) and unicodedata.normalize("NFC", chr(code)) == chr(code) and not unicodedata.combining(chr(code)):
            pairs.append((chr(code), to))
    for a, b in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        c = f"replace({c}, '{a}', '{b}')"
    c = f"regexp_replace({c}, '[\\p{{Cf}}\\x{{34f}}\\x{{115f}}\\x{{1160}}\\x{{3164}}\\x{{fe00}}-\\x{{fe0f}}]', '', 'g')"
    quote = lambda s: s.replace("'", "''")
    c = f"nfc_normalize(translate(translate({c}, chr(9), ' '), '{quote(''.join(a for a, _ in pairs))}', '{quote(''.join(b for _, b in pairs))}'))"
    return f"trim(regexp_replace(regexp_replace({c}, ' *\\n *', chr(10), 'g'), ' {{2,}}', ' ', 'g'), ' ')"


_DOC_FORMS = f"f AS (SELECT doc_id, text, {_form_sql('text')} AS form FROM documents WHERE text IS NOT NULL)"
SQL["p10_found"] = f"WITH {_DOC_FORMS} SELECT a.doc_id AS doc_lo, b.doc_id AS doc_hi FROM f a JOIN f b ON a.form = b.form AND a.doc_id < b.doc_id AND a.text <> b.text"
SQL["p10_classes"] = f"WITH {_DOC_FORMS} SELECT doc_id, min(doc_id) OVER (PARTITION BY form) AS form_id, min(doc_id) OVER (PARTITION BY text) AS text_id FROM f"
_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
_GRAM = "SELECT DISTINCT {0}, array_to_string(w[i:i+11], ' ') AS g FROM (SELECT {0}, w, unnest(range(1, greatest(1, len(w) - 10))) AS i FROM {1})"
SQL["p9_found"] = f"""WITH {_DOC_FORMS}, dw AS (SELECT doc_id, {_WORDS.format('form')} AS w FROM f), iw AS (SELECT item_id, {_WORDS.format(_form_sql('text'))} AS w FROM heldout_items WHERE text IS NOT NULL),
ig AS ({_GRAM.format('item_id', 'iw')}), dg AS ({_GRAM.format('doc_id', 'dw')}) SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)"""
_SPEAKER = lambda c, n: f"lower(coalesce(nullif(trim(regexp_replace(nfc_normalize({c}), '[\\s\\x{{a0}}]+', ' ', 'g')), ''), {sql_side('pair', n)}))"
SQL["p1_found"] = f"""WITH RECURSIVE k AS MATERIALIZED (SELECT DISTINCT case_id, unnest(list_concat(['s:' || {_SPEAKER('known_author', 1)}, 's:' || {_SPEAKER('unknown_author', 2)}], list_transform(list_concat(coalesce(known_videos, []), coalesce(unknown_videos, [])), lambda v: 'v:' || v))) AS key FROM read_corpus_sorted),
e AS MATERIALIZED (SELECT DISTINCT a.case_id AS x, b.case_id AS y FROM k a JOIN k b USING (key)),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
c AS (SELECT x AS case_id, min(y) AS root FROM r GROUP BY x),
p AS (SELECT lower({sql_side('pair', 1)}) AS a, lower({sql_side('pair', 2)}) AS b, {_SPLIT} AS s FROM (SELECT DISTINCT pair, split FROM predictions)),
q AS (SELECT a, b, bool_or(s = 'train') AS tr, bool_or(s = 'test') AS te FROM p WHERE a <> '' GROUP BY ALL),
j AS (SELECT root, bool_or(tr) AS tr, bool_or(te) AS te FROM c JOIN read_corpus_sorted USING (case_id) JOIN q ON q.a = lower({sql_side('pair', 1)}) AND q.b = lower({sql_side('pair', 2)}) GROUP BY root)
SELECT case_id FROM c JOIN j USING (root) WHERE tr AND te"""
