"""Linear pair methods: feature blocks of documents, differences of pairs, a logistic regression of each corpus.

Every corpus has its own vocabulary, scaling and weights: features are keyed by corpus, and a pair holds features of its own
corpus only. Either a task fits a corpus (``logistic``: fevec, dv), or all are in one distributed fit, a constant of each
corpus being its intercept (stylospeaker): the sum falls apart into one problem a corpus, so the weights are the same. Vocabularies and scales come from documents of
training pairs alone. Documents: ``corpus, doc_id, text, train``; pairs: ``corpus, pair_id, a, b, train, label``.

Defined results: pairs with a null text have no row; a pair without a common or differing feature has the zero vector; a
corpus without training pairs gets the prediction of zero weights; copies of one text in a corpus are one document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

from averis.functions import text as T
from averis.operators import features as FE
from averis.operators import grams as G
from averis.operators import logistic as LR
from averis.operators.scorers import drawn
from averis.session import store

#: Value of a corpus' constant: large, so that its weight is small and the penalty on it next to nothing.
CONSTANT = 100.0


def documents_and_pairs(cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``cases``: case_id, masking, topic, known, unknown, split, y_true. Distinct texts of a corpus, and the pairs of them."""
    key = lambda c: F.concat_ws("|", "masking", "topic", F.md5(F.col(c).cast("binary")))
    c = cases.where("known IS NOT NULL AND unknown IS NOT NULL").withColumns({"corpus": F.concat_ws("|", "masking", "topic"), "a": key("known"), "b": key("unknown"), "train": F.col("split") == "train"})
    both = c.select("corpus", "train", F.inline(F.array(F.struct(F.col("a").alias("doc_id"), F.col("known").alias("text")), F.struct(F.col("b").alias("doc_id"), F.col("unknown").alias("text")))))
    docs = both.groupBy("corpus", "doc_id").agg(F.any_value("text").alias("text"), F.max("train").alias("train"))
    return store(docs, "docs"), store(c.select("corpus", F.col("case_id").alias("pair_id"), "a", "b", "train", F.col("y_true").cast("double").alias("label")), "pairs")


def style(docs: DataFrame) -> DataFrame:
    """F12 as a long table (corpus, doc_id, feature, value): marks, word properties, tags, sentences, function words and
    phrases, richness, readability, contractions; what is absent is 0."""
    tok = store(FE.token_table(docs), "tokens")
    s = F.greatest(F.lit(1), F.size(T.sentences("text")))
    sentences = docs.select("doc_id", s.alias("sentences"), (F.size(T.tokens("text")) / s).alias("mean_sentence"))
    long = lambda d: d.select("doc_id", F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in d.columns if c != "doc_id"])))
    parts = [FE.mark_counts(docs), FE.counts(tok.withColumn("tag", F.when(F.col("tag") == "PROPN", "NOUN").otherwise(F.col("tag"))), "tag"), FE.counts(tok.where(F.col("low").isin(*FE.FUNCTION_WORDS)), "low"), FE.phrase_counts(docs, list(FE.PHRASES))]
    made = [p.select("doc_id", F.concat(F.lit(f"{i}."), "feature").alias("feature"), F.col("n").cast("double").alias("value")) for i, p in enumerate(parts)]
    made += [long(p) for p in (FE.word_properties(tok), sentences, FE.yule_hapax(tok), FE.readability(docs), FE.contraction_totals(docs, list(FE.CONTRACTIONS)))]
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return docs.select("corpus", "doc_id").join(out, "doc_id").where("value <> 0")


#: V8: characters 3..6, words 1..3, tags 1..3 (2,000 features each); the style vector over its deviation comes beside them.
SPEAKER = {"char": G.Block(G.characters(3, 6), top=2000), "word": G.Block(lambda d: G.grams(d["word2"], 1, 3), top=2000), "pos": G.Block(lambda d: G.grams(G.word_tags(d), 1, 3), top=2000)}
#: V7: characters 1..3 inside words, tags 1..3, chunks 1..3, subtrees, special characters, function words, masked words, word
#: lengths, richness, tag shares; all over their deviation.
VECTOR = {
    "char": G.Block(G.inside_words(1, 3)), "pos": G.Block(lambda d: G.grams(G.marked_tags(d), 1, 3)), "chunk": G.Block(lambda d: G.grams(G.chunks(d), 1, 3)), "subtree": G.Block(G.subtrees), "masked": G.Block(lambda d: G.grams(G.masked(d), 1, 3)),
    "special": G.Block(lambda d: G._SPECIAL.findall(d["text"]), min_df=0.0), "function": G.Block(G.function_shares, plain=True), "length": G.Block(G.length_histogram, plain=True), "richness": G.Block(G.richness, plain=True), "tag": G.Block(G.tag_shares, plain=True),
}
#: Function words, word lengths, sentence lengths, marks, tag, word and character n-grams.
BINARY = {
    "function": G.Block(lambda d: [w for w in d["words"] if w in G._FUNCTION], 0.02), "length": G.Block(lambda d: [str(len(w)) for w in d["words"]], 0.02), "mark": G.Block(lambda d: G._MARK.findall(d["text"]), 0.02), "pos": G.Block(lambda d: G.grams(G.marked_tags(d), 1, 3), 0.02),
    "word": G.Block(lambda d: G.grams(d["words"], 1, 2), 0.02), "char": G.Block(G.characters(2, 4), 0.02), "sentence": G.Block(G.sentence_lengths, plain=True),
}


def learned(docs: DataFrame, blocks: dict[str, G.Block], reads: list[str], others: DataFrame | None = None, train: DataFrame | None = None) -> tuple[DataFrame, G.Vocabulary, dict[str, int]]:
    """Documents as arrays (corpus, doc_id, train, i, v), the vocabulary of the training documents (``train``: corpus, text,
    else those of ``docs``), and their number by corpus."""
    train = docs.where("train") if train is None else train
    size = store(train.groupBy("corpus").agg(F.count(F.lit(1)).alias("docs")), "size")
    v = G.vocabulary(G.counted(G.sources(train, reads, ["corpus"]), blocks), size, blocks, others)
    by = [c for c in docs.columns if c != "text"]
    return G.documents(G.sources(docs, reads, by), blocks, v), v, {r.corpus: r.docs for r in size.collect()}


def chosen(x: DataFrame, v: G.Vocabulary, top: int = 50_000) -> np.ndarray:
    """By place 1 for the ``top`` features of each corpus of highest chi2 against the text's author, ties by name, else
    infinite. ``x``: corpus, author, i, v of training documents."""
    share = x.groupBy("corpus", "author").agg(F.count(F.lit(1)).alias("k")).withColumn("p", F.col("k") / F.sum("k").over(Window.partitionBy("corpus")))
    rows = x.where("author IS NOT NULL").join(share.select("corpus", "author", "p"), ["corpus", "author"]).repartition("corpus", "author").sortWithinPartitions("corpus", "author")
    width = len(v)

    # sum over authors of (o - t p)^2 / (t p), t the feature's total, needs only the authors that have it: the rest adds up to t
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, s, last, share, held, n = np.zeros(width), np.zeros(width), None, 1.0, [], 0

        def added() -> tuple[np.ndarray, np.ndarray]:
            u, inv = np.unique(np.concatenate([i for i, _ in held]), return_inverse=True)
            return u, np.bincount(inv, np.concatenate([w for _, w in held]), len(u))

        for b in batches:
            i, w = b.column("i"), b.column("v")
            for k, (who, p) in enumerate(zip(zip(b.column("corpus").to_pylist(), b.column("author").to_pylist()), b.column("p").to_pylist())):
                if who != last or n > 2_000_000:
                    if held:
                        u, o = added()
                        if who == last:
                            held, n = [(u, o)], len(u)
                        else:
                            t[u] += o
                            s[u] += o * o / share
                    if who != last:
                        held, n, last, share = [], 0, who, p
                held.append((i[k].values.to_numpy(), w[k].values.to_numpy()))
                n += len(held[-1][0])
        if held:
            u, o = added()
            t[u] += o
            s[u] += o * o / share
        yield G.totals(t, s)

    t, s = G.gathered(rows.select("corpus", "author", "p", "i", "v").mapInArrow(run, "i int, s double, q double"), width)
    out = np.full(width, np.inf)
    chi, of = np.where(t > 0, s / np.where(t > 0, t, 1) - t, -np.inf), np.array(v.corpus)
    for c in sorted(set(v.corpus)):
        at = np.flatnonzero((of == c) & (t > 0))
        out[at[np.argsort(-chi[at], kind="stable")[:top]]] = 1.0
    return out


def paired(pairs: DataFrame, x: DataFrame, over: np.ndarray) -> DataFrame:
    """``pairs`` with i, v of |a - b|, each document's values divided by ``over``."""
    sent = x.sparkSession.sparkContext.broadcast(over)
    ends = [x.select(F.col("doc_id").alias(k), F.col("i").alias("i" + k), F.col("v").alias("v" + k)) for k in "ab"]
    own = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sd = sent.value
        for b in batches:
            ia, va, ib, vb = (b.column(k) for k in ("ia", "va", "ib", "vb"))
            at, values = [], []
            for k in range(b.num_rows):
                i = np.concatenate([ia[k].values.to_numpy(), ib[k].values.to_numpy()])
                v = np.concatenate([va[k].values.to_numpy(), -vb[k].values.to_numpy()]) / sd[i]
                order = np.argsort(i, kind="stable")
                i, v = i[order], v[order]
                again = np.flatnonzero(i[1:] == i[:-1])
                v[again] += v[again + 1]
                v[again + 1] = 0.0
                v = np.abs(v)
                keep = v > 1e-12
                at.append(i[keep])
                values.append(v[keep])
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in own], G.listed(at, pa.int32()), G.listed(values, pa.float64())], [*own, "i", "v"])

    j = pairs.join(ends[0], "a").join(ends[1], "b").select(*own, "ia", "va", "ib", "vb")
    return j.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in pairs.dtypes) + ", i array<int>, v array<double>")


def instances(d: DataFrame, width: int) -> DataFrame:
    """Pairs with their sparse ``vector``, the constant of their corpus behind the features. The table is written as the
    structure that a vector is, and read as vectors."""
    corpora = sorted(r.corpus for r in d.select("corpus").distinct().collect())
    place = F.create_map(*[F.lit(x) for k, c in enumerate(corpora) for x in (c, width + k)])[F.col("corpus")] if corpora else F.lit(width)
    vector = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(width + max(1, len(corpora))).alias("size"), F.concat("i", F.array(place)).alias("indices"), F.concat("v", F.array(F.lit(CONSTANT))).alias("values"))
    out = d.select("corpus", "pair_id", "train", "label", vector.alias("vector"))
    return store(out, "rows", schema=StructType([*out.schema.fields[:-1], StructField("vector", VectorUDT())]))


def scaled(x: DataFrame, docs: DataFrame) -> DataFrame:
    """Values over their deviation among the corpus' training documents, absent ones being 0; a deviation of 0 counts as 1.
    Means are left out: they cancel in differences."""
    size = docs.where("train").groupBy("corpus").agg(F.count(F.lit(1)).alias("docs"))
    seen = x.join(docs.where("train").select("corpus", "doc_id"), ["corpus", "doc_id"], "left_semi")
    s = seen.groupBy("corpus", "feature").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q")).join(F.broadcast(size), "corpus")
    var = F.col("q") / F.col("docs") - F.pow(F.col("s") / F.col("docs"), 2)
    s = s.select("corpus", "feature", F.when(var > 1e-18, F.sqrt(var)).otherwise(1.0).alias("sd"))
    return x.join(s, ["corpus", "feature"]).select("corpus", "doc_id", "feature", (F.col("value") / F.col("sd")).alias("value"))


def differences(pairs: DataFrame, x: DataFrame, rescale: bool = False) -> DataFrame:
    """(corpus, pair_id, feature, value): |a - b|, over its deviation among training pairs if ``rescale``."""
    ends = F.array(F.struct(F.col("a").alias("doc_id"), F.lit(1.0).alias("sign")), F.struct(F.col("b").alias("doc_id"), F.lit(-1.0).alias("sign")))
    d = pairs.select("corpus", "pair_id", F.inline(ends)).join(x, ["corpus", "doc_id"]).groupBy("corpus", "pair_id", "feature").agg(F.abs(F.sum(F.col("sign") * F.col("value"))).alias("value")).where("value > 1e-12")
    if not rescale:
        return d
    d = store(d, "differences")
    as_docs = pairs.select("corpus", F.col("pair_id").alias("doc_id"), "train")
    return scaled(d.withColumnRenamed("pair_id", "doc_id"), as_docs).withColumnRenamed("doc_id", "pair_id")


def vectors(pairs: DataFrame, d: DataFrame) -> DataFrame:
    """``pairs`` with a sparse ``vector``: features get their places by corpus and name, corpora their constants behind."""
    d = d.select("corpus", "pair_id", F.concat_ws("\u0001", "corpus", "feature").alias("f"), "value")
    constant = pairs.select("corpus", "pair_id", F.col("corpus").alias("f"), F.lit(CONSTANT).alias("value"))
    d = store(d.unionByName(constant), "entries")
    known = d.join(pairs.where("train").select("pair_id"), "pair_id", "left_semi").select("f").distinct()
    names = store(known.select("f", (F.row_number().over(Window.orderBy("f")) - 1).alias("i")), "names")  # vocabularies: bounded by their limits
    width = max(1, names.count())
    rows = d.join(names, "f").groupBy("pair_id").agg(F.sort_array(F.collect_list(F.struct("i", "value"))).alias("e"))

    @F.udf(VectorUDT())
    def sparse(e):
        return SparseVector(width, [x["i"] for x in e or []], [x["value"] for x in e or []])

    return pairs.join(rows, "pair_id", "left").select("corpus", "pair_id", "train", "label", sparse("e").alias("vector"))


def fit(rows: DataFrame, c: float = 1.0, max_iter: int = 100) -> LogisticRegressionModel:
    """Logistic regression with penalty |w|^2 / (2 C) on the sum of the losses, of all corpora at once."""
    return LogisticRegression(featuresCol="vector", labelCol="label", regParam=1 / (c * max(1, rows.count())), elasticNetParam=0.0, standardization=False, fitIntercept=False, maxIter=max_iter).fit(rows)


def tuned(rows: DataFrame, v: G.Vocabulary, over: np.ndarray, n: int, part: int, penalties: tuple[float, ...] = (1e-4, 1e-3, 1e-2, 1e-1, 1.0), most: int = 1000) -> tuple[np.ndarray, dict[str, float]]:
    """Weights and intercepts with the penalty that decides most held-out training pairs (a fifth, by hash) rightly, the
    strongest of equals; fitted with it on all ``n`` training pairs, of which ``part`` are not held out. A penalty is per pair,
    as in stochastic descent."""
    found = LR.each(rows, v, over, [p * n for p in penalties], most, [p * part for p in penalties])
    right = [sum(k for (_, j), (_, k) in found.items() if j == at) for at in range(len(penalties))]
    best = max(range(len(penalties)), key=lambda k: (right[k], penalties[k]))
    return LR.spread_out({c: f for (c, k), (f, _) in found.items() if k == best}, v, over)


def scored(model: LogisticRegressionModel, rows: DataFrame) -> DataFrame:
    """(pair_id, score): the probability of one author."""
    from pyspark.ml.functions import vector_to_array

    return model.transform(rows).select("pair_id", vector_to_array("probability")[1].alias("score"))


def _training_pairs(docs: DataFrame, max_pairs: int = 50_000, seed: int = 15) -> DataFrame:
    """R15 of the training documents of each corpus: all pairs of one author, and as many of two authors, both up to
    ``max_pairs`` (the method's own setting), drawn by digests where there are more. A text of several authors is a document
    of each. Documents are numbered with those of an author in one run, so that any pair is a number and only the pairs that
    are taken are made."""
    d = store(docs.where("train AND author IS NOT NULL").select("corpus", "doc_id", "author"), "authored")
    runs = d.groupBy("corpus", "author").agg(F.count(F.lit(1)).alias("n"))
    start = F.sum("n").over(Window.partitionBy("corpus").orderBy("author").rowsBetween(Window.unboundedPreceding, -1))
    runs = store(runs.withColumn("start", F.coalesce(start, F.lit(0))), "runs")
    placed = d.join(runs.hint("merge"), ["corpus", "author"]).select("corpus", "doc_id", (F.col("start") + F.row_number().over(Window.partitionBy("corpus", "author").orderBy("doc_id")) - 1).alias("at"))
    placed = store(placed, "placed")

    def draw(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("start")
        n, first = t["n"].to_numpy(np.int64), t["start"].to_numpy(np.int64)
        same, i, j = same_author(n, first, max_pairs, f"{seed}|{key[0]}|same")
        _, p, q = other_author(n, first, same, f"{seed}|{key[0]}|other")
        return pd.DataFrame({"corpus": key[0], "x": np.concatenate([i, p]), "y": np.concatenate([j, q]), "label": np.repeat([1.0, 0.0], [len(i), len(p)])})

    made = store(runs.groupBy("corpus").applyInPandas(draw, "corpus string, x bigint, y bigint, label double"), "drawn")
    for k, side in (("x", "a"), ("y", "b")):
        made = made.join(placed.select("corpus", F.col("doc_id").alias(side), F.col("at").alias(k)).hint("merge"), ["corpus", k])
    return made.select("corpus", "a", "b", "label", F.xxhash64("a", "b", "label").alias("pair_id"), F.lit(True).alias("train"))


def _numbers(m: int, k: int, key: str) -> np.ndarray:
    """``k`` of the numbers below ``m``, all if there are no more."""
    return np.arange(m, dtype=np.int64) if m <= k else np.sort(np.array(drawn(m, k, key), dtype=np.int64))


def same_author(n: np.ndarray, first: np.ndarray, most: int, key: str) -> tuple[int, np.ndarray, np.ndarray]:
    """How many pairs are taken, and both their documents; authors have ``n`` documents from number ``first`` on."""
    ends = np.cumsum(n * (n - 1) // 2)
    t = _numbers(int(ends[-1]) if len(ends) else 0, most, key)
    who = np.searchsorted(ends, t, side="right")
    t = t - (ends - n * (n - 1) // 2)[who]
    j = ((1 + np.sqrt(8.0 * t + 1)) / 2).astype(np.int64)
    j -= j * (j - 1) // 2 > t
    j += j * (j + 1) // 2 <= t
    return len(t), first[who] + t - j * (j - 1) // 2, first[who] + j


def other_author(n: np.ndarray, first: np.ndarray, most: int, key: str) -> tuple[int, np.ndarray, np.ndarray]:
    """The same of pairs of two authors: each document with those behind its author's run."""
    behind = int(n.sum()) - first - n
    ends = np.cumsum(n * behind)
    t = _numbers(int(ends[-1]) if len(ends) else 0, most, key)
    who = np.searchsorted(ends, t, side="right")
    t = t - (ends - n * behind)[who]
    return len(t), first[who] + t // behind[who], first[who] + n[who] + t % behind[who]


def stylospeaker(cases: DataFrame, run: int = 1) -> DataFrame:
    docs, pairs = documents_and_pairs(cases)
    s = store(scaled(style(docs), docs), "style")
    x, v, _ = learned(docs, SPEAKER, ["chars", "word2", "toks"], s.select("corpus", F.lit("style").alias("block"), "feature").distinct())
    at = docs.sparkSession.createDataFrame([(c, n[6:], k) for k, (c, n) in enumerate(zip(v.corpus, v.name)) if n.startswith("style:")], "corpus string, feature string, k int")
    s = s.join(F.broadcast(at), ["corpus", "feature"]).groupBy("doc_id").agg(F.collect_list(F.struct("k", "value")).alias("e"))
    x = x.join(s.hint("merge"), "doc_id", "left")
    x = x.select("doc_id", F.concat("i", F.coalesce("e.k", F.array().cast("array<int>"))).alias("i"), F.concat("v", F.coalesce("e.value", F.array().cast("array<double>"))).alias("v"))
    rows = instances(paired(pairs, store(x, "vectors"), np.ones(len(v))), len(v))
    return _joined(cases, scored(fit(rows.where("train")), rows))


def fevec(cases: DataFrame, run: int = 1) -> DataFrame:
    docs, pairs = documents_and_pairs(cases)
    x, v, size = learned(docs, VECTOR, ["text", "blanked", "toks", "lettered"])
    x = store(x, "vectors")
    over = G.deviations(x.where("train"), v, size)
    d = store(paired(pairs.where("train"), x, over).withColumn("held", F.pmod(F.xxhash64("pair_id", F.lit(3)), F.lit(5)) == 0), "differences")
    rows = d.groupBy("corpus", "held").count().collect()
    count: dict[str, int] = {}
    for r in rows:
        count[r.corpus] = count.get(r.corpus, 0) + r["count"]
    w, start = tuned(d, v, G.deviations(d, v, count), sum(count.values()), sum(r["count"] for r in rows if not r.held))
    return _joined(cases, LR.probabilities(d.select("corpus", "pair_id", "i", "v").unionByName(paired(pairs.where("NOT train"), x, over).select("corpus", "pair_id", "i", "v")), w, start))


def authored(cases: DataFrame) -> DataFrame:
    """(corpus, doc_id, author): the distinct texts of each author in the training cases."""
    key = lambda c: F.concat_ws("|", "masking", "topic", F.md5(F.col(c).cast("binary")))
    c = cases.where("split = 'train' AND known IS NOT NULL AND unknown IS NOT NULL")
    return c.select(F.concat_ws("|", "masking", "topic").alias("corpus"), F.inline(F.array(F.struct(key("known").alias("doc_id"), F.col("known_author").alias("author")), F.struct(key("unknown").alias("doc_id"), F.col("unknown_author").alias("author"))))).distinct()


def own_pairs(entries: DataFrame) -> DataFrame:
    """The training pairs of ``authored`` texts; the method refuses a corpus of fewer than two authors, so it has none."""
    several = entries.groupBy("corpus").agg(F.min("author").alias("lo"), F.max("author").alias("hi")).where("lo < hi").select("corpus")
    return _training_pairs(entries.join(F.broadcast(several), "corpus", "left_semi").withColumn("train", F.lit(True)))


def dv(cases: DataFrame, run: int = 1) -> DataFrame:
    """Trained on pairs of its own from the distinct training documents, applied to the cases; the 50,000 features of highest
    chi2 in each corpus. A document is a text and its author, so a text of two authors counts twice."""
    docs, pairs = documents_and_pairs(cases)
    entries = store(authored(cases), "authors")
    x, v, _ = learned(docs, BINARY, ["text", "chars", "toks", "words", "lens"], train=docs.join(entries.select("doc_id", "author"), "doc_id"))
    x = store(x, "vectors")
    over = chosen(x.join(entries.select("doc_id", "author"), "doc_id"), v)
    own = store(paired(own_pairs(entries), x, over), "own")
    w, start = LR.spread_out({c: f for (c, _), (f, _) in LR.each(own.withColumn("held", F.lit(False)), v, over, [1.0], 1000).items()}, v, over)
    return _joined(cases, LR.probabilities(paired(pairs, x, over), w, start))


def _joined(cases: DataFrame, scores: DataFrame) -> DataFrame:
    return cases.join(scores.withColumnRenamed("pair_id", "case_id"), "case_id", "left")


SCORERS: dict[str, Callable[[DataFrame, int], DataFrame]] = {"stylospeaker": stylospeaker, "fevec": fevec, "dv": dv}
