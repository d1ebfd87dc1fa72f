"""Feature blocks of documents, made in Python a document at a time: n-grams counted where the text is, nothing exploded.

A block is a function from a document's sources to its n-grams (or to named values). The first pass counts in how many
training documents a feature is, summed up in each task before anything is shuffled; the second keeps of each document the
features of its corpus' vocabulary, as arrays of places and values. Vocabularies are broadcast: cut by ``min_df`` they hold
at most 1 / min_df x the features of a mean document for each corpus. Patterns over Unicode classes run in the JVM.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import repeat
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from averis.functions import text as T
from averis.operators import features as FE
from averis.session import store

#: Features that a task counts before it hands them on.
HELD = 400_000
BLANKS = r"[ \t\n\r\x{0b}\f\x{85}\x{a0}\x{2000}-\x{200a}\x{202f}\x{3000}]"
#: What blocks read, as Columns of the text.
SOURCES: dict[str, Callable[[Column], Column]] = {
    "text": lambda t: t,
    "chars": lambda t: F.regexp_replace(F.lower(t), BLANKS + "{2,}", " "),
    "blanked": lambda t: F.filter(F.split(F.lower(t), BLANKS + "+"), lambda x: x != ""),
    "toks": lambda t: T.tokens(t),
    "words": lambda t: T.words(t),
    "word2": lambda t: F.regexp_extract_all(F.lower(t), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)),
    "lettered": lambda t: F.filter(T.tokens(t), lambda x: x.rlike(r"\p{L}")),
    "lens": lambda t: F.transform(T.sentences(t), lambda s: F.size(T.tokens(s))),
}


@dataclass(frozen=True)
class Block:
    """``make`` gives n-grams, weighed by TF-IDF of unit length, or (``plain``) a dict of values that are taken as they are."""

    make: Callable[[dict], list | dict]
    min_df: float = 0.1
    top: int | None = None
    plain: bool = False


@dataclass
class Vocabulary:
    """Features in order of corpus, block and name; a feature's place is its row. ``places`` counts from 1."""

    corpus: list = field(default_factory=list)
    name: list = field(default_factory=list)
    idf: np.ndarray = field(default_factory=lambda: np.zeros(0))
    places: dict = field(default_factory=dict)

    def __len__(self) -> int:
        return len(self.name)


# ---- what a document has ----
_CLASS = {w: k for k, ws in reversed(FE.CLASSES.items()) for w in ws}
_ADJ = re.compile(FE.SHAPES[1][0])
_ENDINGS = ("en", "ern", "eln", "ing", "te", "ten", "tet", "ed")
_TAGS: dict[str, str] = {}
_CHUNK = re.compile(FE.CHUNK)
_MARK = re.compile(FE.MARK_TOKEN)
_SPECIAL = re.compile(r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]\^_`{¦}~]""")
_FUNCTION = frozenset(FE.FUNCTION_WORDS)


def tag(token: str) -> str:
    """``features.tag`` of one token."""
    kinds = [unicodedata.category(c) for c in token]
    if kinds[0][0] == "N":
        return "NUM"
    if len(token) == 1 and token in "%&+=€$@#§°":
        return "SYM"
    if not any(k[0] in "LN" for k in kinds) and "_" not in token:
        return "PUNCT"
    if (k := _CLASS.get(token.lower())) is not None:
        return k
    if kinds[:2] == ["Lu", "Ll"]:
        return "NOUN"
    if _ADJ.search(token):
        return "ADJ"
    if any(token.endswith(e) and kinds[-len(e) - 2 : -len(e)] == ["Ll", "Ll"] for e in _ENDINGS):
        return "VERB"
    return "X"


def tags(d: dict) -> list[str]:
    found = d.get("tags")
    if found is None:
        if len(_TAGS) > 300_000:
            _TAGS.clear()
        found = []
        for t in d["toks"]:
            k = _TAGS.get(t)
            if k is None:
                k = _TAGS[t] = tag(t)
            found.append(k)
        d["tags"] = found
    return found


def grams(a: list[str], lo: int, hi: int) -> list[str]:
    out = []
    for n in range(lo, hi + 1):
        out += a if n == 1 else map(" ".join, zip(*(a[i:] for i in range(n))))
    return out


def characters(lo: int, hi: int) -> Callable[[dict], list]:
    def make(d: dict) -> list:
        x, out = d["chars"], []
        a = list(x)
        for n in range(1, hi + 1):
            if n > 1:
                a = list(map(add, a, x[n - 1 :]))
            if n >= lo:
                out += a
        return out
    return make


def inside_words(lo: int, hi: int) -> Callable[[dict], list]:
    """``vectorize.char_wb``: a token shorter than ``lo`` with its blanks is its own n-gram once."""
    known: dict[str, list] = {}

    def make(d: dict) -> list:
        out = []
        for t in d["blanked"]:
            found = known.get(t)
            if found is None:
                if len(known) > 50_000:
                    known.clear()
                p = f" {t} "
                found = [p[i : i + n] for n in range(lo, hi + 1) for i in range(max(len(p) - n + 1, int(n == lo)))]
                if len(t) < 30:
                    known[t] = found
            out += found
        return out
    return make


def marked_tags(d: dict) -> list[str]:
    """Tags, marks and symbols as themselves."""
    return [t if k in ("PUNCT", "SYM") else k for t, k in zip(d["toks"], tags(d))]


def word_tags(d: dict) -> list[str]:
    return [k for k in tags(d) if k not in ("PUNCT", "SYM", "X")]


def chunks(d: dict) -> list[str]:
    return _CHUNK.sub("NP ", " ".join(tags(d)) + " ").split()


def subtrees(d: dict) -> list[str]:
    out, at, s = [], 0, " ".join(tags(d)) + " "
    for m in _CHUNK.finditer(s):
        out += [*s[at : m.start()].split(), f"NP[{m[0][:-1]}]"]
        at = m.end()
    return out + s[at:].split()


def masked(d: dict) -> list[str]:
    return [w if (w := t.lower()) in _FUNCTION else k for t, k in zip(d["toks"], tags(d))]


def function_shares(d: dict) -> dict:
    n = Counter(w for t in d["toks"] if (w := t.lower()) in _FUNCTION)
    return {k: v / (1 + len(d["toks"])) for k, v in n.items()}


def tag_shares(d: dict) -> dict:
    return {k: v / (1 + len(d["toks"])) for k, v in Counter(tags(d)).items()}


def length_histogram(d: dict) -> dict:
    """``features.length_histogram``."""
    n = [len(t) for t in d["toks"]]
    if not n:
        return {}
    return {"chars": sum(n), "avg_chars": round(sum(n) / len(n), 9)} | {f"len_{k}": round(c / len(n), 9) for k, c in Counter(n).items() if k <= 10}


def sentence_lengths(d: dict) -> dict:
    """``features.sentence_lengths``."""
    n = d["lens"]
    return {str(i): round(sum(x >= i for x in n) / len(n), 9) for i in range(3, min(69, max(n, default=0)) + 1)}


def richness(d: dict, window: int = 1000) -> dict:
    """``features.richness``."""
    w = [t.lower() for t in d["lettered"]]
    each = [_richness(w[i : i + window]) for i in range(0, len(w), window)]
    return {k: round(sum(m[k] for m in each) / len(each), 6) for k in each[0]} if each else {}


def _richness(w: list[str]) -> dict:
    f = Counter(Counter(w).values())
    n, v, v1, v2 = float(len(w)), float(sum(f.values())), f.get(1, 0), f.get(2, 0)
    s2 = sum(i * i * c for i, c in f.items())
    sp2, ent, si = s2 / (n * n), sum(-c * (i / n) * math.log(i / n) for i, c in f.items()), sum(c * (i / n) * (i - 1) for i, c in f.items())
    ln, lv = math.log(n), math.log(v)
    lnln = math.log(ln) if ln > 1 else 0.0
    return {
        "ttr": v / n, "guiraud_r": v / math.sqrt(n), "herdan_c": lv / ln if n > 1 else 0.0, "dugast_k": lv / lnln if lnln else 0.0, "maas_a2": (ln - lv) / (ln * ln) if n > 1 else 0.0,
        "dugast_u": ln * ln / (ln - lv) if n > v else 0.0, "tuldava_ln": (1 - v * v) / (v * v * ln) if n > 1 else 0.0, "brunet_w": n ** (v**-0.172), "cttr": v / math.sqrt(2 * n),
        "summer_s": math.log(lv) / lnln if lv > 0 and lnln else 0.0, "sichel_s": v2 / v, "michea_m": v / v2 if v2 else 0.0, "honore_h": 100 * ln / (1 - v1 / v) if v > v1 else 0.0,
        "herdan_vm": math.sqrt(sp2 - 1 / v) if sp2 >= 1 / v else 0.0, "entropy": ent, "yule_k": 10000 * (s2 - n) / (n * n), "simpson_d": si / (n - 1) if n > 1 else 0.0,
    }


# ---- passes over documents ----
def sources(docs: DataFrame, names: list[str], by: list[str]) -> DataFrame:
    """``by`` and the sources of each document's text, dealt out evenly: the cost of a row is the length of its text."""
    spark = docs.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return docs.repartition(tasks).select(*by, F.array(F.struct(*[SOURCES[n](F.col("text")).alias(n) for n in names])).alias("parts"))


def made(block: Block, parts: list[dict]) -> list | dict:
    """The block of a document; a document of several texts has the n-grams of each."""
    return block.make(parts[0]) if len(parts) == 1 else [g for p in parts for g in block.make(p)]


def counted(x: DataFrame, blocks: dict[str, Block]) -> DataFrame:
    """(corpus, block, feature, df, total) of ``x``: corpus, parts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, total = defaultdict(Counter), defaultdict(Counter)

        def out() -> Iterator[pa.RecordBatch]:
            for (corpus, block), c in df.items():
                t = total[corpus, block]
                n = len(c)
                yield pa.RecordBatch.from_arrays([pa.array([corpus] * n, pa.string()), pa.array([block] * n, pa.string()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64()), pa.array([t[k] for k in c], pa.int64())], ["corpus", "block", "feature", "df", "total"])
            df.clear()
            total.clear()

        for b in batches:
            for corpus, parts in zip(b.column("corpus").to_pylist(), b.column("parts").to_pylist()):
                for name, block in blocks.items():
                    g = made(block, parts)
                    df[corpus, name].update(set(g))
                    if block.top:
                        total[corpus, name].update(g)
            if sum(map(len, df.values())) > HELD:
                yield from out()
        yield from out()

    c = x.mapInArrow(run, "corpus string, block string, feature string, df bigint, total bigint")
    return c.groupBy("corpus", "block", "feature").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def vocabulary(counts: DataFrame, size: DataFrame, blocks: dict[str, Block], others: DataFrame | None = None) -> Vocabulary:
    """Features in at least ``min_df`` of a corpus' documents, of a block with ``top`` so many of highest total, ties by name.
    ``size``: corpus, docs. ``others``: corpus, block, feature of blocks made elsewhere."""
    least, top = F.lit(0.0), F.lit(None).cast("int")
    for k, b in blocks.items():
        least = F.when(F.col("block") == k, 0.0 if b.plain else b.min_df).otherwise(least)
        top = F.when(F.col("block") == k, F.lit(b.top).cast("int")).otherwise(top)
    v = counts.join(F.broadcast(size), "corpus").where(F.col("df") >= least * F.col("docs"))
    if any(b.top for b in blocks.values()):
        v = v.withColumn("r", F.row_number().over(Window.partitionBy("corpus", "block").orderBy(F.desc("total"), "feature"))).where(top.isNull() | (F.col("r") <= top))
    v = v.select("corpus", "block", "feature", (F.log((1.0 + F.col("docs")) / (1 + F.col("df"))) + 1).alias("idf"))
    if others is not None:
        v = v.unionByName(others.select("corpus", "block", "feature", F.lit(1.0).alias("idf")))
    t = v.orderBy("corpus", "block", "feature").toArrow()
    corpus, block, feature = (t.column(k).to_pylist() for k in ("corpus", "block", "feature"))
    out = Vocabulary(corpus, [f"{b}:{f}" for b, f in zip(block, feature)], t.column("idf").to_numpy().copy(), {})
    for i, (c, b, f) in enumerate(zip(corpus, block, feature)):
        out.places.setdefault((c, b), {})[f] = i + 1
    return out


def vector(corpus: str, parts: list[dict], blocks: dict[str, Block], places: dict, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places, in order, and values of a document."""
    at, values = [], []
    for name in sorted(blocks):
        here = places.get((corpus, name))
        if here is None:
            continue
        g = made(blocks[name], parts)
        if blocks[name].plain:
            e = sorted((here[k], v) for k, v in g.items() if k in here)
            i, v = np.array([p for p, _ in e], dtype=np.int32) - 1, np.array([v for _, v in e], dtype=float)
        else:
            i = np.fromiter(map(here.get, g, repeat(0)), np.int32, len(g))
            i = i[i > 0]
            lo = i.min() if len(i) else 1
            n = np.bincount(i - lo)  # a block's places lie together
            i = np.flatnonzero(n)
            n, i = n[i], i + (lo - 1)
            v = n * idf[i]
            v /= math.sqrt(v @ v) or 1.0
        at.append(i.astype(np.int32))
        values.append(v)
    return (np.concatenate(at), np.concatenate(values)) if at else (np.zeros(0, np.int32), np.zeros(0))


def listed(flat: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """An Arrow array of lists."""
    ends = np.concatenate([[0], np.cumsum([len(x) for x in flat])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat) if flat else np.zeros(0), kind))


def documents(x: DataFrame, blocks: dict[str, Block], v: Vocabulary) -> DataFrame:
    """``x`` (corpus, doc_id, parts and others) with i, v instead of the parts."""
    own = [c for c in x.columns if c != "parts"]
    sent = x.sparkSession.sparkContext.broadcast((v.places, v.idf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, idf = sent.value
        for b in batches:
            both = [vector(c, p, blocks, places, idf) for c, p in zip(b.column("corpus").to_pylist(), b.column("parts").to_pylist())]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in own], listed([i for i, _ in both], pa.int32()), listed([w for _, w in both], pa.float64())], [*own, "i", "v"])

    return x.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in x.dtypes if c != "parts") + ", i array<int>, v array<double>")


def rows(x: DataFrame, blocks: dict[str, Block], v: Vocabulary) -> DataFrame:
    """(doc_id, feature, value) of ``x``: corpus, doc_id, parts; a row for each feature of a document."""
    sent = x.sparkSession.sparkContext.broadcast((v.places, v.idf, pa.array(v.name, pa.string())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, idf, names = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, 200):  # some hundred rows come of each
                b = whole.slice(at, 200)
                both = [vector(c, p, blocks, places, idf) for c, p in zip(b.column("corpus").to_pylist(), b.column("parts").to_pylist())]
                of = np.repeat(np.arange(len(both)), [len(i) for i, _ in both])
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(of)), names.take(pa.array(np.concatenate([i for i, _ in both]))), pa.array(np.concatenate([w for _, w in both]))], ["doc_id", "feature", "value"])

    return x.mapInArrow(run, f"doc_id {dict(x.dtypes)['doc_id']}, feature string, value double")


def sums(x: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of values and of their squares by place, over the rows (i, v) of ``x``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, q = np.zeros(width), np.zeros(width)
        for b in batches:
            i, v = b.column("i").flatten().to_numpy(), b.column("v").flatten().to_numpy()
            s += np.bincount(i, v, width)
            q += np.bincount(i, v * v, width)
        yield totals(s, q)

    return gathered(x.select("i", "v").mapInArrow(run, "i int, s double, q double"), width)


def totals(s: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero((s != 0) | (q != 0)).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(at), pa.array(s[at]), pa.array(q[at])], ["i", "s", "q"])


def gathered(x: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """One row a feature: bounded as the vocabulary."""
    t = x.groupBy("i").agg(F.sum("s").alias("s"), F.sum("q").alias("q")).toArrow()
    s, q = np.zeros(width), np.zeros(width)
    s[t.column("i").to_numpy()], q[t.column("i").to_numpy()] = t.column("s").to_numpy(), t.column("q").to_numpy()
    return s, q


def deviations(x: DataFrame, v: Vocabulary, size: dict[str, int]) -> np.ndarray:
    """By place the deviation over ``size[corpus]`` rows, absent values being 0; a deviation of 0 counts as 1, and a feature
    that no row has is infinite, so that its values become 0."""
    s, q = sums(x, len(v))
    n = np.array([max(1, size.get(c, 1)) for c in v.corpus], dtype=float)
    var = q / n - (s / n) ** 2
    return np.where(q == 0, np.inf, np.where(var > 1e-18, np.sqrt(np.maximum(var, 0)), 1.0))
