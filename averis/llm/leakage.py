"""Problem 9: passages of held-out items inside corpus documents.

The normalised 12-grams of the test items become a table with 64-bit hashes, built once. Where it has at most
``MAX_GRAMS`` hashes they are broadcast as one sorted array; every document is then scanned once, all windows of a batch
of documents being hashed and looked up together. Above that bound the windows of the documents are joined with the
grams instead. A window found is only a candidate: it meets the item's gram by its hash and is verified letter by letter.
Hits give (document, item) and the spans to remove.

Words are compared in the form of problem 10: the hash is taken over prototypes in which letters that may be read for
each other are folded, and the verification reads a letter drawn like several (see ``lookalike``) as each of them.

Defined results: null and empty texts have no words; an item of fewer than ``n`` words leaks nowhere; a document is
reported once per item; repeated items are reported each under their own id; any other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from averis.llm.lookalike import EITHER, SPECIAL, reading
from averis.session import store

#: Hashes of item grams that are broadcast (8 bytes each).
MAX_GRAMS = 4_000_000
_WORD = re.compile(r"[^\W_]+")
_RUN = regex.compile(r"[\p{L}\p{N}\p{M}\p{Cf}]+")
_HIT = "array<struct<h:bigint,gram:string,lo:int,hi:int>>"


def words(text: str) -> list[str]:
    """Words of the one form of ``text``, lower-cased."""
    return _WORD.findall((reading(text) if SPECIAL.search(text) else text).lower())


def placed(text: str) -> list[tuple[str, int, int]]:
    """The same words, each with the raw span it comes from."""
    if not SPECIAL.search(text):
        low = text.lower()
        return [(m.group(), m.start(), m.end()) for m in _WORD.finditer(low)]
    return [(w, m.start(), m.end()) for m in _RUN.finditer(text) for w in words(m.group())]


class _Hashes(dict):
    """word -> hash of the word with letters that may be read for each other folded."""

    def __missing__(self, w: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[w] = h = xxhash.xxh64_intdigest(w.replace("i", "l").replace(EITHER, "l"))
        return h


def windows(texts: list[list[str]], n: int, hashes: _Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, first word) of every window of ``n`` words that lies within one text."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    flat = np.fromiter((hashes[w] for t in texts for w in t), dtype=np.uint64, count=int(sizes.sum()))
    if len(flat) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.zeros(len(flat) - n + 1, dtype=np.uint64)
    for j in range(n):
        at += flat[j : j + len(at)] * np.uint64(pow(0x9E3779B97F4A7C15, j + 1, 1 << 64))
    owner = np.repeat(np.arange(len(texts)), sizes)
    inside = np.flatnonzero(owner[: len(at)] == owner[n - 1 :])
    first = np.cumsum(sizes) - sizes
    return at[inside].view(np.int64), owner[inside], inside - first[owner[inside]]


def _scanner(n: int, grams):
    """Arrow function: text -> its windows whose hash is in the broadcast ``grams`` (None: all its windows)."""

    @F.pandas_udf(_HIT)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known, hashes = None if grams is None else grams.value, _Hashes()
        for s in batches:
            h, owner, first = windows([words(t) for t in s], n, hashes)
            if known is not None and len(known):
                hit = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
                h, owner, first = h[hit], owner[hit], first[hit]
            out: list[list] = [[] for _ in range(len(s))]
            texts, ws, last = list(s), [], -1
            for x, d, i in zip(h.tolist(), owner.tolist(), first.tolist()):
                if d != last:
                    ws, last = placed(texts[d]), d
                out[d].append((x, " ".join(w for w, _, _ in ws[i : i + n]), ws[i][1], ws[i + n - 1][2]))
            yield pd.Series(out, dtype=object)

    return scan


def alike(a: str, b: str) -> bool:
    """Whether two lower-cased readings are the same letter by letter."""
    either = (EITHER + "i", EITHER + "l", "i" + EITHER, "l" + EITHER)
    return a == b or (len(a) == len(b) and all(x == y or x + y in either for x, y in zip(a, b)))


def leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, n: int = 12) -> DataFrame:
    """(doc_id, item_id, spans): leaked items of each document with the raw spans [start, end) in code points, sorted."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text IS NOT NULL")
    grams = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).where("text IS NOT NULL")
    grams = store(grams.select("item_id", F.inline(_scanner(n, None)("text"))).select("item_id", "h", F.col("gram").alias("want")).distinct(), "grams")
    hashes = grams.select("h").distinct()
    known = None
    if hashes.count() <= MAX_GRAMS:
        known = docs.sparkSession.sparkContext.broadcast(np.sort(np.array([r["h"] for r in hashes.collect()], dtype=np.int64)))
        if not len(known.value):
            return rows.select("doc_id").limit(0).crossJoin(grams.select("item_id").limit(0)).withColumn("spans", F.array(F.array(F.lit(0))))
    hits = rows.select("doc_id", F.inline(_scanner(n, known)("text")))

    @F.pandas_udf("boolean")
    def verified(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([alike(x, y) for x, y in zip(a, b)], dtype=bool)

    met = hits.join(grams, "h")
    met = met.where((F.col("gram") == F.col("want")) | verified("gram", "want"))
    return met.groupBy("doc_id", "item_id").agg(F.sort_array(F.collect_list(F.array("lo", "hi"))).alias("spans"))


def without_spans(docs: DataFrame, doc_id: str, text: str, found: DataFrame) -> DataFrame:
    """(doc_id, text) of every document, leaked spans cut out."""
    cuts = found.groupBy("doc_id").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("cuts"))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        res = []
        for t, s in zip(texts, spans):
            if t is None or s is None:
                res.append(t)
                continue
            keep, at = [], 0
            for a, b in s:
                keep.append(t[at : max(at, a)])
                at = max(at, b)
            res.append("".join(keep) + t[at:])
        return pd.Series(res, dtype=object)

    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return d.join(cuts, "doc_id", "left").select("doc_id", cut("text", "cuts").alias("text"))
