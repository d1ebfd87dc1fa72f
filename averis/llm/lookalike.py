"""Problem 10: one form for texts that look alike.

A token (a run of letters, marks and ignorable characters) is matched against the vocabulary of the corpus by walking a
trie with a weighted edit automaton. Its edits are: read a look-alike letter for the trie's letter (cost 0; a letter
drawn like several, as the palochka like I and l, may be read as each of them), skip an ignorable character (cost 0),
read another width, ligature or composition of the same letters (cost 0); anything else costs 1 and the default budget
is 0. Of the words reached one without special characters is canonical before others, then the most frequent, then the
smallest. Tokens that reach none are normalised by table: every letter to its prototype, composed. Blanks count alike
whatever their width or number; line breaks stay.

The vocabulary is every spelling of the corpus, of whatever script, that some special token could reach: words are
counted over all rows, words and special tokens meet by a coarse key (the prototypes, with letters that may be read for
each other folded), and keys are dealt to buckets of bounded size. Each bucket builds the trie of its words and walks its
tokens through it, so the vocabulary has no limit. What differs from the table is kept as a table of spellings; it is
broadcast where it has at most ``MAX_SPELLINGS`` rows and joined to the tokens of the texts otherwise.

Defined results: null text -> null; empty text -> empty text; texts of any length are processed whole; a text with no
special character is returned unchanged but for its blanks.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from averis.session import store

# Letters of other scripts drawn as a Latin letter is, in pairs "other latin".
_PAIRS = (
    "а a, е e, о o, р p, с c, х x, у y, і i, ј j, ѕ s, ԁ d, һ h, ԛ q, ԝ w, ӏ l, ү y, "
    "А A, В B, Е E, Ѕ S, І I, Ј J, К K, М M, Н H, О O, Р P, С C, Т T, Х X, Ү Y, Ԍ G, Ԛ Q, Ԝ W, Ӏ I, "
    "Α A, Β B, Ε E, Ζ Z, Η H, Ι I, Κ K, Μ M, Ν N, Ο O, Ρ P, Τ T, Υ Y, Χ X, ο o, ν v, ρ p, ϲ c, ϳ j, Ϲ C, "
    "օ o, ɡ g, ɑ a, ‐ -, ‑ -, ∶ :"
)
LOOKALIKES = dict(p.strip().split(" ") for p in _PAIRS.split(", "))
#: Letters drawn as I and as l alike; ``EITHER`` stands for them where a text is read letter by letter.
AMBIGUOUS = "ІӀӏΙ"
EITHER = "\u01c0"
#: Invisible characters besides format characters: grapheme joiner, Hangul fillers, variation selectors.
_INVISIBLE = {0x034F, 0x115F, 0x1160, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10)}
_BREAKS = "\n\r\x0b\x0c\x85  "


class _Prototypes(dict):
    """code point -> prototype string, filled on demand; usable with str.translate."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        kind = unicodedata.category(c)
        if c in _BREAKS:
            p = "\n"
        elif kind == "Zs" or c == "\t":
            p = " "
        elif kind == "Cf" or code in _INVISIBLE:
            p = ""
        elif c in LOOKALIKES:
            p = LOOKALIKES[c]
        else:
            d = unicodedata.decomposition(c)
            tag, rest = (d.split(" ", 1) if d.startswith("<") else ("", d))
            form = tag in ("", "<wide>", "<narrow>", "<noBreak>") or (tag == "<compat>" and (0xFB00 <= code <= 0xFB06 or 0x2160 <= code <= 0x217F or 0x132 <= code <= 0x133 or 0x1C4 <= code <= 0x1CC))
            p = "".join(self[int(x, 16)] for x in rest.split()) if d and form else c
            if not d and 0xAC00 <= code <= 0xD7A3:
                p = unicodedata.normalize("NFD", c)
        self[code] = p
        return p


PROTO = _Prototypes()
TOKEN = regex.compile(r"[\p{L}\p{M}\p{Cf}]+|[^\p{L}\p{M}\p{Cf}\x21-\x7e]+")
#: Texts without any of these are their own form but for blanks: ASCII, Latin-1 letters, plain punctuation, CJK, kana.
SPECIAL = re.compile("[^\\x20-\\x7e\\n¡-¬®-ÿ–-„…、-〩ぁ-ゖゝ-ヾ一-鿿]")
_BLANKS = re.compile(r" *\n *| {2,}")
_TOKEN_JVM = r"[\p{L}\p{M}\p{Cf}]+"
#: Rows of the table of spellings that may be broadcast, and tokens and words of a bucket.
MAX_SPELLINGS = 500_000
BUCKET = 50_000


class _Readings(_Prototypes):
    """Prototypes, but ambiguous letters as ``EITHER``."""

    def __missing__(self, code: int) -> str:
        self[code] = p = EITHER if chr(code) in AMBIGUOUS else PROTO[code]
        return p


READ = _Readings()


def table_form(s: str) -> str:
    return unicodedata.normalize("NFC", s.translate(PROTO))


def reading(s: str) -> str:
    return unicodedata.normalize("NFC", s.translate(READ))


def coarse(s: str) -> str:
    """Key under which every two spellings that the automaton takes for each other fall."""
    return reading(s).replace("I", "l").replace(EITHER, "l")


def tidy_blanks(s: str) -> str:
    return _BLANKS.sub(lambda m: "\n" if "\n" in m.group() else " ", s).strip(" ")


def _tidy(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r" *\n *", "\n"), " {2,}", " "))


def _latin_only(s: str) -> bool:
    return regex.fullmatch(r"[\p{Latin}\p{M}]*", s) is not None


def clean(word: str) -> bool:
    """A spelling fit for the vocabulary: composed, no ignorables or presentation forms, one script, not wholly look-alike."""
    if unicodedata.normalize("NFC", word) != word or any(PROTO[ord(c)] == "" or ord(c) >= 0xFB00 for c in word):
        return False
    letters = [c for c in word if c.isalpha()]
    scripts = {unicodedata.name(c, "?").split(" ")[0] for c in letters}
    if len(scripts) != 1:
        return False
    return scripts == {"LATIN"} or not _latin_only(table_form(word))


class Speller:
    """Vocabulary trie (implicit in the sorted word list) with the weighted automaton, and the fallback table. ``known``
    holds spellings that were found before."""

    def __init__(self, counts: dict[str, int], budget: int = 0, cache_size: int = 200_000, known: dict[str, str] | None = None):
        self.words = sorted(counts)
        self.counts = counts
        self.budget = budget
        self.cache_size = cache_size
        self.known = known or {}
        self.cache: dict[str, str] = {}

    def reach(self, token: str) -> list[tuple[int, str]]:
        """(cost, word) for every vocabulary word the automaton reaches from ``token`` within the budget."""
        want = unicodedata.normalize("NFD", token.translate(READ))
        found, words = [], self.words
        stack = [(0, len(words), 0, 0, 0)]  # range of words sharing a prefix, its length, position in the token, cost
        while stack:
            lo, hi, depth, at, cost = stack.pop()
            while lo < hi and len(words[lo]) == depth:
                if cost + len(want) - at <= self.budget:
                    found.append((cost + len(want) - at, words[lo]))
                lo += 1
            while lo < hi:
                prefix = words[lo][: depth + 1]
                end = bisect_left(words, prefix + "\U0010ffff", lo, hi)
                p = unicodedata.normalize("NFD", READ[ord(prefix[-1])])
                if want.startswith(p, at) or (p in ("I", "l", EITHER) and want[at : at + 1] in ((EITHER,) if p != EITHER else ("I", "l"))):
                    stack.append((lo, end, depth + 1, at + len(p), cost))
                elif cost < self.budget:
                    stack += [(lo, end, depth + 1, at, cost + 1), (lo, end, depth + 1, at + 1, cost + 1)]
                lo = end
        return found

    def spell(self, token: str) -> str:
        got = self.known.get(token) or self.cache.get(token)
        if got is None:
            best = min(((cost, SPECIAL.search(w) is not None, -self.counts[w], w) for cost, w in self.reach(token)), default=None) if self.words else None
            got = best[3] if best else table_form(token)
            if len(self.cache) >= self.cache_size:
                self.cache.clear()
            self.cache[token] = got
        return got

    def form(self, text: str) -> str:
        if SPECIAL.search(text):
            spell = self.spell
            text = TOKEN.sub(lambda m: spell(m.group()), text)
        return tidy_blanks(text)


@dataclass(frozen=True)
class Spelling:
    """(token, word): the canonical spelling of every token of the corpus that the table would spell otherwise."""

    table: DataFrame
    rows: int

    def collected(self) -> dict[str, str] | None:
        return {r["token"]: r["word"] for r in self.table.collect()} if self.rows <= MAX_SPELLINGS else None


def _walked(rows: pd.DataFrame) -> pd.DataFrame:
    """A bucket's special tokens through the trie of its words; those that the table would spell otherwise."""
    speller = Speller({w: n for w, n in zip(rows["w"], rows["n"]) if clean(w)})
    spelled = [(t, speller.spell(t)) for t in rows["w"][rows["special"]]]
    return pd.DataFrame([(t, w) for t, w in spelled if w != table_form(t)], columns=["token", "word"])


def fit_speller(df: DataFrame, text: str) -> Spelling:
    """Spellings of all special tokens of all rows, found in tries of all words they could reach."""
    words = df.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(_TOKEN_JVM), F.lit(0))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    words = store(words.withColumn("special", F.col("w").rlike(SPECIAL.pattern)), "words")

    @F.pandas_udf("string")
    def key(s: pd.Series) -> pd.Series:
        return pd.Series([coarse(x) for x in s], dtype=object)

    special = store(words.where("special").withColumn("key", key("w")), "special")
    plain = words.where("NOT special").withColumn("key", F.translate("w", "I", "l")).join(special.select("key").distinct(), "key", "left_semi")
    met = store(special.unionByName(plain.select(*special.columns)), "met")
    buckets = 1 + met.count() // BUCKET
    found = met.groupBy(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket")).applyInPandas(_walked, "token string, word string")
    found = store(found, "spelling")
    return Spelling(found, found.count())


def with_form(df: DataFrame, text: str, out: str, spelling: Spelling) -> DataFrame:
    """``df`` with column ``out``: the one form of ``text``; other columns pass through untouched. Texts without special
    characters stay in the JVM."""
    special = F.col(text).rlike(SPECIAL.pattern)
    known = spelling.collected()
    if known is not None:
        shared = df.sparkSession.sparkContext.broadcast(known)

        @F.pandas_udf("string")
        def form(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            f = Speller({}, known=shared.value).form
            for s in batches:
                yield pd.Series([None if x is None else f(x) for x in s], dtype=object)

        return df.withColumn(out, F.coalesce(form(F.when(special, F.col(text))), _tidy(F.col(text))))

    # the table is too large to be sent everywhere: every text meets the spellings of its own tokens
    digest = F.sha2(F.col(text).cast("binary"), 256)
    texts = df.where(special).select(digest.alias("_text"), F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(_TOKEN_JVM), F.lit(0)))).alias("token")).where(F.col("token").rlike(SPECIAL.pattern)).distinct()
    own = texts.join(spelling.table, "token").groupBy("_text").agg(F.collect_list("token").alias("_tokens"), F.collect_list("word").alias("_words"))

    @F.pandas_udf("string")
    def form_of(ts: pd.Series, tokens: pd.Series, words: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else Speller({}, known=dict(zip(a, b)) if a is not None else None).form(t) for t, a, b in zip(ts, tokens, words)], dtype=object)

    met = df.withColumn("_text", F.when(special, digest)).join(own, "_text", "left")
    return met.withColumn(out, F.coalesce(form_of(F.when(special, F.col(text)), "_tokens", "_words"), _tidy(F.col(text)))).drop("_text", "_tokens", "_words")


def alike_classes(df: DataFrame, row_id: str, text: str, spelling: Spelling) -> DataFrame:
    """(id, form, text): each row's class of texts that look alike and its class of equal texts, as 32-digit digests."""
    two = lambda c: F.concat(*[F.lpad(F.hex(F.xxhash64(c, F.lit(seed))), 16, "0") for seed in (0, 7)])
    keyed = with_form(df.select(F.col(row_id).alias("id"), F.col(text).alias("t")).where("t IS NOT NULL"), "t", "f", spelling)
    return keyed.select("id", two("f").alias("form"), two("t").alias("text"))


def alike_pairs(df: DataFrame, row_id: str, text: str, spelling: Spelling) -> DataFrame:
    """Pairs (doc_lo, doc_hi) with different texts of one form; pairs are made between classes of equal texts and then
    joined with the members, so copies of one text never meet each other."""
    keyed = store(alike_classes(df, row_id, text, spelling), "forms")
    classes = keyed.select("form", "text").distinct()
    torn = classes.groupBy("form").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("form")
    classes = classes.join(torn, "form", "left_semi")
    met = classes.join(classes.withColumnRenamed("text", "other"), "form").where("text < other").drop("form")
    left, right = keyed.select("text", F.col("id").alias("x")), keyed.select(F.col("text").alias("other"), F.col("id").alias("y"))
    pairs = met.join(left, "text").join(right, "other")
    return pairs.select(F.least("x", "y").alias("doc_lo"), F.greatest("x", "y").alias("doc_hi"))
