"""Problem 7: reading level by smoothed unigram language models, one per language and level.

P(word | level) is smoothed towards the language's collection model (Dirichlet prior of mass ``mu``); a text gets the
level with the highest posterior: log prior + sum of log P(word | level) over its words. Words no graded sample has
say nothing and are skipped. The models are counted from the graded samples, whose table is of the same few hundred
rows at every scale (its size is checked before it is collected); every text is scored whole.

Defined results: null and empty texts, texts in a language without samples and texts without any word get no level
(no row, or with ``keep`` a null level unless the text is empty); ties go to the easier level; posteriors sum to 1; repeated rows are scored each.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W\d_]+")
#: Bytes of graded samples that may be collected.
LABEL_BYTES = 64 << 20


class Levels:
    """Per language: word -> row of log-likelihoods, and log priors."""

    def __init__(self, samples: list[tuple[str, int, str]], mu: float = 200.0):
        self.levels = sorted({lv for _, lv, _ in samples})
        place = {lv: i for i, lv in enumerate(self.levels)}
        counts: dict[str, dict[str, np.ndarray]] = defaultdict(lambda: defaultdict(lambda: np.zeros(len(self.levels))))
        rows: dict[str, Counter] = defaultdict(Counter)
        for lang, lv, text in samples:
            rows[lang][lv] += 1
            for w in WORD.findall(text.lower()):
                counts[lang][w][place[lv]] += 1
        self.models = {}
        for lang, words in counts.items():
            names = list(words)
            c = np.array([words[w] for w in names])
            background = c.sum(1, keepdims=True) / c.sum()
            ll = np.log((c + mu * background) / (c.sum(0, keepdims=True) + mu))
            n = sum(rows[lang].values())
            prior = np.log([max(rows[lang][lv], 0.5) / n for lv in self.levels])
            self.models[lang] = ({w: i for i, w in enumerate(names)}, np.vstack([ll, np.zeros((1, ll.shape[1]))]), prior)

    def posterior(self, lang: str, text: str) -> np.ndarray | None:
        model = self.models.get(lang)
        if model is None:
            return None
        at, ll, prior = model
        none, get = len(ll) - 1, at.get
        idx = [get(w, none) for w in WORD.findall(text.lower())]
        if not idx:
            return None
        x = prior + ll[idx].sum(0)
        x = np.exp(x - x.max())
        return x / x.sum()


def read_samples(labels: DataFrame, lang: str = "lang", level: str = "level", text: str = "text") -> list[tuple[str, int, str]]:
    rows = labels.select(F.lower(F.trim(lang)).alias("lang"), F.col(level).alias("level"), F.col(text).alias("text")).dropna()
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    if 4 * size > LABEL_BYTES:
        raise ValueError(f"graded samples hold {size} characters; fit on a bounded sample of them")
    return sorted((r["lang"], r["level"], r["text"]) for r in rows.collect())


def with_level(df: DataFrame, keys: list[str], lang: str, text: str, samples: list[tuple[str, int, str]], mu: float = 200.0, keep: bool = False) -> DataFrame:
    """(keys, level INT, p DOUBLE) of every text in a language that has samples; with ``keep`` of every non-empty text,
    level and p being null where no model can say anything."""
    langs = sorted({x for x, _, _ in samples})

    @F.pandas_udf("struct<level:int,p:double>")
    def grade(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        m = Levels(samples, mu)
        for ls, ts in batches:
            best = []
            for x, t in zip(ls, ts):
                p = m.posterior(x, t)
                best.append((None, None) if p is None else (m.levels[int(p.argmax())], float(p.max())))
            yield pd.DataFrame(best, columns=["level", "p"]).astype({"level": "Int32", "p": "float64"})

    base = F.regexp_replace(F.lower(F.trim(F.col(lang))), "[-_].*", "")
    rows = df.select(*keys, base.alias("_l"), F.col(text).alias("_t")).where(F.length("_t") > 0)
    if not keep:
        rows = rows.where(F.col("_l").isin(langs))
    graded = rows.select(*keys, grade("_l", "_t").alias("g")).select(*keys, "g.level", "g.p")
    return graded if keep else graded.where("level IS NOT NULL")


