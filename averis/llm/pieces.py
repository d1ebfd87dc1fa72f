"""Problem 5: oversized texts cut at natural boundaries.

Dynamic programming over boundary positions: a cut after position b costs the penalty of its kind (paragraph, line,
sentence, clause, blank, none), a piece costs one and a quadratic share for the distance of its size from the even size
of the fewest pieces that fit. Piece k covers [cut(k-1) - overlap, cut(k)), so every piece repeats exactly ``overlap``
characters of the one before, and no piece is longer than ``limit``; every piece but the last adds at least ``overlap``
characters (a quarter of ``limit - overlap``, if that is less). Every natural boundary is a candidate; where a stretch as
long as a quarter piece has none, every 32nd position that does not part a base letter from its marks is added (any
position, where marks alone run that long), so a text without boundaries is cut too. One pass finds the cheapest cuts
over all numbers of pieces; since a piece has a least size, the ends within that size do not depend on each other and
are decided together, so the work is the number of boundaries times those of one piece, however long the text.

Defined results: null and empty texts give no piece; a text of at most ``limit`` characters is one piece; a final
piece always reaches the end of the text; characters are code points; repeated rows are cut each.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Penalties of cuts by kind, best first: after a paragraph, a line, a sentence, a clause, a blank; anywhere else.
PENALTIES = (0.0, 0.2, 0.5, 2.0, 4.0, 40.0)
_KINDS = (
    (0, re.compile(r"\n\s*\n")),
    (1, re.compile(r"\n")),
    (2, re.compile("[.!?…][\"'”“»«)\\]]*\\s+|[。！？।॥][」』”’）]*")),
    (3, re.compile(r"[,;:–—]\s+|[，、；：]")),
    (4, re.compile(r"\s+")),
)
STRIDE = 32


def boundaries(text: str, limit: int, overlap: int) -> tuple[list[int], list[float]]:
    kind: dict[int, float] = {}
    for k, pattern in reversed(_KINDS):
        for m in pattern.finditer(text):
            kind[m.end()] = PENALTIES[k]
    kind.pop(0, None)
    kind.pop(len(text), None)
    natural = sorted(kind)
    gap = max(1, (limit - overlap) // 4)
    stride = max(1, min(STRIDE, gap // 2))
    for a, b in zip([0, *natural], [*natural, len(text)]):
        if b - a > gap:
            for p in range(a + stride, b, stride):
                q = p
                while q < b and q - p < gap and unicodedata.category(text[q])[0] == "M":
                    q += 1
                p = q if q - p < gap else p
                if p < b:
                    kind.setdefault(p, PENALTIES[5])
    at = sorted(kind)
    return at, [kind[p] for p in at]


def cut_points(text: str, limit: int, overlap: int) -> list[int]:
    """Ends of the pieces, the last being the length of the text."""
    n = len(text)
    if n <= limit:
        return [n] if n else []
    return cheapest_cuts(*boundaries(text, limit, overlap), n, limit, overlap)[1]


def cheapest_cuts(pos: list[int], pen: list[float], n: int, limit: int, overlap: int) -> tuple[float, list[int]]:
    """Cost and ends of the cheapest pieces that end at ``pos`` (penalties ``pen``) or at ``n``."""
    step = limit - overlap
    least = max(1, min(overlap, step // 4))
    scale = -(-(n - overlap) // step) / (n - overlap)
    from_ = bisect_left(pos, overlap + least)
    at = np.array([overlap, *pos[from_:], n])  # the first piece adds what it has beyond the overlap
    price = np.array([0.0, *pen[from_:], 0.0])
    cost, back = np.full(len(at), np.inf), np.zeros(len(at), dtype=np.int64)
    cost[0] = 0.0
    first, past = np.searchsorted(at, at - step), np.searchsorted(at, at - least, side="right")
    past[-1] = len(at) - 1
    i = 1
    while i < len(at):
        j = max(i + 1, int(np.searchsorted(at, at[i] + least, side="left")))
        j = min(j, len(at) - 1) if i < len(at) - 1 else len(at)
        a, b = first[i], past[j - 1]
        if a < b:
            size = at[None, i:j] - at[a:b, None]
            total = size * scale - 1.0
            total *= total
            total *= 4.0
            total += cost[a:b, None] + 1.0
            total[(size < (least if j < len(at) else 1)) | (size > step)] = np.inf
            got = total.argmin(0)
            cost[i:j] = total[got, np.arange(j - i)] + price[i:j]
            back[i:j] = got + a
        i = j
    out, i = [], len(at) - 1
    while i:
        out.append(int(at[i]))
        i = int(back[i])
    return float(cost[-1]), out[::-1]


def pieces(df: DataFrame, keys: list[str], text: str, limit: int = 3000, overlap: int = 200) -> DataFrame:
    """(keys, piece INT from 1, n_pieces INT, start INT, piece_text): short texts stay in the JVM, long ones are cut."""
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be less than half the limit")
    rows = df.select(*keys, F.col(text).alias("_text")).where(F.length("_text") > 0)
    short = rows.where(F.length("_text") <= limit).select(*keys, F.lit(1).alias("piece"), F.lit(1).alias("n_pieces"), F.lit(0).alias("start"), F.col("_text").alias("piece_text"))
    long = rows.where(F.length("_text") > limit)

    @F.pandas_udf("array<struct<piece:int,n_pieces:int,start:int,piece_text:string>>")
    def cut(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            res = []
            for t in s:
                ends = cut_points(t, limit, overlap)
                starts = [0] + [e - overlap for e in ends[:-1]]
                res.append([(i + 1, len(ends), a, t[a:e]) for i, (a, e) in enumerate(zip(starts, ends))])
            yield pd.Series(res, dtype=object)

    made = long.select(*keys, F.explode(cut("_text")).alias("p")).select(*keys, "p.*")
    return short.unionByName(made)
