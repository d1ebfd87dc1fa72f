"""Problem 4: sentence boundaries across languages and scripts.

Candidate boundaries are runs of terminators with the closing quotes and brackets behind them and, in scripts that part
sentences by blanks, the blanks next to their letters. Two things are settled by definition: a line break ends a
sentence, and what stands inside quotes or brackets does not end the sentence around them. Every other candidate is
classified by maximum entropy: a period by its neighbours (tokens, case, length, digits, known abbreviations), any
other mark by its kind, the script and case behind it, and the quote it closes, a blank by the letters on its sides.
The training cases are reliable boundaries of the corpus: marks at line ends as positives, marks before lower-case words
or commas and periods inside known abbreviations as negatives; one case of each kind of mark is given beforehand, so
that a corpus without it still has a model of it. Training reads about ``sample`` texts (one class of key hashes);
their cases are counted where they are and the driver receives the counts. Classification covers every text; decisions
are kept in a memo whose key fixes all features, so no decision depends on the order of rows.

Whether a period stands in text whose words are replaced by tags is decided around it: four tags within ``NEAR``
characters on either side.

Defined results: null and empty or blank texts give no sentence; a text without any mark is one sentence per line;
texts of any length are processed whole; repeated rows are split each; ends count code points.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TERM = re.compile("[.!?…。！？｡．।॥؟۔;]+(?:[”“\"’)\\]」』）】》〉]|[   ]?»)*")
LINE = re.compile("[^\n\r\x0b\x0c\x85  ]+")
_BLANK_LETTER = re.compile("[฀-໿က-႟ក-៿]")
_BLANK = re.compile("(?<=[฀-໿က-႟ក-៿])\\s+(?=\\S)|(?<=\\S)\\s+(?=[฀-໿က-႟ក-៿])")
_QUOTES = re.compile("[\"„“”«»()\\[\\]「」『』（）‚‘]")
_OPEN = {"„": "“”", "«": "»", "(": ")", "[": "]", "「": "」", "『": "』", "（": "）"}
_CLOSE = "“”»)]」』）"
_TAGGED = re.compile(r"[ANV](?<!\S.)(?=[\s.,!?;:]|$)")
#: Characters on either side of a period within which four tags make it a period of tagged text.
NEAR = 200
_QUOTATIVE = re.compile("[とっ]|[他她我你它]?们?\\w{0,2}[说問问道]")

# Abbreviations that never end a sentence, and month names, of the languages met.
NEVER_FINAL = frozenset(
    "abb abs abt allg aufl bd bsp bspw bzgl bzw ca co dipl dr ebd eigtl einschl evtl exkl fa fr frl geb gem gez ggf ggfs hbf hr hrn hrsg inkl insb inkl kap lt max med mind min mio mrd mwst "
    "nr nrn orig prof sog spez st std stk str tab tel telef tsd tägl urspr usf vgl vllt verm vors wg zb zt ztl zzgl "
    "approx capt cf col dept eq fig figs gov jr lt mr mrs ms mt no nos rev sgt sr vol vs "
    "av bd boul chap env éd mme mlle mgr p pag réf st ste "
    "aprox avda cap núm pág págs sr sra srta dra ud uds vda "
    "г гл др им кв млн млрд напр обл рис руб ср стр тел тыс ул "
    "κ κα σελ τηλ αρ βλ "
    "डॉ श्री प्रो सु".split()
)
MONTHS = frozenset(
    "januar jänner februar märz april mai juni juli august september oktober november dezember january february march may june july october december "
    "janvier février mars avril juin juillet août septembre octobre novembre décembre enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split()
)


_CLOSED_BY = {"“": '„', "”": '„“', "»": "«", ")": "(", "]": "[", "」": "「", "』": "『", "）": "（"}


def spans(line: str) -> list[tuple[int, int]]:
    """Outermost [open, close] positions of quoted or bracketed text in a line, in one pass; what is never closed is no
    span, and spans closed inside it count by themselves."""
    out: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []
    depth: Counter = Counter()
    for m in _QUOTES.finditer(line):
        c, i = m.group(), m.start()
        top = stack[-1][0] if stack else ""
        if top == c == '"' or (top and top in _CLOSED_BY.get(c, "")):
            a = stack.pop()[1]
            depth[top] -= 1
        elif c in _OPEN or c in '"“':
            stack.append((c, i))
            depth[c] += 1
            continue
        elif any(depth[t] for t in _CLOSED_BY.get(c, "")):
            while True:
                t, a = stack.pop()
                depth[t] -= 1
                if t in _CLOSED_BY[c]:
                    break
        else:
            continue
        while out and out[-1][0] > a:
            out.pop()
        out.append((a, i))
    return out


def shape(tok: str) -> str:
    c = tok[:1]
    if not c:
        return "none"
    if c.isdigit():
        return "digit"
    if c.isalpha():
        return "upper" if c.isupper() else "lower" if c.islower() else "caseless"
    return "open" if c in "„“\"«([¡¿「『（–—-*•" else "punct"


def features(prev: str, before: str, nxt: str, tagged: bool) -> tuple[str, ...]:
    """Maximum-entropy features of a period between ``prev`` and ``nxt``; ``before`` is the token in front of ``prev``."""
    low = prev.lower().strip("\"„“”«»()[]'’")
    ns = shape(nxt)
    word = nxt.lower().strip(".,;:!?\"”“)")
    digits = bool(low) and low.replace(",", "").replace(".", "").isdigit()
    single = len(low) == 1 and low.isalpha()
    kind = "digit" if digits else "single" if single else "short" if len(low) <= 3 else "word"
    if not digits and shape(prev) == "upper":
        kind += "^"
    known = low.split(".")[-1].split("-")[-1] in NEVER_FINAL or low.endswith("str")
    f = ["bias", "next=" + ns, "kind=" + kind, f"{kind}|{ns}", "inner" if "." in low.strip(".") else "plain"]
    if tagged:
        f = ["tagged " + x for x in f]
        f += ["tagged|comma" if before.endswith(",") else "tagged|", "tagged|chain" if re.fullmatch(r"[ANV]\.", before) else "tagged|-"]
    else:
        f += ["known" if known else "new", f"known={known}|{ns}"]
        if single:
            f.append("suffix|" + ns if low == prev and before[-1:].isdigit() else "initial")
        if digits:
            f += ["month" if word in MONTHS else "nomonth", "ordinal" if before.lower() in ("am", "vom", "zum", "im", "der", "dem", "den", "beim", "ab", "bis") and len(low) <= 2 else "cardinal"]
        else:
            f.append("prev=" + low)
        if len(word) == 1 and nxt[1:2] == ".":
            f.append("chain")
    return tuple(f)


_GOES_ON = ",;:、，；：)]）»”"


def follower(c: str, line: str, k: int, gap: bool, closed: bool) -> str:
    """What stands behind a mark, as far as it matters to its features."""
    if c in _GOES_ON:
        return "comma"
    if closed and not gap and c == "と":
        return "quotative"
    s = shape(c)
    return "quotative" if closed and s == "caseless" and _QUOTATIVE.match(line, k) else s


def mark_kind(plain: str) -> str:
    if any(x in plain for x in "!?！？؟;"):
        return "ask"
    if plain in (".", "．"):
        return "period"
    return "dots" if "." in plain or "…" in plain else "stop"


def mark_features(kind: str, behind: str, closed: str) -> tuple[str, ...]:
    """Features of a mark other than a plain period; ``closed`` is "", "led" (it closes a quote that a colon or comma led
    in) or "bare" (any other quote or bracket)."""
    return ("mark", f"{kind}|{behind}", f"{closed}>{behind}", f"{kind}|{closed}|{behind}")


def blank_features(left: str, right: str) -> tuple[str, ...]:
    sides = ["script" if _BLANK_LETTER.match(c) else shape(c) for c in (left, right)]
    return ("blank", "left " + sides[0], "right " + sides[1], "|".join(sides))


#: One case of each kind of mark, given beforehand: ends before capitals, openers and caseless letters, none before the rest.
_GIVEN = {
    (mark_features(k, b, c), y): 1
    for k in ("ask", "stop", "dots", "period", "joined")
    for c in ("", "led", "bare")
    for b, y in (("upper", 1), ("open", 1), ("lower", 0), ("comma", 0), ("digit", int(k not in ("dots", "joined"))), ("caseless", int(k != "joined")), ("quotative", int(c == "led")), ("inner", 0))
} | {(blank_features(a, b), int(a == b == "ก")): 1 for a in "ก8aA" for b in "ก8aA" if "ก" in (a, b)}


class Splitter:
    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.memo: dict[tuple, bool] = {}
        self.marks: dict[tuple, bool] = {}
        self.kinds: dict[str, str] = {}
        self.plain: dict[tuple[str, str], bool] = {}

    def decide(self, found: tuple[str, ...]) -> bool:
        w = self.weights
        return sum(w.get(x, 0.0) for x in found) > 0

    def mark_ends(self, key: tuple, seen: Counter | None) -> bool:
        got = self.marks.get(key)
        if got is None:
            got = self.marks[key] = self.decide(mark_features(*key))
        if seen is not None:
            seen[(mark_features(*key), _mark_label(*key))] += 1
        return got

    def blank_ends(self, left: str, right: str, seen: Counter | None) -> bool:
        got = self.marks.get((left, right))
        if got is None:
            got = self.marks[(left, right)] = self.decide(blank_features(left, right))
        if seen is not None:
            found = blank_features(left, right)
            seen[(found, int(found[-1] == "script|script"))] += 1
        return got

    def period_ends(self, prev: str, before: str, nxt: str, tagged: bool) -> bool:
        if len(prev) > 1 and prev.isalpha():  # then features see of ``before`` the tag alone, of ``nxt`` its shape and a chained initial
            key = (prev, before if tagged else "", nxt if nxt[1:2] == "." else nxt[:1], tagged)
        else:
            key = (prev, before, nxt, tagged)
        got = self.memo.get(key)
        if got is None:
            if len(self.memo) > 500_000:
                self.memo.clear()
            got = self.memo[key] = self.decide(features(prev, before, nxt, tagged))
        return got

    def ends(self, text: str, seen: Counter | None = None) -> list[int]:
        """Ends of the sentences of ``text``; ``seen`` counts (features, label or None) of the candidates met."""
        out: list[int] = []
        kinds, plain = self.kinds, self.plain
        tags = [m.start() for m in _TAGGED.finditer(text)]
        if len(tags) < 4:
            tags = []
        thai = _BLANK_LETTER.search(text) is not None
        for lm in LINE.finditer(text):
            line = lm.group()
            size = len(line.rstrip())
            if not line.strip():
                continue
            base = lm.start()
            found = [m.start() for m in _BLANK.finditer(line) if self.blank_ends(line[m.start() - 1], line[m.end()], seen)] if thai and _BLANK_LETTER.search(line) else []
            held = spans(line) if _QUOTES.search(line) else ()
            at = 0
            for m in TERM.finditer(line, 0, size):
                e = m.end()
                if e >= size:
                    break
                s = m.start()
                if line[s] == ";" and not "Ͱ" <= line[s - 1 : s] <= "Ͽ":  # a question mark in Greek alone
                    continue
                c = line[e]
                gap = c.isspace()
                k = e
                while line[k].isspace():
                    k += 1
                c = line[k]
                while at < len(held) and held[at][1] <= s:
                    at += 1
                closed = ""
                if at < len(held) and held[at][0] < s:
                    a, b = held[at]
                    if e <= b:
                        continue
                    closed = "led" if line[:a].rstrip()[-1:] in (":", "：", ",", "，", "、") else "bare"
                mark = m.group()
                kind = kinds.get(mark)
                if kind is None:
                    kind = kinds[mark] = mark_kind(mark.rstrip("”“\"’)]」』）】》〉»   "))
                if kind != "period" or closed:
                    if closed or seen is not None:
                        ends = self.mark_ends((kind, follower(c, line, k, gap, bool(closed)), closed), seen)
                    else:
                        ends = plain.get((kind, c))
                        if ends is None:
                            ends = plain[(kind, c)] = self.mark_ends((kind, follower(c, line, k, gap, False), ""), None)
                    if ends:
                        found.append(e)
                    continue
                p = line.rfind(" ", 0, s) + 1
                prev = line[p:s]
                near = bool(tags) and bisect_left(tags, base + s + NEAR) - bisect_left(tags, base + s - NEAR) >= 4
                if c in _GOES_ON:
                    if not self.mark_ends(("period", "comma", ""), seen):
                        continue
                elif not gap:
                    behind = shape(c)
                    if behind in ("upper", "open"):
                        stop = line.find(" ", k)
                        rest = line[p : stop if stop > 0 else size]
                        last = prev[prev.rfind(".") + 1 :]
                        if "@" in rest or rest.startswith("www.") or (not (near and len(last) == 1) and (len(last) < 2 or (last.isupper() and not near) or (prev[-1:].isdigit() and "." in prev))):
                            behind = "inner"
                    if not self.mark_ends(("joined", behind, ""), seen):
                        continue
                q = line.rfind(" ", 0, max(0, p - 1)) + 1
                before = line[q : max(0, p - 1)]
                stop = line.find(" ", k)
                nxt = line[k : stop if stop > 0 else size]
                if seen is not None:
                    seen[(features(prev, before, nxt, near), _label(prev, before, nxt, near))] += 1
                if self.period_ends(prev, before, nxt, near):
                    found.append(e)
            if seen is not None and line[size - 1] == "." and size > 1:
                after = LINE.search(text, lm.end())
                p = line.rfind(" ", 0, size - 1) + 1
                q = line.rfind(" ", 0, max(0, p - 1)) + 1
                if after:
                    near = bool(tags) and bisect_left(tags, base + size + NEAR) - bisect_left(tags, base + size - NEAR) >= 4
                    seen[(features(line[p : size - 1], line[q : max(0, p - 1)], after.group().lstrip().split(" ")[0], near), 1)] += 1
            found.sort()
            out += [base + x for x in found]
            out.append(base + size)
        return out


def _mark_label(kind: str, behind: str, closed: str) -> int | None:
    """Label of a reliable case of a mark, None of any other."""
    if behind in ("lower", "comma", "punct", "inner") or (behind == "quotative" and closed != "led"):
        return 0
    if kind in ("dots", "joined") and behind == "digit":
        return 0
    if kind == "joined" and behind == "caseless":
        return 0
    return 1 if behind in ("upper", "open", "caseless", "quotative") else None


def _label(prev: str, before: str, nxt: str, tagged: bool) -> int | None:
    """Label of a reliable period, None of any other."""
    low = prev.lower().strip("\"„“”«»()[]'’")
    ns = shape(nxt)
    if ns in ("lower", "punct"):
        return 0
    if tagged:
        if ns == "digit" or re.fullmatch(r"[ANV]\.", before) or before.endswith(","):
            return 0
        return 1 if ns == "upper" and len(low) == 1 else None
    if len(low) == 1 and low == prev and before[-1:].isdigit() and ns == "upper":
        return 1
    if low.split(".")[-1].split("-")[-1] in NEVER_FINAL or low.endswith("str") or (len(low) == 1 and low.isalpha()):
        return 0
    if low.isdigit() and nxt.lower().strip(".,;:!?") in MONTHS:
        return 0
    return 1 if len(low) >= 4 and low.isalpha() and ns in ("upper", "open") else None


def observed(texts: list[str]) -> Counter:
    """(features, label) of the reliable cases of ``texts``, counted."""
    seen: Counter = Counter()
    blank = Splitter({})
    for t in texts:
        blank.ends(t, seen)
    return Counter({k: n for k, n in seen.items() if k[1] is not None})


def weigh(counted: Counter, l2: float = 1.0, steps: int = 300) -> dict[str, float]:
    """Weights of the maximum-entropy classifier (full-batch AdaGrad), the given cases among those counted."""
    counted = counted + Counter(_GIVEN)
    if not any(fs[0] not in ("mark", "blank") for fs, _ in counted):
        counted[(("bias",), 1)] = 4  # no period anywhere: each ends its sentence
    cases = sorted(counted.items())
    names = {f: i for i, f in enumerate(sorted({f for (fs, _), _ in cases for f in fs}))}
    width = max(len(fs) for (fs, _), _ in cases)
    idx = np.full((len(cases), width), len(names))
    y, n = np.zeros(len(cases)), np.zeros(len(cases))
    for r, ((fs, lab), c) in enumerate(cases):
        idx[r, : len(fs)] = [names[f] for f in fs]
        y[r], n[r] = lab, c
    w, g2 = np.zeros(len(names) + 1), np.full(len(names) + 1, 1e-8)
    firm = {f for (fs, _), _ in cases if fs[0] in ("mark", "blank") for f in fs}  # few and seldom in doubt
    decay = np.array([0.05 if f in firm else 1.0 for f in names] + [0.0]) * l2
    for _ in range(steps):
        p = 1 / (1 + np.exp(-w[idx].sum(1)))
        g = np.bincount(idx.ravel(), np.repeat((p - y) * n, width), len(w)) + decay * w
        g[-1] = 0.0
        g2 += g * g
        w -= 0.5 * g / np.sqrt(g2)
        w[-1] = 0.0
    return {f: float(w[i]) for f, i in names.items()}


def train(texts: list[str], l2: float = 1.0, steps: int = 300) -> dict[str, float]:
    return weigh(observed(texts), l2, steps)


def fit(df: DataFrame, key: str, text: str, sample: int = 3000) -> dict[str, float]:
    """Weights trained on about ``sample`` texts: those whose key falls into one of ``rows / sample`` hash classes, so the
    sample is of one size for a table of any size. Its cases are counted on the executors."""
    classes = max(1, df.count() // sample)
    rows = df.where(F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(classes)) == 0).where(F.length(text) > 0).select(F.col(text).alias("t"))

    @F.pandas_udf("array<struct<f:array<string>,y:int,n:bigint>>")
    def cases(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            counted = [(list(f), y, n) for (f, y), n in observed(list(s)).items()]
            yield pd.Series([counted if i == 0 else [] for i in range(len(s))], dtype=object)

    got = rows.select(F.inline(cases("t"))).groupBy("f", "y").agg(F.sum("n").alias("n")).collect()
    return weigh(Counter({(tuple(r["f"]), r["y"]): r["n"] for r in got}))


def sentence_ends(df: DataFrame, keys: list[str], text: str, weights: dict[str, float]) -> DataFrame:
    """(keys, sent_end INT): one row per sentence."""

    @F.pandas_udf("array<int>")
    def ends(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        split = Splitter(weights).ends
        for s in batches:
            yield pd.Series([split(t) for t in s], dtype=object)

    rows = df.where(F.length(text) > 0).select(*keys, ends(F.col(text)).alias("_e"))
    return rows.select(*keys, F.explode("_e").alias("sent_end"))


def sentences(df: DataFrame, keys: list[str], text: str, weights: dict[str, float]) -> DataFrame:
    """(keys, sentences ARRAY<STRING>): every non-empty text as the list of its sentences, blanks around them dropped."""

    @F.pandas_udf("array<string>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        split = Splitter(weights).ends
        for s in batches:
            res = []
            for t in s:
                at, got = 0, []
                for e in split(t):
                    got.append(t[at:e].strip())
                    at = e
                res.append(got)
            yield pd.Series(res, dtype=object)

    return df.where(F.length(text) > 0).select(*keys, cut(F.col(text)).alias("sentences"))
