"""Problem 6: personal information in free text, by weak supervision.

Candidates are spans that a broad pattern of their kind (email, phone, idnum, address, name) proposes. Labelers look at
each candidate and vote yes, no or nothing: strict patterns (digit counts, number formats), gazetteers (first names,
top-level words, street words, function words), and context (words that introduce such data in general). The votes of
all candidates of all rows are counted by voting pattern; expectation-maximisation over these counts estimates each
labeler's reliability without any gold label. Its posteriors are the labels of a logistic span classifier, which decides.
The classifier sees the votes, the span's shape and, for names, its first word, and the tokens in front of and behind it.
A possible name that no labeler knows is judged by its place alone: a model of the places where known names stand is
learned from the corpus, so no wording of such places is given and a name that no gazetteer holds is found there.

Voting patterns are a bounded table (a few hundred); the classifier is fitted on about ``sample`` candidates (one class
of hashes of all of them), counted before they are collected. The spans themselves never leave the executors.

Where spans overlap the kinds go in the order email, idnum, phone, address, name. Replacement puts ``[EMAIL]`` and so
on in place of each accepted span and leaves every other character as it is.

Defined results: null text stays null and has no spans; empty text stays empty; texts of any length are read whole;
repeated spans of a text are all replaced and reported once by ``found``; repeated rows are handled each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from averis.session import store

KINDS = ("email", "idnum", "phone", "address", "name")

# Spoken digits and joints of spelled-out addresses in the languages served.
_DIGIT = "null|eins|zwei|zwo|drei|vier|fünf|sechs|sieben|acht|neun|zero|oh|one|two|three|four|five|six|seven|eight|nine|zéro|un|deux|trois|quatre|cinq|sept|huit|neuf|cero|uno|dos|tres|cuatro|cinco|seis|siete|ocho|nueve"
_DOT = r"(?:punkt|dot|point|punto|\(punkt\)|\[punkt\]|\(dot\)|\[dot\]|\(point\)|\[point\]|\(punto\)|\[punto\])"
_JOINT = r"(?:punkt|dot|point|punto|unterstrich|underscore|minus|bindestrich|dash|plus)"
_AT = r"(?:ät|at|arobase|arroba|\(at\)|\[at\]|\(ät\)|\[ät\]|@)"

# Common first names.
FIRST_NAMES = frozenset(
    "achim adam aisha alexander ali alice amir andrea andreas anja anke anna anne anton armin axel barbara ben bernd bettina birgit björn boris brigitte bruno carla carlos carmen carsten charlotte christian christina clara "
    "claudia clemens daniel david dennis detlef diana dieter dirk dominik doris elena elif elke emil emily emma eric erik eva fabian fatima felix finn florian frank franz frauke frieda friedrich gabriele georg gerd gisela "
    "götz günter hanna hannah hans heike heinz helena helga helmut henrik holger ina ines ingo ingrid irene isabel jakob jan jana jens jessica joachim johanna johannes john jonas jörg josef julia julian jürgen käthe karin "
    "karl karsten katharina katja kevin kim klaus knut konrad lars laura lea lena leon leonie lina linda lisa lucas luis lukas lutz maja manfred manuela marc marco maren maria marie mario markus martin martina mathias matthias "
    "max maximilian mehmet melanie mia michael mirko monika nadine nicole niklas nina noah norbert olaf oliver oskar otto patrick paul paula peter petra philipp rainer ralf rené robert roland rolf sabine sandra sarah sebastian silke "
    "simon simone sofia sophie stefan stefanie susanne sven svenja tariq thomas tim timo tobias tom torsten ulrich ursula uwe vera volker walter werner wiebke wilhelm wolfgang yusuf yvonne zoé".split()
)
#: Words that open sentences or phrases and are no first names.
_FUNCTION = frozenset(
    "das der die den dem des ein eine einen einem einer wir ihr ich er sie es du man am im in an auf aus bei mit nach von vor zu zum zur und oder aber wenn weil dass als auch so nur noch schon hier da dort dann jetzt heute morgen gestern wer was wo wie warum welche "
    "ist sind war hat haben kann könnt mein meine unser unsere dein kein keine alle alles viele manche jeder jede nehmt schaut passt kommt ruft laut bis dr prof herr herrn frau fräulein herrin familie "
    "the a an we you he she it they this that these those my our your his her no not all some many when where who what why how shall look now here there then with without after before although whereas and or but if is are was were can at on in of to from by for see watch more mr mrs ms miss sir dear "
    "je tu il elle nous vous ils le la les un une des du au aux ce cette mon ma mes et ou mais si où qui que quoi pourquoi m mme el los las una yo tú usted hoy ¿ ¡ señor señora don doña monsieur madame".split()
)
_OPENERS = "|".join(sorted({w.capitalize() for w in _FUNCTION if w.isalpha()}))
_STREET = r"(?:straße|strasse|str\.|str|weg|platz|gasse|allee|ring|ufer|damm|steig|stieg|pfad|chaussee|teich|hof|berg|markt|graben|wall|park|tor|kamp|winkel)"
_ROAD = r"(?:Road|Rd\.?|Lane|Ln\.?|Street|Avenue|Ave\.?|Drive|Close|Court|Way|Place|Square|Terrace|Crescent|Row|Hill)"
_TOWN1 = r"(?:(?:Ober|Unter|Nieder|Bad|Neu|Alt|Groß|Klein|Sankt|St\.|Markt|Burg|Hohen|Mittel|Nord|Süd|Ost|West|Upper|Lower|Great|Little|New|Old|Saint|North|South|East|West|Port|Fort|Mount) )?[A-ZÄÖÜ][a-zäöüßéèáà]+(?:-[A-ZÄÖÜ][a-zäöüß]+)*(?: (?:am|an der|ob der|im|in der|bei|upon|on|under) [A-ZÄÖÜ][a-zäöüß]+)?"
_CAP = r"(?:[A-ZÄÖÜÉÈÁ][a-zäöüßéèêáàçñóíú]+|[А-ЯЁ][а-яё]+|[Α-ΫΆΈΉΊΌΎΏ][ά-ώ]+)"
_NUMBER = r"\d{1,4}(?: ?[a-h](?![\w]))?(?:[-/]\d{1,4}(?: ?[a-h](?!\w))?)?"

PATTERNS = {
    "email": re.compile(
        rf"[\w.+%-]*\w@\w[\w-]*(?:\.[\w-]*\w)+|(?<![\w.])\w[\w.+-]*(?: {_JOINT} [\w+-]+)* {_AT} \w[\w-]*(?:(?: {_DOT} |\.)\w[\w-]*)+(?:(?: {_DOT} )\w[\w-]*)?",
        re.I,
    ),
    "idnum": re.compile(r"(?<![\w.,+/-])(?:\d{2} ?\d{6} ?[A-Z] ?\d{3}|\d{2} \d{3} \d{3} \d{3}|\d{11}|\d{3}-\d{2}-\d{4}|[A-Z](?=[A-Z0-9]*\d[A-Z0-9]*\d[A-Z0-9]*\d)[A-Z0-9]{8,9}|\d{8}[A-Z]|[XYZ]\d{7}[A-Z]|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D])(?![\w/-]|[.,]\d)"),
    "phone": re.compile(r"(?<![\w.,/+-])(?:\+\d{1,3}|\(\d{2,5}\)|00\d{2}|0\d{1,5})(?:[ /.()-]{0,2}\d+)+(?![\w-]|[.,]\d)"),
    "address": re.compile(
        rf"(?<!\w)(?:(?:(?:Am|An der|Auf der|Auf dem|Im|In der|In den|Zum|Zur|Unter den|Hinter der|Vor dem) )?[A-ZÄÖÜ][\wäöüß]*(?:-[A-ZÄÖÜ][\wäöüß]*)*(?:[ -]?(?i:{_STREET}))(?<!\.\.) {_NUMBER}|{_NUMBER} (?:[A-ZÄÖÜ][\wäöüß'-]* ){{1,3}}{_ROAD}(?!\w))"
        rf"(?:(?:,? (?:in )?)\d{{4,5}} {_TOWN1}|, {_TOWN1}(?=[,.;!?)]|$))?",
    ),
    "name": re.compile(rf"(?<![\w.@-])(?!(?:{_OPENERS}) )(?:{_CAP}(?:-{_CAP})*|[A-ZÄÖÜ]\.(?:-?[A-ZÄÖÜ]\.)?) (?:(?:von|van|de|zu|von der|van der) )?{_CAP}(?:-{_CAP})*(?![\w@])"),
}
#: Names in scripts without capitals, as far as a title behind tells them.
TITLED = re.compile("[一-鿿]{2,4}(?=さん|様|先生(?![はがをもとの]))|[ァ-ヴー]{2,}(?=さん|様)")
SPOKEN = re.compile(rf"(?<!\w)(?:{_DIGIT})(?: (?:{_DIGIT})){{6,}}(?!\w)", re.I)
_SPOKEN_HINTS = tuple(f" {d} " for d in _DIGIT.split("|"))
_STREET_ENDS = tuple(_STREET[3:-1].replace("\\", "").split("|"))
_ROAD_WORDS = tuple(" " + x.replace("\\", "").rstrip("?").rstrip(".") for x in _ROAD[3:-1].split("|"))
_SPACE_DIGIT = re.compile(r" \d")
_EMAIL_HINT = re.compile(rf" {_AT} \w", re.I)
_BEFORE = {
    "email": re.compile(r"(?:mail|kontakt|contact|adresse|address|schreib|write|écri|escrib|fragen|questions|邮箱|メール|meldet)", re.I),
    "idnum": re.compile(r"(?:ausweis|pass|steuer|versicherung|nummer|number|social|security|insurance|tax|card|formular|identi|kenn|dni|nie|numéro|número)", re.I),
    "phone": re.compile(r"\b(?:tel|handy|mobil|nummer|number|ruf|anruf|call|phone|appel|llam|fax)|電話|电话", re.I),
    "address": re.compile(r"(?:adresse|address|wohn|nach|paket|parcel|laden|shop|liegt|komm|send|live|visit|here)", re.I),
    "name": re.compile(r"(?:\b(?:ich bin|i am|i'm|name ist|name is|my name|heiße|called|danke an|thanks to|frau|herrn?|mr\.?|mrs\.?|ms\.?|dr\.|prof\.|m'appelle|me llamo|меня зовут|με λένε)) $", re.I),
}
_AFTER_NAME = re.compile(r"\s*(?:,? (?:meinem|meiner|my|fragt|asked|said|sagte|meinte)|[.!?]?$|さん|様|先生)")
_YES, _NO, _NIL = "y", "n", "-"


def _vote(yes: bool, no: bool = False) -> str:
    return _YES if yes else _NO if no else _NIL


def labels(kind: str, text: str, a: int, b: int) -> str:
    """The labelers' votes on text[a:b] (one letter each), then the categorical shape features, as one pattern."""
    span, before, after = text[a:b], text[max(0, a - 40) : a], text[b : b + 25]
    context = _BEFORE[kind].search(before) is not None
    digits = sum(c.isdigit() for c in span)
    if kind == "email":
        v = [_vote("@" in span), _vote(re.search(r"(?:example|test|invalid|com|net|org|de|fr|es|io|eu|info|uk)$", span, re.I) is not None), _vote(context), _vote(len(re.findall(r"[^\W_]+", span)) >= 3, len(span) < 6)]
        sure = re.search(rf" (?!at ){_AT} | {_DOT} ", span, re.I) is not None
        v[0] = _vote("@" in span or sure, not sure)
        shape = "plain" if "@" in span else "spelled" if sure else "vague"
    elif kind == "idnum":
        v = [_vote(re.fullmatch(r"\d{2} ?\d{6} ?[A-Z] ?\d{3}|\d{3}-\d{2}-\d{4}", span) is not None), _vote(digits >= 5, digits < 4), _vote(context), _vote(len(re.sub(r"\W", "", span)) in (9, 10, 11, 12), False)]
        shape = "alnum" if any(c.isalpha() for c in span) else "digits"
    elif kind == "phone":
        n = digits or len(span.split(" "))
        v = [_vote(7 <= n <= 15, n < 7 or n > 15), _vote(span[0] in "+(" or span.startswith("0") or not digits), _vote(context), _vote(False, re.fullmatch(r"0\d\.\d\d(?:\.\d{2,4})?", span) is not None)]
        shape = "spoken" if not digits else "digits"
    elif kind == "address":
        street = re.search(rf"(?i:{_STREET})|{_ROAD}", span) is not None
        v = [_vote(street), _vote(re.search(r"\d{5} [A-ZÄÖÜ]", span) is not None), _vote(context), _vote(re.search(r"^(?:Am|An|Im|In|Auf|Zum|Zur) |[Ss]tr(?:aße|\.)|weg |[Pp]latz |Road|Lane|Street", span) is not None)]
        shape = "road" if re.search(_ROAD, span) else "street"
    else:
        first, last = span.split(" ")[0], span.split(" ")[-1]
        parts = first.lower().strip(".").split("-")
        known = all(p in FIRST_NAMES for p in parts)
        initial = first.endswith(".")
        start = not before or before.rstrip()[-1:] in ".!?\n…:" or before[-1:] == "\n"
        bad = (parts[0] in _FUNCTION and not initial) or last.lower() in _FUNCTION
        v = [_vote(known and not bad, bad), _vote(initial and not bad), _vote(context), _vote(_AFTER_NAME.match(after) is not None or not after), _vote(False, not known and not initial and not context)]
        shape = ("initial" if initial else "titled" if " " not in span else "other") + ("^" if start else "")
    return "".join(v) + "|" + shape


def _address_hint(text: str) -> bool:
    """A number behind a word that ends like a street, or an English street word anywhere: cheap, and never misses a match
    of the address pattern."""
    if any(w in text for w in _ROAD_WORDS):
        return True
    return any(text[max(0, m.start() - 12) : m.start()].lower().endswith(_STREET_ENDS) for m in _SPACE_DIGIT.finditer(text))


def candidates_of(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, pattern) of every candidate span."""
    out = []
    low = text.lower()
    for kind in KINDS:
        if kind == "email" and "@" not in text and not _EMAIL_HINT.search(text):
            continue
        if kind == "address" and not _address_hint(text):
            continue
        for m in PATTERNS[kind].finditer(text):
            a, b = m.span()
            out.append((kind, a, b, labels(kind, text, a, b)))
        if kind == "name" and TITLED.search(text):
            out += [("name", *m.span(), labels("name", text, *m.span())) for m in TITLED.finditer(text)]
        if kind == "phone" and any(h in low for h in _SPOKEN_HINTS):
            out += [("phone", *m.span(), labels("phone", text, *m.span())) for m in SPOKEN.finditer(text)]
    return out


_TOKEN = re.compile(r"[^\W\d_]+|\d+|\S")


def around(kind: str, text: str, a: int, b: int) -> list[str]:
    """Tokens next to a span and, of a name, its first word: lower-cased, numbers as their length."""
    plain = lambda t: f"#{min(len(t), 6)}" if t[:1].isdigit() else t.lower()[:20]
    left = text[max(0, a - 30) : a]
    before = _TOKEN.findall(left[left.rfind("\n") + 1 :])
    after = _TOKEN.match(text[b : b + 30].lstrip(" "))
    got = ["<" + (plain(before[-1]) if before else "^"), ">" + (plain(after.group()) if after else "$")]
    if kind == "name":
        got.append("=" + text[a:b].split(" ")[0].lower())
    return got


def posteriors(counts: dict[tuple[str, str], int], rounds: int = 100) -> dict[tuple[str, str], float]:
    """Posterior that a candidate is personal data, by kind and voting pattern: EM over the labelers."""
    result: dict[tuple[str, str], float] = {}
    for kind in KINDS:
        pats = sorted(p for k, p in counts if k == kind)
        if not pats:
            continue
        n = np.array([counts[(kind, p)] for p in pats], dtype=float)
        votes = [p.split("|")[0] for p in pats]
        m = len(votes[0])
        onehot = {c: np.array([[v[j] == c for j in range(m)] for v in votes], dtype=float) for c in (_YES, _NO, _NIL)}
        score = onehot[_YES].sum(1) - 2 * onehot[_NO].sum(1)
        q = np.where(score >= 2, 0.9, np.where(score <= 0, 0.1, 0.6))
        for _ in range(rounds):
            ll = [np.log((n * r).sum() / n.sum() + 1e-9) * np.ones(len(pats)) for r in (1 - q, q)]
            for c, r in ((0, 1 - q), (1, q)):
                prior = {_YES: (1.0, 3.0)[c], _NO: (3.0, 0.3)[c], _NIL: 2.0}  # a labeler is better than chance
                mass = (n * r)[:, None]
                den = mass.sum() + sum(prior.values())
                for x in (_YES, _NO, _NIL):
                    p = ((mass * onehot[x]).sum(0) + prior[x]) / den
                    if c and x == _NO:
                        p[0] = min(p[0], 0.002)  # the first labeler of a kind knows its format: it says no to true data at most so often
                    ll[c] = ll[c] + onehot[x] @ np.log(p)
            new = 1 / (1 + np.exp(np.clip(ll[0] - ll[1], -50, 50)))
            if np.abs(new - q).max() < 1e-6:
                break
            q = new
        result.update({(kind, p): float(y) for p, y in zip(pats, q)})
    return result


def _evidence(kind: str, pattern: str, near: list[str]) -> list[str]:
    """Features of a candidate: its votes, its shape and the tokens around it."""
    votes, shape = pattern.split("|")
    return [kind, f"{kind} {shape}", *[f"{kind} {x}" for x in near], *[f"{kind} {j}{v}" for j, v in enumerate(votes) if v == _YES or (v == _NO and not (kind == "name" and j == 4))]]


def _unknown(kind: str, pattern: str) -> bool:
    """A possible name that no labeler knows, for or against."""
    votes = pattern.split("|")[0]
    return kind == "name" and _YES not in votes and votes[0] != _NO


def _place(pattern: str, near: list[str]) -> list[str]:
    """Features of the place where a possible name stands, whatever the name."""
    return ["~", "~" + pattern.split("|")[1], "~" + near[0], "~" + near[1], f"~{near[0]}{near[1]}"]


def _logistic(rows: list[tuple[list[str], float, float]], steps: int, l2: float) -> dict[str, float]:
    """Weights from (features, label in 0..1, weight) by full-batch AdaGrad."""
    names = {f: i for i, f in enumerate(sorted({f for fs, _, _ in rows for f in fs}))}
    if not names:
        return {}
    width = max(len(fs) for fs, _, _ in rows)
    idx = np.full((len(rows), width), len(names))
    for r, (fs, _, _) in enumerate(rows):
        idx[r, : len(fs)] = [names[f] for f in fs]
    y, n = np.array([x[1] for x in rows]), np.array([x[2] for x in rows])
    w, g2 = np.zeros(len(names) + 1), np.full(len(names) + 1, 1e-8)
    for _ in range(steps):
        g = np.bincount(idx.ravel(), np.repeat((1 / (1 + np.exp(-np.clip(w[idx].sum(1), -50, 50))) - y) * n, width), len(w)) + l2 * w
        g[-1] = 0.0
        g2 += g * g
        w -= 0.5 * g / np.sqrt(g2)
        w[-1] = 0.0
    return {f: float(w[i]) for f, i in names.items() if abs(w[i]) > 1e-3}


def classifier(cases: list[tuple[str, str, list[str], int]], q: dict[tuple[str, str], float], steps: int = 300, l2: float = 0.02) -> dict[str, float]:
    """Weights of the span classifier from counted candidates (kind, pattern, tokens around, count) and the posteriors of
    their patterns.

    A name that no labeler knows is not a negative case, it is unlabelled. For those a second model learns, from the places
    alone, where known names stand; it sees a known name at only a share of the places of names, and that share is its mean
    over the known names. A place is one of names if the model gives at least half of that."""
    cases = sorted(cases)
    weights = _logistic([(_evidence(k, p, near), q[(k, p)], n**0.5) for k, p, near, n in cases], steps, l2)
    places = [(_place(p, near), q[(k, p)], float(n)) for k, p, near, n in cases if k == "name" and p[0] != _NO]
    where = _logistic(places, steps, l2)
    mass = sum(y * n for _, y, n in places)
    share = sum(y * n / (1 + np.exp(-sum(where.get(f, 0.0) for f in fs))) for fs, y, n in places) / mass if mass > 0 else 1.0
    return weights | where | {"~share": float(np.log(share / (2 - share)))}


def accepts(w: dict[str, float], kind: str, pattern: str, near: list[str]) -> bool:
    if _unknown(kind, pattern):
        return sum(w.get(f, 0.0) for f in _place(pattern, near)) >= max(w["~share"], -2.0)
    return sum(w.get(f, 0.0) for f in _evidence(kind, pattern, near)) >= 0


def candidates(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, kind, start, end, pattern, near, pii) of every candidate of every row, stored once."""

    @F.pandas_udf("array<struct<kind:string,start:int,end:int,pattern:string,near:array<string>,pii:string>>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([[(k, a, b, p, around(k, t, a, b), t[a:b]) for k, a, b, p in candidates_of(t)] for t in s], dtype=object)

    rows = df.where(F.length(text) > 0).select(*keys, F.explode(find(F.col(text))).alias("c"))
    return store(rows.select(*keys, "c.*"), "pii")


def fit(found: DataFrame, sample: int = 200_000) -> dict[str, float]:
    """Weights of the span classifier: posteriors from the votes of all candidates, the classifier on a sample of them."""
    counts = {(r["kind"], r["pattern"]): r["n"] for r in found.groupBy("kind", "pattern").agg(F.count(F.lit(1)).alias("n")).collect()}
    classes = 1 + sum(counts.values()) // sample
    seen = found.where(F.pmod(F.xxhash64("pii", "near", F.lit(29)), F.lit(classes)) == 0).groupBy("kind", "pattern", "near").agg(F.count(F.lit(1)).alias("n"))
    return classifier([(r["kind"], r["pattern"], list(r["near"]), r["n"]) for r in seen.collect()], posteriors(counts))


def accepted(found: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates the classifier accepts."""
    shared = found.sparkSession.sparkContext.broadcast(fit(found))

    @F.pandas_udf("boolean")
    def good(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        w = shared.value
        for kinds, patterns, nears in batches:
            yield pd.Series([accepts(w, k, p, list(near)) for k, p, near in zip(kinds, patterns, nears)], dtype=bool)

    yes = found.where(good("kind", "pattern", "near"))
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    return yes.select(*keys, "kind", "start", "end", "pii", rank.alias("rank"))


def resolved(spans: list) -> list:
    """Spans (start, end, kind, pii, rank) without overlaps: better kinds first, then earlier, then longer ones."""
    kept: list = []
    for x in sorted(spans, key=lambda x: (x["rank"], x["start"], -x["end"])):
        if all(x["end"] <= y["start"] or x["start"] >= y["end"] for y in kept):
            kept.append(x)
    return sorted(kept, key=lambda x: x["start"])


def personal_data(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, spans ARRAY<STRUCT<start, end, kind, pii>>) of every row with personal data, spans in order."""
    yes = accepted(candidates(df, keys, text), keys)
    per = yes.groupBy(*keys).agg(F.collect_list(F.struct("start", "end", "kind", "pii", "rank")).alias("s"))

    @F.pandas_udf("array<struct<start:int,end:int,kind:string,pii:string>>")
    def solve(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([[(x["start"], x["end"], x["kind"], x["pii"]) for x in resolved(list(v))] for v in s], dtype=object)

    return per.select(*keys, solve("s").alias("spans"))


def masked(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, text) of every row with each span replaced by its kind's placeholder. The classifier is broadcast and each
    text is searched again where it is, so no text is moved."""
    shared = df.sparkSession.sparkContext.broadcast(fit(candidates(df, keys, text)))
    ranks = {k: i for i, k in enumerate(KINDS)}

    def mask(t: str, w: dict[str, float]) -> str:
        spans = [{"start": a, "end": b, "kind": k, "rank": ranks[k]} for k, a, b, p in candidates_of(t) if accepts(w, k, p, around(k, t, a, b))]
        parts, at = [], 0
        for x in resolved(spans):
            parts += [t[at : x["start"]], f"[{x['kind'].upper()}]"]
            at = x["end"]
        return "".join(parts) + t[at:]

    @F.pandas_udf("string")
    def replace(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = shared.value
        for s in batches:
            yield pd.Series([mask(t, w) if t else t for t in s], dtype=object)

    return df.select(*keys, replace(F.col(text)).alias("text"))
