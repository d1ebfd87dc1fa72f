"""Text cleaning and tokenising as Column expressions; all run in the JVM, null in gives null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from averis.functions.names import col_of

# Unicode white space, spelled out so that other regex engines read it alike.
WS = r"[\t\n\x{0b}\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LATIN = r"A-Za-z\x{c0}-\x{24f}"
WORD = r"[\p{L}\p{N}_]"

# Hesitation sounds that are dropped.
FILLERS = ("ähm", "ähs", "äh", "öhm", "öh", "ehm", "hmm", "hm", "mhm", "mmh", "mm", "mh")
# Phrases that introduce a speaker.
INTROS = ("ich bin", "ich bin der", "ich bin die", "ich bin euer", "ich heiße", "mein name ist", "hier ist", "hier spricht", "mein name")


def _re(c: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(c, pattern, to)


def strip(c: Column | str) -> Column:
    return _re(col_of(c), rf"^{WS}+|{WS}+$", "")


def squeeze_ws(c: Column | str) -> Column:
    """Every run of white space one blank, ends trimmed."""
    return F.trim(_re(col_of(c), WS + "+", " "))


def tidy_punct(c: Column | str) -> Column:
    """No white space before sentence punctuation, single blanks, trimmed."""
    return squeeze_ws(_re(col_of(c), WS + r"+([,.!?;:])", "$1"))


def _capital(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


def drop_ellipsis(c: Column | str) -> Column:
    return _re(col_of(c), rf"…|(?:\.{WS}*){{3,}}", " ")


def normalize_text(c: Column | str) -> Column:
    """Ellipses to blanks, a blank between punctuation and a letter, tidied, first character upper case."""
    return _capital(tidy_punct(_re(drop_ellipsis(c), rf"([.!?])([{LATIN}])", "$1 $2")))


def strip_foreign(c: Column | str) -> Column:
    """Only digits, Latin letters, white space and common punctuation stay."""
    return tidy_punct(_re(col_of(c), rf"[^0-9{LATIN}\t\n\x{{0b}}\f\r \x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}.,!?;:\-–—'\"„“”()\[\]%&/+=€$@#]", " "))


def strip_fillers(c: Column | str) -> Column:
    """C4: hesitation sounds as whole words go, the punctuation they leave behind is repaired."""
    words = "|".join(FILLERS)
    c = _re(col_of(c), rf"(?iu)(?<!{WORD})(?:{words})(?!{WORD})", " ")
    c = _re(c, WS + r"+([,.!?;:])", "$1")
    c = _re(c, r"([.!?])[,;:]+", "$1")
    c = _re(c, rf"(?:[,;:]{WS}*){{2,}}", ", ")
    c = _re(_re(c, WS + "+", " "), r"^[ ,;:.]+", "")
    return _capital(F.trim(c))


def sentences(c: Column | str) -> Column:
    """Split behind . ! ? and white space, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(col_of(c), rf"(?<=[.!?]){WS}+"), strip), lambda s: s != "")


def drop_repeated_sentences(c: Column | str) -> Column:
    """Second half of C6: a sentence equal to the one before it, case aside, is dropped."""
    parts = F.split(col_of(c), rf"(?<=[.!?]){WS}+")
    key = lambda s: F.lower(strip(s))
    kept = F.filter(parts, lambda s, i: (i == 0) | (key(s) == "") | (key(s) != key(F.get(parts, i - 1))))
    return strip(F.array_join(kept, " "))


def normal_form(c: Column | str) -> Column:
    """Lower case, only digits and Latin letters, single blanks."""
    return squeeze_ws(_re(F.lower(col_of(c)), rf"[^0-9a-z\x{{c0}}-\x{{24f}}\t\n\x{{0b}}\f\r \x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]", " "))


def replace_urls(c: Column | str) -> Column:
    """Lower case, addresses of pages replaced by `` URL ``."""
    return _re(F.lower(col_of(c)), r"(?:https?://|www\.)[^ \t\n\r]+", " URL ")


def intro_names(c: Column | str) -> Column:
    """One to three capitalised words behind an introducing phrase."""
    cap = r"[A-ZÄÖÜ][\p{L}\p{N}_]+"
    phrases = "|".join(sorted((p.replace(" ", r" ") for p in INTROS), key=len, reverse=True))
    return F.regexp_extract_all(col_of(c), F.lit(rf"(?iu:{phrases}){WS}+({cap}(?:{WS}+{cap}){{0,2}})"), F.lit(1))


def channel_aliases(name: Column | str) -> Column:
    """The name, its ' - ' parts, what stands in brackets and the name without brackets; four characters at least."""
    n = col_of(name)
    parts = F.concat(
        F.array(F.trim(n)), F.transform(F.split(n, " - "), lambda p: F.trim(p)),
        F.transform(F.regexp_extract_all(n, F.lit(r"\(([^)]+)\)"), F.lit(1)), lambda p: F.trim(p)),
        F.array(F.trim(_re(n, WS + r"*\([^)]*\)", ""))),
    )
    return F.array_sort(F.array_distinct(F.filter(parts, lambda p: F.length(p) >= 4)))


def expand_tokens(names: Column | str) -> Column:
    """The names and their words of three characters or more."""
    n = col_of(names)
    tokens = F.flatten(F.transform(n, lambda x: F.filter(F.split(x, " +"), lambda t: F.length(t) >= 3)))
    return F.array_sort(F.array_distinct(F.concat(n, tokens)))


def redact(text: Column | str, terms: Column, placeholder: str) -> Column:
    """Terms of two characters or more, longest first, as whole words, case aside. Terms are data, hence quoted."""
    order = F.array_sort(F.filter(terms, lambda t: F.length(t) >= 2), lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))
    quoted = lambda t: F.concat(F.lit(rf"(?iu)(?<!{WORD})\Q"), t, F.lit(rf"\E(?!{WORD})"))
    return F.aggregate(order, col_of(text), lambda acc, t: F.call_function("regexp_replace", acc, quoted(t), F.lit(placeholder)))


def anonymize(text: Column | str, name: Column | str) -> Column:
    """C11-C13 without a tagger: channels become [KANAL], introduced names [NAME]."""
    return redact(redact(text, channel_aliases(name), "[KANAL]"), expand_tokens(intro_names(text)), "[NAME]")


def author_of(stem: Column | str) -> Column:
    """The part before the last ' - ', else the whole."""
    return _re(col_of(stem), r"^(.*) - .*$", "$1")


def tokens(c: Column | str) -> Column:
    """Words and single punctuation marks."""
    return F.regexp_extract_all(col_of(c), F.lit(rf"{WORD}+|[^\p{{L}}\p{{N}}_\t\n\x{{0b}}\f\r \x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]"), F.lit(0))


def words(c: Column | str) -> Column:
    """Lower-cased tokens that have a letter."""
    return F.filter(tokens(F.lower(col_of(c))), lambda t: t.rlike(r"\p{L}"))


def token_sentences(c: Column | str) -> Column:
    """Lower case, sentences up to their terminators, split on white space."""
    s = F.regexp_extract_all(F.lower(col_of(c)), F.lit(r"[^.!?\n]+(?:[.!?\n]+|$)|[.!?\n]+"), F.lit(0))
    return F.transform(F.filter(F.transform(s, strip), lambda x: x != ""), lambda x: F.split(x, WS + "+"))


def syllables(c: Column | str) -> Column:
    """Vowel groups of a lower-cased word, at least one."""
    return F.greatest(F.lit(1), F.regexp_count(F.lower(col_of(c)), F.lit("[aeiouyäöüáàâéèêíìîóòôúùû]+")))
