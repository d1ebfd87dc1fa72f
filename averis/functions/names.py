"""Canonical forms of method names, splits and case-folder names, all as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Registry key of each method and its display name.
METHODS = {
    "coav": "COAV", "siambert": "SiamBERT", "fevec": "FeVec-DE", "dv": "DV-Bin-DE", "css": "CSS",
    "mlsr": "MultilingualStyleRepresentation", "mstyledistance": "MStyleDistance",
    "stylospeaker": "StyloSpeaker", "rsp": "RSP", "lambdag": "LambdaG",
}
_BY_NAME = {k: k for k in METHODS} | {v.lower(): k for k, v in METHODS.items()}

#: Folder name of a case: optional tag of one letter, known author, "vs" or "vs.", unknown author.
PAIR = r"(?U)^(?:\[[A-Za-z]\]\s*)?(.+?)\s+vs\.?\s+(.+?)\s*$"


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def method_key(c: Column | str) -> Column:
    """Registry key of a registry key or display name, letter case aside; other names lower-cased; null stays null."""
    low = F.lower(F.trim(col_of(c)))
    table = F.create_map(*[F.lit(x) for kv in _BY_NAME.items() for x in kv])
    return F.coalesce(F.try_element_at(table, low), low)


def split_key(c: Column | str) -> Column:
    """train/test for themselves and their directory aliases training/testing."""
    low = F.lower(F.trim(col_of(c)))
    return F.when(low == "training", "train").when(low == "testing", "test").otherwise(low)


def compose(c: Column | str) -> Column:
    """NFC, evaluated only where a combining mark occurs (the composition is an ICU call in the JVM)."""
    c = col_of(c)
    return F.when(c.rlike(r"\p{M}"), F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(False))).otherwise(c)


def squeeze(c: Column | str) -> Column:
    """Unicode blanks collapsed to one space and trimmed."""
    return F.trim(F.regexp_replace(col_of(c), r"(?U)\s+", " "))


def pair_side(c: Column | str, side: int) -> Column:
    """Known (1) or unknown (2) speaker of a folder name in composed form; empty string if the pattern does not match."""
    return squeeze(F.regexp_extract(compose(c), PAIR, side))


def pair_key(c: Column | str) -> Column:
    """``known \\u0001 unknown`` of a folder name, in one pass of the pattern; index names and anything else the pattern
    rejects stay as they are but for their blanks."""
    return squeeze(F.regexp_replace(compose(c), PAIR, "$1\u0001$2"))


def speaker_key(c: Column | str) -> Column:
    """A speaker's name with letter case, spacing and encoding aside."""
    return F.lower(squeeze(compose(c)))
