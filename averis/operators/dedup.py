"""Messages delivered more than once: exact quotient hash tables over fixed-width identifiers.

An identifier is brought to 128 bits (two BIGINT words, the two halves of an MD5 digest of its length-prefixed fields).
A Feistel network, invertible whatever its round function, permutes the 128 bits so that any skew of the identifiers
is gone. The leading ``quotient_bits`` of the permuted identifier are the quotient, which names the table's shard and
comes first in its key; the remainder, stored whole, follows. The permutation is a bijection and nothing of the remainder
is dropped, so two rows meet in one slot exactly if their 128-bit identifiers are equal. With ``exact`` the slot also
holds the identifier as it was before the digest, as the last part of its key, so that even identifiers of one digest
stay apart: there are no false matches at all. Without it fewer bytes are moved and equality is that of digests.

Insertion is a hash aggregation: copies within a map task are merged before the shuffle, so a hot identifier costs one
slot per task, and a slot takes its identifier once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 4


def _framed(keys: Sequence[Column]) -> Column:
    """One string per identifier, injective: each field with its length in front; null is told from every string."""
    parts = []
    for k in keys:
        s = k.cast("string")
        parts += [F.coalesce(F.length(s).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(s, F.lit(""))]
    return F.concat(*parts)


def identifier(keys: Sequence[Column]) -> tuple[Column, Column]:
    digest = F.md5(_framed(keys).cast("binary"))
    word = lambda a: F.conv(F.substring(digest, a, 16), 16, -10).cast("bigint")
    return word(1), word(17)


def permuted(hi: Column, lo: Column, rounds: int = ROUNDS) -> tuple[Column, Column]:
    for r in range(rounds):
        hi, lo = lo, hi.bitwiseXOR(F.xxhash64(lo, F.lit(r)))
    return hi, lo


def unpermuted(hi: Column, lo: Column, rounds: int = ROUNDS) -> tuple[Column, Column]:
    for r in reversed(range(rounds)):
        hi, lo = lo.bitwiseXOR(F.xxhash64(hi, F.lit(r))), hi
    return hi, lo


def quotient_table(df: DataFrame, keys: Sequence[Column], row_id: str, quotient_bits: int = 16, keep: str = "last", exact: bool = True) -> DataFrame:
    """One row per identifier: quotient INT, remainder (rem_hi, rem_lo), kept row id, number of copies.

    Nulls in a key field are a value of their own. Rows whose ``row_id`` is null are never kept unless all copies have
    none. An empty table gives an empty table. Column names of ``df`` do not matter: only expressions are read.
    """
    rows = df.select(_framed(keys).alias("_f"), F.col(row_id).cast("bigint").alias("_id"))
    own = ["_f"] if exact else []
    rows = rows.select(F.md5(F.col("_f").cast("binary")).alias("_d"), *own, "_id")
    word = lambda a: F.conv(F.substring("_d", a, 16), 16, -10).cast("bigint")
    rows = rows.select(word(1).alias("_h"), word(17).alias("_l"), *own, "_id")
    for r in range(ROUNDS):
        rows = rows.select(F.col("_l").alias("_h"), F.col("_h").bitwiseXOR(F.xxhash64(F.col("_l"), F.lit(r))).alias("_l"), *own, "_id")
    mask = (1 << (64 - quotient_bits)) - 1
    rows = rows.select(
        F.shiftrightunsigned("_h", 64 - quotient_bits).cast("int").alias("quotient"),
        F.col("_h").bitwiseAND(F.lit(mask)).alias("rem_hi"), F.col("_l").alias("rem_lo"), *own, "_id",
    )
    best = F.max("_id") if keep == "last" else F.min("_id")
    return rows.groupBy("quotient", "rem_hi", "rem_lo", *own).agg(best.alias("kept"), F.count(F.lit(1)).alias("copies")).drop("_f")


def redelivered(df: DataFrame, keys: Sequence[Column], row_id: str, keep: str = "last", **kw) -> DataFrame:
    """Row ids that are copies of a kept row. Needs ``row_id`` unique; the anti join on it has no skew."""
    kept = quotient_table(df, keys, row_id, keep=keep, **kw).select(F.col("kept").alias("_kept"))
    ids = df.select(F.col(row_id).alias("_row"))
    return ids.join(kept, ids["_row"] == kept["_kept"], "left_anti").select(F.col("_row").alias(row_id))


def deduplicated(df: DataFrame, keys: Sequence[Column], row_id: str, keep: str = "last", **kw) -> DataFrame:
    """``df`` with exactly one row of each identifier, all columns kept as they are."""
    kept = quotient_table(df, keys, row_id, keep=keep, **kw).select(F.col("kept").alias("_kept"))
    return df.join(kept, df[row_id] == kept["_kept"], "left_semi")
