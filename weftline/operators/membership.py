"""Membership in a large set of keys, by a Bloom filter first and an exact join of its positives.

The filter is a table of 64-bit words: a key sets BITS bits of one word, words are merged by bit_or. About ten bits
a key leave some two in a hundred unknown keys positive. It is broadcast only if its measured size is below
``limit``; larger sets take the plain join, with the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits that a key sets in its word, and keys a word.
BITS, KEYS_A_WORD = 4, 6
#: Most bytes of a filter that is broadcast; a word takes 16.
LIMIT = 64 << 20


def _word(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(words))


def _mask(key: Column) -> Column:
    """BITS bits of 64, by a hash of its own."""
    h = F.xxhash64(F.lit("bits"), key)
    mask = F.lit(0).cast("long")
    for k in range(BITS):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")))
    return mask


def bloom(keys: DataFrame, key: str, n: int) -> DataFrame:
    """(word, bits) of about ``n`` keys; a partial aggregate, so a common key costs no more than another."""
    words = max(1, n // KEYS_A_WORD)
    return keys.where(F.col(key).isNotNull()).select(_word(F.col(key), words).alias("word"), _mask(F.col(key)).alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("bits"))


def split(rows: DataFrame, filter_: DataFrame, key: str, n: int) -> DataFrame:
    """``rows`` with ``maybe``: false where the key is certainly not among those of the filter, which is broadcast."""
    at = rows.withColumn("_word", _word(F.col(key), max(1, n // KEYS_A_WORD)))
    joined = at.join(F.broadcast(filter_.withColumnRenamed("word", "_word").withColumnRenamed("bits", "_bits")), "_word", "left")
    maybe = F.col("_bits").bitwiseAND(_mask(F.col(key))) == _mask(F.col(key))
    return joined.withColumn("maybe", F.coalesce(maybe, F.lit(False))).drop("_word", "_bits")


def not_in(rows: DataFrame, seen: DataFrame, key: str, limit: int = LIMIT) -> DataFrame:
    """Rows whose ``key`` is not among ``seen``'s, exactly; a null key is among none. Only the filter's positives are shuffled.

    Repeated rows stay; ``seen`` may hold repeats and nulls. ``seen`` is counted first: its size decides the plan, never the result.
    """
    known = seen.select(F.col(key).alias("_seen")).where(F.col("_seen").isNotNull())
    n = known.count()
    if n // KEYS_A_WORD * 16 > limit:
        return rows.join(known, F.col(key) == F.col("_seen"), "left_anti")
    told = split(rows, bloom(known, "_seen", n), key, n)
    positives = told.where("maybe").drop("maybe")
    return told.where("NOT maybe").drop("maybe").unionByName(positives.join(known, F.col(key) == F.col("_seen"), "left_anti"))
