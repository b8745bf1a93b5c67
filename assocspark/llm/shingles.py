"""Word shingles as DataFrame expressions: words are runs of letters and digits, lower-cased."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality_rules import let

SHINGLE, PERCENT = 5, 80
#: Bits of a bitmap of keys: 2 MB.
MAP_BITS = 1 << 24
#: Between words; the same pattern works in other SQL engines.
BETWEEN = "[^\\p{L}\\p{N}]+"


def word_hashes(text: Column) -> Column:
    words = F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), BETWEEN, -1), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingle_hashes(hashes: Column, k: int) -> Column:
    """Hashes of the k-word shingles by position; none if there are fewer words."""
    return F.when(F.size(hashes) < k, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(hashes) - k), lambda i: F.xxhash64(*(F.get(hashes, i + j) for j in range(k)))))


def item_shingles(text: Column, k: int = SHINGLE) -> Column:
    """(k, set) of a short text: its distinct k-word shingles, or with fewer words the whole sequence as one."""

    def of(h: Column) -> Column:
        short = F.when(F.size(h) == 0, F.array().cast("array<bigint>"))
        for n in range(1, k):
            short = short.when(F.size(h) == n, shingle_hashes(h, n))
        return F.struct(F.least(F.size(h), F.lit(k)).alias("k"), F.array_distinct(short.otherwise(shingle_hashes(h, k))).alias("shingles"))

    return let(word_hashes(text), of)


def minima_needed(size: int, percent: int = PERCENT) -> int:
    """So many minima of a set with at most `size` shingles that one of them is in any text that holds percent of the set."""
    return size - math.ceil(size * percent / 100) + 1


def size_class(n: Column) -> Column:
    """Sets of 2 ** (c - 1) < n <= 2 ** c shingles are in partition c."""
    return F.ceil(F.log2(n.cast("double"))).cast("int")


def minima(shingles: Column, percent: int = PERCENT) -> Column:
    """The least hashes of a set, as many as its size partition needs to lose no match."""
    upper = F.pow(F.lit(2.0), size_class(F.size(shingles))).cast("int")
    need = upper - F.ceil(upper * percent / 100).cast("int") + 1
    return F.slice(F.array_sort(shingles), 1, F.greatest(need, F.lit(1)))


def bitmap(keys: DataFrame, bits: int = MAP_BITS) -> Column:
    """A test of the column `shingle` that is true of every key of keys (shingle), and of others with a chance of keys / bits.

    The bits are one row, so they reach the tasks as the value of a scalar subquery: bits / 8 bytes."""
    where = lambda h: h.bitwiseAND(F.lit(bits - 1))
    spot = where(F.col("shingle"))
    words = keys.groupBy(F.shiftright(spot, 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), spot.bitwiseAND(F.lit(63)).cast("int"))).alias("w"))
    every = keys.sparkSession.range(bits >> 6).withColumnRenamed("id", "at").join(words, "at", "left")
    row = every.groupBy().agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("w", F.lit(0)).alias("w")))).alias("x"))
    held = row.select(F.col("x.w").alias("x")).scalar()
    word = F.get(held, F.shiftright(spot, 6).cast("int"))
    return F.call_function("shiftright", word, spot.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
