"""Joins of a table to itself, dealt as pairs of blocks of its keys."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys of a block.
BLOCK = 2_048


def split(rows: DataFrame, key: str, block: int = BLOCK) -> tuple[DataFrame, int]:
    """rows with the block (own) of their key, once for each pair of blocks (lo, hi) that it is in, and the number of pairs. Rows of any
    two keys are together in one pair of blocks."""
    n = max(1, -(-rows.agg(F.approx_count_distinct(key)).first()[0] // block))
    own = rows.withColumn("own", _own(key, n))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return dealt.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("other"), n * (n + 1) // 2


def own(key: str, pairs: int) -> Column:
    """The block of a key, where split() has made so many pairs of blocks."""
    return _own(key, (isqrt(8 * pairs + 1) - 1) // 2)


def _own(key: str, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
