"""Hash signatures, on Arrow batches: XXH3 isn't among Spark's functions, and sums over tokens and bits are slow in those that are."""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import tokens

DIM = 256


def stable_hash(text: Column) -> Column:
    """XXH3-64 with seed 0 as a signed long."""

    @F.pandas_udf("long")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else int(np.uint64(xxhash.xxh3_64_intdigest(t)).view(np.int64))).astype("Int64")

    return run(text)


def hash_embedding(text: Column, dim: int = DIM) -> Column:
    """Sum over tokens of pseudo-random vectors drawn from their hashes, of length 1 (or zero)."""

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        known: dict[str, np.ndarray] = {}

        def vector(token: str) -> np.ndarray:
            if token not in known:
                h = xxhash.xxh3_64_intdigest(token).to_bytes(8, "little")
                known[token] = np.array([xxhash.xxh3_64_intdigest(h + d.to_bytes(8, "little")) % 2000 for d in range(dim)]) / 1000 - 1
            return known[token]

        def embed(words) -> list[float]:
            v = sum((vector(w) for w in words), np.zeros(dim)) if words is not None else np.zeros(dim)
            n = float(np.linalg.norm(v))
            return (v / n if n >= 1e-10 else v * 0).tolist()

        return s.map(embed)

    return run(tokens(text))


DIGEST_DIM = 32


def digest_embedding(text: Column) -> Column:
    """Like hash_embedding, with the 32 hexadecimal digits of a token's MD5, less 7.5, as its vector: any SQL engine can say the same.
    Sums are of halves, so they are exact."""

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        known: dict[str, np.ndarray] = {}

        def vector(token: str) -> np.ndarray:
            if token not in known:
                pairs = np.frombuffer(md5(token.encode()).digest(), np.uint8)
                known[token] = np.stack([pairs >> 4, pairs & 15], axis=1).ravel() - 7.5
            return known[token]

        def embed(words) -> list[float]:
            v = sum((vector(w) for w in words), np.zeros(DIGEST_DIM)) if words is not None else np.zeros(DIGEST_DIM)
            n = float(np.sqrt((v * v).sum()))
            return (v / n if n else v).tolist()

        return s.map(embed)

    return run(tokens(text))


def digest_hash(token: Column) -> Column:
    """60 bits of a token's MD5."""
    return F.conv(F.substring(F.md5(token), 1, 15), 16, 10).cast("long")


def simhash(text: Column, token_hash=F.xxhash64) -> Column:
    """64-bit SimHash of the tokens: a bit is set if most token hashes have it. Hashes are SQL functions, votes are counted on Arrow batches."""
    place = np.arange(64, dtype=np.uint64)

    @F.pandas_udf("long")
    def votes(s: pd.Series) -> pd.Series:
        def code(hashes) -> int:
            if hashes is None or not len(hashes):
                return 0
            bits = (np.asarray(hashes, np.int64).view(np.uint64)[:, None] >> place) & np.uint64(1)
            return int(np.bitwise_or.reduce((2 * bits.sum(axis=0) > len(hashes)).astype(np.uint64) << place).view(np.int64))

        return s.map(code).astype("int64")

    return votes(F.transform(tokens(text), lambda t: token_hash(t)))


def simhash_similarity(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / 64


__all__ = ["digest_embedding", "digest_hash", "hash_embedding", "simhash", "simhash_similarity", "stable_hash"]
