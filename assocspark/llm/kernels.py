"""Vectorised hashing of bytes, words and shingles. Everything runs on whole Arrow batches of UTF-8 texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
#: Texts are hashed in buffers of about this many bytes (one longer text makes a buffer of its own).
BUFFER = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (the finaliser of SplitMix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, BUFFER + 4096)
        with np.errstate(over="ignore"):
            steps = np.full(size, base, U64)
            steps[0] = 1
            have = np.cumprod(steps, dtype=U64)
        _powers[name] = have
    return have[:n]


def inverse_powers(n: int) -> np.ndarray:
    return _power("down", _INV, n + 1)


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """P with n + 1 entries, so that range_hash(P, s, e) depends on nothing but the bytes s to e."""
    out = np.zeros(len(buf) + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[buf] * _power("up", _BASE, len(buf)), out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((prefix[end] - prefix[start]) * inverse_powers(len(prefix))[start] + (end - start).astype(U64))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and its n + 1 offsets; null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[at[0] : at[-1]], at - at[0]


def buffers(batches: Iterator[pa.RecordBatch], size: int = BUFFER) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts (column 1) have about size bytes together."""
    for batch in batches:
        _, at = utf8(batch.column(1))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(at, at[start] + size, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end


def joined(buf: np.ndarray, at: np.ndarray, gap: int = 32) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts one after another with a gap byte behind each; their starts and ends."""
    n = len(at) - 1
    out = np.full(len(buf) + n, gap, np.uint8)
    keep = np.ones(len(out), bool)
    keep[at[1:] + np.arange(n)] = False
    out[keep] = buf
    return out, at[:-1] + np.arange(n), at[1:] + np.arange(n)


def words(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+."""
    inside = np.zeros(len(text) + 2, np.int8)
    inside[1:-1] = ~_SPACE[text]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles over A-Z lower-cased words. Fewer words make one shingle, no words none."""
    buf, at = utf8(column)
    text, start, end = joined(_LOWER[buf], at)
    ws, we = words(text)
    h = range_hash(prefix_hash(text), ws, we)
    first, last = np.searchsorted(ws, start), np.searchsorted(ws, end)
    with np.errstate(over="ignore"):
        acc = h
        for j in range(1, k):
            acc = mix(acc[:-1] * U64(0xA24BAED4963EE407) + h[j:]) if len(acc) > 1 else acc[:0]
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            if b - a >= k:
                yield np.unique(acc[a : b - k + 1])
            elif b > a:
                one = h[a]
                for x in h[a + 1 : b]:
                    one = mix(np.array([one * U64(0xA24BAED4963EE407) + x]))[0]
                yield mix(np.array([one + U64(b - a)]))
            else:
                yield np.zeros(0, U64)
