"""Packing of token ids into sequences of at most `size` by Karmarkar-Karp multiway differencing.

Each task tokenizes its own rows as they come; nothing is shuffled. Full sequences are cut from a
document's front. What rests of documents stays whole and is gathered into blocks worth exactly WINDOWS sequences (the
document that a block's end falls into is cut there). A block is split by differencing: the two partial partitions with the
largest imbalance merge, largest sums against smallest, until one near-equal partition is left. Its sums differ by
little, so a window that is above the capacity gives the end of its longest piece to windows below it: only what differencing
cannot place is cut. Without leave to cut (`fill`), a window above the capacity makes the block try again with one window more.

Defined cases: null or empty text is the end id alone. Repeated rows are packed each, as are rows with a null id. A very long
text's ids are held by its task alone, 4 bytes each. Columns other than id and text play no part, whatever their names.
An empty table gives an empty result. Piece order and sequence
ids depend on the input's partitions, which Spark rebuilds alike when an executor is lost.
"""

from __future__ import annotations

import heapq
import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

SIZE, END_ID = 2048, 1
#: Sequences to a block. Only the last block of a task is not worth exactly as many.
WINDOWS = 32
#: Fixed value: the public splitting pattern of byte-level BPE.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@lru_cache(maxsize=2)
def encoder(path: str):
    """The byte-level BPE of a tokenizer file as a faster encoder with the same ids: its merges are ranked by id."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(letter[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special), tuple(special)


def token_ids(text: str | None, path: str) -> np.ndarray:
    """The ids of a text, then END_ID."""
    if not text:
        return np.array([END_ID], np.uint32)
    enc, special = encoder(path)
    ids = enc.encode(text, allowed_special="all") if any(s in text for s in special) else enc.encode_ordinary(text)
    ids.append(END_ID)
    return np.array(ids, np.uint32)


def difference(sizes: list[int], ways: int) -> list[list[int]]:
    """Items split into `ways` groups of near-equal sums, by Karmarkar-Karp multiway differencing."""
    left, right = [-1] * len(sizes), [-1] * len(sizes)  # nodes: an item, or two merged nodes
    heap = []
    for i, s in enumerate(sizes):
        sums, node = np.zeros(ways, np.int64), np.full(ways, -1, np.int64)
        sums[0], node[0] = s, i
        heap.append((-s, i, sums, node))
    heapq.heapify(heap)
    tick = len(sizes)
    while len(heap) > 1:
        _, _, s1, n1 = heapq.heappop(heap)
        _, _, s2, n2 = heapq.heappop(heap)
        s2, n2 = s2[::-1], n2[::-1]
        sums, node = s1 + s2, np.where(n1 >= 0, n1, n2)
        for j in np.flatnonzero((n1 >= 0) & (n2 >= 0)).tolist():
            left.append(int(n1[j]))
            right.append(int(n2[j]))
            node[j] = len(left) - 1
        order = np.argsort(-sums, kind="stable")
        sums, node = sums[order], node[order]
        heapq.heappush(heap, (-int(sums[0] - sums[-1]), tick, sums, node))
        tick += 1
    groups = []
    for root in heap[0][3].tolist() if heap else []:
        group, stack = [], [root]
        while stack:
            x = stack.pop()
            if x >= len(sizes):
                stack += [right[x], left[x]]
            elif x >= 0:
                group.append(x)
        groups.append(group)
    return groups


def fill(sizes: list[int], size: int) -> list[list[int]]:
    """Groups of at most `size` each: as few windows as the sum allows, one more whenever one is too full."""
    ways = max(1, -(-sum(sizes) // size))
    while True:
        groups = difference(sizes, ways)
        if all(sum(sizes[i] for i in g) <= size for g in groups):
            return [g for g in groups if g]
        ways += 1


def level(sizes: list[int], size: int) -> list[list[tuple[int, int, int]]]:
    """Groups of (item, first, length) of at most `size` each, as few as the sum allows: differencing places whole items, and
    a group that is too full gives the end of its longest items to groups with room, in the order of both."""
    groups = [[(i, 0, sizes[i]) for i in g] for g in difference(sizes, max(1, -(-sum(sizes) // size)))]
    over: list[tuple[int, int, int]] = []
    for g in groups:
        g.sort(key=lambda p: (p[2], p[0]))
        extra = sum(p[2] for p in g) - size
        while extra > 0:
            i, at, n = g.pop()
            cut = min(n, extra)
            over.append((i, at + n - cut, cut))
            if n > cut:
                g.append((i, at, n - cut))
            extra -= cut
    for g in groups:
        room = size - sum(p[2] for p in g)
        while room > 0 and over:
            i, at, n = over.pop()
            g.append((i, at, min(n, room)))
            if n > room:
                over.append((i, at + room, n - room))
            room -= min(n, room)
    return [g for g in groups if g]


def _pack(path: str, size: int, whole: bool):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        serial = TaskContext.get().partitionId() << 33
        block: list[tuple[int, int, np.ndarray, int]] = []  # document, start, ids, the document's number of ids
        held, room = 0, WINDOWS * size
        out: list[tuple] = []

        def flush():
            nonlocal serial, held
            sizes = [len(p[2]) for p in block]
            for group in [[(i, 0, sizes[i]) for i in g] for g in fill(sizes, size)] if whole else level(sizes, size):
                at = 0
                for i, first, n in group:
                    doc, start, ids, total = block[i]
                    out.append((doc, start + first, n, zlib.crc32(ids[first : first + n].tobytes()), total, serial, at))
                    at += n
                serial += 1
            block.clear()
            held = 0

        def batch_of():
            cols = list(zip(*out, strict=True)) or [()] * len(names)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = token_ids(text.as_py(), path)
                n, at = len(ids), 0
                while at < n:
                    if n - at >= size:
                        out.append((doc, at, size, zlib.crc32(ids[at : at + size].tobytes()), n, serial, 0))
                        serial += 1
                        at += size
                        continue
                    if whole and held + n - at > room:
                        flush()
                    length = min(n - at, room - held)
                    block.append((doc, at, ids[at : at + length].copy(), n))
                    held += length
                    at += length
                    if held == room:
                        flush()
            if len(out) >= 20_000:
                yield batch_of()
        if block:
            flush()
        yield batch_of()

    return run


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. whole: what rests of a document is never cut."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_pack(tokenizer, size, whole), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
