"""Bytes of texts that repeat a passage of 100 bytes, exactly, by suffix sorting of what may repeat.

Suffix-sorting a corpus of long texts column by column takes as many rounds as the longest text has
bytes. The construction here is therefore given short documents only: pieces around positions that
any two equal 100-byte strings share.

1. Each 100-byte window picks the least hash among its 32-byte grams (leftmost of equals). Windows
   in a row with the same pick form a territory, known by the gram's hash and the territory's own.
   Equal windows pick the same gram at the same place, so they are in territories of one gram.
2. Territories are collapsed where they arise and then dealt by the gram's hash. All but the first of
   equal territories repeat it whole. Different territories of a gram may share some windows: where
   hashes of the bytes that such windows would have in common agree, they are asked for as pieces of at
   most 168 bytes. Grams known from a bounded sample to be
   very common are dealt by the territory's hash instead, and all their pieces are asked for.
3. Pieces are suffix-sorted by column-wise construction: each round inserts one symbol of every piece
   and rewrites the collection's Burrows-Wheeler transform and common prefixes from one external file
   to the next. Suffixes with common prefixes of 100 or more are equal windows; the first of each goes
   on, dealt by its hash, to meet the same window of other piece sets.

Defined cases: null text is empty. Texts under 100 bytes lose nothing. Rows that share an id are one
document written twice: they don't repeat each other, and each is returned. Rows with a null id
are returned whole. A text longer than a buffer is hashed alone, in steps, with 16 bytes of hashes for each of its own. Columns other
than id and text play no part, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, local_tmp, small_side, written
from .kernels import U64, buffers, inverse_powers, mix, prefix_hash, range_hash, utf8

LENGTH, GRAM = 100, 32
PICKS = LENGTH - GRAM + 1
#: Windows are told apart by their gram's place in them, in SHARES classes of SHARE places. All windows
#: of class i around a gram at q hold the bytes from q - SHARE * i to CORE bytes on.
SHARES, SHARE = 4, -(-PICKS // 4)
CORE = LENGTH - SHARE + 1
#: Windows looked at together, pieces sorted together, bytes of text to a dealt part.
STEP, PIECES, PART_BYTES = 1 << 17, 2048, 8 << 20
#: Documents sampled for very common grams, the share of them that makes a gram common, the most of such grams.
SAMPLE, COMMON, COMMON_MAX = 2_000, 0.02, 10_000


_KINDS = {"key": np.uint64, "sub": np.uint32, "doc": np.int64, "start": np.int64, "n": np.uint8, "at": np.uint8, **{f"core{i}": np.uint8 for i in range(SHARES)}}


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` keys in a row."""
    n = len(key) - width + 1
    full = np.full(-(-len(key) // width) * width, np.iinfo(np.uint64).max, U64)
    full[: len(key)] = key
    rows = full.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def territories(buf: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """Of all texts of a buffer: gram hash, territory hash, document, first window, windows, the gram's
    place in the first window, and for each class a hash of its core (0: no window of it)."""
    out: list[tuple[np.ndarray, ...]] = []
    names = tuple(_KINDS)
    if len(buf) < LENGTH:
        return {c: np.zeros(0, _KINDS[c]) for c in names}
    prefix = prefix_hash(buf)
    inside = np.zeros(len(buf) + 1, np.int32)
    long = np.diff(at) >= LENGTH
    inside[at[:-1][long]] += 1
    inside[at[1:][long] - LENGTH + 1] -= 1
    inside = np.cumsum(inside)[:-1] > 0
    down = inverse_powers(len(buf))
    low = U64(STEP * 2 - 1)
    for s in range(0, len(buf) - LENGTH + 1, STEP):
        e = min(s + STEP, len(buf) - LENGTH + 1)
        w = np.flatnonzero(inside[s:e])
        if not len(w):
            continue
        end = e + PICKS - 1
        with np.errstate(over="ignore"):
            gram = mix((prefix[s + GRAM : end + GRAM] - prefix[s:end]) * down[s:end])
        pick = (_least((gram & ~low) | np.arange(end - s, dtype=U64), PICKS) & low).astype(np.int64)
        p = pick[w]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(w) != 1) | (np.diff(p) != 0)]))
        first, last = w[new], w[np.append(new[1:], len(w)) - 1]
        spot = p[new]
        with np.errstate(over="ignore"):
            own = mix(range_hash(prefix, first + s, last + s + LENGTH) + (spot - first).astype(U64) * U64(0x9E3779B97F4A7C15))
        doc = np.searchsorted(at, first + s, "right") - 1
        cores = []
        for i in range(SHARES):
            has = (spot - first >= SHARE * i) & (spot - last < SHARE * (i + 1))
            a = (spot + s - SHARE * i)[has]
            core = np.zeros(len(new), np.uint8)
            core[has] = (range_hash(prefix, a, a + CORE) >> U64(56)).astype(np.uint8) | np.uint8(1)
            cores.append(core)
        out.append((gram[spot], (own >> U64(32)).astype(np.uint32), doc, first + s - at[doc], last - first + 1, spot - first, *cores))
    if not out:
        return territories(buf[:0], at[:1])
    return dict(zip(names, map(np.concatenate, zip(*out, strict=True)), strict=True))


def _firsts(doc: np.ndarray, start: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A sort order by keys, document, start; and in it, which rows repeat an earlier row of the same keys."""
    order = np.lexsort((start, doc, *keys))
    if not len(order):
        return order, np.zeros(0, bool)
    same = np.ones(len(order) - 1, bool)
    for k in keys:
        k = k[order]
        same &= k[1:] == k[:-1]
    head = np.concatenate([[True], ~same])
    lead = np.flatnonzero(head)[np.cumsum(head) - 1]
    doc, start = doc[order], start[order]
    return order, (doc != doc[lead]) | (start != start[lead])


def _dealt(part: np.ndarray, parts: int, kind: int, **cols: np.ndarray) -> Iterator[tuple]:
    """(part, kind, one binary for each column) for every part that has rows."""
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(cut)).tolist():
        rows = order[cut[p] : cut[p + 1]]
        yield p, kind, *(cols[c][rows].astype(t).tobytes() if c in cols else b"" for c, t in _KINDS.items())


_PACKED = "part int, kind int, " + ", ".join(f"{c} binary" for c in _KINDS)


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * (2 + len(_KINDS))
    kinds = [pa.int32(), pa.int32()] + [pa.binary()] * len(_KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in _PACKED.split(", ")])


def _unpacked(table: pa.Table, kind: int) -> dict[str, np.ndarray]:
    kinds = table.column("kind").to_numpy()
    rows = np.flatnonzero(kinds == kind)
    return {c: np.frombuffer(b"".join(table.column(c)[int(i)].as_py() for i in rows), t) for c, t in _KINDS.items()}


_RANGES = "doc_id long, start long, n long, kind int"


def _ranges(doc, start, n, kind: int) -> pa.Table:
    return pa.table({"doc_id": pa.array(doc, pa.int64()), "start": pa.array(start, pa.int64()), "n": pa.array(n, pa.int64()), "kind": pa.array(np.full(len(doc), kind, np.int32))})


def _collapse(parts: int, common: np.ndarray):
    """Step 1, and what of step 2 needs no other rows."""

    def run(batches):
        for batch in buffers(batches):
            buf, at = utf8(batch.column(1))
            x = territories(buf, at)
            x["doc"] = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)[x["doc"]]
            order, again = _firsts(x["doc"], x["start"], x["sub"], x["key"])
            x = {c: v[order] for c, v in x.items()}
            deal = (np.where(np.isin(x["key"], common), mix(x["key"] ^ x["sub"].astype(U64)), x["key"]) % U64(parts)).astype(np.int64)
            out = list(_dealt(deal[~again], parts, 0, **{c: v[~again] for c, v in x.items()}))
            out += _dealt(deal[again], parts, 1, **{c: x[c][again] for c in ("doc", "start", "n")})
            yield _packed(out)

    return run


def _shared(gram: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Which rows have a side, and share gram and side with another row."""
    out = np.zeros(len(gram), bool)
    has = np.flatnonzero(side)
    with np.errstate(over="ignore"):
        _, inverse, count = np.unique(mix(gram[has] + side[has].astype(U64) * U64(0xD1342543DE82EF95)), return_inverse=True, return_counts=True)
    out[has] = count[inverse] > 1
    return out


def _meet(common: np.ndarray):
    """The rest of step 2, for one part."""

    def run(table: pa.Table) -> pa.Table:
        x, done = _unpacked(table, 0), _unpacked(table, 1)
        order, again = _firsts(x["doc"], x["start"], x["sub"], x["key"])
        x = {c: v[order] for c, v in x.items()}
        repeat = _ranges(x["doc"][again], x["start"][again], x["n"][again], 0)
        x = {c: v[~again].astype(v.dtype if c == "key" or c[:4] == "core" else np.int64) for c, v in x.items()}
        everyone = np.isin(x["key"], common)
        # a window shared with another territory of the gram shares its class's core; classes go from the last window to the first
        asked = np.stack([np.zeros(len(everyone), bool), *(_shared(x["key"], x[f"core{i}"]) | everyone & (x[f"core{i}"] > 0) for i in reversed(range(SHARES))), np.zeros(len(everyone), bool)], axis=1)
        row, begin = np.nonzero(asked[:, 1:] & ~asked[:, :-1])
        _, end = np.nonzero(asked[:, :-1] & ~asked[:, 1:])
        a = np.clip(x["at"][row] - SHARE * (SHARES - begin) + 1, 0, x["n"][row])
        b = np.clip(x["at"][row] - SHARE * (SHARES - end) + 1, 0, x["n"][row])
        return pa.concat_tables([_ranges(done["doc"], done["start"], done["n"], 0), repeat, _ranges(x["doc"][row], x["start"][row] + a, b - a, 1)])

    return run


def suffix_sort(pieces: list[bytes], folder: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Piece, offset and common prefix with the one before, of all suffixes of the pieces in order.

    Symbols go in from the right, one of each piece a round. The transform lists, for every suffix so
    far, the symbol before it (0: none). Sorted stably by symbol, it is the order of the suffixes one
    symbol longer, so those already in keep their order and the new ones fall into place. The common
    prefix of neighbours with the same first symbol is one more than the least between the places
    they come from. A round reads the last files from front to back and writes the next.
    """
    m = len(pieces)
    text = np.frombuffer(b"".join(pieces), np.uint8)
    used = np.flatnonzero(np.bincount(text, minlength=256))
    kind = np.uint8 if len(used) < 256 else np.uint16  # symbols are numbered from 1 in their order, 0: none
    code = np.zeros(256, kind)
    code[used] = np.arange(1, len(used) + 1)
    text = code[text]
    size = np.array([len(p) for p in pieces], np.int64)
    base = np.cumsum(size) - size
    left = size.copy()

    def before(who: np.ndarray) -> np.ndarray:
        out = np.zeros(len(who), kind)
        some = left[who] > 0
        out[some] = text[base[who[some]] + left[who[some]] - 1]
        return out

    with ExitStack() as files:
        old, new = ([files.enter_context(open(f"{folder}/{x}{i}", "w+b", buffering=0)) for x in ("bwt", "lcp")] for i in (0, 1))
        old[0].write(before(np.arange(m)).data)
        old[1].write(np.zeros(m, np.uint8).data)
        count, rank = m, np.arange(m)
        while True:
            bwt, lcp = np.empty(count, kind), np.empty(count, np.uint8)
            for f, array in zip(old, (bwt, lcp), strict=True):
                f.seek(0)
                f.readinto(array.data)
            place = np.argsort(bwt, kind="stable")[np.count_nonzero(bwt == 0) :]
            live = np.flatnonzero(left > 0)
            if not len(live):
                break
            owner = np.full(count, -1, np.int32)
            owner[rank[live]] = live
            owner = owner[place]
            fresh = np.flatnonzero(owner >= 0)
            who = owner[fresh]
            left[who] -= 1
            rank[who] = m + fresh
            grown, common = np.empty(m + len(place), kind), np.zeros(m + len(place), np.uint8)
            grown[:m] = bwt[:m]
            kept = np.flatnonzero(owner < 0) + m
            grown[kept], common[kept] = bwt[m:], lcp[m:]
            grown[m + fresh] = before(who)
            changed = np.zeros(len(place) + 1, bool)
            changed[fresh] = changed[fresh + 1] = True
            changed[0] = changed[-1] = False
            changed = np.flatnonzero(changed)
            a, b = place[changed - 1], place[changed]
            same = bwt[a] == bwt[b]
            common[m + changed] = 0
            changed, a, b = changed[same], a[same] + 1, b[same] + 1
            if len(changed):
                down = np.argsort(-a, kind="stable")
                ends = np.empty(2 * len(a), np.int64)
                ends[::2], ends[1::2] = a[down], b[down]
                common[m + changed[down]] = np.minimum.reduceat(np.append(lcp, np.uint8(0)), ends)[::2] + 1
            for f, array in zip(new, (grown, common), strict=True):
                f.seek(0)
                f.write(array.data)
            old, new, count = new, old, len(grown)
    step = np.empty(len(bwt), np.int64)
    step[place] = m + np.arange(len(place))
    piece, offset = np.empty(len(bwt), np.int64), np.empty(len(bwt), np.int64)
    spot, who, off = np.arange(m), np.arange(m), size.copy()
    while len(who):
        piece[spot], offset[spot] = who, off
        more = off > 0
        spot, who, off = step[spot[more]], who[more], off[more] - 1
    return piece, offset, lcp


def _sort_pieces(parts: int):
    """Step 3 on rows (doc_id, text, ranges): sorts pieces, reports repeats among them, deals the other windows."""

    def run(batches):
        held: list[tuple[int, int, bytes]] = []

        def sort() -> pa.RecordBatch:
            with local_tmp("suffixes-") as folder:
                piece, offset, lcp = suffix_sort([p[2] for p in held], folder)
            size = np.array([len(p[2]) for p in held], np.int64)
            window = size[piece] - offset >= LENGTH
            # equal windows follow each other; a suffix too short to be one never stands between them
            group = np.cumsum(lcp < LENGTH)
            piece, offset, group = piece[window], offset[window], group[window]
            doc = np.array([p[0] for p in held], np.int64)[piece]
            start = np.array([p[1] for p in held], np.int64)[piece] + offset
            order, again = _firsts(doc, start, group)
            doc, start, piece, offset = doc[order], start[order], piece[order], offset[order]
            text = np.frombuffer(b"".join(p[2] for p in held), np.uint8)
            base = (np.cumsum(size) - size)[piece] + offset
            key = range_hash(prefix_hash(text), base, base + LENGTH)
            sub = range_hash(prefix_hash(text ^ np.uint8(0x5A)), base, base + LENGTH).astype(np.uint32)
            deal = (key % U64(parts)).astype(np.int64)
            one = np.ones(len(doc), np.int64)
            out = list(_dealt(deal[~again], parts, 0, key=key[~again], sub=sub[~again], doc=doc[~again], start=start[~again], n=one[~again]))
            d, s, n = _runs(doc[again], start[again])
            out += _dealt(mix(d.astype(U64)) % U64(parts), parts, 1, doc=d, start=s, n=np.minimum(n, 255))
            held.clear()
            return _packed(out)

        for batch in batches:
            for doc, text, starts, ns in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                data = text.as_py().encode()
                for s, n in zip(starts, ns, strict=True):
                    held.append((doc, s, data[s : s + n + LENGTH - 1]))
                    if len(held) == PIECES:
                        yield sort()
        yield sort() if held else _packed([])

    return run


def _runs(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows as runs (document, first, number) of at most 255."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    if not len(doc):
        return doc, start, start
    new = np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(start) > 1)])
    lead = np.flatnonzero(new)
    new |= (start - start[lead[np.cumsum(new) - 1]]) % 255 == 0
    lead = np.flatnonzero(new)
    last = np.append(lead[1:], len(doc)) - 1
    return doc[lead], start[lead], start[last] - start[lead] + 1


def _meet_windows(table: pa.Table) -> pa.Table:
    x, done = _unpacked(table, 0), _unpacked(table, 1)
    order, again = _firsts(x["doc"], x["start"], x["sub"], x["key"])
    doc, start, n = _runs(x["doc"][order][again], x["start"][order][again])
    return pa.concat_tables([_ranges(done["doc"], done["start"], done["n"], 0), _ranges(doc, start, n, 0)])


def _common_grams(docs: DataFrame, rows: int) -> np.ndarray:
    def run(batches):
        for batch in buffers(batches):
            x = territories(*utf8(batch.column(1)))
            gram, doc = x["key"], x["doc"]
            pairs = np.unique(np.stack([doc.astype(U64), gram]), axis=1)[1] if len(gram) else gram
            yield pa.RecordBatch.from_arrays([pa.array(pairs.view(np.int64))], ["gram"])

    part = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, rows // SAMPLE))) == 0)
    found = part.mapInArrow(run, "gram long").groupBy("gram").count().where(F.col("count") >= max(8, COMMON * min(rows, SAMPLE)))
    return np.sort(np.array([r.gram for r in found.orderBy(F.desc("count"), "gram").limit(COMMON_MAX).collect()], np.int64).view(U64))


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, starts, ns: runs of 100-byte windows (byte offset of the first, number) that also start earlier."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    rows, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(16, size // PART_BYTES)
    common = _common_grams(docs, rows)
    met = docs.mapInArrow(_collapse(parts, common), _PACKED).groupBy("part").applyInArrow(_meet(common), _RANGES)
    met = written(met, "territories")
    wanted = met.where("kind = 1").groupBy("doc_id").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("ns"))
    windows = _with_ranges(docs, written(wanted, "wanted"))[0].select("doc_id", "text", "starts", "ns").mapInArrow(_sort_pieces(parts), _PACKED).groupBy("part").applyInArrow(_meet_windows, _RANGES)
    found = met.where("kind = 0").union(windows)
    return written(found.groupBy("doc_id").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("ns")), "repeated")


def _with_ranges(docs: DataFrame, ranges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of docs that have ranges, with starts and ns, and the others. Only texts that have some
    are shuffled if their ids are few enough to tell without a shuffle."""
    ids = small_side(ranges.select("doc_id"))
    return docs.join(ids, "doc_id", "left_semi").join(ranges, "doc_id"), docs.join(ids, "doc_id", "left_anti")


def _cut(data: bytes, starts, ns) -> tuple[bytes, int]:
    """The bytes that no repeated window covers, and the number of runs removed."""
    if starts is None or not len(starts):
        return data, 0
    s = np.asarray(starts)
    e = s + np.asarray(ns) + LENGTH - 1
    step = np.zeros(len(data) + 1, np.int64)
    np.add.at(step, s, 1)
    np.add.at(step, e, -1)
    gone = np.cumsum(step)[:-1] > 0
    spans = int(np.count_nonzero(gone & ~np.concatenate([[False], gone[:-1]])))
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), spans


def _replace(at: int):
    """Rows whose column `at` is the text and whose last two are its ranges: the text loses what repeats, the
    ranges go. Characters cut in two go as well; null stays null."""

    def run(batches):
        for batch in batches:
            out = []
            for text, s, n in zip(batch.column(at), *(batch.column(batch.num_columns - k).to_pylist() for k in (2, 1)), strict=True):
                text = text.as_py()
                out.append(None if text is None else _cut(text.encode(), s, n)[0].decode(errors="ignore"))
            columns = batch.columns[:-2]
            columns[at] = pa.array(out, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-2])

    return run


def _digest(batches):
    for batch in batches:
        out = []
        for doc, text, s, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            data = (text.as_py() or "").encode()
            kept, spans = _cut(data, s, n)
            out.append((doc, len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
        cols = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    some, others = _with_ranges(rows, repeated_ranges(docs, id_col, text_col))
    none = [F.lit(None).cast("array<long>").alias(c) for c in ("starts", "ns")]
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return some.select("doc_id", "text", "starts", "ns").mapInArrow(_digest, schema).union(others.select("doc_id", "text", *none).mapInArrow(_digest, schema))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with all their columns, the text without what repeats."""
    packed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    some, others = _with_ranges(packed, repeated_ranges(docs, id_col, text_col))
    columns = [F.col("row")[c].cast("string").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns]
    some = some.select(*columns, F.col("starts").alias("__starts"), F.col("ns").alias("__ns"))
    cut = some.mapInArrow(_replace(docs.columns.index(text_col)), some.drop("__starts", "__ns").schema)
    return cut.union(others.select(*columns))
