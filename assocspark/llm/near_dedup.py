"""Near-duplicate documents by b-bit MinHash.

Each text's distinct k-word shingles give K minima. The low 4 bits of each are kept and packed
into longs; bands of full minima name candidate buckets. Texts with equal shingle sets are one
class from the start. In a bucket every class is held against one of them (a star, so never
all pairs): the class that meets the most others in all its buckets; the packed bits estimate the similarity, corrected for the 1 in 16
chance that unequal minima agree, and pairs near or above the threshold are confirmed on their
full shingle sets. Connected classes then form components. Pairs of one bucket that are still in
different components are compared as well, block by block and with a longer sketch before they are
confirmed, so that no link is lost.

Sets are known by 128 bits of hash and shingles by 64, so "exact" and "full" mean equal up to those.

Defined cases: null, empty or blank texts have no shingles, stay their own component and are kept.
Repeated rows get the same component. Rows that share an id but not the text are each judged by
their own text. Rows with a null id are returned with a null component and kept. A very long text
is hashed in a buffer of its own, and only its sketches and its set of hashes leave it. Columns of the
input other than id and text play no part, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, small_side, spread_join, written
from .kernels import buffers, shingle_sets

ROWS, BANDS, BITS = 5, 40, 4
K = ROWS * BANDS
PER_LONG = 64 // BITS
#: The estimate is let through this far below the threshold: five standard errors of K minima at 0.8.
MARGIN = 0.148

#: A second, longer sketch of the classes that still have to be compared with many, and its margin (five standard errors).
FINE, FINE_MARGIN = 2048, 0.048
#: Nodes of rows that share an id lie at or below this.
_BELOW = -(1 << 62)
#: So many longs of the longer sketch are looked at first.
COARSE = 12
#: Members of a bucket compared by one group of a task, and rows to a group.
BLOCK, GROUP_ROWS = 2_000, 8_000

_rng = np.random.default_rng(20240229)
_A = (_rng.integers(0, 1 << 32, FINE, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, FINE, dtype=np.uint64).astype(np.uint32)


def minima(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """k minima of 32 bits of a non-empty set of 64-bit hashes."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(k, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 512):
        part = low[None, at : at + 512] * _A[:k, None]
        part += _B[:k, None]
        np.minimum(out, part.min(axis=1), out=out)
    return out


def pack(low: np.ndarray) -> np.ndarray:
    """Low BITS of each minimum, PER_LONG to a long; the rest of the last long is zero."""
    field = np.zeros(-(-len(low) // PER_LONG) * PER_LONG, np.uint64)
    field[: len(low)] = low & np.uint32((1 << BITS) - 1)
    shift = (np.arange(len(field)) % PER_LONG * BITS).astype(np.uint64)
    return np.bitwise_or.reduce((field << shift).reshape(-1, PER_LONG), axis=1).view(np.int64)


def bands(low: np.ndarray) -> list[int]:
    rows = low.reshape(BANDS, ROWS)
    return [xxhash.xxh3_64_intdigest(r.tobytes(), j) - (1 << 63) for j, r in enumerate(rows)]


def _sketch(k: int):
    def run(batches):
        for batch in buffers(batches):
            n, s1, s2, sig, keys = [], [], [], [], []
            for s in shingle_sets(batch.column(1), k):
                n.append(len(s))
                d = xxhash.xxh3_128_intdigest(s.tobytes())
                s1.append((d >> 64) - (1 << 63))
                s2.append((d & ((1 << 64) - 1)) - (1 << 63))
                if len(s):
                    low = minima(s)
                    sig.append(pack(low))
                    keys.append(bands(low))
                else:
                    sig.append(None)
                    keys.append(None)
            ids = [c.cast(pa.int64()) for c in batch.column(0).flatten()]
            numbers, lists = [pa.array(c, pa.int64()) for c in (n, s1, s2)], [pa.array(c, pa.list_(pa.int64())) for c in (sig, keys)]
            yield pa.RecordBatch.from_arrays([*ids, *numbers, *lists], ["doc_id", "given", "n_shingles", "s1", "s2", "sig", "bands"])

    return run


def _sets(k: int):
    def run(batches):
        for batch in buffers(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array((s.view(np.int64) for s in shingle_sets(batch.column(1), k)), pa.list_(pa.int64()))], ["id", "shingles"])

    return run


def _fine(k: int):
    def run(batches):
        for batch in buffers(batches):
            sigs = (pack(minima(s, FINE)) if len(s) else None for s in shingle_sets(batch.column(1), k))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sigs, pa.list_(pa.int64()))], ["rep", "fine"])

    return run


def _estimate(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """Collision-corrected similarities of packed sketches (rows of longs) by bit counts."""
    x = a ^ b
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    x &= np.uint64(0x1111111111111111)
    agree = k - np.bitwise_count(x).sum(axis=-1, dtype=np.int64)  # unused fields agree and are not counted
    chance = 2.0**-BITS
    return (agree / k - chance) / (1 - chance)


def _across(percent: int, best: bool):
    """Likely pairs of one bucket's blocks i and j that are in different components; best: for each member only
    the likeliest. Nothing is compared within the commonest component."""

    def pairs(a: dict, b: dict, ordered: bool):
        for at in range(0, len(a["rep"]), 64):
            x = {c: v[at : at + 64] for c, v in a.items()}
            n = x["n"][:, None], b["n"][None, :]
            may = (x["part"][:, None] != b["part"][None, :]) & (100 * np.minimum(*n) >= percent * np.maximum(*n))
            if ordered:
                may &= b["late"][None, :] | (x["rep"][:, None] < b["rep"][None, :])
            i, j = np.nonzero(may)
            for cut in range(0, len(i), 50_000):
                p, q = i[cut : cut + 50_000], j[cut : cut + 50_000]
                like = _estimate(x["fine"][p, :COARSE], b["fine"][q, :COARSE], COARSE * PER_LONG)
                ok = like >= percent / 100 - MARGIN
                p, q = p[ok], q[ok]
                equal = x["bands"][p] == b["bands"][q]  # a pair belongs to the first bucket that has both
                ok = x["bands"][p, equal.argmax(axis=1)] == x["key"][p]
                p, q = p[ok], q[ok]
                like = _estimate(x["fine"][p], b["fine"][q], FINE)
                ok = like >= percent / 100 - FINE_MARGIN
                p, q = p[ok], q[ok]
                if best:
                    order = np.lexsort((b["rep"][q], -like[ok], p))
                    order = order[np.unique(p[order], return_index=True)[1]]
                    p, q = p[order], q[order]
                yield x["rep"][p], b["rep"][q], x["n"][p], b["n"][q]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("i", "ascending"), ("j", "ascending")])
        rows = {c: table.column(c).to_numpy() for c in ("key", "i", "j", "block", "rep", "part", "n")}
        for c, kind in (("fine", np.uint64), ("bands", np.int64)):
            rows[c] = table.column(c).combine_chunks().flatten().to_numpy().view(kind).reshape(table.num_rows, -1)
        out = [(np.zeros(0, np.int64),) * 4]
        new = np.ones(table.num_rows, bool)
        new[1:] = np.any([rows[c][1:] != rows[c][:-1] for c in ("key", "i", "j")], axis=0)
        lead = np.flatnonzero(new)
        for s, e in zip(lead, np.append(lead[1:], table.num_rows), strict=True):
            part, times = np.unique(rows["part"][s:e], return_counts=True)
            if len(part) == 1:
                continue
            late = rows["part"][s:e] == part[times.argmax()]
            one, two = (rows["block"][s:e] == rows[c][s] for c in "ij")
            group = {c: v[s:e] for c, v in rows.items()} | {"late": late}
            of = lambda mask, group=group: {c: v[mask] for c, v in group.items()}
            if rows["i"][s] == rows["j"][s]:
                out += pairs(of(~late), group, True)
            else:
                out += pairs(of(one & ~late), of(two), False)
                out += pairs(of(two & ~late), of(one & late), False)
        a, b, na, nb = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"a": a, "b": b, "na": na, "nb": nb})

    return run


def _agree(x, y):
    """Fields of two packed longs that agree, by a bit count."""
    x = x.bitwiseXOR(y)
    x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
    x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
    return F.lit(PER_LONG) - F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))


def similar(a, b):
    """Collision-corrected similarity: agreements happen by chance with 2 ** -BITS."""
    spare = -(-K // PER_LONG) * PER_LONG - K
    agree = F.aggregate(F.zip_with(a, b, _agree), F.lit(0), lambda s, v: s + v) - spare
    chance = 2.0**-BITS
    return (agree / F.lit(float(K)) - chance) / (1 - chance)


def components(edges: DataFrame, name: str) -> DataFrame:
    """(id, component) for every id in edges (a, b), by alternating large and small stars until nothing changes."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    mark = None
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.withColumnRenamed("a", "u").join(least, "u")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("u", "m")).where("a <> b").distinct()
        before, now = now, written(small, name)
        discard(before)
        last, mark = mark, now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if last == mark:
            return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select("b", "b").distinct())


def _nodes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text, ...) with a column node, and the ids of several rows. Rows that share an id get a node for each
    text, below all ids (two texts of one id share it with probability 2 ** -62); for all others it is the id."""
    twice = written(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "twice")
    if twice.isEmpty():
        return docs.withColumn("node", F.col("doc_id")), twice
    own = F.lit(_BELOW) - F.pmod(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))), F.lit(1 << 62))
    marked = docs.join(small_side(twice.withColumn("several", F.lit(True))), "doc_id", "left")
    return marked.withColumn("node", F.when(F.col("several"), own).otherwise(F.col("doc_id"))).drop("several"), twice


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, n_shingles, component_id (the smallest id reachable over links of similarity >= percent / 100), kept."""
    rows, twice = _nodes(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    found = _linked(rows, k, percent).withColumnRenamed("component", "component_id")
    if not twice.isEmpty():  # a component that holds such a row is known by a node below all ids
        found = written(found, "found")
        least = found.where(F.col("component_id") <= _BELOW).groupBy("component_id").agg(F.min("doc_id").alias("least"))
        found = found.join(least, "component_id", "left").withColumn("component_id", F.coalesce("least", "component_id"))
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def without_copies(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with all their columns, but one row of each component: that with the smallest id, where rows that share an id
    come before all others and of rows with the same id and text one stays. Rows with a null id all stay."""
    packed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    rows, twice = _nodes(packed)
    found = _linked(rows.select("doc_id", "text", "node"), k, percent)
    gone = written(found.where("node <> component").select("node").distinct(), "gone")
    rest = rows.join(small_side(gone), "node", "left_anti")
    if not twice.isEmpty():
        rest = rest.where(F.coalesce(F.col("node") > _BELOW, F.lit(True))).unionByName(rest.where(F.col("node") <= _BELOW).groupBy("node").agg(*(F.min_by(c, F.to_json("row")).alias(c) for c in ("doc_id", "text", "row"))))
    return rest.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def _linked(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, node, n_shingles, component (the smallest node reachable) for each row of docs (doc_id, text, node)."""
    bounded_batches(docs.sparkSession)
    given = docs.select("node", "doc_id", "text")
    docs = docs.select(F.col("node").alias("doc_id"), "text")
    sketch = written(given.select(F.struct("node", "doc_id").alias("ids"), "text").mapInArrow(_sketch(k), "doc_id long, given long, n_shingles long, s1 long, s2 long, sig array<long>, bands array<long>"), "sketch")
    total = sketch.count()
    classes = written(sketch.where("n_shingles > 0 and doc_id is not null").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "classes")
    # joined by the representative's id too, so that a class of many copies is no hot key
    reps = sketch.join(classes.select("s1", "s2", F.col("rep").alias("doc_id")), ["doc_id", "s1", "s2"])
    reps = written(reps.select(F.col("doc_id").alias("rep"), "n_shingles", "sig", "bands").dropDuplicates(["rep"]), "reps")
    keys = reps.select("rep", F.explode("bands").alias("key"))
    shared = written(keys.join(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"), "shared")
    # the original of many copies meets more of them than any copy does, so it makes the best centre
    met = shared.groupBy("rep").agg(F.sum("n").alias("met"))
    rank = F.least("met", F.lit((1 << 31) - 1)) * (1 << 32) + F.pmod(F.xxhash64("rep"), F.lit(1 << 32))
    ranked = shared.join(met, "rep").select("key", "rep", rank.alias("rank"))
    centres = ranked.groupBy("key").agg(F.max_by("rep", "rank").alias("c"))
    members = written(shared.select("key", "rep").join(centres, "key"), "members")
    discard(shared)
    facts = reps.select(F.col("rep").alias("id"), F.col("n_shingles").alias("n"), "sig", "bands")

    def likely(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose sizes and estimate allow the threshold."""
        for x in "ab":
            pairs = pairs.join(facts.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"s{x}")), x)
        return pairs.where(_may(percent)).select("a", "b", "na", "nb")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        """Pairs, a written table, whose full shingle sets reach the threshold; also written."""
        ids = written(pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "doc_id"), "ids")
        sets = written(docs.join(small_side(ids), "doc_id", "left_semi").mapInArrow(_sets(k), "id long, shingles array<long>").dropDuplicates(["id"]), "sets")
        joined = pairs
        for x in "ba":
            joined = joined.join(sets.select(F.col("id").alias(x), F.col("shingles").alias(f"s{x}")), x)
        both = F.size(F.array_intersect("sa", "sb"))
        out = written(joined.where(100 * both >= percent * (F.col("na") + F.col("nb") - both)).select("a", "b"), name)
        discard(ids, sets, pairs)
        return out

    stars = members.where("rep <> c").select(F.col("rep").alias("a"), F.col("c").alias("b")).distinct()
    links = confirmed(written(likely(stars), "pairs"), "links")
    found, fine = components(links, "parts"), None
    for best in (True, False):  # first the likeliest pair of each, since after it many others are settled
        placed = members.join(found.withColumnRenamed("id", "rep"), "rep", "left").withColumn("part", F.coalesce("component", "rep"))
        mixed = placed.groupBy("key").agg(F.min("part").alias("p0"), F.max("part").alias("p1"), F.count("*").alias("m")).where("m > 2 and p0 < p1")
        open_ = written(placed.join(mixed.select("key"), "key", "left_semi").select("key", "rep", "part"), "open")
        if open_.isEmpty():
            break
        if fine is None:  # later rounds leave fewer members open
            ids = small_side(open_.select(F.col("rep").alias("doc_id")).distinct())
            fine = written(docs.join(ids, "doc_id", "left_semi").mapInArrow(_fine(k), "rep long, fine array<long>").dropDuplicates(["rep"]).join(facts.withColumnRenamed("id", "rep").drop("sig"), "rep"), "fine")
        sizes = open_.groupBy("key").agg(F.count("*").alias("m"))
        # only keys of more than one block are looked up; a block and another make one group of 2 * BLOCK sketches at most
        blocks = written(sizes.where(F.col("m") > BLOCK).select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), "blocks")
        several = blocks.agg(F.coalesce(F.sum(F.col("blocks") * F.col("blocks") * BLOCK), F.lit(0))).first()[0]
        dealt = open_.join(small_side(blocks), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "part").join(fine, "rep")
        groups = max(1, (open_.count() + several) // GROUP_ROWS)
        rest = dealt.groupBy(F.pmod(F.xxhash64("key", "i", "j"), F.lit(groups)).alias("g")).applyInArrow(_across(percent, best), "a long, b long, na long, nb long")
        more = confirmed(written(rest.distinct(), "rest"), "more")
        links = written(links.union(more), "links")
        found = components(links, "parts")
        discard(open_, blocks, more)
    placed = classes.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("s1", "s2", "n", F.coalesce("component", "rep").alias("component"))
    placed = written(placed, "placed")
    discard(reps, members, *([fine] if fine is not None else []))
    facts = sketch.select("given", "doc_id", "n_shingles", "s1", "s2")
    some = F.coalesce((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.lit(False))
    full = spread_join(facts.where(some), placed, ["s1", "s2"], total)
    bare = facts.where(~some).withColumn("component", F.col("doc_id"))  # no shingles or no id: alone
    out = full.select(*bare.columns).union(bare)
    return out.select(F.col("given").alias("doc_id"), F.col("doc_id").alias("node"), "n_shingles", "component")


def _may(percent: int):
    n = F.least("na", "nb"), F.greatest("na", "nb")
    return (100 * n[0] >= percent * n[1]) & (similar(F.col("sa"), F.col("sb")) >= percent / 100 - MARGIN)
