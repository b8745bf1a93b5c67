"""License notices and texts in documents: MinHash bands over overlapping text windows retrieve templates.

Templates are dealt into size classes: a class holds templates of more than `stride` and at most 2 * stride shingles. For each
class that has any, a document is cut into blocks of stride shingles, and a window is SPAN blocks in a row, so every place
where such a template may lie is inside one window. Sketches are one-permutation MinHash: shingle hashes
are told apart by their top bits into BINS bins, and a bin's least hash is a band of one row. A window's band is the least of its
blocks' bands, so blocks are sketched, once each for the SPAN windows they are in, and a template that shares a band with
a block has that block's windows as candidates: all that share a band with a window, and some more. A window with `percent` of a template has a similarity J to it of at least
(0.8 stride) / (3 stride + 0.2 stride) = 1/4 (1/3 with a whole copy of the shortest template, 2/3 of the longest), and BINS = 32
bands miss it with probability (1 - J) ** 32 at most: 1e-4, 2e-6 and 1e-15. Each candidate is verified by exact shingle containment.

Notices of at most SHORT shingles are about as short as a sketch: their windows of 2m shingles at every
m are compared by all of their shingles with the least hashes of the notice, as many as its size needs, so none is missed.

Shingles are compared by 64 bits of hash. Defined cases: null or empty texts have no windows. A template of fewer than five
words is one shingle of all of them. Repeated rows of an id count as one text each; their windows are reported
once. Rows with a null id are in no result. A very long text is one array of 8 bytes a word within its row. Columns other than id and
text play no part, whatever their names. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_side, written
from .decontamination import _positions, rows_of, sketches
from .license_texts import NOTICES, TEXTS
from .quality_rules import let
from .shingles import PERCENT, SHINGLE, shingle_hashes, word_hashes

TEMPLATES = NOTICES + TEXTS
SHORT, SPAN, BIN_BITS = 64, 3, 5


def bin_minima(hashes: Column) -> Column:
    """The least hash of each bin; bins are the values of the top BIN_BITS bits, so they follow each other in a sorted array."""
    top = lambda h: F.shiftright(h, 64 - BIN_BITS)
    return let(F.sort_array(hashes), lambda x: F.filter(x, lambda h, i: (i == 0) | (top(h) != top(F.get(x, i - 1)))))


def _bands(docs: DataFrame, lengths: list[int], classes: list[int], percent: int) -> DataFrame:
    """(doc_id, class, k, at, key), from one reading of each text: in class 0 every shingle of the lengths and its place, and in
    the others the bands of each block and its number."""
    entry = lambda c, k, at, key: F.struct(F.lit(c).alias("class"), F.lit(k).alias("k"), at.alias("at"), key.alias("key"))

    def whole(s: Column, k: int) -> Column:
        return F.transform(s, lambda x, i: entry(0, k, i, x))

    def blocks(s: Column, stride: int) -> Column:
        least = -(-percent * (stride + 1) // 100)  # shingles that a document with a template of the class has at least
        each = F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / stride).cast("int")), lambda i: F.transform(bin_minima(F.slice(s, i * stride + 1, F.lit(stride))), lambda x: entry(stride, SHINGLE, i, x)))
        return F.when(F.size(s) >= least, F.flatten(each)).otherwise(F.array().cast("array<struct<class:int,k:int,at:int,key:bigint>>"))

    def of(h: Column) -> Column:
        parts = [whole(shingle_hashes(h, k), k) for k in lengths if k != SHINGLE]
        full = let(shingle_hashes(h, SHINGLE), lambda s: F.concat(*([whole(s, SHINGLE)] if SHINGLE in lengths else []), *(blocks(s, c) for c in classes))) if classes or SHINGLE in lengths else None
        return F.concat(*parts, *([full] if full is not None else []))

    return docs.select("doc_id", F.explode(let(word_hashes(F.col("text")), of)).alias("e")).select("doc_id", "e.class", "e.k", "e.at", "e.key")


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, n_shingles, n_shared (in the best window), n_windows, first_word: for each template that a document holds."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    items = docs.sparkSession.createDataFrame(templates or TEMPLATES, "item_id string, text string")
    known = sketches(items, percent=percent)
    brief = F.col("n") <= SHORT
    stride = F.when(brief, F.col("n")).otherwise(F.pow(F.lit(2.0), F.col("part") - 1).cast("int"))
    known = written(known.withColumn("brief", brief).withColumn("stride", stride).withColumn("span", F.when(brief, 2).otherwise(SPAN)), "templates")
    lengths = sorted(r.k for r in known.where("brief").select("k").distinct().collect())  # 1 to 5
    classes = sorted(r.stride for r in known.where("not brief").select("stride").distinct().collect())  # powers of two
    sketched = F.when(F.col("brief"), F.col("keys")).otherwise(bin_minima(F.col("shingles")))
    keys = known.select("item_id", "k", F.when(F.col("brief"), 0).otherwise(F.col("stride")).alias("class"), "stride", "span", F.explode(sketched).alias("key"))

    def windows(hits: DataFrame, block: Column) -> DataFrame:
        """Each hit with the windows that its block is in."""
        return hits.withColumn("window", F.explode(F.sequence(F.greatest(block - F.col("span") + 1, F.lit(0)), block)))

    met = _bands(docs, lengths, classes, percent).join(small_side(keys), ["class", "k", "key"])
    block = F.when(F.col("class") == 0, F.floor(F.col("at") / F.col("stride")).cast("int")).otherwise(F.col("at"))
    found = written(windows(met, block).select("doc_id", "item_id", "window").distinct(), "windows")
    again = docs.join(small_side(found.select("doc_id").distinct()), "doc_id", "left_semi")
    whole = known.select("item_id", "k", "n", "stride", "span", F.explode("shingles").alias("shingle"))
    every = sorted({*lengths, *([SHINGLE] if classes else [])}) or [SHINGLE]
    hits = windows(_positions(rows_of(again), every).join(small_side(whole), ["k", "shingle"]), F.floor(F.col("pos") / F.col("stride")).cast("int"))
    hits = hits.select(F.col("doc_id").alias("row"), F.col("doc_id.doc_id").alias("doc_id"), "item_id", "window", "shingle", "n", "pos").join(small_side(found), ["doc_id", "item_id", "window"], "left_semi")
    held = hits.groupBy("row", "doc_id", "item_id", "window", "shingle").agg(F.max("n").alias("n"), F.min("pos").alias("pos"))
    held = held.groupBy("row", "doc_id", "item_id", "window").agg(F.max("n").alias("n"), F.count("*").alias("shared"), F.min("pos").alias("pos")).where(100 * F.col("shared") >= percent * F.col("n"))
    return held.groupBy("doc_id", F.col("item_id").alias("license")).agg(F.max("n").cast("long").alias("n_shingles"), F.max("shared").alias("n_shared"), F.count("*").alias("n_windows"), F.min("pos").cast("long").alias("first_word"))
