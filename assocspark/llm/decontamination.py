"""Benchmark items inside documents: a size-partitioned MinHash containment search.

Items are partitioned by their number of shingles. An item's sketch are its least shingle hashes,
as many as the largest set of its partition needs so that a document holding `percent` of the item
must hold one of them: the search misses nothing. Only documents with at least `percent` of the shingles of a partition's
smallest item are looked up in that partition. A long document would outnumber a short item in
any sketch of its own, so documents are not sketched; every shingle of every document is looked up
in the sketches. These are broadcast if they are few; otherwise each partition's keys are a bitmap first, and only what
passes it is shuffled. The documents found are read again and each pair is verified by exact containment of the item's shingles.

Shingles are compared by 64 bits of hash. Defined cases: null or empty texts and items have no shingles and are in no pair. An item of fewer
than five words is one shingle of all of them. Repeated rows of an id, or rows that share one, count as one text each; a pair
is returned once, with the largest containment. Rows and items with a null id are in no pair. A very long text is
one array of 8 bytes a word within its row. Columns other than id and text play no part, whatever their names. Empty tables give an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, small_side, written
from .shingles import PERCENT, SHINGLE, bitmap, item_shingles, minima, shingle_hashes, size_class, word_hashes


def rows_of(docs: DataFrame) -> DataFrame:
    """docs with doc_id made a struct of the id and a hash of the text, so that rows which share an id stay apart unless their texts are equal."""
    return docs.select(F.struct("doc_id", F.xxhash64("text").alias("t")).alias("doc_id"), "text")


def _positions(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """(doc_id, k, size, pos, shingle) for every shingle of the lengths asked for; size is how many of them the row has."""
    hashed = docs.select("doc_id", word_hashes(F.col("text")).alias("h"))
    size = F.size("h") - F.col("k") + 1
    if len(lengths) == 1:
        return hashed.select("doc_id", F.lit(lengths[0]).alias("k"), "h").select("doc_id", "k", size.alias("size"), F.posexplode(shingle_hashes(F.col("h"), lengths[0])).alias("pos", "shingle"))
    parts = F.array(*(F.struct(F.lit(k).alias("k"), (F.size("h") - k + 1).alias("size"), shingle_hashes(F.col("h"), k).alias("s")) for k in lengths))
    return hashed.select("doc_id", F.explode(parts).alias("p")).select("doc_id", F.col("p.k").alias("k"), F.col("p.size").alias("size"), F.posexplode("p.s").alias("pos", "shingle"))


def _looked_up(docs: DataFrame, keys: DataFrame, lengths: list[int], percent: int) -> DataFrame:
    """(doc_id, item_id) of documents that hold a key (item_id, k, part, shingle) and are large enough for its partition."""
    rows = _positions(docs, lengths).select("doc_id", "k", "size", "shingle")
    # a set of partition c has more than 2 ** (c - 1) shingles
    enough = lambda part: 100 * F.col("size") >= percent * (F.floor(F.pow(F.lit(2.0), part - 1)) + 1)
    if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(keys), ["k", "shingle"]).where(enough(F.col("part"))).select("doc_id", "item_id")
    test = F.lit(False)
    for part in sorted(r.part for r in keys.select("part").distinct().collect()):  # as many as an item's size has bits
        test = test | (enough(F.lit(part)) & bitmap(keys.where(F.col("part") == part)))
    return rows.where(test).join(keys, ["k", "shingle"]).where(enough(F.col("part"))).select("doc_id", "item_id")


def sketches(items: DataFrame, id_col: str = "item_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """item_id, k, shingles (its set), n, part (size partition), keys (its sketch)."""
    sets = items.select(F.col(id_col).alias("item_id"), item_shingles(F.col(text_col)).alias("s")).select("item_id", "s.k", "s.shingles").where(F.size("shingles") > 0)
    return sets.select("item_id", "k", "shingles", F.size("shingles").alias("n"), size_class(F.size("shingles")).alias("part"), minima(F.col("shingles"), percent).alias("keys"))


def find_items(docs: DataFrame, items: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Pairs doc_id, item_id, n_shingles, n_shared of documents that hold at least percent of an item's shingles."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    items = items.where(F.col(item_id_col).isNotNull())
    known = written(sketches(items, item_id_col, item_text_col, percent), "items")
    lengths = sorted(r.k for r in known.select("k").distinct().collect()) or [SHINGLE]  # 1 to 5
    keys = known.select("item_id", "k", "part", F.explode("keys").alias("shingle"))
    pairs = written(_looked_up(docs, keys, lengths, percent).distinct(), "candidates")
    again = docs.join(small_side(pairs.select("doc_id").distinct()), "doc_id", "left_semi")
    whole = known.select("item_id", "k", "n", F.explode("shingles").alias("shingle"))
    shared = _positions(rows_of(again), lengths).select("doc_id", "k", "shingle").distinct().join(small_side(whole), ["k", "shingle"])
    shared = shared.select(F.col("doc_id").alias("row"), F.col("doc_id.doc_id").alias("doc_id"), "item_id", "n").join(small_side(pairs), ["doc_id", "item_id"], "left_semi")
    counted = shared.groupBy("row", "doc_id", "item_id").agg(F.max("n").cast("long").alias("n_shingles"), F.count("*").alias("n_shared"))
    counted = counted.where(100 * F.col("n_shared") >= percent * F.col("n_shingles"))
    return counted.groupBy("doc_id", "item_id").agg(F.max("n_shingles").alias("n_shingles"), F.max("n_shared").alias("n_shared"))
