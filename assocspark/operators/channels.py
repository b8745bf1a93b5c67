"""Recall channels. Each returns (query_id, id, channel, score, ord); ord is the place in the channel's own order."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lang
from ..functions import text
from ..params import DEFAULT, Params

PUSH_ORDER = ["Bm25", "SemanticBinary", "EntityInverted", "TopicCluster", "TemporalNeighbor", "Goal", "Event", "Causal", "RecentActivation", "SemanticDense"]


#: Queries that one scan of the vectors is held against, and distances that a task computes at once.
QUERY_BLOCK, DISTANCES = 2_048, 1 << 22


def _seeds(df: DataFrame, channel: str, order: list[Column], k: int | None) -> DataFrame:
    df = df.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    df = df.where(F.col("n") <= k) if k else df  # compared as it is, so that Spark limits each task's rows before the shuffle
    return df.select("query_id", "id", F.lit(channel).alias("channel"), "score", (F.col("n") - 1).alias("ord"))


def entity_channel(queries: DataFrame, postings: DataFrame, k: int | None = None) -> DataFrame:
    """queries: (query_id, text); postings: (dim, key, id). The score grows with the query entities covered."""
    keys = queries.select("query_id", F.explode(text.entities(F.col("text"))).alias("key"))
    n = postings.where("dim = 'entity'").join(keys, "key").groupBy("query_id", "id").agg(F.countDistinct("key").alias("n"))
    n = n.withColumn("score", F.when(F.col("n") <= 1, 0.2).when(F.col("n") == 2, 0.35).otherwise(0.5))
    return _seeds(n, "EntityInverted", [F.desc("score"), F.asc("id")], k)


def topic_channel(queries: DataFrame, postings: DataFrame, k: int | None = None) -> DataFrame:
    """A memory is a row for every query topic that it has."""
    keys = queries.select("query_id", F.posexplode(text.topics(F.col("text"))).alias("pos", "key"))
    hits = postings.where("dim = 'topic'").select("key", "id").distinct().join(keys, "key").withColumn("score", F.lit(0.15))
    return _seeds(hits, "TopicCluster", [F.asc("pos"), F.asc("id")], k)


def temporal_channel(queries: DataFrame, postings: DataFrame, k: int | None = None) -> DataFrame:
    """queries: (query_id, now_ms)."""
    keys = queries.select("query_id", F.explode(temporal_keys(F.col("now_ms"))).alias("key"))
    hits = postings.where("dim = 'temporal'").join(keys, "key").select("query_id", "id").distinct().withColumn("score", F.lit(0.3))
    return _seeds(hits, "TemporalNeighbor", [F.asc("id")], k)


MARKED = (("goal", "Goal"), ("event", "Event"), ("causal", "Causal"))


def marked_keys(queries: DataFrame, dim: str) -> DataFrame:
    """(query_id, key): the goal, event or causal key of a query's text, the same as a memory with that text would have."""
    t = F.col("text")
    cause = text.causal(t)
    key = {"goal": text.first_marker(t, lang.GOAL), "event": text.first_marker(t, lang.EVENT), "causal": F.when(cause.isNotNull(), F.concat_ws(" -> ", cause["cause"], cause["effect"]))}[dim]
    return queries.select("query_id", key.alias("key")).where("key is not null")


def key_channel(queries: DataFrame, postings: DataFrame, dim: str, channel: str, k: int | None = None) -> DataFrame:
    """Goal, event and causal channels: queries (query_id, key)."""
    hits = postings.where(F.col("dim") == dim).join(queries.distinct(), "key").withColumn("score", F.lit(0.15))
    return _seeds(hits, channel, [F.asc("key"), F.asc("id")], k)


def temporal_keys(ms: Column) -> Column:
    """Hour, day and week of a time, tagged with the size of the bucket."""
    return F.array(*(F.concat(F.lit(f"{tag}:"), F.floor(ms / size).cast("string")) for tag, size in (("h", 3_600_000), ("d", 86_400_000), ("w", 604_800_000))))


def recent_channel(recent: DataFrame, edges: DataFrame, k: int | None = None) -> DataFrame:
    """recent: (query_id, id). The memories themselves, and the first eight neighbours of each."""
    own = recent.select("query_id", "id", F.lit(0.3).alias("e"))
    first = edges.withColumn("n", F.row_number().over(Window.partitionBy("src").orderBy("ord", "dst", "link_type"))).where("n <= 8")
    near = recent.withColumnRenamed("id", "src").join(first, "src").select("query_id", F.col("dst").alias("id"), F.lit(0.15).alias("e"))
    total = own.unionByName(near).groupBy("query_id", "id").agg(F.least(F.lit(1.0), F.sum("e")).alias("score"))
    return _seeds(total, "RecentActivation", [F.desc(F.round("score", 9)), F.asc("id")], k)


def full_text(memories: DataFrame) -> DataFrame:
    """(id, text) to (id, term, tf, dl): how often a memory has a term, and how many terms it has."""
    words = memories.select("id", text.segments(F.col("text")).alias("w")).where(F.size("w") > 0)
    return words.select("id", F.size("w").cast("long").alias("dl"), F.explode("w").alias("term")).groupBy("id", "dl", "term").agg(F.count("*").alias("tf")).select("id", "term", "tf", "dl")


def bm25_channel(queries: DataFrame, term: DataFrame, k: int | None = None, p: Params = DEFAULT) -> DataFrame:
    """The query's terms, each once, joined to the term table (store it: it is read three times); the corpus figures are one row."""
    words = queries.select("query_id", F.explode(F.array_distinct(text.segments(F.col("text")))).alias("term"))
    docs = term.groupBy("id").agg(F.first("dl").alias("dl"))
    stats = docs.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    df = term.join(words.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    hits = words.join(df, "term").join(term, "term").join(F.broadcast(stats))  # one row
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + p.bm25_k1 * (1 - p.bm25_b + p.bm25_b * F.col("dl") / F.col("avgdl"))
    total = hits.groupBy("query_id", "id").agg(F.sum(idf * F.col("tf") * (p.bm25_k1 + 1) / norm).alias("raw")).withColumn("raw", F.round("raw", 9))
    return _seeds(total.withColumn("score", F.tanh(F.col("raw") / p.bm25_norm)), "Bm25", [F.desc("raw"), F.asc("id")], k)


def _blocks(queries: DataFrame):
    """The queries (query_id, q) in blocks of about QUERY_BLOCK, so that what the driver holds and tasks get is bounded."""
    n = max(1, -(-queries.count() // QUERY_BLOCK))
    for i in range(n):
        part = queries if n == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i)
        rows = part.where("q is not null").collect()
        yield [r.query_id for r in rows], [r.q for r in rows]


def _nearest(queries: DataFrame, rows: DataFrame, k: int | None, load, distances, exact) -> DataFrame:
    """(query_id, id, d): for each query, of each batch of rows (id, value) the k nearest, all ties with the last included."""
    spark, kind, key = rows.sparkSession, queries.schema["query_id"].dataType, rows.schema["id"].dataType
    out = None
    for names, values in _blocks(queries):
        if not names:
            continue
        known = spark.sparkContext.broadcast((names, load(values)))  # QUERY_BLOCK queries

        def run(batches):
            names, q = known.value
            step = max(1, DISTANCES // max(1, len(names)))
            for batch in batches:
                ids, v = batch.column(0), load(batch.column(1).to_pylist())
                for at in range(0, len(v), step):
                    part = v[at : at + step]
                    d = distances(q, part)
                    if k and k < len(part):
                        limit = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
                        i, j = np.nonzero(d <= limit + 1e-9 * (1 + np.abs(limit)))
                    else:
                        i, j = np.indices(d.shape).reshape(2, -1)
                    yield pa.RecordBatch.from_arrays([pa.array([names[x] for x in i]), ids.take(pa.array(j + at)), pa.array(exact(q, part, i, j), pa.float64())], ["query_id", "id", "d"])

        found = rows.mapInArrow(run, f"query_id {kind.simpleString()}, id {key.simpleString()}, d double")
        out = found if out is None else out.union(found)
    if out is None:
        out = spark.createDataFrame([], f"query_id {kind.simpleString()}, id {key.simpleString()}, d double")
    return out


def dense_channel(queries: DataFrame, vectors: DataFrame, k: int | None = None) -> DataFrame:
    """queries: (query_id, q); vectors: (id, embedding). Exact: every query is held against all vectors, in blocks of matrix products."""

    def load(values):
        return np.array(values, float).reshape(len(values), -1)

    def distances(q, v):
        if not len(v):
            return np.zeros((len(q), 0))
        return (q * q).sum(axis=1)[:, None] + (v * v).sum(axis=1)[None] - 2 * q @ v.T

    def exact(q, v, i, j):
        return np.array([((q[a] - v[b]) ** 2).sum() for a, b in zip(i, j, strict=True)])

    d = _nearest(queries.select("query_id", "q"), vectors.select("id", "embedding").where("embedding is not null"), k, load, distances, exact).withColumn("d", F.round("d", 9))
    return _seeds(d.withColumn("score", 1 / (1 + F.col("d"))), "SemanticDense", [F.asc("d"), F.asc("id")], k)


def binary_channel(queries: DataFrame, codes: DataFrame, k: int | None = None, bits: int = 64) -> DataFrame:
    """queries: (query_id, q); codes: (id, code). Exact, by bit counts in blocks."""

    def load(values):
        return np.array(values, np.int64).view(np.uint64)

    def distances(q, v):
        return np.bitwise_count(q[:, None] ^ v[None, :]).astype(float)

    def exact(q, v, i, j):
        return np.bitwise_count(q[i] ^ v[j]).astype(float)

    h = _nearest(queries.select("query_id", "q"), codes.select("id", "code").where("code is not null"), k, load, distances, exact)
    return _seeds(h.withColumn("score", F.greatest(F.lit(0.0), 1 - F.col("d") / bits)), "SemanticBinary", [F.asc("d"), F.asc("id")], k)


def union_channels(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def contributions(seeds: DataFrame) -> DataFrame:
    return seeds.groupBy("query_id", "channel").agg(F.count("*").alias("n"))
