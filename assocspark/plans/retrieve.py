"""The whole retrieval of a batch of queries."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores, text
from ..hooks import HASH, Models
from ..operators import browse, channels, fusion, rerank, spreading
from ..params import DEFAULT, Params
from ..sources.warehouse import first_by_id, stored

#: What the retrieval modes change: hops, fan-out and per-channel seeds.
MODES = {"Fast": {"max_hops": 1, "fan_out": 5, "per_channel": 10}, "Balanced": {}, "Deep": {"max_hops": 3, "fan_out": 20}, "Explore": {"max_hops": 3}}


def with_mode(mode: str, p: Params = DEFAULT) -> Params:
    return replace(p, **MODES[mode])


@dataclass(frozen=True)
class Tables:
    """What a retrieval reads, as stored tables: units, postings, edges, terms (full text), vectors (id, embedding, code) and
    context links, if there are any."""

    unit: DataFrame
    posting: DataFrame
    edge: DataFrame
    term: DataFrame
    vector: DataFrame
    link: DataFrame | None = None


def derived(units: DataFrame, postings: DataFrame, edges: DataFrame) -> Tables:
    """Tables of units that have their vectors."""
    return Tables(units.drop("embedding"), postings, edges, stored(channels.full_text(units)), units.select("id", "embedding", "code"))


def features(queries: DataFrame) -> DataFrame:
    """(query_id, feature): the entities and topics of a query's text, which context links know it by."""
    t = F.col("text")
    named = lambda kind, c: F.transform(c, lambda x: F.concat(F.lit(f"{kind}:"), x))
    return queries.select("query_id", F.explode(F.array_distinct(F.concat(named("entity", text.entities(t)), named("topic", text.topics(t))))).alias("feature"))


def understood(queries: DataFrame, models: Models = HASH) -> DataFrame:
    """queries (query_id, text, now_ms) with the vector and code of the text; none if it has no token."""
    v = models.embed(F.col("text"))
    rows = queries.select("query_id", "text", "now_ms", v.alias("v")).withColumn("v", F.when(F.exists("v", lambda x: x != 0), F.col("v")))
    return stored(rows.withColumn("code", scores.sign_code(F.col("v"))))


def recall(queries: DataFrame, t: Tables, p: Params = DEFAULT, models: Models = HASH, recent: DataFrame | None = None) -> DataFrame:
    """Seeds of all ten channels, ranked and deduplicated. queries: as understood() returns them; recent: (query_id, id)."""
    k, some = p.per_channel, queries.where("v is not null")
    parts = [
        channels.bm25_channel(queries, t.term, k, p),
        models.binary(some.select("query_id", F.col("code").alias("q")), t.vector.where("code <> 0").select("id", "code"), k),
        channels.entity_channel(queries, t.posting, k),
        channels.topic_channel(queries, t.posting, k),
        channels.temporal_channel(queries, t.posting, k),
        *(channels.key_channel(channels.marked_keys(queries, dim), t.posting, dim, name, k) for dim, name in channels.MARKED),
        models.dense(some.select("query_id", F.col("v").alias("q")), t.vector.select("id", "embedding"), k),
    ]
    if recent is not None:
        parts.append(channels.recent_channel(recent, t.edge, k))
    return fusion.deduped(fusion.ranked(channels.union_channels(parts), p))


def fallback(queries: DataFrame, fused: DataFrame, units: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Seeds of queries that have none: the first memories by id, as if recently active."""
    bare = queries.select("query_id").join(fused.select("query_id").distinct(), "query_id", "left_anti")
    first = first_by_id(units.select("id"), p.fallback)  # a stated number of rows
    return fused.unionByName(bare.join(F.broadcast(first)).select("query_id", "id", F.lit(0.3).alias("fused"), F.lit("RecentActivation").alias("channel")))


def retrieve(queries: DataFrame, t: Tables, now_ms: int, top_k: int = 10, p: Params = DEFAULT, *, models: Models = HASH, recent: DataFrame | None = None) -> DataFrame:
    """queries (query_id, text, and now_ms if it isn't the same for all). Returns (query_id, rank, id, score, channel, hop,
    dimensions, path (of steps), trace (as text), warnings)."""
    if "now_ms" not in queries.columns:
        queries = queries.withColumn("now_ms", F.lit(now_ms).cast("long"))
    asked, units = understood(queries, models), t.unit
    fused = fusion.fuse(recall(asked, t, p, models, recent), p)
    live = units
    if "lifecycle" in units.columns:
        live = browse.eligible(units)
        fused = fused.join(units.join(live, "id", "left_anti").select("id"), "id", "left_anti")
    fused = fallback(asked, stored(fused.select("query_id", "id", "fused", "channel")), live, p)
    seeds = stored(fusion.energised(fused, units.select("id", "importance"), p))
    reached = spreading.spread(seeds, t.edge, p)
    rows = reached.join(seeds.select("query_id", "id", "channel"), ["query_id", "id"], "left")
    kept = [c for c in ("lifecycle",) if c in units.columns]
    rows = rows.join(units.select("id", F.col("text").alias("content"), "content_type", "entities", *kept), "id").join(rerank.about(asked), "query_id")
    question, content, subject = F.col("question"), F.col("content"), F.col("subject")
    boosts = [rerank.why_boost(question, content), rerank.type_boost(question, F.col("corrects"), subject, content, F.col("content_type")), rerank.keyword_boost(F.col("keywords"), content), rerank.definition_boost(question, subject, content)]
    if models.rerank is not None:
        boosts.append(models.rerank(F.col("query"), content))
    rows = rows.withColumn("energy", rerank.boosted(F.col("energy"), *boosts, p=p))
    if "lifecycle" in units.columns:
        rows = rows.where("lifecycle <> 'Compressed'")
    if t.link is not None:
        known = rerank.context_strengths(features(asked).join(asked.select("query_id", "now_ms"), "query_id"), t.link, F.col("now_ms"), p)
        rows = rows.join(known.select("query_id", F.col("memory_id").alias("id"), F.col("strength").alias("context")), ["query_id", "id"], "left")
        rows = rows.withColumn("energy", rerank.context_correction(F.col("energy"), F.col("context"), p))
    rows = rows.withColumn("energy", rerank.coverage_correction(F.col("energy"), F.col("query_entities"), F.col("entities"), p))
    best = rerank.top_k(rows, top_k)
    best = rerank.warned(best, t.edge, F.col("lifecycle") if kept else None)
    return best.select("query_id", "rank", "id", F.col("energy").alias("score"), "channel", "hop", rerank.matched_dimensions(F.col("trace"), F.col("channel")).alias("dimensions"), F.col("trace").alias("path"), spreading.trace_text(F.col("trace")).alias("trace"), "warnings")
