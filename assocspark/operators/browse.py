"""Listing, explaining, inspecting and dumping memories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import preview


def page(units: DataFrame, limit: int = 20, cursor=None, content_type: str | None = None) -> DataFrame:
    """Keyset pagination: ids downwards from below the cursor; limit is kept within 1 to 100."""
    rows = units.where(F.col("content_type") == content_type) if content_type else units
    rows = rows.where(F.col("id") < cursor) if cursor is not None else rows
    return rows.orderBy(F.desc("id")).limit(min(100, max(1, limit))).select("id", "content_type", preview(F.col("text")).alias("preview"))


def page_info(units: DataFrame, limit: int = 20, cursor=None, content_type: str | None = None) -> tuple[DataFrame, int | None, int]:
    """A page with the cursor of the next one (None: there is none) and the number of all memories of the type."""
    size = min(100, max(1, limit))
    rows = page(units, size, cursor, content_type)
    total = (units.where(F.col("content_type") == content_type) if content_type else units).count()
    last = rows.agg(F.min("id"), F.count("*")).first()
    more = last[1] == size and not page(units, 1, last[0], content_type).isEmpty()
    return rows, last[0] if more else None, total


def eligible(units: DataFrame) -> DataFrame:
    """Seeds are neither compressed nor made by consolidation."""
    return units.where(~((F.col("lifecycle") == "Compressed") | (F.col("generated_by") == "Consolidation")))


def explain(units: DataFrame, edges: DataFrame, activation: DataFrame | None = None) -> DataFrame:
    """Each memory with its out-links, what they correct or contradict, and if activation (memory_id, signal) is given, how often it was retrieved."""
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("link_type") == kind, F.col("dst"))))
    links = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_links"), of("Correction").alias("corrects"), of("Contradiction").alias("contradicts"))
    rows = units.join(links, "id", "left").select("id", preview(F.col("text"), 120).alias("summary"), "importance", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "corrects", "contradicts")
    if activation is None:
        return rows
    times = activation.where("signal = 'retrieve'").groupBy(F.col("memory_id").alias("id")).agg(F.count("*").alias("times"))
    return rows.join(times, "id", "left").withColumn("retrieval_count", F.coalesce("times", F.lit(0))).drop("times")


def stats(units: DataFrame, edges: DataFrame) -> DataFrame:
    return units.agg(F.count("*").alias("n_memories")).join(F.broadcast(edges.agg(F.count("*").alias("n_edges"), F.countDistinct("src").alias("n_sources"))))  # one row each


def unit_stats(units: DataFrame, edges: DataFrame) -> DataFrame:
    """How many memories of each stage there are, and how many links they have."""
    links = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("links"))
    return units.join(links, "id", "left").groupBy("stage").agg(F.count("*").alias("n_memories"), F.coalesce(F.sum("links"), F.lit(0)).alias("n_links"))


def posting_stats(postings: DataFrame) -> DataFrame:
    return postings.groupBy("dim").agg(F.count("*").alias("n"), F.countDistinct("key").alias("n_keys"))


def strongest_edges(edges: DataFrame, n: int) -> DataFrame:
    return edges.orderBy(F.desc(F.round("strength", 9)), "src", "dst", "link_type").limit(n)


def edge_view(edges: DataFrame) -> DataFrame:
    """Edges as they are shown: their ends, type, figures, and whether they are on observation or confirmed."""
    state = F.when(F.col("observing"), "Observing").otherwise("Confirmed")
    return edges.select("src", "dst", "link_type", "strength", "confidence", state.alias("state"), "last_activated_at", "activation_count")


def nodes(seen: DataFrame, units: DataFrame) -> DataFrame:
    """A traversal's nodes (id, depth) that are memories, with type and preview."""
    return seen.join(units.select("id", "content_type", preview(F.col("text")).alias("preview")), "id")


def in_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return edges.join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")


def json_lines(units: DataFrame) -> DataFrame:
    return units.select(F.to_json(F.struct(*units.columns)).alias("value"))
