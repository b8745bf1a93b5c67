"""Ranks within channels, deduplication, and reciprocal-rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import seed_energy
from ..params import DEFAULT, Params
from .channels import PUSH_ORDER


def push_order(col):
    return F.array_position(F.array(*map(F.lit, PUSH_ORDER)), col)


def ranked(seeds: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """The per_channel best of each channel with their 0-based rank."""
    w = Window.partitionBy("query_id", "channel").orderBy(F.desc("score"), F.asc("ord"))
    return seeds.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= p.per_channel).withColumn("rank", F.col("rank") - 1)


def deduped(seeds: DataFrame) -> DataFrame:
    """The best-ranked row of each id and channel."""
    w = Window.partitionBy("query_id", "channel", "id").orderBy("rank")
    return seeds.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def maxima(seeds: DataFrame) -> DataFrame:
    """The largest score of each channel."""
    return seeds.groupBy("query_id", "channel").agg(F.max("score").alias("score"))


def fuse(seeds: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(query_id, id, fused, channel): summed weight / (k + rank), or with k <= 0 the largest score; channel is the largest contributor."""
    weight = F.lit(1.0)
    for name, value in p.channel_weights.items():
        weight = F.when(F.col("channel") == name, value).otherwise(weight)
    part = weight / (p.rrf_k + F.coalesce("rank", F.lit(99))) if p.rrf_k > 0 else F.col("score")
    rows = seeds.withColumn("part", part)
    first = F.max_by("channel", F.struct(F.round("part", 12), F.col("score"), -push_order(F.col("channel"))))
    return rows.groupBy("query_id", "id").agg((F.sum if p.rrf_k > 0 else F.max)("part").alias("fused"), first.alias("channel"))


def energised(fused: DataFrame, importance: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(query_id, id, energy) of seeds that reach min_energy. importance: (id, importance)."""
    top = F.max("fused").over(Window.partitionBy("query_id"))
    norm = F.when(top > 0, F.col("fused") / top).otherwise(0.0)
    rows = fused.withColumn("norm", norm).join(importance, "id", "left")
    return rows.withColumn("energy", seed_energy(F.col("norm"), F.coalesce("importance", F.lit(0.0)), p)).where(F.col("energy") >= p.min_energy).select("query_id", "id", "channel", "fused", "energy")
