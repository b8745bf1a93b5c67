"""Retrieval quality. results: (query_id, id, rank from 1); relevant: (query_id, id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def evaluate(results: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """recall, precision, hit, reciprocal rank and NDCG at k of each query that has results or relevant ids."""
    rel = relevant.select("query_id", "id").distinct().withColumn("rel", F.lit(1))
    n_rel = rel.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    top = results.where(F.col("rank") <= k).join(rel, ["query_id", "id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    seen = top.groupBy("query_id").agg(F.count("*").alias("n_got"), F.sum("rel").alias("hits"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"), F.sum(F.col("rel") / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    rows = seen.join(n_rel, "query_id", "full").fillna(0, ["n_got", "hits", "dcg", "n_rel"])
    ideal = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(k)), lambda i: F.when((i > 0) & (i <= F.col("n_rel")), 1 / F.log2(i + 1.0)).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    return rows.select("query_id", F.when(F.col("n_rel") == 0, 1.0).otherwise(F.col("hits") / F.col("n_rel")).alias("recall"), (F.col("hits") / F.least(F.lit(k), F.greatest("n_got", F.lit(1)))).alias("precision"), (F.col("hits") > 0).cast("int").alias("hit"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"), F.when(F.col("n_rel") == 0, 0.0).otherwise(F.col("dcg") / ideal).alias("ndcg"))


def awareness(cases: DataFrame) -> DataFrame:
    """cases (query_id, expected_dimensions, dimensions, expected_warnings (a number), contradiction (whether one was named)):
    explanation accuracy, the share of expected dimensions that were hit, and contradiction awareness."""
    wanted = F.size("expected_dimensions")
    accuracy = F.when(wanted <= 0, 1.0).otherwise(F.size(F.filter("expected_dimensions", lambda x: F.array_contains("dimensions", x))) / wanted)
    aware = F.when(F.col("expected_warnings") == 0, 1.0).when(F.col("contradiction"), 1.0).otherwise(0.0)
    return cases.select("query_id", accuracy.alias("explanation_accuracy"), aware.alias("contradiction_awareness"))


def averages(scores: DataFrame) -> DataFrame:
    return scores.agg(*(F.avg(c).alias(c) for c in ("recall", "precision", "hit", "rr", "ndcg")))
