"""Rule-based reranking and score corrections. Rows are (query_id, id, energy, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lang
from ..functions import scores, text
from ..params import DEFAULT, Params


def about(queries: DataFrame) -> DataFrame:
    """queries (query_id, text) with what the boosts need to know of them, worked out once a query."""
    t = F.col("text")
    q = F.lower(t)
    corrects = text.contains_any(q, dict(lang.QUESTIONS)["Correction"]) | text.changes(q)
    return queries.select("query_id", t.alias("query"), text.question_type(t).alias("question"), corrects.alias("corrects"), F.lower(text.what_subject(t)).alias("subject"), text.keywords(t).alias("keywords"), text.entities(t).alias("query_entities"))


def boosted(energy: Column, *boosts: Column, p: Params = DEFAULT) -> Column:
    """Adds boosts one after another; each that is above 0 keeps the energy to the cap."""
    return F.aggregate(F.array(*boosts), energy.cast("double"), lambda e, b: F.when(b > 0, F.least(e + b, F.lit(p.energy_cap))).otherwise(e))


def why_boost(question: Column, content: Column) -> Column:
    return F.when(question == "Why", text.explanatory(content)).otherwise(0.0)


def type_boost(question: Column, corrects: Column, subject: Column, content: Column, content_type: Column) -> Column:
    """The first boost that matches the memory's content type."""
    on_topic = subject.isNull() | F.contains(F.lower(content), subject)
    return (
        F.when((question == "Correction") & (content_type == "Correction"), 0.12)
        .when((question == "Preference") & (content_type == "Preference"), 0.08)
        .when((question == "Preference") & (content_type == "Decision"), 0.04)
        .when((question == "Why") & content_type.isin("Decision", "TaskState"), 0.08)
        .when((question == "How") & (content_type == "TaskState"), 0.08)
        .when((question == "What") & (content_type == "ProjectKnowledge"), F.when(on_topic, 0.15).otherwise(0.0))
        .when((question != "Correction") & corrects & (content_type == "Correction"), 0.10)
        .otherwise(0.0)
    )


def keyword_boost(words: Column, content: Column) -> Column:
    """.04 for each keyword in the text, .08 at most."""
    low = F.lower(content)
    return F.least(F.lit(0.08), 0.04 * F.size(F.filter(words, lambda k: F.contains(low, F.lower(k)))))


def definition_boost(question: Column, subject: Column, content: Column) -> Column:
    low = F.lower(content)
    hit = F.exists(F.array(*map(F.lit, lang.DEFINITION)), lambda d: F.contains(low, F.concat(subject, F.lit(" "), d)))
    return F.when((question == "What") & subject.isNotNull() & hit, 0.05).otherwise(0.0)


def context_correction(energy: Column, strength: Column, p: Params = DEFAULT) -> Column:
    return energy * (1 + p.context_alpha * F.coalesce(strength, F.lit(0.0)))


def coverage_correction(energy: Column, query_entities: Column, memory_entities: Column, p: Params = DEFAULT) -> Column:
    n = F.size(query_entities)
    return F.when(n >= 2, energy * (1 + p.coverage_beta * F.size(F.array_intersect(query_entities, memory_entities)) / n)).otherwise(energy)


def context_strengths(features: DataFrame, links: DataFrame, now_ms: int | Column, p: Params = DEFAULT) -> DataFrame:
    """features (query_id, feature, and the column of now_ms if it is one) joined to context links: the largest remaining strength of each memory."""
    now = now_ms if isinstance(now_ms, Column) else F.lit(now_ms)
    rest = scores.forget(F.col("strength"), now - F.col("last_reviewed_at"), F.col("review_count"), p)
    return features.join(links, "feature").withColumn("rest", rest).groupBy("query_id", "memory_id").agg(F.max("rest").alias("strength"))


def warned(results: DataFrame, edges: DataFrame, lifecycle: Column | None = None) -> DataFrame:
    """results with warnings: low confidence, deprecated, one for each out-edge that corrects, contradicts or supersedes, stale."""
    kinds = ["Correction", "Contradiction", "Supersedes"]
    about = edges.where(F.col("link_type").isin(kinds)).select(F.col("src").alias("id"), F.struct(F.array_position(F.array(*map(F.lit, kinds)), F.col("link_type")).alias("o"), "dst", F.concat_ws(":", "link_type", F.col("dst").cast("string")).alias("w")).alias("e"))
    about = about.groupBy("id").agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["w"]).alias("about"))
    own = F.when(F.col("energy") < 0.20, F.lit("LowConfidence"))
    gone = F.when(lifecycle == "Deprecated", F.lit("Deprecated")) if lifecycle is not None else F.lit(None).cast("string")
    stale = F.when(F.col("energy") < 0.10, F.lit("StaleFreshness"))
    out = F.concat(F.array_compact(F.array(own, gone)), F.coalesce("about", F.array().cast("array<string>")), F.array_compact(F.array(stale)))
    return results.join(about, "id", "left").withColumn("warnings", out).drop("about")


def warnings(results: DataFrame, edges: DataFrame, lifecycle: Column | None = None) -> DataFrame:
    """(query_id, id, energy, warnings)."""
    return warned(results, edges, lifecycle).select("query_id", "id", "energy", "warnings")


def top_k(results: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("energy", 9)), F.asc("id"))
    return results.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def lexical_overlap(query: Column, content: Column) -> Column:
    return scores.jaccard(text.token_set(query), text.token_set(content))


def explanation(id_: Column, dimensions: Column, hops: Column, notes: Column) -> Column:
    """One sentence on why a memory was recalled."""
    said = F.when(F.size(notes) > 0, F.array_join(notes, ", ")).otherwise("none")
    return F.format_string("Memory %s was recalled via %d dimension(s) (%s), hops=%d. Warnings: %s.", id_.cast("string"), F.size(dimensions), F.array_join(dimensions, ", "), hops, said)


def matched_dimensions(trace: Column, channel: Column) -> Column:
    """Link types along the trace, then the seed's channel, each once."""
    return F.array_distinct(F.array_compact(F.concat(F.transform(trace, lambda s: s["link_type"]), F.array(channel))))
