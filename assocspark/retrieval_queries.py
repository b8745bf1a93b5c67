"""Queries of association, reranking and the whole retrieval, and SQL that says the same. Their models are those of the digest
backend, since any SQL engine has MD5."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import lang
from .functions import text
from .hooks import DIGEST
from .operators import association, channels, rerank
from .params import DEFAULT
from .plans import retrieve as plan
from .queries import BM25, ENTITY, MEM, NO_PATH, NOW, SIGNED, TOPIC, TRACE, _CTX, _NAMED, _TOP, _any, _first, _hop_sql, _label, _postings, _r, causal_sql, context_link_fold, digest_sql, memories, once, probes, query, question_sql, small, table
from .sources.warehouse import stored

# --- short texts with markers, made from the parts, and questions about them

TYPES = ["Correction", "Preference", "Decision", "TaskState", "ProjectKnowledge", "UserStatement", "Event"]
TAILS = [" plan to grow", "; we deploy it", " failed because the {} was late so we stopped", " was chosen due to the price", " means {}", ", I prefer {}", " is not used, therefore dropped", ""]
ASKED = [
    (1, "Why is the red bolt late?"),
    (2, "What is ring"),
    (3, "which widget do you prefer instead"),
    (4, "how to deploy the gear"),
    (5, "we plan to grow"),
    (6, "ring what is it"),
    (7, "Tell me about Brand#4, gRPC and redb"),
    (8, "changed my mind on the bolt"),
    (9, "x failed because the Brand#17 was late so we stopped"),
    (10, "之前 widget 后来 ring 的价格变化"),
    (11, "Why was it chosen? The Brand#2 widget, OOM or BM25"),
    (12, "gear"),
]
SAID = "said AS (SELECT p_partkey AS id, p_name || CASE p_partkey % 8 {} END AS text, [{}][p_partkey % 7 + 1] AS content_type FROM part)".format(
    " ".join(f"WHEN {i} THEN '{t}'".replace("{}", "' || p_brand || '") for i, t in enumerate(TAILS)),
    ", ".join(f"'{t}'" for t in TYPES),
)
ASK = "ask AS (SELECT * FROM (VALUES {}) t(query_id, text))".format(", ".join(f"({i}, '{t}')" for i, t in ASKED))


def said(spark, sf_dir):
    k = F.col("p_partkey")
    tail = F.lit("")
    for i, t in enumerate(TAILS):
        before, _, after = t.partition("{}")
        tail = F.when(k % 8 == i, F.concat(F.lit(before), *([F.col("p_brand"), F.lit(after)] if "{}" in t else []))).otherwise(tail)
    return table(spark, sf_dir, "part").select(k.alias("id"), F.concat("p_name", tail).alias("text"), F.element_at(F.array(*map(F.lit, TYPES)), (k % 7 + 1).cast("int")).alias("content_type"))


def asked(spark):
    return spark.createDataFrame(ASKED, "query_id int, text string")


_POINTS = r"[^\p{L}\p{N}]+"
_STOP = "[" + ", ".join(f"'{w}'" for w in sorted(set(lang.STOP))) + "]"
_WORDS = rf"list_filter(regexp_split_to_array(text, '{_POINTS}'), lambda w: ((strlen(w) >= 2 AND regexp_matches(w, '\p{{Lu}}')) OR regexp_matches(w, '^[A-Za-z]{{3,}}$')) AND NOT list_contains({_STOP}, lower(w)))"
_HAN = rf"list_filter(regexp_split_to_array(text, '[\s!-/:-@\[-`{{-~？]+'), lambda w: regexp_matches(w, '^[^\x{{0}}-\x{{2E80}}]{{2,}}$') AND NOT list_contains({_STOP}, w))"
_HEADS = " ".join(rf"WHEN contains(lower(text), '{d}') THEN regexp_split_to_array(trim(substr(text, 1, instr(lower(text), '{d}') - 1)), '\s+')[-1]" for d in lang.WHAT)
_CHANGED = " OR ".join(f"(contains(lower(text), '{x}') AND contains(lower(text), '{y}'))" for x, y in lang.CHANGE_PAIRS)


def about_sql(source: str) -> str:
    """What boosts need to know of a query."""
    subject = f"(SELECT CASE WHEN strlen(s) >= 2 THEN s END FROM (SELECT CASE WHEN strlen(s) >= 2 THEN string_split(s, '{lang.POSSESSIVE[0]}')[-1] END AS s FROM (SELECT CASE {_HEADS} END AS s)))"
    return f"""about AS (SELECT query_id, {question_sql('lower(text)')} AS question, {_any(dict(lang.QUESTIONS)['Correction'], 'lower(text)')} OR {_CHANGED} AS corrects,
        lower({subject}) AS subject, ({once('kw')})[1:5] AS kws, {once(_NAMED)} AS qe FROM (SELECT *, list_concat({_WORDS}, {_HAN}) AS kw FROM {source}))"""


WHY = "(CASE WHEN question = 'Why' THEN least(0.20, " + " + ".join(f"CASE WHEN contains(content, '{w}') THEN {v} ELSE 0 END" for w, v in lang.EXPLANATORY) + ") ELSE 0 END)"
TYPE = """(CASE WHEN question = 'Correction' AND content_type = 'Correction' THEN 0.12
    WHEN question = 'Preference' AND content_type = 'Preference' THEN 0.08 WHEN question = 'Preference' AND content_type = 'Decision' THEN 0.04
    WHEN question = 'Why' AND content_type IN ('Decision', 'TaskState') THEN 0.08 WHEN question = 'How' AND content_type = 'TaskState' THEN 0.08
    WHEN question = 'What' AND content_type = 'ProjectKnowledge' THEN CASE WHEN subject IS NULL OR contains(lower(content), subject) THEN 0.15 ELSE 0 END
    WHEN question <> 'Correction' AND corrects AND content_type = 'Correction' THEN 0.10 ELSE 0 END)"""
KEYWORD = "least(0.08, 0.04 * len(list_filter(kws, lambda k: contains(lower(content), lower(k)))))"
DEFINED = "(CASE WHEN question = 'What' AND subject IS NOT NULL AND (" + " OR ".join(f"contains(lower(content), subject || ' {d}')" for d in lang.DEFINITION) + ") THEN 0.05 ELSE 0 END)"


def boosted_sql(energy: str) -> str:
    for b in (WHY, TYPE, KEYWORD, DEFINED):
        energy = f"(CASE WHEN {b} > 0 THEN least({energy} + {b}, 1.0) ELSE {energy} END)"
    return energy


_ASKED = f"{SAID}, {ASK}, {about_sql('ask')}, pairs AS (SELECT query_id, id, question, corrects, subject, kws, said.text AS content, content_type FROM about, said)"


def _asked(spark, sf_dir):
    """Every question, a stated set, with every text."""
    return said(spark, sf_dir).withColumnRenamed("text", "content").join(small(rerank.about(asked(spark))))


def _boosts():
    c = {n: F.col(n) for n in ("question", "corrects", "subject", "keywords", "content", "content_type")}
    return {
        "why": rerank.why_boost(c["question"], c["content"]),
        "type": rerank.type_boost(c["question"], c["corrects"], c["subject"], c["content"], c["content_type"]),
        "keyword": rerank.keyword_boost(c["keywords"], c["content"]),
        "definition": rerank.definition_boost(c["question"], c["subject"], c["content"]),
    }


@query(f"WITH {ASK}, {about_sql('ask')} SELECT query_id, question, corrects, subject, array_to_string(kws, ' ') AS keywords FROM about")
def query_about(spark, sf_dir):
    return rerank.about(asked(spark)).select("query_id", "question", "corrects", "subject", F.array_join("keywords", " ").alias("keywords"))


@query(f"WITH {_ASKED} SELECT query_id, id, round({TYPE}, 6)::DOUBLE AS boost FROM pairs")
def type_boost(spark, sf_dir):
    return _asked(spark, sf_dir).select("query_id", "id", F.round(_boosts()["type"], 6).alias("boost"))


@query(f"WITH {_ASKED} SELECT query_id, id, round({KEYWORD}, 6)::DOUBLE AS boost FROM pairs")
def keyword_boost(spark, sf_dir):
    return _asked(spark, sf_dir).select("query_id", "id", F.round(_boosts()["keyword"], 6).alias("boost"))


@query(f"WITH {_ASKED} SELECT query_id, id, round({DEFINED}, 6)::DOUBLE AS boost FROM pairs")
def definition_boost(spark, sf_dir):
    return _asked(spark, sf_dir).select("query_id", "id", F.round(_boosts()["definition"], 6).alias("boost"))


@query(f"""WITH {MEM}, q AS (SELECT item_id AS query_id, text FROM benchmark WHERE text IS NOT NULL AND item_id % 20 = 0 UNION ALL SELECT -query_id, text FROM ({ASK.replace('ask AS (', '', 1)[:-1]}) UNION ALL SELECT 0 - 100, 'What is Onhe'),
    {about_sql('q')}, pairs AS (SELECT query_id, id, question, corrects, subject, kws, mem.text AS content, content_type FROM about, mem) SELECT query_id, id, round({boosted_sql('0.5')}, 6)::DOUBLE AS energy FROM pairs""")
def question_boosts(spark, sf_dir):
    """All boosts of every conversation turn for a stated set of queries: every twentieth benchmark text and the questions above."""
    asked_ = spark.createDataFrame([(-i, t) for i, t in ASKED] + [(-100, "What is Onhe")], "query_id long, text string")
    q = rerank.about(probes(spark, sf_dir).where("query_id % 20 = 0").union(asked_))
    rows = memories(spark, sf_dir).withColumnRenamed("text", "content").join(small(q))
    return rows.select("query_id", "id", F.round(rerank.boosted(F.lit(0.5), *_boosts().values()), 6).alias("energy"))


@query(f"WITH {_ASKED}, lx AS (SELECT query_id, id, list_distinct(list_filter(regexp_split_to_array(lower(a.text), '{text.BETWEEN}'), lambda x: x <> '')) AS x, list_distinct(list_filter(regexp_split_to_array(lower(s.text), '{text.BETWEEN}'), lambda x: x <> '')) AS y FROM ask a, said s) SELECT query_id, id, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE, 6) AS score FROM lx")
def lexical_rerank(spark, sf_dir):
    rows = said(spark, sf_dir).withColumnRenamed("text", "content").join(small(asked(spark)))
    return rows.select("query_id", "id", F.round(rerank.lexical_overlap(F.col("text"), F.col("content")), 6).alias("score"))


def _key_sql(dim: str) -> str:
    words = {"goal": _first(lang.GOAL), "event": _first(lang.EVENT)}.get(dim)

    def keys(of: str, name: str) -> str:
        if words:
            return f"SELECT {name}, {words} AS key FROM {of}"
        return f"SELECT {name}, c.cause || ' -> ' || c.effect AS key FROM (SELECT *, {causal_sql()} AS c FROM {of}) WHERE c IS NOT NULL"

    return f"WITH {SAID}, {ASK}, qk AS ({keys('ask', 'query_id')}), mk AS ({keys('said', 'id')}) SELECT query_id, id, 0.15::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY id) - 1 AS ord FROM qk JOIN mk USING (key) QUALIFY ord < 20"


def _key_channel(spark, sf_dir, dim: str, name: str):
    posting = association.postings(association.understand(said(spark, sf_dir).withColumn("created_at_ms", F.lit(NOW)), DIGEST))
    return channels.key_channel(channels.marked_keys(asked(spark), dim), posting, dim, name, 20).select("query_id", "id", "score", "ord")


@query(_key_sql("goal"))
def goal_channel(spark, sf_dir):
    return _key_channel(spark, sf_dir, "goal", "Goal")


@query(_key_sql("event"))
def event_channel(spark, sf_dir):
    return _key_channel(spark, sf_dir, "event", "Event")


@query(_key_sql("causal"))
def causal_channel(spark, sf_dir):
    return _key_channel(spark, sf_dir, "causal", "Causal")


@query(f"WITH {_CTX}, cs AS (SELECT query_id, memory_id, max(strength * pow(0.5, greatest({NOW} - at_ms, 0) / (86400000 * pow(2.0, least(rc, 6))))) AS s FROM qf JOIN cl USING (feature) GROUP BY query_id, memory_id) SELECT query_id, memory_id, round(0.5 * (1 + 0.5 * s), 4) AS energy FROM cs")
def context_correction(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("f"), (F.col("item_id") % 20).cast("string")).alias("feature"))
    known = rerank.context_strengths(q, context_link_fold(spark, sf_dir), NOW)
    return known.select("query_id", "memory_id", F.round(rerank.context_correction(F.lit(0.5), F.col("strength")), 4).alias("energy"))


@query("SELECT p_partkey AS id, format('Memory {} was recalled via {} dimension(s) ({}), hops={}. Warnings: {}.', p_partkey, p_partkey % 3, array_to_string(['Causal', 'Bm25'][1:(p_partkey % 3)::BIGINT], ', '), p_partkey % 4, CASE WHEN p_partkey % 2 = 0 THEN 'none' ELSE 'LowConfidence' END) AS summary FROM part")
def explanation_text(spark, sf_dir):
    k = F.col("p_partkey")
    dims = F.slice(F.array(F.lit("Causal"), F.lit("Bm25")), F.lit(1), (k % 3).cast("int"))
    notes = F.when(k % 2 == 1, F.array(F.lit("LowConfidence"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "part").select(k.alias("id"), rerank.explanation(k, dims, (k % 4).cast("int"), notes).alias("summary"))


# --- association

_BUCKETS = "['h:' || (created_at_ms // 3600000), 'd:' || (created_at_ms // 86400000), 'w:' || (created_at_ms // 604800000)]"
UNITS = f"""{MEM}, {SIGNED}, unit AS (SELECT mem.id, conversation_id, text, content_type, {once(_NAMED)} AS ent, {_TOP} AS top, list_filter([{_first(lang.GOAL)}], lambda x: x IS NOT NULL) AS goals,
        list_filter([{_first(lang.EVENT)}], lambda x: x IS NOT NULL) AS events, list_filter([CASE WHEN c IS NOT NULL THEN c.cause || ' -> ' || c.effect END], lambda x: x IS NOT NULL) AS causals,
        list_filter([{_label(lang.EMOTION)}], lambda x: x IS NOT NULL) AS emotions, {_BUCKETS} AS temporals, v, code, simhash,
        least(1.0, CASE WHEN length(text) > 200 THEN 0.7 WHEN length(text) > 50 THEN 0.5 ELSE 0.3 END + CASE WHEN content_type IN ('Decision', 'Preference') THEN 0.2 ELSE 0.0 END)::DOUBLE AS importance
    FROM (SELECT *, {causal_sql()} AS c FROM mem) mem JOIN signed USING (id))"""
_EACH = ("ent", "top", "temporals")
CAND = "post AS ({}), cand AS (SELECT DISTINCT a.id AS src, b.id AS dst FROM post a JOIN post b USING (dim, key) WHERE b.id < a.id)".format(" UNION ".join(f"SELECT '{c}' AS dim, unnest({c}) AS key, id FROM unit" for c in _EACH))


def _jaccard(c: str) -> str:
    return f"CASE WHEN len(list_concat(a.{c}, b.{c})) = 0 THEN 0 ELSE len(list_intersect(a.{c}, b.{c})) / len(list_distinct(list_concat(a.{c}, b.{c})))::DOUBLE END"


def _shared(c: str) -> str:
    return f"len(list_intersect(a.{c}, b.{c}))"


FEATURES = f"""{UNITS}, {CAND}, near AS (SELECT src, dst, (1 - bit_count(xor(a.simhash, b.simhash)) / 64.0)::DOUBLE AS lexical FROM cand JOIN unit a ON a.id = src JOIN unit b ON b.id = dst
        QUALIFY row_number() OVER (PARTITION BY src ORDER BY (1 - bit_count(xor(a.simhash, b.simhash)) / 64.0)::DOUBLE DESC, dst) <= 30),
    raw AS (SELECT src, dst, lexical, {_jaccard('ent')} AS entity_j, {_jaccard('top')} AS topic_j, {_jaccard('goals')} AS goal_j, {_jaccard('events')} AS event_j,
        {_shared('temporals')} AS temporal_n, {_shared('causals')} AS causal_n, {_shared('emotions')} AS emotion_n, a.importance AS importance,
        CASE WHEN a.conversation_id = b.conversation_id THEN 1.0 ELSE 0.0 END::DOUBLE AS co_context, CASE WHEN a.code = 0 OR b.code = 0 THEN 0 ELSE 1 - bit_count(xor(a.code, b.code)) / 64.0 END::DOUBLE AS bits_j
        FROM near JOIN unit a ON a.id = src JOIN unit b ON b.id = dst),
    feat AS (SELECT *, list_filter([CASE WHEN entity_j > 0 THEN 'Entity' END, CASE WHEN topic_j > 0 THEN 'Topic' END, CASE WHEN goal_j > 0 THEN 'Goal' END, CASE WHEN event_j > 0 THEN 'Event' END,
        CASE WHEN temporal_n > 0 THEN 'Temporal' END, CASE WHEN causal_n > 0 THEN 'Causal' END, CASE WHEN emotion_n > 0 THEN 'Emotion' END, CASE WHEN lexical > 0.7 THEN 'Semantic' END], lambda x: x IS NOT NULL) AS dims FROM raw)"""
SCORED = f"""{FEATURES}, scored AS (SELECT *, least(1.0, greatest(0.0, (0.20 * entity_j + 0.10 * topic_j + 0.12 * goal_j + 0.10 * event_j + 0.10 * least(1.0, temporal_n / greatest(len(dims), 1)) + 0.10 * least(1.0, causal_n / greatest(len(dims), 1))
        + 0.05 * least(1.0, emotion_n / greatest(len(dims), 1)) + 0.02 * importance + 0.03 * co_context + CASE WHEN len(dims) > 0 THEN 0.18 * lexical + 0.10 * bits_j ELSE 0 END
        + CASE WHEN len(dims) >= 3 THEN 0.15 ELSE 0 END)::DOUBLE)) AS score FROM feat)"""
_KIND = "CASE " + " ".join(f"WHEN list_contains(dims, '{d}') THEN '{t}'" for d, t in (("Causal", "Causal"), ("Entity", "EntityOverlap"), ("Temporal", "TemporalAdjacent"), ("Topic", "TopicRelated"), ("Goal", "SameGoal"), ("Event", "SameEvent"))) + " ELSE 'SemanticSimilar' END"
BUILT = f"{SCORED}, edge AS (SELECT src, dst, {_KIND} AS link_type, score AS strength, score AS confidence, round(score, 9) <= 0.55 AS observing FROM scored WHERE round(score, 9) >= 0.25)"


def _units(spark, sf_dir):
    return association.understand(memories(spark, sf_dir), DIGEST)


def _features(spark, sf_dir):
    units = stored(association.compared(_units(spark, sf_dir)))
    return association.pair_features(association.candidate_pairs(association.postings(units), units=units, best=DEFAULT.max_candidates), units)


@query(f"WITH {UNITS}, {CAND} SELECT src, dst FROM cand")
def candidate_pairs(spark, sf_dir):
    return association.candidate_pairs(_postings(spark, sf_dir))


@query(f"""WITH {FEATURES} SELECT src, dst, round(lexical, 6) AS lexical, round(entity_j, 6)::DOUBLE AS entity_j, round(topic_j, 6)::DOUBLE AS topic_j, round(goal_j, 6)::DOUBLE AS goal_j, round(event_j, 6)::DOUBLE AS event_j,
    temporal_n, causal_n, emotion_n, round(importance, 6) AS importance, co_context, round(bits_j, 6) AS "binary", array_to_string(dims, ',') AS dims FROM feat""")
def pair_features(spark, sf_dir):
    f = _features(spark, sf_dir)
    counts = [F.col(c).cast("long").alias(c) for c in ("temporal_n", "causal_n", "emotion_n")]
    return f.select("src", "dst", *(_r(c) for c in ("lexical", "entity_j", "topic_j", "goal_j", "event_j")), *counts, _r("importance"), F.col("co_context").cast("double").alias("co_context"), _r("binary"), F.array_join("dims", ",").alias("dims"))


@query(f"WITH {SCORED} SELECT src, dst, round(score, 9) AS score FROM scored")
def assoc_score(spark, sf_dir):
    return _features(spark, sf_dir).select("src", "dst", F.round(association.association_score(F.lit(1000)), 9).alias("score"))


@query(f"WITH {BUILT} SELECT src, dst, link_type, round(strength, 9) AS strength, observing FROM edge")
def edge_build(spark, sf_dir):
    return association.build_edges(_features(spark, sf_dir), F.lit(1000), NOW).select("src", "dst", "link_type", _r("strength", 9), "observing")


@query("""WITH c AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 > 0 THEN p_partkey // 4 END AS conversation_id, CASE WHEN p_partkey % 5 > 0 THEN p_partkey // 3 END AS session_id, CASE WHEN p_partkey % 7 > 0 THEN p_partkey // 10 END AS project_id, NULL::BIGINT AS task_id FROM part),
    n AS (SELECT a.id AS src, b.id AS dst, coalesce((a.conversation_id = b.conversation_id)::INT, 0) + coalesce((a.session_id = b.session_id)::INT, 0) + coalesce((a.project_id = b.project_id)::INT, 0) AS same,
        (coalesce(a.conversation_id, b.conversation_id) IS NOT NULL)::INT + (coalesce(a.session_id, b.session_id) IS NOT NULL)::INT + (coalesce(a.project_id, b.project_id) IS NOT NULL)::INT AS held FROM c a JOIN c b ON b.id = a.id + 1)
    SELECT src, dst, round(CASE WHEN held = 0 THEN 0 ELSE same / held END::DOUBLE, 6) AS ratio FROM n""")
def co_context_ratio(spark, sf_dir):
    k = F.col("p_partkey")
    some = lambda m, n: F.when(k % m > 0, F.floor(k / n))
    rows = table(spark, sf_dir, "part").select(k.alias("id"), some(3, 4).alias("conversation_id"), some(5, 3).alias("session_id"), some(7, 10).alias("project_id"), F.lit(None).cast("long").alias("task_id"))
    a, b = rows.select(F.col("id").alias("src"), F.struct(*rows.columns).alias("a")), rows.select(F.col("id").alias("dst"), (F.col("id") - 1).alias("src"), F.struct(*rows.columns).alias("b"))
    return a.join(b, "src").select("src", "dst", F.round(association.co_context("a", "b"), 6).alias("ratio"))


# --- the whole retrieval

ORDER = "[" + ", ".join(f"'{c}'" for c in channels.PUSH_ORDER) + "]"


def _recalled(name: str, channel: str, rows: str, order: str) -> str:
    return f"{name} AS (SELECT query_id, id, '{channel}' AS channel, score, row_number() OVER (PARTITION BY query_id ORDER BY {order}) - 1 AS ord FROM ({rows}))"


def _same_key(column: str, key: str) -> str:
    return f"SELECT query_id, unit.id, 0.15::DOUBLE AS score FROM (SELECT query_id, {key} AS key FROM (SELECT *, {causal_sql()} AS c FROM q)) qk JOIN unit ON list_contains(unit.{column}, qk.key)"


_NOW = "[('h:' || ((1700000000000 + query_id * 600000) // 3600000)), ('d:' || ((1700000000000 + query_id * 600000) // 86400000)), ('w:' || ((1700000000000 + query_id * 600000) // 604800000))]"
RECALL = ",\n    ".join(
    [
        BUILT,
        "q AS (SELECT item_id AS query_id, text FROM benchmark WHERE text IS NOT NULL)",
        f"qv AS (SELECT query_id, v, list_sum(list_transform(range(1, 33), lambda i: CASE WHEN v[i] > 0 THEN 1::BIGINT << (i - 1) ELSE 0 END))::BIGINT AS code FROM (SELECT query_id, {digest_sql()} AS v FROM q) WHERE len(list_filter(v, lambda x: x <> 0)) > 0)",
        BM25,
        ENTITY,
        TOPIC,
        _recalled("near_bits", "SemanticBinary", "SELECT query_id, id, (1 - bit_count(xor(qv.code, unit.code)) / 64.0)::DOUBLE AS score FROM qv, unit WHERE unit.code <> 0", "score DESC, id"),
        _recalled("same_time", "TemporalNeighbor", f"SELECT query_id, id, 0.3::DOUBLE AS score FROM (SELECT query_id, {_NOW} AS now FROM q) n JOIN unit ON list_has_any(unit.temporals, n.now)", "id"),
        _recalled("same_goal", "Goal", _same_key("goals", _first(lang.GOAL)), "id"),
        _recalled("same_event", "Event", _same_key("events", _first(lang.EVENT)), "id"),
        _recalled("same_cause", "Causal", _same_key("causals", "CASE WHEN c IS NOT NULL THEN c.cause || ' -> ' || c.effect END"), "id"),
        _recalled("near_vector", "SemanticDense", "SELECT query_id, id, d, 1 / (1 + d) AS score FROM (SELECT query_id, id, round(list_sum(list_transform(list_zip(qv.v, unit.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 9) AS d FROM qv, unit)", "d, id"),
        "s AS (" + " UNION ALL ".join(f"SELECT query_id, id, channel, score, ord FROM {n} WHERE ord < 20" for n in ("bm25", "entity", "topic", "near_bits", "same_time", "same_goal", "same_event", "same_cause", "near_vector")) + ")",
        "rk AS (SELECT *, row_number() OVER (PARTITION BY query_id, channel ORDER BY score DESC, ord) - 1 AS rank FROM s)",
        "dd AS (SELECT * FROM rk QUALIFY row_number() OVER (PARTITION BY query_id, channel, id ORDER BY rank) = 1)",
        "pt AS (SELECT *, (CASE WHEN channel IN ('TopicCluster', 'TemporalNeighbor') THEN 0.3 ELSE 1.0 END)::DOUBLE / (1 + rank) AS part FROM dd)",
        f"top AS (SELECT query_id, id, channel FROM pt QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY round(part, 12) DESC, score DESC, list_position({ORDER}, channel)) = 1)",
        "fu AS (SELECT query_id, id, sum(part) AS fused FROM pt GROUP BY query_id, id)",
    ]
)
SPREAD = ",\n    ".join(
    [
        RECALL,
        "en AS (SELECT query_id, id, fused, least(fused / max(fused) OVER (PARTITION BY query_id) * 0.4 * (1 + importance * 0.6), 1.0) AS energy FROM fu JOIN unit USING (id))",
        f"s0 AS (SELECT query_id, id, id AS seed, {NO_PATH} AS path, energy, row_number() OVER (PARTITION BY query_id ORDER BY round(fused, 9) DESC, id) AS ord FROM en WHERE energy >= 0.05)",
        "top6 AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(strength * confidence, 9) DESC, dst, link_type) AS er FROM edge QUALIFY er <= 6)",
        _hop_sql(1, "s0", "SELECT query_id, id FROM s0"),
        _hop_sql(2, "s1", "SELECT query_id, id FROM s0 UNION ALL SELECT query_id, id FROM s1"),
        "every AS (" + " UNION ALL ".join(f"SELECT query_id, id, seed, path, energy, {h} AS hop FROM s{h}" for h in range(3)) + ")",
        about_sql("q"),
    ]
)
RETRIEVED = f"""{SPREAD},
    boosted AS (SELECT query_id, id, seed, path, hop, qe, ent, {boosted_sql('energy')} AS energy FROM (SELECT every.*, question, corrects, subject, kws, qe, ent, text AS content, content_type FROM every JOIN about USING (query_id) JOIN unit USING (id))),
    covered AS (SELECT *, CASE WHEN len(qe) >= 2 THEN energy * (1 + 0.2 * len(list_intersect(qe, ent)) / len(qe)) ELSE energy END AS e FROM boosted),
    best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(e, 9) DESC, id) AS rank FROM covered QUALIFY rank <= 10)
    SELECT query_id, rank, id, round(e, 8) AS score, channel, hop, array_to_string({once("list_filter(list_append(list_transform(path, lambda s: s.t), channel), lambda x: x IS NOT NULL)")}, ',') AS dimensions, {TRACE} AS trace,
        array_to_string(list_filter([CASE WHEN e < 0.2 THEN 'LowConfidence' END, CASE WHEN e < 0.1 THEN 'StaleFreshness' END], lambda x: x IS NOT NULL), ',') AS warnings
    FROM best LEFT JOIN (SELECT top.* FROM top JOIN s0 USING (query_id, id)) USING (query_id, id)"""


@query(f"WITH {RETRIEVED}")
def retrieve_topk(spark, sf_dir):
    """The whole retrieval: conversations as memories with their edges, benchmark texts as queries, all channels."""
    units = stored(_units(spark, sf_dir))
    posting = stored(association.postings(units))
    e = stored(association.build_edges(association.pair_features(association.candidate_pairs(posting, units=units, best=DEFAULT.max_candidates), units), F.lit(1000), NOW))
    asked_ = probes(spark, sf_dir).withColumn("now_ms", F.lit(1700000000000) + F.col("query_id") * 600000)
    out = plan.retrieve(asked_, plan.derived(units, posting, e), NOW, 10, models=DIGEST)
    return out.select("query_id", "rank", "id", _r("score", 8), "channel", "hop", F.array_join("dimensions", ",").alias("dimensions"), "trace", F.array_join("warnings", ",").alias("warnings"))
