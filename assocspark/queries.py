"""Queries over the tables of a folder, and SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lang
from .functions import scores, signatures, text
from .hooks import DIGEST
from .operators import association, browse, channels, fusion, learning, metrics, rerank, spreading, summaries
from .params import DEFAULT, TYPE_MODIFIER
from .sources.warehouse import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
NOW = 1_706_745_600_000  # 2024-02-01


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# --- shared inputs, in both languages

BETWEEN = text.BETWEEN
_TOK = rf"list_filter(regexp_split_to_array(lower(text), '{BETWEEN}'), lambda x: x <> '')"
_TYPES = "(CASE role WHEN 'user' THEN 'UserStatement' WHEN 'assistant' THEN 'ProjectKnowledge' ELSE 'Decision' END)"
MEM = f"mem AS (SELECT conv_id * 1000 + turn AS id, conv_id AS conversation_id, turn, text, {_TYPES} AS content_type, 1700000000000 + conv_id * 600000 + turn * 60000 AS created_at_ms FROM conversations WHERE text IS NOT NULL)"
_TRIMMED = r"list_transform(regexp_split_to_array(text, '\s+'), lambda x: regexp_replace(x, '^[^\p{L}\p{N}_-]+|[^\p{L}\p{N}_-]+$', '', 'g'))"
_NAMED = f"list_transform(list_filter({_TRIMMED}, lambda x: strlen(x) >= 2 AND regexp_matches(x, '^[A-Z]')), lambda x: lower(x))"
_ENT = f"list_distinct({_NAMED})"


def once(values: str) -> str:
    """SQL for a list without later repeats, in its order."""
    return f"list_filter({values}, lambda x, i: list_position({values}, x) = i)"


_TOP = f"list_filter({_TOK}, lambda x: strlen(x) >= 2)[1:5]"


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("role") == "user", "UserStatement").when(F.col("role") == "assistant", "ProjectKnowledge").otherwise("Decision")
    return table(spark, sf_dir, "conversations").where("text is not null").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("conversation_id"), "turn", "text", kind.alias("content_type"), (F.lit(1700000000000) + F.col("conv_id") * 600000 + F.col("turn") * 60000).alias("created_at_ms"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("id"), "text", "lang", "source")


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").where("text is not null").select(F.col("item_id").alias("query_id"), "text")


EDGE = """pairs AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey),
    edge AS (SELECT src, dst, list_extract([{}], ((src + dst) % 14 + 1)::BIGINT) AS link_type, 0.3 + ((src * 7 + dst * 13) % 70) / 100.0::DOUBLE AS strength, 0.5 + ((src * 3 + dst * 5) % 50) / 100.0::DOUBLE AS confidence, (src + dst) % 3 = 0 AS observing, 1704067200000 + ((src * 31 + dst) % 30) * 86400000 AS last_activated_at, (src + 2 * dst) % 8 AS activation_count FROM pairs)""".format(", ".join(f"'{t}'" for t in TYPE_MODIFIER))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts bought together, with figures made from their keys."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    p = li.withColumnRenamed("l_partkey", "src").join(li.withColumnRenamed("l_partkey", "dst"), "l_orderkey").where("src <> dst").select("src", "dst").distinct()
    s, d = F.col("src"), F.col("dst")
    kind = F.element_at(F.array(*map(F.lit, TYPE_MODIFIER)), ((s + d) % 14 + 1).cast("int"))
    return p.select("src", "dst", kind.alias("link_type"), (0.3 + (s * 7 + d * 13) % 70 / 100.0).alias("strength"), (0.5 + (s * 3 + d * 5) % 50 / 100.0).alias("confidence"), ((s + d) % 3 == 0).alias("observing"), (1704067200000 + (s * 31 + d) % 30 * 86400000).alias("last_activated_at"), ((s + 2 * d) % 8).alias("activation_count"))


SEED = """seed AS (SELECT p_partkey // 20 % 10 AS query_id, p_partkey AS id, 1.0::DOUBLE / (1 + p_partkey % 7) AS fused, (p_partkey % 11) / 10.0::DOUBLE AS importance
    FROM part WHERE p_partkey % 20 = 0)"""


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth part as a seed of one of ten queries."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").where("p_partkey % 20 = 0").select((F.floor(k / 20) % 10).alias("query_id"), k.alias("id"), (1.0 / (1 + k % 7)).alias("fused"), (k % 11 / 10.0).alias("importance"), F.lit("Bm25").alias("channel"))


_SIGNAL = "(CASE event_type WHEN 'purchase' THEN 'UserConfirmedCorrect' WHEN 'click' THEN 'Referenced' WHEN 'signup' THEN 'TaskSucceeded' WHEN 'error' THEN 'UserRejected' ELSE 'retrieve' END)"
LOG = f"log AS (SELECT event_id, user_id AS memory_id, epoch_us(ts) // 1000 AS ts_ms, {_SIGNAL} AS signal FROM events)"


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    signal = F.when(kind == "purchase", "UserConfirmedCorrect").when(kind == "click", "Referenced").when(kind == "signup", "TaskSucceeded").when(kind == "error", "UserRejected").otherwise("retrieve")
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("memory_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), signal.alias("signal"))


def small(df: DataFrame, limit: int = 10_000) -> DataFrame:
    """A stated query set as a broadcast side: more than limit rows are an error."""
    if df.limit(limit + 1).count() > limit:
        raise ValueError(f"a query set of more than {limit} rows; hold it against the table in blocks")
    return F.broadcast(df)


def _r(c: str, n: int = 6):
    return F.round(c, n).alias(c)


# --- text functions


@query(f"SELECT doc_id, len({_TOK})::BIGINT AS n_tokens, len(list_distinct({_TOK}))::BIGINT AS n_distinct FROM documents WHERE text IS NOT NULL")
def tok_counts(spark, sf_dir):
    t = text.tokens(F.col("text"))
    return documents(spark, sf_dir).select(F.col("id").alias("doc_id"), F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


@query(f"SELECT doc_id, array_to_string({_TOP}, ' ') AS topics FROM documents WHERE text IS NOT NULL")
def topic_top5(spark, sf_dir):
    return documents(spark, sf_dir).select(F.col("id").alias("doc_id"), F.array_join(text.topics(F.col("text")), " ").alias("topics"))


@query(f"WITH {MEM} SELECT id, unnest({_ENT}) AS entity FROM mem")
def entity_mentions(spark, sf_dir):
    return memories(spark, sf_dir).select("id", F.explode(text.entities(F.col("text"))).alias("entity"))


@query(f"WITH {MEM} SELECT id, round(least(1.0, CASE WHEN length(text) > 200 THEN 0.7 WHEN length(text) > 50 THEN 0.5 ELSE 0.3 END + CASE WHEN content_type IN ('Decision', 'Preference') THEN 0.2 ELSE 0.0 END)::DOUBLE, 6) AS importance FROM mem")
def importance_heuristic(spark, sf_dir):
    return memories(spark, sf_dir).select("id", F.round(text.importance(F.col("text"), F.col("content_type")), 6).alias("importance"))


def _any(words: list[str], col: str = "q") -> str:
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


def question_sql(q: str) -> str:
    changed = " OR ".join(f"contains({q}, '{x}') AND contains({q}, '{y}')" for x, y in lang.CHANGE_PAIRS)
    return f"CASE WHEN {changed} THEN 'Correction' " + " ".join(f"WHEN {_any(words, q)} THEN '{n}'" for n, words in lang.QUESTIONS) + " ELSE 'None' END"


@query(f"WITH {MEM}, low AS (SELECT id, lower(text) AS q FROM mem) SELECT id, {question_sql('q')} AS question FROM low")
def question_type(spark, sf_dir):
    return memories(spark, sf_dir).select("id", text.question_type(F.col("text")).alias("question"))


_first = lambda words: "CASE " + " ".join(f"WHEN contains(text, '{w}') THEN '{w}'" for w in words) + " END"
_label = lambda pairs: "CASE " + " ".join(f"WHEN contains(text, '{w}') THEN '{v}'" for w, v in pairs) + " END"


@query(f"SELECT doc_id, {_first(lang.GOAL)} AS goal, {_first(lang.DECISION)} AS decision, {_label(lang.PREFERENCE)} AS preference, {_label(lang.EMOTION)} AS emotion FROM documents WHERE text IS NOT NULL")
def marker_extract(spark, sf_dir):
    t = F.col("text")
    return documents(spark, sf_dir).select(F.col("id").alias("doc_id"), text.first_marker(t, lang.GOAL).alias("goal"), text.first_marker(t, lang.DECISION).alias("decision"), text.first_label(t, lang.PREFERENCE).alias("preference"), text.first_label(t, lang.EMOTION).alias("emotion"))


def causal_sql(text: str = "text") -> str:
    """A struct of cause and effect, or null."""
    parts = []
    for a, b in lang.CAUSAL:
        tail = f"substr({text}, instr(lower({text}), '{a}') + {len(a)})"
        at = f"instr(lower({tail}), '{b}')"
        pair = f"{{'cause': trim(substr(substr({tail}, 1, {at} - 1), 1, 80)), 'effect': trim(substr(substr({tail}, {at} + {len(b)}), 1, 80))}}"
        parts.append(f"WHEN instr(lower({text}), '{a}') > 0 AND {at} > 0 THEN {pair}")
    return f"CASE {' '.join(parts)} END"


@query(f"SELECT doc_id, c.cause AS cause, c.effect AS effect FROM (SELECT doc_id, {causal_sql()} AS c FROM documents WHERE text IS NOT NULL) WHERE c IS NOT NULL")
def causal_pairs(spark, sf_dir):
    c = text.causal(F.col("text"))
    return documents(spark, sf_dir).select(F.col("id").alias("doc_id"), c["cause"].alias("cause"), c["effect"].alias("effect")).where("cause is not null")


@query(f"WITH {MEM} SELECT id, substr(text, 1, 100) AS p100, substr(text, 1, 120) AS p120 FROM mem")
def preview_list(spark, sf_dir):
    return memories(spark, sf_dir).select("id", text.preview(F.col("text"), 100).alias("p100"), text.preview(F.col("text"), 120).alias("p120"))


@query(f"WITH {MEM} SELECT id, round(least(0.20, " + " + ".join(f"CASE WHEN contains(text, '{w}') THEN {v} ELSE 0 END" for w, v in lang.EXPLANATORY) + ")::DOUBLE, 6) AS boost FROM mem")
def why_boost(spark, sf_dir):
    return memories(spark, sf_dir).select("id", F.round(text.explanatory(F.col("text")), 6).alias("boost"))


@query()
def hash_embed(spark, sf_dir):
    v = signatures.hash_embedding(F.col("text"))
    return memories(spark, sf_dir).select("id", v.alias("embedding"))


def digest_sql(text: str = "text") -> str:
    """The digest embedding of a text as a list of doubles."""
    tokens = _TOK.replace("lower(text)", f"lower({text})")
    sums = f"list_transform(range(1, 33), lambda i: coalesce(list_sum(list_transform({tokens}, lambda t: instr('0123456789abcdef', substr(md5(t), i, 1)) - 8.5)), 0)::DOUBLE)"
    return f"(SELECT list_transform(v, lambda x: CASE WHEN n > 0 THEN x / n ELSE 0 END) FROM (SELECT v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM (SELECT {sums} AS v)))"


SIM_BITS = "list_transform(range(60), lambda i: CASE WHEN list_sum(list_transform(h, lambda x: CASE WHEN (x >> i) & 1 = 1 THEN 1 ELSE -1 END)) > 0 THEN 1::BIGINT << i ELSE 0 END)"
SIGNED = f"""signed AS (SELECT id, v, list_sum(list_transform(range(1, 33), lambda i: CASE WHEN v[i] > 0 THEN 1::BIGINT << (i - 1) ELSE 0 END))::BIGINT AS code,
        coalesce(list_sum({SIM_BITS}), 0)::BIGINT AS simhash
    FROM (SELECT id, {digest_sql()} AS v, list_transform({_TOK}, lambda t: ('0x' || substr(md5(t), 1, 15))::BIGINT) AS h FROM mem))"""


@query(f"WITH {MEM}, {SIGNED} SELECT id, array_to_string(list_transform(v, lambda x: round(x * 1000000)::BIGINT), ',') AS embedding, code FROM signed")
def digest_embed(spark, sf_dir):
    v = signatures.digest_embedding(F.col("text"))
    rows = memories(spark, sf_dir).select("id", v.alias("v"))
    return rows.select("id", F.array_join(F.transform("v", lambda x: F.round(x * 1000000).cast("long").cast("string")), ",").alias("embedding"), scores.sign_code(F.col("v")).alias("code"))


@query()
def stable_hash(spark, sf_dir):
    return memories(spark, sf_dir).select("id", signatures.stable_hash(F.col("text")).alias("hash"))


@query(f"WITH {MEM}, {SIGNED} SELECT id, simhash FROM signed")
def lexical_simhash(spark, sf_dir):
    return memories(spark, sf_dir).select("id", signatures.simhash(F.col("text"), signatures.digest_hash).alias("simhash"))


# --- postings and channels

_BUCKETS = "unnest(['h:' || (created_at_ms // 3600000), 'd:' || (created_at_ms // 86400000), 'w:' || (created_at_ms // 604800000)])"
POST = f"post AS (SELECT DISTINCT 'entity' AS dim, unnest({_ENT}) AS key, id FROM mem UNION SELECT DISTINCT 'topic', unnest({_TOP}), id FROM mem UNION SELECT DISTINCT 'temporal', {_BUCKETS}, id FROM mem)"


def _postings(spark, sf_dir):
    return association.postings(association.understand(memories(spark, sf_dir), DIGEST)).where("dim in ('entity', 'topic', 'temporal')")


@query(f"WITH {MEM}, {POST} SELECT dim, key, id FROM post")
def posting_build(spark, sf_dir):
    return _postings(spark, sf_dir)


@query(f"WITH {MEM}, {POST} SELECT dim, count(*) AS n, count(DISTINCT key) AS n_keys FROM post GROUP BY dim")
def posting_stats(spark, sf_dir):
    return browse.posting_stats(_postings(spark, sf_dir))


@query("SELECT event_id, unnest(['h:' || (epoch_us(ts) // 1000 // 3600000), 'd:' || (epoch_us(ts) // 1000 // 86400000), 'w:' || (epoch_us(ts) // 1000 // 604800000)]) AS key FROM events")
def temporal_buckets(spark, sf_dir):
    return signals(spark, sf_dir).select("event_id", F.explode(channels.temporal_keys(F.col("ts_ms"))).alias("key"))


_DOCS = "mem AS (SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL), q AS (SELECT item_id AS query_id, text FROM benchmark WHERE text IS NOT NULL)"
_DE = f"dp AS (SELECT DISTINCT unnest({_ENT}) AS key, id FROM mem), qk AS (SELECT query_id, unnest({_ENT}) AS key FROM q)"
_DT = f"tp AS (SELECT DISTINCT unnest({_TOP}) AS key, id FROM mem), tk AS (SELECT query_id, unnest(range(len(t))) AS pos, unnest(t) AS key FROM (SELECT query_id, {_TOP} AS t FROM q))"
ENTITY = f"{_DE}, entity AS (SELECT query_id, id, 'EntityInverted' AS channel, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS ord FROM (SELECT query_id, id, CASE WHEN count(DISTINCT key) <= 1 THEN 0.2 WHEN count(DISTINCT key) = 2 THEN 0.35 ELSE 0.5 END::DOUBLE AS score FROM dp JOIN qk USING (key) GROUP BY query_id, id))"
TOPIC = f"{_DT}, topic AS (SELECT query_id, id, 'TopicCluster' AS channel, 0.15::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY pos, id) - 1 AS ord FROM tp JOIN tk USING (key))"
BM25 = f"""term AS (SELECT id, t AS term, count(*) AS tf FROM (SELECT id, unnest({_TOK}) AS t FROM mem) GROUP BY id, t), doc AS (SELECT id, sum(tf) AS dl FROM term GROUP BY id),
    st AS (SELECT count(*) AS n, avg(dl) AS av FROM doc), w AS (SELECT query_id, unnest(list_distinct({_TOK})) AS term FROM q), df AS (SELECT term, count(*) AS df FROM term WHERE term IN (SELECT term FROM w) GROUP BY term),
    bm AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av))), 9) AS raw FROM w JOIN df USING (term) JOIN term USING (term) JOIN doc USING (id), st GROUP BY query_id, id),
    bm25 AS (SELECT query_id, id, 'Bm25' AS channel, tanh(raw / 2) AS score, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, id) - 1 AS ord FROM bm)"""


def _doc_postings(spark, sf_dir):
    d, t = documents(spark, sf_dir), F.col("text")
    return d.select(F.lit("entity").alias("dim"), F.explode(text.entities(t)).alias("key"), "id").union(d.select(F.lit("topic"), F.explode(F.array_distinct(text.topics(t))), "id"))


def _channels(spark, sf_dir, k=20):
    q, posting = probes(spark, sf_dir), _doc_postings(spark, sf_dir)
    term = stored(channels.full_text(documents(spark, sf_dir)))
    return channels.union_channels([channels.bm25_channel(q, term, k), channels.entity_channel(q, posting, k), channels.topic_channel(q, posting, k)])


@query(f"WITH {_DOCS}, {ENTITY} SELECT query_id, id, score, ord FROM entity WHERE ord < 20")
def entity_channel(spark, sf_dir):
    return channels.entity_channel(probes(spark, sf_dir), _doc_postings(spark, sf_dir), 20).select("query_id", "id", "score", "ord")


@query(f"WITH {_DOCS}, {TOPIC} SELECT query_id, id, score, ord FROM topic WHERE ord < 20")
def topic_channel(spark, sf_dir):
    return channels.topic_channel(probes(spark, sf_dir), _doc_postings(spark, sf_dir), 20).select("query_id", "id", "score", "ord")


@query(f"WITH {_DOCS}, {BM25} SELECT query_id, id, round(score, 6) AS score, ord FROM bm25 WHERE ord < 20")
def bm25_topk(spark, sf_dir):
    term = stored(channels.full_text(documents(spark, sf_dir)))
    return channels.bm25_channel(probes(spark, sf_dir), term, 20).select("query_id", "id", _r("score"), "ord")


@query(f"WITH {MEM}, {POST} SELECT DISTINCT item_id AS query_id, id, 0.3::DOUBLE AS score FROM benchmark, post WHERE dim = 'temporal' AND key IN ('h:' || ((1700000000000 + item_id * 600000) // 3600000), 'd:' || ((1700000000000 + item_id * 600000) // 86400000), 'w:' || ((1700000000000 + item_id * 600000) // 604800000))")
def temporal_channel(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), (F.lit(1700000000000) + F.col("item_id") * 600000).alias("now_ms"))
    return channels.temporal_channel(q, _postings(spark, sf_dir)).select("query_id", "id", "score")


@query(f"""WITH {EDGE}, recent AS (SELECT p_partkey // 20 % 10 AS query_id, p_partkey AS id FROM part WHERE p_partkey % 20 = 0),
    first AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst, link_type) AS n FROM edge) WHERE n <= 8),
    e AS (SELECT query_id, id, 0.3 AS e FROM recent UNION ALL SELECT query_id, dst, 0.15 FROM recent JOIN first ON src = id)
    SELECT query_id, id, round(least(1.0, sum(e))::DOUBLE, 6) AS score FROM e GROUP BY query_id, id""")
def recent_channel(spark, sf_dir):
    recent = table(spark, sf_dir, "part").where("p_partkey % 20 = 0").select((F.floor(F.col("p_partkey") / 20) % 10).alias("query_id"), F.col("p_partkey").alias("id"))
    return channels.recent_channel(recent, edges(spark, sf_dir).withColumn("ord", F.lit(0))).select("query_id", "id", _r("score"))


def _vectors(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return v, v.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))


@query("""WITH d AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))), 9) AS d FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0)
    SELECT query_id, id, round(1 / (1 + d), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY d, id) - 1 AS ord FROM d QUALIFY ord < 20""")
def dense_knn_topk(spark, sf_dir):
    v, q = _vectors(spark, sf_dir)
    return channels.dense_channel(q, v, 20).select("query_id", "id", _r("score"), "ord")


@query("""WITH c AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x > 0) AS b FROM embeddings),
    h AS (SELECT q.id AS query_id, v.id AS id, len(list_filter(list_zip(v.b, q.b), lambda p: p[1] <> p[2])) AS h FROM c q, c v WHERE q.id % 20 = 0)
    SELECT query_id, id, round((1 - h / 64)::DOUBLE, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY h, id) - 1 AS ord FROM h QUALIFY ord < 20""")
def hamming_topk(spark, sf_dir):
    v, q = _vectors(spark, sf_dir)
    codes = v.select("id", scores.sign_code(F.col("embedding")).alias("code"))
    return channels.binary_channel(q.select("query_id", scores.sign_code(F.col("q")).alias("q")), codes, 20).select("query_id", "id", _r("score"), "ord")


# --- fusion

SEEDS = f"{_DOCS}, {BM25}, {ENTITY}, {TOPIC}, s AS (SELECT * FROM bm25 WHERE ord < 20 UNION ALL SELECT * FROM entity WHERE ord < 20 UNION ALL SELECT * FROM topic WHERE ord < 20), rk AS (SELECT *, row_number() OVER (PARTITION BY query_id, channel ORDER BY score DESC, ord) - 1 AS rank FROM s), dd AS (SELECT * FROM rk QUALIFY row_number() OVER (PARTITION BY query_id, channel, id ORDER BY rank) = 1)"
FUSED = SEEDS + ", pt AS (SELECT *, (CASE WHEN channel = 'TopicCluster' THEN 0.3 ELSE 1.0 END)::DOUBLE / (1 + rank) AS part FROM dd), fu AS (SELECT query_id, id, sum(part) AS fused FROM pt GROUP BY query_id, id)"


@query(f"WITH {SEEDS} SELECT query_id, id, channel, rank FROM rk WHERE rank < 20")
def channel_rank(spark, sf_dir):
    return fusion.ranked(_channels(spark, sf_dir)).select("query_id", "id", "channel", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {SEEDS} SELECT query_id, id, channel, rank FROM dd")
def seed_dedupe(spark, sf_dir):
    return fusion.deduped(fusion.ranked(_channels(spark, sf_dir))).select("query_id", "id", "channel", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {FUSED}, top AS (SELECT query_id, id, channel FROM pt QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY round(part, 12) DESC, score DESC, list_position(['Bm25', 'EntityInverted', 'TopicCluster'], channel)) = 1) SELECT query_id, id, round(fused, 6) AS fused, channel FROM fu JOIN top USING (query_id, id)")
def rrf_fuse(spark, sf_dir):
    return fusion.fuse(fusion.deduped(fusion.ranked(_channels(spark, sf_dir)))).select("query_id", "id", _r("fused"), "channel")


@query(f"WITH {SEEDS} SELECT query_id, id, round(max(score), 6) AS fused FROM dd GROUP BY query_id, id")
def rrf_max(spark, sf_dir):
    return fusion.fuse(fusion.deduped(fusion.ranked(_channels(spark, sf_dir))), replace(DEFAULT, rrf_k=0.0)).select("query_id", "id", _r("fused"))


@query(f"WITH {SEEDS} SELECT query_id, channel, count(*) AS n FROM dd GROUP BY query_id, channel")
def channel_contrib(spark, sf_dir):
    return channels.contributions(fusion.deduped(fusion.ranked(_channels(spark, sf_dir))))


# --- spreading

NO_PATH = "[]::STRUCT(t VARCHAR, d BIGINT, e DOUBLE)[]"
ENERGY = f"{SEED}, en AS (SELECT query_id, id, fused, least(fused / max(fused) OVER (PARTITION BY query_id) * 0.4 * (1 + importance * 0.6), 1.0) AS energy FROM seed), s0 AS (SELECT *, id AS seed, {NO_PATH} AS path, row_number() OVER (PARTITION BY query_id ORDER BY round(fused, 9) DESC, id) AS ord FROM en WHERE energy >= 0.05)"
TOP6 = f"{EDGE}, top6 AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(strength * confidence, 9) DESC, dst, link_type) AS er FROM edge QUALIFY er <= 6)"
_MOD = "(CASE link_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in TYPE_MODIFIER.items()) + " END)::DOUBLE"


def _hop_sql(n: int, frontier: str, reached: str) -> str:
    d = f"pow(0.55::DOUBLE, {n})"
    return f"""m{n} AS (SELECT f.query_id, t.dst AS id, f.ord, t.er, f.seed, f.path, t.link_type, least(1.0, f.energy * t.strength * t.confidence * {d} * {_MOD}) AS e FROM {frontier} f JOIN top6 t ON t.src = f.id WHERE NOT EXISTS (SELECT 1 FROM ({reached}) r WHERE r.query_id = f.query_id AND r.id = t.dst)),
    g{n} AS (SELECT query_id, id, list(e ORDER BY ord, er) AS es, arg_min({{'seed': seed, 'path': list_append(path, {{'t': link_type, 'd': id, 'e': e}})}}, ord * 1000 + er) AS p FROM m{n} WHERE e >= 0.05 GROUP BY query_id, id),
    s{n} AS (SELECT query_id, id, p.seed AS seed, p.path AS path, list_reduce(list_prepend(0.0::DOUBLE, es), lambda a, b: greatest(a, b) + 0.3 * least(a, b)) AS energy, len(es)::BIGINT AS n_paths, row_number() OVER (PARTITION BY query_id ORDER BY round(list_reduce(list_prepend(0.0::DOUBLE, es), lambda a, b: greatest(a, b) + 0.3 * least(a, b)), 9) DESC, id) AS ord FROM g{n})"""


def _seed_energy(spark, sf_dir):
    s = seeds(spark, sf_dir)
    return fusion.energised(s.drop("importance"), s.select("id", "importance"))


@query(f"WITH {ENERGY} SELECT query_id, id, round(energy, 6) AS energy FROM s0")
def seed_energy(spark, sf_dir):
    return _seed_energy(spark, sf_dir).select("query_id", "id", _r("energy"))


@query(f"WITH {EDGE} SELECT src, dst, round(strength * confidence * 0.55 * {_MOD}, 9) AS passed FROM edge")
def type_modifier_apply(spark, sf_dir):
    e = edges(spark, sf_dir)
    return e.select("src", "dst", F.round(F.col("strength") * F.col("confidence") * 0.55 * scores.type_modifier(F.col("link_type")), 9).alias("passed"))


@query(f"WITH {TOP6} SELECT src, dst, link_type, er AS edge_rank FROM top6")
def fan_out_cap(spark, sf_dir):
    return spreading.strongest(edges(spark, sf_dir)).select("src", "dst", "link_type", F.col("edge_rank").cast("long").alias("edge_rank"))


@query(f"WITH {ENERGY}, {TOP6}, {_hop_sql(1, 's0', 'SELECT query_id, id FROM s0')} SELECT query_id, id, round(energy, 6) AS energy, n_paths FROM s1")
def spread_hop1(spark, sf_dir):
    return spreading.spread(_seed_energy(spark, sf_dir), edges(spark, sf_dir), hops=1).where("hop = 1").select("query_id", "id", _r("energy"), "n_paths")


_HOPS = f"{ENERGY}, {TOP6}, {_hop_sql(1, 's0', 'SELECT query_id, id FROM s0')}, {_hop_sql(2, 's1', 'SELECT query_id, id FROM s0 UNION ALL SELECT query_id, id FROM s1')}"


@query(f"WITH {_HOPS} SELECT query_id, id, round(energy, 6) AS energy, 0 AS hop FROM s0 UNION ALL SELECT query_id, id, round(energy, 6), 1 FROM s1 UNION ALL SELECT query_id, id, round(energy, 6), 2 FROM s2")
def spread_hop2(spark, sf_dir):
    return spreading.spread(_seed_energy(spark, sf_dir), edges(spark, sf_dir)).select("query_id", "id", _r("energy"), "hop")


@query(f"WITH {_HOPS} SELECT query_id, sum(n_paths - 1)::BIGINT AS merged FROM (SELECT query_id, n_paths FROM s1 UNION ALL SELECT query_id, n_paths FROM s2) GROUP BY query_id")
def merged_count(spark, sf_dir):
    return spreading.spread(_seed_energy(spark, sf_dir), edges(spark, sf_dir)).where("hop > 0").groupBy("query_id").agg(F.sum(F.col("n_paths") - 1).alias("merged"))


@query(f"WITH {ENERGY}, {TOP6}, {_hop_sql(1, 's0', 'SELECT query_id, id FROM s0')} SELECT query_id, id, round(e, 6) AS energy FROM m1 WHERE e >= 0.05 QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY ord, er) = 1")
def spread_one_hop(spark, sf_dir):
    return spreading.one_hop(_seed_energy(spark, sf_dir), edges(spark, sf_dir)).where("hop = 1").select("query_id", "id", _r("energy"))


TRACE = "'seed=' || seed || list_reduce(list_prepend('', list_transform(path, lambda s: ' -' || s.t || '->' || s.d || printf(' (e=%.3f)', s.e))), lambda a, b: a || b)"


@query(f"""WITH {_HOPS}, every AS (SELECT query_id, id, seed, path FROM s0 UNION ALL SELECT query_id, id, seed, path FROM s1 UNION ALL SELECT query_id, id, seed, path FROM s2)
    SELECT query_id, id, {TRACE} AS trace, array_to_string({once("list_append(list_transform(path, lambda s: s.t), 'Bm25')")}, ',') AS dimensions FROM every""")
def spread_trace(spark, sf_dir):
    out = spreading.spread(_seed_energy(spark, sf_dir), edges(spark, sf_dir))
    return out.select("query_id", "id", spreading.trace_text(F.col("trace")).alias("trace"), F.array_join(rerank.matched_dimensions(F.col("trace"), F.lit("Bm25")), ",").alias("dimensions"))


@query(f"WITH {ENERGY}, {TOP6} SELECT f.query_id, f.id AS src, t.dst, round(least(1.0, f.energy * t.strength * t.confidence * 0.55 * {_MOD}), 6) AS energy FROM s0 f JOIN top6 t ON t.src = f.id")
def propagate_hop1(spark, sf_dir):
    top = spreading.strongest(edges(spark, sf_dir))
    rows = _seed_energy(spark, sf_dir).withColumnRenamed("id", "src").join(top, "src")
    e = scores.passed_energy(F.col("energy"), F.col("strength"), F.col("confidence"), 1, F.col("link_type"))
    return rows.select("query_id", "src", "dst", F.round(e, 6).alias("energy"))


@query("SELECT p_partkey AS id, round(greatest(0.0, least((CASE p_partkey % 3 WHEN 0 THEN 1.2 WHEN 1 THEN 0.6 ELSE 1.0 END) * (p_partkey % 7 / 7.0::DOUBLE) * 0.4 * (1 + p_partkey % 5 / 5.0::DOUBLE * 0.6) + p_partkey % 4 / 4.0::DOUBLE * 0.2 + p_partkey % 6 / 6.0::DOUBLE * 0.15 + 0.1 * 0.5, 1.0)), 6) AS energy FROM part")
def initial_energy(spark, sf_dir):
    k = F.col("p_partkey")
    channel = F.when(k % 3 == 0, "SemanticDense").when(k % 3 == 1, "SemanticBinary").otherwise("Bm25")
    e = scores.initial_energy(channel, k % 7 / 7.0, k % 4 / 4.0, k % 5 / 5.0, k % 6 / 6.0, F.lit(0.5))
    return table(spark, sf_dir, "part").select(k.alias("id"), F.round(e, 6).alias("energy"))


def _traverse_sql(hops: str, depth: int) -> str:
    return f"WITH RECURSIVE {EDGE}, hops AS ({hops}), walk AS (SELECT p_partkey AS id, 0 AS depth FROM part WHERE p_partkey % 20 = 0 UNION SELECT h.dst, w.depth + 1 FROM walk w JOIN hops h ON h.src = w.id WHERE w.depth < {depth}) SELECT id, min(depth) AS depth FROM walk GROUP BY id"


@query(_traverse_sql("SELECT src, dst FROM edge", 2))
def traverse_out(spark, sf_dir):
    return spreading.traverse(table(spark, sf_dir, "part").where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("id")), edges(spark, sf_dir), "out", 2)


@query(_traverse_sql("SELECT src, dst FROM edge WHERE link_type IN ('Causal', 'SameGoal') UNION ALL SELECT dst, src FROM edge WHERE link_type IN ('Causal', 'SameGoal')", 2))
def traverse_both(spark, sf_dir):
    return spreading.traverse(table(spark, sf_dir, "part").where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("id")), edges(spark, sf_dir), "both", 2, ["Causal", "SameGoal"])


# --- association


@query("SELECT p_partkey AS total, round(CASE WHEN p_partkey < 500 THEN 0.6 WHEN p_partkey >= 1000 THEN 1.0 ELSE 0.6 + 0.4 * (p_partkey - 500) / 500 END::DOUBLE, 6) AS factor FROM part")
def cold_start_curve(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("total"), F.round(scores.cold_start(F.col("p_partkey")), 6).alias("factor"))


# --- reranking


@query(f"WITH {EDGE}, r AS (SELECT 1 AS query_id, p_partkey AS id, (p_partkey % 30) / 100.0::DOUBLE AS energy FROM part), a AS (SELECT src AS id, list(link_type || ':' || dst ORDER BY list_position(['Correction', 'Contradiction', 'Supersedes'], link_type), dst) AS w FROM edge WHERE link_type IN ('Correction', 'Contradiction', 'Supersedes') GROUP BY src) SELECT id, array_to_string(list_concat(list_concat(CASE WHEN energy < 0.2 THEN ['LowConfidence'] ELSE [] END, coalesce(w, [])), CASE WHEN energy < 0.1 THEN ['StaleFreshness'] ELSE [] END), ',') AS warnings FROM r LEFT JOIN a USING (id)")
def warnings(spark, sf_dir):
    r = table(spark, sf_dir, "part").select(F.lit(1).alias("query_id"), F.col("p_partkey").alias("id"), (F.col("p_partkey") % 30 / 100.0).alias("energy"))
    return rerank.warnings(r, edges(spark, sf_dir)).select("id", F.array_join("warnings", ",").alias("warnings"))


@query(f"""WITH {_DOCS}, qe AS (SELECT query_id, {_ENT} AS qe FROM q WHERE query_id % 20 = 0), me AS (SELECT id, {_ENT} AS me FROM mem)
    SELECT query_id, id, round(CASE WHEN len(qe) >= 2 THEN 0.5 * (1 + 0.2 * len(list_intersect(qe, me)) / len(qe)) ELSE 0.5 END::DOUBLE, 6) AS energy FROM qe, me""")
def coverage_correction(spark, sf_dir):
    """Every twentieth benchmark text, a stated set, against all documents."""
    q = probes(spark, sf_dir).where("query_id % 20 = 0").select("query_id", text.entities(F.col("text")).alias("qe"))
    m = documents(spark, sf_dir).select("id", text.entities(F.col("text")).alias("me"))
    return m.join(small(q)).select("query_id", "id", F.round(rerank.coverage_correction(F.lit(0.5), F.col("qe"), F.col("me")), 6).alias("energy"))


# --- learning


@query(f"""WITH {LOG}, w AS (SELECT *, (CASE signal WHEN 'retrieve' THEN 0.5 WHEN 'Referenced' THEN 0.8 ELSE 1.0 END)::DOUBLE AS weight FROM log WHERE signal <> 'UserRejected')
    SELECT x.memory_id AS a, y.memory_id AS b, round(sum(least(x.weight, y.weight)), 6) AS weight FROM w x JOIN w y ON x.memory_id < y.memory_id AND x.ts_ms < y.ts_ms + 3600000 AND y.ts_ms < x.ts_ms + 3600000 GROUP BY 1, 2""")
def coactivation_pairs(spark, sf_dir):
    return learning.coactivation_pairs(learning.weighted(signals(spark, sf_dir))).select("a", "b", _r("weight"))


_STRONG = "pr AS (SELECT src AS a, dst AS b, ((src + dst) % 9)::DOUBLE AS weight FROM edge WHERE src < dst)"


def _pairs(e):
    return e.where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"), ((F.col("src") + F.col("dst")) % 9).cast("double").alias("weight"))


@query(f"WITH {EDGE}, {_STRONG}, b AS (SELECT a AS src, b AS dst, 0.08 * least(weight, 5) AS d FROM pr WHERE weight >= 3 UNION ALL SELECT b, a, 0.08 * least(weight, 5) FROM pr WHERE weight >= 3) SELECT src, dst, round(CASE WHEN d IS NULL THEN strength ELSE least(1.0, strength + d) END, 6) AS strength, activation_count + CASE WHEN d IS NULL THEN 0 ELSE 1 END AS activation_count FROM edge LEFT JOIN b USING (src, dst)")
def hebbian_update(spark, sf_dir):
    e = edges(spark, sf_dir)
    return learning.hebbian(e, _pairs(e)).select("src", "dst", _r("strength"), "activation_count")


@query(f"WITH {EDGE}, pr AS (SELECT p_partkey AS a, p_partkey + 1 AS b, (p_partkey % 9)::DOUBLE AS weight FROM part) SELECT a AS src, b AS dst FROM pr WHERE weight >= 3 AND NOT EXISTS (SELECT 1 FROM edge WHERE src = a AND dst = b AND link_type = 'CoActivation')")
def coactivation_new_edges(spark, sf_dir):
    k = F.col("p_partkey")
    pairs = table(spark, sf_dir, "part").select(k.alias("a"), (k + 1).alias("b"), (k % 9).cast("double").alias("weight"))
    return learning.new_edges(edges(spark, sf_dir), pairs, NOW).select("src", "dst")


@query(f"WITH {EDGE}, r AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 17 = 0) SELECT src, dst, round(CASE WHEN src IN (SELECT id FROM r) OR dst IN (SELECT id FROM r) THEN greatest(0.12, strength - 0.08) ELSE strength END, 6) AS strength, CASE WHEN src IN (SELECT id FROM r) OR dst IN (SELECT id FROM r) THEN greatest(0, activation_count - 1) ELSE activation_count END AS activation_count FROM edge")
def reject_weaken(spark, sf_dir):
    r = table(spark, sf_dir, "part").where("p_partkey % 17 = 0").select(F.col("p_partkey").alias("id"))
    return learning.reject(edges(spark, sf_dir), r).select("src", "dst", _r("strength"), "activation_count")


DECAY = f"{EDGE}, fd AS (SELECT *, NOT observing AND link_type IN ('Causal', 'Correction', 'Contradiction', 'Supersedes') AS kept, strength * pow(0.5, greatest({NOW} - last_activated_at, 0) / (86400000 * pow(2.0, least(activation_count, 6)))) AS faded FROM edge), dc AS (SELECT src, dst, link_type, observing, kept, CASE WHEN kept THEN strength ELSE greatest(0.12, faded) END AS strength FROM fd WHERE kept OR NOT observing OR round(faded, 9) >= 0.12)"


@query(f"WITH {DECAY} SELECT src, dst, round(strength, 4) AS strength FROM dc")
def decay_curve(spark, sf_dir):
    return learning.decay(edges(spark, sf_dir), NOW).select("src", "dst", _r("strength", 4))


@query(f"WITH {EDGE} SELECT src, dst FROM edge WHERE (NOT observing AND link_type IN ('Causal', 'Correction', 'Contradiction', 'Supersedes')) OR strength >= 0.12 QUALIFY row_number() OVER (PARTITION BY src ORDER BY round(strength, 9) DESC, dst, link_type) <= 64")
def compaction(spark, sf_dir):
    return learning.compact(edges(spark, sf_dir)).select("src", "dst")


@query(f"WITH {LOG}, d AS (SELECT memory_id, list((CASE signal WHEN 'Referenced' THEN 0.05 WHEN 'UserConfirmedCorrect' THEN 0.10 WHEN 'TaskSucceeded' THEN 0.08 ELSE -0.10 END)::DOUBLE ORDER BY ts_ms, event_id) AS ds FROM log WHERE signal <> 'retrieve' GROUP BY memory_id) SELECT memory_id, round(list_reduce(list_prepend(0.5::DOUBLE, ds), lambda s, x: least(1.0, greatest(0.0, s + x))), 6) AS usage_score FROM d")
def usage_score(spark, sf_dir):
    return learning.usage(signals(spark, sf_dir)).select("memory_id", _r("usage_score"))


@query(f"WITH {LOG} SELECT 'f' || (event_id % 20) AS feature, memory_id, least(1.0, 0.25 * count(*))::DOUBLE AS strength, count(*) AS review_count, max(ts_ms) AS last_reviewed_at FROM log WHERE signal IN ('Referenced', 'UserConfirmedCorrect', 'TaskSucceeded') GROUP BY 1, 2")
def context_link_fold(spark, sf_dir):
    return learning.context_links(signals(spark, sf_dir).withColumn("feature", F.concat(F.lit("f"), (F.col("event_id") % 20).cast("string"))))


_CTX = f"{LOG}, cl AS (SELECT 'f' || (event_id % 20) AS feature, memory_id, least(1.0, 0.25 * count(*))::DOUBLE AS strength, count(*) AS rc, max(ts_ms) AS at_ms FROM log WHERE signal IN ('Referenced', 'UserConfirmedCorrect', 'TaskSucceeded') GROUP BY 1, 2), qf AS (SELECT item_id AS query_id, 'f' || (item_id % 20) AS feature FROM benchmark)"


@query(f"WITH {_CTX} SELECT query_id, memory_id, round(max(strength * pow(0.5, greatest({NOW} - at_ms, 0) / (86400000 * pow(2.0, least(rc, 6))))), 4) AS strength FROM qf JOIN cl USING (feature) GROUP BY query_id, memory_id")
def context_strength(spark, sf_dir):
    links = context_link_fold(spark, sf_dir)
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("f"), (F.col("item_id") % 20).cast("string")).alias("feature"))
    return rerank.context_strengths(q, links, NOW).select("query_id", "memory_id", _r("strength", 4))


_SETS = f"{LOG}, rs AS (SELECT event_id // 5 AS retrieval_id, memory_id, max(ts_ms) OVER (PARTITION BY event_id // 5) AS ts_ms FROM log)"


@query(f"WITH {_SETS}, d AS (SELECT DISTINCT * FROM rs), n AS (SELECT a.memory_id, b.memory_id AS other, count(*) AS n, max(a.ts_ms) AS last_at FROM d a JOIN d b USING (retrieval_id) WHERE a.memory_id <> b.memory_id GROUP BY 1, 2) SELECT memory_id, other, n FROM n QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY last_at DESC, other) <= 16")
def co_activation_top16(spark, sf_dir):
    s = signals(spark, sf_dir).withColumn("retrieval_id", F.floor(F.col("event_id") / 5))
    at = s.groupBy("retrieval_id").agg(F.max("ts_ms").alias("ts_ms"))
    return learning.coactivation_counts(s.drop("ts_ms").join(at, "retrieval_id")).select("memory_id", "other", "n")


@query(f"WITH {EDGE}, u AS (SELECT l_partkey AS src, l_partkey + 1 AS dst, count(*) AS uses FROM lineitem GROUP BY 1, 2) SELECT src, dst, round(CASE WHEN uses IS NULL THEN strength ELSE least(1.0, strength + 0.25 * uses) END, 6) AS strength, activation_count + coalesce(uses, 0) AS activation_count FROM edge LEFT JOIN u USING (src, dst)")
def path_reinforce(spark, sf_dir):
    paths = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_partkey") + 1).alias("dst"))
    return learning.reinforce_paths(edges(spark, sf_dir), paths, NOW).select("src", "dst", _r("strength"), "activation_count")


@query(f"WITH {EDGE} SELECT src, CASE WHEN dst % 10 = 0 THEN 1 ELSE dst END AS dst, link_type FROM edge WHERE src <> CASE WHEN dst % 10 = 0 THEN 1 ELSE dst END")
def redirect_edges(spark, sf_dir):
    gone = table(spark, sf_dir, "part").where("p_partkey % 10 = 0").select(F.col("p_partkey").alias("id"), F.lit(1).cast("long").alias("into"))
    return learning.redirect(edges(spark, sf_dir), gone).select("src", "dst", "link_type")


_CYCLE = f"""WITH {EDGE}, {LOG}, w AS (SELECT *, (CASE signal WHEN 'retrieve' THEN 0.5 WHEN 'Referenced' THEN 0.8 ELSE 1.0 END)::DOUBLE AS weight FROM log WHERE signal <> 'UserRejected'),
    pr AS (SELECT x.memory_id AS a, y.memory_id AS b, sum(least(x.weight, y.weight)) AS weight
        FROM w x JOIN w y ON x.memory_id < y.memory_id AND x.ts_ms < y.ts_ms + 3600000 AND y.ts_ms < x.ts_ms + 3600000 GROUP BY 1, 2 HAVING round(sum(least(x.weight, y.weight)), 9) >= 3),
    b AS (SELECT a AS src, b AS dst, 0.08 * least(weight, 5) AS d FROM pr UNION ALL SELECT b, a, 0.08 * least(weight, 5) FROM pr),
    hb AS (SELECT e.src, e.dst, link_type, least(1.0, strength + coalesce(d, 0)) AS strength, observing, last_activated_at, activation_count + CASE WHEN d IS NULL THEN 0 ELSE 1 END AS n FROM edge e LEFT JOIN b USING (src, dst)),
    nw AS (SELECT a AS src, b AS dst, 'CoActivation' AS link_type, 0.3::DOUBLE AS strength, true AS observing, {NOW} AS last_activated_at, 0 AS n FROM pr WHERE NOT EXISTS (SELECT 1 FROM edge WHERE src = a AND dst = b AND link_type = 'CoActivation')),
    gr AS (SELECT * FROM hb UNION ALL SELECT * FROM nw), r AS (SELECT DISTINCT memory_id AS id FROM log WHERE signal = 'UserRejected'),
    rj AS (SELECT src, dst, link_type, CASE WHEN hit THEN greatest(0.12, strength - 0.08) ELSE strength END AS strength, observing, last_activated_at, CASE WHEN hit THEN greatest(0, n - 1) ELSE n END AS n
        FROM (SELECT *, src IN (SELECT id FROM r) OR dst IN (SELECT id FROM r) AS hit FROM gr)),
    fd AS (SELECT *, NOT observing AND link_type IN ('Causal', 'Correction', 'Contradiction', 'Supersedes') AS kept, strength * pow(0.5, greatest({NOW} - last_activated_at, 0) / (86400000 * pow(2.0, least(n, 6)))) AS faded FROM rj),
    dc AS (SELECT src, dst, link_type, CASE WHEN kept THEN strength ELSE greatest(0.12, faded) END AS strength FROM fd WHERE kept OR NOT observing OR round(faded, 9) >= 0.12)
    SELECT src, dst, link_type, round(strength, 4) AS strength FROM dc QUALIFY row_number() OVER (PARTITION BY src ORDER BY round(strength, 9) DESC, dst, link_type) <= 64"""


@query(_CYCLE)
def consolidate_cycle(spark, sf_dir):
    return learning.cycle(stored(edges(spark, sf_dir)), signals(spark, sf_dir), NOW).select("src", "dst", "link_type", _r("strength", 4))


@query(f"WITH {EDGE} SELECT src, dst, round(CASE WHEN {NOW} - last_activated_at > 86400000 THEN greatest(strength * 0.97, 0.12) ELSE strength END, 6) AS strength FROM edge")
def linear_decay(spark, sf_dir):
    return learning.linear_decay(edges(spark, sf_dir), NOW).select("src", "dst", _r("strength"))


@query(f"""WITH {EDGE}, kept AS (SELECT DISTINCT src FROM edge WHERE strength >= 0.5)
    SELECT p_partkey AS id, CASE WHEN p_partkey % 9 = 0 THEN 'Compressed' WHEN p_partkey NOT IN (SELECT src FROM kept) AND p_partkey % 3 <> 0 THEN 'Deprecated' ELSE 'Active' END AS lifecycle FROM part""")
def compact_units(spark, sf_dir):
    k = F.col("p_partkey")
    units = table(spark, sf_dir, "part").select(k.alias("id"), F.when(k % 9 == 0, "Compressed").otherwise("Active").alias("lifecycle"), F.when(k % 3 == 0, NOW).otherwise(0).alias("updated_at_ms"))
    return learning.compact_units(units, edges(spark, sf_dir), NOW, replace(DEFAULT, floor=0.5))[0].select("id", "lifecycle")


# --- summaries


@query(f"WITH s AS (SELECT doc_id AS id, list_distinct({_TOK}) AS s FROM documents WHERE text IS NOT NULL), p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.s, b.s)) AS i, len(a.s) + len(b.s) AS n FROM s a JOIN s b ON a.id < b.id AND len(a.s) >= 0.7 * len(b.s) AND len(b.s) >= 0.7 * len(a.s) WHERE len(a.s) > 0) SELECT a, b FROM p WHERE i >= 0.7 * (n - i)")
def similar_texts(spark, sf_dir):
    return summaries.similar_pairs(documents(spark, sf_dir))


_SETS = f"mem AS (SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL), s AS (SELECT id, list_distinct({_TOK}) AS s FROM mem), pr AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.s, b.s)) AS i, len(a.s) + len(b.s) AS n FROM s a JOIN s b ON a.id < b.id AND len(a.s) >= 0.7 * len(b.s) AND len(b.s) >= 0.7 * len(a.s) WHERE len(a.s) > 0), p AS (SELECT a, b FROM pr WHERE i >= 0.7 * (n - i))"


@query(f"""WITH RECURSIVE {_SETS}, nb AS (SELECT b, list(a) AS near FROM p GROUP BY b),
    o AS (SELECT mem.id, coalesce(near, []) AS near, row_number() OVER (ORDER BY mem.id) AS n FROM mem LEFT JOIN nb ON nb.b = mem.id),
    w AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS heads UNION ALL SELECT o.n, CASE WHEN list_has_any(w.heads, o.near) THEN w.heads ELSE list_append(w.heads, o.id) END FROM w JOIN o ON o.n = w.n + 1),
    done AS (SELECT heads FROM w ORDER BY n DESC LIMIT 1)
    SELECT id, coalesce(list_min(list_intersect(near, heads)), id) AS leader FROM o, done""")
def summary_clusters(spark, sf_dir):
    return summaries.leaders(documents(spark, sf_dir).select("id", "text"))


_SENTENCES = r"list_filter(list_transform(regexp_extract_all(text, '[^。！？.!?\n]*[。！？.!?\n]|[^。！？.!?\n]+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: strlen(x) > 1)"


@query(f"""WITH d AS (SELECT doc_id AS id, text, CASE WHEN len({_SENTENCES}) > 0 THEN {_SENTENCES} ELSE [text] END AS ss, list_filter({_TOK}, lambda x: strlen(x) >= 2)[1:20] AS known FROM documents WHERE text IS NOT NULL),
    e AS (SELECT id, known, len(ss) AS n, unnest(ss) AS text, unnest(range(len(ss))) AS i FROM d),
    h AS (SELECT id, text AS s, i, round(len(list_filter({_TOK}, lambda x: list_contains(known, x))) * (1 - 0.5 * i / n), 9) AS score FROM e),
    b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, i) AS r FROM h)
    SELECT id, string_agg(s, '' ORDER BY r) AS summary FROM b WHERE r <= 3 GROUP BY id""")
def summary_text(spark, sf_dir):
    return summaries.summary(documents(spark, sf_dir).withColumn("leader", F.col("id"))).select(F.col("leader").alias("id"), "summary")


# --- browsing and metrics


@query(f"WITH {MEM} SELECT id, content_type, substr(text, 1, 100) AS preview FROM mem WHERE content_type = 'UserStatement' ORDER BY id DESC LIMIT 20")
def list_page(spark, sf_dir):
    return browse.page(memories(spark, sf_dir), 20, content_type="UserStatement")


@query(f"WITH {MEM} SELECT id, content_type, substr(text, 1, 100) AS preview FROM mem WHERE id < 20000 ORDER BY id DESC LIMIT 10")
def list_cursor(spark, sf_dir):
    return browse.page(memories(spark, sf_dir), 10, cursor=20000)


@query(f"WITH {EDGE} SELECT (SELECT count(*) FROM part) AS n_memories, count(*) AS n_edges, count(DISTINCT src) AS n_sources FROM edge")
def store_stats(spark, sf_dir):
    return browse.stats(table(spark, sf_dir, "part"), edges(spark, sf_dir))


@query(f"WITH {EDGE} SELECT p_partkey AS id, count(dst) AS n_links, array_to_string(list_sort(coalesce(list(dst) FILTER (link_type = 'Correction'), [])), ',') AS corrects FROM part LEFT JOIN edge ON src = p_partkey GROUP BY 1")
def explain_row(spark, sf_dir):
    units = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"), F.lit(0.5).alias("importance"))
    return browse.explain(units, edges(spark, sf_dir)).select("id", "n_links", F.coalesce(F.array_join(F.transform("corrects", lambda x: x.cast("string")), ","), F.lit("")).alias("corrects"))


@query(f"WITH {EDGE} SELECT src, dst, link_type, round(strength, 6) AS strength FROM edge ORDER BY round(strength, 9) DESC, src, dst, link_type LIMIT 20")
def inspect_edges(spark, sf_dir):
    return browse.strongest_edges(edges(spark, sf_dir), 20).select("src", "dst", "link_type", _r("strength"))


@query(f"""WITH {MEM}, u AS (SELECT id, conversation_id, turn, text, content_type, created_at_ms, {once(_NAMED)} AS entities, {_TOP} AS topics,
        round(least(1.0, CASE WHEN length(text) > 200 THEN 0.7 WHEN length(text) > 50 THEN 0.5 ELSE 0.3 END + CASE WHEN content_type IN ('Decision', 'Preference') THEN 0.2 ELSE 0.0 END)::DOUBLE, 6) AS importance FROM mem)
    SELECT to_json(u)::VARCHAR AS value FROM u""")
def dump_json(spark, sf_dir):
    t = F.col("text")
    rows = memories(spark, sf_dir).select("id", "conversation_id", "turn", "text", "content_type", "created_at_ms", text.entities(t).alias("entities"), text.topics(t).alias("topics"), F.round(text.importance(t, F.col("content_type")), 6).alias("importance"))
    return browse.json_lines(rows)


@query(f"""WITH {EDGE}, n AS (SELECT src, count(*) AS n FROM edge GROUP BY src)
    SELECT CASE WHEN p_partkey % 3 = 0 THEN 'Indexed' ELSE 'Enriched' END AS stage, count(*) AS n_memories, coalesce(sum(n), 0)::BIGINT AS n_links FROM part LEFT JOIN n ON src = p_partkey GROUP BY 1""")
def inspect_units(spark, sf_dir):
    units = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 == 0, "Indexed").otherwise("Enriched").alias("stage"))
    return browse.unit_stats(units, edges(spark, sf_dir))


_EVAL = f"WITH {FUSED}, res AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(fused, 9) DESC, id) AS rank FROM fu), rel AS (SELECT item_id AS query_id, doc_id AS id FROM benchmark, labels WHERE doc_id % 10 = item_id % 10 AND quality = 1)"


@query(
    _EVAL
    + """, t AS (SELECT res.*, CASE WHEN rel.id IS NULL THEN 0 ELSE 1 END AS rel FROM res LEFT JOIN (SELECT DISTINCT * FROM rel) rel USING (query_id, id) WHERE rank <= 10),
    sc AS (SELECT query_id, count(*) AS got, sum(rel) AS hits, min(CASE WHEN rel = 1 THEN rank END) AS first, sum(rel / log2(rank + 1.0)) AS dcg FROM t GROUP BY query_id), n AS (SELECT query_id, count(DISTINCT id) AS n FROM rel GROUP BY query_id),
    j AS (SELECT query_id, coalesce(got, 0) AS got, coalesce(hits, 0) AS hits, first, coalesce(dcg, 0) AS dcg, coalesce(n, 0) AS n FROM sc FULL JOIN n USING (query_id))
    SELECT query_id, round(CASE WHEN n = 0 THEN 1.0 ELSE hits::DOUBLE / n END, 6) AS recall, round(hits::DOUBLE / least(10, greatest(got, 1)), 6) AS precision, CASE WHEN hits > 0 THEN 1 ELSE 0 END AS hit, round(coalesce(1.0::DOUBLE / first, 0), 6) AS rr, round(CASE WHEN n = 0 THEN 0 ELSE dcg / list_sum(list_transform(range(1, (least(n, 10) + 1)::BIGINT), lambda i: 1 / log2(i + 1.0))) END, 6) AS ndcg FROM j"""
)
def retrieval_metrics(spark, sf_dir):
    fused = fusion.fuse(fusion.deduped(fusion.ranked(_channels(spark, sf_dir))))
    results = rerank.top_k(fused.withColumnRenamed("fused", "energy"), 10)
    b, lab = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "labels").where("quality = 1")
    rel = b.select(F.col("item_id").alias("query_id"), (F.col("item_id") % 10).alias("m")).join(lab.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 10).alias("m")), "m").select("query_id", "id")
    return metrics.evaluate(results, rel, 10).select("query_id", *(_r(c) for c in ("recall", "precision")), "hit", _r("rr"), _r("ndcg"))


@query(
    f"""WITH c AS (SELECT item_id AS query_id, list_transform(range(item_id % 4), lambda i: 'd' || i) AS want, list_transform(range(item_id % 3), lambda i: 'd' || (i * 2)) AS got, item_id % 2 AS expected, item_id % 5 = 0 AS named FROM benchmark)
    SELECT query_id, round(CASE WHEN len(want) = 0 THEN 1.0 ELSE len(list_filter(want, lambda x: list_contains(got, x))) / len(want)::DOUBLE END, 6) AS explanation_accuracy, CASE WHEN expected = 0 OR named THEN 1.0 ELSE 0.0 END::DOUBLE AS contradiction_awareness FROM c"""
)
def explanation_metrics(spark, sf_dir):
    i = F.col("item_id")
    named = lambda n, step: F.transform(F.sequence(F.lit(0).cast("long"), n), lambda x: F.concat(F.lit("d"), (x * step).cast("string")))
    upto = lambda n, step: F.slice(named(n, step), F.lit(1), n.cast("int"))
    cases = table(spark, sf_dir, "benchmark").select(i.alias("query_id"), upto(i % 4, 1).alias("expected_dimensions"), upto(i % 3, 2).alias("dimensions"), (i % 2).alias("expected_warnings"), (i % 5 == 0).alias("contradiction"))
    return metrics.awareness(cases).select("query_id", _r("explanation_accuracy"), "contradiction_awareness")


from . import retrieval_queries  # noqa: E402, F401  (registers its queries here)
