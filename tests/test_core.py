"""Golden numbers, small graphs, SQL for every query that has some, and the engine end to end."""

from __future__ import annotations

import json
import random
import re

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from assocspark import __main__ as cli
from assocspark import hooks, params, queries
from assocspark.functions import scores, signatures, text
from assocspark.operators import association, blocks, browse, channels, fusion, learning, metrics, rerank, spreading, summaries
from assocspark.plans import retrieve as plan
from assocspark.plans.engine import RAW, Engine
from assocspark.sources import fixtures, warehouse
from assocspark.sources.warehouse import NotFound, RecordExists, Warehouse
from assocspark.streaming import feeds

SF = "/root/testdata/sf0.001"
DAY = 86_400_000
EDGE = "src long, dst long, link_type string, strength double, confidence double, observing boolean, last_activated_at long, activation_count long"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def edge(src, dst, kind="EntityOverlap", s=0.9, c=0.9, observing=False, at=0, n=0):
    return src, dst, kind, s, c, observing, at, n


def test_pairs_that_share_only_a_time(spark):
    m = spark.createDataFrame([(1, "alpha beta", 0), (2, "gamma delta", 60_000), (3, "omega kappa", 3 * DAY), (4, "sigma theta", 30 * DAY)], "id long, text string, created_at_ms long").withColumn("content_type", F.lit("UserStatement"))
    post = association.postings(association.understand(m))
    assert {(r.src, r.dst) for r in association.candidate_pairs(post).collect()} == {(2, 1), (3, 1), (3, 2)}
    every = {(r.src, r.dst) for r in post.withColumnRenamed("id", "src").join(post.withColumnRenamed("id", "dst"), ["dim", "key"]).where("dst < src").collect()}
    assert {(r.src, r.dst) for r in association.candidate_pairs(post).collect()} == every
    times = [r for r in queries.QUERIES["pair_features"](spark, SF).collect() if r.dims == "Temporal"]
    assert times and all(r.entity_j == r.topic_j == 0 for r in times)


def test_binary_similarity_counts(spark):
    m = spark.createDataFrame([(1, "alpha beta", 0), (2, "alpha beta", 0), (3, "gamma delta", 0), (4, "...", 0)], "id long, text string, created_at_ms long").withColumn("content_type", F.lit("UserStatement"))
    units = association.understand(m)
    rows = association.pair_features(association.candidate_pairs(association.postings(units)), units)
    vector = {r.id: r.v for r in m.select("id", signatures.hash_embedding(F.col("text")).alias("v")).collect()}
    share = sum((x > 0) == (y > 0) for x, y in zip(vector[1][:64], vector[3][:64], strict=True)) / 64
    got = {(r.src, r.dst): r.binary for r in rows.collect()}
    assert got[2, 1] == 1.0 and got[3, 1] == got[3, 2] == pytest.approx(share) and 0 < share < 1 and got[4, 1] == 0.0
    without = {(r.src, r.dst): r.s for r in rows.withColumn("binary", F.lit(0.0)).select("src", "dst", association.association_score(F.lit(1000)).alias("s")).collect()}
    with_ = {(r.src, r.dst): r.s for r in rows.select("src", "dst", association.association_score(F.lit(1000)).alias("s")).collect()}
    assert with_[3, 1] - without[3, 1] == pytest.approx(0.1 * share)


def test_question_boosts_search_all_memories(spark):
    got = {(r.query_id, r.id): r.energy for r in queries.QUERIES["question_boosts"](spark, SF).collect()}
    ids = {r.id: r.content_type for r in queries.memories(spark, SF).collect()}
    asked = {r.query_id for r in queries.probes(spark, SF).where("query_id % 20 = 0").collect()} | {-i for i in range(1, 13)} | {-100}
    assert set(got) == {(i, m) for i in asked for m in ids} and "ProjectKnowledge" in ids.values()
    assert any(got[-2, m] > 0.5 for m, kind in ids.items() if kind == "ProjectKnowledge")


def test_rank_fusion(spark):
    seeds = spark.createDataFrame([(1, 1, "Bm25", 0.9, 0), (1, 1, "SemanticDense", 0.5, 2), (1, 2, "Bm25", 0.8, 1), (1, 3, "TopicCluster", 0.15, 0)], "query_id int, id int, channel string, score double, rank int")
    got = {r.id: r for r in fusion.fuse(seeds).collect()}
    assert [round(got[i].fused, 6) for i in (1, 2, 3)] == [1.333333, 0.5, 0.3] and got[1].channel == "Bm25"
    energy = {r.id: round(r.energy, 3) for r in fusion.energised(fusion.fuse(seeds), spark.createDataFrame([(i, 0.5) for i in (1, 2, 3)], "id int, importance double")).collect()}
    assert energy == {1: 0.52, 2: 0.195, 3: 0.117}


def test_two_hops(spark):
    seeds = spark.createDataFrame([(1, 1, 0.52, 1.3), (1, 2, 0.195, 0.5)], "query_id int, id long, energy double, fused double")
    graph = spark.createDataFrame([edge(1, 10, s=0.8), edge(2, 10, "Causal"), edge(10, 11, "SameGoal"), edge(11, 1)], EDGE)
    got = {r.id: r for r in spreading.spread(seeds, graph).withColumn("text", spreading.trace_text(F.col("trace"))).collect()}
    assert round(got[10].energy, 6) == 0.2398 and got[10].n_paths == 2 and got[10].hop == 1
    assert got[11].energy == pytest.approx(0.064634, abs=1e-5) and got[11].text.startswith("seed=1 -EntityOverlap->10 (e=0.206) -SameGoal->11")
    assert set(got) == {1, 2, 10, 11}


def test_spreading_is_that_of_a_plain_model(spark):
    rng = random.Random(4)
    rows = {(a, b): edge(a, b, rng.choice(["Causal", "TopicRelated", "EntityOverlap"]), rng.randint(30, 100) / 100, rng.randint(50, 100) / 100) for a, b in ((rng.randrange(25), rng.randrange(25)) for _ in range(150)) if a != b}
    start = [(1, i, 0.5 - i / 50, 1.0 - i / 10) for i in range(4)]
    reached = {i: e for _, i, e, _ in start}
    frontier = [(i, e) for _, i, e, _ in start]
    weight = {"Causal": 1.3, "TopicRelated": 0.85, "EntityOverlap": 1.0}
    for hop in (1, 2, 3):
        met = {}
        for node, e in frontier:
            for r in sorted((r for r in rows.values() if r[0] == node), key=lambda r: (-round(r[3] * r[4], 9), r[1], r[2]))[:6]:
                x = min(1.0, e * r[3] * r[4] * 0.55**hop * weight[r[2]])
                if r[1] not in reached and x >= 0.05:
                    met[r[1]] = max(met[r[1]], x) + 0.3 * min(met[r[1]], x) if r[1] in met else x
        frontier = sorted(met.items(), key=lambda r: (-round(r[1], 9), r[0]))
        reached |= met
    got = spreading.spread(spark.createDataFrame(start, "query_id int, id long, energy double, fused double"), spark.createDataFrame(list(rows.values()), EDGE), hops=3).collect()
    assert {r.id: round(r.energy, 9) for r in got} == {i: round(e, 9) for i, e in reached.items()}


def test_scalars(spark):
    assert one(spark, scores.merge_energies(F.array(*map(F.lit, (0.5, 0.3, 0.4))))) == pytest.approx(0.71)
    assert one(spark, scores.cold_start(F.lit(750))) == pytest.approx(0.8)
    for s, days, n, want in ((0.8, 1, 0, 0.4), (0.8, 8, 3, 0.4), (0.8, 3, 1, 0.282843)):
        assert one(spark, scores.forget(F.lit(s), F.lit(days * DAY), F.lit(n))) == pytest.approx(want, abs=1e-6)
    assert one(spark, rerank.context_correction(F.lit(1.0), F.lit(0.25))) == 1.125
    assert one(spark, rerank.coverage_correction(F.lit(1.0), F.array(*map(F.lit, "abc")), F.array(F.lit("a"), F.lit("b")))) == pytest.approx(1.133333, abs=1e-6)
    assert one(spark, scores.clamp01(F.lit(float("nan")))) == 0.0
    for word in ("rust", "", "größe", "中文"):
        assert one(spark, signatures.stable_hash(F.lit(word))) % (1 << 64) == xxhash.xxh3_64_intdigest(word)
    v = one(spark, signatures.hash_embedding(F.lit("a b")))
    assert sum(x * x for x in v) == pytest.approx(1.0)


def test_text(spark):
    assert one(spark, text.entities(F.lit("The (Rust) compiler of Mozilla, X"))) == ["the", "rust", "mozilla"]
    assert one(spark, text.question_type(F.lit("Why did it fail"))) == "Why"
    assert one(spark, text.question_type(F.lit("之前 A 后来 B"))) == "Correction"
    c = one(spark, text.causal(F.lit("It failed because the disk was full so we stopped")))
    assert (c.cause, c.effect) == ("the disk was full", "we stopped")
    assert one(spark, text.causal(F.lit("so it was because"))) is None
    assert one(spark, text.first_label(F.lit("I avoid it"), [("avoid", "Negative")])) == "Negative"


def test_learning(spark):
    log = spark.createDataFrame([(1, 0, 1.0), (2, 3_599_999, 0.5), (3, 3_600_000, 0.8), (1, 10, 0.5)], "memory_id long, ts_ms long, weight double")
    got = {(r.a, r.b): round(r.weight, 6) for r in learning.coactivation_pairs(log).collect()}
    assert got == {(1, 2): 1.0, (2, 3): 0.5, (1, 3): 0.5}
    graph = spark.createDataFrame([edge(1, 2, s=0.8, at=0, n=0), edge(1, 3, "Causal", s=0.1), edge(2, 3, s=0.13, observing=True)], EDGE)
    faded = {(r.src, r.dst): round(r.strength, 6) for r in learning.decay(graph, DAY).collect()}
    assert faded == {(1, 2): 0.4, (1, 3): 0.1}
    pairs = spark.createDataFrame([(1, 2, 4.0), (5, 6, 3.0), (1, 3, 2.0)], "a long, b long, weight double")
    assert {(r.src, r.dst): round(r.strength, 6) for r in learning.hebbian(graph, pairs).collect()}[1, 2] == 1.0
    assert [(r.src, r.dst, r.link_type) for r in learning.new_edges(graph, pairs.where("a = 5"), 0).collect()] == [(5, 6, "CoActivation")]
    weak = {(r.src, r.dst): round(r.strength, 6) for r in learning.reject(graph, spark.createDataFrame([(3,)], "id long")).collect()}
    assert weak == {(1, 2): 0.8, (1, 3): 0.12, (2, 3): 0.12}
    assert learning.compact(spark.createDataFrame([edge(1, i, s=0.5 + i / 1000) for i in range(2, 102)], EDGE)).count() == 64


def test_leaders(spark):
    rng = random.Random(2)
    words = [f"t{i}" for i in range(12)]
    rows = [(i, " ".join(sorted(rng.sample(words, rng.randint(8, 12))))) for i in range(60)]
    heads, want = [], {}
    for i, t in rows:
        s = set(t.split())
        want[i] = next((j for j, h in heads if len(s & h) / len(s | h) >= 0.7), i)
        if want[i] == i:
            heads.append((i, s))
    got = summaries.leaders(spark.createDataFrame(rows, "id long, text string"))
    assert {r.id: r.leader for r in got.collect()} == want


def test_keywords(spark):
    words = lambda q: one(spark, text.keywords(F.lit(q)))
    assert words("compare redb with gRPC") == ["compare", "redb", "gRPC"]
    assert words("What is the BM25 of it? The OOM") == ["BM25", "OOM"]
    assert words("价格 变化 是 什么 x1 y") == ["价格", "变化"]
    assert words("one two three four five six") == ["one", "two", "three", "four", "five"]


def test_segments(spark):
    assert one(spark, text.segments(F.lit("Rust 数据库引擎 很快"))) == ["rust", "数据", "据库", "库引", "引擎", "很快"]


def test_texts_without_sql(spark):
    """What hashing keeps from SQL, against plain Python over the whole table."""
    rows = {r.id: r.text for r in queries.memories(spark, SF).collect()}
    for r in queries.QUERIES["stable_hash"](spark, SF).collect():
        assert r.hash % (1 << 64) == xxhash.xxh3_64_intdigest(rows[r.id])
    known = {r.id: r.embedding for r in queries.QUERIES["hash_embed"](spark, SF).collect()}
    assert set(known) == set(rows)
    for i in list(rows)[::20]:
        v = np.zeros(signatures.DIM)
        for token in re.split(text.BETWEEN, rows[i].lower()):
            if token:
                h = xxhash.xxh3_64_intdigest(token).to_bytes(8, "little")
                v += [(xxhash.xxh3_64_intdigest(h + d.to_bytes(8, "little")) % 2000 - 1000) / 1000 for d in range(signatures.DIM)]
        assert np.allclose(known[i], v / np.linalg.norm(v))


def test_nearest_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = rng.integers(-3, 4, (60, 5)).astype(float)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)], "id long, embedding array<double>")
    monkeypatch.setattr(channels, "QUERY_BLOCK", 4)
    monkeypatch.setattr(channels, "DISTANCES", 16)
    q = rows.where("id % 6 = 0 and embedding is not null").select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
    got = {}
    for r in channels.dense_channel(q, rows, 7).collect():
        got.setdefault(r.query_id, []).append((r.ord, r.id))
    want = {i: [(n, j) for n, (_, j) in enumerate(sorted((((v[i] - x) ** 2).sum(), j) for j, x in enumerate(v))[:7])] for i in range(0, 60, 6)}
    assert {i: sorted(x) for i, x in got.items()} == want
    assert channels.dense_channel(q.limit(0), rows, 7).count() == 0
    codes = rows.where("embedding is not null").select("id", scores.sign_code(F.col("embedding")).alias("code"))
    own = codes.select(F.col("id").alias("query_id"), F.col("code").alias("q"))
    assert channels.binary_channel(own, codes, 3).where("ord = 0 and score < 1").count() == 0


def test_top_k_limits_before_the_shuffle(spark):
    for name in ("entity_channel", "dense_knn_topk", "channel_rank"):
        plan_ = queries.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert "WindowGroupLimit" in plan_, name


def test_hot_keys_meet_in_blocks(spark, monkeypatch):
    post = spark.createDataFrame([("entity", "hot", i) for i in range(40)] + [("topic", "cold", i) for i in range(35, 45)], "dim string, key string, id long")
    whole = {tuple(r) for r in association.candidate_pairs(post).collect()}
    log = spark.createDataFrame([(i % 9, i * 60_000, 0.5 + i % 3) for i in range(150)], "memory_id long, ts_ms long, weight double")
    pairs = {tuple(r) for r in learning.coactivation_pairs(log).collect()}
    monkeypatch.setattr(blocks.split, "__defaults__", (7,))
    assert {tuple(r) for r in association.candidate_pairs(post).collect()} == whole and len(whole) == 40 * 39 // 2 + 10 * 9 // 2 - 10
    assert {tuple(r) for r in learning.coactivation_pairs(log).collect()} == pairs
    new = {tuple(r) for r in association.candidate_pairs(post, new=post.where("id > 41")).collect()}
    assert new == {p for p in whole if p[0] > 41}


def test_usage_goes_on(spark):
    rng = random.Random(7)
    rows = [(m, rng.randrange(5 * DAY), e, rng.choice(["Referenced", "UserConfirmedCorrect", "UserRejected", "TaskSucceeded"])) for m in range(4) for e in range(60)]
    rows.sort(key=lambda r: (r[1], r[2]))
    want = dict.fromkeys(range(4), 0.5)
    for m, _, _, s in rows:
        want[m] = min(1.0, max(0.0, want[m] + params.USAGE_DELTA[s]))
    frame = lambda part: spark.createDataFrame(part, "memory_id long, ts_ms long, event_id long, signal string")
    half = next(i for i in range(120, 240) if rows[i][1] > rows[i - 1][1])
    once = {r.memory_id: r.usage_score for r in learning.usage(frame(rows)).collect()}
    twice = {r.memory_id: r.usage_score for r in learning.usage(frame(rows[half:]), learning.usage(frame(rows[:half]))).collect()}
    assert once == pytest.approx(want) and twice == pytest.approx(want)


def test_channel_maxima_and_energy(spark):
    seeds = spark.createDataFrame([(1, 1, "Bm25", 0.9), (1, 2, "Bm25", 0.4), (1, 1, "Goal", 0.15)], "query_id int, id int, channel string, score double")
    assert {(r.channel, r.score) for r in fusion.maxima(seeds).collect()} == {("Bm25", 0.9), ("Goal", 0.15)}
    reached = spreading.spread_seeds(seeds.withColumn("rank", F.lit(None).cast("int")), spark.createDataFrame([edge(1, 9)], EDGE), spark.createDataFrame([(1, 0.5)], "id int, importance double"))
    assert {r.id: round(r.energy, 4) for r in reached.collect()} == {1: 0.52, 2: 0.1778, 9: round(0.52 * 0.81 * 0.55, 4)}
    rows = metrics.averages(spark.createDataFrame([(1.0, 0.5, 1, 1.0, 0.5), (0.0, 0.5, 0, 0.0, 0.5)], "recall double, precision double, hit int, rr double, ndcg double"))
    assert tuple(rows.first()) == (0.5, 0.5, 0.5, 0.5, 0.5)


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_queries(spark, name):
    df = queries.QUERIES[name](spark, SF)
    c = duckdb.connect()
    for t in ("documents", "conversations", "benchmark", "labels", "embeddings", "events", "lineitem", "part"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    r = c.execute(queries.ORACLE_SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, map(tuple, df.select(*names).collect()))) == sorted(map(repr, map(tuple, r.fetchall())))


def test_queries_without_sql():
    assert set(queries.QUERIES) - set(queries.ORACLE_SQL) == {"hash_embed", "stable_hash"}  # see test_texts_without_sql


def memories(spark, rows):
    return spark.createDataFrame([(i, t, "UserStatement", 1_700_000_000_000 + i * 1000, 1, None, None, None) for i, t in rows], RAW)


def test_engine(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/store")
    engine.write(memories(spark, [(1, "Rust is fast because of Zig so we use Rust"), (2, "Rust borrows ideas"), (3, "Bread recipe")]), 0)
    engine.write(memories(spark, [(4, "Rust compiler release")]), 0)
    with pytest.raises(RecordExists):
        engine.write(memories(spark, [(4, "again")]), 0)
    assert {(r.src, r.dst) for r in engine.store.read("edge").where("link_type = 'EntityOverlap'").collect()} == {(2, 1), (4, 1), (4, 2)}
    out = engine.retrieve(spark.createDataFrame([(1, "Tell me about Rust")], "query_id long, text string"), 1_700_000_000_000, 3).collect()
    assert [r.rank for r in out] == [1, 2, 3] and out[0].id in (1, 2, 4)
    engine.feedback(spark.createDataFrame([(1, 1, 5, "UserConfirmedCorrect"), (1, 3, 6, "UserRejected")], "retrieval_id long, memory_id long, ts_ms long, signal string"))
    report = engine.consolidate(DAY)
    assert report["edges_before"] >= 3
    assert [r.id for r in engine.list(2).collect()] == [4, 3] and [r.id for r in engine.list(2, cursor=3).collect()] == [2, 1]
    assert engine.inspect("stats").first().n_memories == 4
    assert engine.explain().count() == 4 and engine.summarise().count() == 0
    assert {r.id for r in engine.traverse(spark.createDataFrame([(4,)], "id long"), "out", 2).collect()} >= {4, 2}
    assert json.loads(engine.dump().where("value like '%Bread%'").first().value)["id"] == 3
    engine.reindex(0)
    assert engine.inspect("stats").first().n_memories == 4
    engine.clear()
    assert engine.store.version("unit") == 0


def test_summaries_are_written_back(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/store")
    engine.write(memories(spark, [(i, f"Alpha stops. Beta waits long! No one knows v{i}") for i in range(1, 13)] + [(20, "Alpha notes"), (21, "Bread recipe")]), 0)
    assert engine.consolidate(DAY)["summaries_new"] == 1
    units = {r.id: r for r in engine.store.read("unit").collect()}
    assert sorted(units) == [*range(1, 13), 20, 21, 22] and units[22].content_type == "Reflection"
    assert units[22].text == "No one knows v1No one knows v2Beta waits long!" and units[22].importance == 0.5
    for _ in range(2):
        rows = engine.store.read("unit").collect()
        assert {r.id for r in rows if r.lifecycle == "Compressed"} == set(range(1, 13)) and [r.id for r in rows if r.generated_by == "Consolidation"] == [22]
        edges = {(r.src, r.dst) for r in engine.store.read("edge").collect()}
        assert (20, 22) in edges and not any(b < 13 or a == 22 for a, b in edges)
        engine.reindex(0)
    assert engine.compress(DAY) == 0


QUERY = "query_id long, text string"
SIGNALS = "retrieval_id long, memory_id long, ts_ms long, signal string"


def test_engine_learns_from_feedback(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/store", models=hooks.DIGEST)
    engine.write(memories(spark, [(1, "Rust is fast because of Zig so we use Rust"), (2, "Rust borrows ideas"), (3, "Bread recipe"), (4, "Zig and Bread")]), 0)
    assert not engine.degraded
    ask = spark.createDataFrame([(7, "Tell me about Rust")], QUERY)
    first = {r.id: r for r in engine.retrieve(ask, DAY, 10).collect()}
    assert {"path"}.isdisjoint(engine.retrieve(ask, DAY).columns) and set(first) == {1, 2, 3, 4}
    engine.feedback(spark.createDataFrame([(7, 2, DAY, "UserConfirmedCorrect"), (7, 3, DAY + 1, "UserRejected")], SIGNALS), DAY)
    assert {r.memory_id: round(r.usage_score, 2) for r in engine.store.read("usage").collect()} == {2: 0.6, 3: 0.4}
    links = {(r.feature, r.memory_id): r.strength for r in engine.store.read("context_link").collect()}
    assert ("entity:rust", 2) in links and set(links.values()) == {0.25}
    again = {r.id: r for r in engine.retrieve(ask, DAY, 10).collect()}
    assert again[2].score == pytest.approx(first[2].score * 1.125) and again[1].score == pytest.approx(first[1].score)
    other = {r.id: r.score for r in engine.retrieve(spark.createDataFrame([(8, "how is Bread made")], QUERY), DAY, 10).collect()}
    plain = {r.id: r.score for r in plan.retrieve(spark.createDataFrame([(8, "how is Bread made")], QUERY), plan.Tables(*map(engine.store.read, ("unit", "posting", "edge", "term", "vector"))), DAY, 10, models=hooks.DIGEST).collect()}
    assert other == pytest.approx(plain)  # links of other features lift nothing
    assert engine.coactivation().where("memory_id = 1 and other = 2").first().n >= 1
    assert engine.explain(2).first().retrieval_count >= 2
    with pytest.raises(NotFound):
        engine.explain(99)
    with pytest.raises(NotFound):
        engine.traverse(spark.createDataFrame([(99,)], "id long"))
    assert {(r.src, r.dst) for r in engine.traverse_edges(spark.createDataFrame([(4,)], "id long")).collect()} == {(r.src, r.dst) for r in engine.store.read("edge").where("src = 4").collect()}
    assert {r.preview for r in engine.traverse_nodes(spark.createDataFrame([(4,)], "id long")).collect()} >= {"Zig and Bread"}
    assert {r.state for r in engine.inspect("edges").collect()} <= {"Observing", "Confirmed"}
    assert engine.query_context(spark.createDataFrame([(7,)], "retrieval_id long")).count() > 0 == engine.retrieval_paths(spark.createDataFrame([(1234,)], "retrieval_id long")).count()
    vector = engine.store.read("vector").where("id = 3").select("id", F.transform("embedding", lambda x: -x).alias("embedding"))
    engine.put_vectors(vector)
    with pytest.raises(ValueError):
        engine.put_vectors(spark.createDataFrame([(3, [1.0])], "id long, embedding array<double>"))
    engine.remove_vectors(spark.createDataFrame([(1,)], "id long"))
    kept = {r.id: r.embedding for r in engine.store.read("vector").collect()}
    assert set(kept) == {2, 3, 4} and kept[3] == vector.first().embedding
    page, cursor, total = engine.list_info(3)
    assert ([r.id for r in page.collect()], cursor, total) == ([4, 3, 2], 2, 4) and engine.list_info(3, cursor=2)[1] is None
    assert {r.id for r in engine.get(spark.createDataFrame([(2,), (50,)], "id long")).collect()} == {2}
    assert {k: engine.inspect(k).count() > 0 for k in ("stats", "units", "postings", "channel", "edges", "strongest", "in_edges")} == dict.fromkeys(("stats", "units", "postings", "channel", "edges", "strongest", "in_edges"), True)


def test_paths_are_reinforced(spark, tmp_path):
    """A confirmed result that was reached over an edge strengthens the first edge of its path."""
    engine = Engine(spark, f"file://{tmp_path}/store", models=hooks.DIGEST)
    engine.write(memories(spark, [(1, "Alpha one"), (2, "Omega two")]), 0)
    engine.store.replace("edge", engine.store.read("edge").limit(0).unionByName(spark.createDataFrame([(1, 2, "Causal", 0.5, 0.9, False, 0, 0, 0)], engine.store.read("edge").schema)))
    engine.store.append("retrieval_path", spark.createDataFrame([(5, 1, 2)], "retrieval_id long, src long, dst long"))
    engine.store.append("query_context", spark.createDataFrame([(5, "entity:alpha")], "retrieval_id long, feature string"))
    engine.feedback(spark.createDataFrame([(5, 2, 3, "Referenced")], SIGNALS), 9)
    e = engine.store.read("edge").first()
    assert (e.strength, e.activation_count, e.last_activated_at) == (0.75, 1, 9)


def test_consolidation_learns_once(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/store", models=hooks.DIGEST)
    engine.write(memories(spark, [(1, "Rust a"), (2, "Rust b")]), 0)
    engine.feedback(spark.createDataFrame([(r, m, r, "UserConfirmedCorrect") for r in range(4) for m in (1, 2)], SIGNALS))
    strength = lambda: engine.store.read("edge").where("src = 2 and dst = 1 and link_type = 'EntityOverlap'").first().strength
    before = strength()
    report = engine.consolidate(5)
    grown = strength()
    assert grown > before and report["edges_new"] == 1 and report["edges_reinforced"] >= 1
    assert [engine.consolidate(5)["edges_reinforced"] for _ in range(2)] == [0, 0] and strength() == pytest.approx(grown)
    replaying = Engine(spark, engine.store.root, params.Params(replay_log=True), hooks.DIGEST)
    assert replaying.consolidate(5)["edges_reinforced"] >= 1
    assert engine.consolidate(40 * DAY, "EdgesOnly")["edges_archived"] == engine.store.log("edge_archive").where("epoch = 4").count()


def test_fallback_and_lifecycles(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/store", models=hooks.DIGEST)
    engine.write(memories(spark, [(i, f"Alpha note {i}") for i in range(1, 6)]), 0)
    unit = engine.store.read("unit")
    engine.store.replace("unit", unit.withColumn("lifecycle", F.when(F.col("id") == 1, "Compressed").when(F.col("id") == 2, "Deprecated").otherwise("Active")))
    none = engine.retrieve(spark.createDataFrame([(1, "?!")], QUERY), 900 * DAY, 10).collect()
    assert {r.id for r in none} == {2, 3, 4, 5} and {r.channel for r in none if r.hop == 0} == {"RecentActivation"}
    some = {r.id: r for r in engine.retrieve(spark.createDataFrame([(2, "Alpha note")], QUERY), DAY, 10).collect()}
    assert 1 not in some and "Deprecated" in some[2].warnings and "Deprecated" not in some[3].warnings


def test_writes_add_to_the_store(spark, tmp_path):
    """Batches one after another give what one batch gives."""
    texts = [(i, f"Alpha {'Beta' if i % 2 else 'Gamma'} item {i}") for i in range(1, 7)]
    one_, many = (Engine(spark, f"file://{tmp_path}/{n}", models=hooks.DIGEST) for n in "ab")
    one_.write(memories(spark, texts), 0)
    for t in texts:
        many.write(memories(spark, [t]), 0)
    for name in ("posting", "term", "unit", "vector"):
        assert {str(r) for r in one_.store.read(name).select(sorted(one_.store.read(name).columns)).collect()} == {str(r) for r in many.store.read(name).select(sorted(one_.store.read(name).columns)).collect()}, name
    key = lambda e: {(r.src, r.dst, r.link_type) for r in e.store.read("edge").collect()}
    assert key(one_) == key(many)


def test_snapshots_merge(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Warehouse, "PARTS", 2)
    store = Warehouse(spark, f"file://{tmp_path}/s")
    for i in range(5):
        store.add("t", spark.range(i, i + 1)) if i else store.replace("t", spark.range(1))
    assert sorted(r.id for r in store.read("t").collect()) == [0, 1, 2, 3, 4] and store.version("t") == 5


def test_no_machine_local_folder_on_a_cluster(monkeypatch):
    class Conf(dict):
        def set(self, k, v):
            self[k] = v

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    class Frame:
        sparkSession = Session()

    with pytest.raises(ValueError, match="share"):
        warehouse.stored(Frame())


def test_backends_and_environment(monkeypatch):
    assert hooks.models("digest") is hooks.DIGEST
    with pytest.raises(ValueError):
        hooks.models("neural")
    monkeypatch.setenv("ASSOCSPARK__MAX_HOPS", "4")
    monkeypatch.setenv("ASSOCSPARK__REPLAY_LOG", "true")
    assert params.from_environment() == params.Params(max_hops=4, replay_log=True)
    monkeypatch.setenv("ASSOCSPARK__NOTHING", "1")
    with pytest.raises(ValueError):
        params.from_environment()


def test_rerank_hook(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/store", models=hooks.models("lexical"))
    engine.write(memories(spark, [(1, "Rust borrows"), (2, "Rust compiler speed")]), 0)
    out = {r.id: r.score for r in engine.retrieve(spark.createDataFrame([(1, "Rust compiler speed")], QUERY), 0).collect()}
    assert out[2] > out[1] and browse.unit_stats(engine.store.read("unit"), engine.store.read("edge")).first().n_memories == 2


def test_command_line(spark, tmp_path):
    run = lambda *args: cli.call(spark, ["--store", f"file://{tmp_path}/store", "--now-ms", "5", *args])
    assert [run("write", t)["id"] for t in ("Rust is fast", "Rust borrows ideas")] == [1, 2]
    assert [r.id for r in run("list", "--limit", "1").collect()] == [2]
    assert run("retrieve", "about Rust", "--top-k", "1").count() == 1 and run("explain", "1").first().id == 1
    run("clear")
    assert Engine(spark, f"file://{tmp_path}/store").store.version("unit") == 0


def test_streams(spark, tmp_path):
    memories(spark, [(1, "Rust a"), (2, "Rust b")]).write.parquet(f"{tmp_path}/in")
    engine = Engine(spark, f"file://{tmp_path}/store")
    feeds.ingest(spark.readStream.schema(RAW).parquet(f"{tmp_path}/in"), engine, f"{tmp_path}/ck", 0).awaitTermination()
    assert engine.store.read("unit").count() == 2
    spark.createDataFrame([("2024-01-01 00:10:00", 1, "Referenced")], "ts string, memory_id long, signal string").selectExpr("cast(ts as timestamp) ts", "memory_id", "signal").write.parquet(f"{tmp_path}/ev")
    stream = spark.readStream.schema("ts timestamp, memory_id long, signal string").parquet(f"{tmp_path}/ev")
    q = feeds.signal_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT n FROM counts").first().n == 1


@pytest.mark.parametrize("first", [True, False])
def test_streams_recover(spark, tmp_path, first, monkeypatch):
    """A batch that was cut short between the log and the derivation is whole after a rerun, be it the first batch or a later one."""
    memories(spark, [(1, "Rust a"), (2, "Rust b")]).write.parquet(f"{tmp_path}/in")
    engine = Engine(spark, f"file://{tmp_path}/store", models=hooks.DIGEST)
    stream = lambda: feeds.ingest(spark.readStream.schema(RAW).parquet(f"{tmp_path}/in"), engine, f"{tmp_path}/ck", 0)
    if not first:
        stream().awaitTermination()
        memories(spark, [(3, "Rust c"), (4, "Rust d")]).write.mode("append").parquet(f"{tmp_path}/in")

    def crash(*_):
        raise RuntimeError("lost")

    for step in ("recover", "_put"):
        monkeypatch.setattr(engine, step, crash)
        with pytest.raises(Exception, match="lost"):
            stream().awaitTermination()
        monkeypatch.undo()
    stream().awaitTermination()
    ids = {1, 2} if first else {1, 2, 3, 4}
    assert {r.id for r in engine.store.log("memory").collect()} == ids == {r.id for r in engine.store.read("unit").collect()}
    assert engine.store.log("memory").count() == engine.store.read("unit").count() == len(ids)
    assert {r.id for r in engine.store.read("posting").select("id").collect()} == ids


def test_feedback_stream(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/store", models=hooks.DIGEST)
    engine.write(memories(spark, [(1, "Rust a")]), 0)
    spark.createDataFrame([(1, 1, 5, "UserConfirmedCorrect")], SIGNALS).write.parquet(f"{tmp_path}/ev")
    for _ in range(2):
        feeds.feedback(spark.readStream.schema(SIGNALS).parquet(f"{tmp_path}/ev"), engine, f"{tmp_path}/ck").awaitTermination()
    assert engine.store.read("usage").first().usage_score == pytest.approx(0.6)


def test_fixtures(spark, tmp_path):
    (tmp_path / "en").mkdir()
    (tmp_path / "en/a.json").write_text(json.dumps({"case_id": "c1", "task_type": "FactRecall", "writes": [{"local_id": "m1", "content": "x", "n": 3}, {"local_id": "m2", "content": "y"}]}))
    cases = fixtures.read(spark, str(tmp_path), fixtures.CASE)
    assert cases.first().locale == "en" and fixtures.writes(cases).count() == 4
