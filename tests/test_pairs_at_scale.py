"""Queries on pairs: what grows with the square of the memories is never shuffled, and blocks lose nothing."""

from __future__ import annotations

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from assocspark import queries, retrieval_queries
from assocspark.operators import association, learning, summaries
from assocspark.params import DEFAULT

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles_pairs(text: str) -> bool:
    return any(f"hashpartitioning({c}" in text for c in ("src", "dst", "a#", "b#"))


def texts(spark, n=60):
    rows = [(i * 3, " ".join(f"w{(i * k) % (5 + k)}" for k in range(1, 2 + i % 9)) + (" Onhe" if i % 4 == 0 else ""), (i % 5) * 604_800_000 if i % 3 else None) for i in range(1, n)]
    return spark.createDataFrame(rows, "id long, text string, created_at_ms long").withColumn("content_type", F.lit("UserStatement"))


@pytest.mark.parametrize("blocks", [256, 2])
def test_closest_pairs_of_blocks(spark, monkeypatch, blocks):  # F4
    from assocspark.operators import grid

    monkeypatch.setattr(grid, "ROWS", 7)
    monkeypatch.setattr(grid, "BLOCKS", blocks)
    units = association.understand(texts(spark)).localCheckpoint()
    post = association.postings(units).where("dim in ('entity', 'topic', 'temporal')").localCheckpoint()
    code = {r.id: r.simhash & (2**64 - 1) for r in units.select("id", "simhash").collect()}
    shared = {(r.src, r.dst) for r in post.withColumnRenamed("id", "src").join(post.withColumnRenamed("id", "dst"), ["dim", "key"]).where("dst < src").collect()}
    best = {}
    for src, dst in shared:
        best.setdefault(src, []).append((bin(code[src] ^ code[dst]).count("1"), dst))
    want = {(src, dst): 1 - d / 64 for src, rows in best.items() for d, dst in sorted(rows)[:5]}
    p = type(DEFAULT)(max_candidates=5)
    closest = association.candidate_pairs(post, units=units, best=5)
    got = association.pair_features(closest, units, p)
    assert ("a" in closest.columns) == (blocks == 256)
    rows = got.collect()
    assert len(rows) == len(want) and {(r.src, r.dst): r.lexical for r in rows} == want
    joined = association.pair_features(association.candidate_pairs(post, units=units), units, p)
    assert sorted(map(str, rows)) == sorted(map(str, joined.collect()))
    assert {(r.src, r.dst) for r in association.candidate_pairs(post).collect()} == shared


def test_features_are_made_where_pairs_meet(spark):  # F4
    assert not shuffles_pairs(plan(queries.QUERIES["pair_features"](spark, SF)))


def test_scores_are_made_where_pairs_meet(spark):  # F1
    assert not shuffles_pairs(plan(queries.QUERIES["assoc_score"](spark, SF)))


def test_edges_are_made_where_pairs_meet(spark):  # F3
    rows = queries.QUERIES["edge_build"](spark, SF)
    assert not shuffles_pairs(plan(rows))
    assert rows.count() == rows.dropDuplicates(["src", "dst"]).count() > 0


def test_all_pairs_leave_their_blocks_once(spark):  # F2
    rows = queries.QUERIES["candidate_pairs"](spark, SF)
    assert not shuffles_pairs(plan(rows))
    assert rows.count() == rows.distinct().count() > 0


def test_retrieval_keeps_pairs_where_they_meet(spark, monkeypatch):  # F6
    seen, stored = [], retrieval_queries.stored
    monkeypatch.setattr(retrieval_queries, "stored", lambda df: seen.append((df.columns, plan(df))) or stored(df))
    queries.QUERIES["retrieve_topk"](spark, SF)
    edges = [text for columns, text in seen if "link_type" in columns]
    assert len(edges) == 1 and not shuffles_pairs(edges[0])


def brute_coactivation(rows, window):
    out = {}
    for n, (x, t, w) in enumerate(rows):
        for y, u, v in rows[:n]:
            if x != y and abs(t - u) < window:
                k = (min(x, y), max(x, y))
                out[k] = out.get(k, 0) + min(w, v)
    return {k: round(v, 6) for k, v in out.items()}


def test_coactivation_shuffles_events_not_pairs(spark, monkeypatch):  # F8
    from assocspark.operators import blocks

    rows = [(i * 7 % 23, i * i * 9_000 % 40_000_000, (0.5, 0.8, 1.0)[i % 3]) for i in range(600)]
    log = spark.createDataFrame(rows, "memory_id long, ts_ms long, weight double")
    want = brute_coactivation(rows, DEFAULT.pair_window_ms)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")  # windows that span batches
        for size in (2_048, 5):
            monkeypatch.setattr(blocks.split, "__defaults__", (size,))
            got = learning.coactivation_pairs(log)
            assert {(r.a, r.b): round(r.weight, 6) for r in got.collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    text = plan(got)
    assert "bucket" not in text and "least(memory_id" not in text


def test_cycle_works_out_pairs_once(spark):  # F9
    text = plan(queries.QUERIES["consolidate_cycle"](spark, SF))
    assert "bucket" not in text and "ts_ms" not in text


def test_similar_sets_join_tokens_not_sets(spark, monkeypatch):  # F5
    monkeypatch.setattr(summaries.similar, "MEMBERS", 3)
    rows = [(i, " ".join(f"t{(i // 8 * 31 + k) % 97}" for k in range(3 + i // 8 % 40) if (k * 7 + i) % (5 + i % 8) or i % 8 < 4)) for i in range(400)]
    rows += [(1000, "..."), (1001, None), (1002, "t1"), (1003, "t1 t1"), (1004, "T1")]
    d = spark.createDataFrame(rows, "id long, text string")
    sets = {i: set(t.lower().split()) for i, t in rows if t and t != "..."}
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 7 * len(sets[a] | sets[b])}
    found = summaries.similar_pairs(d)
    got = [(r.a, r.b) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 500
    assert "collect_list(struct(df" not in plan(found)


def test_leaders_of_equal_sets_make_no_pairs(spark, monkeypatch):  # F7
    seen, pairs = [], summaries.similar.pairs
    monkeypatch.setattr(summaries.similar, "pairs", lambda sets, t: seen.append(sets.count()) or pairs(sets, t))
    rows = [(i, f"a b c d e f g h i {'j' if i % 3 else 'k'}") for i in range(90)] + [(200, ""), (201, "..."), (202, "z")]
    got = {r.id: r.leader for r in summaries.leaders(spark.createDataFrame(rows, "id long, text string")).collect()}
    assert got == {**{i: 0 for i in range(90)}, 200: 200, 201: 201, 202: 202} and seen == [3]


def greedy(sets, t=7):
    """Leaders by brute force: (id: leader)."""
    heads, out = [], {}
    for i in sorted(sets):
        near = [h for h in heads if sets[i] and 10 * len(sets[i] & sets[h]) >= t * len(sets[i] | sets[h])]
        out[i] = min(near, default=i)
        heads += [] if near else [i]
    return out


def test_near_copies_are_held_against_leaders(spark, monkeypatch):  # F7
    rnd = random.Random(7)
    base = [f"g{k}" for k in range(30)]
    rows = {}
    for i in range(400):
        if i % 4 == 0:  # one group of near copies, some of which are not similar to its leader
            rows[i] = [w if rnd.random() > 0.12 else f"x{i % 50}" for w in base] + [f"y{i}"]
        else:
            rows[i] = [f"o{rnd.randrange(40)}" for _ in range(6)] + [f"z{i // 7}"]
    rows |= {1000 + v: [f"c{v + k}" for k in range(12)] for v in range(24)}  # a chain: each is similar to its neighbours only
    sets = {i: set(w) for i, w in rows.items()}
    made, seen = [], summaries.similar.Index.similar

    def similar(self, a, b):
        out = seen(self, a, b)
        made.append(out.count())
        return out

    monkeypatch.setattr(summaries.similar.Index, "similar", similar)
    for dense, step in ((16, 16), (1, 4)):
        monkeypatch.setattr(summaries.similar, "DENSE", dense)
        monkeypatch.setattr(summaries.similar, "STEP", step)
        made.clear()
        found = summaries.leaders(spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], "id long, text string"))
        assert {r.id: r.leader for r in found.collect()} == greedy(sets)
        if dense == 1:
            fewer = sum(made)
        elif dense == 16:
            whole = sum(made)
    assert fewer < whole


@pytest.mark.parametrize("size", [2_048, 3])
def test_cycle_decides_where_pairs_meet(spark, monkeypatch, size):  # F9
    from assocspark.operators import blocks

    monkeypatch.setattr(blocks.split, "__defaults__", (size,))
    now, p = queries.NOW, replace(DEFAULT, max_degree=3)
    signal = ("UserConfirmedCorrect", "Referenced", "retrieve", "UserRejected")
    log = [(i * 7 % 24, i * i * 90_000 % 40_000_000, signal[i % 4] if i * 7 % 24 % 3 else signal[i % 3]) for i in range(500)] + [(50, None, "Referenced"), (51, 5, "UserRejected")]
    log = spark.createDataFrame(log, "memory_id long, ts_ms long, signal string")
    kinds = ("CoActivation", "Causal", "EntityOverlap")
    rows = [(i, j, kinds[(i + j) % 3], (i * 5 + j) % 9 / 9, 0.5, (i + j) % 4 == 0, now - (i + j) % 5 * 86_400_000, (i + j) % 3) for i in range(0, 30, 2) for j in range(0, 52, 3) if i != j]
    edges = spark.createDataFrame(rows, "src long, dst long, link_type string, strength double, confidence double, observing boolean, last_activated_at long, activation_count long")
    pairs = learning.coactivation_pairs(learning.weighted(log), p).localCheckpoint()
    grown = learning.hebbian(edges, pairs, p).unionByName(learning.new_edges(edges, pairs, now, p))
    rejected = log.where("signal = 'UserRejected'").select(F.col("memory_id").alias("id"))
    want = learning.compact(learning.decay(learning.reject(grown, rejected, p), now, p), p)
    made, seen = [], learning.stored
    monkeypatch.setattr(learning, "stored", lambda d: made.append(seen(d)) or made[-1])
    got = learning.cycle(edges, log, now, p)
    key = lambda d: sorted((r.src, r.dst, r.link_type, round(r.strength, 9), r.observing, r.activation_count) for r in d.collect())
    assert key(got) == key(want) and any(r[2] == "CoActivation" and r[4] for r in key(got))
    changes = [d for d in made if "known" in d.columns]
    assert len(changes) == 1 and 0 < changes[0].where("known").count() < pairs.where("weight >= 3").count()
    assert changes[0].count() < pairs.where("weight >= 3").count() or size == 3


def test_pairs_store_neither_texts_nor_vectors(spark, monkeypatch):  # F1
    from assocspark.operators import grid

    seen, let_go = [], []
    kept = lambda f: lambda d: seen.append(set(d.columns)) or f(d)
    monkeypatch.setattr(retrieval_queries, "stored", kept(retrieval_queries.stored))
    monkeypatch.setattr(grid, "release", let_go.append, raising=False)
    assert queries.QUERIES["assoc_score"](spark, SF).count() > 0
    assert len(seen) == 1 and not seen[0] & {"text", "embedding"} and len(let_go) == 1
