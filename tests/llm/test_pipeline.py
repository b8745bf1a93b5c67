"""The stages of the corpus pipeline, each against brute force on its own input, and the queries' registration."""

from __future__ import annotations

import itertools
import re
from collections import Counter

import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from assocspark.llm import queries, toxicity
from assocspark.llm.common import new_path

SF = "/root/testdata/sf0.001"


def test_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names


def stage_input(spark):
    """The documents with repeated rows, rows without an id, an id with two texts, and columns named as operators name theirs."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = spark.createDataFrame([(None, "no id", "en", "x", 5), (None, None, "en", "x", 0), (5001, "one text", "en", "x", 8), (5001, "another text", "en", "x", 12), (5002, None, None, None, None), (5003, "", "en", "x", 0)], docs.schema)
    docs = docs.unionByName(docs.limit(3)).unionByName(more)
    for name in ("node", "row", "score", "starts", "key", "component"):
        docs = docs.withColumn(name, F.lit(1))
    return docs


def rows(docs) -> Counter:
    return Counter((r.doc_id, r.text) for r in docs.collect())


def test_stages(spark):
    docs = stage_input(spark)
    columns = docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, given = rows(docs), docs
        out = stage(spark, docs, SF)
        path = new_path(spark, "test-stage")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        after = rows(docs)
        assert docs.columns == columns, name
        assert after[None, "no id"] == after[None, None] == 1, name
        if name == "toxicity":
            scored = toxicity.score_toxicity(given, spark.read.parquet(f"{SF}/labels.parquet"), text_col="text")
            bad = {r.doc_id for r in scored.where("predicted = 1").collect()}
            assert bad and after == Counter({k: n for k, n in before.items() if k[0] not in bad})
        if name == "near_dedup":
            assert not after - before and max(after.values()) == 1 and after[5001, "one text"] == after[5001, "another text"] == 1
            sets = {}
            for k in before:
                w = (k[1] or "").encode().lower().split()
                sets[k] = frozenset(zip(*(w[j:] for j in range(5)), strict=False)) or (frozenset([tuple(w)]) if w else None)
            near = lambda a, b: a is not None and b is not None and 100 * len(a & b) >= 80 * len(a | b)
            kept = [k for k in after if k[0] is not None and sets[k]]
            assert not any(near(sets[x], sets[y]) for n, x in enumerate(kept) for y in kept[:n])
            for k in before:  # what went has a link that leads to a row before it
                if k not in after:
                    assert any(near(sets[k], sets[x]) for x in before if x != k), k
        if name == "suffix_dedup":
            want = brute_kept([k for k in before if k[0] is not None])
            assert {k: t for k, t in after if k is not None and k != 5001} == {k: t for k, t in want.items() if k != 5001}
            assert all(r.n_chars == len(r.text) for r in docs.where("text is not null").collect())
        if name == "decontamination":
            found = set()
            for (d, t), (_, x) in itertools.product(before, items):
                k, s = shingles(x)
                w = [y for y in re.split(r"[\W_]+", (t or "").lower()) if y]
                if s and 100 * len(s & {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}) >= 80 * len(s):
                    found.add(d)
            assert after == Counter({k: n for k, n in before.items() if k[0] is None or k[0] not in found})
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.select("doc_id").collect()}


def brute_kept(given) -> dict:
    """Each document without the bytes of 100-byte strings that start earlier; letters cut in two go as well."""
    first, out = {}, {}
    for i, t in sorted(given, key=lambda r: r[0]):
        b = (t or "").encode()
        for s in range(len(b) - 99):
            first.setdefault(b[s : s + 100], (i, s))
    for i, t in given:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if first[b[s : s + 100]] != (i, s):
                gone[s : s + 100] = bytes([1]) * 100
        out[i] = None if t is None else bytes(x for x, g in zip(b, gone, strict=True) if not g).decode(errors="ignore")
    return out


def shingles(text, k=5):
    w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    k = min(k, len(w))
    return k, {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    r = c.execute(queries.ORACLE_SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, map(tuple, df.select(*names).collect()))) == sorted(map(repr, map(tuple, r.fetchall())))
