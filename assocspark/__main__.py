"""Command line: python -m assocspark --store PATH <command>. Rows go to standard output as JSON lines. Variables such as
ASSOCSPARK__MAX_HOPS change parameters."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import SparkSession

from .hooks import BACKENDS, models
from .params import from_environment
from .plans.engine import RAW, Engine


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="assocspark")
    out.add_argument("--store", required=True, help="folder of the store on any Spark file system")
    out.add_argument("--now-ms", type=int, help="time of the call; the clock's if left out")
    out.add_argument("--models", default="hash", choices=list(BACKENDS))
    sub = out.add_subparsers(dest="command", required=True)
    add = sub.add_parser("write")
    add.add_argument("text")
    add.add_argument("--id", type=int, help="the id after the largest if left out")
    add.add_argument("--type", default="UserStatement")
    add.add_argument("--conversation", type=int)
    add.add_argument("--session", type=int)
    add.add_argument("--project", type=int)
    add.add_argument("--task", type=int)
    ask = sub.add_parser("retrieve")
    ask.add_argument("text")
    ask.add_argument("--top-k", type=int, default=10)
    ask.add_argument("--mode", default="Balanced")
    sub.add_parser("explain").add_argument("id", type=int)
    page = sub.add_parser("list")
    page.add_argument("--limit", type=int, default=20)
    page.add_argument("--cursor", type=int)
    page.add_argument("--type")
    sub.add_parser("consolidate")
    sub.add_parser("reindex")
    look = sub.add_parser("inspect")
    look.add_argument("kind", nargs="?", default="stats", choices=["stats", "units", "postings", "channel", "edges", "strongest", "contradictions", "in_edges"])
    look.add_argument("--n", type=int, default=20)
    look.add_argument("--dim", default="entity")
    walk = sub.add_parser("traverse")
    walk.add_argument("id", type=int)
    walk.add_argument("--direction", default="out")
    walk.add_argument("--depth", type=int, default=1)
    sub.add_parser("dump").add_argument("--path")
    sub.add_parser("clear")
    return out


def call(spark: SparkSession, argv: list[str]):
    """Runs one command; a DataFrame, a dictionary or nothing comes back."""
    a = parser().parse_args(argv)
    engine = Engine(spark, a.store, from_environment(), models(a.models))
    now = a.now_ms if a.now_ms is not None else int(time.time() * 1000)
    if a.command == "write":
        id_ = a.id
        if id_ is None:
            last = engine.store.read("unit").agg({"id": "max"}).first()[0] if engine.store.version("unit") else 0
            id_ = last + 1
        row = (id_, a.text, a.type, now, a.conversation, a.session, a.project, a.task)
        engine.write(spark.createDataFrame([row], RAW), now)
        return {"id": id_}
    if a.command == "retrieve":
        return engine.retrieve(spark.createDataFrame([(now, a.text)], "query_id long, text string"), now, a.top_k, a.mode)
    if a.command == "explain":
        return engine.explain(a.id)
    if a.command == "list":
        return engine.list(a.limit, a.cursor, a.type)
    if a.command == "consolidate":
        return engine.consolidate(now)
    if a.command == "reindex":
        return engine.reindex(now)
    if a.command == "inspect":
        return engine.inspect(a.kind, a.n, a.dim)
    if a.command == "traverse":
        return engine.traverse(spark.createDataFrame([(a.id,)], "id long"), a.direction, a.depth)
    if a.command == "dump":
        return engine.dump(a.path)
    return engine.clear()


def main() -> None:
    spark = SparkSession.builder.appName("assocspark").getOrCreate()
    out = call(spark, sys.argv[1:])
    if isinstance(out, dict):
        print(json.dumps(out))
    elif out is not None:
        for line in out.toJSON().toLocalIterator():
            print(line)


if __name__ == "__main__":
    main()
