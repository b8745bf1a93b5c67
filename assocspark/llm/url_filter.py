"""Allow and block rules for urls by a sort-merge range join.

A host's labels are reversed and each ends with a dot, so that a rule's host and its subdomains
are one interval of keys: those that begin with the rule's key. Rules are sorted by that key. Urls are range-partitioned and
sorted by it, and each partition is merged with the rules in one sweep: a stack holds the rules whose interval is open, the
most nested on top. A sweep may begin anywhere, since the rules before a partition's first key are run through the same stack.
Partitions are cut by the first KEY_CHARS of the key and then a hash, so the boundaries that Spark samples are
small, and a host with any number of urls, or copies of one url, is spread over many partitions.

Defined cases: null urls, urls without ://, and empty hosts have an empty host and fit no rule.
The rule with the longest host wins, then that with the longest path; of equal rules, block. A
page no rule fits is allowed. Repeated rows are judged alike, and rows with a null id are judged and returned. A very long
url is one row of its partition and no boundary. Columns other than id and url play no part, whatever their names.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: Urls to a partition, and how many characters of a key boundaries have.
RANGE_ROWS, KEY_CHARS = 50_000, 48
#: Rules come as a list that the driver holds; they go to every task, so their number is bounded.
RULES = 1_000_000

_COLUMNS = "page_id long, host string, path string, rule string, verdict string"


def host_key(host: str) -> str:
    return "".join(x + "." for x in reversed(host.split("."))) if host else ""


def host_and_path(url) -> tuple:
    """Columns host (A-Z lower-cased) and path of a url column; both empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def ordered(rules: Sequence[tuple[str, str, str]]) -> list[tuple[str, list[tuple[str, str, str]]]]:
    """rules (verdict, host, path) as (key, [(path, host and path, verdict)]) in the order of keys, of a key the longest path first."""
    held: dict[str, list[tuple[str, str, str]]] = {}
    for verdict, host, path in sorted(rules, key=lambda r: (-len(r[2]), r[2], r[0] != "block")):
        if host:
            held.setdefault(host_key(host), []).append((path, host + path, verdict))
    return sorted(held.items())


def _sweep(rules: list[tuple[str, list[tuple[str, str, str]]]]):
    """A function over urls sorted by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, stack = 0, []
        for batch in batches:
            out = []
            for key, page, host, path in zip(*(batch.column(c).to_pylist() for c in ("key", "page_id", "host", "path")), strict=True):
                while at < len(rules) and rules[at][0] <= key:
                    while stack and not rules[at][0].startswith(stack[-1][0]):
                        stack.pop()
                    stack.append(rules[at])
                    at += 1
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                fit = next(((rule, verdict) for _, held in reversed(stack) for p, rule, verdict in held if path.startswith(p)), None) if host else None
                out.append((page, host, path, *(fit or (None, "allow"))))
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.string()) for c in cols[1:])], ["page_id", "host", "path", "rule", "verdict"])

    return run


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """rules: (verdict, host, path). Returns page_id, host, path, rule (host and path, or null) and verdict for each row."""
    if len(rules) > RULES:
        raise ValueError(f"{len(rules)} rules; a list that goes to every task may have {RULES}")
    spark = pages.sparkSession
    bounded_batches(spark)
    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url")).select("page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    key = F.when(F.col("host") == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split("host", "\\.", -1)), "."), F.lit(".")))
    # the row's own place in the hash keeps copies of one url apart
    spread = F.xxhash64("page_id", "path", F.monotonically_increasing_id())
    urls = urls.withColumn("key", key).withColumn("begin", F.substring("key", 1, KEY_CHARS)).withColumn("spread", spread)
    parts = max(spark.sparkContext.defaultParallelism, pages.count() // RANGE_ROWS)
    dealt = urls.repartitionByRange(parts, "begin", "spread").drop("begin", "spread").sortWithinPartitions("key", "path", "page_id")
    return dealt.mapInArrow(_sweep(ordered(rules)), _COLUMNS)
