"""WARC archives of pages, and their index by external merge.

Pages become WARC/1.1 records: of equal payloads that with the smallest id is a response, the
others are revisits without a block that name it. Spark writes the archives (plain WARC text, at most
about FILE_BYTES of payload each, one larger payload alone) and reads them back as files; a parser takes
the records out by Content-Length and sorts each archive's index lines by reversed-host url key and capture
time. These locally sorted runs are written, dealt into key ranges, and merged in each range by a loser tree: lines beyond
a bound are merged to a sorted scratch file first, so a range needs bounded memory and its output is a globally
ordered capture history.

Defined cases: a null payload is empty; empty payloads are equal payloads. A null url has the url
key "" and is written as the empty string; blanks and control characters of a url are percent-encoded. Rows with a null
id are archived and returned with a null id, and are a response only if no row with an id has their payload. Rows that
share an id are judged by their own payload each; of rows with the same id and payload all are what that id is. Columns
other than id, url and html play no part, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import pickle
import re
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, local_tmp, new_path, small_side, spread_join, written

#: Bytes of payload and records to an archive file, index lines kept in memory by a merging task, lines read ahead of a run.
FILE_BYTES, FILE_RECORDS, MEMORY_LINES, AHEAD = 64 << 20, 1_000, 200_000, 2_000
_START = datetime(2024, 1, 1, tzinfo=timezone.utc)
#: Stands for a null id in a join.
_NONE = -(1 << 63)
_UNSAFE = re.compile(r"[\s\x00-\x1f\x7f-\x9f]")
_INDEX = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, captured string, run long, seq long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str) -> str:
    """Reversed host, then the path and query: com,example)/path."""
    _, found, rest = url.partition("://")
    if not found:
        return ""
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    return ",".join(reversed(rest[:cut].lower().split("."))) + ")" + rest[cut:].split("#")[0]


def captured(page_id: int | None) -> str:
    """The capture time of a page: the tables have none, so one second per id."""
    return (_START + timedelta(seconds=(page_id or 0) % 10**9)).strftime("%Y-%m-%dT%H:%M:%SZ")


def one_line(url: str) -> str:
    """A url as a header may hold it."""
    return _UNSAFE.sub(lambda m: quote(m[0]), url)


def record(page_id: int | None, url: str, payload: bytes, sha: str, response: int | None) -> str:
    """One WARC record without the two line ends behind it; response is the id of the record that has the payload."""
    known = "" if page_id is None else page_id
    head = ["WARC/1.1", f"WARC-Type: {'response' if response == page_id else 'revisit'}", f"WARC-Record-ID: <urn:page:{known}>", f"WARC-Date: {captured(page_id)}", f"WARC-Target-URI: {one_line(url)}", f"WARC-Payload-Digest: sha1:{sha}", "Content-Type: text/html; charset=utf-8"]
    if response != page_id:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{response}>", f"WARC-Refers-To-Payload-Length: {len(payload)}"]
        payload = b""
    return "\r\n".join([*head, f"Content-Length: {len(payload)}", "", payload.decode()])


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names lower-cased) and block of each record of an archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        size = int(head["content-length"])
        yield head, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


class LoserTree:
    """Merges sorted iterators: each inner node keeps the loser of its match, so the next least item costs one path of matches."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, self.n = runs, len(runs)
        self.head = [next(r, None) for r in runs]
        self.loser = [0] * max(1, self.n)
        winner = [0] * (2 * self.n)
        for i in range(self.n):
            winner[self.n + i] = i
        for i in range(self.n - 1, 0, -1):
            a, b = winner[2 * i], winner[2 * i + 1]
            winner[i], self.loser[i] = (a, b) if self._less(a, b) else (b, a)
        self.loser[0] = winner[1] if self.n > 1 else 0

    def _less(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        return y is None or x is not None and (x, a) < (y, b)

    def __iter__(self) -> Iterator[tuple]:
        while self.n and (item := self.head[w := self.loser[0]]) is not None:
            yield item
            self.head[w] = next(self.runs[w], None)
            i = (self.n + w) // 2
            while i:
                if self._less(self.loser[i], w):
                    w, self.loser[i] = self.loser[i], w
                i //= 2
            self.loser[0] = w


def _write(batches):
    for batch in batches:
        page, url, html, response = (batch.column(i).to_pylist() for i in range(4))
        out = [record(p, u or "", (h or "").encode(), digest((h or "").encode()), r) for p, u, h, r in zip(page, url, html, response, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])


def _order(line: tuple) -> tuple:
    """Url key, time, id (null first), and what keeps equal lines apart."""
    return line[5], line[6], line[0] is not None, line[0] or 0, line[7], line[8]


def _read(batches):
    """An archive's index lines as a sorted run."""
    for batch in batches:
        for run, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            out = []
            for n, (head, block) in enumerate(records(data.as_py())):
                page, refers = (int(x) if (x := head.get(k, "").rpartition(":")[2].rstrip(">")) else None for k in ("warc-record-id", "warc-refers-to"))
                sha = head["warc-payload-digest"].partition(":")[2]
                if head["warc-type"] == "response" and digest(block) != sha:
                    raise ValueError(f"record {page}: the block doesn't have the digest {sha}")
                size = int(head.get("warc-refers-to-payload-length", len(block)))
                out.append((page, size, sha, head["warc-type"], refers, url_key(head["warc-target-uri"]), head["warc-date"], run, n))
            yield _lines(sorted(out, key=_order))


def _lines(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 9
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in _INDEX.split(", ")])


def _merge(batches):
    """Lines of many runs, each run's in order, go out sorted. A line that is out of its run's order begins a run of its own."""
    with local_tmp("runs-") as folder:
        runs: dict[int, list[list[tuple]]] = {}
        held, files = 0, []

        def in_memory() -> list[Iterator[tuple]]:
            return [iter(r) for parts in runs.values() for r in parts]

        def spill():
            nonlocal held
            files.append(f"{folder}/{len(files)}")
            with open(files[-1], "wb") as f:
                ahead: list[tuple] = []
                for item in LoserTree(in_memory()):
                    ahead.append(item)
                    if len(ahead) == AHEAD:
                        pickle.dump(ahead, f)
                        ahead = []
                pickle.dump(ahead, f)
            runs.clear()
            held = 0

        def lines(name: str):
            with open(name, "rb") as f:
                try:
                    while True:
                        yield from pickle.load(f)
                except EOFError:
                    return

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                item = _order(row), row
                parts = runs.setdefault(row[7], [[]])
                if parts[-1] and item[0] < parts[-1][-1][0]:
                    parts.append([])
                parts[-1].append(item)
                held += 1
                if held >= MEMORY_LINES:
                    spill()
        out = []
        for item in LoserTree([*map(lines, files), *in_memory()]):
            out.append(item[1])
            if len(out) == 5_000:
                yield _lines(out)
                out = []
        yield _lines(out)


def archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes the pages as WARC files to the folder path."""
    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    size = F.coalesce(F.octet_length("html"), F.lit(0))
    # payloads by size: files of class c hold payloads of at most 16 ** c * 64 KB, and fewer records the larger c is
    step = F.when(size <= 1 << 16, 0).when(size <= 1 << 20, 1).when(size <= 1 << 24, 2).otherwise(3)
    rows = rows.withColumn("sha", F.sha1(F.coalesce("html", F.lit("")).cast("binary"))).withColumn("step", step)
    ids = written(rows.select("page_id", "sha", "step"), "ids")
    first = ids.groupBy("sha").agg(F.min("page_id").alias("response"), F.count("*").alias("n")).where("n > 1")
    # only ids and digests are shuffled: pages that repeat another are few, the rest refer to themselves
    repeats = spread_join(ids.select("page_id", "sha"), written(first, "first"), ["sha"], ids.count()).where(F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response")))
    repeats = written(repeats.select(F.coalesce("page_id", F.lit(_NONE)).alias("known"), "sha", "response").distinct(), "repeats")
    rows = rows.withColumn("known", F.coalesce("page_id", F.lit(_NONE))).join(small_side(repeats), ["known", "sha"], "left")
    for c in sorted(r.step for r in ids.select("step").distinct().collect()):  # four at most
        each = rows.where(F.col("step") == c).select("page_id", "url", "html", F.coalesce("response", "page_id").alias("response"))
        limit = max(1, min(FILE_RECORDS, FILE_BYTES >> (16 + 4 * c)))
        each.mapInArrow(_write, "value string").write.mode("append").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", limit).text(path)
    if not ids.take(1):
        rows.select(F.lit("").alias("value")).limit(0).write.mode("append").text(path)


def captures(spark, path: str, ranges: int | None = None) -> DataFrame:
    """The index of a folder of archives, globally ordered by url key, time and id (null first)."""
    bounded_batches(spark)
    files = spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("run"), "content")
    lines = written(files.mapInArrow(_read, _INDEX), "runs")  # read once; the ranges are sampled from these
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return lines.repartitionByRange(ranges, "url_key", "captured", "page_id", "run", "seq").mapInArrow(_merge, _INDEX)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages to archives in the shared folder and back."""
    path = new_path(pages.sparkSession, "warc")
    archive(pages, path, id_col, url_col, html_col)
    return captures(pages.sparkSession, path)
