"""Tables of a memory store on any Spark file system: append-only logs, and snapshots named by a pointer."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


class RecordExists(ValueError):
    """A log already has a record with this id."""


class NotFound(KeyError):
    """No memory has this id."""


class Warehouse:
    """Logs are Parquet folders that grow. A snapshot is a list of folders: each is written whole before the row that lists it is
    appended to the pointer, so readers see the old snapshot or the new one."""

    #: Folders of a snapshot; one more and they are written as one.
    PARTS = 16

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _newest(self, name: str) -> tuple[int, list[str]]:
        try:
            rows = self.spark.read.schema("version long, parts array<string>").parquet(f"{self._path(name)}/pointer")
        except AnalysisException:
            return 0, []
        row = rows.agg(F.max(F.struct("version", "parts")).alias("x")).first().x
        return (row.version, row.parts) if row else (0, [])

    def version(self, name: str) -> int:
        """The newest snapshot that was written whole, or 0."""
        return self._newest(name)[0]

    def read(self, name: str) -> DataFrame:
        n, parts = self._newest(name)
        if not n:
            raise KeyError(name)
        return self.spark.read.parquet(*(f"{self._path(name)}/{p}" for p in parts))

    def _write(self, name: str, df: DataFrame, parts: list[str]) -> None:
        n = self.version(name) + 1
        df.write.mode("overwrite").parquet(f"{self._path(name)}/v={n}")
        self.spark.createDataFrame([(n, [*parts, f"v={n}"])], "version long, parts array<string>").coalesce(1).write.mode("append").parquet(f"{self._path(name)}/pointer")

    def replace(self, name: str, df: DataFrame) -> None:
        """A new snapshot; readers see the old one until it is whole."""
        self._write(name, df, [])

    def add(self, name: str, df: DataFrame) -> None:
        """A snapshot with more rows: only these are written, unless it has too many folders."""
        _, parts = self._newest(name)
        if len(parts) < self.PARTS:
            self._write(name, df, parts)
        else:
            self.replace(name, self.read(name).unionByName(df))

    def upsert(self, name: str, df: DataFrame, *keys: str) -> None:
        if not self.version(name):
            return self.replace(name, df)
        old = self.read(name)
        return self.replace(name, old.join(df.select(*keys), list(keys), "left_anti").unionByName(df))

    def log(self, name: str, schema: str | None = None) -> DataFrame:
        """The records of a log; none if it was never written and a schema is given."""
        try:
            return self.spark.read.parquet(f"{self._path(name)}/log")
        except AnalysisException:
            if schema is None:
                raise
            return self.spark.createDataFrame([], schema)

    def append(self, name: str, df: DataFrame, key: str | None = None) -> None:
        """Appends to a log; with a key, ids that are there already, or twice in df, are an error."""
        path = f"{self._path(name)}/log"
        if key:
            if not df.groupBy(key).count().where("count > 1").isEmpty():
                raise RecordExists(name)
            try:
                if not df.join(self.spark.read.parquet(path).select(key), key, "left_semi").isEmpty():
                    raise RecordExists(name)
            except AnalysisException:
                pass  # the first append
        df.write.mode("append").parquet(path)

    def clear(self) -> None:
        """Removes the store; nothing there is no error."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def by_ids(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows with these ids; unknown ids give none."""
    return table.join(ids.select(F.col(ids.columns[0]).alias(key)).distinct(), key, "left_semi")


def first_by_id(table: DataFrame, n: int, key: str = "id") -> DataFrame:
    return table.orderBy(key).limit(n)


def _stored_at(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir is unset, and {master} needs a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="assocspark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/stored-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df as a table of its own in the folder of spark.checkpoint.dir. Where that is unset, a temporary one is made and set, but only
    if driver and executors are one process.

    A plan that reads a long derivation many times is short again, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = _stored_at(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dealt(df: DataFrame, key: str) -> DataFrame:
    """As stored(), in as many buckets of the key as shuffles have partitions: joins on the key shuffle none of it."""
    spark = df.sparkSession
    path, name = _stored_at(spark), f"stored_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).sortBy(key).option("path", path).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only: its files are where path says
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that came from stored(), when what was made of them is itself stored."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
