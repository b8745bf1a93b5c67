"""What the training-data operators share: the shared folder, written tables, checked broadcasts."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it has at most this many rows (ids and a few numbers each: about 16 MB).
BROADCAST_ROWS = 200_000
#: A key is hot if it has more rows than this, and more than one in HOT_KEYS of all rows: fewer than HOT_KEYS keys can be.
HOT_ROWS, HOT_KEYS = 10_000, 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches to and from Python end at 4 MB, whatever the length of the texts.

    The settings are read when a plan runs, which is after the operator has returned, so they stay set."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a temporary one is made and set, but only if driver and
    executors are one process; elsewhere executors would each write to a disk of their own, so that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir is unset, and {master} needs a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="assocspark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/assocspark/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written as Parquet to the shared folder and read back: lineage ends here, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    release(spark)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that came from written(), when what was made of them is itself written."""
    for t in tables:
        delete(t.sparkSession, t.stored_at)


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df, with a broadcast hint only if it has at most limit rows; else Spark shuffles both sides. df should be cheap to count."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def spread_join(rows: DataFrame, side: DataFrame, on: list[str], total: int) -> DataFrame:
    """rows left-joined to side, which has one row for each key and in n the rows with that key; rows has total rows.

    Hot keys are looked up in a broadcast of their own (fewer than HOT_KEYS rows, see there), so a task never gets all rows of one."""
    bound = max(HOT_ROWS, total // HOT_KEYS)
    hot, cold = side.where(F.col("n") > bound).drop("n"), side.where(F.col("n") <= bound).drop("n")
    return rows.join(F.broadcast(hot), on).unionByName(rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on, "left"))


def local_tmp(prefix: str) -> tempfile.TemporaryDirectory:
    """Scratch files of one task, gone when the task is done."""
    return tempfile.TemporaryDirectory(prefix=prefix, dir=os.environ.get("TMPDIR") or None)
