"""documents to packed training sequences, in five stages. Each stage's rows are written as Parquet and read again as the next one's docs.

Null texts are clean, no near-duplicate, nothing to cut, and one end id when packed. Rows with a null id go through all
stages. Repeated rows are one document after the second stage. Columns other than doc_id and text are carried along as they are,
whatever their names; only n_chars follows the text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assocspark.llm import decontamination, near_dedup, packing, suffix_dedup, toxicity
from assocspark.llm.common import delete, new_path, small_side, table, written
from assocspark.llm.queries import TOKENIZER

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the rows of these doc_ids; their texts are shuffled only if the ids are many."""
    return docs.join(small_side(written(ids.distinct(), "dropped")), "doc_id", "left_anti").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a score under 0.5."""
    score = toxicity.scorer(spark, docs, table(spark, sf_dir, "labels"))
    return docs.where(score(F.col("text")) < 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, by five words and a similarity of 0.8 (op9's contract has two words instead). Rows that
    share an id are documents of their own unless their texts are equal too."""
    return near_dedup.without_copies(docs, k=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; passages of 100 bytes that an earlier text has are cut from the texts."""
    out = suffix_dedup.without_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item."""
    return _without(docs, decontamination.find_items(docs, table(spark, sf_dir, "benchmark")).select("doc_id"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences."""
    return packing.pack(docs, TOKENIZER)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What the stages before it wrote is deleted as soon as the next stage is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
