"""Evaluation files: JSON with one case, or one set, to a file, in a folder for each locale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CONTEXT = "struct<session_id:bigint,conversation_id:bigint,project_id:bigint,task_id:bigint,user_id:bigint>"
CASE = f"""case_id string, task_type string,
    writes array<struct<local_id:string,content:string,content_type:string,context:{_CONTEXT},n:int>>,
    query struct<text:string,mode:string,top_k:int,context:{_CONTEXT}>,
    ground_truth struct<relevant:array<string>,also_acceptable:array<string>,expected_dimensions:array<string>,expected_warnings:array<string>,expected_edges:array<struct<from:string,to:string,link_type:string>>>"""
DATASET = "entries array<struct<content_type:string,content:string,importance:double,category:string>>"
CATEGORY_QUERIES = "queries array<struct<query:string,expected_categories:array<string>,description:string>>"


def read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All files under folder/<locale>/, with the locale."""
    locale = F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1)
    return spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(folder).withColumn("locale", locale)


def writes(cases: DataFrame) -> DataFrame:
    """One row for each memory of a case, repeated n times as the case asks."""
    w = cases.select("locale", "case_id", F.posexplode("writes").alias("pos", "w")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.coalesce("w.n", F.lit(1))))))
    return w.select("locale", "case_id", "pos", "copy", "w.local_id", "w.content", "w.content_type", "w.context")
