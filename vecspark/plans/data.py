"""The test tables as the operators' inputs."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIM = 64
#: A row of lineitem as an evaluation case; the same text is SQL for Spark and for DuckDB.
CASES = """
SELECT l_orderkey AS sample, CASE WHEN l_linenumber % 2 = 0 THEN 'primary' ELSE 'uniform' END AS method,
  CAST(2 + l_partkey % 3 AS INT) AS key_bits, CAST(2 + l_suppkey % 3 AS INT) AS value_bits, CAST(8 + 8 * (l_linenumber % 3) AS INT) AS top_k,
  CAST(l_orderkey % 8 AS INT) AS layer, CAST(128 * (1 + l_orderkey % 3) AS INT) AS tokens,
  CASE l_orderkey % 5 WHEN 0 THEN 'first' WHEN 1 THEN 'quarter' WHEN 2 THEN 'middle' WHEN 3 THEN 'three_quarter' ELSE 'last' END AS position,
  l_extendedprice / 99991 AS output_mse, (1 - l_discount - l_tax) / 1.00007e0 AS output_cosine,
  CAST(65536 AS BIGINT) AS raw_bytes, CAST(l_quantity * 64 AS BIGINT) + 512 * (4 + l_partkey % 3 + l_suppkey % 3) AS storage_bytes
FROM lineitem
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CASES.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, v, label."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def queries_of(rows: DataFrame) -> DataFrame:
    """query_id, q: the rows whose id is divisible by 100."""
    return rows.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("v").cast("array<double>").alias("q"))


def shared_folder(spark: SparkSession) -> str:
    """A new folder's URI below the one that spark.checkpoint.dir names; a temporary one only on a local master, where that is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="vecspark-")
        spark.sparkContext.setCheckpointDir(at)
    return f"{at.rstrip('/')}/vecspark/{uuid.uuid4().hex}"
