"""The corpus pipeline: good documents, one of each near-duplicate class, without passages seen before, packed.

Each stage reads all documents that its predecessor kept, from the table that was written; run() does the writing.
Defined cases are those of the operators: a null text is an empty one; rows without a doc_id are scored, pass both
dedup stages as they are and are packed with a null doc_id; an empty table gives no rows. Extra columns stay up to packing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vecspark.llm import near_dedup, packing, quality, substring_dedup
from vecspark.llm.common import stored
from vecspark.llm.tokens import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.7 or more; trained on the labelled ones among those that are to be scored."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest doc_id."""
    return near_dedup.keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of windows of 50 words that an earlier document has; n_chars follows the text."""
    return substring_dedup.dedup(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 ids."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [("quality", good), ("near_dedup", one_of_each), ("substring_dedup", without_repeats), ("packing", packed)]

#: Compression, sampling and merges by rank can't be put in SQL; tests compare with a brute-force run.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
