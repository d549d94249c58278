"""What the operators share: the shared folder, stored tables, and small pieces of Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Bytes of text that a task works on at once; a longer text is worked on alone.
CHUNK = 512 << 10
#: Rows of such a piece are fewer than this, so that operators can put a row's number in 14 bits beside a hash.
ROWS = 1 << 14


def shared_folder(spark: SparkSession) -> str:
    """A new folder's URI below the one that spark.checkpoint.dir names.

    Only on a local master, where driver and tasks are one machine, a temporary folder serves where that is unset.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="vecspark-")
        spark.sparkContext.setCheckpointDir(at)
    return f"{at.rstrip('/')}/vecspark/{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str | None = None, compression: str | None = None) -> DataFrame:
    """df as a table in the shared folder: later steps read it again, and a lost executor costs no more than its tasks."""
    path = path or shared_folder(df.sparkSession)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *paths: str) -> None:
    """Deletes stored tables that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def whole_rows(docs: DataFrame, *more: Column) -> DataFrame:
    """A struct `row` of all columns of docs, whatever their names, beside the columns `more`."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *more)


def with_row(docs: DataFrame, more: str) -> StructType:
    """The schema of whole_rows(docs) and of columns in DDL."""
    return StructType([StructField("row", docs.schema), *StructType.fromDDL(more).fields])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """The two columns that the operators read; a null text is an empty one."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK, rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of a column at the most, and less than `rows` rows, whatever Spark's own batches are."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.nan_to_num(np.asarray(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), float))
        upto, begin = np.cumsum(sizes), 0
        while begin < len(sizes):
            before = upto[begin - 1] if begin else 0.0
            end = min(max(begin + 1, int(np.searchsorted(upto, before + most, "right"))), begin + rows - 1)
            yield batch.slice(begin, end - begin)
            begin = end


def packed(values: np.ndarray) -> bytes:
    """Integers, byte by byte of all, compressed: bytes that are mostly 0 cost next to nothing."""
    return zstandard.ZstdCompressor(level=1).compress(values.astype(np.uint64, copy=False).view(np.uint8).reshape(-1, 8).T.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view(np.uint64).ravel()


Batches = Iterator[pa.RecordBatch]
Map = Callable[[Batches], Batches]
