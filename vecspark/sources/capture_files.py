"""Capture files of any size: JSON is tokenised step by step, and a partition is a range of samples.

A file is one capture, or an object whose "samples" is a list of captures.  One pass skims a file for the places of its samples: it looks at
strings and brackets only, a piece of the file at a time.  Ranges of samples of about `range_bytes` are then read by tasks, each by
a seek and reads of its own bytes; a task holds one piece of the file and one sample.  Keys that are not known are skipped.

* `scan_captures` is a plan of two steps: files are skimmed by tasks, a file each, and the ranges are dealt out to tasks that read them;
* `spark.read.format("attention_captures").load(path)`, once CaptureSource is registered, plans the ranges on the driver, for files that are few.

Files are opened by Arrow's file systems.  A sample that is no valid capture JSON is a row with nulls whose parse_error names the file's sample and
byte (an error, with mode "failfast"); a file that ends within a sample, or has no capture at all, is an error.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .captures import FIELDS, with_defaults

PIECE, RANGE_BYTES, BATCH_BYTES = 1 << 20, 32 << 20, 1 << 20
SCHEMA = f"source string, sample long, {FIELDS}, parse_error string"
_RANGES = "source string, first long, begins array<long>, ends array<long>"
#: A string, with the colon behind it that makes it a key, or a bracket; or a quote alone, of a string that goes on.
_TOKEN = re.compile(rb'"((?:[^"\\]|\\.)*)"(\s*:)?|["{}\[\]]', re.DOTALL)
_BLANK = re.compile(rb"\s*\Z")
#: name -> type
_FIELDS = dict(x.strip().split(" ", 1) for x in FIELDS.split(","))
_ARROW = {"string": pa.string(), "int": pa.int32(), "float": pa.float32(), "array<float>": pa.list_(pa.float32())}


def opened(uri: str):
    """An Arrow file for a path or URI."""
    store, path = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))
    return store.open_input_file(path)


def files_at(path: str) -> list[str]:
    """The file, or the .json files of a folder, in order."""
    store, at = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
    if store.get_file_info(at).type == fs.FileType.Directory:
        return sorted(x.path for x in store.get_file_info(fs.FileSelector(at)) if x.type == fs.FileType.File and x.path.endswith(".json"))
    return [path]


def skim(file, name: str = "", piece: int = PIECE) -> Iterator[tuple[int, int]]:
    """(begin, end) of each sample, in bytes: of the list under "samples", or of the whole file where there is none."""
    depth, key, begin, listed, within, found, query = 0, None, 0, False, False, 0, False
    buffer, at, size, more = b"", 0, 0, True
    while more:
        data = file.read(piece)
        more, size = bool(data), size + len(data)
        buffer += data
        done = len(buffer)
        for m in _TOKEN.finditer(buffer):
            text = m.group()
            if text == b'"' or (more and text[:1] == b'"' and _BLANK.match(buffer, m.end())):
                done = m.start()  # its end, or its colon, may still come
                break
            if text[:1] == b'"':
                if depth == 1 and m.group(2):
                    key = m.group(1)
                    query |= key == b"query"
            elif text in (b"{", b"["):
                if depth == 1 and key == b"samples" and text == b"[":
                    listed = within = True
                elif depth == 2 and within and text == b"{":
                    begin = at + m.start()
                depth += 1
            else:
                depth -= 1
                if depth < 0:
                    raise ValueError(f"capture file {name}: a bracket too many at byte {at + m.start()}")
                if depth == 2 and within and text == b"}":
                    found += 1
                    yield begin, at + m.end()
                elif depth == 1 and within:
                    within = False
        at += done
        buffer = buffer[done:]
    if depth or buffer:
        place = f"sample {found}, which begins at byte {begin}" if within else f"byte {at}"
        raise ValueError(f"capture file {name} ends within {place}")
    if not listed:
        if not query:
            raise ValueError(f"capture file {name} has neither samples nor a capture")
        yield 0, size


def ranges(file, name: str, range_bytes: int = RANGE_BYTES) -> Iterator[tuple[int, list[int], list[int]]]:
    """(number of its first sample, begins, ends) of ranges of about range_bytes."""
    first, begins, ends = 0, [], []
    for begin, end in skim(file, name):
        if begins and end - begins[0] > range_bytes:
            yield first, begins, ends
            first, begins, ends = first + len(begins), [], []
        begins.append(begin)
        ends.append(end)
    if begins:
        yield first, begins, ends


def _value(x, kind: str):
    """x as a value of the field's type; a TypeError if it is of another one."""
    if x is None or (kind == "string" and isinstance(x, str)):
        return x
    if kind == "int" and isinstance(x, int) and not isinstance(x, bool):
        return x
    if kind == "float" and isinstance(x, (int, float)) and not isinstance(x, bool):
        return float(x)
    if kind == "array<float>" and isinstance(x, list):
        return [_value(y, "float") for y in x]
    raise TypeError


def parsed(data: bytes, place: str, strict: bool = False) -> list:
    """Values of FIELDS and what is wrong. place: how an error names the sample."""
    error = None
    try:
        found = json.loads(data)
        if not isinstance(found, dict):
            raise ValueError("is no object")
        out = []
        for name, kind in _FIELDS.items():
            try:
                out.append(_value(found.get(name), kind))
            except TypeError:
                raise ValueError(f"{name} is no {kind}") from None
        return [*out, None]
    except (ValueError, RecursionError) as e:
        error = f"{place}: {e}"
    if strict:
        raise ValueError(error)
    return [None] * len(_FIELDS) + [error]


def rows_of(name: str, first: int, begins: list[int], ends: list[int], strict: bool) -> Iterator[pa.RecordBatch]:
    """The samples of a range, in batches."""
    names = ["source", "sample", *_FIELDS, "parse_error"]
    kinds = [pa.string(), pa.int64(), *(_ARROW[kind] for kind in _FIELDS.values()), pa.string()]
    rows, size = [], 0
    with opened(name) as file:
        for i, (begin, end) in enumerate(zip(begins, ends)):
            file.seek(begin)
            rows.append([name, first + i, *parsed(file.read(end - begin), f"{name}, sample {first + i} at byte {begin}", strict)])
            size += end - begin
            if size >= BATCH_BYTES:
                yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)
                rows, size = [], 0
    if rows:
        yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)


def scan_captures(spark: SparkSession, path: str | list[str], range_bytes: int = RANGE_BYTES, mode: str = "permissive") -> DataFrame:
    """A row a sample of all files, with source and sample (its number in the file); defaults are filled in as by read_captures()."""
    files = spark.read.format("binaryFile").load(path).select("path")  # only listed: the content column isn't read

    def skimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("path").to_pylist():
                with opened(name) as file:
                    for first, begins, ends in ranges(file, name, range_bytes):
                        yield pa.record_batch([pa.array([name]), pa.array([first]), pa.array([begins], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int64()))], names=["source", "first", "begins", "ends"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield from rows_of(r["source"], r["first"], r["begins"], r["ends"], mode == "failfast")

    dealt = files.repartition("path").mapInArrow(skimmed, _RANGES).repartition("source", "first")
    return checked(dealt.mapInArrow(read, SCHEMA))


def checked(rows: DataFrame) -> DataFrame:
    """rows of SCHEMA with defaults; capture_error says what is wrong with the JSON, or with the capture."""
    out = with_defaults(rows)
    return out.withColumn("capture_error", F.coalesce("parse_error", "capture_error")).drop("parse_error")


@dataclass
class Range(InputPartition):
    source: str
    first: int
    begins: list[int]
    ends: list[int]


class CaptureSource(DataSource):
    """format("attention_captures"): options path, range_bytes, mode (permissive or failfast)."""

    @classmethod
    def name(cls) -> str:
        return "attention_captures"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.strict = options["path"], options.get("mode", "permissive").lower() == "failfast"
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))

    def partitions(self) -> list[Range]:
        out = []
        for name in files_at(self.path):
            with opened(name) as file:
                out += [Range(name, *r) for r in ranges(file, name, self.range_bytes)]
        return out

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is not None:
            yield from rows_of(partition.source, partition.first, partition.begins, partition.ends, self.strict)
