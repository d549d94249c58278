"""Pages as a data source and sink: format("kv_pages"), a folder with a file in the page form for each page.

The form stores a page's columns one after another (keys' cells, their signs, residual norms, values' cells, norms), so the
entries of a range of slots are five ranges of bytes.  Filters on page choose files, filters on slot choose ranges, before anything is
read (spark.sql.python.filterPushdown.enabled must be on); a large page is read by several tasks, a range each.

Writing takes rows (page, slot, mse, signs, res_norm, packed, norm) that are clustered by page and sorted by slot, as `write_pages` arranges
them; options dim, key_bits, value_bits and seed say what the codes mean.  A task writes below _staged; only what the commit messages of
successful tasks name is moved to its place, by the driver, so a failed or repeated task leaves nothing.  A page that exists is an error
in mode append; overwrite replaces the folder's pages.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from vecspark.functions import codes
from vecspark.functions.spec import ProductSpec, QuantizerSpec, packed_size

from .blobs import PAGE, _page_head, _read_page_head, compact, from_compact

SCHEMA = "page string, slot int, mse binary, signs binary, res_norm float, packed binary, norm float"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
STAGED = "_staged"
#: Entries that a task reads of one page.
ENTRIES = 1 << 16


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))


class PageFile:
    """A page that is read by ranges. bytes_read counts what was."""

    def __init__(self, store: fs.FileSystem, path: str):
        self.file, self.bytes_read = store.open_input_file(path), 0
        at, n_key, n_value, self.entries = _read_page_head(self._range(0, PAGE.size))
        specs = self._range(at, n_key + n_value)
        self.keys, self.values = from_compact(specs[:n_key], True), from_compact(specs[n_key:])
        self.begin = at + n_key + n_value
        self.widths = (packed_size(self.keys.dim, self.keys.bits - 1), packed_size(self.keys.dim, 1), 4, self.values.code_bytes, 4)
        if self.file.size() != self.begin + self.entries * sum(self.widths):
            raise ValueError(f"page {path} has another length")

    def _range(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(size)
        if len(data) != size:
            raise ValueError("a page is too short")
        self.bytes_read += size
        return data

    def columns(self, low: int, high: int) -> list[np.ndarray]:
        """Rows of bytes of the slots from low to high - 1, for each of the five columns."""
        out, at = [], self.begin
        for width in self.widths:
            out.append(np.frombuffer(self._range(at + low * width, (high - low) * width), np.uint8).reshape(-1, width))
            at += self.entries * width
        return out

    def batch(self, page: str, low: int, high: int) -> pa.RecordBatch:
        mse, signs, res_norm, packed, norm = self.columns(low, high)
        floats = lambda x: pa.array(np.ascontiguousarray(x).view("<f4").ravel())
        return pa.record_batch([pa.array([page] * (high - low)), pa.array(np.arange(low, high, dtype=np.int32)), codes.bytes_of(mse), codes.bytes_of(signs), floats(res_norm), codes.bytes_of(packed), floats(norm)], names=NAMES)


@dataclass
class Slots(InputPartition):
    path: str
    page: str
    low: int
    high: int


@dataclass
class Written(WriterCommitMessage):
    """Of each page that a task wrote: its name, the staged file, entries."""

    pages: list[tuple[str, str, int]] = field(default_factory=list)


class PageSource(DataSource):
    """Options: path; for writing also dim, key_bits, value_bits, seed."""

    @classmethod
    def name(cls) -> str:
        return "kv_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        o = self.options
        if schema.fieldNames() != NAMES:
            raise ValueError(f"pages are written from the columns {SCHEMA}")
        spec = {x: int(o[x]) for x in ("dim", "key_bits", "value_bits")}
        return _Writer(o["path"], ProductSpec(spec["dim"], spec["key_bits"], int(o.get("seed", 42))), QuantizerSpec(spec["dim"], spec["value_bits"], int(o.get("seed", 42))), overwrite)


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.pages, self.low, self.high = path, None, 0, 1 << 31

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = getattr(f, "attribute", None)
            if name == ("page",) and isinstance(f, (EqualTo, In)):
                own = set(f.value) if isinstance(f, In) else {f.value}
                self.pages = own if self.pages is None else self.pages & own
            elif name == ("slot",) and isinstance(f, EqualTo):
                self.low, self.high = max(self.low, f.value), min(self.high, f.value + 1)
            elif name == ("slot",) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif name == ("slot",) and isinstance(f, (LessThan, LessThanOrEqual)):
                self.high = min(self.high, f.value + isinstance(f, LessThanOrEqual))
            else:
                yield f

    def partitions(self) -> list[Slots]:
        store, at = _store(self.path)
        out = []
        for info in sorted(store.get_file_info(fs.FileSelector(at)), key=lambda x: x.path):
            name = info.path.rpartition("/")[2]
            page = unquote(name.removesuffix(".page"))
            if info.type != fs.FileType.File or not name.endswith(".page") or (self.pages is not None and page not in self.pages):
                continue
            with store.open_input_file(info.path) as file:  # the head alone
                entries = _read_page_head(file.read(PAGE.size))[3]
            low, high = min(self.low, entries), min(self.high, entries)
            out += [Slots(info.path, page, a, min(a + ENTRIES, high)) for a in range(low, high, ENTRIES)]
        return out

    def read(self, partition: Slots | None) -> Iterator[pa.RecordBatch]:
        if partition is not None and partition.low < partition.high:
            yield PageFile(_store(self.path)[0], partition.path).batch(partition.page, partition.low, partition.high)


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, keys: ProductSpec, values: QuantizerSpec, overwrite: bool):
        self.path, self.keys, self.values, self.overwrite, self.job = path, keys, values, overwrite, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, at = _store(self.path)
        folder, out = f"{at}/{STAGED}/{self.job}/{uuid.uuid4().hex}", Written()
        store.create_dir(folder, recursive=True)
        page, parts = None, []

        def flush() -> None:
            if page is None:
                return
            if any(page == x for x, _, _ in out.pages):
                raise ValueError(f"the rows of page {page!r} are not clustered")
            path = f"{folder}/{len(out.pages)}.page"
            n = self._write_page(store, path, pa.Table.from_batches(parts))
            out.pages.append((page, path, n))

        for batch in batches:
            names = batch.column("page").to_pylist()
            begin = 0
            for i in range(1, len(names) + 1):
                if i == len(names) or names[i] != names[begin]:
                    if names[begin] is None:
                        raise ValueError("a page needs a name")
                    if names[begin] != page:
                        flush()
                        page, parts = names[begin], []
                    parts.append(batch.slice(begin, i - begin))
                    begin = i
        flush()
        return out

    def _write_page(self, store: fs.FileSystem, path: str, rows: pa.Table) -> int:
        if (rows.column("slot").to_numpy() != np.arange(rows.num_rows)).any():
            raise ValueError("the slots of a page must be 0, 1, .. in order")
        key, value = compact(self.keys), compact(self.values)
        floats = lambda name: rows.column(name).to_numpy().astype("<f4").tobytes()
        cells = lambda name, width: codes.rows_of(rows.column(name).combine_chunks(), width).tobytes()
        with store.open_output_stream(path) as out:
            out.write(_page_head(len(key), len(value), rows.num_rows) + key + value)
            out.write(cells("mse", self.keys.base.code_bytes))
            out.write(cells("signs", packed_size(self.keys.dim, 1)))
            out.write(floats("res_norm"))
            out.write(cells("packed", self.values.code_bytes))
            out.write(floats("norm"))
        return rows.num_rows

    def commit(self, messages: list[Written | None]) -> None:
        store, at = _store(self.path)
        pages = [p for m in messages if m is not None for p in m.pages]
        seen = {x.path.rpartition("/")[2] for x in store.get_file_info(fs.FileSelector(at)) if x.path.endswith(".page")}
        named = [quote(page, safe="") + ".page" for page, _, _ in pages]
        if len(set(named)) < len(named) or (not self.overwrite and seen & set(named)):
            self._clear(store, at)
            raise ValueError("a page was written twice, or exists already")
        if self.overwrite:
            for name in seen - set(named):
                store.delete_file(f"{at}/{name}")
        for (_, staged, _), name in zip(pages, named):
            store.move(staged, f"{at}/{name}")
        self._clear(store, at)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_store(self.path))

    def _clear(self, store: fs.FileSystem, at: str) -> None:
        """Whatever tasks of this job have staged, also those whose messages are lost."""
        if store.get_file_info(f"{at}/{STAGED}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{at}/{STAGED}/{self.job}")
        if store.get_file_info(f"{at}/{STAGED}").type == fs.FileType.Directory and not store.get_file_info(fs.FileSelector(f"{at}/{STAGED}")):
            store.delete_dir(f"{at}/{STAGED}")


def write_pages(entries: DataFrame, path: str, keys: ProductSpec, values: QuantizerSpec, mode: str = "append") -> None:
    """entries: page, slot, mse, signs, res_norm, packed, norm, in any order."""
    entries.sparkSession.dataSource.register(PageSource)
    store, at = _store(path)
    store.create_dir(at, recursive=True)
    rows = entries.select(*NAMES).repartition("page").sortWithinPartitions("page", "slot")
    options = {"dim": keys.dim, "key_bits": keys.bits, "value_bits": values.bits, "seed": keys.seed}
    rows.write.format("kv_pages").options(**options).mode(mode).save(path)


def read_pages(spark, path: str) -> DataFrame:
    spark.dataSource.register(PageSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("kv_pages").load(path)
