"""Capture files that are tokenised step by step, and pages as a source and sink."""

import io
import json
import os
import struct
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecspark.functions import codes
from vecspark.functions.spec import ProductSpec, QuantizerSpec
from vecspark.operators import encode
from vecspark.sources import blobs, capture_files, captures, pages


def one(i, dim=4, tokens=3, **more):
    rng = np.random.default_rng(i)
    flat = rng.normal(size=2 * tokens * dim).round(3).tolist()
    return {"name": f"c{i}", "model": "m", "layer": i % 3, "heads": 2, "kv_heads": 1, "head_dim": dim, "query": rng.normal(size=2 * dim).round(3).tolist(), "keys": flat[: tokens * dim], "values": flat[tokens * dim :], **more}


def test_skim_at_any_piece_size():
    text = json.dumps({"meta": {"samples": [1, {"a": "]}"}], "x": "\\\"{["}, "samples": [one(0, note={"deep": [[{}], "}\\"]}), one(1, name='q"u{o}te\\')], "after": ["samples", {"k": []}]}, indent=1).encode()
    whole = list(capture_files.skim(io.BytesIO(text)))
    assert len(whole) == 2 and [json.loads(text[a:b])["name"] for a, b in whole] == ["c0", 'q"u{o}te\\']
    for piece in (1, 2, 7, 64):
        assert list(capture_files.skim(io.BytesIO(text), piece=piece)) == whole
    single = json.dumps(one(3)).encode()
    assert list(capture_files.skim(io.BytesIO(single), piece=3)) == [(0, len(single))]
    assert list(capture_files.skim(io.BytesIO(b' {"samples" : [ ] }'))) == []
    for bad, message in ((b'{"samples": [{"a": 1}, {"b": [1', "ends within sample 1, which begins at byte 23"), (b'{"a": "x', "ends within byte"), (b'{"a": 1}', "neither samples nor a capture"), (b'{"samples": []}}', "a bracket too many at byte 15")):
        with pytest.raises(ValueError, match=message):
            list(capture_files.skim(io.BytesIO(bad), piece=5))


def test_a_large_file_within_fixed_memory(tmp_path):
    """10,000 samples, 30 MB: skimming and reading hold a few MB."""
    path = tmp_path / "large.json"
    sample = json.dumps(one(0, 32, 6))
    with open(path, "w") as out:
        out.write('{"skipped": {"unknown": [1, 2, 3]}, "samples": [')
        for i in range(10_000):
            out.write((", " if i else "") + sample)
        out.write("]}")
    assert os.path.getsize(path) > 25 << 20
    tracemalloc.start()
    with capture_files.opened(str(path)) as file:
        found = list(capture_files.ranges(file, "large", 4 << 20))
    rows = sum(b.num_rows for r in found[:2] for b in capture_files.rows_of(str(path), *r, True))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(len(r[1]) for r in found) == 10_000 and len(found) > 5 and rows == len(found[0][1]) + len(found[1][1])
    assert peak < 32 << 20  # the samples as Python's lists would take more than 100 MB


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "many.json").write_text(json.dumps({"extra": [{"samples": 3}], "samples": [one(i, unknown={"x": [i]}) for i in range(50)]}))
    (tmp_path / "single.json").write_text(json.dumps(one(99)))
    return tmp_path


def test_scan_equals_the_plain_reader(spark, folder):
    drop = ["source", "sample"]
    want = sorted(map(str, captures.read_captures(spark, str(folder)).collect()))
    for got in (capture_files.scan_captures(spark, str(folder)), capture_files.scan_captures(spark, str(folder), range_bytes=1500)):
        assert sorted(map(str, got.drop(*drop).collect())) == want
    spark.dataSource.register(capture_files.CaptureSource)
    source = spark.read.format("attention_captures").option("range_bytes", 2000).load(str(folder))
    assert source.rdd.getNumPartitions() > 5
    assert sorted(map(str, capture_files.checked(source).drop(*drop).collect())) == want
    assert [r.sample for r in source.where("source like '%many.json'").orderBy("sample").collect()] == list(range(50))


def test_broken_samples_are_named_by_their_place(spark, tmp_path):
    text = '{"samples": [' + json.dumps(one(0)) + ', {"name": 5, "query": []}, {"name": "x" "y"}, ' + json.dumps(one(3, heads=0)) + ', {"query": [1, "a"]}]}'
    (tmp_path / "broken.json").write_text(text)
    got = {r.sample: r.capture_error for r in capture_files.scan_captures(spark, str(tmp_path)).collect()}
    assert got[0] is None and got[3] == "no heads" and len(got) == 5
    assert f"broken.json, sample 1 at byte {text.index('{' + chr(34) + 'name' + chr(34) + ': 5')}: name is no string" in got[1]
    assert "sample 2 at byte" in got[2] and "delimiter" in got[2] and "query is no array<float>" in got[4]
    with pytest.raises(Exception, match="sample 1 at byte"):
        capture_files.scan_captures(spark, str(tmp_path), mode="failfast").collect()
    (tmp_path / "broken.json").write_text(text[:-30])
    with pytest.raises(Exception, match="ends within sample"):
        capture_files.scan_captures(spark, str(tmp_path)).collect()


KEYS, VALUES = ProductSpec(16, 3, 7), QuantizerSpec(16, 2, 7)


@pytest.fixture(scope="module")
def entries(spark):
    rng = np.random.default_rng(3)
    rows = [(p, s, rng.normal(size=16).tolist()) for p, n in (("a/b c", 40), ("ü", 3), ("z", 200)) for s in range(n)]
    df = spark.createDataFrame(rows, "page string, slot int, v array<double>").repartition(4)
    return encode.quantize(encode.quantize_product(df, KEYS), VALUES).drop("v").cache()


def rows_of(df):
    return sorted((r.page, r.slot, bytes(r.mse), bytes(r.signs), r.res_norm, bytes(r.packed), r.norm) for r in df.collect())


def test_pages_round_trip_with_filters(spark, entries, tmp_path):
    path = str(tmp_path / "pages")
    os.mkdir(path)
    pages.write_pages(entries, path, KEYS, VALUES)
    assert sorted(os.listdir(path)) == ["%C3%BC.page", "a%2Fb%20c.page", "z.page"]
    read, want = pages.read_pages(spark, path), rows_of(entries)
    assert rows_of(read) == want
    for condition, keep in (
        ("page = 'z' and slot >= 10 and slot < 13", lambda p, s: p == "z" and 10 <= s < 13), ("slot = 2", lambda p, s: s == 2), ("page in ('z', 'ü') and slot > 197", lambda p, s: p in "zü" and s > 197),
        ("page = 'none'", lambda p, s: False), ("slot <= 1 and page <> 'z'", lambda p, s: s <= 1 and p != "z"), ("page = 'z' and page = 'ü'", lambda p, s: False), ("slot > 500", lambda p, s: False),
    ):
        assert rows_of(read.where(condition)) == [r for r in want if keep(r[0], r[1])], condition
    assert read.where("page = 'z' and slot < 5").rdd.getNumPartitions() == 1


def test_a_slot_range_touches_only_its_bytes(entries, tmp_path):
    path = str(tmp_path)
    pages.write_pages(entries, path, KEYS, VALUES)
    data = bytearray((tmp_path / "z.page").read_bytes())
    store, at = pages._store(path)
    file = pages.PageFile(store, f"{at}/z.page")
    head, entry = file.bytes_read, sum(file.widths)
    assert head == 24 + 25 + 25 and len(data) == head + 200 * entry
    got = file.batch("z", 50, 60)
    assert file.bytes_read - head == 10 * entry
    begin = head
    for width in file.widths:  # everything but these bytes may be anything
        for slot in range(200):
            if not 50 <= slot < 60:
                data[begin + slot * width : begin + (slot + 1) * width] = b"\xee" * width
        begin += 200 * width
    (tmp_path / "z.page").write_bytes(bytes(data))
    assert pages.PageFile(store, f"{at}/z.page").batch("z", 50, 60).equals(got)


def test_bytes_of_a_page(spark, tmp_path):
    """Worked out by hand: two entries at 4 dimensions, 2-bit keys (1 bit and a sign), 2-bit values."""
    rows = [("p", 0, b"\x05", b"\x0a", 0.5, b"\x1b", 1.0), ("p", 1, b"\x03", b"\x0c", 0.25, b"\xe4", 2.0)]
    df = spark.createDataFrame(rows, pages.SCHEMA)
    pages.write_pages(df, str(tmp_path), ProductSpec(4, 2, 9), QuantizerSpec(4, 2, 9))
    spec = struct.pack("<QQq", 4, 2, 9) + b"\x02"
    want = b"TQKV" + struct.pack("<5I", 1, 25, 25, 2, 2) + spec + spec + b"\x05\x03" + b"\x0a\x0c" + struct.pack("<2f", 0.5, 0.25) + b"\x1b\xe4" + struct.pack("<2f", 1.0, 2.0)
    assert (tmp_path / "p.page").read_bytes() == want
    blob = blobs.page_bytes(df.withColumnRenamed("page", "name"), ["name"], ProductSpec(4, 2, 9), QuantizerSpec(4, 2, 9)).first()
    assert bytes(blob.page) == want


def test_failed_writes_leave_nothing(spark, entries, tmp_path):
    path = str(tmp_path)
    bad = entries.withColumn("packed", F.when((F.col("page") == "z") & (F.col("slot") == 150), F.lit(b"\x00")).otherwise(F.col("packed")))
    with pytest.raises(Exception, match="not all codes have 4 bytes"):
        pages.write_pages(bad, path, KEYS, VALUES)
    with pytest.raises(Exception, match="slots of a page must be"):
        pages.write_pages(entries.where("slot <> 1"), path, KEYS, VALUES)
    assert os.listdir(path) == []
    pages.write_pages(entries.where("page = 'z'"), path, KEYS, VALUES)
    with pytest.raises(Exception, match="exists already"):
        pages.write_pages(entries, path, KEYS, VALUES)
    assert os.listdir(path) == ["z.page"]
    pages.write_pages(entries.where("page <> 'z'"), path, KEYS, VALUES, "overwrite")
    assert sorted(os.listdir(path)) == ["%C3%BC.page", "a%2Fb%20c.page"]


def test_page_parts_of_a_batch():
    assert codes.rows_of(codes.bytes_of(np.arange(6, dtype=np.uint8).reshape(3, 2)), 2).tolist() == [[0, 1], [2, 3], [4, 5]]
