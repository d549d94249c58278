"""A model's key/value cache: a table of codes partitioned by layer and head, with a choice of bits and seeds for each layer.

Each head of a layer has quantisers of its own, by seeds that follow from the layer's seed and the head's number.  A lookup of a layer
reads the partitions of that layer alone.  The layers' profiles stand beside the entries, so a cache can be opened again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecspark.functions import codes
from vecspark.functions.spec import VALUE_SEED, ProductSpec, QuantizerSpec, derived_seed, head_seed

from . import attention

ENTRY = "layer int, kv_head int, slot int, mse binary, signs binary, res_norm float, packed binary, norm float"
_PROFILE = "layer int, heads int, kv_heads int, head_dim int, key_bits int, value_bits int, capacity int, seed long"


@dataclass(frozen=True)
class LayerProfile:
    layer: int
    heads: int
    head_dim: int
    key_bits: int
    value_bits: int
    kv_heads: int = 0  # 0: as many as heads
    capacity: int = 0
    seed: int = 42

    def __post_init__(self):
        if self.layer < 0 or self.heads < 1 or self.kv_heads < 0 or self.capacity < 0:
            raise ValueError(f"layer, heads, kv_heads or capacity of layer {self.layer} is out of range")
        if self.heads % self.key_heads:
            raise ValueError(f"{self.heads} heads of layer {self.layer} can't share {self.key_heads} key/value heads")
        ProductSpec(self.head_dim, self.key_bits), QuantizerSpec(self.head_dim, self.value_bits)

    @property
    def key_heads(self) -> int:
        return self.kv_heads or self.heads

    @property
    def entry_bytes(self) -> int:
        return attention.entry_bytes(self.head_dim, self.key_bits, self.value_bits)

    def specs(self, kv_head: int) -> tuple[ProductSpec, QuantizerSpec]:
        """The quantisers of a head's keys and values."""
        if not 0 <= kv_head < self.key_heads:
            raise ValueError(f"layer {self.layer} has no key/value head {kv_head}")
        return _specs(self.head_dim, self.key_bits, self.value_bits, head_seed(self.seed, kv_head))


@lru_cache(256)
def _specs(dim: int, key_bits: int, value_bits: int, seed: int) -> tuple[ProductSpec, QuantizerSpec]:
    return ProductSpec(dim, key_bits, seed).solved(), QuantizerSpec(dim, value_bits, derived_seed(seed, VALUE_SEED)).solved()


class ModelCache:
    def __init__(self, spark: SparkSession, path: str, profiles: list[LayerProfile]):
        self.spark, self.path, self.profiles = spark, path, list(profiles)
        self._by_layer = {p.layer: p for p in self.profiles}
        if not self.profiles:
            raise ValueError("a model has one layer or more")
        if len(self._by_layer) < len(self.profiles):
            raise ValueError("a layer has two profiles")

    @classmethod
    def create(cls, spark: SparkSession, path: str, profiles: list[LayerProfile]) -> ModelCache:
        cache = cls(spark, path, profiles)
        spark.createDataFrame([(json.dumps([asdict(p) for p in cache.profiles]),)], "profiles string").coalesce(1).write.parquet(f"{path}/profiles")
        spark.createDataFrame([], ENTRY).write.partitionBy("layer", "kv_head").parquet(f"{path}/entries")
        return cache

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> ModelCache:
        rows = spark.read.parquet(f"{path}/profiles").collect()
        return cls(spark, path, [LayerProfile(**p) for p in json.loads(rows[0].profiles)])

    @property
    def layers(self) -> list[int]:
        """The layers' numbers, in the order of their profiles."""
        return [p.layer for p in self.profiles]

    def profile(self, layer: int) -> LayerProfile:
        if layer not in self._by_layer:
            raise ValueError(f"the model has no layer {layer}")
        return self._by_layer[layer]

    @property
    def entries(self) -> DataFrame:
        return self.spark.read.schema(ENTRY).parquet(f"{self.path}/entries")

    def layer(self, layer: int, kv_head: int | None = None) -> DataFrame:
        """The entries of a layer (of one of its heads): other partitions are not read."""
        profile = self.profile(layer)
        found = self.entries.where(F.col("layer") == layer)
        if kv_head is None:
            return found
        profile.specs(kv_head)
        return found.where(F.col("kv_head") == kv_head)

    def coded(self, rows: DataFrame) -> DataFrame:
        """rows: layer, kv_head, slot, key, value. As ENTRY; an unknown layer or head, or a vector of another length, is an error."""
        of = self._by_layer

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.column("layer").to_numpy().astype(np.int64) << 32 | batch.column("kv_head").to_numpy()
                for page in np.unique(at).tolist():
                    layer, head = page >> 32, page & 0xFFFFFFFF
                    if layer not in of:
                        raise ValueError(f"the model has no layer {layer}")
                    profile = of[layer]
                    keys, values = profile.specs(head)
                    own = batch.filter(pa.array(at == page))
                    cells, signs, left = codes.encode_product(codes.matrix_of(own.column("key"), profile.head_dim), keys)
                    plain, norm = codes.indices(codes.matrix_of(own.column("value"), profile.head_dim), values)
                    made = [codes.bytes_of(codes.pack(cells, keys.bits - 1)), codes.bytes_of(codes.pack(signs, 1)), pa.array(left.astype(np.float32)), codes.bytes_of(codes.pack(plain, values.bits)), pa.array(norm.astype(np.float32))]
                    yield pa.record_batch([*(own.column(c) for c in ("layer", "kv_head", "slot")), *made], names=[x.split()[0] for x in ENTRY.split(", ")])

        return rows.select(*(F.col(c).cast("int") for c in ("layer", "kv_head", "slot")), "key", "value").mapInArrow(run, ENTRY)

    def append(self, rows: DataFrame, order: list[str]) -> None:
        """rows: layer, kv_head, key, value and what orders them; slots go on from each head's last one."""
        last = self.entries.groupBy("layer", "kv_head").agg(F.max("slot").alias("_last"))
        place = F.row_number().over(Window.partitionBy("layer", "kv_head").orderBy(*order))
        placed = rows.join(last, ["layer", "kv_head"], "left").withColumn("slot", F.coalesce("_last", F.lit(-1)) + place)
        self.coded(placed).write.mode("append").partitionBy("layer", "kv_head").parquet(f"{self.path}/entries")

    def attend(self, layer: int, queries: DataFrame, by: list[str], scale: float = 1.0, k: int | None = None) -> DataFrame:
        """by, head, coordinate, output of queries (by, head, q): each head reads the key/value head of its group."""
        profile = self.profile(layer)
        asked = attention.grouped_heads(queries, profile.heads, profile.key_heads)
        keys, values = profile.specs(0)
        return attention.attend_codes(asked, self.layer(layer).drop("layer"), ["kv_head"], [*by, "head"], keys, values, scale, k, lambda page: profile.specs(page["kv_head"][0].as_py()))

    def sizes(self) -> DataFrame:
        """layer, kv_head, entries, live_bytes, storage_bytes (at least of the profile's capacity), raw_bytes of two float32 vectors; nulls above: sums."""
        own = F.create_map(*[F.lit(x) for p in self.profiles for x in (p.layer, p.entry_bytes)])
        room = F.create_map(*[F.lit(x) for p in self.profiles for x in (p.layer, p.capacity)])
        raw = F.create_map(*[F.lit(x) for p in self.profiles for x in (p.layer, 8 * p.head_dim)])
        pages = self.entries.groupBy("layer", "kv_head").agg(F.count("*").alias("n"))
        held = pages.withColumns({"_live": F.col("n") * own[F.col("layer")], "_room": F.greatest(F.col("n"), room[F.col("layer")]) * own[F.col("layer")], "_raw": F.col("n") * raw[F.col("layer")]})
        return held.rollup("layer", "kv_head").agg(F.sum("n").alias("entries"), F.sum("_live").alias("live_bytes"), F.sum("_room").alias("storage_bytes"), F.sum("_raw").alias("raw_bytes"))
