"""Accumulators of runs: summaries of layers and of whole runs, and counts that are taken in the pass that does the work.

A measured layer is a row: group (the run), layer, tokens, raw_fp32, raw_fp16, live_bytes, storage_bytes, append_ms, attention_ms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .sweep import lower_ranks

_MEANS = {"raw_fp32": "mean_raw_fp32", "raw_fp16": "mean_raw_fp16", "live_bytes": "mean_live_bytes", "storage_bytes": "mean_storage_bytes", "append_ms": "mean_append_ms", "attention_ms": "mean_attention_ms"}


def _rate(count: Column | str, ms: str) -> Column:
    """Things a second; 0 where no time was measured."""
    n = F.col(count) if isinstance(count, str) else count
    return F.when((F.col(ms) > 0) & (n > 0), n * 1000.0 / F.col(ms)).otherwise(0.0)


def _ratios(rows: DataFrame) -> DataFrame:
    """Both compression ratios, of means; null without bytes."""
    return rows.withColumns({f"compression_vs_{x}": F.try_divide(f"mean_raw_{x}", F.nullif("mean_live_bytes", F.lit(0.0))) for x in ("fp32", "fp16")})


def layer_summaries(runs: DataFrame) -> DataFrame:
    """A row a layer: runs, mean tokens, bytes, times and rates, and what is saved against both float forms."""
    means = [F.avg(F.col(x).cast("double")).alias(name) for x, name in _MEANS.items()]
    out = runs.groupBy("layer").agg(F.count("*").alias("runs"), F.avg("tokens").alias("mean_tokens"), *means, F.avg(_rate("tokens", "append_ms")).alias("mean_tokens_per_s"), F.avg(_rate(F.lit(1), "attention_ms")).alias("mean_queries_per_s"))
    return _ratios(out)


def run_summary(runs: DataFrame) -> DataFrame:
    """One row over all groups: sums within a group first, then their means; groups a second by the time of a whole group."""
    sums = [F.sum(x).alias(x) for x in ("tokens", *_MEANS)]
    groups = runs.groupBy("group").agg(F.count("*").alias("layers"), *sums).withColumn("total_ms", F.col("append_ms") + F.col("attention_ms"))
    means = [F.avg(F.col(x).cast("double")).alias(name) for x, name in {**_MEANS, "total_ms": "mean_total_ms"}.items()]
    rates = [F.avg(_rate("tokens", "append_ms")).alias("mean_tokens_per_s"), F.avg(_rate("layers", "attention_ms")).alias("mean_queries_per_s"), F.avg(_rate(F.lit(1), "total_ms")).alias("mean_groups_per_s")]
    return _ratios(groups.agg(F.count("*").alias("runs"), F.coalesce(F.sum("layers"), F.lit(0)).alias("layer_runs"), *means, *rates))


def turn_summaries(turns: DataFrame, by: list[str]) -> DataFrame:
    """by, ok, failed, total_ms, mean_ms, assistant_chars, p50_ms, p95_ms of turns (by, duration_ms, assistant_chars, error).

    A turn with an error counts as failed, and in the total and mean time; characters and percentiles (the value at or below the rank) are of the others.
    """
    fine = F.coalesce(F.col("error"), F.lit("")) == ""
    out = turns.groupBy(*by).agg(
        F.count_if(fine).alias("ok"), F.count_if(~fine).alias("failed"), F.sum("duration_ms").alias("total_ms"), F.avg("duration_ms").alias("mean_ms"), F.coalesce(F.sum(F.when(fine, F.col("assistant_chars"))), F.lit(0)).alias("assistant_chars"),
    )
    ranks = lower_ranks(turns.where(fine), by, "duration_ms", {"p50_ms": 0.5, "p95_ms": 0.95})
    return out.join(ranks, by, "left")


def observed(df: DataFrame, name: str, **bytes_of: str) -> tuple[DataFrame, Observation]:
    """df, and what a pass over it counts: rows, and the bytes of binary columns (name = column). No pass of its own; ask after the action."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *(F.coalesce(F.sum(F.octet_length(c)), F.lit(0)).alias(n) for n, c in bytes_of.items())), seen
