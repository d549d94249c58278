"""Configurations of external benchmark runs: JSON of any shape as VARIANT, checked row by row.

A file has a list `runs`.  Fields keep what they are until they are asked for, so a wrong type is a violation of its run, not an error
of the file.  Every violation is a row; a run without any is good.  Relative paths are those of the file's folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TEXTS = ("name", "workdir", "model", "perplexity_bin", "bench_bin", "baseline")
_PATHS = ("workdir", "model", "perplexity_bin", "bench_bin")
_KV = "array<struct<name: string, type_k: string, type_v: string, args: array<string>>>"
_INTS = {"perplexity": ("ctx_sizes",), "bench": ("n_prompt", "n_gen", "n_depth", "threads", "n_gpu_layers")}


def _text(x: Column) -> Column:
    return F.coalesce(F.trim(x), F.lit(""))


def resolved(folder: Column, path: Column) -> Column:
    """path, below folder where it is relative; an empty one stays empty."""
    return F.when((path == "") | path.startswith("/"), path).otherwise(F.concat(folder, F.lit("/"), path))


def kv_name(kv: Column) -> Column:
    """A variant's name: its own, or its types, or `default`."""
    k, v = F.coalesce(kv["type_k"], F.lit("")), F.coalesce(kv["type_v"], F.lit(""))
    made = F.when((k != "") & (v != ""), F.concat(k, F.lit("/"), v)).when(v != "", v).when(k != "", k).otherwise("default")
    return F.when(_text(kv["name"]) != "", kv["name"]).otherwise(made)


def read_config(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A row a run: source, run (its place), name and paths, kv_types (named), contexts, n_prompt, n_gen, has_perplexity, has_bench, violations.

    A file that is no JSON, or has no runs, is a row with a null run and its violation.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.try_parse_json("value").alias("doc"))
    runs = F.try_variant_get("doc", "$.runs", "array<variant>")
    broken = F.when(F.col("doc").isNull(), "the file is no JSON").when(F.coalesce(F.size(runs), F.lit(0)) < 1, "a configuration has one run or more")
    each = files.select("source", broken.alias("broken"), F.posexplode_outer(runs).alias("run", "r"))
    folder = F.regexp_replace("source", r"^file:(//)?|/[^/]*$", "")
    get = lambda at, kind: F.try_variant_get("r", f"$.{at}", kind)
    out = each.select(
        "source", "broken", "run", "r", *(_text(get(x, "string")).alias(x) for x in _TEXTS), get("kv_types", _KV).alias("kv"), _text(get("perplexity.dataset", "string")).alias("dataset"),
        *(F.filter(get(at, "array<int>"), lambda x: x.isNotNull()).alias(name) for at, name in (("perplexity.ctx_sizes", "contexts"), ("bench.n_prompt", "n_prompt"), ("bench.n_gen", "n_gen"))),
        F.coalesce(F.schema_of_variant(get("perplexity", "variant")) != "VOID", F.lit(False)).alias("has_perplexity"), F.coalesce(F.schema_of_variant(get("bench", "variant")) != "VOID", F.lit(False)).alias("has_bench"),
    )
    out = out.withColumns({x: resolved(folder, F.col(x)) for x in (*_PATHS, "dataset")})
    named = F.transform("kv", lambda x: F.struct(kv_name(x).alias("name"), _text(x["type_k"]).alias("type_k"), _text(x["type_v"]).alias("type_v"), F.coalesce(x["args"], F.array().cast("array<string>")).alias("args")))
    out = out.withColumn("kv_types", named).withColumn("violations", violations())
    return out.select("source", "run", *_TEXTS, "kv_types", "dataset", "contexts", "n_prompt", "n_gen", "has_perplexity", "has_bench", "violations")


def violations() -> Column:
    """All that is wrong with a run, in one order."""
    names = F.transform("kv_types", lambda x: x["name"])
    empty = lambda x: F.coalesce(F.size(x), F.lit(0)) < 1
    twice = F.filter(F.array_distinct(names), lambda n: F.size(F.filter(names, lambda m: m == n)) > 1)
    ints = lambda at: F.forall(F.try_variant_get("r", f"$.{at}", "array<int>"), lambda x: x.isNotNull())
    wrong = [F.when(F.try_variant_get("r", f"$.{at}", "variant").isNotNull() & ~F.coalesce(ints(at), F.lit(False)), F.lit(f"{at} is no list of integers")) for part, own in _INTS.items() for at in (f"{part}.{x}" for x in own)]
    inside = [
        F.when(F.col("name") == "", "a run has a name"),
        F.when(F.col("model") == "", "a run has a model"),
        F.when(F.try_variant_get("r", "$.kv_types", "variant").isNotNull() & F.col("kv").isNull(), "kv_types is no list of variants"),
        F.when(empty("kv_types"), "a run has one entry of kv_types or more"),
        F.when(F.size(twice) > 0, F.concat(F.lit("kv_types has "), F.array_join(twice, ", "), F.lit(" twice"))),
        F.when((F.col("baseline") != "") & ~F.coalesce(F.array_contains(names, F.col("baseline")), F.lit(False)), F.concat(F.lit("no entry of kv_types is the baseline "), F.col("baseline"))),
        F.when(~F.col("has_perplexity") & ~F.col("has_bench"), "a run has perplexity or bench"),
        *(F.when(F.col("has_perplexity") & condition, text) for condition, text in ((F.col("perplexity_bin") == "", "perplexity needs perplexity_bin"), (F.col("dataset") == "", "perplexity needs a dataset"), (empty("contexts"), "perplexity needs ctx_sizes"))),
        *(F.when(F.col("has_bench") & condition, text) for condition, text in ((F.col("bench_bin") == "", "bench needs bench_bin"), (empty("n_prompt") & empty("n_gen"), "bench needs n_prompt or n_gen"))),
        *wrong,
    ]
    return F.when(F.col("broken").isNotNull(), F.array("broken")).otherwise(F.filter(F.array(*inside), lambda x: x.isNotNull()))


def config_violations(runs: DataFrame) -> DataFrame:
    """source, run, name, place, violation: a row for each, of read_config()."""
    return runs.select("source", "run", "name", F.posexplode("violations").alias("place", "violation"))


def variants(runs: DataFrame) -> DataFrame:
    """source, run, name, variant, type_k, type_v, is_baseline: the variants of runs without a violation."""
    good = runs.where(F.size("violations") == 0).select("source", "run", "name", "baseline", F.explode("kv_types").alias("kv"))
    return good.select("source", "run", "name", F.col("kv.name").alias("variant"), "kv.type_k", "kv.type_v", (F.col("kv.name") == F.col("baseline")).alias("is_baseline"))
