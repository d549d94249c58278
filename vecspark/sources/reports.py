"""Reports, profiles, logs and prompts as DataFrames: declared schemas, explodes and regular expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CASE = "struct<method: string, key_bits: int, value_bits: int, requested_top_k: int, top_k: int, raw_kv_bytes: bigint, cache_live_bytes: bigint, cache_storage_bytes: bigint, compression_ratio: double, output_mse: double, output_cosine: double>"
REPORT = f"generated_at string, samples array<struct<model: string, name: string, prompt_index: int, layer: int, token_index: int, token_position: string, sequence_length: int, tokens: int, heads: int, kv_heads: int, head_dim: int, cases: array<{_CASE}>>>"
_LAYER = "struct<layer: int, heads: int, kv_heads: int, head_dim: int, key_bits: int, value_bits: int, top_k: int, capacity: int, seed: bigint>"
_PROFILE = f"label: string, profiles: array<{_LAYER}>"
BENCH = "build_commit string, type_k string, type_v string, n_prompt int, n_gen int, n_depth int, avg_ts double, stddev_ts double, samples_ts array<double>"


def read_report(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A row for each case of each sample of sweep reports; top_k is the requested one where there is one."""
    samples = spark.read.schema(REPORT).option("multiLine", True).json(path).select(F.explode("samples").alias("s"))
    cases = samples.select("s.*").withColumn("case", F.explode("cases")).drop("cases")
    rows = cases.select("*", "case.*").drop("case")
    return rows.withColumn("top_k", F.coalesce(F.nullif(F.col("requested_top_k"), F.lit(0)), F.col("top_k")))


def read_profiles(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """label and a layer's choice, of files with one profile report or a bundle under "reports". The default label is "all"."""
    raw = spark.read.schema(f"label string, profiles array<{_LAYER}>, reports array<struct<{_PROFILE}>>").option("multiLine", True).json(path)
    bundle = F.when(F.size("reports") > 0, F.col("reports")).otherwise(F.array(F.struct("label", "profiles")))
    each = raw.select(F.explode(bundle).alias("r")).select(F.coalesce(F.nullif(F.trim("r.label"), F.lit("")), F.lit("all")).alias("label"), "r.profiles")
    checked = F.when(F.size("profiles") > 0, F.col("profiles")).otherwise(F.raise_error("a report has no profiles").cast(f"array<{_LAYER}>"))
    rows = each.select("label", F.explode(checked).alias("p")).select("label", "p.*")
    return rows.withColumn("kv_heads", F.coalesce(F.nullif(F.col("kv_heads"), F.lit(0)), F.col("heads")))


def read_bench(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Throughput samples with their kind."""
    from vecspark.functions.columns import bench_kind

    return spark.read.schema(BENCH).option("multiLine", True).json(path).withColumn("kind", bench_kind("n_prompt", "n_gen")).orderBy("kind", "n_depth", "n_prompt", "n_gen")


_NUMBER = r"([-+]?\d+(?:\.\d*)?(?:[eE][-+]?\d+)?)"
_TYPE = r"\(\s*([^\s()]+)\s*\)"
#: The lines of an inference tool's log that are read; only their words are fixed.
FINAL = rf"Final estimate: *PPL *= *{_NUMBER} *\+/- *{_NUMBER}"
OLDER = rf"perplexity: *{_NUMBER}"
TOTALS = rf"size *= *{_NUMBER} *MiB\b[^\n]*?\bK *{_TYPE} *: *{_NUMBER} *MiB *, *V *{_TYPE} *: *{_NUMBER} *MiB"
#: A word is tried from its start alone (or from where the match before ended), and not again from each of its characters.
BUFFER = rf"(?:\G|(?<![\w.+:-]))([\w.+:-]++) +KV buffer size *= *{_NUMBER} *MiB"


def _fields(match: Column, pattern: str, count: int) -> Column:
    """The groups of a whole match of a pattern, none of which can hold a line feed; null for null."""
    return F.split(F.regexp_replace(match, F.lit(pattern), F.lit("\n".join(f"${i + 1}" for i in range(count)))), "\n")


def _once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, which is worked out once, however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _double(fields: Column, i: int) -> Column:
    return F.get(fields, F.lit(i)).try_cast("double")


def perplexity(text: Column) -> Column:
    """struct(value, error): the final estimate, else the last older form."""
    older = F.try_element_at(F.regexp_extract_all(text, F.lit(OLDER), F.lit(1)), F.lit(-1)).try_cast("double")
    final = _fields(F.regexp_substr(text, F.lit(FINAL)), FINAL, 2)
    return _once(final, lambda f: F.struct(F.coalesce(_double(f, 0), older).alias("value"), _double(f, 1).alias("error")))


def kv_memory(text: Column) -> Column:
    """struct(total, key_type, k, value_type, v, buffer, buffers): MiB and types of the last totals line, the sum and the list (name,
    mib) of buffer lines; null if there is neither."""
    totals = _fields(F.try_element_at(F.regexp_extract_all(text, F.lit(TOTALS), F.lit(0)), F.lit(-1)), TOTALS, 5)
    line = lambda f: F.struct(F.get(f, F.lit(0)).alias("name"), F.coalesce(_double(f, 1), F.lit(0.0)).alias("mib"))
    # No match goes over the end of a line, so only lines with the words are searched.
    some = F.filter(F.split(text, "\n"), lambda x: x.contains("KV buffer size"))
    lines = F.transform(F.flatten(F.transform(some, lambda x: F.regexp_extract_all(x, F.lit(BUFFER), F.lit(0)))), lambda m: _once(_fields(m, BUFFER, 2), line))

    def found(x: Column) -> Column:
        last = lambda i: F.coalesce(_double(x["t"], i), F.lit(0.0))
        kind = lambda i: F.trim(F.get(x["t"], F.lit(i)))
        made = F.struct(last(0).alias("total"), kind(1).alias("key_type"), last(2).alias("k"), kind(3).alias("value_type"), last(4).alias("v"), x["sum"].alias("buffer"), x["b"].alias("buffers"))
        return F.when((last(0) > 0) | (x["sum"] > 0), made)

    summed = lambda x: F.struct(x["t"].alias("t"), x["b"].alias("b"), F.aggregate(x["b"], F.lit(0.0), lambda a, y: a + y["mib"]).alias("sum"))
    return _once(_once(F.struct(totals.alias("t"), lines.alias("b")), summed), found)


def read_logs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    logs = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return logs.select("path", perplexity(F.col("text")).alias("perplexity"), kv_memory(F.col("text")).alias("memory"))


def prompts(text: Column) -> Column:
    """The prompts of a file: a JSON array of strings, or parts between blank lines; trimmed, empty ones dropped."""
    parts = F.when(F.ltrim(text).startswith("["), F.from_json(text, "array<string>")).otherwise(F.split(F.regexp_replace(text, "\r\n", "\n"), r"\n[ \t]*\n"))
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x.isNotNull() & (x != ""))


def read_prompts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.posexplode(prompts(F.col("value"))).alias("prompt_index", "prompt"))


def metric_lines(requests: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """Lines in the text exposition format: a counter of requests (endpoint, backend, status) for each label set, their totals by class of
    status, and a gauge of live sessions if those are given."""
    counts = requests.groupBy("endpoint", "backend", "status").count()
    parts = [
        counts.select(F.lit(1).alias("part"), F.format_string('requests_total{endpoint="%s",backend="%s",status="%s"} %d', "endpoint", "backend", F.col("status").cast("string"), "count").alias("value")),
        counts.groupBy(F.format_string("%dxx", F.floor(F.col("status") / 100)).alias("class")).agg(F.sum("count").alias("n")).select(F.lit(2).alias("part"), F.format_string('responses_total{class="%s"} %d', "class", "n").alias("value")),
    ]
    if sessions is not None:
        parts.append(sessions.agg(F.count("*").alias("n")).select(F.lit(3).alias("part"), F.format_string("sessions %d", "n").alias("value")))
    kinds = parts[0].sparkSession.createDataFrame([(1, "# TYPE requests_total counter"), (2, "# TYPE responses_total counter"), (3, "# TYPE sessions gauge")][: len(parts)], "part int, value string")
    lines = kinds.withColumn("kind", F.lit(0))
    for p in parts:
        lines = lines.unionByName(p.withColumn("kind", F.lit(1)))
    return lines.orderBy("part", "kind", "value").select("value")


def _nested(rows: DataFrame, by: list[str], cell: str, own: list[str], order: list[str]) -> DataFrame:
    """by, and the other rows' columns `own` as a list of structs, in order."""
    key = [F.col(x) for x in order]
    kept = F.transform(F.array_sort(F.collect_list(F.struct(*(k.alias(f"_{i}") for i, k in enumerate(key)), F.struct(*own).alias("x")))), lambda y: y["x"])
    return rows.groupBy(*by).agg(kept.alias(cell))


SAMPLE = ["model", "name", "prompt_index", "layer", "token_index", "token_position", "sequence_length", "tokens", "heads", "kv_heads", "head_dim"]
CASE = ["method", "key_bits", "value_bits", "requested_top_k", "top_k", "raw_kv_bytes", "cache_live_bytes", "cache_storage_bytes", "compression_ratio", "output_mse", "output_cosine"]


#: Samples of a report that write_report() puts in one file.
REPORT_SAMPLES = 1000


def write_report(cases: DataFrame, path: str, generated_at: str = "") -> None:
    """cases (the columns SAMPLE and CASE, a row a case) as sweep reports that read_report() reads: files of about REPORT_SAMPLES samples, each a whole report."""
    samples = _nested(cases, SAMPLE, "cases", CASE, ["method", "key_bits", "value_bits", "top_k"])
    parts = max(1, -(-cases.select(*SAMPLE).distinct().count() // REPORT_SAMPLES))
    dealt = samples.groupBy(F.pmod(F.xxhash64(*SAMPLE), F.lit(parts)).alias("part")).agg(F.sort_array(F.collect_list(F.struct(*SAMPLE, "cases"))).alias("samples"))
    dealt.select(F.lit(generated_at).alias("generated_at"), "samples").write.mode("errorifexists").option("maxRecordsPerFile", 1).json(path)


LAYER = ["layer", "heads", "kv_heads", "head_dim", "key_bits", "value_bits", "top_k", "capacity", "seed"]


def write_profiles(choices: DataFrame, path: str) -> None:
    """choices (label and the columns LAYER) as a bundle of profile reports that read_profiles() reads: one file, a report a label."""
    reports = _nested(choices, ["label"], "profiles", LAYER, ["layer"]).select(F.struct("label", "profiles").alias("r"))
    reports.agg(F.sort_array(F.collect_list("r")).alias("reports")).coalesce(1).write.mode("errorifexists").json(path)
