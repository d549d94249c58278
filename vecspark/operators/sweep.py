"""Evaluation results: summaries by configuration, best cases, frontiers, groupings by layer, token count and position.

A case is a row: sample, method, key_bits, value_bits, top_k, output_mse, output_cosine, raw_bytes, storage_bytes, and for
groupings layer, tokens and position.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecspark.functions import columns as c

CONFIG = ["method", "key_bits", "value_bits", "top_k"]


def ordered_unique(text: str, kind: type = int) -> list:
    """The items of a comma-separated list, each once, in their order."""
    return list(dict.fromkeys(kind(x.strip()) for x in text.split(",") if x.strip()))


def grid(samples: DataFrame, methods: Iterable[str], key_bits: Iterable[int], value_bits: Iterable[int], top_k: Iterable[int]) -> DataFrame:
    """Every sample with every configuration: nested explodes, no join."""
    out = samples
    for name, values in zip(CONFIG, (methods, key_bits, value_bits, top_k)):
        out = out.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return out


def _best(by: str) -> list[Column]:
    """Orders for the three contests: ties go to the other measures, then to the smaller configuration."""
    mse, cosine, size = F.col("output_mse"), F.desc("output_cosine"), F.col("storage_bytes")
    first = {"mse": [mse, cosine, size], "cosine": [cosine, mse, size], "size": [size, mse, cosine]}[by]
    return [*first, *map(F.col, CONFIG)]


def best_cases(cases: DataFrame, by: str) -> DataFrame:
    """Each sample's best case by 'mse', 'cosine' or 'size'."""
    return cases.withColumn("_n", c.best_first(*_best(by), by=["sample"])).where("_n = 1").drop("_n")


def lower_ranks(rows: DataFrame, by: list[str], column: str, shares: dict[str, float]) -> DataFrame:
    """by, and for each name the element at place floor(share (n - 1)) of the group's sorted values: values are counted first, and the counts
    are added up in order, so no group's values are in one row."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*by)
    upto = counts.withColumn("_upto", F.sum("_n").over(group.orderBy(column).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_n").over(group))
    at = lambda share: F.floor(F.lit(share) * (F.col("_all") - 1))
    return upto.groupBy(*by).agg(*[F.max(F.when((F.col("_upto") - F.col("_n") <= at(p)) & (at(p) < F.col("_upto")), F.col(column))).alias(name) for name, p in shares.items()])


#: Values whose powers of two differ by less than this many are added up as integers of one scale, in two halves of so many bits.
_POWERS, _HALF = 4, 28


def steady_means(rows: DataFrame, by: list[str], names: dict[str, str]) -> DataFrame:
    """by, and for each column its mean under the name given, whatever the order in which rows are added: groups of the same values have the same mean,
    to the last bit, where sums of doubles would put one before the other by chance.

    Values of like size are added as integers (up to 2^35 rows of a size and group; more are an error), their few sums from the smallest size on.
    Non-finite values count as in avg().
    """
    x = {i: F.col(name).cast("double") for i, name in enumerate(names)}
    k = {i: F.col(f"_k{i}") for i in x}
    power = lambda n: F.pow(F.lit(2.0), n * _POWERS)
    finite = {i: (F.abs(v) < float("inf")) & (v != 0) for i, v in x.items()}
    # Below 2^-1000 a value is scaled less, as its inverse would be no number.
    sized = rows.withColumns({f"_k{i}": F.when(finite[i], F.greatest(F.floor(F.log2(F.abs(v)) / _POWERS).cast("int"), F.lit(-1000 // _POWERS))) for i, v in x.items()})
    scaled = sized.withColumns({f"_v{i}": v * power(-k[i]) * float(1 << 52 - _HALF) for i, v in x.items()})
    high = {i: F.floor(F.col(f"_v{i}")) for i in x}
    low = {i: F.floor((F.col(f"_v{i}") - high[i]) * float(1 << _HALF)) for i in x}
    # The rest are zeros and what isn't finite; their sum has no rounding.
    part = lambda i: F.struct(F.lit(i).alias("i"), k[i].alias("k"), F.sum(high[i]).alias("h"), F.sum(low[i]).alias("l"), F.sum(F.when(~finite[i], x[i])).alias("rest"), F.count(x[i]).alias("n"))
    parts = scaled.groupBy(*by, *k.values()).agg(F.array(*map(part, x)).alias("_parts"))
    sums = parts.select(*by, F.inline("_parts")).groupBy(*by, "i", "k").agg(*(F.sum(name).alias(name) for name in ("h", "l", "rest", "n")))
    value = F.coalesce((F.col("h") * float(1 << _HALF) + F.col("l")) * 2.0**-52 * power(F.col("k")), F.col("rest"))
    own = lambda i: F.array_sort(F.collect_list(F.when(F.col("i") == i, F.struct("k", value.alias("x")))))
    total = lambda i: F.aggregate(own(i), F.lit(0.0), lambda a, p: a + F.coalesce(p["x"], F.lit(0.0)))
    return sums.groupBy(*by).agg(*(F.try_divide(total(i), F.sum(F.when(F.col("i") == i, F.col("n")))).alias(name) for i, name in enumerate(names.values())))


def with_steady_means(means: DataFrame, rows: DataFrame, by: list[str], names: dict[str, str]) -> DataFrame:
    """means (a row for each group of rows) with steady_means(); nulls are groups too."""
    own = steady_means(rows, by, names).withColumnsRenamed({x: f"_{x}" for x in by})
    on = [F.col(x).eqNullSafe(F.col(f"_{x}")) for x in by]
    return means.join(own, on).drop(*(f"_{x}" for x in by))


def summary(cases: DataFrame) -> DataFrame:
    """A row a configuration: counts, means, percentiles (lower ranks) and wins in the three contests."""
    ranks = [lower_ranks(cases, CONFIG, "output_mse", {"p50_mse": 0.5, "p95_mse": 0.95}), lower_ranks(cases, CONFIG, "output_cosine", {"p05_cosine": 0.05, "p50_cosine": 0.5})]
    ranked = cases
    for by in ("mse", "cosine", "size"):
        ranked = ranked.withColumn(f"_{by}", (c.best_first(*_best(by), by=["sample"]) == 1).cast("long"))
    means = ranked.groupBy(*CONFIG).agg(
        F.count("*").alias("cases"),
        F.max("output_mse").alias("max_mse"),
        F.min("output_cosine").alias("min_cosine"),
        F.avg("storage_bytes").alias("mean_storage"),
        F.avg(F.try_divide(F.col("raw_bytes").cast("double"), F.col("storage_bytes"))).alias("mean_compression"),
        *[F.sum(f"_{by}").alias(f"{by}_wins") for by in ("mse", "cosine", "size")],
    )
    means = with_steady_means(means, cases, CONFIG, {"output_mse": "mean_mse", "output_cosine": "mean_cosine"})
    for r in ranks:
        means = means.join(r, CONFIG)
    return means.select(*CONFIG, "cases", "mean_mse", "p50_mse", "p95_mse", "max_mse", "mean_cosine", "p05_cosine", "p50_cosine", "min_cosine", "mean_storage", "mean_compression", *[f"{by}_wins" for by in ("mse", "cosine", "size")])


def frontier(summaries: DataFrame, size: str = "mean_storage", mse: str = "mean_mse", cosine: str = "mean_cosine") -> DataFrame:
    """Rows that no other one dominates: not larger, not less exact, and better in one of the three. A row for each
    configuration, so the sides are small; equal rows all stay."""
    a, b = summaries.alias("a"), summaries.alias("b")
    better = (F.col(f"b.{size}") < F.col(f"a.{size}")) | (F.col(f"b.{mse}") < F.col(f"a.{mse}")) | (F.col(f"b.{cosine}") > F.col(f"a.{cosine}"))
    return a.join(b, (F.col(f"b.{size}") <= F.col(f"a.{size}")) & (F.col(f"b.{mse}") <= F.col(f"a.{mse}")) & better, "left_anti")


def groupings(cases: DataFrame) -> DataFrame:
    """Means of each configuration over all, by method, by layer, by token count and by position, in one pass (grouping sets).

    dimension: which of the five; label: its value as text; place: 1 for the group's best (mean error, then cosine, size).
    """
    keys = ["key_bits", "value_bits", "top_k"]
    sets = ", ".join(f"({d}, {', '.join(keys)})" for d in ("method", "layer", "tokens", "position")) + f", ({', '.join(keys)})"
    means = cases.sparkSession.sql(f"""
        SELECT CASE WHEN grouping(method) = 0 THEN 'method' WHEN grouping(layer) = 0 THEN 'layer' WHEN grouping(tokens) = 0 THEN 'tokens' WHEN grouping(position) = 0 THEN 'position' ELSE 'overall' END AS dimension,
               coalesce(method, CAST(layer AS STRING), CAST(tokens AS STRING), position, 'all') AS label, {", ".join(keys)},
               count(*) AS cases, avg(output_mse) AS mean_mse, avg(output_cosine) AS mean_cosine, avg(storage_bytes) AS mean_storage
        FROM {{cases}} GROUP BY GROUPING SETS ({sets})""", cases=cases)
    order = Window.partitionBy("dimension", "label").orderBy(F.round("mean_mse", 9), F.desc(F.round("mean_cosine", 9)), "mean_storage", *keys)
    return means.withColumn("place", F.row_number().over(order))
