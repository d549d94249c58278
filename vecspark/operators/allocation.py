"""Choosing a configuration for each layer: candidates, skyline, floors, and the best set under a budget.

Candidates are a row a (layer, configuration).  The choice under a budget is a knapsack with one item of each layer; its
table has a row for each layer's few candidates, so each profile set is worked out by one task, sets in parallel.
"""

from __future__ import annotations

from math import ceil

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecspark.functions import columns as c
from vecspark.functions.spec import SEED_STEP

from .sweep import with_steady_means

KEYS = ["key_bits", "value_bits", "top_k"]
_CHOSEN = "set string, layer int, key_bits int, value_bits int, top_k int, storage_bytes double, mean_mse double"


SHAPE = ["heads", "kv_heads", "head_dim"]


def candidates(cases: DataFrame, method: str | None = None, positions: list[str] | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Means, the 5th percentile (interpolated) and the minimum of the cosine, for each layer and configuration (and by, if given).

    method, positions: only cases of these (all, if not given).  Samples of one layer have one shape, where cases have those columns; another
    one is an error when the result is used.
    """
    if method is not None:
        cases = cases.where(c.normal_method("method") == method)
    if positions:
        cases = cases.where(c.position_label("position").isin([*positions]))
    shape = [x for x in SHAPE if x in cases.columns]
    found = cases.groupBy(*by, "layer", *KEYS).agg(
        F.count("*").alias("cases"),
        F.percentile("output_cosine", F.lit(0.05)).alias("p05_cosine"),
        F.min("output_cosine").alias("min_cosine"),
        F.avg("raw_bytes").alias("raw_bytes"),
        F.avg("storage_bytes").alias("storage_bytes"),
        F.avg(F.try_divide(F.col("raw_bytes").cast("double"), F.col("storage_bytes"))).alias("compression"),
        F.max("tokens").alias("capacity"),
        *[f(x).alias(f"_{name}_{x}") for x in shape for name, f in (("least", F.min), ("most", F.max))],
    )
    found = with_steady_means(found, cases, [*by, "layer", *KEYS], {"output_mse": "mean_mse", "output_cosine": "mean_cosine"})
    for x in shape:
        layer = Window.partitionBy(*by, "layer")
        least, most = F.min(f"_least_{x}").over(layer), F.max(f"_most_{x}").over(layer)
        one = F.when(least == most, least).otherwise(F.raise_error(F.format_string(f"samples of layer %d differ in {x}", "layer")).cast("int"))
        found = found.withColumn(x, one).drop(f"_least_{x}", f"_most_{x}")
    return found


def skyline(found: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Per layer, in the order of size, only what is more exact than all before it."""
    order = Window.partitionBy(*by, "layer").orderBy("storage_bytes", "mean_mse", F.desc("mean_cosine"), *KEYS)
    before = F.min("mean_mse").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return found.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("mean_mse") < F.col("_before"))).drop("_before")


def floors(found: DataFrame, mean_cosine: float | None = None, p05_cosine: float | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """What keeps both floors. A layer without such a candidate is an error when the result is used."""
    fits = F.lit(True)
    for name, least in (("mean_cosine", mean_cosine), ("p05_cosine", p05_cosine)):
        if least is not None:
            fits &= F.col(name) >= least
    marked = found.withColumn("_fits", fits).withColumn("_some", F.max(fits.cast("int")).over(Window.partitionBy(*by, "layer")))
    checked = F.when(F.col("_some") == 0, F.raise_error(F.format_string("layer %d has no candidate above the floors", "layer")).cast("boolean")).otherwise(F.col("_fits"))
    return marked.where(checked).drop("_fits", "_some")


def best_by(found: DataFrame, what: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Each layer's candidate: 'mse' (most exact, then smallest) or 'size' (smallest, then most exact)."""
    order = ["mean_mse", "storage_bytes"] if what == "mse" else ["storage_bytes", "mean_mse"]
    return found.withColumn("_n", F.row_number().over(Window.partitionBy(*by, "layer").orderBy(*order, F.desc("mean_cosine"), *KEYS))).where("_n = 1").drop("_n")


def choose(layers: list[list[tuple[float, float]]], budget: float, unit: float) -> list[int] | None:
    """One (size, error) of each layer so that the errors' sum is least and the sizes, each rounded up to units, fit; None if
    none do. Ties go to fewer units. Only states that no smaller one beats are kept from layer to layer."""
    room = ceil(budget / unit)
    states: list[tuple[int, float, tuple[int, ...]]] = [(0, 0.0, ())]
    for options in layers:
        grown = sorted((used + ceil(size / unit), error + more, path + (i,)) for used, error, path in states for i, (size, more) in enumerate(options) if used + ceil(size / unit) <= room)
        states, least = [], float("inf")
        for state in grown:
            if state[1] < least:
                states.append(state)
                least = state[1]
    return list(states[-1][2]) if states else None


def allocate(found: DataFrame, budgets: DataFrame, unit: float = 1.0) -> DataFrame:
    """set, layer and the chosen configuration. budgets: set, budget in bytes (null: the most exact of each layer), and, if there is such a
    column, compression: raw bytes of the layers by this are the budget then.  Each set chooses among all of found, or, where found has a column set,
    among its own."""
    budget_of = budgets.select("set", "budget", F.col("compression") if "compression" in budgets.columns else F.lit(None).cast("double").alias("compression"))
    if budget_of.count() > MOST_SETS:
        raise ValueError(f"more than {MOST_SETS} sets are not broadcast")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["layer", "storage_bytes", "mean_mse", *KEYS])
        groups = [g for _, g in rows.groupby("layer", sort=True)]
        budget, ratio = rows["budget"].iloc[0], rows["compression_target"].iloc[0]
        if not pd.isna(ratio):
            budget = sum(g["raw_bytes"].iloc[0] for g in groups) / ratio
        if pd.isna(budget):
            picked = [int(g["mean_mse"].argmin()) for g in groups]
        else:
            picked = choose([list(zip(g["storage_bytes"], g["mean_mse"])) for g in groups], float(budget), unit)
            if picked is None:
                raise ValueError(f"no choice of candidates fits {budget} bytes")
        return pd.concat([g.iloc[[i]] for g, i in zip(groups, picked)])[["set", "layer", *KEYS, "storage_bytes", "mean_mse"]]

    raw = found if "raw_bytes" in found.columns else found.withColumn("raw_bytes", F.lit(None).cast("double"))
    asked = F.broadcast(budget_of.withColumnRenamed("compression", "compression_target"))
    return (raw.join(asked, "set") if "set" in found.columns else raw.join(asked)).groupBy("set").applyInPandas(run, _CHOSEN)


MOST_SETS = 10_000


def selection_mode(max_storage: float = 0, min_compression: float = 0, mean_cosine: float = 0, p05_cosine: float = 0) -> str:
    """How a profile is chosen under these limits; 0 is none."""
    floor, budget = mean_cosine > 0 or p05_cosine > 0, max_storage > 0 or min_compression > 0
    return {(False, False): "best-mse", (True, False): "fidelity-floor", (False, True): "budgeted", (True, True): "budgeted-fidelity-floor"}[floor, budget]


def select_profile(found: DataFrame, name: str = "all", max_storage: float = 0, min_compression: float = 0, mean_cosine: float = 0, p05_cosine: float = 0, unit: float = 1.0) -> DataFrame:
    """candidates() with set, mode: one of each layer, of the skyline and above the floors; the smallest under floors alone, the best sum of
    errors under a budget (bytes, or raw bytes by a compression), the most exact otherwise."""
    mode = selection_mode(max_storage, min_compression, mean_cosine, p05_cosine)
    left = floors(skyline(found), mean_cosine or None, p05_cosine or None)
    if mode in ("best-mse", "fidelity-floor"):
        chosen = best_by(left, "mse" if mode == "best-mse" else "size")
    else:
        budget = [(name, None if min_compression > 0 else float(max_storage), float(min_compression) if min_compression > 0 else None)]
        picked = allocate(left, found.sparkSession.createDataFrame(budget, "set string, budget double, compression double"), unit)
        chosen = left.join(F.broadcast(picked.select("layer", *KEYS)), ["layer", *KEYS])  # a row a layer
    return chosen.select(F.lit(name).alias("set"), F.lit(mode).alias("mode"), *found.columns)


def set_names(text: str, whole: bool = True) -> list[str]:
    """The names of a comma-separated list of positions (and of `all`, if whole), by their common names, each once, `all` first and then in order."""
    out = []
    for x in (p.strip().lower() for p in text.split(",")):
        name = "all" if whole and x == "all" else c.SYNONYMS.get(x)
        if x and name is None:
            raise ValueError(f"unknown {'set' if whole else 'position'} {x!r}")
        if x and name not in out:
            out.append(name)
    return sorted(out, key=["all", *c.POSITIONS].index)


def select_sets(cases: DataFrame, sets: str = "all", positions: str = "", method: str = "primary", max_storage: float = 0, min_compression: float = 0, mean_cosine: float = 0, p05_cosine: float = 0, unit: float = 1.0) -> DataFrame:
    """select_profile() for several sets in one plan: `all` chooses among all cases, a position's name among the cases there.

    positions: only cases at these, in every set.  A set without a case is an error when the result is used.
    """
    names, at = set_names(sets), set_names(positions, False)
    if not names:
        raise ValueError("there is no set")
    of = F.array(*[F.lit(x) if x == "all" else F.when(c.position_label("position") == x, F.lit(x)) for x in names])
    each = cases.withColumn("set", F.explode(F.filter(of, lambda x: x.isNotNull())))
    by = ("set",)
    found = candidates(each, method, at or None, by)
    asked = cases.sparkSession.createDataFrame([(x,) for x in names], "set string")
    whole = asked.join(found, "set", "left")
    there = F.when(F.col("layer").isNull(), F.raise_error(F.concat(F.lit("no cases for the set "), F.col("set"))).cast("boolean")).otherwise(True)
    left = floors(skyline(whole.where(there), by), mean_cosine or None, p05_cosine or None, by)
    mode = selection_mode(max_storage, min_compression, mean_cosine, p05_cosine)
    if mode in ("best-mse", "fidelity-floor"):
        chosen = best_by(left, "mse" if mode == "best-mse" else "size", by)
    else:
        budget = [(x, None if min_compression > 0 else float(max_storage), float(min_compression) if min_compression > 0 else None) for x in names]
        picked = allocate(left, cases.sparkSession.createDataFrame(budget, "set string, budget double, compression double"), unit)
        chosen = left.join(picked.select("set", "layer", *KEYS), ["set", "layer", *KEYS])
    return chosen.withColumn("mode", F.lit(mode)).select("set", "mode", *(x for x in found.columns if x != "set"))


def allocation_summary(chosen: DataFrame) -> DataFrame:
    """Of each set: layers, samples, mean errors, total raw and stored bytes, and their ratio."""
    out = chosen.groupBy("set").agg(
        F.count("*").alias("layers"), F.sum("cases").alias("samples"), F.avg("mean_mse").alias("mean_mse"), F.avg("mean_cosine").alias("mean_cosine"),
        F.sum("raw_bytes").alias("raw_bytes"), F.sum("storage_bytes").alias("storage_bytes"),
    )
    return out.withColumn("compression", F.try_divide("raw_bytes", "storage_bytes"))


def layer_profiles(chosen: DataFrame, seed: int = 42, capacity: int = 0) -> DataFrame:
    """The choice as rows of a profile: the capacity given or the layer's most tokens, and a seed of its own for each layer."""
    own = F.lit(seed).bitwiseXOR((F.col("layer") + 1).cast("long") * F.lit(SEED_STEP))
    room = F.lit(capacity) if capacity > 0 else F.col("capacity")
    return chosen.withColumn("capacity", room.cast("int")).withColumn("seed", own)


def expand(profile: DataFrame, layers: DataFrame) -> DataFrame:
    """The profile for all layers: one that it lacks gets the nearest profiled layer's row (the lower one of two).

    donor: the layer that a row is from. The nearest are found by the last profiled layer before and the first one after,
    in windows over the layers, not by comparing all with all.
    """
    names = profile.columns
    marks = layers.select("layer").distinct().join(profile.select("layer", F.col("layer").alias("_own")), "layer", "full")
    before = F.last("_own", True).over(Window.orderBy("layer").rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_own", True).over(Window.orderBy("layer").rowsBetween(0, Window.unboundedFollowing))
    nearer = F.when(before.isNull() | (after - F.col("layer") < F.col("layer") - before), after).otherwise(before)
    wanted = marks.withColumn("donor", nearer).select(F.col("layer").alias("_layer"), "donor")
    rows = profile.withColumnRenamed("layer", "donor").join(wanted, "donor").withColumnRenamed("_layer", "layer")
    return rows.select(*names, "donor")


def against_baseline(runs: DataFrame, baseline: str, keys: list[str], measure: str) -> DataFrame:
    """Each variant's measure with the baseline's at the same keys: ratio and delta. Rows without one or with a zero one go."""
    base = runs.where(F.col("variant") == baseline).select(*keys, F.col(measure).alias("baseline_value")).where("baseline_value <> 0")
    other = runs.where(F.col("variant") != baseline)
    return other.join(base, keys).withColumn("ratio", F.col(measure) / F.col("baseline_value")).withColumn("delta", F.col(measure) - F.col("baseline_value"))
