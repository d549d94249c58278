"""Requests: where each goes, and how many there were of each outcome; on tables and on streams alike.

`routed` joins requests with routes and backends, tables that may change while a stream runs: each batch reads them anew.  What can't be
routed keeps its row, with the reason; `split` writes both sides of a stream from one pass.  `windows` counts by time windows behind a
watermark.  `count_into` is a sink for totals: a batch's counts replace what an earlier attempt of the same batch has written, so a
batch counts once whatever is repeated, and late rows count too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

COUNTED = ["endpoint", "backend", "status"]


def routed(requests: DataFrame, routes: DataFrame | None = None, backends: DataFrame | None = None, default: str = "default") -> DataFrame:
    """requests (model, ...) with backend, backend_model and route_error (null where all is well).

    routes: model, backend, backend_model (null: the model's own name), a row a model; backends: backend, those that are there.  Without routes
    every request goes to `default` with its own model.  A route to a backend that isn't there is an error of the request.
    """
    named = F.trim(F.coalesce("model", F.lit(""))) != ""
    missing = F.when(~named, "a model is required")
    if routes is None:
        return requests.withColumns({"backend": F.when(named, F.lit(default)), "backend_model": F.when(named, F.col("model")), "route_error": missing})
    own = routes.select(F.col("model").alias("_model"), F.col("backend").alias("_backend"), F.coalesce("backend_model", "model").alias("_to"))
    if backends is not None:
        own = own.join(backends.select(F.col("backend").alias("_backend"), F.lit(True).alias("_there")), "_backend", "left")
    else:
        own = own.withColumn("_there", F.lit(True))
    out = requests.join(own, named & (F.col("model") == F.col("_model")), "left")
    error = missing.when(F.col("_model").isNull(), F.concat(F.lit('unknown model "'), F.col("model"), F.lit('"'))).when(F.col("_there").isNull(), F.concat(F.lit('backend "'), F.col("_backend"), F.lit('" is unavailable')))
    fine = error.isNull()
    return out.withColumns({"backend": F.when(fine, F.col("_backend")), "backend_model": F.when(fine, F.col("_to")), "route_error": error}).drop("_model", "_backend", "_to", "_there")


def replaced(batch: DataFrame, path: str, number: int) -> None:
    """Writes a batch below path, in place of what an earlier attempt of it has written."""
    batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def split(routes_of: Callable[[DataFrame], DataFrame], requests: DataFrame, good: str, bad: str) -> DataStreamWriter:
    """A stream's writer that routes each batch once, and writes what is routed below `good` and the rest below `bad`."""

    def write(batch: DataFrame, number: int) -> None:
        out = routes_of(batch).persist()
        try:
            replaced(out.where("route_error IS NULL").drop("route_error"), good, number)
            replaced(out.where("route_error IS NOT NULL").drop("backend", "backend_model"), bad, number)
        finally:
            out.unpersist()

    return requests.writeStream.foreachBatch(write)


def counts(requests: DataFrame) -> DataFrame:
    """endpoint, backend, status, requests; a missing endpoint is `unknown`, a missing backend `server`."""
    text = lambda name, default: F.coalesce(F.nullif(F.trim(name), F.lit("")), F.lit(default)).alias(name)
    return requests.groupBy(text("endpoint", "unknown"), text("backend", "server"), "status").agg(F.count("*").alias("requests"))


def totals(counted: DataFrame) -> DataFrame:
    """One row: all requests, those unauthorised, with other client errors, and with server errors. counted: of counts(), of any number of batches."""
    n, s = F.col("requests"), F.col("status")
    some = lambda condition: F.coalesce(F.sum(F.when(condition, n)), F.lit(0)).cast("long")
    return counted.agg(F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("requests"), some(s == 401).alias("unauthorized"), some(s.between(400, 499) & (s != 401)).alias("client_errors"), some(s >= 500).alias("server_errors"))


def windows(requests: DataFrame, every: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """began, endpoint, backend, status, requests: counts by windows of ts. On a stream a window comes once, when no row of it can come any more."""
    kept = requests.withWatermark("ts", late) if requests.isStreaming else requests
    text = lambda name, default: F.coalesce(F.nullif(F.trim(name), F.lit("")), F.lit(default)).alias(name)
    out = kept.groupBy(F.window("ts", every), text("endpoint", "unknown"), text("backend", "server"), "status").agg(F.count("*").alias("requests"))
    return out.select(F.col("window.start").alias("began"), *COUNTED, "requests")


def count_into(requests: DataFrame, path: str) -> DataStreamWriter:
    """A stream's writer that adds each batch's counts to the table at path; totals() of what is there are the stream's."""
    return requests.writeStream.foreachBatch(lambda batch, number: replaced(counts(batch), path, number))


def counted(spark, path: str) -> DataFrame:
    """What count_into() has written, summed over batches."""
    rows = spark.read.schema("endpoint string, backend string, status int, requests long").parquet(f"{path}/batch=*")
    return rows.groupBy(*COUNTED).agg(F.sum("requests").alias("requests"))
