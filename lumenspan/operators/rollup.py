"""Mergeable rollups of spans and metrics: 1 minute, then 5 minutes and 1 hour each from the level below."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..work import floor_ns
from .weighted import bin_of, float_bin, quantiles, whole_weight

LEVELS = {"1m": 60, "5m": 300, "1h": 3600}
KEYS = ["bucket", "service_name", "operation"]
QUANTILES = {"p50_ns": 0.5, "p95_ns": 0.95, "p99_ns": 0.99}


def red_states(spans: DataFrame, level: str = "1m") -> DataFrame:
    """Partial states of rate, errors and duration: a row for each window, service, operation and duration bin."""
    w, error = F.col("sampling_weight"), (F.col("status_code") == "error").cast("int")
    keyed = spans.select(floor_ns(F.col("ts_ns"), LEVELS[level]).alias("bucket"), "service_name", F.col("span_name").alias("operation"), bin_of(F.col("duration_ns")).alias("bin"), w.alias("cw"), (w * error).alias("ew"), whole_weight(w).alias("ww"))
    return keyed.groupBy(*KEYS, "bin").agg(F.sum("cw").alias("call_weight"), F.sum("ew").alias("error_weight"), F.sum("ww").alias("w"))


def coarser(states: DataFrame, level: str) -> DataFrame:
    """States of a coarser level from those of a finer one: sums of sums."""
    keyed = states.withColumn("bucket", floor_ns(F.col("bucket"), LEVELS[level]))
    return keyed.groupBy(*KEYS, "bin").agg(F.sum("call_weight").alias("call_weight"), F.sum("error_weight").alias("error_weight"), F.sum("w").alias("w"))


def red(states: DataFrame, service: str | None = None, operation: str | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """Finished rows of any level: calls, errors, error rate, p50, p95 and p99 per window, service and operation."""
    for name, value in (("service_name", service), ("operation", operation)):
        if value is not None:
            states = states.where(F.col(name) == value)
    if start is not None:
        states = states.where(F.col("bucket") >= start)
    if end is not None:
        states = states.where(F.col("bucket") < end)
    out = quantiles(states, KEYS, QUANTILES, sums={"calls": "call_weight", "errors": "error_weight"})
    rate = F.when(F.col("calls") > 0, F.col("errors") / F.col("calls")).otherwise(0.0)
    return out.select(*KEYS, "calls", "errors", rate.alias("error_rate"), *QUANTILES)


def level_for(seconds: int) -> str:
    """The coarsest level whose windows fit whole into the asked step."""
    return max((k for k, v in LEVELS.items() if seconds % v == 0), key=LEVELS.get, default="1m")


def services(states: DataFrame, since: int) -> DataFrame:
    """Services seen since then, by name."""
    return states.where(F.col("bucket") >= since).select("service_name").distinct().orderBy("service_name")


def labels_key(labels) -> F.Column:
    """A map as text in order of its keys, the identity of a series."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


def metric_states(metrics: DataFrame, seconds: int = 60) -> DataFrame:
    """Metrics by window and series: count, sum, least, greatest, one map of labels."""
    keyed = metrics.withColumns({"bucket": floor_ns(F.col("ts_ns"), seconds), "labels_key": labels_key(F.col("labels"))})
    return keyed.groupBy("bucket", "service_name", "metric_name", "metric_type", "labels_key").agg(
        F.count("value").alias("n"), F.sum("value").alias("total"), F.min("value").alias("least"), F.max("value").alias("greatest"), F.any_value("labels").alias("labels")
    )


def metric_rollup(states: DataFrame, seconds: int) -> DataFrame:
    """Finished metric rows of a coarser window from finer states."""
    keyed = states.withColumn("bucket", floor_ns(F.col("bucket"), seconds))
    out = keyed.groupBy("bucket", "service_name", "metric_name", "metric_type", "labels_key").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("greatest").alias("greatest"))
    return out.withColumn("mean", F.col("total") / F.col("n"))


def metric_bins(metrics: DataFrame, seconds: int = 60) -> DataFrame:
    """Histogram state of metrics by window and series, next to ``metric_states``: a row for each bin of values, which merges by sums."""
    keyed = metrics.where(F.col("value").isNotNull()).select(floor_ns(F.col("ts_ns"), seconds).alias("bucket"), "service_name", "metric_name", labels_key(F.col("labels")).alias("labels_key"), float_bin(F.col("value")).alias("bin"))
    return keyed.groupBy("bucket", "service_name", "metric_name", "labels_key", "bin").agg(F.count(F.lit(1)).alias("w"))


def metric_quantiles(bins: DataFrame, seconds: int, keys: tuple[str, ...] = ("service_name", "metric_name", "labels_key")) -> DataFrame:
    """p50, p95 and p99 of a coarser window from finer histograms, by series or by what ``keys`` keeps of it."""
    return quantiles(bins.withColumn("bucket", floor_ns(F.col("bucket"), seconds)), ["bucket", *keys], {"p50": 0.5, "p95": 0.95, "p99": 0.99})
