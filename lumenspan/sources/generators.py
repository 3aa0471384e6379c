"""Deterministic synthetic traces and spans from ``spark.range``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import NO_SPAN

#: The demo's call topology, and shares of trace sizes with their least and largest span counts.
TOPOLOGY = (("gateway", "checkout"), ("checkout", "inventory"), ("checkout", "payments"))
SIZES = ((0.60, 3, 8), (0.30, 10, 30), (0.09, 40, 100), (0.01, 150, 400))
SERVICES = ("gateway", "checkout", "inventory", "payments")
OPERATIONS = ("GET /", "GET /cart", "POST /cart", "POST /pay", "GET /items", "reserve", "charge", "refund", "lookup", "render")


def _draw(seed: str, *keys: Column) -> Column:
    """A number from 0 to below 1 by hash."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(seed), *(k.cast("string") for k in keys))), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def _pick(draw: Column, values: tuple[str, ...]) -> Column:
    return F.get(F.array(*map(F.lit, values)), F.floor(draw * len(values)).cast("int"))


def traces(spark: SparkSession, n: int, start_ns: int = 1_704_067_200_000_000_000, seed: str = "traces") -> DataFrame:
    """Traces of mixed sizes; each span's parent is a random span before it."""
    t = spark.range(n).select(F.col("id").alias("t"))
    u, size, below = _draw(seed + "size", F.col("t")), None, 0.0
    for share, low, high in SIZES:
        own = (low + F.floor(_draw(seed + "n", F.col("t")) * (high - low + 1))).cast("int")
        size = F.when(u < below + share, own) if size is None else size.when(u < below + share, own)
        below += share
    s = t.withColumn("size", size.otherwise(SIZES[-1][2])).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("size") - 1)))
    ident = lambda i: F.substring(F.md5(F.concat_ws("/", F.lit(seed), F.col("t").cast("string"), i.cast("string"))), 1, 16)
    parent = F.floor(_draw(seed + "parent", F.col("t"), F.col("i")) * F.col("i")).cast("int")
    d = _draw(seed + "duration", F.col("t"), F.col("i"))
    return s.select(
        (F.lit(start_ns) + F.col("t") * 10_000_000 + F.col("i") * 100_000).alias("ts_ns"), F.md5(F.concat(F.lit(seed), F.col("t").cast("string"))).alias("trace_id"), ident(F.col("i")).alias("span_id"),
        F.when(F.col("i") == 0, NO_SPAN).otherwise(ident(parent)).alias("parent_span_id"), F.when(F.col("i") == 0, SERVICES[0]).otherwise(_pick(_draw(seed + "service", F.col("t"), F.col("i")), SERVICES)).alias("service_name"),
        _pick(_draw(seed + "operation", F.col("t"), F.col("i")), OPERATIONS).alias("span_name"), F.lit("server").alias("span_kind"), (-F.log(1 - d) * 20_000_000).cast("long").alias("duration_ns"),
        F.when(_draw(seed + "error", F.col("t"), F.col("i")) < 0.01, "error").otherwise("ok").alias("status_code"), F.lit(1.0).alias("sampling_weight"),
    )


def spans(spark: SparkSession, n: int, days: int = 7, start_ns: int = 1_704_067_200_000_000_000, seed: str = "spans") -> DataFrame:
    """Flat spans: ten services with five operations each, exponential durations of 200 ms on average, a fifth of them errors."""
    r = spark.range(n)
    a, b, c, e, t = (_draw(seed + x, F.col("id")) for x in "abcet")
    return r.select(
        (F.lit(start_ns) + (t * days * 86_400).cast("long") * 1_000_000_000).alias("ts_ns"), F.md5(F.concat(F.lit(seed), F.floor(F.col("id") / 10).cast("string"))).alias("trace_id"),
        F.substring(F.md5(F.concat(F.lit(seed + "i"), F.col("id").cast("string"))), 1, 16).alias("span_id"), F.lit(NO_SPAN).alias("parent_span_id"), F.concat(F.lit("svc-"), F.floor(a * 10).cast("string")).alias("service_name"),
        F.concat(F.lit("op-"), F.floor(b * 5).cast("string")).alias("span_name"), F.lit("server").alias("span_kind"), (-F.log(1 - c) * 200_000_000).cast("long").alias("duration_ns"),
        F.when(e < 0.2, "error").otherwise("ok").alias("status_code"), F.create_map(F.lit("http.route"), F.lit("/")).alias("span_attributes"), F.create_map(F.lit("host"), F.lit("a")).alias("resource_attributes"), F.lit(1.0).alias("sampling_weight"),
    )
