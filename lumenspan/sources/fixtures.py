"""Spans, traces, logs and metrics as views over the test tables, each with the same view in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import NO_SPAN
from ..work import nanos


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat spans from events: a user is a trace, an event type an operation."""
    e = _table(spark, sf_dir, "events")
    error = F.col("event_type") == "error"
    return e.select(
        nanos(e, "ts").alias("ts_ns"),
        F.md5(F.col("user_id").cast("string")).alias("trace_id"),
        F.substring(F.md5(F.concat(F.lit("s"), F.col("event_id").cast("string"))), 1, 16).alias("span_id"),
        F.lit(NO_SPAN).alias("parent_span_id"),
        F.concat(F.lit("svc-"), (F.col("user_id") % 10).cast("string")).alias("service_name"),
        F.col("event_type").alias("span_name"),
        F.lit("server").alias("span_kind"),
        F.round(F.col("value") * 1e6).cast("long").alias("duration_ns"),
        F.when(error, "error").otherwise("ok").alias("status_code"),
        F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("event.type"), F.col("event_type")).alias("span_attributes"),
        F.create_map(F.lit("deployment.environment"), F.lit("test"), F.lit("user.id"), F.col("user_id").cast("string")).alias("resource_attributes"),
        F.when(error, 1.0).otherwise(20.0).alias("sampling_weight"),
    )


SPANS_SQL = """spans AS (
  SELECT epoch_us(ts) * 1000 AS ts_ns, md5(CAST(user_id AS VARCHAR)) AS trace_id, substr(md5('s' || CAST(event_id AS VARCHAR)), 1, 16) AS span_id,
         'svc-' || CAST(user_id % 10 AS VARCHAR) AS service_name, event_type AS span_name, CAST(round(value * 1e6) AS BIGINT) AS duration_ns,
         CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status_code, json_extract_string(props, '$.k') AS k,
         CAST(user_id AS VARCHAR) AS user_id, CASE WHEN event_type = 'error' THEN CAST(1 AS DOUBLE) ELSE CAST(20 AS DOUBLE) END AS sampling_weight
  FROM events)"""


def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trace trees: an order is a root, its distinct line numbers are children of the root (odd) or of the line before (even)."""
    o = _table(spark, sf_dir, "orders")
    lines = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("supp"), F.max("l_returnflag").alias("flag"), F.max("l_quantity").alias("qty"))
    trace = F.lpad(F.lower(F.hex("key")), 32, "0")
    number = lambda c: F.lpad(c.cast("string"), 16, "0")
    orders = o.select(F.col("o_orderkey").alias("key"), nanos(o, "o_orderdate").alias("at"))
    roots = orders.select(
        F.col("at").alias("ts_ns"), trace.alias("trace_id"), F.lit("0" * 15 + "1").alias("span_id"), F.lit(NO_SPAN).alias("parent_span_id"),
        F.lit("gateway").alias("service_name"), F.lit("order").alias("span_name"), F.lit(100_000_000).cast("long").alias("duration_ns"), F.lit("ok").alias("status_code"), F.lit(1.0).alias("sampling_weight"),
    )
    n = F.col("l_linenumber")
    children = lines.join(orders, F.col("l_orderkey") == F.col("key")).select(
        (F.col("at") + n * 1_000_000).cast("long").alias("ts_ns"), trace.alias("trace_id"), number(n + 1).alias("span_id"),
        number(F.when(n % 2 == 1, 1).otherwise(n)).alias("parent_span_id"), F.concat(F.lit("svc-"), (F.col("supp") % 8).cast("string")).alias("service_name"),
        F.concat(F.lit("line-"), n.cast("string")).alias("span_name"), (F.col("qty") * 1_000_000).cast("long").alias("duration_ns"),
        F.when(F.col("flag") == "R", "error").otherwise("ok").alias("status_code"), F.lit(1.0).alias("sampling_weight"),
    )
    return roots.unionByName(children)


TREES_SQL = """lines AS (SELECT l_orderkey, l_linenumber AS n, min(l_suppkey) AS supp, max(l_returnflag) AS flag, max(l_quantity) AS qty FROM lineitem GROUP BY ALL),
tree AS (
  SELECT epoch_us(o_orderdate) * 1000 AS ts_ns, lpad(lower(to_hex(o_orderkey)), 32, '0') AS trace_id, '0000000000000001' AS span_id, '0000000000000000' AS parent_span_id,
         'gateway' AS service_name, 'order' AS span_name, CAST(100000000 AS BIGINT) AS duration_ns, 'ok' AS status_code, CAST(1 AS DOUBLE) AS sampling_weight FROM orders
  UNION ALL
  SELECT epoch_us(o_orderdate) * 1000 + n * 1000000, lpad(lower(to_hex(o_orderkey)), 32, '0'), lpad(CAST(n + 1 AS VARCHAR), 16, '0'),
         lpad(CAST(CASE WHEN n % 2 = 1 THEN 1 ELSE n END AS VARCHAR), 16, '0'), 'svc-' || CAST(supp % 8 AS VARCHAR), 'line-' || CAST(n AS VARCHAR),
         CAST(qty * 1000000 AS BIGINT), CASE WHEN flag = 'R' THEN 'error' ELSE 'ok' END, CAST(1 AS DOUBLE)
  FROM lines JOIN orders ON l_orderkey = o_orderkey)"""


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    body = F.concat(F.lit("event "), F.col("event_type"), F.lit(" by user "), F.col("user_id").cast("string"), F.lit(" value "), F.round(F.col("value") * 100).cast("long").cast("string"), F.lit(" key "), F.get_json_object("props", "$.k"))
    return e.select(
        nanos(e, "ts").alias("ts_ns"),
        F.md5(F.col("user_id").cast("string")).alias("trace_id"),
        F.substring(F.md5(F.concat(F.lit("s"), F.col("event_id").cast("string"))), 1, 16).alias("span_id"),
        F.concat(F.lit("svc-"), (F.col("user_id") % 10).cast("string")).alias("service_name"),
        F.when(F.col("event_type") == "error", 17).otherwise(9).cast("short").alias("severity_number"),
        body.alias("body"),
    )


LOGS_SQL = """logs AS (
  SELECT epoch_us(ts) * 1000 AS ts_ns, md5(CAST(user_id AS VARCHAR)) AS trace_id, substr(md5('s' || CAST(event_id AS VARCHAR)), 1, 16) AS span_id,
         'svc-' || CAST(user_id % 10 AS VARCHAR) AS service_name, CASE WHEN event_type = 'error' THEN 17 ELSE 9 END AS severity_number, event_type,
         'event ' || event_type || ' by user ' || CAST(user_id AS VARCHAR) || ' value ' || CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) || ' key ' || json_extract_string(props, '$.k') AS body
  FROM events)"""


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    return e.select(
        nanos(e, "ts").alias("ts_ns"),
        F.concat(F.lit("svc-"), (F.col("user_id") % 10).cast("string")).alias("service_name"),
        F.concat(F.lit("events."), F.col("event_type")).alias("metric_name"),
        F.lit("gauge").alias("metric_type"),
        F.col("value"),
        F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("labels"),
    )
