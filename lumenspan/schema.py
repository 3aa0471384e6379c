"""Tables of the engine: columns, layout, closed value sets and default settings."""

from __future__ import annotations

from pyspark.sql import types as T

#: Closed sets of the wire format.
SPAN_KINDS = ("unspecified", "internal", "server", "client", "producer", "consumer")
STATUS_CODES = ("unset", "ok", "error")
METRIC_TYPES = ("unspecified", "gauge", "sum", "histogram", "exponential_histogram", "summary")
NO_SPAN = "0" * 16
NO_TRACE = "0" * 32

_MAP = T.MapType(T.StringType(), T.StringType())


def _struct(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns])


_L, _S, _D = T.LongType(), T.StringType(), T.DoubleType()

#: Times are nanoseconds since 1970 in a long, as Spark's timestamps hold microseconds; ids are lower-case hex.
SPANS = _struct(
    ("ts_ns", _L), ("trace_id", _S), ("span_id", _S), ("parent_span_id", _S), ("service_name", _S), ("span_name", _S),
    ("span_kind", _S), ("duration_ns", _L), ("status_code", _S), ("status_message", _S), ("resource_attributes", _MAP),
    ("span_attributes", _MAP), ("sampling_weight", _D),
    ("events", T.ArrayType(_struct(("ts_ns", _L), ("name", _S), ("attributes", _MAP)))),
    ("links", T.ArrayType(_struct(("trace_id", _S), ("span_id", _S), ("attributes", _MAP)))),
)
LOGS = _struct(
    ("ts_ns", _L), ("trace_id", _S), ("span_id", _S), ("service_name", _S), ("severity_number", T.ShortType()), ("severity_text", _S),
    ("body", _S), ("template_id", _L), ("params", T.ArrayType(_S)), ("log_attributes", _MAP),
)
METRICS = _struct(("ts_ns", _L), ("service_name", _S), ("metric_name", _S), ("metric_type", _S), ("value", _D), ("labels", _MAP), ("labels_hash", _L))
TEMPLATES = _struct(("template_id", _L), ("template_text", _S), ("first_seen", _L), ("updated_at", _L))
EDGES_RAW = _struct(("ts_ns", _L), ("caller_service", _S), ("callee_service", _S), ("duration_ns", _L), ("is_error", T.IntegerType()), ("sampling_weight", _D))

TABLES = {"spans": SPANS, "logs": LOGS, "metrics": METRICS, "log_templates": TEMPLATES, "service_edges_raw": EDGES_RAW}
#: Keys that identify a row, in the order in which a table is sorted inside a day.
SORT_KEYS = {
    "spans": ("service_name", "span_name", "ts_ns", "trace_id", "span_id"),
    "logs": ("service_name", "ts_ns", "trace_id", "span_id"),
    "metrics": ("service_name", "metric_name", "labels_hash", "ts_ns"),
    "log_templates": ("template_id",),
    "service_edges_raw": ("caller_service", "callee_service", "ts_ns"),
}

#: Days that rows are kept; logs by severity in ``operators.retention``.
RETENTION_DAYS = {"spans": 30, "metrics": 7, "service_edges_raw": 3, "service_edges": 90, "metrics_rollup_1m": 90, "red_1m": 7, "red_5m": 30, "red_1h": 400}
#: Settings that users of the platform know.
DEFAULTS = {
    "query_timeout_s": 30, "max_rows_scanned": 50_000_000, "alert_interval_s": 60, "decision_wait_ms": 5_000, "decided_ttl_ms": 300_000,
    "drain_depth": 4, "drain_similarity": 0.6, "drain_children": 100, "drain_templates": 10_000, "drain_clusters_per_leaf": 200,
    "kafka_partitions": 12, "window": 32, "min_samples": 8, "trigger": 3.0, "clear": 1.5, "consecutive": 2, "cooldown_s": 600,
    "cardinality_budget": 10_000, "cardinality_buckets": 256, "tracked_keys": 10_000, "templates_limit": 200, "instances_limit": 100, "max_traces": 50_000,
}
