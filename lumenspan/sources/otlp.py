"""Telemetry exports in their JSON form, a request per row, flattened to spans, logs and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import series_hash
from ..schema import METRIC_TYPES, NO_SPAN, SPAN_KINDS, STATUS_CODES

_PLAIN = "stringValue string, boolValue boolean, intValue string, doubleValue double, bytesValue string"


def _fields(text: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (x.split(" ") for x in text.split(", ")))


_P = _fields(_PLAIN)
_VALUE = f"struct<{_P}, arrayValue: struct<values: array<struct<{_P}>>>, kvlistValue: struct<values: array<struct<key: string, value: struct<{_P}>>>>>"
_ATTRIBUTES = f"array<struct<key: string, value: {_VALUE}>>"
_RESOURCE = f"struct<attributes: {_ATTRIBUTES}>"
_SPAN = (
    "struct<traceId: string, spanId: string, parentSpanId: string, name: string, kind: int, startTimeUnixNano: string, endTimeUnixNano: string, "
    f"attributes: {_ATTRIBUTES}, status: struct<code: int, message: string>, events: array<struct<timeUnixNano: string, name: string, attributes: {_ATTRIBUTES}>>, "
    f"links: array<struct<traceId: string, spanId: string, attributes: {_ATTRIBUTES}>>>"
)
TRACES = f"resourceSpans array<struct<resource: {_RESOURCE}, scopeSpans: array<struct<spans: array<{_SPAN}>>>>>"
_LOG = f"struct<timeUnixNano: string, observedTimeUnixNano: string, traceId: string, spanId: string, severityNumber: int, severityText: string, body: {_VALUE}, attributes: {_ATTRIBUTES}>"
LOGS = f"resourceLogs array<struct<resource: {_RESOURCE}, scopeLogs: array<struct<logRecords: array<{_LOG}>>>>>"
_POINT = f"struct<timeUnixNano: string, asDouble: double, asInt: string, count: string, sum: double, attributes: {_ATTRIBUTES}>"
_METRIC = "struct<name: string, " + ", ".join(f"{n}: struct<dataPoints: array<{_POINT}>>" for n in ("gauge", "sum", "histogram", "exponentialHistogram", "summary")) + ">"
METRICS = f"resourceMetrics array<struct<resource: {_RESOURCE}, scopeMetrics: array<struct<metrics: array<{_METRIC}>>>>>"


def _plain(v: Column) -> Column:
    bytes_ = F.lower(F.hex(F.unbase64(v["bytesValue"])))
    return F.coalesce(v["stringValue"], v["boolValue"].cast("string"), v["intValue"], v["doubleValue"].cast("string"), bytes_, F.lit(""))


def value_text(v: Column) -> Column:
    """Any value as text: lists as [a,b], maps as {k=v,...}, bytes in hex."""
    items = F.concat(F.lit("["), F.array_join(F.transform(v["arrayValue"]["values"], _plain), ","), F.lit("]"))
    pairs = F.concat(F.lit("{"), F.array_join(F.transform(v["kvlistValue"]["values"], lambda e: F.concat(e["key"], F.lit("="), _plain(e["value"]))), ","), F.lit("}"))
    return F.when(v["arrayValue"].isNotNull(), items).when(v["kvlistValue"].isNotNull(), pairs).otherwise(_plain(v))


def attributes(a: Column) -> Column:
    """Attributes as a map; the last of equal keys stays, and none give an empty map."""
    entries = F.transform(F.coalesce(a, F.array().cast(_ATTRIBUTES)), lambda e: F.named_struct(F.lit("key"), e["key"], F.lit("value"), value_text(e["value"])))
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    last = F.transform(keys, lambda k: F.named_struct(F.lit("key"), k, F.lit("value"), F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]))
    return F.map_from_entries(last)


def _named(code: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, names)), F.coalesce(code, F.lit(0))), F.lit(names[0]))


def _id(text: Column, digits: int) -> Column:
    """Lower-case hex, cut or filled with zeros to its length."""
    return F.substring(F.rpad(F.lower(F.coalesce(text, F.lit(""))), digits, "0"), 1, digits)


def _service(resource: Column) -> Column:
    return F.coalesce(resource["service.name"], F.lit(""))


def spans(requests: DataFrame, column: str = "value") -> DataFrame:
    """Spans of trace exports; text that can't be parsed gives no rows."""
    r = requests.select(F.explode(F.from_json(column, TRACES)["resourceSpans"]).alias("r")).select(attributes(F.col("r.resource.attributes")).alias("ra"), F.explode("r.scopeSpans").alias("s"))
    r = r.select("ra", F.explode("s.spans").alias("x"))
    start, end = F.col("x.startTimeUnixNano").cast("long"), F.col("x.endTimeUnixNano").cast("long")
    return r.select(
        F.coalesce(start, F.lit(0)).alias("ts_ns"), _id(F.col("x.traceId"), 32).alias("trace_id"), _id(F.col("x.spanId"), 16).alias("span_id"),
        F.when(F.length(F.coalesce("x.parentSpanId", F.lit(""))) > 0, _id(F.col("x.parentSpanId"), 16)).otherwise(NO_SPAN).alias("parent_span_id"),
        _service(F.col("ra")).alias("service_name"), F.coalesce("x.name", F.lit("")).alias("span_name"), _named(F.col("x.kind"), SPAN_KINDS).alias("span_kind"),
        F.greatest(F.coalesce(end - start, F.lit(0)), F.lit(0)).alias("duration_ns"), _named(F.col("x.status.code"), STATUS_CODES).alias("status_code"),
        F.coalesce("x.status.message", F.lit("")).alias("status_message"), F.col("ra").alias("resource_attributes"), attributes(F.col("x.attributes")).alias("span_attributes"),
        F.lit(1.0).alias("sampling_weight"),
        F.transform("x.events", lambda e: F.named_struct(F.lit("ts_ns"), e["timeUnixNano"].cast("long"), F.lit("name"), e["name"], F.lit("attributes"), attributes(e["attributes"]))).alias("events"),
        F.transform("x.links", lambda e: F.named_struct(F.lit("trace_id"), _id(e["traceId"], 32), F.lit("span_id"), _id(e["spanId"], 16), F.lit("attributes"), attributes(e["attributes"]))).alias("links"),
    )


def logs(requests: DataFrame, column: str = "value") -> DataFrame:
    """Log records; a missing time is the time of observation."""
    r = requests.select(F.explode(F.from_json(column, LOGS)["resourceLogs"]).alias("r")).select(attributes(F.col("r.resource.attributes")).alias("ra"), F.explode("r.scopeLogs").alias("s"))
    r = r.select("ra", F.explode("s.logRecords").alias("x"))
    own, seen = F.col("x.timeUnixNano").cast("long"), F.col("x.observedTimeUnixNano").cast("long")
    return r.select(
        F.coalesce(F.when(own != 0, own), seen, F.lit(0)).alias("ts_ns"), _id(F.col("x.traceId"), 32).alias("trace_id"), _id(F.col("x.spanId"), 16).alias("span_id"),
        _service(F.col("ra")).alias("service_name"), F.coalesce("x.severityNumber", F.lit(0)).cast("short").alias("severity_number"), F.coalesce("x.severityText", F.lit("")).alias("severity_text"),
        value_text(F.col("x.body")).alias("body"), attributes(F.col("x.attributes")).alias("log_attributes"),
    )


def metrics(requests: DataFrame, column: str = "value") -> DataFrame:
    """Metric points; histograms and summaries give a ``_count`` and a ``_sum`` row each, without their buckets."""
    r = requests.select(F.explode(F.from_json(column, METRICS)["resourceMetrics"]).alias("r")).select(attributes(F.col("r.resource.attributes")).alias("ra"), F.explode("r.scopeMetrics").alias("s"))
    r = r.select("ra", F.explode("s.metrics").alias("m"))
    kinds = dict(zip(("gauge", "sum", "histogram", "exponentialHistogram", "summary"), METRIC_TYPES[1:], strict=True))

    def tagged(kind: str, column: str) -> Column:
        points = F.coalesce(F.col(f"m.{column}.dataPoints"), F.array().cast(f"array<{_POINT}>"))
        return F.transform(points, lambda p: F.named_struct(F.lit("t"), F.lit(kind), F.lit("p"), p))

    points = [tagged(t, k) for k, t in kinds.items()]
    r = r.select("ra", "m.name", F.explode(F.concat(*points)).alias("x")).select("ra", "name", "x.t", "x.p")
    number = F.coalesce(F.col("p.asDouble"), F.col("p.asInt").cast("double"), F.lit(0.0))
    pair = F.array(F.struct(F.concat("name", F.lit("_count")).alias("n"), F.coalesce(F.col("p.count").cast("double"), F.lit(0.0)).alias("v")), F.struct(F.concat("name", F.lit("_sum")).alias("n"), F.coalesce(F.col("p.sum"), F.lit(0.0)).alias("v")))
    one = F.array(F.struct(F.col("name").alias("n"), number.alias("v")))
    r = r.withColumn("row", F.explode(F.when(F.col("t").isin("gauge", "sum"), one).otherwise(pair)))
    out = r.select(F.coalesce(F.col("p.timeUnixNano").cast("long"), F.lit(0)).alias("ts_ns"), _service(F.col("ra")).alias("service_name"), F.col("row.n").alias("metric_name"), F.col("t").alias("metric_type"), F.col("row.v").alias("value"), attributes(F.col("p.attributes")).alias("labels"))
    return out.withColumn("labels_hash", series_hash(F.col("service_name"), F.col("metric_name"), F.col("labels")))
