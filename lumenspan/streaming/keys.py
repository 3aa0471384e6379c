"""Keys by which records are dealt to partitions of a broker or a shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.hashing import fnv1a_of
from ..schema import NO_TRACE


def span_key(trace_id: Column) -> Column:
    """All spans of a trace go together."""
    return trace_id


def log_key(trace_id: Column, service: Column) -> Column:
    """Logs go with their trace; those without one, with their service."""
    return F.when((trace_id == NO_TRACE) | (trace_id == "") | trace_id.isNull(), service).otherwise(trace_id)


def metric_key(service: Column, metric: Column) -> Column:
    """Points of a metric of a service go together."""
    return fnv1a_of(F.concat(service, F.lit("\0"), metric))
