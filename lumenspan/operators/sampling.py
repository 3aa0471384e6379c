"""Tail sampling: a chain of policies decides each trace once and as a whole; kept spans carry the inverse of its probability."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import share_of
from ..schema import DEFAULTS
from ..work import gathered, staged

SALT = "sampling-decision:"


@dataclass(frozen=True)
class Policy:
    """kind: errors, slow, rolling_p99, attribute, rate_limit or probabilistic, with what it needs."""

    kind: str
    threshold_ns: int = 0
    window: int = 200
    key: str = ""
    value: str = ""
    per_second: float = 0.0
    rate: float = 0.0


#: The chain that the platform ships.
SHIPPED = (Policy("errors"), Policy("slow", threshold_ns=500_000_000), Policy("attribute", key="debug.force_sample", value="true"), Policy("rate_limit", per_second=200), Policy("probabilistic", rate=0.05))


def views(spans: DataFrame, attributes: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """What policies see of a trace: start, duration, errors, the first span's service, and whether any span has each (key, value)."""
    end = F.col("ts_ns") + F.col("duration_ns")
    has = [F.bool_or(F.coalesce((F.col("span_attributes")[k] == v) | (F.col("resource_attributes")[k] == v), F.lit(False))).alias(f"has_{i}") for i, (k, v) in enumerate(attributes)]
    return spans.groupBy("trace_id").agg(
        F.min("ts_ns").alias("start_ns"), (F.max(end) - F.min("ts_ns")).alias("duration_ns"), F.bool_or(F.col("status_code") == "error").alias("has_error"),
        F.min_by("service_name", F.struct("ts_ns", "span_id")).alias("service_name"), *has,
    )


def rolling_p99(traces: DataFrame, window: int = 200, by: tuple[str, ...] = ("service_name",)) -> DataFrame:
    """``p99_ns``: the 99th percentile of up to ``window`` traces before each one of its group, null before the first."""
    w = Window.partitionBy(*by).orderBy("start_ns", "trace_id").rowsBetween(-window, -1)
    past = F.array_sort(F.collect_list("duration_ns").over(w))
    n = F.size(past)
    return traces.withColumn("p99_ns", F.when(n > 0, F.get(past, F.least(F.floor(n * 99 / 100), n - 1).cast("int"))))


def within_rate(traces: DataFrame, per_second: float) -> DataFrame:
    """``allowed``: a token bucket per service in event time, holding up to one second's tokens. One after the other within a service."""
    def run(batches):
        service, tokens, last = None, 0.0, 0
        for b in batches:
            out = []
            for s, ts in zip(b.column("service_name").to_pylist(), b.column("start_ns").to_pylist(), strict=True):
                if s != service:
                    service, tokens, last = s, per_second, ts
                tokens = min(per_second, tokens + (ts - last) / 1e9 * per_second)
                last = ts
                out.append(tokens >= 1)
                tokens -= out[-1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.bool_())], [*b.schema.names, "allowed"])

    dealt = gathered(traces, "service_name", "start_ns", "trace_id")
    return dealt.mapInArrow(run, type(traces.schema)(traces.schema.fields[:]).add("allowed", "boolean"))


def decide(spans: DataFrame, chain: tuple[Policy, ...] = SHIPPED) -> DataFrame:
    """trace_id, sampled, policy and weight: the first policy that doesn't abstain decides; if all abstain, the trace is dropped.

    A policy sees only traces about which all before it abstained, so errors use up no tokens of a rate limit and slow
    traces that are kept anyway don't move a rolling threshold. Tokens and windows go by the traces' own times.
    """
    pairs = tuple((p.key, p.value) for p in chain if p.kind == "attribute")
    keep = lambda name, weight: F.struct(F.lit(True).alias("sampled"), F.lit(name).alias("policy"), F.lit(float(weight)).alias("weight"))
    drop = lambda name: F.struct(F.lit(False).alias("sampled"), F.lit(name).alias("policy"), F.lit(0.0).alias("weight"))
    traces = views(spans, pairs).withColumn("verdict", F.lit(None).cast("struct<sampled: boolean, policy: string, weight: double>"))
    for p in chain:
        if p.kind in ("rolling_p99", "rate_limit"):
            # the state is made of undecided traces alone
            traces = staged(traces, "undecided")
            left = traces.where("verdict IS NULL")
            if p.kind == "rolling_p99":
                seen = rolling_p99(left, p.window)
                verdict = F.when((F.col("p99_ns") > 0) & (F.col("duration_ns") > F.col("p99_ns")), keep("rolling_p99", 1))
            else:
                seen, verdict = within_rate(left, p.per_second), F.when(~F.col("allowed"), drop("rate_limit"))
            traces = traces.where("verdict IS NOT NULL").unionByName(seen.withColumn("verdict", verdict).select(*traces.columns))
            continue
        if p.kind == "errors":
            verdict = F.when(F.col("has_error"), keep("errors", 1))
        elif p.kind == "slow":
            verdict = F.when(F.col("duration_ns") > p.threshold_ns, keep("slow", 1))
        elif p.kind == "attribute":
            verdict = F.when(F.col(f"has_{pairs.index((p.key, p.value))}"), keep("attribute", 1))
        else:
            verdict = F.when(chosen(F.col("trace_id"), p.rate), keep("probabilistic", 1 / p.rate if p.rate else 0)).otherwise(drop("probabilistic"))
        traces = traces.withColumn("verdict", F.coalesce("verdict", verdict))
    return traces.withColumn("verdict", F.coalesce("verdict", drop("none"))).select("trace_id", "verdict.sampled", "verdict.policy", "verdict.weight")


def span_bytes(spans: DataFrame) -> Column:
    """About how many bytes a buffered span takes: its ids (16 and twice 8), its texts, 64 for the numbers, and keys and values of its attributes."""
    out = F.lit(16 + 8 + 8 + 64).cast("long")
    for c in ("service_name", "span_name", "span_kind", "status_code", "status_message"):
        if c in spans.columns:
            out = out + F.coalesce(F.octet_length(c), F.lit(0))
    for c in ("resource_attributes", "span_attributes"):
        if c in spans.columns:
            entries = F.coalesce(F.map_entries(c), F.array().cast("array<struct<key:string,value:string>>"))
            out = out + F.aggregate(entries, F.lit(0).cast("long"), lambda a, e: a + F.octet_length(e["key"]) + F.coalesce(F.octet_length(e["value"]), F.lit(0)))
    return out


def cutoffs(spans: DataFrame, max_traces: int = DEFAULTS["max_traces"], wait_ms: int = DEFAULTS["decision_wait_ms"], replicas: int = DEFAULTS["kafka_partitions"]) -> DataFrame:
    """trace_id, start_ns, decided_ns and forced: when a buffer of at most ``max_traces`` traces in each replica decides each trace.

    A trace waits ``wait_ms`` from its first span, unless the buffer is full before: then the oldest one is decided
    with the spans that are there. The oldest goes first, so a trace is forced when the ``max_traces``-th one after it arrives
    before its time. Spans from ``decided_ns`` on are late (``late``).
    """
    replica = F.pmod(F.conv(F.substring(F.md5("trace_id"), 1, 8), 16, 10).cast("long"), F.lit(replicas))
    first = spans.groupBy("trace_id").agg(F.min("ts_ns").alias("start_ns"))
    following = F.lead("start_ns", max_traces).over(Window.partitionBy(replica).orderBy("start_ns", "trace_id"))
    due = F.col("start_ns") + wait_ms * 1_000_000
    out = first.withColumn("following", following).withColumn("forced", F.coalesce(F.col("following") < due, F.lit(False)))
    return out.select("trace_id", "start_ns", F.when(F.col("forced"), F.col("following")).otherwise(due).alias("decided_ns"), "forced")


def chosen(trace_id: Column, rate: float) -> Column:
    """Deterministic choice by trace id: all at 1 and above, none at 0 and below."""
    return F.lit(True) if rate >= 1 else F.lit(False) if rate <= 0 else share_of(trace_id, SALT) < rate


def sampled(spans: DataFrame, decisions: DataFrame) -> DataFrame:
    """Spans of kept traces with the trace's weight."""
    kept = decisions.where("sampled").select("trace_id", F.col("weight").alias("sampling_weight"))
    return spans.drop("sampling_weight").join(kept, "trace_id")


def late(spans: DataFrame, decisions: DataFrame, decided_at: str = "decided_ns", ttl_ns: int = 300_000_000_000) -> DataFrame:
    """What becomes of spans that come after their trace's decision: attached with its weight, dropped with it, or new once the decision has expired."""
    joined = spans.join(decisions, "trace_id", "left")
    known = F.col(decided_at).isNotNull() & (F.col("ts_ns") - F.col(decided_at) <= ttl_ns)
    fate = F.when(~known | F.col(decided_at).isNull(), "new").when(F.col("sampled"), "attached").otherwise("dropped")
    return joined.withColumn("fate", fate).withColumn("sampling_weight", F.when(fate == "attached", F.col("weight")).otherwise(F.col("sampling_weight")))


def upweighted(spans: DataFrame, *keys: str) -> DataFrame:
    """Estimated number of spans from the sampled ones, and how many there are."""
    return spans.groupBy(*keys).agg(F.sum("sampling_weight").alias("estimated"), F.count(F.lit(1)).alias("seen"))


