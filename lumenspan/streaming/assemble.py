"""Stateful streams: trace assembly with one decision per trace, rollups, template clustering, and sinks that can run twice."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import rollup
from ..operators.sampling import SALT, Policy
from ..schema import DEFAULTS
from ..sources.config import PolicyFile

#: What closing and deciding look at goes through state next to the whole span as JSON; ``flags`` has a character for errors and one for each attribute policy, 1 where the span meets it.
HELD = ["trace_id", "span_id", "parent_span_id", "start_ns", "end_ns", "flags", "span"]
#: A state is a bucket of traces: spans of undecided traces, and the weights of decided ones, as compressed Arrow tables.
STATE = "held binary, decided binary"
_TEXT = ("trace_id", "span_id", "parent_span_id", "flags", "span")
PENDING = pa.schema([(c, pa.large_string() if c in _TEXT else pa.int64()) for c in (*HELD, "due_ms")])
DECIDED = pa.schema([("trace_id", pa.large_string()), ("weight", pa.float64()), ("due_ms", pa.int64())])
#: Start (negative: end) of a span that has no time.
NEVER = (1 << 63) - 1
OUTPUT = "span string, sampling_weight double, late boolean"
#: Kinds of policy that look at one trace alone.
KINDS = ("errors", "slow", "attribute", "probabilistic")
JSON = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def _weights(traces: np.ndarray, start: np.ndarray, end: np.ndarray, met: np.ndarray, chain: tuple[Policy, ...], known: list[tuple[str, str]]) -> np.ndarray:
    """Weights of whole traces, 0 where one is dropped: the first policy that decides. ``met``: a row of flags for each; ``known``: the attributes that they stand for."""
    out, undecided = np.zeros(len(traces)), np.ones(len(traces), bool)
    for p in chain:
        if p.kind == "probabilistic":
            if p.rate > 0:
                out[[i for i in np.flatnonzero(undecided) if p.rate >= 1 or _share(traces[i]) < p.rate]] = 1 / p.rate
            break
        if p.kind == "slow":
            hit = (start < NEVER) & (end > -NEVER)
            hit[hit] = end[hit] - start[hit] > p.threshold_ns
        else:
            hit = met[:, 0 if p.kind == "errors" else 1 + known.index((p.key, p.value))]
        out[undecided & hit] = 1.0
        undecided &= ~hit
    return out


def _packed(frame: pd.DataFrame, schema: pa.Schema) -> bytes:
    if not len(frame):
        return b""
    with pa.BufferOutputStream() as out:
        with pa.ipc.new_stream(out, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(pa.Table.from_pandas(frame, schema, preserve_index=False))
        return out.getvalue().to_pybytes()


def _unpacked(data: bytes, schema: pa.Schema) -> pd.DataFrame:
    return (pa.ipc.open_stream(data).read_all() if data else schema.empty_table()).to_pandas()


def closed(rows: list[tuple]) -> bool:
    """Whether a root is there and all spans lie inside of it: the trace needs no more waiting."""
    roots = [r for r in rows if set(r[2]) <= {"0"}]
    if len(roots) != 1:
        return False
    a, z = roots[0][0], roots[0][0] + roots[0][5]
    ids = {r[1] for r in rows}
    return len(rows) > 1 and all(r[0] >= a and r[0] + r[5] <= z and (r[2] in ids or r is roots[0]) for r in rows)


def assemble(spans: DataFrame, chain: tuple[Policy, ...] | PolicyFile, wait_ms: int = DEFAULTS["decision_wait_ms"], keep_ms: int = DEFAULTS["decided_ttl_ms"], early: bool = True, buckets: int = 1024) -> DataFrame:
    """Whole spans of sampled traces, with all their columns, ``sampling_weight`` and ``late``, as soon as each trace is decided.

    A trace is held from its first span for ``wait_ms`` of processing time, or until its root closes it. Then the chain decides once. Spans that come
    later get the same verdict for ``keep_ms``; after that, the trace would begin anew. State is the checkpoint's, so
    a restart goes on without losing or repeating decisions.

    Traces go through Python by ``buckets`` of their ids' hashes, so that a call handles many; each trace has its own times. As the number of shuffle
    partitions, ``buckets`` stays what it was when the checkpoint began.

    Rate limits and rolling thresholds need a second state, by service; the engine allows one such operator in a stream,
    so a chain that has them is an error here. ``sampling.decide`` has them.

    With a ``PolicyFile`` traces are decided by the chain that the file holds then. Attributes are looked at when a span comes
    in, so a changed file may drop or reorder attribute policies but not bring new keys; it is then refused and the one before stays.
    """
    live = chain if isinstance(chain, PolicyFile) else None
    chain = live.current() if live else chain
    if other := [p.kind for p in chain if p.kind not in KINDS]:
        raise ValueError(f"policies that a stream can't apply: {other}")
    known = [(p.key, p.value) for p in chain if p.kind == "attribute"]

    def now() -> tuple[Policy, ...]:
        new = live.current() if live else chain
        return new if all(p.kind in KINDS and (p.kind != "attribute" or (p.key, p.value) in known) for p in new) else chain

    kinds = spans.drop("sampling_weight").schema
    has = lambda p: [F.coalesce(F.col(c)[p.key] == p.value, F.lit(False)) for c in ("span_attributes", "resource_attributes") if c in spans.columns]
    met = [F.coalesce(F.col("status_code") == "error", F.lit(False)), *(reduce(Column.__or__, has(p), F.lit(False)) for p in chain if p.kind == "attribute")]
    end = F.col("ts_ns") + F.col("duration_ns")
    keyed = spans.select(
        F.pmod(F.xxhash64("trace_id"), F.lit(buckets)).alias("bucket"), "trace_id", "span_id", (F.coalesce("parent_span_id", F.lit("")) if early else F.lit("")).alias("parent_span_id"),
        F.coalesce("ts_ns", F.lit(NEVER)).alias("start_ns"), F.coalesce(end, F.lit(-NEVER)).alias("end_ns"), F.concat(*(m.cast("int").cast("string") for m in met)).alias("flags"),
        F.to_json(F.struct(*kinds.names).cast(_as(kinds, numbered=True)), JSON).alias("span"),
    )

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now_ms, out = state.getCurrentProcessingTimeMs(), []
        rows, decided = (_unpacked(data, schema) for data, schema in zip(state.get if state.exists else (b"", b""), (PENDING, DECIDED)))
        began = len(rows)
        if not state.hasTimedOut:
            fresh = pd.concat([b[HELD] for b in batches], ignore_index=True)
            at = pd.Index(decided["trace_id"], dtype=object).get_indexer(pd.Index(fresh["trace_id"], dtype=object))
            if (late := at >= 0).any():
                weights = decided["weight"].to_numpy()[at[late]]
                out.append(pd.DataFrame({"span": fresh["span"][late].to_numpy(), "sampling_weight": weights, "late": True})[weights > 0])
                decided.loc[np.unique(at[late]), "due_ms"] = now_ms + keep_ms
                fresh = fresh[~late]
            rows = pd.concat([rows, fresh.assign(due_ms=now_ms + wait_ms)], ignore_index=True) if began else fresh.assign(due_ms=now_ms + wait_ms)
            twice = (rows.duplicated(["trace_id", "span_id"]) & rows["span_id"].notna()).to_numpy()
            rows = rows[~twice] if twice.any() else rows
        if len(rows):
            codes, traces = pd.factorize(rows["trace_id"].to_numpy(dtype=object), use_na_sentinel=False)
            order = np.argsort(codes, kind="stable")
            first = np.flatnonzero(np.diff(codes[order], prepend=-1))
            due = rows["due_ms"].to_numpy()[order][first]  # a trace's spans that were held come first
            rows = rows.assign(due_ms=due[codes])
            ready = due <= now_ms
            if early:
                _close(rows, began, codes, order, first, ready)
            if ready.any():
                go = order[ready[codes[order]]]
                first = np.flatnonzero(np.diff(codes[go], prepend=-1))
                flags = np.frombuffer("".join(rows["flags"].to_numpy()[go]).encode(), np.uint8).reshape(len(go), 1 + len(known)) == ord("1")
                weight = np.zeros(len(traces))
                weight[ready] = _weights(
                    traces[ready], np.minimum.reduceat(rows["start_ns"].to_numpy()[go], first), np.maximum.reduceat(rows["end_ns"].to_numpy()[go], first),
                    np.logical_or.reduceat(flags, first), now(), known,
                )
                go = go[weight[codes[go]] > 0]
                out.append(pd.DataFrame({"span": rows["span"].to_numpy()[go], "sampling_weight": weight[codes[go]], "late": False}))
                new = pd.DataFrame({"trace_id": traces[ready], "weight": weight[ready], "due_ms": now_ms + keep_ms})
                decided, rows = pd.concat([decided, new], ignore_index=True) if len(decided) else new, rows[~ready[codes]]
        decided = decided[decided["due_ms"] > now_ms]
        if len(rows) or len(decided):
            state.update((_packed(rows, PENDING), _packed(decided, DECIDED)))
            state.setTimeoutDuration(int(max(1, min(f["due_ms"].min() for f in (rows, decided) if len(f)) - now_ms)))
        elif state.exists:
            state.remove()
        yield from (x for x in out if len(x))

    out = keyed.groupBy("bucket").applyInPandasWithState(step, OUTPUT, STATE, "append", "ProcessingTimeTimeout")
    return out.select(F.from_json("span", _as(kinds, numbered=True), JSON).cast(_as(kinds)).alias("span"), "sampling_weight", "late").select("span.*", "sampling_weight", "late")


def _as(kind: T.DataType, numbered: bool = False) -> T.DataType:
    """The same type where all may be null; numbered: fields are called by their places, which takes less room in JSON."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(str(i) if numbered else f.name, _as(f.dataType, numbered)) for i, f in enumerate(kind)])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_as(kind.elementType, numbered))
    return T.MapType(_as(kind.keyType, numbered), _as(kind.valueType, numbered)) if isinstance(kind, T.MapType) else kind


def _close(rows: pd.DataFrame, began: int, codes: np.ndarray, order: np.ndarray, first: np.ndarray, ready: np.ndarray) -> None:
    """Mark as ready the traces that spans after the first ``began`` rows close."""
    root = ~rows["parent_span_id"].str.contains("[^0]").to_numpy(dtype=bool)
    timed = ((rows["start_ns"] < NEVER) & (rows["end_ns"] > -NEVER)).to_numpy()
    last = np.append(first[1:], len(order))
    maybe = ~ready & (np.add.reduceat(root[order].astype(int), first) == 1) & (last - first > 1) & np.logical_and.reduceat(timed[order], first) & (order[last - 1] >= began)
    start, end, ids, parents = (rows[c].to_numpy() for c in ("start_ns", "end_ns", "span_id", "parent_span_id"))
    for t in np.flatnonzero(maybe):
        ready[t] = closed([(start[i], ids[i], parents[i], None, None, end[i] - start[i]) for i in order[first[t] : last[t]]])


def _share(trace_id: str | None) -> float:
    import hashlib

    return int(hashlib.md5((SALT + (trace_id or "")).encode()).hexdigest()[:8], 16) / float(1 << 32)


def until_empty(q) -> None:
    """Wait until all input is read and each trace's decision has expired. (processAllAvailable doesn't return while timers run.)"""
    import time

    while q.isActive:
        last = q.lastProgress or {"stateOperators": [], "sources": []}
        held = [o["numRowsTotal"] for o in last["stateOperators"]]
        # a micro-batch that moved on in a source may have found no rows there, and more may follow
        if held and not any(held) and all(x["startOffset"] == x["endOffset"] for x in last["sources"]):
            return
        time.sleep(0.2)
    if q.exception():
        raise q.exception()


def write_once(spark_path: str, table: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: each micro-batch has a folder of its own, which a repeated batch overwrites."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{spark_path}/{table}/batch_id={batch_id}")

    return sink


def rollup_sink(path: str, level: str = "1m") -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink of partial rollup states; readers merge them, so a window may span batches."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        rollup.red_states(batch, level).write.mode("overwrite").parquet(f"{path}/red_{level}/batch_id={batch_id}")

    return sink


def keyed_for_stream(spans: DataFrame) -> DataFrame:
    """Key and value as a broker's topic has them; a span without a trace id is an error."""
    return spans.select(F.when(F.col("trace_id").isNull(), F.raise_error(F.lit("a span has no trace id"))).otherwise(F.col("trace_id")).alias("key"), F.to_json(F.struct(*spans.columns)).alias("value"))


def source(spark, kind: str, schema, **options) -> DataFrame:
    """A stream of records: ``kind`` is parquet, json or kafka (where its connector is installed)."""
    reader = spark.readStream.format(kind).options(**options)
    return (reader if kind == "kafka" else reader.schema(schema)).load()


def notify(sender: Callable[[dict], None]) -> Callable[[DataFrame, int], list[str]]:
    """A foreachBatch sink that hands each alert to a sender; one that fails doesn't stop the others."""
    def sink(batch: DataFrame, batch_id: int) -> list[str]:
        errors = []
        for row in batch.toLocalIterator():
            try:
                sender(row.asDict(recursive=True))
            except Exception as e:
                errors.append(str(e))
        return errors

    return sink
