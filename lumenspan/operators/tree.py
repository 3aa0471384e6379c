"""Trace trees: edges, orphans, depth, critical path, flamegraph and summaries."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import NO_SPAN
from ..work import gathered


def distinct_spans(spans: DataFrame) -> DataFrame:
    """One row for each span id of a trace: the earliest, as spans can be delivered twice."""
    w = Window.partitionBy("trace_id", "span_id").orderBy("ts_ns", "duration_ns")
    return spans.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def parent_links(spans: DataFrame) -> DataFrame:
    """Each span that has its parent in its trace, with the parent's service and operation. Spans delivered twice count once; roots and orphans are left out."""
    spans = distinct_spans(spans)
    p = spans.select("trace_id", F.col("span_id").alias("parent_span_id"), F.col("service_name").alias("caller_service"), F.col("span_name").alias("caller_operation"))
    return spans.join(p, ["trace_id", "parent_span_id"], "inner")


def service_edges(spans: DataFrame) -> DataFrame:
    """A row for each call from one service to another: parent and child of different services."""
    needed = ("ts_ns", "trace_id", "span_id", "parent_span_id", "service_name", "span_name", "duration_ns", "status_code", "sampling_weight")
    links = parent_links(spans.select(*needed)).where(F.col("caller_service") != F.col("service_name"))
    return links.select("ts_ns", "caller_service", F.col("service_name").alias("callee_service"), "duration_ns", (F.col("status_code") == "error").cast("int").alias("is_error"), "sampling_weight")


def orphans(spans: DataFrame) -> DataFrame:
    """Spans that name a parent which is not in their trace."""
    ids = spans.select("trace_id", F.col("span_id").alias("parent_span_id"))
    return spans.where(F.col("parent_span_id") != NO_SPAN).join(ids, ["trace_id", "parent_span_id"], "left_anti")


def summaries(spans: DataFrame) -> DataFrame:
    """Per trace: spans (one delivered twice counts once), start, duration from the first start to the last end, and whether any span failed."""
    end = F.col("ts_ns") + F.col("duration_ns")
    return spans.groupBy("trace_id").agg(
        F.count_distinct("span_id").alias("n_spans"), F.min("ts_ns").alias("start_ns"), (F.max(end) - F.min("ts_ns")).alias("duration_ns"), F.bool_or(F.col("status_code") == "error").alias("has_error")
    )


class Assembled:
    """A trace's tree: children by time, roots, orphans, depths, paths and the critical path."""

    def __init__(self, rows: list[tuple]):
        # (ts, span, parent, service, operation, duration); of a span delivered twice the earliest row counts
        first = {}
        for r in sorted(rows, key=lambda r: (r[0], r[1])):
            first.setdefault(r[1], r)
        self.rows = list(first.values())
        at = {r[1]: i for i, r in enumerate(self.rows)}
        self.children: list[list[int]] = [[] for _ in self.rows]
        self.roots, self.orphans = [], []
        for i, r in enumerate(self.rows):
            if r[2] == NO_SPAN:
                self.roots.append(i)
            elif r[2] in at and at[r[2]] != i:
                self.children[at[r[2]]].append(i)
            else:
                self.orphans.append(i)

    def chain(self, root: int) -> list[int]:
        """From a root always on to the child that ends last, the first of equal ones."""
        out, seen = [root], {root}
        while kids := [k for k in self.children[out[-1]] if k not in seen]:
            out.append(max(kids, key=lambda k: (self.rows[k][0] + self.rows[k][5], -k)))
            seen.add(out[-1])
        return out

    def critical(self) -> list[int]:
        """The chain of the largest total duration, the first of equal ones."""
        chains = [self.chain(r) for r in self.roots]
        return max(chains, key=lambda c: sum(self.rows[i][5] for i in c), default=[])

    def walk(self) -> Iterator[tuple[int, int, str]]:
        """(span, depth, path) in pre-order; orphans are shown as further roots, in order of time."""
        for top in sorted([*self.roots, *self.orphans]):
            stack = [(top, 0, "")]
            while stack:
                i, depth, before = stack.pop()
                path = f"{before};{self.rows[i][3]}/{self.rows[i][4]}" if before else f"{self.rows[i][3]}/{self.rows[i][4]}"
                yield i, depth, path
                stack += [(k, depth + 1, path) for k in reversed(self.children[i])]


def assembled(spans: DataFrame) -> DataFrame:
    """Spans with place (pre-order number in their trace), depth, path (service/operation from the top), orphan and critical.

    Traces meet by one shuffle on trace_id and are built one after the other, so that memory is bounded by one trace.
    Cycles of parents, which no root reaches, are left out.
    """
    names = ["trace_id", "ts_ns", "span_id", "parent_span_id", "service_name", "span_name", "duration_ns", "status_code"]

    def build(batches):
        trace, rows = None, []
        out: list[tuple] = []

        def flush():
            tree = Assembled([r[:6] for r in rows])
            state = {(r[0], r[1]): r[6] for r in rows}
            critical, orphan = set(tree.critical()), set(tree.orphans)
            for place, (i, depth, path) in enumerate(tree.walk()):
                r = tree.rows[i]
                out.append((trace, *r, state[(r[0], r[1])], place, depth, path, i in orphan, i in critical))

        def batch():
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=heads)
            out.clear()
            return made

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[0] != trace and rows:
                    flush()
                    rows = []
                    if len(out) >= 5000:
                        yield batch()
                trace = row[0]
                rows.append(row[1:])
        if rows:
            flush()
        if out:
            yield batch()

    i64, text, flag = pa.int64(), pa.string(), pa.bool_()
    types = (text, i64, text, text, text, text, i64, text, i64, i64, text, flag, flag)
    heads = [*names, "place", "depth", "path", "orphan", "critical"]
    dealt = gathered(spans.select(*names), "trace_id", "ts_ns", "span_id")
    return dealt.mapInArrow(build, "trace_id string, ts_ns long, span_id string, parent_span_id string, service_name string, span_name string, duration_ns long, status_code string, place long, depth long, path string, orphan boolean, critical boolean")


def critical_paths(spans: DataFrame) -> DataFrame:
    """Per trace: the number of spans on the critical path and their total duration."""
    return assembled(spans).where("critical").groupBy("trace_id").agg(F.count(F.lit(1)).alias("path_spans"), F.sum("duration_ns").alias("path_duration_ns"))


def flamegraph(spans: DataFrame, operation: str | None = None) -> DataFrame:
    """Frames merged over traces: total duration, spans and errors for each path. With ``operation``, only traces that have it."""
    if operation is not None:
        spans = spans.join(spans.where(F.col("span_name") == operation).select("trace_id").distinct(), "trace_id", "left_semi")
    return assembled(spans).groupBy("path").agg(F.sum("duration_ns").alias("duration_ns"), F.count(F.lit(1)).alias("n_spans"), F.sum((F.col("status_code") == "error").cast("long")).alias("n_errors"))
