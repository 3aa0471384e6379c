"""Service graphs: weighted edges, traffic share, cycles and cut vertices."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .weighted import bin_of, quantiles, whole_weight
from ..work import floor_ns

LEVELS = {"p50_ns": 0.5, "p95_ns": 0.95, "p99_ns": 0.99}


def edge_states(edges: DataFrame, seconds: int = 60) -> DataFrame:
    """Mergeable rollup of raw edges: a row for each window, edge and duration bin."""
    w = F.col("sampling_weight")
    keyed = edges.withColumns({"bucket": floor_ns(F.col("ts_ns"), seconds), "bin": bin_of(F.col("duration_ns"))})
    return keyed.groupBy("bucket", "caller_service", "callee_service", "bin").agg(F.sum(w).alias("call_weight"), F.sum(w * F.col("is_error")).alias("error_weight"), F.sum(whole_weight(w)).alias("w"))


def graph(states: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Edges of a time window from rollup states: calls, error rate and latency quantiles."""
    if start is not None:
        states = states.where(F.col("bucket") >= start)
    if end is not None:
        states = states.where(F.col("bucket") < end)
    keys = ["caller_service", "callee_service"]
    out = quantiles(states, keys, LEVELS, sums={"calls": "call_weight", "errors": "error_weight"})
    return out.select(*keys, "calls", F.when(F.col("calls") > 0, F.col("errors") / F.col("calls")).otherwise(0.0).alias("error_rate"), *LEVELS)


def criticality(edges: DataFrame) -> DataFrame:
    """Share of all calls that each service gets; services that are never called have 0."""
    calls = edges.groupBy(F.col("callee_service").alias("service")).agg(F.sum("calls").alias("calls"))
    nodes = edges.select(F.col("caller_service").alias("service")).union(edges.select("callee_service")).distinct()
    share = F.coalesce("calls", F.lit(0.0))
    total = F.sum(share).over(Window.partitionBy())
    return nodes.join(calls, "service", "left").select("service", share.alias("inbound_calls"), F.when(total > 0, share / total).otherwise(0.0).alias("criticality"))


def existing_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are both among ``nodes`` (service)."""
    for end in ("caller_service", "callee_service"):
        edges = edges.join(nodes.select(F.col("service").alias(end)), end, "left_semi")
    return edges


def _small(edges: DataFrame, run: Callable[[list[tuple[str, str]]], list[tuple]], schema: str) -> DataFrame:
    """Run a walk over the distinct edges in one task: there are at most services squared of them, whatever the traffic."""
    types = {"string": pa.string(), "long": pa.int64()}
    fields = [f.split() for f in schema.split(", ")]

    def all_rows(batches):
        pairs = [p for b in batches for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        rows = run(sorted(pairs))
        columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
        yield pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])

    return edges.select("caller_service", "callee_service").distinct().coalesce(1).mapInArrow(all_rows, schema)


def walk_cycles(pairs: list[tuple[str, str]]) -> list[list[str]]:
    """Cycles that a depth-first walk in order of names closes: at least one in each cyclic structure, not all there are."""
    after: dict[str, list[str]] = {}
    for a, b in pairs:
        after.setdefault(a, []).append(b)
    done: set[str] = set()
    found = []
    for top in sorted({x for p in pairs for x in p}):
        if top in done:
            continue
        path, place = [top], {top: 0}
        stack = [iter(sorted(after.get(top, ())))]
        while stack:
            n = next(stack[-1], None)
            if n is None:
                stack.pop()
                done.add(path[-1])
                del place[path.pop()]
            elif n in place:
                found.append(path[place[n] :] + [n])
            elif n not in done:
                place[n] = len(path)
                path.append(n)
                stack.append(iter(sorted(after.get(n, ()))))
    return found


def cyclic_services(pairs: list[tuple[str, str]]) -> set[str]:
    """Services that can reach themselves."""
    after: dict[str, set[str]] = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    out = set()
    for top in after:
        seen, todo = set(), list(after[top])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += after.get(x, ())
        if top in seen:
            out.add(top)
    return out


def walk_cuts(pairs: list[tuple[str, str]]) -> set[str]:
    """Services without which the graph, seen undirected, falls apart."""
    beside: dict[str, set[str]] = {}
    for a, b in pairs:
        if a != b:
            beside.setdefault(a, set()).add(b)
            beside.setdefault(b, set()).add(a)
    order: dict[str, int] = {}
    low: dict[str, int] = {}
    cuts = set()
    for top in sorted(beside):
        if top in order:
            continue
        order[top] = low[top] = len(order)
        kids = 0
        stack = [(top, None, iter(sorted(beside[top])))]
        while stack:
            x, above, rest = stack[-1]
            n = next(rest, None)
            if n is None:
                stack.pop()
                if above is not None:
                    low[above] = min(low[above], low[x])
                    if above != top and low[x] >= order[above]:
                        cuts.add(above)
            elif n not in order:
                order[n] = low[n] = len(order)
                kids += x == top
                stack.append((n, x, iter(sorted(beside[n]))))
            elif n != above:
                low[x] = min(low[x], order[n])
        if kids > 1:
            cuts.add(top)
    return cuts


def cycles(edges: DataFrame) -> DataFrame:
    return _small(edges, lambda p: [(i, k, s) for i, c in enumerate(walk_cycles(p)) for k, s in enumerate(c)], "cycle long, position long, service string")


def services_on_cycles(edges: DataFrame) -> DataFrame:
    return _small(edges, lambda p: [(s,) for s in sorted(cyclic_services(p))], "service string")


def cut_vertices(edges: DataFrame) -> DataFrame:
    return _small(edges, lambda p: [(s,) for s in sorted(walk_cuts(p))], "service string")
