"""Logical plans of the query language: built from the syntax tree, tightened, lowered to DataFrames.

Catalyst pushes filters and limits down and prunes columns. What it doesn't do is done here: bounds on one field are
tightened and contradictions folded, and the day range of the partition column is derived from the time range.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.weighted import bin_of, float_bin, whole_weight
from .language import Aggregate, Comparison, Matcher, SelectQuery, TraceQuery, parse

#: Names of the language and their columns; any other name is an attribute.
FIELDS = {
    "service": "service_name", "operation": "span_name", "status": "status_code", "kind": "span_kind", "duration": "duration_ns",
    "trace_id": "trace_id", "span_id": "span_id", "parent_span_id": "parent_span_id", "sampling_weight": "sampling_weight",
}
NUMERIC = ("duration_ns", "sampling_weight")
IDS = ("trace_id", "span_id", "parent_span_id")
SCANNABLE = ("spans",)
DAY_NS = 86_400_000_000_000
QUANTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


@dataclass(frozen=True)
class Term:
    """field op value; numeric terms compare numbers, the others text."""

    name: str
    op: str
    value: str | int | float
    numeric: bool

    def __str__(self) -> str:
        return f"{self.name} {self.op} {self.value!r}"


FALSE = Term("false", "==", 0, True)


@dataclass(frozen=True)
class Plan:
    """Scan, filter, project, aggregate, sort and limit, always in this order."""

    table: str
    start: int
    end: int
    terms: tuple[Term, ...]
    aggregates: tuple[Aggregate, ...]
    by: tuple[str, ...]
    sort: tuple[tuple[str, bool], ...]
    limit: int | None
    days: tuple[date, date] | None = None
    columns: tuple[str, ...] | None = None
    pushed: bool = False

    def text(self) -> str:
        """The plan as an indented tree."""
        out = []
        if self.limit is not None:
            out.append(f"Limit {self.limit}")
        if self.sort:
            out.append("Sort " + ", ".join(f"{n} {'desc' if d else 'asc'}" for n, d in self.sort))
        if self.aggregates:
            out.append("Aggregate " + ", ".join(a.alias for a in self.aggregates) + (f" by {', '.join(self.by)}" if self.by else ""))
        where = " AND ".join(map(str, self.terms)) or "true"
        out.append("Project " + (", ".join(self.columns) if self.columns else "*"))
        scan = f"Scan {self.table} [{self.start}, {self.end})" + (f" days {self.days[0]}..{self.days[1]}" if self.days else "")
        out += [scan + f" where {where}"] if self.pushed else [f"Filter {where}", scan]
        return "\n".join("  " * i + x for i, x in enumerate(out))


def build(query: SelectQuery, table: str = "spans") -> Plan:
    if table not in SCANNABLE:
        raise ValueError(f"table {table!r} can't be queried")
    terms = [_matched(m) for m in query.matchers] + [Term(c.name, c.op, c.value, True) for c in query.comparisons]
    names = {a.alias for a in query.aggregates} | set(query.by)
    if query.aggregates:
        for n, _ in query.sort:
            if n not in names:
                raise ValueError(f"cannot sort by {n!r}: it is neither an aggregate nor a group field of this query")
    return Plan(table, query.start, query.end, tuple(terms), query.aggregates, query.by, query.sort, query.limit)


def _matched(m: Matcher) -> Term:
    value = m.value.lower() if FIELDS.get(m.name) in IDS and m.op in ("=", "!=") else m.value
    return Term(m.name, m.op, value, False)


def _allows(op: str, bound: float, x: float) -> bool:
    return {">": x > bound, ">=": x >= bound, "<": x < bound, "<=": x <= bound, "==": x == bound, "!=": x != bound}[op]


def fold(plan: Plan) -> Plan:
    """Drop repeated terms, keep the tightest bounds of a field, and replace a contradiction by a false term."""
    texts: dict[tuple[str, bool], list[Term]] = {}
    for t in dict.fromkeys(plan.terms):
        texts.setdefault((t.name, t.numeric), []).append(t)
    out: list[Term] = []
    for (_, numeric), terms in texts.items():
        kept = _tight(terms) if numeric else _consistent(terms)
        if kept is None:
            return replace(plan, terms=(FALSE,))
        out += kept
    return replace(plan, terms=tuple(sorted(out, key=str)))


def _consistent(terms: list[Term]) -> list[Term] | None:
    equal = {t.value for t in terms if t.op == "="}
    other = {t.value for t in terms if t.op == "!="}
    if len(equal) > 1 or equal & other:
        return None
    return [t for t in terms if not (equal and t.op == "!=")]


def _tight(terms: list[Term]) -> list[Term] | None:
    equal = {t.value for t in terms if t.op == "=="}
    if len(equal) > 1:
        return None
    if equal:
        (x,) = equal
        ok = all(_allows(t.op, t.value, x) for t in terms)
        return [t for t in terms if t.op == "=="][:1] if ok else None
    low = max((t for t in terms if t.op in (">", ">=")), key=lambda t: (t.value, t.op == ">"), default=None)
    high = min((t for t in terms if t.op in ("<", "<=")), key=lambda t: (t.value, t.op == "<="), default=None)
    if low and high and (low.value > high.value or low.value == high.value and (low.op == ">" or high.op == "<")):
        return None
    inside = [t for t in terms if t.op == "!=" and (not low or _allows(low.op, low.value, t.value)) and (not high or _allows(high.op, high.value, t.value))]
    # attributes that are no numbers fail any bound, so a dropped != changes nothing only beside a bound
    return [t for t in (low, high) if t] + (inside if low or high else [t for t in terms if t.op == "!="])


def push_predicates(plan: Plan) -> Plan:
    """Filters are part of the scan; an aggregate, sort or limit stands above them in any plan."""
    return replace(plan, pushed=True)


def prune_days(plan: Plan) -> Plan:
    """Derive the days that the half-open time range touches."""
    first, last = (date(1970, 1, 1) + timedelta(days=x // DAY_NS) for x in (plan.start, plan.end - 1))
    return replace(plan, days=(first, last))


def prune_columns(plan: Plan) -> Plan:
    """An aggregate needs only the columns it names, the time and the weight."""
    if not plan.aggregates:
        return plan
    names = [t.name for t in plan.terms if t is not FALSE] + [a.name for a in plan.aggregates if a.name] + list(plan.by)
    columns = {"ts_ns", "sampling_weight"}
    for n in names:
        columns |= {FIELDS[n]} if n in FIELDS else {"span_attributes", "resource_attributes"}
    return replace(plan, columns=tuple(sorted(columns)))


PASSES: dict[str, Callable[[Plan], Plan]] = {"fold": fold, "push_predicates": push_predicates, "prune_days": prune_days, "prune_columns": prune_columns}


def optimized(plan: Plan, without: tuple[str, ...] = ()) -> Plan:
    return reduce(lambda p, f: f[1](p) if f[0] not in without else p, PASSES.items(), plan)


def operand(name: str) -> Column:
    """A field as a column: known names, else the span's attribute, else the resource's."""
    if name in FIELDS:
        return F.col(FIELDS[name])
    return F.coalesce(F.col("span_attributes")[name], F.col("resource_attributes")[name])


def number(name: str) -> Column:
    """A field as a number; an attribute that is none is null."""
    return F.col(FIELDS[name]) if FIELDS.get(name) in NUMERIC else operand(name).try_cast("double")


def condition(t: Term) -> Column:
    if t is FALSE:
        return F.lit(False)
    if t.numeric:
        x, v = number(t.name), F.lit(t.value)
        return {">": x > v, ">=": x >= v, "<": x < v, "<=": x <= v, "==": x == v, "!=": x != v}[t.op]
    x = operand(t.name)
    # a missing attribute counts as empty text where a difference is asked for
    there = x if t.name in FIELDS else F.coalesce(x, F.lit(""))
    return {"=": lambda: x == t.value, "!=": lambda: there != t.value, "=~": lambda: there.rlike(t.value), "!~": lambda: ~there.rlike(t.value)}[t.op]()


def weight_of(value: Column | None = None) -> Column:
    w = F.col("sampling_weight")
    return w if value is None else F.when(value.isNotNull(), w)


def aggregated(a: Aggregate) -> Column:
    """Weighted aggregates: each sampled span stands for 1/p spans; minimum and maximum are what was seen. Quantiles here are exact, and keep every distinct value of a group."""
    if a.function == "count":
        return F.sum("sampling_weight").alias(a.alias)
    x = number(a.name)
    if a.function == "sum":
        out = F.sum(x * weight_of())
    elif a.function == "avg":
        out = F.sum(x * weight_of()) / F.sum(weight_of(x))
    elif a.function in ("min", "max"):
        out = F.min(x) if a.function == "min" else F.max(x)
    else:
        out = F.percentile(x, F.lit(QUANTILES[a.function]), F.greatest(F.bround(weight_of()).cast("long"), F.lit(0)))
    return out.alias(a.alias)


def _binned(df: DataFrame, keys: list[str], field: str, aggregates: list[Aggregate], others: list[Aggregate]) -> DataFrame:
    """Quantiles of a field, and other aggregates in the same pass: partial results by group and histogram bin, then a running sum of weights over the bins.

    A quantile is the lower edge of the first bin that reaches its share of all weights, off by less than 1 in 512.
    """
    x = number(field)
    bin_ = bin_of(x) if FIELDS.get(field) == "duration_ns" else float_bin(x.cast("double"))
    # for each aggregate its partial columns and how they are merged
    parts: dict[str, Column] = {}
    merges: list[Column] = []
    for a in others:
        v, p = number(a.name) if a.name else None, a.alias
        if a.function == "count":
            parts[p], out = F.sum("sampling_weight"), F.sum(f"`{p}`")
        elif a.function == "sum":
            parts[p], out = F.sum(v * weight_of()), F.sum(f"`{p}`")
        elif a.function == "avg":
            parts[p], parts[f"{p} weight"] = F.sum(v * weight_of()), F.sum(weight_of(v))
            out = F.sum(f"`{p}`") / F.sum(f"`{p} weight`")
        else:
            f = F.min if a.function == "min" else F.max
            parts[p], out = f(v), f(f"`{p}`")
        merges.append(out.alias(p))
    weight = F.when(x.isNotNull(), F.greatest(whole_weight(F.col("sampling_weight")), F.lit(0)))
    bins = df.withColumns({"a bin": bin_, "a weight": weight}).groupBy(*keys, "a bin").agg(F.sum("a weight").alias("a weight"), *(c.alias(n) for n, c in parts.items()))
    group = Window.partitionBy(*keys)
    bins = bins.withColumns({"all of it": F.sum("a weight").over(group), "up to it": F.sum("a weight").over(group.orderBy("a bin").rowsBetween(Window.unboundedPreceding, 0))})
    found = [F.min(F.when((F.col("up to it") >= QUANTILES[a.function] * F.col("all of it")) & (F.col("a weight") > 0), F.col("a bin"))).cast("double").alias(a.alias) for a in aggregates]
    return bins.groupBy(*keys).agg(*merges, *found)


def grouped(df: DataFrame, plan: Plan, exact: bool) -> DataFrame:
    """The aggregates of a plan by group. Quantiles come from mergeable histograms, one for each field, unless ``exact``."""
    quantiles: dict[str, list[Aggregate]] = {}
    for a in plan.aggregates:
        if a.function in QUANTILES:
            quantiles.setdefault(a.name, []).append(a)
    keys = list(plan.by)
    if exact or not quantiles:
        return df.groupBy(*(operand(n).alias(n) for n in keys)).agg(*map(aggregated, plan.aggregates))
    # names of the language that are columns, too, must not be taken for these
    named = [f"by {i}" for i in range(len(keys))]
    df = df.withColumns({k: operand(n) for k, n in zip(named, keys, strict=True)}) if keys else df
    others, out = [a for a in plan.aggregates if a.function not in QUANTILES], None
    for field, own in quantiles.items():
        one = _binned(df, named, field, list(dict.fromkeys(own)), list(dict.fromkeys(others)) if out is None else [])
        if out is None:
            out = one
            continue
        right = one.select(*(F.col(k).alias(f"same {k}") for k in named), *(f"`{a.alias}`" for a in dict.fromkeys(own)))
        same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"same {k}")) for k in named), F.lit(True))
        out = out.join(right, same) if named else out.crossJoin(right)  # without groups, both have one row
    return out.select(*(F.col(k).alias(n) for k, n in zip(named, keys, strict=True)), *(F.col(f"`{a.alias}`") for a in plan.aggregates))


def lowered(plan: Plan, spans: DataFrame, exact: bool = False) -> DataFrame:
    """The DataFrame of a plan over a table of spans; ``dt``, if the table has it, is its day partition."""
    df = spans
    if plan.days and "dt" in df.columns:
        df = df.where(F.col("dt").between(F.lit(plan.days[0]), F.lit(plan.days[1])))
    df = df.where((F.col("ts_ns") >= plan.start) & (F.col("ts_ns") < plan.end))
    if plan.terms:
        df = df.where(reduce(lambda a, b: a & b, map(condition, plan.terms)))
    if plan.columns:
        df = df.select(*plan.columns)
    if plan.aggregates:
        df = grouped(df, plan, exact)
    if plan.sort:
        key = (lambda n: F.col(f"`{n}`")) if plan.aggregates else operand
        df = df.orderBy(*(key(n).desc_nulls_last() if down else key(n).asc_nulls_last() for n, down in plan.sort))
    return df if plan.limit is None else df.limit(plan.limit)


def run(text: str, spans: DataFrame, now=None, without: tuple[str, ...] = (), exact: bool = False) -> DataFrame:
    """The result of a query text over a table of spans. ``exact`` asks for quantiles of the values themselves instead of mergeable histograms."""
    query = parse(text, now)
    if isinstance(query, TraceQuery):
        return trace(spans, query.trace_id)
    return lowered(optimized(build(query), without), spans, exact)


def trace(spans: DataFrame, trace_id: str) -> DataFrame:
    """All spans of a trace in order of time, whenever they were."""
    return spans.where(F.col("trace_id") == trace_id.lower()).orderBy("ts_ns", "span_id")


def explained(text: str, spans: DataFrame, now=None) -> dict[str, str]:
    """The query's plans before and after each pass that changed it, and what Catalyst makes of it."""
    query = parse(text, now)
    if isinstance(query, TraceQuery):
        raise ValueError("a trace lookup has no plan to explain")
    plan = build(query)
    best = optimized(plan)
    catalyst = lowered(best, spans)._jdf.queryExecution().toString()
    return {"query": text, "logical": plan.text(), "optimized": best.text(), "catalyst": catalyst}


__all__ = ["Comparison", "Plan", "Term", "build", "explained", "fold", "lowered", "optimized", "run", "trace"]
