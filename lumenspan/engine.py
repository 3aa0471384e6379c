"""The platform's calls over tables in a folder: queries, traces, services, templates and health."""

from __future__ import annotations

import threading
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import graph, logs, rollup, storage, tree
from .plans import language, logical
from .schema import DEFAULTS, TABLES
from .work import staged


class TooManyRows(RuntimeError):
    """A query would scan more rows than allowed."""


class Engine:
    """Tables are folders ``<root>/<table>`` with a folder per day; ``tables`` overrides any of them by a DataFrame."""

    def __init__(self, spark: SparkSession, root: str | None = None, tables: dict[str, DataFrame] | None = None, now: datetime | None = None, max_rows: int = DEFAULTS["max_rows_scanned"]):
        self.spark, self.root, self.tables, self.max_rows = spark, root, tables or {}, max_rows
        self._now = now

    @property
    def now(self) -> datetime:
        return self._now or datetime.now(timezone.utc)

    def _since(self, text: str) -> int:
        ns = language.duration_ns(text)
        if ns is None:
            raise ValueError(f"invalid duration {text!r}")
        return language._ns(self.now) - ns

    def table(self, name: str) -> DataFrame:
        if name in self.tables:
            return self.tables[name]
        if name not in TABLES:
            raise ValueError(f"unknown table {name!r}")
        return storage.read(self.spark, f"{self.root}/{name}", name)

    def query(self, text: str, timeout_s: float | None = None) -> DataFrame:
        """The result of a query. The row guard reads footers of the days in range only; it doesn't stop a query when it can't tell."""
        parsed = language.parse(text, self.now)
        if isinstance(parsed, language.TraceQuery):
            return self.trace(parsed.trace_id)
        rows = self.estimated_rows(parsed)
        if rows is not None and rows > self.max_rows:
            raise TooManyRows(f"the query would read about {rows} rows, more than {self.max_rows}")
        out = logical.lowered(logical.optimized(logical.build(parsed)), self.table("spans"))
        return self._within(out, timeout_s) if timeout_s else out

    def _within(self, df: DataFrame, seconds: float) -> DataFrame:
        """Run now and give up after so many seconds."""
        sc, group = self.spark.sparkContext, f"query-{id(df)}"
        sc.setJobGroup(group, "query with a time limit", interruptOnCancel=True)
        timer = threading.Timer(seconds, sc.cancelJobGroup, [group])
        timer.start()
        try:
            return staged(df, "result")
        finally:
            timer.cancel()
            sc.setLocalProperty("spark.jobGroup.id", None)

    def estimated_rows(self, parsed: language.SelectQuery) -> int | None:
        """Rows in the days of a query by the footers of these days' files; None where the table isn't a folder."""
        if "spans" in self.tables or self.root is None:
            return None
        first, last = logical.prune_days(logical.build(parsed)).days
        days = [f"{self.root}/spans/dt={d}" for d in self._days("spans") if str(first) <= d <= str(last)]
        return storage.estimated_rows(self.spark, days) if days else 0

    def _days(self, table: str) -> list[str]:
        """Days of which a table has a folder."""
        if not self._there(table):
            return []
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        names = [f.getPath().getName() for f in at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)]
        return sorted(n[3:] for n in names if n.startswith("dt="))

    #: Stored rollups and the level that each is made from.
    ROLLUPS = {"red_1m": "spans", "red_5m": "red_1m", "red_1h": "red_5m", "service_edges": "spans"}

    def roll_up(self, *days: str) -> None:
        """Make the stored rollups of these days (all that spans have, if none are given) anew, each from the level below; the readers use them from then on."""
        for name, below in self.ROLLUPS.items():
            rows = storage.read(self.spark, f"{self.root}/spans", "spans") if below == "spans" else self.spark.read.parquet(f"{self.root}/{below}")
            rows = rows.where(F.col("dt").isin(list(days))) if days else rows
            if name == "service_edges":
                made = graph.edge_states(tree.service_edges(rows))
            else:
                made = rollup.red_states(storage.distinct_rows(rows, "spans")) if below == "spans" else rollup.coarser(rows, name[4:])
            made = storage.with_day(made.withColumn("ts_ns", F.col("bucket"))).drop("ts_ns")
            made.repartition("dt").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt").parquet(f"{self.root}/{name}")

    def _rollup(self, name: str, since: int | None) -> DataFrame | None:
        """A stored rollup from a time on, with only the days that it needs."""
        if name in self.tables:
            return self.tables[name]
        if self.root is None or not self._there(name):
            return None
        rows = self.spark.read.parquet(f"{self.root}/{name}")
        return rows if since is None else rows.where(F.col("dt") >= F.lit(str(logical.date(1970, 1, 1) + timedelta(days=since // logical.DAY_NS))))

    def explain(self, text: str) -> dict[str, str]:
        return logical.explained(text, self.table("spans"), self.now)

    def trace(self, trace_id: str) -> DataFrame:
        return logical.trace(self.table("spans"), trace_id)

    def trace_tree(self, trace_id: str) -> DataFrame:
        return tree.assembled(self.trace(trace_id)).orderBy("place")

    def trace_logs(self, trace_id: str) -> DataFrame:
        return logs.of_trace(self.table("logs"), trace_id)

    def red_states(self, level: str = "1m", since: int | None = None) -> DataFrame:
        if level not in rollup.LEVELS:
            raise ValueError(f"unknown level {level!r}")
        stored = self._rollup(f"red_{level}", since)
        return stored if stored is not None else rollup.red_states(storage.distinct_rows(self.table("spans"), "spans"), level)

    def red(self, level: str = "1m", service: str | None = None, operation: str | None = None, since: str = "1h") -> DataFrame:
        return rollup.red(self.red_states(level, self._since(since)), service, operation, self._since(since)).orderBy("bucket")

    def services(self) -> DataFrame:
        since = language._ns(self.now - timedelta(days=30))
        return rollup.services(self.red_states("1h", since), since)

    def service_graph(self, window: str = "1h") -> dict[str, DataFrame]:
        """Edges, nodes, cycles and cut vertices of a window: from the stored rollup of edges by the minute, else from the spans."""
        since = self._since(window)
        states = self._rollup("service_edges", since)
        if states is None:
            states = graph.edge_states(tree.service_edges(self.table("spans").where(F.col("ts_ns") >= since)))
        else:
            states = states.where(F.col("bucket") >= since)
        made = graph.graph(states)
        return {"edges": made, "nodes": graph.criticality(made), "cycles": graph.cycles(made), "cut_vertices": graph.cut_vertices(made)}

    def parsed_logs(self) -> DataFrame:
        """Logs with their templates: as they are stored, else found now, once for all that is asked of the result."""
        rows = self.table("logs")
        return rows if "template_text" in rows.columns else staged(logs.with_templates(rows), "parsed")

    def log_templates(self, since: str = "1h", limit: int = 0) -> DataFrame:
        parsed = self.parsed_logs()
        return logs.template_counts(parsed, logs.dictionary(parsed), self._since(since), language._ns(self.now), limit)

    def log_instances(self, template_id: int, since: str = "24h", limit: int = 0) -> DataFrame:
        return logs.instances(self.parsed_logs(), template_id, self._since(since), language._ns(self.now), limit)

    def health(self) -> DataFrame:
        """Statistics of the tables that are there."""
        return storage.stats(self.spark, {t: f"{self.root}/{t}" for t in TABLES if self._there(t)})

    def _there(self, table: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
