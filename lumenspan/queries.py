"""Queries over the test tables, each with the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import anomaly, cardinality, graph, logs, rollup, sampling, storage, tree, weighted
from .plans import logical
from .sources import fixtures, otlp
from .sources.fixtures import LOGS_SQL, SPANS_SQL, TREES_SQL
from .streaming import assemble
from .work import free_shuffles, new_folder, staged

NOW = datetime(2024, 1, 31, tzinfo=timezone.utc)
NOW_NS = 1_706_659_200_000_000_000
MONTH = 'range("2024-01-01T00:00:00Z", "2024-01-31T00:00:00Z")'

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


_BIN = "(({v} >> greatest(0, length(bin({v})) - 10)) << greatest(0, length(bin({v})) - 10))"


def _dsl(name: str, text: str, sql: str, cast: dict[str, str] | None = None, exact: bool = False) -> None:
    """A query of the language; ``cast`` gives columns that are rounded or renamed."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = logical.run(text, fixtures.spans(spark, sf_dir), NOW, exact=exact)
        return out.selectExpr(*(f"{e} AS {n}" for n, e in cast.items())) if cast else out

    run.__name__, run.__doc__ = name, text
    QUERIES[name], SQL[name] = run, f"WITH {SPANS_SQL} {sql}"


_RANGE = "ts_ns >= 1704067200000000000 AND ts_ns < 1706659200000000000"
_WP = "CAST(quantile_cont(duration_ns, {q}) AS DOUBLE)"
_EXPANDED = f"""x AS (SELECT s.*, CAST(sampling_weight AS BIGINT) AS w FROM spans s WHERE {_RANGE}), e AS (SELECT x.* FROM x, range(20) r(i) WHERE i < w)"""

#: Groups of x with the running weight over the bins of durations, as the mergeable quantiles have it.
_RANKED = f"""b AS (SELECT *, {_BIN.format(v='duration_ns')} AS bin FROM x), r AS (SELECT *, sum(w) OVER (PARTITION BY {{by}} ORDER BY bin) AS upto, sum(w) OVER (PARTITION BY {{by}}) AS total FROM b)"""
_WEIGHED = f"x AS (SELECT s.*, CAST(sampling_weight AS BIGINT) AS w FROM spans s WHERE {_RANGE} {{where}})"
_AT = "CAST(min(bin) FILTER (upto >= {q} * total) AS DOUBLE)"

_dsl(
    "dsl_flagship",
    f"{{status=error}} {MONTH} | duration > 5ms | count, p95(duration) by (service, operation) | sort by (count desc, service, operation) | limit 10",
    f""", {_WEIGHED.format(where="AND status_code = 'error' AND duration_ns > 5000000")}, {_RANKED.format(by='service_name, span_name')}
    SELECT service_name AS service, span_name AS operation, sum(sampling_weight) AS count, {_AT.format(q=0.95)} AS p95_duration FROM r
    GROUP BY ALL ORDER BY count DESC, service, operation LIMIT 10""",
    {"service": "service", "operation": "operation", "count": "`count`", "p95_duration": "p95_duration"},
)
_ID = {"ts_ns": "ts_ns", "span_id": "span_id", "service_name": "service_name", "span_name": "span_name", "duration_ns": "duration_ns"}
_IDS = "SELECT ts_ns, span_id, service_name, span_name, duration_ns FROM spans"
_dsl("dsl_filter_eq_neq_regex", f'{{service=~"svc-[1-5]", operation!="click", operation!~"^e", event.type!="nothing"}} {MONTH}',
     f"{_IDS} WHERE {_RANGE} AND regexp_matches(service_name, 'svc-[1-5]') AND span_name <> 'click' AND NOT regexp_matches(span_name, '^e')", _ID)
_dsl("dsl_label_eq", f'{{service="svc-3", status=ok, kind=server}} {MONTH}', f"{_IDS} WHERE {_RANGE} AND service_name = 'svc-3' AND status_code = 'ok'", _ID)
_dsl("dsl_numeric_ops", f"{{}} {MONTH} | duration >= 2ms | duration < 1h30m | k >= 10 | k <= 90 | k != 50 | sampling_weight == 20 | duration > 0.5ms",
     f"{_IDS} WHERE {_RANGE} AND duration_ns >= 2000000 AND duration_ns < 5400000000000 AND TRY_CAST(k AS DOUBLE) BETWEEN 10 AND 90 AND TRY_CAST(k AS DOUBLE) <> 50 AND sampling_weight = 20", _ID)
_dsl("dsl_attr_fallback_groupby", f'{{user.id=~"^1"}} {MONTH} | count by (user.id, deployment.environment)',
     f"SELECT user_id, 'test' AS environment, sum(sampling_weight) AS count FROM spans WHERE {_RANGE} AND regexp_matches(user_id, '^1') GROUP BY ALL", {"user_id": "`user.id`", "environment": "`deployment.environment`", "count": "`count`"})
_dsl("dsl_all_aggs", f"{{}} {MONTH} | count, sum(duration), avg(duration), min(duration), max(duration), p50(duration), p95(duration), p99(duration) by (operation)",
     f""", {_WEIGHED.format(where="")}, {_RANKED.format(by='span_name')}
     SELECT span_name AS operation, sum(sampling_weight) AS count, CAST(sum(duration_ns * w) AS BIGINT) AS total, round(sum(duration_ns * w)::DOUBLE / sum(w), 3) AS mean, min(duration_ns) AS least, max(duration_ns) AS greatest,
       {_AT.format(q=0.5)} AS p50, {_AT.format(q=0.95)} AS p95, {_AT.format(q=0.99)} AS p99 FROM r GROUP BY ALL""",
     {"operation": "operation", "count": "`count`", "total": "CAST(sum_duration AS BIGINT)", "mean": "round(avg_duration, 3)", "least": "min_duration", "greatest": "max_duration", "p50": "p50_duration", "p95": "p95_duration", "p99": "p99_duration"})
_dsl("dsl_exact_quantiles", f"{{}} {MONTH} | count, sum(duration), avg(duration), min(duration), max(duration), p50(duration), p95(duration), p99(duration) by (operation)",
     f""", {_EXPANDED}, q AS (SELECT span_name, {_WP.format(q=0.5)} AS p50, {_WP.format(q=0.95)} AS p95, {_WP.format(q=0.99)} AS p99 FROM e GROUP BY ALL)
     SELECT span_name AS operation, sum(sampling_weight) AS count, CAST(sum(duration_ns * w) AS BIGINT) AS total, round(sum(duration_ns * w)::DOUBLE / sum(w), 3) AS mean, min(duration_ns) AS least, max(duration_ns) AS greatest,
       round(any_value(p50), 3) AS p50, round(any_value(p95), 3) AS p95, round(any_value(p99), 3) AS p99 FROM x JOIN q USING (span_name) GROUP BY ALL""",
     {"operation": "operation", "count": "`count`", "total": "CAST(sum_duration AS BIGINT)", "mean": "round(avg_duration, 3)", "least": "min_duration", "greatest": "max_duration", "p50": "round(p50_duration, 3)", "p95": "round(p95_duration, 3)", "p99": "round(p99_duration, 3)"}, exact=True)
_dsl("dsl_global_agg", f"{{}} {MONTH} | count, max(k), avg(k)",
     f"SELECT sum(sampling_weight) AS count, max(TRY_CAST(k AS DOUBLE)) AS most, round(sum(TRY_CAST(k AS DOUBLE) * sampling_weight) / sum(CASE WHEN TRY_CAST(k AS DOUBLE) IS NOT NULL THEN sampling_weight END), 6) AS mean FROM spans WHERE {_RANGE}", {"count": "`count`", "most": "max_k", "mean": "round(avg_k, 6)"})
_dsl("dsl_contradiction_empty", f'{{service="svc-1"}} {MONTH} | duration > 500ms | duration < 300ms', f"{_IDS} WHERE false", _ID)


@query(f"WITH {SPANS_SQL} SELECT service_name AS service, sum(sampling_weight) AS count FROM spans WHERE ts_ns >= 1704866400000000000 AND ts_ns < 1704996000000000000 GROUP BY ALL")
def dsl_partition_prune(spark, sf_dir):
    """A day and a half of a table with a folder per day: only the two days' folders are read."""
    path = new_folder(spark, "spans")
    storage.write(fixtures.spans(spark, sf_dir), path, "spans")
    return logical.run('{} range("2024-01-10T06:00:00Z", "2024-01-11T18:00:00Z") | count by (service)', spark.read.parquet(path), NOW)


_dsl("dsl_since", "{status!=error} since 36h", f"{_IDS} WHERE status_code <> 'error' AND ts_ns >= 1706529600000000000 AND ts_ns < 1706659200000000000", _ID)
_dsl("dsl_topk", f"{{}} {MONTH} | sort by (duration desc, span_id) | limit 25", f"{_IDS} WHERE {_RANGE} ORDER BY duration_ns DESC, span_id LIMIT 25", _ID)


@query(f"WITH {TREES_SQL} SELECT ts_ns, span_id, parent_span_id, service_name, span_name, duration_ns FROM tree WHERE trace_id = '00000000000000000000000000000007'")
def trace_lookup(spark, sf_dir):
    out = logical.run('trace("00000000000000000000000000000007")', fixtures.trees(spark, sf_dir), NOW)
    return out.select("ts_ns", "span_id", "parent_span_id", "service_name", "span_name", "duration_ns")


@query(f"WITH {TREES_SQL} SELECT trace_id, count(*) AS n_spans, min(ts_ns) AS start_ns, max(ts_ns + duration_ns) - min(ts_ns) AS duration_ns, bool_or(status_code = 'error') AS has_error FROM tree GROUP BY trace_id")
def trace_summary(spark, sf_dir):
    return tree.summaries(fixtures.trees(spark, sf_dir))


@query(f"WITH {TREES_SQL.replace('tree AS (', 'tree AS MATERIALIZED (')} SELECT trace_id, span_id, parent_span_id FROM tree c WHERE parent_span_id <> '0000000000000000' AND NOT EXISTS (SELECT 1 FROM tree p WHERE p.trace_id = c.trace_id AND p.span_id = c.parent_span_id)")
def trace_orphans(spark, sf_dir):
    return tree.orphans(fixtures.trees(spark, sf_dir)).select("trace_id", "span_id", "parent_span_id")


_WALK = """w AS (SELECT trace_id, span_id, service_name || '/' || span_name AS path, CAST(0 AS BIGINT) AS depth, duration_ns, status_code FROM tree t
     WHERE parent_span_id = '0000000000000000' OR NOT EXISTS (SELECT 1 FROM tree p WHERE p.trace_id = t.trace_id AND p.span_id = t.parent_span_id)
  UNION ALL SELECT c.trace_id, c.span_id, w.path || ';' || c.service_name || '/' || c.span_name, w.depth + 1, c.duration_ns, c.status_code FROM w JOIN tree c ON c.trace_id = w.trace_id AND c.parent_span_id = w.span_id)"""


@query(f"WITH RECURSIVE {TREES_SQL}, {_WALK} SELECT depth, count(*) AS n_spans FROM w GROUP BY depth")
def trace_depth(spark, sf_dir):
    return tree.assembled(fixtures.trees(spark, sf_dir)).groupBy("depth").agg(F.count(F.lit(1)).alias("n_spans"))


@query(f"""WITH RECURSIVE {TREES_SQL}, best AS (
  SELECT trace_id, parent_span_id, span_id, duration_ns FROM tree QUALIFY row_number() OVER (PARTITION BY trace_id, parent_span_id ORDER BY ts_ns + duration_ns DESC, ts_ns, span_id) = 1),
c AS (SELECT trace_id, span_id, duration_ns FROM tree WHERE parent_span_id = '0000000000000000' UNION ALL SELECT b.trace_id, b.span_id, b.duration_ns FROM c JOIN best b ON b.trace_id = c.trace_id AND b.parent_span_id = c.span_id)
SELECT trace_id, count(*) AS path_spans, CAST(sum(duration_ns) AS BIGINT) AS path_duration_ns FROM c GROUP BY trace_id""")
def critical_path(spark, sf_dir):
    return tree.critical_paths(fixtures.trees(spark, sf_dir))


@query(f"WITH RECURSIVE {TREES_SQL.replace('tree AS (', 'every AS (')}, tree AS (SELECT * FROM every WHERE trace_id IN (SELECT trace_id FROM every WHERE span_name = 'line-4')), {_WALK} SELECT path, CAST(sum(duration_ns) AS BIGINT) AS duration_ns, count(*) AS n_spans, count(*) FILTER (status_code = 'error') AS n_errors FROM w GROUP BY path")
def flamegraph_merge(spark, sf_dir):
    return tree.flamegraph(fixtures.trees(spark, sf_dir), operation="line-4")


_EDGES = f"{TREES_SQL.replace('tree AS (', 'tree AS MATERIALIZED (')}, edges AS (SELECT c.ts_ns, p.service_name AS caller_service, c.service_name AS callee_service, c.duration_ns, CASE WHEN c.status_code = 'error' THEN 1 ELSE 0 END AS is_error, c.sampling_weight FROM tree c JOIN tree p ON p.trace_id = c.trace_id AND p.span_id = c.parent_span_id AND p.service_name <> c.service_name)"


@query(f"WITH {_EDGES} SELECT ts_ns, caller_service, callee_service, duration_ns, CAST(is_error AS INTEGER) AS is_error, sampling_weight FROM edges")
def service_edges(spark, sf_dir):
    return tree.service_edges(fixtures.trees(spark, sf_dir))


@query(f"""WITH {_EDGES}, b AS (SELECT *, {_BIN.format(v='duration_ns')} AS bin FROM edges),
r AS (SELECT *, sum(sampling_weight) OVER (PARTITION BY caller_service, callee_service ORDER BY bin) AS upto, sum(sampling_weight) OVER (PARTITION BY caller_service, callee_service) AS total FROM b)
SELECT caller_service, callee_service, sum(sampling_weight) AS calls, sum(is_error * sampling_weight) / sum(sampling_weight) AS error_rate,
  min(bin) FILTER (upto >= 0.5 * total) AS p50_ns, min(bin) FILTER (upto >= 0.95 * total) AS p95_ns, min(bin) FILTER (upto >= 0.99 * total) AS p99_ns FROM r GROUP BY ALL""")
def service_graph(spark, sf_dir):
    return graph.graph(graph.edge_states(tree.service_edges(fixtures.trees(spark, sf_dir))))


@query(f"""WITH {_EDGES}, calls AS (SELECT callee_service AS service, sum(sampling_weight) AS n FROM edges GROUP BY ALL), nodes AS (SELECT caller_service AS service FROM edges UNION SELECT callee_service FROM edges)
SELECT service, coalesce(n, 0) AS inbound_calls, round(coalesce(n, 0) / sum(n) OVER (), 9) AS criticality FROM nodes LEFT JOIN calls USING (service)""")
def graph_nodes(spark, sf_dir):
    edges = graph.graph(graph.edge_states(tree.service_edges(fixtures.trees(spark, sf_dir))))
    return graph.criticality(edges).withColumn("criticality", F.round("criticality", 9))


@query(f"WITH RECURSIVE {_EDGES}, d AS (SELECT DISTINCT caller_service AS x, callee_service AS y FROM edges), reach AS (SELECT x, y FROM d UNION SELECT r.x, d.y FROM reach r JOIN d ON d.x = r.y) SELECT DISTINCT x AS service FROM reach WHERE x = y")
def graph_cycles(spark, sf_dir):
    return graph.services_on_cycles(tree.service_edges(fixtures.trees(spark, sf_dir)))


_LEAVES = ("svc-0", "svc-1", "svc-2")


@query(f"""WITH RECURSIVE {_EDGES}, d AS (SELECT DISTINCT caller_service AS x, callee_service AS y FROM edges UNION SELECT s, 'db-' || s FROM (VALUES ('svc-0'), ('svc-1'), ('svc-2')) t(s)),
u AS (SELECT x, y FROM d UNION SELECT y, x FROM d), n AS (SELECT DISTINCT x AS v FROM u),
reach AS (SELECT n.v AS without, (SELECT min(m.v) FROM n m WHERE m.v <> n.v) AS v FROM n UNION SELECT r.without, u.y FROM reach r JOIN u ON u.x = r.v AND u.y <> r.without)
SELECT without AS service FROM reach GROUP BY without HAVING count(*) < (SELECT count(*) - 1 FROM n)""")
def graph_cut_vertices(spark, sf_dir):
    """Three of the services have a store of their own, which is reached through them alone."""
    edges = tree.service_edges(fixtures.trees(spark, sf_dir)).select("caller_service", "callee_service")
    own = spark.createDataFrame([(s, f"db-{s}") for s in _LEAVES], edges.schema)
    return graph.cut_vertices(edges.unionByName(own))


@query(SQL["service_graph"])
def service_graph_redelivered(spark, sf_dir):
    """The service graph of spans that were all delivered twice."""
    spans = fixtures.trees(spark, sf_dir)
    return graph.graph(graph.edge_states(tree.service_edges(spans.unionByName(spans))))


def _red_sql(seconds: int) -> str:
    size = seconds * 1_000_000_000
    return f"""WITH {SPANS_SQL}, b AS (SELECT ts_ns - ts_ns % {size} AS bucket, service_name, span_name AS operation, status_code, sampling_weight AS cw, CAST(round_even(sampling_weight, 0) AS BIGINT) AS w, {_BIN.format(v='duration_ns')} AS bin FROM spans),
r AS (SELECT *, sum(w) OVER (PARTITION BY bucket, service_name, operation ORDER BY bin) AS upto, sum(w) OVER (PARTITION BY bucket, service_name, operation) AS total FROM b)
SELECT bucket, service_name, operation, sum(cw) AS calls, coalesce(sum(cw) FILTER (status_code = 'error'), 0) AS errors, coalesce(sum(cw) FILTER (status_code = 'error'), 0) / sum(cw) AS error_rate,
  min(bin) FILTER (upto >= 0.5 * total) AS p50_ns, min(bin) FILTER (upto >= 0.95 * total) AS p95_ns, min(bin) FILTER (upto >= 0.99 * total) AS p99_ns FROM r GROUP BY ALL"""


@query(_red_sql(60))
def red_1m(spark, sf_dir):
    return rollup.red(rollup.red_states(fixtures.spans(spark, sf_dir)))


@query(_red_sql(300))
def red_5m(spark, sf_dir):
    return rollup.red(rollup.coarser(rollup.red_states(fixtures.spans(spark, sf_dir)), "5m"))


@query(_red_sql(3600))
def red_1h(spark, sf_dir):
    return rollup.red(rollup.coarser(rollup.coarser(rollup.red_states(fixtures.spans(spark, sf_dir)), "5m"), "1h"))


@query("""SELECT epoch_us(ts) * 1000 - (epoch_us(ts) * 1000) % 3600000000000 AS bucket, 'svc-' || CAST(user_id % 10 AS VARCHAR) AS service_name, 'events.' || event_type AS metric_name, 'gauge' AS metric_type, 'user=' || CAST(user_id AS VARCHAR) AS labels_key,
  count(value) AS n, round(sum(value), 6) AS total, min(value) AS least, max(value) AS greatest FROM events GROUP BY ALL""")
def metrics_rollup(spark, sf_dir):
    out = rollup.metric_rollup(rollup.metric_states(fixtures.metrics(spark, sf_dir)), 3600)
    return out.withColumn("total", F.round("total", 6)).drop("mean")


@query("""SELECT epoch_us(ts) * 1000 - (epoch_us(ts) * 1000) % 60000000000 AS bucket, 'svc-' || CAST(user_id % 10 AS VARCHAR) AS service_name, 'events.' || event_type AS metric_name, 'user=' || CAST(user_id AS VARCHAR) AS labels_key,
  count(value) AS n, round(sum(value), 6) AS total, min(value) AS least, max(value) AS greatest FROM events GROUP BY ALL""")
def metrics_rollup_1m(spark, sf_dir):
    return rollup.metric_states(fixtures.metrics(spark, sf_dir)).select("bucket", "service_name", "metric_name", "labels_key", "n", F.round("total", 6).alias("total"), "least", "greatest")


_FLOAT_BIN = "floor(value / pow(2.0, floor(log2(value)) - 9)) * pow(2.0, floor(log2(value)) - 9)"


@query(f"""WITH b AS (SELECT epoch_us(ts) * 1000 - (epoch_us(ts) * 1000) % 3600000000000 AS bucket, 'events.' || event_type AS metric_name, CASE WHEN value = 0 THEN 0 ELSE {_FLOAT_BIN} END AS bin FROM events WHERE value IS NOT NULL),
r AS (SELECT *, count(*) OVER (PARTITION BY bucket, metric_name ORDER BY bin) AS upto, count(*) OVER (PARTITION BY bucket, metric_name) AS total FROM b)
SELECT bucket, metric_name, min(bin) FILTER (upto >= 0.5 * total) AS p50, min(bin) FILTER (upto >= 0.95 * total) AS p95, min(bin) FILTER (upto >= 0.99 * total) AS p99 FROM r GROUP BY ALL""")
def metrics_quantiles(spark, sf_dir):
    """Hourly quantiles of each metric over all series, from one-minute histograms."""
    return rollup.metric_quantiles(rollup.metric_bins(fixtures.metrics(spark, sf_dir)), 3600, ("metric_name",))


@query(f"WITH {SPANS_SQL} SELECT DISTINCT service_name FROM spans WHERE ts_ns - ts_ns % 3600000000000 >= {NOW_NS - 30 * 86_400_000_000_000}")
def services_distinct(spark, sf_dir):
    return rollup.services(rollup.coarser(rollup.red_states(fixtures.spans(spark, sf_dir)), "1h"), NOW_NS - 30 * 86_400_000_000_000)


@query(f"WITH {SPANS_SQL} SELECT service_name, count(*) AS n_spans, round(avg(duration_ns) / 1e6, 2) AS mean_ms FROM spans GROUP BY ALL")
def spans_per_service(spark, sf_dir):
    return fixtures.spans(spark, sf_dir).groupBy("service_name").agg(F.count(F.lit(1)).alias("n_spans"), F.round(F.avg("duration_ns") / 1e6, 2).alias("mean_ms"))


@query(f"WITH {LOGS_SQL} SELECT 'event ' || event_type || ' by user <*> value <*> key <*>' AS template_text, count(*) AS occurrences, min(ts_ns) AS first_seen, max(ts_ns) AS last_seen FROM logs GROUP BY event_type")
def log_templates(spark, sf_dir):
    parsed = staged(logs.with_templates(fixtures.logs(spark, sf_dir)).select("ts_ns", "template_id", "template_text"), "parsed")
    return logs.template_counts(parsed, logs.dictionary(parsed), 0, NOW_NS).drop("template_id")


@query(f"WITH {LOGS_SQL} SELECT ts_ns, span_id, body FROM logs WHERE event_type = 'click' ORDER BY ts_ns DESC, span_id LIMIT 100")
def log_instances(spark, sf_dir):
    parsed = staged(logs.with_templates(fixtures.logs(spark, sf_dir)).drop("params"), "parsed")
    words = F.col("template_text").startswith("event click by")
    picked = logs.dictionary(parsed).where(words).select("template_id")
    found = parsed.join(picked, "template_id", "left_semi")
    return logs.blank_ids(found).orderBy(F.desc("ts_ns"), "span_id").limit(100).select("ts_ns", "span_id", "body")


@query(f"WITH {LOGS_SQL} SELECT ts_ns, trace_id, span_id, body FROM logs WHERE trace_id = md5('7')")
def trace_logs(spark, sf_dir):
    import hashlib

    return logs.of_trace(fixtures.logs(spark, sf_dir), hashlib.md5(b"7").hexdigest()).select("ts_ns", "trace_id", "span_id", "body")


#: Lines with their words, and which of the words at places 5, 7 and 9 the template has widened by then.
_WIDENED = f"""{LOGS_SQL}, n AS (SELECT *, string_split(body, ' ') AS t FROM logs),
w AS (SELECT *, first_value(t) OVER o AS f FROM n WINDOW o AS (PARTITION BY event_type ORDER BY ts_ns, trace_id, span_id, body)),
p AS (SELECT *, bool_or(t[5] <> f[5]) OVER o AS a, bool_or(t[7] <> f[7]) OVER o AS b, bool_or(t[9] <> f[9]) OVER o AS c FROM w WINDOW o AS (PARTITION BY event_type ORDER BY ts_ns, trace_id, span_id, body ROWS UNBOUNDED PRECEDING))"""


@query(f"WITH {_WIDENED} SELECT count(*) AS n_lines, CAST(sum(strlen(body)) AS BIGINT) AS raw_bytes, CAST(sum(4 + CASE WHEN a THEN strlen(t[5]) + 1 ELSE 0 END + CASE WHEN b THEN strlen(t[7]) + 1 ELSE 0 END + CASE WHEN c THEN strlen(t[9]) + 1 ELSE 0 END) AS BIGINT) AS templated_bytes FROM p")
def log_savings(spark, sf_dir):
    return logs.savings(logs.with_templates(fixtures.logs(spark, sf_dir)))


@query(f"WITH {_WIDENED} SELECT ts_ns, span_id, concat_ws('|', CASE WHEN a THEN t[5] END, CASE WHEN b THEN t[7] END, CASE WHEN c THEN t[9] END) AS params FROM p")
def log_params(spark, sf_dir):
    return logs.with_templates(fixtures.logs(spark, sf_dir)).select("ts_ns", "span_id", F.array_join("params", "|").alias("params"))


_CHAIN = (sampling.Policy("errors"), sampling.Policy("slow", threshold_ns=110_000_000), sampling.Policy("probabilistic", rate=0.05))
_DECIDED = f"""{TREES_SQL}, v AS (SELECT trace_id, max(ts_ns + duration_ns) - min(ts_ns) AS d, bool_or(status_code = 'error') AS e FROM tree GROUP BY trace_id),
decided AS (SELECT trace_id, CASE WHEN e THEN 'errors' WHEN d > 110000000 THEN 'slow' ELSE 'probabilistic' END AS policy,
  e OR d > 110000000 OR CAST('0x' || substr(md5('sampling-decision:' || trace_id), 1, 8) AS BIGINT) / 4294967296.0 < 0.05 AS sampled,
  CASE WHEN e OR d > 110000000 THEN 1.0 WHEN CAST('0x' || substr(md5('sampling-decision:' || trace_id), 1, 8) AS BIGINT) / 4294967296.0 < 0.05 THEN 20.0 ELSE 0.0 END::DOUBLE AS weight FROM v)"""


@query(f"WITH {_DECIDED} SELECT trace_id, sampled, policy, weight FROM decided")
def sampling_decide(spark, sf_dir):
    return sampling.decide(fixtures.trees(spark, sf_dir), _CHAIN)


@query(f"WITH {_DECIDED} SELECT service_name, sum(weight) AS estimated, count(*) AS seen FROM tree JOIN decided USING (trace_id) WHERE sampled GROUP BY ALL")
def sampling_upweight(spark, sf_dir):
    spans = fixtures.trees(spark, sf_dir)
    return sampling.upweighted(sampling.sampled(spans, sampling.decide(spans, _CHAIN)), "service_name")


@query(f"""WITH {SPANS_SQL}, w AS (SELECT span_id, duration_ns, list(duration_ns) OVER (PARTITION BY service_name ORDER BY ts_ns, span_id ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING) AS past FROM spans)
SELECT span_id AS trace_id, CASE WHEN len(past) > 0 THEN list_sort(past)[1 + least(len(past) * 99 // 100, len(past) - 1)] ELSE -1 END AS p99_ns FROM w""")
def sampling_rolling_p99(spark, sf_dir):
    # each span is taken as a trace of its own, so that the window has many of them
    one = fixtures.spans(spark, sf_dir).withColumn("trace_id", F.col("span_id"))
    return sampling.rolling_p99(sampling.views(one)).select("trace_id", F.coalesce("p99_ns", F.lit(-1)).cast("long").alias("p99_ns"))


def _bucket_sql(rows: str, per_second: float) -> str:
    """A token bucket per service over ``rows`` (trace_id, service_name, start_ns), one row after the other."""
    return f"""lined AS (SELECT *, row_number() OVER (PARTITION BY service_name ORDER BY start_ns, trace_id) AS k FROM {rows}),
bucket AS (SELECT service_name, k, trace_id, start_ns, CAST({per_second} - 1 AS DOUBLE) AS rest, true AS allowed FROM lined WHERE k = 1
  UNION ALL SELECT l.service_name, l.k, l.trace_id, l.start_ns, least({per_second}::DOUBLE, b.rest + (l.start_ns - b.start_ns) / 1e9 * {per_second}) - CASE WHEN least({per_second}::DOUBLE, b.rest + (l.start_ns - b.start_ns) / 1e9 * {per_second}) >= 1 THEN 1 ELSE 0 END,
    least({per_second}::DOUBLE, b.rest + (l.start_ns - b.start_ns) / 1e9 * {per_second}) >= 1 FROM bucket b JOIN lined l ON l.service_name = b.service_name AND l.k = b.k + 1)"""


@query(f"""WITH RECURSIVE {SPANS_SQL}, one AS (SELECT span_id AS trace_id, service_name, ts_ns // 1000 AS start_ns FROM spans), {_bucket_sql('one', 1.5)} SELECT trace_id, service_name, allowed FROM bucket""")
def sampling_rate_limit(spark, sf_dir):
    """Each span as a trace of its own, a thousand times as dense as it was, so that the limit is passed."""
    one = fixtures.spans(spark, sf_dir).withColumns({"trace_id": F.col("span_id"), "ts_ns": F.floor(F.col("ts_ns") / 1000).cast("long")})
    return sampling.within_rate(sampling.views(one), 1.5).select("trace_id", "service_name", "allowed")


@query(f"""WITH RECURSIVE {SPANS_SQL}, one AS (SELECT span_id AS trace_id, service_name, ts_ns // 1000 AS start_ns, duration_ns, status_code FROM spans),
first AS (SELECT *, CASE WHEN status_code = 'error' THEN 'errors' WHEN duration_ns > 20000000 THEN 'slow' END AS policy FROM one), left_ AS (SELECT * FROM first WHERE policy IS NULL), {_bucket_sql('left_', 1.5)},
last AS (SELECT trace_id, allowed, CAST('0x' || substr(md5('sampling-decision:' || trace_id), 1, 8) AS BIGINT) / 4294967296.0 < 0.25 AS chosen FROM bucket)
SELECT f.trace_id, coalesce(policy, CASE WHEN allowed THEN 'probabilistic' ELSE 'rate_limit' END) AS policy, policy IS NOT NULL OR allowed AND chosen AS sampled, CAST(CASE WHEN policy IS NOT NULL THEN 1 WHEN allowed AND chosen THEN 4 ELSE 0 END AS DOUBLE) AS weight
FROM first f LEFT JOIN last USING (trace_id)""")
def sampling_chain(spark, sf_dir):
    """A rate limit behind errors and slow traces, which use up none of its tokens."""
    one = fixtures.spans(spark, sf_dir).withColumns({"trace_id": F.col("span_id"), "ts_ns": F.floor(F.col("ts_ns") / 1000).cast("long")})
    chain = (sampling.Policy("errors"), sampling.Policy("slow", threshold_ns=20_000_000), sampling.Policy("rate_limit", per_second=1.5), sampling.Policy("probabilistic", rate=0.25))
    return sampling.decide(one, chain).select("trace_id", "policy", "sampled", "weight")


@query(f"WITH {SPANS_SQL} SELECT trace_id, CAST(sum(96 + 44 + 2 * strlen(span_name) + strlen(service_name) + strlen('server') + strlen(status_code) + strlen(user_id) + coalesce(strlen(k), 0)) AS BIGINT) AS held_bytes FROM spans GROUP BY ALL")
def sampling_held_bytes(spark, sf_dir):
    """What each trace takes in a buffer."""
    spans = fixtures.spans(spark, sf_dir)
    return spans.groupBy("trace_id").agg(F.sum(sampling.span_bytes(spans)).alias("held_bytes"))


@query(f"""WITH {SPANS_SQL}, f AS (SELECT trace_id, min(ts_ns) AS start_ns FROM spans GROUP BY ALL),
n AS (SELECT *, lead(start_ns, 5) OVER (PARTITION BY CAST('0x' || substr(md5(trace_id), 1, 8) AS BIGINT) % 4 ORDER BY start_ns, trace_id) AS following FROM f)
SELECT trace_id, start_ns, least(coalesce(following, start_ns + 3600000000000), start_ns + 3600000000000) AS decided_ns, coalesce(following < start_ns + 3600000000000, false) AS forced FROM n""")
def sampling_evictions(spark, sf_dir):
    """Buffers of five traces in four replicas, each trace waiting an hour."""
    return sampling.cutoffs(fixtures.spans(spark, sf_dir), 5, 3_600_000, 4)


@query(f"WITH {SPANS_SQL} SELECT 'k' AS key, count(DISTINCT k) AS distinct_values FROM spans UNION ALL SELECT 'event.type', count(DISTINCT span_name) FROM spans")
def cardinality_exact(spark, sf_dir):
    return cardinality.estimates(fixtures.spans(spark, sf_dir), exact=True)


@query(f"WITH {SPANS_SQL} SELECT 'k' AS key, count(DISTINCT k) AS distinct_values, true AS near FROM spans UNION ALL SELECT 'event.type', count(DISTINCT span_name), true FROM spans")
def cardinality_estimate(spark, sf_dir):
    """Merged sketches of two halves, each estimate within 3 % of the count beside it."""
    spans = fixtures.spans(spark, sf_dir)
    even = F.pmod(F.xxhash64("span_id"), F.lit(2)) == 0
    merged = cardinality.merged_estimates(cardinality.sketches(spans.where(even)), cardinality.sketches(spans.where(~even))).withColumnRenamed("distinct_values", "estimate")
    both = cardinality.estimates(spans, exact=True).join(merged, "key")
    return both.select("key", "distinct_values", (F.abs(F.col("estimate") - F.col("distinct_values")) <= F.col("distinct_values") * 0.03).alias("near"))


@query(f"WITH {SPANS_SQL} SELECT span_id, span_name AS event_type, CAST(NULL AS VARCHAR) AS k FROM spans")
def cardinality_guard(spark, sf_dir):
    out = cardinality.guarded(fixtures.spans(spark, sf_dir), {"k": cardinality.Budget(10, "drop")}, exact=True)
    return out.select("span_id", F.col("span_attributes")["event.type"].alias("event_type"), F.col("span_attributes")["k"].alias("k"))


@query(f"WITH {SPANS_SQL} SELECT span_id, 'bucket_' || CAST(CAST('0x' || substr(md5(k), 1, 8) AS BIGINT) % 8 AS VARCHAR) AS k FROM spans")
def cardinality_buckets(spark, sf_dir):
    out = cardinality.guarded(fixtures.spans(spark, sf_dir), {"k": cardinality.Budget(10, "bucket", 8)}, exact=True)
    return out.select("span_id", F.col("span_attributes")["k"].alias("k"))


@query("SELECT l_orderkey, l_linenumber, l_shipdate, max(l_quantity) AS l_quantity FROM (SELECT *, rank() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_quantity DESC) AS k FROM lineitem) WHERE k = 1 GROUP BY ALL")
def dedup_latest(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("version", F.struct("l_shipdate", "l_quantity"))
    return storage.latest_version(lines, ["l_orderkey", "l_linenumber"], "version").select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity")


def _ticks(spark, sf_dir):
    s = fixtures.spans(spark, sf_dir)
    return s.select(F.col("span_name").alias("series"), "ts_ns", F.col("span_id").alias("tick_id"), (F.col("duration_ns") / 1e6).alias("value"))


_SCORED = f"""{SPANS_SQL}, t AS (SELECT span_name AS series, ts_ns, span_id AS tick_id, duration_ns / 1e6 AS value, list(duration_ns / 1e6) OVER (PARTITION BY span_name, (ts_ns // 3600000000000) % 168 ORDER BY ts_ns, span_id ROWS BETWEEN 32 PRECEDING AND 1 PRECEDING) AS past FROM spans),
m AS (SELECT *, len(past) >= 8 AS ready, list_aggregate(past, 'median') AS med FROM t),
scored AS (SELECT series, ts_ns, tick_id, value, coalesce(ready, false) AS ready, CASE WHEN ready THEN med END AS baseline,
  CASE WHEN ready THEN (value - med) / greatest(list_aggregate(list_transform(past, lambda v: abs(v - med)), 'median') * 1.4826, 1e-9) END AS z FROM m)"""


@query(f"WITH {_SCORED} SELECT tick_id, ready, round(baseline, 6) AS baseline, round(z, 4) AS z FROM scored")
def anomaly_zscore(spark, sf_dir):
    return anomaly.scores(_ticks(spark, sf_dir)).select("tick_id", "ready", F.round("baseline", 6).alias("baseline"), F.round("z", 4).alias("z"))


@query(f"""WITH {_SCORED}, e AS (SELECT *, CASE WHEN ready AND count(*) OVER o = 2 AND min(CASE WHEN z >= 1.5 THEN 1 ELSE 0 END) OVER o = 1 THEN 1 WHEN ready AND count(*) OVER o = 2 AND min(CASE WHEN z <= 0.5 THEN 1 ELSE 0 END) OVER o = 1 THEN 0 END AS event
  FROM scored WINDOW o AS (PARTITION BY series, ready ORDER BY ts_ns, tick_id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)),
f AS (SELECT *, coalesce(last_value(event IGNORE NULLS) OVER (PARTITION BY series ORDER BY ts_ns, tick_id ROWS UNBOUNDED PRECEDING), 0) = 1 AS firing FROM e)
SELECT tick_id, firing, firing <> coalesce(lag(firing) OVER (PARTITION BY series ORDER BY ts_ns, tick_id), false) AS state_changed FROM f""")
def anomaly_firing(spark, sf_dir):
    return anomaly.firing(anomaly.scores(_ticks(spark, sf_dir)), trigger=1.5, clear=0.5).select("tick_id", "firing", "state_changed")


def _rule_values(spark, sf_dir):
    states = rollup.coarser(rollup.red_states(fixtures.spans(spark, sf_dir)), "1h")
    per = states.groupBy(F.col("service_name").alias("rule"), F.col("bucket").alias("ts_ns")).agg(F.sum("error_weight").alias("e"), F.sum("call_weight").alias("c"))
    return per.select("rule", "ts_ns", (F.col("e") / F.col("c")).alias("value"))


_RULED = f"""{SPANS_SQL}, v AS (SELECT service_name AS rule, ts_ns - ts_ns % 3600000000000 AS ts_ns, coalesce(sum(sampling_weight) FILTER (status_code = 'error'), 0) / sum(sampling_weight) AS value FROM spans GROUP BY ALL),
changes AS (SELECT rule, ts_ns, value, value > 0.01 AS firing FROM v QUALIFY (value > 0.01) <> coalesce(lag(value > 0.01) OVER (PARTITION BY rule ORDER BY ts_ns), false))"""


@query(f"WITH {_RULED} SELECT rule, ts_ns, round(value, 9) AS value, firing FROM changes")
def alert_transitions(spark, sf_dir):
    return anomaly.transitions(_rule_values(spark, sf_dir), ">", 0.01).withColumn("value", F.round("value", 9))


@query(f"""WITH RECURSIVE {_RULED}, n AS (SELECT rule, ts_ns, firing, row_number() OVER (PARTITION BY rule ORDER BY ts_ns) AS k FROM changes),
s AS (SELECT rule, k, ts_ns, firing, ts_ns AS sent, true AS notify FROM n WHERE k = 1
  UNION ALL SELECT n.rule, n.k, n.ts_ns, n.firing, CASE WHEN n.ts_ns - s.sent >= 10800000000000 THEN n.ts_ns ELSE s.sent END, n.ts_ns - s.sent >= 10800000000000 FROM s JOIN n ON n.rule = s.rule AND n.k = s.k + 1)
SELECT rule, ts_ns, firing FROM s WHERE notify""")
def alert_cooldown(spark, sf_dir):
    return anomaly.notifications(anomaly.transitions(_rule_values(spark, sf_dir), ">", 0.01), 10_800).select("rule", "ts_ns", "firing")


@query(f"WITH {LOGS_SQL} SELECT ts_ns, span_id FROM logs WHERE ts_ns >= {NOW_NS} - CASE WHEN severity_number >= 17 THEN 90 WHEN severity_number >= 9 THEN 14 ELSE 1 END * 86400000000000")
def retention_filter(spark, sf_dir):
    return storage.alive(fixtures.logs(spark, sf_dir), "logs", NOW_NS).select("ts_ns", "span_id")


@query(f"""WITH {SPANS_SQL}, d AS (SELECT trace_id, min(ts_ns) + 5000000000 AS decided_ns, CAST('0x' || substr(md5('sampling-decision:' || trace_id), 1, 8) AS BIGINT) / 4294967296.0 < 0.5 AS sampled FROM spans GROUP BY trace_id)
SELECT span_id, CASE WHEN ts_ns - decided_ns > 86400000000000 THEN 'new' WHEN sampled THEN 'attached' ELSE 'dropped' END AS fate FROM spans JOIN d USING (trace_id) WHERE ts_ns > decided_ns""")
def late_spans(spark, sf_dir):
    spans = fixtures.spans(spark, sf_dir)
    decisions = spans.groupBy("trace_id").agg((F.min("ts_ns") + 5_000_000_000).alias("decided_ns"))
    decisions = decisions.withColumns({"sampled": sampling.chosen(F.col("trace_id"), 0.5), "weight": F.lit(2.0)})
    out = sampling.late(spans, decisions, ttl_ns=86_400_000_000_000)
    return out.where("ts_ns > decided_ns").select("span_id", "fate")


@query("SELECT user_id, count(*) AS n_events, min(epoch_us(ts)) * 1000 AS first_ns, count(DISTINCT event_type) AS n_names FROM events GROUP BY ALL")
def events_nested_roundtrip(spark, sf_dir):
    """Events nested in a span, written to the cold form and read again."""
    s = fixtures.spans(spark, sf_dir)
    nested = s.groupBy(F.col("resource_attributes")["user.id"].cast("long").alias("user_id")).agg(F.collect_list(F.struct("ts_ns", F.col("span_name").alias("name"), F.col("span_attributes").alias("attributes"))).alias("events"))
    path = new_folder(spark, "nested")
    nested.write.parquet(path)
    back = spark.read.parquet(path).select("user_id", F.inline("events"))
    return back.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_events"), F.min("ts_ns").alias("first_ns"), F.count_distinct("name").alias("n_names"))


@query("SELECT 'events' AS \"table\", count(*) AS n_rows FROM events UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem")
def storage_rows(spark, sf_dir):
    return storage_stats(spark, sf_dir).select("table", "n_rows")


@query()
def storage_stats(spark, sf_dir):
    return storage.stats(spark, {t: f"{sf_dir}/{t}.parquet" for t in ("events", "orders", "lineitem")})


@query()
def storage_top_columns(spark, sf_dir):
    per = storage.column_stats(spark, {"lineitem": f"{sf_dir}/lineitem.parquet"}).groupBy("table", "column").agg(F.sum("compressed").alias("compressed_bytes"), F.sum("uncompressed").alias("uncompressed_bytes"))
    return per.orderBy(F.desc("compressed_bytes")).limit(10)


@query(f"WITH {SPANS_SQL}, s AS (SELECT service_name, list_sort(list(duration_ns)) AS d FROM spans GROUP BY ALL) SELECT service_name, d[1 + CAST(floor(0.5 * (len(d) - 1)) AS BIGINT)] AS p50, d[1 + CAST(floor(0.99 * (len(d) - 1)) AS BIGINT)] AS p99 FROM s")
def export_latency(spark, sf_dir):
    return weighted.at_index(fixtures.spans(spark, sf_dir), ["service_name"], "duration_ns", {"p50": 0.5, "p99": 0.99})


@query(f"WITH {SPANS_SQL} SELECT ts_ns, trace_id, span_id, service_name, span_name, duration_ns, status_code, k FROM spans")
def decode_spans(spark, sf_dir):
    """Spans written as export requests and decoded again."""
    text = lambda c: F.struct(c.cast("string").alias("stringValue"))
    pair = lambda k, c: F.struct(F.lit(k).alias("key"), text(c).alias("value"))
    s = fixtures.spans(spark, sf_dir)
    one = F.struct(
        F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), F.col("span_name").alias("name"), F.lit(2).alias("kind"), F.col("ts_ns").cast("string").alias("startTimeUnixNano"),
        (F.col("ts_ns") + F.col("duration_ns")).cast("string").alias("endTimeUnixNano"), F.array(pair("k", F.col("span_attributes")["k"])).alias("attributes"),
        F.struct(F.when(F.col("status_code") == "error", 2).otherwise(1).alias("code")).alias("status"),
    )
    # a request holds a few hundred spans, as exporters send them
    requests = s.groupBy("service_name", F.floor(F.col("ts_ns") / 3_600_000_000_000)).agg(F.collect_list(one).alias("spans")).select(
        F.to_json(F.struct(F.array(F.struct(F.struct(F.array(pair("service.name", F.col("service_name"))).alias("attributes")).alias("resource"), F.array(F.struct("spans")).alias("scopeSpans"))).alias("resourceSpans"))).alias("value")
    )
    back = otlp.spans(requests)
    return back.select("ts_ns", "trace_id", "span_id", "service_name", "span_name", "duration_ns", "status_code", F.col("span_attributes")["k"].alias("k"))


@query(_red_sql(60))
def stream_rollup(spark, sf_dir):
    """Rollup states of a stream's micro-batches, merged when they are read."""
    path = new_folder(spark, "stream")
    spans = fixtures.spans(spark, sf_dir)
    spans.repartition(3).write.parquet(f"{path}/in")
    read = assemble.source(spark, "parquet", spans.schema, path=f"{path}/in", maxFilesPerTrigger=1)
    q = read.writeStream.foreachBatch(assemble.rollup_sink(f"{path}/out")).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return rollup.red(spark.read.parquet(f"{path}/out/red_1m"))


_FORCED = f"""{TREES_SQL}, v AS (SELECT trace_id, max(ts_ns + duration_ns) - min(ts_ns) > 500000000 OR bool_or(status_code = 'error') OR bool_or(span_name = 'line-6') AS kept,
  CAST('0x' || substr(md5('sampling-decision:' || trace_id), 1, 8) AS BIGINT) / 4294967296.0 < 0.05 AS chosen FROM tree GROUP BY trace_id)"""


@query(f"""WITH {_FORCED} SELECT trace_id, span_id, parent_span_id, ts_ns, service_name, duration_ns, status_code, CASE WHEN kept THEN 1.0 ELSE 20.0 END::DOUBLE AS sampling_weight,
  CASE WHEN span_name = 'line-6' THEN 'true' ELSE 'false' END AS forced, span_name AS event_name FROM tree JOIN v USING (trace_id) WHERE kept OR chosen""")
def stream_assemble(spark, sf_dir):
    """Whole spans of the traces that the shipped chain without its rate limit keeps, assembled from a stream; a sixth line forces its trace."""
    path = new_folder(spark, "stream")
    forced = F.when(F.col("span_name") == "line-6", "true").otherwise("false")
    event = F.struct("ts_ns", F.col("span_name").alias("name"), F.create_map(F.lit("k"), F.col("service_name")).alias("attributes"))
    # spans of a trace come in one file, so a micro-batch of 64 MB has whole traces and the state is never that of all input
    trees = fixtures.trees(spark, sf_dir).repartition("trace_id").sortWithinPartitions("trace_id")
    spans = trees.withColumns({"span_attributes": F.create_map(F.lit("debug.force_sample"), forced), "events": F.array(event)})
    spans.write.parquet(f"{path}/in")
    free_shuffles(spark)
    read = assemble.source(spark, "parquet", spans.schema, path=f"{path}/in", maxBytesPerTrigger=64 << 20)
    out = assemble.assemble(read, tuple(p for p in sampling.SHIPPED if p.kind != "rate_limit"), wait_ms=1000, keep_ms=1000, early=False)
    write = assemble.write_once(f"{path}/out", "spans")

    def sink(batch: DataFrame, batch_id: int) -> None:
        write(batch, batch_id)
        free_shuffles(spark)

    q = out.writeStream.foreachBatch(sink).option("checkpointLocation", f"{path}/state").start()
    try:
        assemble.until_empty(q)
    finally:
        q.stop()
    back = spark.read.schema(out.schema).parquet(f"{path}/out/spans")
    return back.select("trace_id", "span_id", "parent_span_id", "ts_ns", "service_name", "duration_ns", "status_code", "sampling_weight", F.col("span_attributes")["debug.force_sample"].alias("forced"), F.col("events")[0]["name"].alias("event_name"))
