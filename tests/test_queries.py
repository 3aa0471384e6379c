"""Every query with SQL gives DuckDB's result on the same tables."""

import math

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenspan import queries
from lumenspan.plans import logical
from lumenspan.sources import fixtures

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("" if pd.isna(v) else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, small, duck, name):
    got = queries.QUERIES[name](spark, small).toPandas()
    if name in queries.SQL:
        want = duck.sql(queries.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got.columns)


def test_folding_keeps_results(spark, small):
    spans = fixtures.spans(spark, small)
    text = f"{{status=ok, status!=error}} {queries.MONTH} | duration > 2ms | duration > 1ms | k != 7 | k >= 3 | count by (operation)"
    on = logical.run(text, spans, queries.NOW)
    off = logical.run(text, spans, queries.NOW, without=("fold", "prune_columns"))
    assert rows(on.toPandas()) == rows(off.toPandas())


def test_plan_reads_only_its_columns(spark, small):
    out = logical.run(f"{{service=\"svc-1\"}} {queries.MONTH} | count by (operation)", fixtures.spans(spark, small), queries.NOW)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan.split("ReadSchema")[-1] and "event_id" not in plan.split("ReadSchema")[-1]


def test_only_the_days_in_range_are_read(spark, small):
    plan = queries.QUERIES["dsl_partition_prune"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan and "dt#" in plan.split("PartitionFilters: ")[1].split("]")[0]
    off = logical.run('{} range("2024-01-10T06:00:00Z", "2024-01-11T18:00:00Z") | count by (service)', fixtures.spans(spark, small), queries.NOW)
    assert rows(off.toPandas()) == rows(queries.QUERIES["dsl_partition_prune"](spark, small).toPandas())


def test_quantiles_of_attributes_are_merged(spark, small):
    """Two fields in one query, one of them an attribute with fractions and negative values; no group holds its values."""
    spans = fixtures.spans(spark, small).withColumn("span_attributes", F.create_map(F.lit("delta"), ((F.col("duration_ns") % 1000 - 500) / 7).cast("string")))
    text = f"{{}} {queries.MONTH} | count, p50(delta), p99(duration), avg(delta), p95(delta) by (service)"
    plan = logical.run(text, spans, queries.NOW)
    assert "percentile" not in plan._jdf.queryExecution().executedPlan().toString()
    exact = {r.service: r for r in logical.run(text, spans, queries.NOW, exact=True).collect()}
    got = plan.collect()
    raw = spans.where(f"ts_ns >= 1704067200000000000 AND ts_ns < {queries.NOW_NS}").select("service_name", F.col("span_attributes")["delta"].cast("double").alias("delta"), "duration_ns", "sampling_weight").collect()
    assert plan.columns == ["service", "count", "p50_delta", "p99_duration", "avg_delta", "p95_delta"] and len(got) == len(exact)
    for r in got:
        want = exact[r.service]
        assert r["count"] == want["count"] and abs(r.avg_delta - want.avg_delta) < 1e-6
        own = sorted((x.delta, x.duration_ns) for x in raw if x.service_name == r.service for _ in range(int(x.sampling_weight)))
        for name, k, q in (("p50_delta", 0, 0.5), ("p95_delta", 0, 0.95), ("p99_duration", 1, 0.99)):
            value = sorted(x[k] for x in own)[math.ceil(q * len(own)) - 1]
            assert abs(r[name] - value) <= abs(value) / 500, (name, r, value)
    empty = logical.run("{service=nobody} | count, p95(duration)", spans, queries.NOW).collect()
    assert [tuple(r) for r in empty] == [(None, None)]
