from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from lumenspan.engine import Engine, TooManyRows
from lumenspan.operators import rollup, sampling, storage, tree
from lumenspan.sources import config, fixtures, generators
from lumenspan.streaming import assemble, flush, keys, templates

NOW = datetime(2024, 1, 8, tzinfo=timezone.utc)


def test_engine(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    storage.write(generators.traces(spark, 200), f"{root}/spans", "spans")
    e = Engine(spark, root, now=datetime(2024, 1, 1, 0, 10, tzinfo=timezone.utc))
    total = e.query("{} | count").first()["count"]
    assert total == generators.traces(spark, 200).count()
    assert e.query("{} | count", timeout_s=60).first()["count"] == total
    one = e.query("{} | limit 1").first().trace_id
    assert e.query(f'trace("{one}")').count() == e.trace(one).count() > 0
    assert e.trace_tree(one).first().depth == 0
    assert "Scan spans" in e.explain('{service="gateway"}')["optimized"] and "PartitionFilters: [isnotnull(dt" in e.explain("{}")["catalyst"]
    g = e.service_graph("1h")
    assert g["edges"].count() > 0 and abs(g["nodes"].agg(F.sum("criticality")).first()[0] - 1) < 1e-9
    assert {r.service_name for r in e.services().collect()} == set(generators.SERVICES)
    assert e.red("1m").count() > 0 and e.health().count() == 1
    with pytest.raises(TooManyRows):
        Engine(spark, root, now=datetime(2024, 1, 1, 0, 10, tzinfo=timezone.utc), max_rows=1).query("{}")
    with pytest.raises(ValueError):
        e.red("7m")


def test_stored_rollups_answer_like_spans(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    spans = generators.traces(spark, 150)
    storage.write(spans, f"{root}/spans", "spans")
    storage.write(spans.limit(100), f"{root}/spans", "spans")  # some are delivered again
    e = Engine(spark, root, now=datetime(2024, 1, 1, 0, 10, tzinfo=timezone.utc))
    ask = lambda: [sorted(map(tuple, x.collect())) for x in (e.red("1m"), e.red("5m"), e.red("1h"), e.services(), e.service_graph("1h")["edges"])]
    before = ask()
    assert before[0] == sorted(map(tuple, rollup.red(rollup.red_states(spans)).collect()))
    e.roll_up()
    files = lambda df: "".join(df.inputFiles())
    assert "/red_5m/dt=2024" in files(e.red("5m")) and "/service_edges/dt=2024" in files(e.service_graph("1h")["edges"])
    assert ask()[0] == before[0] and [len(x) for x in ask()] == [len(x) for x in before] and ask()[3:] == before[3:]
    first = e.red("1h").collect()
    e.roll_up("2024-01-01")
    assert e.red("1h").collect() == first


def test_policies_see_only_what_is_undecided(spark):
    """Ten failed traces in the same second use up no tokens of the two that a rate limit gives to the others."""
    rows = [(f"{i:032x}", f"{i:016x}", "0" * 16, "svc", 1_000_000 * i, 5, "error" if i < 10 else "ok", 1.0) for i in range(14)]
    spans = spark.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string, service_name string, ts_ns long, duration_ns long, status_code string, sampling_weight double")
    spans = spans.withColumns({"span_attributes": F.create_map(F.lit("a"), F.lit("b")), "resource_attributes": F.create_map(F.lit("a"), F.lit("b"))})
    chain = (sampling.Policy("errors"), sampling.Policy("rate_limit", per_second=2.0), sampling.Policy("probabilistic", rate=1.0))
    out = {r.trace_id: (r.policy, r.sampled) for r in sampling.decide(spans, chain).collect()}
    assert [out[f"{i:032x}"] for i in range(14)] == [("errors", True)] * 10 + [("probabilistic", True)] * 2 + [("rate_limit", False)] * 2


def test_engine_logs(spark, small):
    e = Engine(spark, tables={"logs": fixtures.logs(spark, small)}, now=datetime(2024, 1, 31, tzinfo=timezone.utc))
    top = e.log_templates("720h")
    assert top.count() == 5
    first = top.first()
    assert e.log_instances(first.template_id, "720h").count() == min(100, first.occurrences)


def test_stream_decides_like_batch(spark, tmp_path):
    spans = generators.traces(spark, 60).drop("span_kind", "sampling_weight")
    spans.write.parquet(f"{tmp_path}/in")
    chain = (sampling.Policy("errors"), sampling.Policy("probabilistic", rate=0.5))
    read = assemble.source(spark, "parquet", spans.schema, path=f"{tmp_path}/in")
    out = assemble.assemble(read, chain, wait_ms=3000, early=False)
    q = out.writeStream.foreachBatch(assemble.write_once(f"{tmp_path}/out", "spans")).option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="1 second").start()
    want = sampling.sampled(spans, sampling.decide(spans, chain))
    total = want.count()
    import time

    for _ in range(120):
        time.sleep(1)
        try:
            if spark.read.parquet(f"{tmp_path}/out/spans").count() >= total:
                break
        except Exception:
            continue
    q.stop()
    got = spark.read.parquet(f"{tmp_path}/out/spans")
    columns = ["trace_id", "span_id", "sampling_weight"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))


def test_stream_carries_whole_spans_and_applies_attributes(spark, tmp_path):
    mark = F.when(F.col("span_name") == "charge", "yes").otherwise("no")
    spans = generators.traces(spark, 60).withColumns({
        "span_attributes": F.create_map(F.lit("force"), mark), "resource_attributes": F.create_map(F.lit("host"), F.lit("a"), F.lit("none"), F.lit(None).cast("string")),
        "status_message": F.lit("m"), "events": F.array(F.struct("ts_ns", F.lit("e").alias("name"), F.create_map(F.lit("a"), F.lit("b")).alias("attributes"))),
        "links": F.array(F.struct("trace_id", "span_id", F.create_map(F.lit("a"), F.lit("b")).alias("attributes"))),
    })
    spans.write.parquet(f"{tmp_path}/in")
    P = sampling.Policy
    chain = (P("errors"), P("attribute", key="other", value="yes"), P("attribute", key="force", value="yes"), P("probabilistic", rate=0.2))
    read = assemble.source(spark, "parquet", spans.schema, path=f"{tmp_path}/in")
    out = assemble.assemble(read, chain, wait_ms=1000, keep_ms=1000, early=False)
    q = out.writeStream.foreachBatch(assemble.write_once(f"{tmp_path}/out", "spans")).option("checkpointLocation", f"{tmp_path}/state").start()
    assemble.until_empty(q)
    q.stop()
    decided = sampling.decide(spans, chain)
    assert "attribute" in {r.policy for r in decided.collect()}
    want = sampling.sampled(spans, decided)
    assert set(want.columns) | {"late"} == set(out.columns)
    got = spark.read.schema(out.schema).parquet(f"{tmp_path}/out/spans").select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    for kind in ("rate_limit", "rolling_p99", "other"):
        with pytest.raises(ValueError, match=kind):
            assemble.assemble(spans, (P(kind),))


def test_rollup_stream_equals_batch(spark, tmp_path):
    spans = generators.spans(spark, 400)
    spans.repartition(4).write.parquet(f"{tmp_path}/in")
    read = assemble.source(spark, "parquet", spans.schema, path=f"{tmp_path}/in", maxFilesPerTrigger=1)
    q = read.writeStream.foreachBatch(assemble.rollup_sink(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination(120)
    states = spark.read.parquet(f"{tmp_path}/out/red_1m")
    key = lambda df: sorted(map(str, rollup.red(df).collect()))
    assert key(states) == key(rollup.red_states(spans))


def test_early_close_and_keys(spark):
    root = (0, "a", "0" * 16, "s", "o", 100, "ok")
    assert assemble.closed([root, (5, "b", "a", "s", "o", 10, "ok")])
    assert not assemble.closed([root, (5, "b", "x", "s", "o", 10, "ok")]) and not assemble.closed([root, (95, "b", "a", "s", "o", 10, "ok")])
    one = generators.traces(spark, 1)
    assert assemble.keyed_for_stream(one).count() == one.count()
    with pytest.raises(Exception, match="no trace id"):
        assemble.keyed_for_stream(one.withColumn("trace_id", F.lit(None).cast("string"))).collect()
    sent, failed = [], []
    sink = assemble.notify(lambda r: sent.append(r) if r["i"] else failed.append(r) or 1 / 0)
    assert len(sink(spark.createDataFrame([(0,), (1,)], "i long"), 0)) == 1 and len(sent) == 1


def test_templates_widen_over_batches(spark, tmp_path):
    lines = [(i, f"user u{'abc'[i % 3]} came in at gate {'xyz'[i // 3 % 3]}") for i in range(9)] + [(20, "disk full"), (21, None)]
    for i in range(2):
        spark.createDataFrame(lines[i::2], "ts_ns long, body string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    read = assemble.source(spark, "parquet", spark.read.parquet(f"{tmp_path}/in").schema, path=f"{tmp_path}/in", maxFilesPerTrigger=1)
    q = templates.templates(read).writeStream.foreachBatch(assemble.write_once(f"{tmp_path}/out", "t")).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination(120)
    out = spark.read.parquet(f"{tmp_path}/out/t")
    assert out.count() == len(lines)
    last = {r.leaf.split("\x1f")[0]: r.template_text for r in out.orderBy("ts_ns").collect()}
    assert last["2"] == "disk full" and last["1"] == ""
    assert out.where("changed").count() < len(lines)


def test_keys(spark):
    rows = spark.createDataFrame([("0" * 32, "a"), ("f" * 32, "b"), (None, "c")], "t string, s string")
    assert [r[0] for r in rows.select(keys.log_key(F.col("t"), F.col("s"))).collect()] == ["a", "f" * 32, "c"]
    assert rows.select(keys.metric_key(F.col("s"), F.lit("m"))).distinct().count() == 3 and rows.select(keys.span_key(F.col("t"))).count() == 3


def test_flush_writes_tables_in_order(spark, tmp_path):
    """One micro-batch becomes several tables; run again, it overwrites its part; a failing write is tried again."""
    spans = generators.traces(spark, 20)
    spans.write.parquet(f"{tmp_path}/in")
    written, fails = [], [1]

    def edges(batch):
        written.append("edges")
        if fails.pop() if fails else False:
            raise OSError("the store is away")
        return tree.service_edges(batch)

    def whole(batch):
        written.append("spans")
        return batch

    read = assemble.source(spark, "parquet", spans.schema, path=f"{tmp_path}/in")
    sink = flush.flush(f"file://{tmp_path}/out", {"service_edges_raw": edges, "spans": whole})
    q = read.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    assert written == ["spans", "edges", "edges"]
    sink(spans, 0)
    assert spark.read.parquet(f"{tmp_path}/out/spans").count() == spans.count() and spark.read.parquet(f"{tmp_path}/out/service_edges_raw").count() == tree.service_edges(spans).count()
    figures = flush.health(q.lastProgress)
    assert figures["state_rows"] == 0 and figures["lag"] == 0 and set(figures) == set(flush.health(None))
    with pytest.raises(ValueError):
        flush.flush("x", {"orders": whole})


def test_stream_follows_a_policy_file(spark, tmp_path):
    """The chain of the file decides: here one that keeps nothing but what a span's attribute forces."""
    spans = generators.traces(spark, 30).drop("sampling_weight")
    forced = spans.withColumn("span_attributes", F.create_map(F.lit("keep"), (F.col("span_name") == spans.first().span_name).cast("string")))
    forced.write.parquet(f"{tmp_path}/in")
    (tmp_path / "chain.yaml").write_text("policies: [{type: attribute_match, key: keep, value: 'true'}, {type: probabilistic, rate: 0.0}]")
    file = config.PolicyFile((tmp_path / "chain.yaml").as_uri(), every_s=0)
    read = assemble.source(spark, "parquet", forced.schema, path=f"{tmp_path}/in", maxFilesPerTrigger=1000)
    out = assemble.assemble(read, file, wait_ms=1000, keep_ms=1000, early=False)
    q = out.writeStream.foreachBatch(assemble.write_once(f"{tmp_path}/out", "spans")).option("checkpointLocation", f"{tmp_path}/state").start()
    try:
        assemble.until_empty(q)
    finally:
        q.stop()
    want = forced.join(forced.where(F.col("span_attributes")["keep"] == "true").select("trace_id").distinct(), "trace_id").count()
    assert 0 < spark.read.schema(out.schema).parquet(f"{tmp_path}/out/spans").count() == want
    with pytest.raises(ValueError):
        (tmp_path / "chain.yaml").write_text("policies: [{type: rate_limiting, rate_per_second: 5}]")
        assemble.assemble(read, config.PolicyFile((tmp_path / "chain.yaml").as_uri()))


def test_stream_waits_over_batches_and_for_late_spans(spark, tmp_path):
    """Spans of a trace that come in two micro-batches are decided together; later ones get the same verdict. The errors say when that was: without them nothing is kept."""
    import time

    kinds = "trace_id string, span_id string, parent_span_id string, service_name string, span_name string, ts_ns long, duration_ns long, status_code string"
    span = lambda trace, i, status="ok", ts=1: (trace, f"{i:016x}", "9" * 16, "s", "o", ts, 5, status)
    add = lambda *rows: spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    add(span("a", 1), span("b", 1), span("c", 1), span(None, 1, "error"))
    add(span("a", 2, "error"), span("a", 1), span("c", 2, "error", None), span("c", 2, "error", None))
    read = assemble.source(spark, "parquet", spark.read.parquet(f"{tmp_path}/in").schema, path=f"{tmp_path}/in", maxFilesPerTrigger=1)
    out = assemble.assemble(read, (sampling.Policy("errors"), sampling.Policy("slow", threshold_ns=10), sampling.Policy("probabilistic", rate=0.0)), wait_ms=10_000, keep_ms=300_000)
    q = out.writeStream.foreachBatch(assemble.write_once(f"{tmp_path}/out", "spans")).option("checkpointLocation", f"{tmp_path}/state").start()

    def got(rows):
        end = time.time() + 60
        while time.time() < end and q.isActive:
            try:
                found = spark.read.schema(out.schema).parquet(f"{tmp_path}/out/spans").select("trace_id", "span_id", "late", "sampling_weight").collect()
            except Exception:
                found = []
            if len(found) >= rows:
                break
            time.sleep(0.5)
        return sorted((r[0] or "", int(r[1], 16), *r[2:]) for r in found)

    try:
        first = [("", 1, False, 1.0), ("a", 1, False, 1.0), ("a", 2, False, 1.0), ("c", 1, False, 1.0), ("c", 2, False, 1.0)]
        assert got(5) == first
        add(span("b", 2, "error"), span("a", 3))
        assert got(6) == sorted([*first, ("a", 3, True, 1.0)])
    finally:
        q.stop()


def test_stream_closes_early(spark, tmp_path):
    """With root and children inside of it a trace is decided at once, long before its wait is over; one whose parent is missing is not."""
    spans = spark.range(40).selectExpr(
        "CAST(id DIV 2 AS STRING) AS trace_id", "CAST(id % 2 + 1 AS STRING) AS span_id", "CASE WHEN id % 2 = 0 THEN '0000' WHEN id < 20 THEN '1' ELSE '7' END AS parent_span_id",
        "'s' AS service_name", "'o' AS span_name", "id % 2 AS ts_ns", "10 - id % 2 AS duration_ns", "'ok' AS status_code",
    )
    spans.coalesce(1).write.parquet(f"{tmp_path}/in")
    read = assemble.source(spark, "parquet", spans.schema, path=f"{tmp_path}/in")
    out = assemble.assemble(read, (sampling.Policy("probabilistic", rate=1.0),), wait_ms=600_000, buckets=3)
    q = out.writeStream.foreachBatch(assemble.write_once(f"{tmp_path}/out", "spans")).option("checkpointLocation", f"{tmp_path}/state").start()
    try:
        while q.isActive and not (q.lastProgress and q.lastProgress["batchId"] > 1):  # the first micro-batch has read all
            q.awaitTermination(1)
    finally:
        q.stop()
    back = spark.read.schema(out.schema).parquet(f"{tmp_path}/out/spans")
    assert sorted((int(r.trace_id), r.span_id) for r in back.collect()) == [(t, s) for t in range(10) for s in "12"]


def test_stream_state_goes_by_buckets(spark, tmp_path):
    """A call of Python, and a row of state, is for many traces: with one for each of 150,000 traces the stream took minutes."""
    spans = spark.range(12_000).selectExpr(
        "md5(CAST(id DIV 2 AS STRING)) AS trace_id", "CAST(id AS STRING) AS span_id", "'x' AS parent_span_id", "'s' AS service_name", "'o' AS span_name", "id AS ts_ns", "id AS duration_ns",
        "CASE WHEN id % 10 = 0 THEN 'error' ELSE 'ok' END AS status_code", "map('a', 'b') AS span_attributes", "map('a', 'b') AS resource_attributes", "1.0D AS sampling_weight",
    )
    spans.write.parquet(f"{tmp_path}/in")
    chain = (sampling.Policy("errors"), sampling.Policy("slow", threshold_ns=11_000), sampling.Policy("probabilistic", rate=0.3))
    read = assemble.source(spark, "parquet", spans.schema, path=f"{tmp_path}/in")
    out = assemble.assemble(read, chain, wait_ms=1000, keep_ms=1000)
    q = out.writeStream.foreachBatch(assemble.write_once(f"{tmp_path}/out", "spans")).option("checkpointLocation", f"{tmp_path}/state").start()
    try:
        assemble.until_empty(q)
    finally:
        q.stop()
    assert 0 < max(s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]) <= 1024
    want = sampling.sampled(spans, sampling.decide(spans, chain))
    got = spark.read.schema(out.schema).parquet(f"{tmp_path}/out/spans").select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_stream_is_not_empty_before_all_files_are_read(spark, tmp_path):
    """A micro-batch of an empty file leaves no state, and yet the next file is waited for."""
    spans = generators.traces(spark, 5)
    for part in (spans.limit(0), spans):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    read = assemble.source(spark, "parquet", spans.schema, path=f"{tmp_path}/in", maxFilesPerTrigger=1)
    out = assemble.assemble(read, (sampling.Policy("probabilistic", rate=1.0),), wait_ms=1000, keep_ms=1000)
    q = out.writeStream.foreachBatch(assemble.write_once(f"{tmp_path}/out", "spans")).option("checkpointLocation", f"{tmp_path}/state").start()
    try:
        assemble.until_empty(q)
    finally:
        q.stop()
    assert spark.read.schema(out.schema).parquet(f"{tmp_path}/out/spans").count() == spans.count()
