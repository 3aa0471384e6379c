import os
import struct
import time

import pytest
from pyspark.sql import functions as F

from lumenspan import cold
from lumenspan.functions import hashing
from lumenspan.operators import alerts, anomaly, cardinality, graph, logs, rollup, sampling, storage, tree
from lumenspan.operators.logs import Leaf
from lumenspan.operators.weighted import quantiles
from lumenspan.plans import logical
from lumenspan.schema import NO_SPAN
from lumenspan.sources import config, generators, otlp, protobuf


def span(n, parent, service, start, duration, status="ok", trace="t"):
    return (start, trace, f"{n:016d}", f"{parent:016d}" if parent else NO_SPAN, service, f"op{n}", duration, status, 20.0, {}, {})


NAMES = "ts_ns long, trace_id string, span_id string, parent_span_id string, service_name string, span_name string, duration_ns long, status_code string, sampling_weight double, span_attributes map<string,string>, resource_attributes map<string,string>"


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), NAMES)


def test_weighted_count(spark):
    a = (10, "t", "a" * 16, NO_SPAN, "checkout", "charge", 600_000_000, "error", 1.0, {"http.route": "/pay"}, {})
    b = (11, "t", "b" * 16, NO_SPAN, "checkout", "refund", 700_000_000, "ok", 20.0, {}, {})
    c = (12, "t", "c" * 16, NO_SPAN, "checkout", "refund", 100_000_000, "ok", 20.0, {}, {})
    from datetime import datetime, timezone

    out = logical.run('{service="checkout"} | duration > 500ms | count by (operation)', frame(spark, a, b, c), datetime(1970, 1, 1, 0, 30, tzinfo=timezone.utc))
    assert {r["operation"]: r["count"] for r in out.collect()} == {"charge": 1.0, "refund": 20.0}


def test_edges_orphans_and_red(spark):
    spans = frame(spark, span(1, 0, "gateway", 0, 100), span(2, 1, "checkout", 1, 50), span(3, 2, "checkout", 2, 40), span(4, 3, "inventory", 3, 20, "error"), span(5, 99, "lost", 5, 1))
    edges = tree.service_edges(spans)
    assert sorted((r.caller_service, r.callee_service, r.is_error) for r in edges.collect()) == [("checkout", "inventory", 1), ("gateway", "checkout", 0)]
    assert [r.span_id for r in tree.orphans(spans).collect()] == [f"{5:016d}"]
    made = {(r.caller_service, r.callee_service): r for r in graph.graph(graph.edge_states(edges.union(edges))).collect()}
    assert made["checkout", "inventory"].calls == 40 and made["checkout", "inventory"].error_rate == 1
    red = rollup.red(rollup.red_states(frame(spark, span(1, 0, "a", 0, 600_000_000, "error"), span(2, 0, "a", 0, 100_000_000)).withColumn("sampling_weight", F.when(F.col("status_code") == "error", 1.0).otherwise(20.0)).withColumn("span_name", F.lit("x")))).first()
    assert (red.calls, red.errors) == (21.0, 1.0)


def test_tree(spark):
    spans = frame(spark, span(1, 0, "a", 0, 100), span(2, 1, "b", 10, 50), span(3, 1, "c", 10, 80), span(4, 2, "d", 20, 5), span(5, 77, "x", 30, 1), span(6, 3, "e", 15, 10))
    out = {r.span_id[-1]: r for r in tree.assembled(spans).collect()}
    assert [k for k, r in sorted(out.items()) if r.critical] == ["1", "3", "6"]
    assert out["4"].depth == 2 and out["5"].orphan and out["5"].depth == 0 and out["4"].path == "a/op1;b/op2;d/op4"
    assert [r.span_id[-1] for r in sorted(out.values(), key=lambda r: r.place)] == ["1", "2", "4", "3", "6", "5"]
    assert tree.summaries(spans).first().duration_ns == 100
    assert tree.assembled(frame(spark).limit(0)).count() == 0
    twice = spans.union(spans)
    assert tree.distinct_spans(twice).count() == 6


def test_graph_walks():
    assert graph.cyclic_services([("gateway", "checkout"), ("checkout", "inventory"), ("inventory", "checkout")]) == {"checkout", "inventory"}
    assert graph.walk_cycles([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")]) == [["a", "b", "c", "a"]]
    assert graph.walk_cycles([("a", "b"), ("a", "c"), ("b", "c")]) == []
    assert graph.walk_cuts([("checkout", "a"), ("checkout", "b"), ("gateway", "checkout")]) == {"checkout"}
    assert graph.walk_cuts([("a", "b"), ("b", "c"), ("c", "a")]) == set()
    assert graph.walk_cuts([("root", "x"), ("root", "y")]) == {"root"}


def test_templates(spark):
    shapes = ["user {0} logged in from 10.0.0.{0}", "order {0} shipped to warehouse {0}", "payment declined for account {0} code {0}", "cache miss for key session-{0}", "health check ok"]
    lines = [(i, s.format(i)) for i, s in enumerate(s for s in shapes for _ in range(50))]
    parsed = logs.with_templates(spark.createDataFrame(lines, "ts_ns long, body string"))
    texts = {r.template_text for r in logs.dictionary(parsed).collect()}
    assert texts == {"user <*> logged in from <*>", "order <*> shipped to warehouse <*>", "payment declined for account <*> code <*>", "cache miss for key <*>", "health check ok"}
    assert logs.with_templates(spark.createDataFrame([(1, ""), (2, None), (3, "x")], "ts_ns long, body string")).count() == 3
    leaf = Leaf(most=2)
    for t in ("a b", "c d", "e f", "a b"):
        leaf.add(t.split())
    assert leaf.made == 4 and len(leaf.clusters) == 2
    wide = [(i, f"w{'x' * (i % 7)}{chr(97 + i % 26)}{chr(97 + i // 26)} same tail here") for i in range(300)]
    capped = logs.with_templates(spark.createDataFrame(wide, "ts_ns long, body string"), children=5)
    assert capped.count() == 300
    versions = spark.createDataFrame([(1, "old", 1, 1), (1, "new", 5, 9)], "template_id long, template_text string, first_seen long, updated_at long")
    assert tuple(logs.latest_templates(versions).first()) == (1, "new", 1, 9)


def test_sampling_estimates_the_population(spark):
    n = 20_000
    t = spark.range(n).select(F.lit(0).cast("long").alias("ts_ns"), F.md5(F.col("id").cast("string")).alias("trace_id"), F.lit("s").alias("span_id"), F.lit("svc").alias("service_name"), F.lit(5).cast("long").alias("duration_ns"), F.when(F.col("id") % 100 == 0, "error").otherwise("ok").alias("status_code"), F.lit(1.0).alias("sampling_weight"))
    chain = (sampling.Policy("errors"), sampling.Policy("probabilistic", rate=0.05))
    kept = sampling.sampled(t, sampling.decide(t, chain))
    assert kept.where("status_code = 'error'").count() == 200
    assert abs(kept.agg(F.sum("sampling_weight")).first()[0] - n) < 0.05 * n * 2
    assert sampling.decide(t, ()).where("sampled").count() == 0
    assert sampling.decide(t, (sampling.Policy("probabilistic", rate=1.0),)).where("weight = 1").count() == n
    assert sampling.decide(t, (sampling.Policy("probabilistic", rate=0.0),)).where("sampled").count() == 0
    busy = sampling.within_rate(sampling.views(t), 50)
    assert busy.where("allowed").count() == 50


def test_cardinality(spark):
    values = spark.range(20_000).select(F.create_map(F.lit("user.id"), F.concat(F.lit("value-"), F.col("id").cast("string"))).alias("span_attributes"))
    assert abs(cardinality.estimates(values).first().distinct_values - 20_000) < 1_000
    out = cardinality.guarded(values, {"user.id": cardinality.Budget(100, "bucket", 8)})
    assert out.select(F.col("span_attributes")["user.id"].alias("v")).distinct().count() == 8
    out = cardinality.guarded(values, {"user.id": cardinality.Budget(100, "keep_and_alert")})
    assert out.where(F.size("alerts") == 1).count() == 20_000
    assert cardinality.guarded(values, {"user.id": cardinality.Budget(100_000, "drop")}).where(F.size("span_attributes") == 1).count() == 20_000


def test_detector(spark):
    week = 7 * 86_400 * 10**9
    series = [("s", i * week, f"{i:03d}", float(v)) for i, v in enumerate([100, 101, 99, 100, 102, 98, 100, 100, 1000, 1000, 100, 100])]
    out = anomaly.firing(anomaly.scores(spark.createDataFrame(series, "series string, ts_ns long, tick_id string, value double"))).orderBy("ts_ns").collect()
    assert [r.ready for r in out] == [False] * 8 + [True] * 4
    assert [r.firing for r in out[8:]] == [False, True, True, False]
    assert [r.state_changed for r in out[8:]] == [False, True, False, True]


def test_alerts(spark):
    ticks = spark.createDataFrame([("r", i * 10**9, float(v)) for i, v in enumerate([0, 5, 5, 0, 5])], "rule string, ts_ns long, value double")
    changes = anomaly.transitions(ticks, ">", 1)
    assert [r.ts_ns // 10**9 for r in changes.orderBy("ts_ns").collect()] == [1, 3, 4]
    assert [r.ts_ns // 10**9 for r in anomaly.notifications(changes, 3).orderBy("ts_ns").collect()] == [1, 4]


def test_quantiles_merge(spark):
    bins = spark.createDataFrame([("k", 1, 5), ("k", 2, 4), ("k", 2, 1), ("k", 9, 1)], "key string, bin long, w long")
    assert tuple(quantiles(bins, ["key"], {"half": 0.5, "most": 0.99}).first()) == ("k", 2, 9)


def test_hashes(spark):
    assert hashing.fnv1a(b"") == 14695981039346656037 and hashing.fnv1a(b"a") == 0xAF63DC4C8601EC8C
    assert hashing.splitmix64(0) == 0
    frame_ = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "v string")
    got = [r[0] for r in frame_.select(hashing.fnv1a_of(F.col("v"))).collect()]
    assert got[0] == got[2] == hashing.signed(hashing.fnv1a(b"a")) and got[3] == hashing.signed(hashing.fnv1a(b""))
    keys = spark.range(2000).select(F.col("id").cast("string").alias("k"))
    four, five = ([f"r{i}" for i in range(n)] for n in (4, 5))
    moved = keys.where(hashing.owner(F.col("k"), four) != hashing.owner(F.col("k"), five)).count()
    assert 0.1 < moved / 2000 < 0.3


def test_decode(spark):
    request = """{"resourceSpans":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"api"}}]},"scopeSpans":[{"spans":[
      {"traceId":"4BF92F3577B34DA6A3CE929D0E0E4736","spanId":"00F067AA0BA902B7","name":"GET","kind":2,"startTimeUnixNano":"1000","endTimeUnixNano":"900","status":{"code":2},
       "attributes":[{"key":"n","value":{"intValue":"5"}},{"key":"l","value":{"arrayValue":{"values":[{"intValue":"1"},{"stringValue":"b"}]}}},{"key":"m","value":{"kvlistValue":{"values":[{"key":"x","value":{"boolValue":true}}]}}}]}]}]}]}"""
    s = otlp.spans(spark.createDataFrame([(request,), ("not json",)], "value string")).first()
    assert (s.trace_id, s.span_kind, s.status_code, s.duration_ns, s.service_name, s.parent_span_id) == ("4bf92f3577b34da6a3ce929d0e0e4736", "server", "error", 0, "api", NO_SPAN)
    assert s.span_attributes == {"n": "5", "l": "[1,b]", "m": "{x=true}"}
    log = """{"resourceLogs":[{"resource":{},"scopeLogs":[{"logRecords":[{"observedTimeUnixNano":"77","severityNumber":9,"body":{"stringValue":"hi"}}]}]}]}"""
    r = otlp.logs(spark.createDataFrame([(log,)], "value string")).first()
    assert (r.ts_ns, r.body, r.severity_number, r.trace_id) == (77, "hi", 9, "0" * 32)
    metric = """{"resourceMetrics":[{"resource":{},"scopeMetrics":[{"metrics":[{"name":"h","histogram":{"dataPoints":[{"timeUnixNano":"1","count":"4","sum":2.5}]}},{"name":"g","gauge":{"dataPoints":[{"timeUnixNano":"1","asInt":"3"}]}}]}]}]}"""
    got = {(m.metric_name, m.value) for m in otlp.metrics(spark.createDataFrame([(metric,)], "value string")).collect()}
    assert got == {("h_count", 4.0), ("h_sum", 2.5), ("g", 3.0)}


def test_config():
    chain = config.policies("policies:\n- {type: always_sample_errors}\n- {type: always_sample_slow, mode: threshold, threshold: 500ms}\n- {type: probabilistic, rate: 0.05}\n")
    assert [p.kind for p in chain] == ["errors", "slow", "probabilistic"] and chain[1].threshold_ns == 500_000_000
    default, own = config.budgets("default: {budget: 5, action: drop}\noverrides:\n  user.id: {budget: 7}\n")
    assert default.action == "drop" and own["user.id"].most == 7
    assert config.rules("rules:\n- {name: a, service: s, metric: m, type: threshold, op: '>', threshold: 2, webhook: x, cooldown: 5m}\n")[0].cooldown_s == 300
    for bad in ("policies:\n- {type: nothing}", "policies:\n- {type: probabilistic, rate: 2}"):
        with pytest.raises(ValueError):
            config.policies(bad)
    for bad in ("rules:\n- {name: a}", "rules:\n- {name: a, service: s, metric: m, type: x, webhook: y}", "rules:\n- {name: a, service: s, metric: m, type: threshold, op: '~', webhook: y}"):
        with pytest.raises(ValueError):
            config.rules(bad)


def test_cold_tier(spark, tmp_path):
    spans = generators.spans(spark, 500, days=3).withColumns({"status_message": F.lit("")})
    hot, cold = f"file://{tmp_path}/hot", f"file://{tmp_path}/cold"
    storage.write(spans.union(spans), f"{hot}/spans", "spans")
    tier = storage.ColdTier(spark, hot, cold)
    day = tier.candidates("spans", 1 << 62).first().dt
    count = lambda: storage.read(spark, f"{hot}/spans", "spans").where(F.col("dt") == F.lit(day)).count()
    before = count()
    with pytest.raises(RuntimeError, match="manifest"):
        tier.drop("spans", day)
    m = tier.export("spans", day)
    assert m.rows * 2 == before
    tier.drop("spans", day)
    assert count() == 0
    assert tier.restore("spans", day) == m.rows and count() == m.rows
    back = storage.read(spark, f"{hot}/spans", "spans").where(F.col("dt") == F.lit(day)).first()
    assert back.span_attributes == {"http.route": "/"}
    assert storage.estimated_rows(spark, f"{hot}/spans") > 0 and storage.readable(2048) == "2.00 KiB"


def test_generated_traces(spark):
    t = generators.traces(spark, 50)
    assert t.where(F.col("parent_span_id") == NO_SPAN).count() == 50 and tree.orphans(t).count() == 0
    assert t.exceptAll(generators.traces(spark, 50)).count() == 0


def test_alerts_are_sent_to_each_place():
    rule = config.Rule("hot", "api", "latency", "threshold", op=">", threshold=2.0, cooldown_s=60, webhook="w", slack_webhook="s")
    values = iter([(1.0, 0), (3.0, 10**9), (1.0, 2 * 10**9), (4.0, 100 * 10**9), (1.5, 300 * 10**9)])
    sent = []

    def to(url, body):
        sent.append((url, body))
        if url == "w":
            raise OSError("down")

    e = alerts.Evaluator([rule], lambda r: next(values), to=to)
    made = [e.tick() for _ in range(5)]
    assert [[n.firing for n in notes] for notes, _ in made] == [[], [True], [], [True], [False]]
    assert [len(errors) for _, errors in made] == [0, 1, 0, 1, 1] and [u for u, _ in sent] == ["w", "s"] * 3
    assert sent[1][1] == {"text": "[FIRING] hot (api/latency): value=3.0000 > 2.0000"}
    assert sent[0][1] == {"Rule": "hot", "Service": "api", "Metric": "latency", "Firing": True, "Message": "value=3.0000 > 2.0000", "Time": "1970-01-01T00:00:01Z"}
    broken = alerts.Evaluator([rule], lambda r: 1 / 0, to=to)
    assert broken.tick()[0] == [] and isinstance(broken.tick()[1][0], ZeroDivisionError)
    assert [alerts.error_band(x) for x in (0.019, 0.02, 0.1)] == ["green", "amber", "red"] and alerts.whole_ms(1_999_999) == 1


def test_retries_wait_longer_and_stop_at_permanent_errors():
    tries, waits = [], []

    def run(error, until):
        tries.append(1)
        if len(tries) < until:
            raise error
        return "done"

    assert alerts.retried(lambda: run(OSError(), 4), sleep=waits.append, draw=lambda: 1.0) == "done" and waits == [0.1, 0.2, 0.4]
    tries.clear()
    with pytest.raises(KeyError):
        alerts.retried(lambda: run(KeyError("x"), 4), permanent=(KeyError,), sleep=waits.append)
    assert len(tries) == 1
    tries.clear()
    with pytest.raises(OSError):
        alerts.retried(lambda: run(OSError(), 9), attempts=3, sleep=lambda s: None)
    assert len(tries) == 3


def test_cold_tier_from_the_command_line(spark, tmp_path):
    hot, cold_ = f"file://{tmp_path}/hot", f"file://{tmp_path}/cold"
    storage.write(generators.traces(spark, 30), f"{hot}/spans", "spans")
    tier = storage.ColdTier(spark, hot, cold_)
    later = 1_735_689_600_000_000_000
    listed = cold.tiered(tier, "spans", "24h", now_ns=later)
    assert len(listed) == 1 and listed[0].startswith("would export spans 2024-01-01: ") and tier.manifest("spans", "2024-01-01") is None
    assert [x.split()[0] for x in cold.tiered(tier, "spans", "24h", export=True, drop=True, now_ns=later)] == ["exported", "dropped"]
    assert tier.restore("spans", "2024-01-01") == generators.traces(spark, 30).count()
    assert cold.tiered(tier, "spans", "99999h", now_ns=later) == ["spans has no day older than 99999h"]
    with pytest.raises(ValueError):
        cold.tiered(tier, "spans", "24h", drop=True)


def _field(number, value):
    """A field of the wire format: whole numbers as varints, floats and (number,) as eight bytes, the rest with its length."""

    def varint(x):
        out = b""
        while x > 127:
            out, x = out + bytes([x & 127 | 128]), x >> 7
        return out + bytes([x])

    if isinstance(value, tuple):
        return varint(number << 3 | 1) + struct.pack("<q", value[0])
    if isinstance(value, float):
        return varint(number << 3 | 1) + struct.pack("<d", value)
    if isinstance(value, int):
        return varint(number << 3) + varint(value % (1 << 64))
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def _pair(key, any_):
    return _field(1, key) + _field(2, any_)


def test_binary_exports(spark):
    resource = _field(1, _field(1, _pair("service.name", _field(1, "ledger"))))
    event = _field(1, (7,)) + _field(2, "retry") + _field(3, _pair("n", _field(3, -2)))
    span = b"".join([_field(1, b"\x01" * 16), _field(2, b"\x02" * 8), _field(5, "transfer"), _field(6, 2), _field(7, (1000,)), _field(8, (4000,)), _field(9, _pair("ok", _field(2, 1))), _field(9, _pair("cost", _field(4, 2.5))),
                     _field(9, _pair("list", _field(5, _field(1, _field(1, "a")) + _field(1, _field(3, 3))))), _field(11, event), _field(15, _field(2, "bad") + _field(3, 2)), _field(99, "unknown")])
    traces = _field(1, resource + _field(2, _field(1, b"") + _field(2, span)))
    log = _field(1, resource + _field(2, _field(2, _field(11, (55,)) + _field(2, 17) + _field(5, _field(1, "it broke")) + _field(6, _pair("raw", _field(7, b"\xff"))))))
    point = _field(3, (9,)) + _field(6, (-4,)) + _field(7, _pair("zone", _field(1, "n")))
    histogram = _field(3, (9,)) + _field(4, (12,)) + _field(5, 6.5)
    metrics = _field(1, resource + _field(2, _field(2, _field(1, "depth") + _field(5, _field(1, point))) + _field(2, _field(1, "size") + _field(9, _field(1, histogram)))))
    rows = spark.createDataFrame([(bytearray(traces),), (bytearray(traces[:-3]),), (None,), (bytearray(b"\x0b"),)], "value binary")
    (s,) = otlp.spans(protobuf.as_json(rows, "TRACES")).collect()
    assert (s.trace_id, s.span_id, s.parent_span_id, s.service_name, s.span_name, s.span_kind, s.ts_ns, s.duration_ns, s.status_code, s.status_message) == ("01" * 16, "02" * 8, "0" * 16, "ledger", "transfer", "server", 1000, 3000, "error", "bad")
    assert s.span_attributes == {"ok": "true", "cost": "2.5", "list": "[a,3]"} and [(e.ts_ns, e.name, e.attributes) for e in s.events] == [(7, "retry", {"n": "-2"})]
    (x,) = otlp.logs(protobuf.as_json(spark.createDataFrame([(bytearray(log),)], "value binary"), "LOGS")).collect()
    assert (x.ts_ns, x.service_name, x.severity_number, x.body, x.log_attributes) == (55, "ledger", 17, "it broke", {"raw": "ff"})
    got = otlp.metrics(protobuf.as_json(spark.createDataFrame([(bytearray(metrics),)], "value binary"), "METRICS")).collect()
    assert sorted((m.metric_name, m.metric_type, m.value, m.ts_ns) for m in got) == [("depth", "gauge", -4.0, 9), ("size_count", "histogram", 12.0, 9), ("size_sum", "histogram", 6.5, 9)]


def test_policy_file_is_read_again(tmp_path):
    at = tmp_path / "chain.yaml"
    at.write_text("policies: [{type: always_sample_errors}]")
    f = config.PolicyFile(at.as_uri(), every_s=0)
    assert [p.kind for p in f.current()] == ["errors"]
    for text, kinds in (("policies: [{type: nonsense}]", ["errors"]), ("policies: [{type: probabilistic, rate: 0.5}]", ["probabilistic"])):
        at.write_text(text)
        os.utime(at, ns=(1, time.time_ns()))
        assert [p.kind for p in f.current()] == kinds and bool(f.error) == (kinds == ["errors"])
    at.unlink()
    assert [p.kind for p in f.current()] == ["probabilistic"] and f.error
    with pytest.raises(ValueError):
        config.PolicyFile(at.as_uri())
