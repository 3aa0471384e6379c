"""The query language: random syntax trees are written out and read back, mistakes are found where they were made."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenspan.plans import logical
from lumenspan.plans.language import COMPARISONS, FUNCTIONS, MATCHES, Aggregate, Comparison, Matcher, QueryError, SelectQuery, TraceQuery, duration_ns, parse

NOW = datetime(2031, 5, 17, 8, 30, tzinfo=timezone.utc)
NOW_NS = int(NOW.timestamp()) * 1_000_000_000
FIELDS = ["duration", "service", "kind", "db.rows", "cart_size", "limit", "sort", "count", "since", "by"]
VALUES = ["ledger", "eu-west 2", 'a "quoted" \\ path', "", "ümlaut", "tab\there"]


def quoted(text):
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"').replace("\t", "\\t") + '"'


def random_query(rng):
    """(text, syntax tree) of a random query."""
    gap = lambda: rng.choice([" ", "  ", "\n", " \t"])
    matchers = [Matcher(rng.choice(FIELDS), rng.choice(MATCHES[:2]), rng.choice(VALUES)) for _ in range(rng.randrange(4))]
    text = "{" + ("," + gap()).join(f"{m.name}{gap()}{m.op}{quoted(m.value)}" for m in matchers) + "}"
    start, end = NOW_NS - 3600 * 10**9, NOW_NS
    kind = rng.randrange(3)
    if kind == 1:
        minutes = rng.randrange(1, 500)
        text += f"{gap()}{rng.choice(['since', 'SINCE'])} {minutes}m"
        start = NOW_NS - minutes * 60 * 10**9
    elif kind == 2:
        hours = rng.randrange(2, 90)
        begin = NOW - timedelta(hours=hours)
        text += f'{gap()}range("{begin.isoformat()}", now-{hours - 1}h)'
        start, end = NOW_NS - hours * 3600 * 10**9, NOW_NS - (hours - 1) * 3600 * 10**9
    comparisons, rest = [], {}
    for _ in range(rng.randrange(5)):
        stage = rng.randrange(4)
        text += gap() + "|" + gap()
        if stage == 0:
            unit, ns = rng.choice([("", 1), ("us", 1_000), ("s", 10**9)])
            c = Comparison(rng.choice(["duration", "db.rows", "cart_size"]), rng.choice(COMPARISONS), rng.randrange(-50, 50) * ns)
            text += f"{c.name} {c.op} {c.value // ns}{unit}"
            comparisons.append(c)
        elif stage == 1:
            aggregates = tuple(Aggregate(f, rng.choice(FIELDS)) if f != "count" else Aggregate("count") for f in rng.sample(FUNCTIONS, rng.randrange(1, 4)))
            by = tuple(rng.sample(FIELDS, rng.randrange(3)))
            text += ", ".join(a.function if a.name is None else f"{a.function}({a.name})" for a in aggregates) + (f" by ({', '.join(by)})" if by else "")
            rest |= {"aggregates": aggregates, "by": by}
        elif stage == 2:
            sort = tuple((n, rng.random() < 0.5) for n in rng.sample(FIELDS, 2))
            text += "sort by (" + ", ".join(f"{n} {'desc' if d else 'asc'}" for n, d in sort) + ")"
            rest["sort"] = sort
        else:
            rest["limit"] = rng.randrange(1000)
            text += f"limit {rest['limit']}"
    return text, SelectQuery(start, end, tuple(matchers), tuple(comparisons), **rest)


@pytest.mark.parametrize("seed", range(150))
def test_written_trees_are_read_back(seed):
    text, tree = random_query(random.Random(seed))
    assert parse(text, NOW) == tree, text


@pytest.mark.parametrize("seed", range(60))
def test_a_cut_or_a_stray_sign_is_an_error_or_another_query(seed):
    """No damage is silently ignored: what still parses isn't the same tree."""
    rng = random.Random(seed)
    text, tree = random_query(rng)
    for stray in (";", "}}", "| |", "~"):
        with pytest.raises(QueryError):
            parse(text + stray, NOW)
    with pytest.raises(QueryError):
        parse(text.replace("{", "(", 1), NOW)


def test_traces():
    assert parse('trace("0123456789ABCDEF0123456789abcdef")', NOW) == TraceQuery("0123456789abcdef" * 2)
    for text in ('trace("0123")', "trace(0123)", 'trace("")', f'trace("{"g" * 32}")', f'trace("{"0" * 32}"'):
        with pytest.raises(QueryError):
            parse(text, NOW)


MISTAKES = [
    # (before the mistake, from it on, part of the message)
    ("{region=eu, shard", "}", "label is followed"),
    ("{region=eu, ", "}", "a label after"),
    ("{region=", "}", "label's value"),
    ("{region=", '"eu', "closing quote"),
    ("{region=eu", " zone=b}", "',' or '}'"),
    ("{} | cart_size", " about 4", "field is followed"),
    ("{} | cart_size >", " many", "a number"),
    ("{} | cart_size > ", "4parsecs", "unknown unit"),
    ("{} | count, p95", " by (kind)", "needs a field"),
    ("{} | max(cart_size), ", "median(cart_size)", "unknown function"),
    ("{} | sort by ", "cart_size", "'('"),
    ("{} | limit ", "2.5", "whole number"),
    ("{} since ", "12", "needs units"),
    ("{} since 2h", " 5m", "should end here"),
    ("{} ", "range(now-1m, now-2m)", "begins before it ends"),
    ('{} range("', '2031-13-01T00:00:00Z", now)', "month"),
    ("{} range(", '"yesterday", now)', "RFC 3339"),
    ("{host=~", '"web(?!1)"}', "not supported"),
    ("{host=~", '"web("}', "invalid pattern"),
    ("{kind=server}", " please", "should end here"),
]


@pytest.mark.parametrize(("before", "after", "message"), MISTAKES)
@pytest.mark.parametrize("lines", [0, 2])
def test_mistakes_are_found_where_they_are(before, after, message, lines):
    with pytest.raises(QueryError) as e:
        parse("\n" * lines + before + after, NOW)
    gap = len(after) - len(after.lstrip())
    assert message in e.value.message and e.value.line == 1 + lines
    assert e.value.column in (len(before), len(before) + 1 + gap), e.value
    assert str(e.value) == f"query:{e.value.line}:{e.value.column}: {e.value.message}"


def test_durations():
    assert duration_ns("2h15m") == duration_ns("135m") == 8_100_000_000_000 and duration_ns("0.25ms") == 250_000
    assert [duration_ns(x) for x in ("7", "7d", "m7", "7m5", "")] == [None] * 5
    assert parse('{} range("2031-05-17T08:29:59.000000007+00:00", now)', NOW).start == NOW_NS - 10**9 + 7


@given(st.text(alphabet='{}()|,=!~<>"xy.0789smhd -\\\n', max_size=40))
@settings(max_examples=400, deadline=None)
def test_any_text_parses_or_fails_cleanly(text):
    try:
        parse(text, NOW)
    except QueryError as e:
        assert e.line >= 1 and e.column >= 1


def _holds(terms, x):
    return all({">": x > t.value, ">=": x >= t.value, "<": x < t.value, "<=": x <= t.value, "==": x == t.value, "!=": x != t.value}[t.op] for t in terms if t is not logical.FALSE) and logical.FALSE not in terms


@given(st.lists(st.tuples(st.sampled_from(COMPARISONS), st.integers(0, 6)), max_size=5))
@settings(max_examples=300, deadline=None)
def test_folded_bounds_hold_for_the_same_numbers(bounds):
    plan = logical.build(SelectQuery(0, 1, comparisons=tuple(Comparison("cart_size", op, v) for op, v in bounds)))
    folded = logical.fold(plan)
    assert len(folded.terms) <= len(plan.terms) or folded.terms == (logical.FALSE,)
    for x in range(-1, 8):
        assert _holds(folded.terms, x) == _holds(plan.terms, x)


def test_folded_labels():
    fold = lambda text: [str(t) for t in logical.fold(logical.build(parse(text, NOW))).terms]
    assert fold("{zone=n, zone!=s, zone=n}") == ["zone = 'n'"]
    assert fold("{zone=n, zone=s}") == fold("{zone=n, zone!=n}") == ["false == 0"]


def test_days_columns_and_refusals():
    plan = logical.optimized(logical.build(parse('{shopper=new} range("2029-02-28T22:00:00Z", "2029-03-02T00:00:00Z") | max(duration) by (kind)', NOW)))
    assert [str(d) for d in plan.days] == ["2029-02-28", "2029-03-01"]
    assert set(plan.columns) == {"ts_ns", "sampling_weight", "span_kind", "duration_ns", "span_attributes", "resource_attributes"}
    assert plan.text().splitlines()[-1].strip().startswith("Scan spans")
    with pytest.raises(ValueError, match="cannot sort"):
        logical.build(parse("{} | max(duration) by (kind) | sort by (service)", NOW))
    with pytest.raises(ValueError, match="can't be queried"):
        logical.build(parse("{}", NOW), "metrics")
    assert logical.optimized(logical.build(parse("{} | count", NOW)), without=("prune_days",)).days is None
