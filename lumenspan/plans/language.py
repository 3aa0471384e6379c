"""The pipeline query language: text to syntax tree, with the place of every error."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from fractions import Fraction

#: Nanoseconds of a unit.
UNITS = {"ns": 1, "us": 1_000, "ms": 1_000_000, "s": 1_000_000_000, "m": 60_000_000_000, "h": 3_600_000_000_000}
FUNCTIONS = ("count", "sum", "avg", "min", "max", "p50", "p95", "p99")
COMPARISONS = (">", ">=", "<", "<=", "==", "!=")
MATCHES = ("=", "!=", "=~", "!~")
DEFAULT_RANGE = timedelta(hours=1)


class QueryError(ValueError):
    """What is wrong in a query, and where: ``query:line:column: message``."""

    def __init__(self, message: str, line: int, column: int):
        super().__init__(f"query:{line}:{column}: {message}")
        self.message, self.line, self.column = message, line, column


@dataclass(frozen=True)
class TraceQuery:
    trace_id: str


@dataclass(frozen=True)
class Matcher:
    name: str
    op: str
    value: str


@dataclass(frozen=True)
class Comparison:
    """A numeric filter; with a unit the value is in nanoseconds."""

    name: str
    op: str
    value: int | float


@dataclass(frozen=True)
class Aggregate:
    function: str
    name: str | None = None

    @property
    def alias(self) -> str:
        return "count" if self.name is None else f"{self.function}_{self.name}"


@dataclass(frozen=True)
class SelectQuery:
    """Half-open time range in nanoseconds since 1970; a stage that is given again replaces the one before, comparisons add up."""

    start: int
    end: int
    matchers: tuple[Matcher, ...] = ()
    comparisons: tuple[Comparison, ...] = ()
    aggregates: tuple[Aggregate, ...] = ()
    by: tuple[str, ...] = ()
    sort: tuple[tuple[str, bool], ...] = ()
    limit: int | None = None


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    line: int
    column: int
    value: object = field(default=None, compare=False)


_SIGNS = ("=~", "!~", "!=", ">=", "<=", "==", "{", "}", "(", ")", ",", "|", "=", ">", "<", "-")
_IDENT = re.compile(r"[^\W\d]\w*(?:\.\w+)*")
_NUMBER = re.compile(r"\d+(?:\.\d+)?(?:[A-Za-zµ]+(?:\d+(?:\.\d+)?[A-Za-zµ]+)*)?")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\"}


def tokens(text: str) -> list[Token]:
    out: list[Token] = []
    at, line, begin = 0, 1, 0
    while at < len(text):
        c = text[at]
        if c == "\n":
            line, begin = line + 1, at + 1
        if c.isspace():
            at += 1
            continue
        column = at - begin + 1
        if c == '"':
            value, stop = [], at + 1
            while stop < len(text) and text[stop] not in '"\n':
                if text[stop] == "\\" and stop + 1 < len(text):
                    stop += 1
                    value.append(_ESCAPES.get(text[stop], text[stop]))
                else:
                    value.append(text[stop])
                stop += 1
            if stop >= len(text) or text[stop] != '"':
                raise QueryError("this string has no closing quote", line, column)
            out.append(Token("string", text[at : stop + 1], line, column, "".join(value)))
            at = stop + 1
        elif m := _NUMBER.match(text, at):
            out.append(Token("number", m[0], line, column))
            at = m.end()
        elif m := _IDENT.match(text, at):
            out.append(Token("ident", m[0], line, column))
            at = m.end()
        else:
            sign = next((s for s in _SIGNS if text.startswith(s, at)), None)
            out.append(Token(sign or "bad", sign or c, line, column))
            at += len(sign or c)
    out.append(Token("end", "", line, len(text) - begin + 1))
    return out


def duration_ns(text: str) -> int | None:
    """Nanoseconds of a duration such as 1h30m or 1.5s; None unless each part has a known unit."""
    parts = re.findall(r"(\d+(?:\.\d+)?)([A-Za-zµ]*)", text)
    if not parts or "".join(a + b for a, b in parts) != text or any(u not in UNITS for _, u in parts):
        return None
    return int(sum(Fraction(a) * UNITS[u] for a, u in parts))


_JAVA_ONLY = re.compile(r"\\[1-9]|\\k<|\(\?(?:[=!]|<[=!]|>)|[*+?}]\+")


class Parser:
    """Recursive descent over the grammar; keywords count only where a stage can begin, in either case."""

    def __init__(self, text: str, now: datetime | None = None):
        self.tokens, self.at = tokens(text), 0
        self.now = _ns(now or datetime.now(timezone.utc))

    @property
    def next(self) -> Token:
        return self.tokens[self.at]

    def take(self) -> Token:
        t = self.next
        self.at += 1
        return t

    def fail(self, message: str, t: Token | None = None) -> QueryError:
        t = t or self.next
        return QueryError(message, t.line, t.column)

    def expect(self, kind: str, what: str) -> Token:
        if self.next.kind != kind:
            raise self.fail(f"expected {what}, got {self.next.text or 'end of query'!r}")
        return self.take()

    def word(self, *words: str) -> bool:
        return self.next.kind == "ident" and self.next.text.lower() in words

    def parse(self) -> TraceQuery | SelectQuery:
        if self.word("trace"):
            out: TraceQuery | SelectQuery = self.trace()
        else:
            out = self.select()
        if self.next.kind != "end":
            raise self.fail("the query should end here")
        return out

    def trace(self) -> TraceQuery:
        self.take()
        self.expect("(", "'('")
        t = self.expect("string", "a quoted trace id")
        if not t.value:
            raise self.fail("the id of a trace can't be empty", t)
        if not re.fullmatch(r"[0-9a-fA-F]{32}", t.value):
            raise self.fail("the id of a trace has 32 hex digits", t)
        self.expect(")", "')'")
        return TraceQuery(t.value.lower())

    def select(self) -> SelectQuery:
        self.expect("{", "'{' or trace(...)")
        matchers = []
        while self.next.kind != "}":
            matchers.append(self.matcher())
            if self.next.kind == ",":
                self.take()
                if self.next.kind == "}":
                    raise self.fail("expected a label after ','")
            elif self.next.kind != "}":
                raise self.fail("expected ',' or '}'")
        self.take()
        start, end = self.time_range()
        comparisons: list[Comparison] = []
        rest: dict = {}
        while self.next.kind == "|":
            self.take()
            self.stage(comparisons, rest)
        return SelectQuery(start, end, tuple(matchers), tuple(comparisons), **rest)

    def matcher(self) -> Matcher:
        name = self.expect("ident", "a label name").text
        op = self.next
        if op.kind not in MATCHES:
            raise self.fail("a label is followed by one of =, !=, =~, !~")
        self.take()
        t = self.next
        if t.kind not in ("string", "ident"):
            raise self.fail("a label's value is a word or stands in quotes")
        self.take()
        value = t.value if t.kind == "string" else t.text
        if op.kind in ("=~", "!~"):
            self.pattern(value, t)
        return Matcher(name, op.kind, value)

    def pattern(self, value: str, t: Token) -> None:
        """Patterns stay in what both RE2 and Java have."""
        if _JAVA_ONLY.search(value):
            raise self.fail("back-references, look-around and possessive quantifiers are not supported", t)
        try:
            re.compile(value)
        except re.error as e:
            raise self.fail(f"invalid pattern: {e}", t) from None

    def time_range(self) -> tuple[int, int]:
        if self.word("since"):
            self.take()
            return self.now - self.duration(), self.now
        if self.word("range"):
            t = self.take()
            self.expect("(", "'('")
            start = self.moment()
            self.expect(",", "','")
            end = self.moment()
            self.expect(")", "')'")
            if start >= end:
                raise self.fail("a range begins before it ends", t)
            return start, end
        return self.now - DEFAULT_RANGE // timedelta(microseconds=1) * 1000, self.now

    def moment(self) -> int:
        if self.word("now"):
            self.take()
            if self.next.kind == "-":
                self.take()
                return self.now - self.duration()
            return self.now
        t = self.expect("string", "an RFC 3339 time or now")
        m = re.fullmatch(r"(\d{4}-\d\d-\d\d[Tt]\d\d:\d\d:\d\d)(?:\.(\d{1,9}))?([Zz]|[+-]\d\d:\d\d)", t.value)
        if not m:
            raise self.fail("this isn't an RFC 3339 time", t)
        try:
            at = datetime.fromisoformat(m[1].upper() + ("+00:00" if m[3] in "Zz" else m[3]))
        except ValueError as e:
            raise self.fail(str(e), t) from None
        return _ns(at) + int((m[2] or "").ljust(9, "0"))

    def duration(self) -> int:
        t = self.expect("number", "a duration")
        ns = duration_ns(t.text)
        if ns is None:
            raise self.fail(f"duration {t.text!r} needs units (ns, us, ms, s, m, h)", t)
        return ns

    def stage(self, comparisons: list[Comparison], rest: dict) -> None:
        after = self.tokens[self.at + 1].kind if self.at + 1 < len(self.tokens) else "end"
        if self.word("sort") and after == "ident":
            rest["sort"] = self.sort()
        elif self.word("limit") and after not in COMPARISONS:
            self.take()
            t = self.expect("number", "a whole number")
            if not t.text.isdigit():
                raise self.fail("limit must be a whole number", t)
            rest["limit"] = int(t.text)
        elif self.word(*FUNCTIONS) and (after == "(" or self.next.text.lower() == "count" and after not in COMPARISONS):
            rest["aggregates"], rest["by"] = self.aggregation()
        else:
            comparisons.append(self.comparison())

    def comparison(self) -> Comparison:
        name = self.expect("ident", "a filter, an aggregation, sort or limit").text
        op = self.next
        if op.kind not in COMPARISONS:
            raise self.fail("a field is followed by one of >, >=, <, <=, ==, !=")
        self.take()
        sign = 1
        if self.next.kind == "-":
            self.take()
            sign = -1
        t = self.expect("number", "a number")
        if re.fullmatch(r"\d+", t.text):
            value: int | float = int(t.text)
        elif re.fullmatch(r"\d+\.\d+", t.text):
            value = float(t.text)
        else:
            ns = duration_ns(t.text)
            if ns is None:
                raise self.fail(f"unknown unit in {t.text!r}", t)
            value = ns
        return Comparison(name, op.kind, sign * value)

    def aggregation(self) -> tuple[tuple[Aggregate, ...], tuple[str, ...]]:
        out = [self.aggregate()]
        while self.next.kind == ",":
            self.take()
            out.append(self.aggregate())
        by: list[str] = []
        if self.word("by"):
            self.take()
            self.expect("(", "'('")
            by.append(self.expect("ident", "a field").text)
            while self.next.kind == ",":
                self.take()
                by.append(self.expect("ident", "a field").text)
            self.expect(")", "')'")
        return tuple(out), tuple(by)

    def aggregate(self) -> Aggregate:
        t = self.expect("ident", "an aggregate function")
        name = t.text.lower()
        if name not in FUNCTIONS:
            raise self.fail(f"unknown function {t.text!r}", t)
        if self.next.kind != "(":
            if name != "count":
                raise self.fail(f"{name} needs a field")
            return Aggregate("count")
        self.take()
        of = self.expect("ident", "a field").text
        self.expect(")", "')'")
        return Aggregate(name, of)

    def sort(self) -> tuple[tuple[str, bool], ...]:
        self.take()
        if not self.word("by"):
            raise self.fail("expected 'by'")
        self.take()
        self.expect("(", "'('")
        out = []
        while True:
            name, down = self.expect("ident", "a field").text, False
            if self.word("asc", "desc"):
                down = self.take().text.lower() == "desc"
            out.append((name, down))
            if self.next.kind != ",":
                break
            self.take()
        self.expect(")", "')'")
        return tuple(out)


def _ns(at: datetime) -> int:
    return (at - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1) * 1000


def parse(text: str, now: datetime | None = None) -> TraceQuery | SelectQuery:
    """The syntax tree of a query. ``now`` is the clock for relative times."""
    return Parser(text, now).parse()
