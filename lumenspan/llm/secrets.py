"""Secret scans by one deterministic automaton that is compiled from all rules."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

from .base import bounded_batches, cleared

#: kind, pattern, least length of the whole match, least length of the value. In a pattern only literals, classes,
#: groups, |, ?, *, + and {n,} are used. A match ends at its longest; those that fail a length are dropped.
#: The first three are the contract's, with {24,} as shorter runs of hex digits are dropped anyway.
ASSIGN_HEAD = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?"""
RULES: list[tuple[str, str, str, int]] = [
    ("assign", ASSIGN_HEAD + r"[A-Za-z0-9+/_.=-]+", ASSIGN_HEAD, 6),
    ("access", r"AKIA[A-Z0-9]+", "", 20),
    ("hex", r"[0-9a-f]{24,}", "", 24),
    ("github", r"gh[opsur]_[A-Za-z0-9]+", "", 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]+", "", 15),
    ("private_key", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY( BLOCK)?-----", "", 27),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "", 38),
]
BASE = ("assign", "access", "hex")
#: Fixed value: what follows a private key's header up to its end mark. It is matched from the header's end on, as in the automaton
#: each of its bytes could begin another rule, which doubles the states.
KEY_BODY = re.compile(rb"(\r?\n[A-Za-z-]+: [A-Za-z0-9.,-]+)*[A-Za-z0-9+/=\r\n]+-----END ([A-Z]+ )*PRIVATE KEY( BLOCK)?-----")


class Nfa:
    """States with byte moves and ordered empty moves, built from a pattern of the subset above."""

    def __init__(self, pattern: str, reverse: bool = False):
        self.moves: list[tuple[frozenset[int], int] | None] = []
        self.empty: list[list[int]] = []
        self.text, self.at, self.reverse = pattern, 0, reverse
        self.start, self.end = self._either()
        if self.at < len(pattern):
            raise ValueError(f"unexpected {pattern[self.at]!r} at {self.at}")

    def _new(self) -> int:
        self.moves.append(None)
        self.empty.append([])
        return len(self.moves) - 1

    def _either(self) -> tuple[int, int]:
        parts = [self._chain()]
        while self.text[self.at : self.at + 1] == "|":
            self.at += 1
            parts.append(self._chain())
        if len(parts) == 1:
            return parts[0]
        start, end = self._new(), self._new()
        for s, e in parts:
            self.empty[start].append(s)
            self.empty[e].append(end)
        return start, end

    def _chain(self) -> tuple[int, int]:
        parts = []
        while self.at < len(self.text) and self.text[self.at] not in "|)":
            parts.append(self._repeated())
        if self.reverse:
            parts.reverse()
        start = end = self._new()
        for s, e in parts:
            self.empty[end].append(s)
            end = e
        return start, end

    def _repeated(self) -> tuple[int, int]:
        begin = self.at
        s, e = self._atom()
        stop, sign = self.at, self.text[self.at : self.at + 1]
        if not sign or sign not in "?*+{":
            return s, e
        self.at += 1
        least = {"?": 0, "*": 0, "+": 1}.get(sign)
        if sign == "{":
            close = self.text.index(",}", self.at)
            least, self.at = int(self.text[self.at : close]), close + 2
        after = self.at
        for _ in range(least - 1):
            self.at = begin
            s2, e2 = self._atom()
            self.empty[e].append(s2)
            last, e = s2, e2
        if stop and least > 1:
            self.at = after
            self.empty[e].append(last)
            return s, self._close(e)
        self.at = after
        if sign in "*+{":
            self.empty[e].append(s)
        end = self._close(e)
        if least == 0:
            begin_state = self._new()
            self.empty[begin_state] += [s, end]
            return begin_state, end
        return s, end

    def _close(self, e: int) -> int:
        end = self._new()
        self.empty[e].append(end)
        return end

    def _atom(self) -> tuple[int, int]:
        if self.text[self.at] == "(":
            self.at += 1
            out = self._either()
            self.at += 1
            return out
        s, e = self._new(), self._new()
        self.moves[s] = (frozenset(self._set()), e)
        return s, e

    def _char(self) -> int:
        c = self.text[self.at]
        self.at += 1
        if c == "\\":
            c = self.text[self.at]
            self.at += 1
            if c == "x":
                self.at += 2
                return int(self.text[self.at - 2 : self.at], 16)
        return ord(c)

    def _set(self) -> Iterable[int]:
        if self.text[self.at] != "[":
            return {self._char()}
        self.at += 1
        out: set[int] = set()
        while self.text[self.at] != "]":
            a = b = self._char()
            if self.text[self.at] == "-" and self.text[self.at + 1] != "]":
                self.at += 1
                b = self._char()
            out.update(range(a, b + 1))
        self.at += 1
        return out

    def closed(self, states: Iterable[int]) -> tuple[int, ...]:
        """States reached by empty moves, first come first."""
        out: dict[int, None] = {}
        stack = list(states)[::-1]
        while stack:
            s = stack.pop()
            if s not in out:
                out[s] = None
                stack.extend(self.empty[s][::-1])
        return tuple(s for s in out if self.moves[s] or s == self.end)

    def step(self, states: tuple[int, ...], byte: int) -> tuple[int, ...]:
        return self.closed(m[1] for s in states if (m := self.moves[s]) and byte in m[0])


def _thread_step(nfa: Nfa, threads: tuple[tuple[int, ...], ...], byte: int, restart: bool) -> tuple[tuple[int, ...], ...]:
    """Threads by their start, earliest first. One that matches and can go on silences the later ones, as the leftmost match takes what follows."""
    out, seen = [], set()
    for t in threads:
        if n := tuple(s for s in nfa.step(t, byte) if s not in seen):
            out.append(n)
            seen.update(n)
            if nfa.end in n:
                return tuple(out)
    if restart:
        n = tuple(s for s in nfa.closed([nfa.start]) if s not in seen)
        if n:
            out.append(n)
    return tuple(out)


def _subsets(nfa: Nfa, bytes_: list[int]) -> list[list[tuple[int, bool]]]:
    """Subset construction for one rule: per state and byte class the next state, and whether a match ends before that byte."""
    fresh = (nfa.closed([nfa.start]),)
    ids, todo, rows = {fresh: 0}, [fresh], []
    for threads in todo:
        row = []
        for byte in bytes_:
            matched = nfa.end in threads[-1]
            moved = _thread_step(nfa, threads, byte, not matched)
            ended = matched and not moved
            if ended:
                moved = _thread_step(nfa, fresh, byte, True)
            if moved not in ids:
                ids[moved] = len(ids)
                todo.append(moved)
            row.append((ids[moved], ended))
        rows.append(row)
    return rows


class Automaton:
    """Transition arrays for all rules: ``table[state * classes + class of byte]``, and what ends on the way into a state."""

    def __init__(self, rules: list[tuple[str, str, str, int]] = RULES):
        self.rules = rules
        nfas = [Nfa(p) for _, p, _, _ in rules]
        groups: dict[tuple[bool, ...], int] = {}
        sets = [m[0] for n in nfas for m in n.moves if m]
        kinds = bytearray(groups.setdefault(tuple(b in s for s in sets), len(groups)) for b in range(256))
        first = [kinds.index(c) for c in range(len(groups))]
        self.classes, self.kinds = len(groups), bytes(kinds)

        alone = [_subsets(n, first) for n in nfas]
        begin = (0,) * len(rules)
        ids, todo, rows, ends = {(begin, 0): 0}, [begin], [], [0]
        for states in todo:
            row = []
            for c in range(self.classes):
                moves = [a[s][c] for a, s in zip(alone, states, strict=True)]
                key = (tuple(m[0] for m in moves), sum(m[1] << i for i, m in enumerate(moves)))
                if key not in ids:
                    ids[key] = len(ids)
                    todo.append(key[0])
                    ends.append(key[1])
                row.append(ids[key])
            rows.append(row)
        self._minimise(rows, ends)
        self.back = [Reverse(p) for _, p, _, _ in rules]
        self.head = [Nfa(h) if h else None for _, _, h, _ in rules]

    def _minimise(self, rows: list[list[int]], ends: list[int]) -> None:
        """Moore's refinement: states that end the same rules and lead to the same classes become one; those with ends come last."""
        block = {e: i for i, e in enumerate(sorted(set(ends)))}
        of = [block[e] for e in ends]
        while True:
            new: dict[tuple[int, ...], int] = {}
            again = [new.setdefault((of[s], *(of[t] for t in row)), len(new)) for s, row in enumerate(rows)]
            if len(new) == len(set(of)):
                break
            of = again
        quiet = sorted({b for s, b in enumerate(of) if not ends[s]})
        loud = sorted({b for s, b in enumerate(of) if ends[s]})
        place = {b: i for i, b in enumerate(quiet + loud)}
        table = [0] * (len(place) * self.classes)
        self.ended: dict[int, list[int]] = {}
        for s, row in enumerate(rows):
            at = place[of[s]] * self.classes
            table[at : at + self.classes] = [place[of[t]] * self.classes for t in row]
            if ends[s]:
                self.ended[at] = [i for i in range(len(self.rules)) if ends[s] >> i & 1]
        self.table, self.loud, self.states = table, len(quiet) * self.classes, len(place)
        self.start = place[of[0]] * self.classes

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """Spans (start, end, rule) in bytes, one pass over ``data``; a sentinel ends what lasts to the end of the text."""
        table, loud, s, found = self.table, self.loud, self.start, []
        last: dict[int, int] = defaultdict(int)
        i = 0
        for c in (data + b"\n").translate(self.kinds):
            s = table[s + c]
            if s >= loud:
                for rule in self.ended[s]:
                    begin = self.back[rule].start(data, i, last[rule])
                    last[rule] = i
                    if self._value(rule, data, begin, i) >= self.rules[rule][3]:
                        found.append((begin, i, rule))
            i += 1
        found = [(b, m.end(), r) if self.rules[r][0] == "private_key" and (m := KEY_BODY.match(data, e)) else (b, e, r) for b, e, r in found]
        found.sort(key=lambda x: (x[0], x[2]))
        return found

    def _value(self, rule: int, data: bytes, begin: int, end: int) -> int:
        """Length of the value: what follows the longest head."""
        nfa = self.head[rule]
        if nfa is None:
            return end - begin
        t, at = nfa.closed([nfa.start]), begin
        for i in range(begin, end):
            t = nfa.step(t, data[i])
            if not t:
                break
            if nfa.end in t and i + 1 < end:
                at = i + 1
        return end - at


class Reverse:
    """Reads a match backwards from its end to the leftmost start; its subset states are made as they are met."""

    def __init__(self, pattern: str):
        self.nfa, self.memo = Nfa(pattern, reverse=True), {}

    def start(self, data: bytes, end: int, least: int) -> int:
        t, best = self.nfa.closed([self.nfa.start]), end
        for i in range(end - 1, least - 1, -1):
            key = (t, data[i])
            if key not in self.memo:
                self.memo[key] = self.nfa.step(*key)
            t = self.memo[key]
            if not t:
                break
            if self.nfa.end in t:
                best = i
        return best


_BUILT: dict[int, Automaton] = {}


def automaton() -> Automaton:
    """The automaton of RULES, built once in a process."""
    if 0 not in _BUILT:
        _BUILT[0] = Automaton()
    return _BUILT[0]


def points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans in code points."""
    if data.isascii():
        return spans
    at = sorted({x for a, b, _ in spans for x in (a, b)})
    place, before, last = {}, 0, 0
    for x in at:
        before += len(data[last:x].decode(errors="surrogatepass"))
        place[x], last = before, x
    return [(place[a], place[b], rule) for a, b, rule in spans]


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, spans: an array of (start, end, kind) in code points, by start, then by the order of the rules.

    Null and empty texts have no spans; a null doc_id stays null; repeated rows are scanned each; other columns are
    ignored; an empty table gives no rows. A text is one run of the automaton, whose memory does not depend on its length.
    """
    bounded_batches(docs.sparkSession)

    def run(batches):
        cleared()
        a = automaton()
        for batch in batches:
            starts, stops, kinds, at = [], [], [], [0]
            for text in batch.column(1).to_pylist():
                data = (text or "").encode(errors="surrogatepass")
                for s, e, rule in points(data, a.spans(data)):
                    starts.append(s)
                    stops.append(e)
                    kinds.append(a.rules[rule][0])
                at.append(len(starts))
            row = pa.StructArray.from_arrays([pa.array(starts, pa.int64()), pa.array(stops, pa.int64()), pa.array(kinds, pa.string())], ["start", "end", "kind"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), row)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, spans array<struct<start: long, end: long, kind: string>>")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each secret in ``text`` replaced by ``mark``; spans that overlap become one. n_chars, if there, follows.

    Null texts stay null, empty ones empty; texts of any length are one run of the automaton; repeated rows are changed
    alike; of secrets that begin at one place the longest counts. Rows and all columns, whatever their names, are kept as they are
    otherwise; an empty table gives no rows. Of a private key without its end mark only the header can be told.
    """
    bounded_batches(docs.sparkSession)
    names, schema = docs.columns, docs.schema

    def run(batches):
        cleared()
        a = automaton()
        for batch in batches:
            texts, counts = [], []
            for text in batch.column(names.index("text")).to_pylist():
                if text is not None:
                    data = text.encode(errors="surrogatepass")
                    parts, at = [], 0
                    for s, e, _ in a.spans(data):
                        if s >= at:
                            parts += [data[at:s], mark.encode()]
                        at = max(at, e)
                    text = b"".join([*parts, data[at:]]).decode(errors="surrogatepass") if at else text
                texts.append(text)
                counts.append(None if text is None else len(text))
            columns = list(batch.columns)
            columns[names.index("text")] = pa.array(texts, pa.string())
            if "n_chars" in names:
                columns[names.index("n_chars")] = pa.array(counts, batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, schema)
