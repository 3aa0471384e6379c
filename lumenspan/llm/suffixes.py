"""Removal of repeated byte strings by a distributed merge sort of suffixes that knows common prefixes.

Sorting the suffix at every byte is not needed to find each repeated string of SPAN bytes. A string's least K-byte
gram, by hash, stands at the same place in every copy of the string, so it is enough to sort the suffixes that begin at such
anchors (about one byte in seventy) and to keep with each what stands before it.

1. Texts that are equal as a whole are found by SHA-256: from SPAN bytes on, all of a text that has a copy goes.
2. The grams of the anchors of all different texts meet, packed and dealt by hash; only anchors whose gram occurs
   again go on. A gram that occurs more than HOT times is split: by how far its strings begin before the anchor, in steps of
   WIDTHS, and by all bytes that the strings of a step have in common (64, then 167, 193 and 200).
3. A task sorts the suffixes at its anchors and writes runs in which a suffix holds only what it doesn't share with the one before
   (front coding). Suffixes that are equal with what stands before them are one entry; if a task has it twice, its
   strings are repeated, and no place goes on. Runs are exchanged by ranges of the key, which is the gram's hash and then the suffix.
4. A range's runs are merged by a loser tree that keeps the common prefix of each head with the last suffix sent, and
   so never compares known prefixes again. These common prefixes decide: a string that begins ``a`` bytes before its
   anchor is repeated if two neighbours' common prefixes reach SPAN - a bytes and what stands before them, sorted from
   the anchor backwards, agrees in ``a`` bytes.
5. The intervals covered are gathered by document and cut out.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import bounded_batches, cleared, mixed, powers, prefix_hash, release_shuffles, staged, steps, utf8

#: Length of the strings that are removed, and of an anchor's gram.
SPAN, K = 200, 64
STEP = 1 << 19
#: Grams or bytes of suffixes that a task takes, suffixes in a run, and grams that a task holds before it looks for frequent ones.
MEET, RANGE_BYTES, RUN, HELD = 2_000_000, 6 << 20, 40_000, 6_000_000
#: Steps in which the strings of an anchor are told apart, and how often a gram of one may occur before the next is taken. At the last a gram is the whole string.
WIDTHS, HOT = (SPAN - K + 1, 34, 8, 1), 4000
EMPTY = hashlib.sha256(b"").hexdigest()


def regions(offsets: np.ndarray, data: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first row, bytes, offsets of rows in them, bytes of the row before them): a few short rows, or a window of a long row; windows overlap so that each string is in one."""
    for a, b in steps(offsets, STEP):
        first, size = int(offsets[a]), int(offsets[b] - offsets[a])
        if size <= STEP + SPAN:
            yield a, data[first : first + size], offsets[a : b + 1] - first, 0
            continue
        for w in range(0, size - SPAN + 1, STEP):
            own = data[first + w : first + min(size, w + STEP + SPAN - 1)]
            yield a, own, np.array([0, len(own)]), w


class Anchors:
    """The anchors of texts: for each run of SPAN-byte strings with the same one its document, place, first and last start, and the hash of its gram.

    The anchor of a string is the least of its grams by the upper half of their hash, the leftmost of equal ones, so it
    depends on the string alone.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n, w = len(data), SPAN - K + 1
        self.sums, self.down = np.zeros(1, np.uint64), np.zeros(0, np.uint64)
        if n < SPAN:
            self.doc = self.at = self.first = self.last = np.zeros(0, np.int64)
            self.gram = np.zeros(0, np.uint64)
            return
        self.sums, self.down = c, down = prefix_hash(data), powers(n)[1]
        gram = mixed((c[K:] - c[:-K]) * down[: n - K + 1])
        low = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
        width = 1
        while 2 * width <= w:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < w:
            low = np.minimum(low[: len(low) - (w - width)], low[w - width :])
        at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
        ends = np.repeat(offsets[1:], np.diff(offsets))[: len(at)]
        valid = np.arange(len(at)) + SPAN <= ends
        same = np.zeros(len(at) + 1, bool)
        same[1:-1] = (at[1:] == at[:-1]) & valid[1:] & valid[:-1]
        self.first = np.flatnonzero(valid & ~same[:-1])
        self.last = np.flatnonzero(valid & ~same[1:])
        self.at = at[self.first]
        # least grams are small numbers; mixed again, they are dealt evenly
        self.gram = mixed(gram[self.at] + np.uint64(1))
        self.doc = np.searchsorted(offsets, self.first, "right") - 1

    def kept(self, keep: np.ndarray) -> Anchors:
        out = object.__new__(Anchors)
        out.sums, out.down = self.sums, self.down
        out.doc, out.at, out.first, out.last, out.gram = (x[keep] for x in (self.doc, self.at, self.first, self.last, self.gram))
        return out

    def narrowed(self, level: int) -> Anchors:
        """The same strings in steps of a width: its gram is the hash of the bytes that all strings of a step have."""
        width = WIDTHS[level]
        low, high = (self.at - self.last) // width, (self.at - self.first) // width
        count = high - low + 1
        i = np.repeat(np.arange(len(count)), count)
        step = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + low[i]
        begin, end = step * width, np.minimum((step + 1) * width, WIDTHS[0])
        out = object.__new__(Anchors)
        out.sums, out.down, out.doc, out.at = self.sums, self.down, self.doc[i], self.at[i]
        out.first, out.last = np.maximum(self.first[i], out.at - end + 1), np.minimum(self.last[i], out.at - begin)
        s, e = out.at - begin, out.at + SPAN - end + 1
        out.gram = mixed((self.sums[e] - self.sums[s]) * self.down[s] + np.uint64(level)) if len(i) else self.gram[:0]
        return out

    def at_level(self, level: int, hot: list[np.ndarray] | None) -> Anchors:
        """The anchors as they are at a level: of each document those whose gram at the level before is hot."""
        out = self if not level else self.narrowed(level - 1) if level > 1 else self
        return out.kept(out.among(hot)).narrowed(level) if level else out

    def among(self, wanted: list[np.ndarray]) -> np.ndarray:
        """Whether an anchor's gram is among those of its document."""
        keep = np.zeros(len(self.doc), bool)
        order = np.argsort(self.doc, kind="stable")
        edges = np.searchsorted(self.doc[order], np.arange(len(wanted) + 1))
        for d, x in enumerate(wanted):
            own = order[edges[d] : edges[d + 1]]
            keep[own] = np.isin(self.gram[own], x)
        return keep


def _common(a: bytes, b: bytes, i: int) -> int:
    """Length of the common prefix of two keys that share their first i bytes."""
    m = min(len(a), len(b))
    x = int.from_bytes(a[i:m], "big") ^ int.from_bytes(b[i:m], "big")
    return m if not x else m - (x.bit_length() + 7) // 8


_ENTRY = struct.Struct("<HHHI")
#: The first 96 bits of a text's SHA-256 and the start in it.
_PLACE = struct.Struct("<12sq")


def front_coded(entries: list[tuple[bytes, bytes, list[tuple[bytes, int]]]]) -> bytes:
    """A sorted run of (key, what stands before the anchor, places): each key without the prefix it shares with the one before. An entry without a place is known to be repeated."""
    out, before = [], b""
    for key, left, places in entries:
        k = _common(before, key, 0)
        out += [_ENTRY.pack(k, len(key) - k, len(left), len(places)), key[k:], left, *(_PLACE.pack(*p) for p in places)]
        before = key
    return b"".join(out)


def unfolded(run: bytes) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """(prefix shared with the one before, key, what stands before the anchor, packed places) of a run."""
    at, key = 0, b""
    while at < len(run):
        k, rest, left, places = _ENTRY.unpack_from(run, at)
        at += _ENTRY.size
        key = key[:k] + run[at : at + rest]
        at += rest
        yield k, key, run[at : at + left], run[at + left : at + left + places * _PLACE.size]
        at += left + places * _PLACE.size


class LoserTree:
    """Merges sorted runs. Each head keeps how much it shares with the last key sent; the larger share wins without a look at the keys, and equal shares are compared only behind them."""

    def __init__(self, runs: list[Iterator[tuple[int, bytes, bytes, bytes]]]):
        self.runs = runs
        self.k = 1 << max(0, len(runs) - 1).bit_length()
        self.head: list = [None] * self.k
        self.key = [b""] * self.k
        self.share = [-1] * self.k
        self.losers = [0] * self.k
        for i in range(len(runs)):
            self._advance(i)
            if self.share[i] >= 0:
                self.share[i] = 0
        self.winner = self._play(1)

    def _advance(self, i: int) -> None:
        x = next(self.runs[i], None)
        self.head[i] = x
        self.share[i], self.key[i] = (-1, b"") if x is None else (x[0], x[1])

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        return self._match(node, self._play(2 * node), self._play(2 * node + 1))

    def _match(self, node: int, a: int, b: int) -> int:
        """The winner of two heads; the loser stays at the node with what it shares with the winner."""
        share = self.share
        if share[a] == share[b]:
            if share[a] >= 0:
                x, y = self.key[a], self.key[b]
                k = _common(x, y, share[a])
                if y[k : k + 1] < x[k : k + 1]:
                    a, b = b, a
                share[b] = k
        elif share[a] < share[b]:
            a, b = b, a
        self.losers[node] = b
        return a

    def __iter__(self) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        """(prefix shared with the one before, key, what stands before the anchor, packed places) in order."""
        while self.share[self.winner] >= 0:
            w = self.winner
            x = self.head[w]
            yield self.share[w], x[1], x[2], x[3]
            self._advance(w)
            node = (w + self.k) >> 1
            while node:
                w = self._match(node, w, self.losers[node])
                node >>= 1
            self.winner = w


def repeated(shared: np.ndarray, lefts: list[bytes], rights: np.ndarray, many: np.ndarray) -> list[list[tuple[int, int]]]:
    """Per entry the runs (from, to) of its strings of SPAN bytes, counted from its first, that another entry has too.

    Entries lie in the order of their suffixes; ``shared`` is how many bytes each has in common with the one before,
    ``rights`` how many bytes from the anchor it has. Entries in ``many`` are there more than once, so all of theirs are.
    """
    n = len(lefts)
    high = np.array([len(x) for x in lefts])
    low = SPAN - rights
    # what stands before the anchors, sorted backwards, and what neighbours have in common there
    width = int(high.max()) + 1
    back = [x[::-1].ljust(width, b"\0") for x in lefts]
    order = np.array(sorted(range(n), key=back.__getitem__))
    table = np.frombuffer(b"".join(back), np.uint8).reshape(n, width)[order]
    unlike = table[1:] != table[:-1]
    common = np.zeros(n, np.int64)
    common[1:] = np.where(unlike.any(1), unlike.argmax(1), width)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    hits = np.zeros((n, int(high.max()) + 2), bool)
    for a in range(int(low.min()), int(high.max()) + 1):
        i = np.flatnonzero((low <= a) & (a <= high))
        if len(i) > 1:
            both = np.cumsum(shared < SPAN - a)[i] * (n + 1) + np.cumsum(common < a)[rank[i]]
            by = np.argsort(both, kind="stable")
            same = both[by[1:]] == both[by[:-1]]
            hits[i[by[1:][same]], a] = True
            hits[i[by[:-1][same]], a] = True
    for i in np.flatnonzero(many).tolist():
        hits[i, low[i] : high[i] + 1] = True
    edges = np.diff(np.concatenate([np.zeros((n, 1), np.int8), hits.view(np.int8)], 1), axis=1)
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    begins, ends = np.nonzero(edges == 1), np.nonzero(edges == -1)
    for i, a, z in zip(begins[0].tolist(), begins[1].tolist(), ends[1].tolist(), strict=True):
        out[i].append((int(high[i]) - z + 1, int(high[i]) - a + 1))
    return out


def merged(runs: list[bytes], chunk: int = 1 << 20) -> Iterator[tuple[bytes, int, int]]:
    """(text, first and last start) of repeated strings, from the runs of a range of keys."""
    shares: list[int] = []
    lefts: list[bytes] = []
    keys: list[bytes] = []
    places: list[bytes] = []
    many: list[bool] = []
    size = 0

    def resolved():
        share, often = np.array(shares), np.array(many)
        # an entry is alone if its gram is neither that of the one before nor of the one behind
        new = np.append(share < 8, True)
        pick = np.flatnonzero(~(new[:-1] & new[1:]) | often)
        if len(pick):
            picked = pick.tolist()
            found = repeated(np.maximum(share[pick] - 8, 0), [lefts[i] for i in picked], np.array([len(keys[i]) - 8 for i in picked]), often[pick])
            for i, spans in zip(picked, found, strict=True):
                for text, lo in _PLACE.iter_unpack(places[i]):
                    for a, b in spans:
                        yield text, lo + a, lo + b - 1
        for x in (shares, lefts, keys, places, many):
            x.clear()

    for share, key, left, place in LoserTree([unfolded(r) for r in runs]):
        if share < 8 and size >= chunk:
            yield from resolved()
            size = 0
        # equal keys follow each other; those with the same bytes before the anchor are one entry
        back, alike = len(keys) - 1, share == len(key)
        while alike and back >= 0 and keys[back] == key and lefts[back] != left and back >= len(keys) - 8:
            back -= 1
        if alike and back >= 0 and keys[back] == key and lefts[back] == left:
            places[back] += place
            many[back] = True
            continue
        shares.append(share)
        lefts.append(left)
        keys.append(key)
        places.append(place)
        many.append(len(place) != _PLACE.size)
        size += len(left) + len(key)
    if keys:
        yield from resolved()


#: A gram of a text (the first 96 bits of its SHA-256), and how often it has it.
_GRAM = np.dtype([("gram", "<u8"), ("high", "<u8"), ("low", "<u4"), ("count", "<u4")])
_TEXT = np.dtype([("high", "<u8"), ("low", "<u4")])


def _dealt(rows: np.ndarray, lead: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Packed rows by ranges of their leading 32 bits."""
    bucket = ((lead * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    at = np.searchsorted(bucket[order], np.arange(buckets + 1))
    rows = rows[order]
    full = np.flatnonzero(at[1:] > at[:-1])
    for i in range(0, len(full), 64):
        part = full[i : i + 64]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([rows[at[b] : at[b + 1]].tobytes() for b in part], pa.binary())], ["bucket", "rows"])


def _unique(rows: np.ndarray) -> np.ndarray:
    """Rows by gram, then text; a text read by two tasks comes twice."""
    rows = rows[np.lexsort((rows["low"], rows["high"], rows["gram"]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows["gram"][1:] != rows["gram"][:-1]) | (rows["high"][1:] != rows["high"][:-1]) | (rows["low"][1:] != rows["low"][:-1])
    return rows[new]


def _by_text(rows: np.ndarray, hot: bool) -> Iterator[pa.RecordBatch]:
    """Grams packed by text, as shared or as hot ones."""
    rows = rows[np.lexsort((rows["gram"], rows["low"], rows["high"]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows["high"][1:] != rows["high"][:-1]) | (rows["low"][1:] != rows["low"][:-1])
    at = np.append(np.flatnonzero(new), len(rows))
    for i in range(0, len(at) - 1, 5000):
        j = min(len(at) - 1, i + 5000)
        texts = np.empty(j - i, _TEXT)
        texts["high"], texts["low"] = rows["high"][at[i:j]], rows["low"][at[i:j]]
        grams = pa.array([rows["gram"][at[x] : at[x + 1]].tobytes() for x in range(i, j)], pa.binary())
        empty = pa.nulls(j - i, pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in texts], pa.binary()), *((empty, grams) if hot else (grams, empty))], ["tid", "grams", "hot"])


def _lists(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(x), np.uint64) for x in column.to_pylist()]


def shared_grams(texts: DataFrame, buckets: int, level: int = 0) -> DataFrame:
    """tid, grams, hot: for each text (tid, text and, beyond level 0, hot) the packed hashes of its anchors' grams that occur again, there or elsewhere, and of those that occur too often."""
    last = level == len(WIDTHS) - 1

    def emit(batches):
        cleared()
        held: list[np.ndarray] = []
        seen: set[bytes] = set()
        size = 0
        for batch in batches:
            tids = batch.column(0).to_pylist()
            new = np.array([not (t in seen or seen.add(t)) for t in tids], bool)
            offsets, data = utf8(batch.column(1).filter(pa.array(new)))
            hot = _lists(batch.column(2).filter(pa.array(new))) if level else None
            names = np.frombuffer(b"".join(t for t, k in zip(tids, new, strict=True) if k), _TEXT)
            of: dict[int, list[np.ndarray]] = {}
            for a, own, part, _ in regions(offsets, data):
                x = Anchors(own, part).at_level(level, hot and hot[a : a + len(part) - 1])
                of.setdefault(a, []).append(np.stack([x.doc.astype(np.uint64), x.gram]))
            for a, found in of.items():
                doc, gram = np.concatenate(found, 1)
                order = np.lexsort((gram, doc))
                gram, doc = gram[order], doc[order]
                first = np.concatenate([[True], (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])]) if len(gram) else np.zeros(0, bool)
                text = names[a + doc[first].astype(np.int64)]
                rows = np.empty(int(first.sum()), _GRAM)
                rows["gram"], rows["high"], rows["low"] = gram[first], text["high"], text["low"]
                rows["count"] = np.diff(np.append(np.flatnonzero(first), len(gram)))
                held.append(rows)
                size += len(rows)
                if size >= 1_000_000:
                    rows = np.concatenate(held)
                    yield from _dealt(rows, rows["gram"] >> np.uint64(32), buckets)
                    held, size = [], 0
        if held:
            rows = np.concatenate(held)
            yield from _dealt(rows, rows["gram"] >> np.uint64(32), buckets)

    def meet(batches):
        held: list[np.ndarray] = []
        hot = np.zeros(0, np.uint64)
        size, limit = 0, HELD

        def counted(rows):
            rows = _unique(rows)
            begins = np.flatnonzero(np.concatenate([[True], rows["gram"][1:] != rows["gram"][:-1]])) if len(rows) else np.zeros(0, np.int64)
            times = np.add.reduceat(rows["count"].astype(np.int64), begins) if len(rows) else begins
            return rows, rows["gram"][begins[times > HOT]], np.repeat(times, np.diff(np.append(begins, len(rows))))

        for batch in batches:
            for raw in batch.column(1).to_pylist():
                rows = np.frombuffer(raw, _GRAM)
                if len(hot):
                    at = np.isin(rows["gram"], hot)
                    yield from _by_text(rows[at], True)
                    rows = rows[~at]
                held.append(rows)
                size += len(rows)
            if size >= limit and not last:
                rows, often, _ = counted(np.concatenate(held))
                at = np.isin(rows["gram"], often)
                yield from _by_text(rows[at], True)
                held, hot = [rows[~at]], np.union1d(hot, often)
                size = len(held[0])
                limit = max(HELD, 2 * size)
        if held:
            rows, often, times = counted(np.concatenate(held))
            at = np.isin(rows["gram"], often) if not last else np.zeros(len(rows), bool)
            yield from _by_text(rows[at], True)
            yield from _by_text(rows[~at & (times > 1)], False)

    dealt = texts.select("tid", "text", *(["hot"] if level else [])).mapInArrow(emit, "bucket int, rows binary").repartitionById(buckets, F.col("bucket"))
    return dealt.mapInArrow(meet, "tid binary, grams binary, hot binary").groupBy("tid").agg(F.collect_list("grams").alias("grams"), F.collect_list("hot").alias("more"))


def repeated_intervals(texts: DataFrame, buckets: int, level: int = 0) -> DataFrame:
    """tid, spans: packed (first, last) starts of repeated strings, from texts (tid, text, grams and, beyond level 0, hot)."""

    def packed(found: dict[bytes, list[tuple[int, int]]]):
        rows = list(found.items())
        for i in range(0, len(rows), 2000):
            part = rows[i : i + 2000]
            yield [r[0] for r in part], [np.array(r[1], np.int64).tobytes() for r in part]

    def emit(batches):
        cleared()
        held: dict[tuple[bytes, bytes], list[tuple[bytes, int]]] = {}

        def flush():
            # equal entries of one task are repeated: their places need no merge
            known: dict[bytes, list[tuple[int, int]]] = {}
            for (key, left), places in held.items():
                if len(places) > 1:
                    last = len(left) + len(key) - 8 - SPAN
                    for text, lo in places:
                        known.setdefault(text, []).append((lo, lo + last))
            for tids, spans in packed(known):
                n = len(tids)
                yield pa.RecordBatch.from_arrays([pa.array([int.from_bytes(t[:4], "big") * buckets >> 32 for t in tids], pa.int32()), pa.nulls(n, pa.binary()), pa.array(tids, pa.binary()), pa.array(spans, pa.binary())], ["bucket", "run", "tid", "spans"])
            entries = sorted((key, left, places if len(places) == 1 else []) for (key, left), places in held.items())
            first = 0
            lead = [int.from_bytes(e[0][:4], "big") * buckets >> 32 for e in entries]
            rows: list[tuple[int, bytes]] = []
            for i in range(1, len(entries) + 1):
                if i == len(entries) or lead[i] != lead[first]:
                    rows.append((lead[first], front_coded(entries[first:i])))
                    first = i
            held.clear()
            for i in range(0, len(rows), 64):
                n = len(rows[i : i + 64])
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows[i : i + 64]], pa.int32()), pa.array([r[1] for r in rows[i : i + 64]], pa.binary()), *(pa.nulls(n, pa.binary()) for _ in range(2))], ["bucket", "run", "tid", "spans"])

        for batch in batches:
            tids, wanted = batch.column(0).to_pylist(), _lists(batch.column(2))
            hot = _lists(batch.column(3)) if level else None
            offsets, data = utf8(batch.column(1))
            for a, own, part, before in regions(offsets, data):
                n = len(part) - 1
                x = Anchors(own, part).at_level(level, hot and hot[a : a + n])
                x = x.kept(x.among(wanted[a : a + n]))
                raw = own.tobytes()
                keys = x.gram.byteswap().tobytes()
                for i, (p, first, last, d) in enumerate(zip(x.at.tolist(), x.first.tolist(), x.last.tolist(), x.doc.tolist(), strict=True)):
                    entry = (keys[8 * i : 8 * i + 8] + raw[p : last + SPAN], raw[first:p])
                    held.setdefault(entry, []).append((tids[a + d], before + first - int(part[d])))
                if len(held) >= RUN:
                    yield from flush()
        if held:
            yield from flush()

    def merge(batches):
        parts: dict[int, list[bytes]] = {}
        for batch in batches:
            for b, run in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if run is not None:
                    parts.setdefault(b, []).append(run)
            known = batch.filter(batch.column(1).is_null())
            if len(known):
                yield known.select(["tid", "spans"])
        for b in list(parts):
            found: dict[bytes, list[tuple[int, int]]] = {}
            for tid, a, z in merged(parts.pop(b)):
                found.setdefault(tid, []).append((a, z))
            for tids, spans in packed(found):
                yield pa.RecordBatch.from_arrays([pa.array(tids, pa.binary()), pa.array(spans, pa.binary())], ["tid", "spans"])

    runs = texts.select("tid", "text", "grams", *(["hot"] if level else [])).mapInArrow(emit, "bucket int, run binary, tid binary, spans binary").repartitionById(buckets, F.col("bucket"))
    return runs.mapInArrow(merge, "tid binary, spans binary")


def removed_spans(spans: list[bytes]) -> np.ndarray:
    """Maximal runs of bytes (begin, end) that the strings cover."""
    x = np.frombuffer(b"".join(spans), np.int64).reshape(-1, 2)
    x = x[np.argsort(x[:, 0], kind="stable")]
    ends = np.maximum.accumulate(x[:, 1] + SPAN)
    new = np.concatenate([[True], x[1:, 0] > ends[:-1]])
    at = np.flatnonzero(new)
    return np.stack([x[at, 0], ends[np.append(at[1:] - 1, len(x) - 1)]], 1)


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and removed (array of begin, end in bytes) of each document.

    A byte goes if a string of SPAN bytes that covers it starts anywhere else too, in that text or another. Null text is
    empty; texts below SPAN bytes stay; every copy of a repeated string goes, the first too; rows that are repeated are
    texts that are equal; null doc_ids are treated each; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    text = F.coalesce("text", F.lit(""))
    sha = F.sha2(text.cast("binary"), 256)
    base = staged(docs.select(F.col("doc_id").cast("long"), F.octet_length(text).cast("long").alias("n_bytes"), sha.alias("sha")), "base")
    copies = base.groupBy("sha").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("rep"), F.first("n_bytes").alias("size"))
    copies = staged(copies.select("sha", "copies", "rep", "size", F.unhex(F.substring("sha", 1, 24)).alias("tid")), "copies")
    total = copies.where(f"size >= {SPAN}").agg(F.sum("size")).first()[0] or 0

    long_texts = docs.select(F.unhex(F.substring(sha, 1, 24)).alias("tid"), text.alias("text")).where(F.octet_length("text") >= SPAN)
    grams = staged(shared_grams(long_texts, max(2, -(-total // 60 // MEET))), "grams")
    release_shuffles(spark)
    # whole texts that have shared grams, one of each group of equal ones
    wanted = copies.join(grams, "tid").select("rep", F.col("sha").alias("want"), "tid", "copies", "grams", "more")
    own = docs.select(F.col("doc_id").cast("long"), sha.alias("own"), text.alias("text"))
    found = own.join(wanted.hint("merge"), (F.col("own") == F.col("want")) & F.col("doc_id").eqNullSafe(F.col("rep")))
    texts = staged(found.select("tid", "text", "copies", "grams", "more"), "texts")
    release_shuffles(spark)
    bytes_of = lambda c: F.sum(F.aggregate(c, F.lit(0).cast("long"), lambda a, g: a + F.octet_length(g)))
    at, found_spans = texts, []
    for level, width in enumerate(WIDTHS):
        chosen, hot = (x or 0 for x in at.agg(bytes_of("grams"), bytes_of("more")).first())
        if chosen:
            found_spans.append(staged(repeated_intervals(at, max(2, -(-chosen // 8 * (SPAN + width) // RANGE_BYTES)), level), "spans"))
            release_shuffles(spark)
        if not hot:
            break
        # strings whose gram is too frequent, in smaller steps
        left = at.where(F.size("more") > 0).select("tid", "text", F.col("more").alias("hot"))
        grams = shared_grams(left, max(2, -(-hot // 8 * 4 // MEET)), level + 1)
        at = staged(left.join(grams.hint("merge"), "tid"), "texts")
        release_shuffles(spark)
    spans = None
    for x in found_spans or [spark.createDataFrame([], "tid binary, spans binary")]:
        spans = x if spans is None else spans.unionByName(x)
    spans = spans.groupBy("tid").agg(F.collect_list("spans").alias("spans"))

    def cut(batches):
        for batch in batches:
            rows = []
            for t, x, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = x.encode(errors="surrogatepass")
                runs = removed_spans(packed)
                kept, at = hashlib.sha256(), 0
                for a, z in runs.tolist():
                    kept.update(raw[at:a])
                    at = z
                kept.update(raw[at:])
                rows.append((t, int((runs[:, 1] - runs[:, 0]).sum()), len(runs), kept.hexdigest(), [{"begin": a, "end": z} for a, z in runs.tolist()]))
            if rows:
                place = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.list_(place)), strict=True)], names=["tid", "n_removed", "n_spans", "kept_sha256", "removed"])

    changed = texts.where("copies = 1").select("tid", "text").join(spans.hint("merge"), "tid").mapInArrow(cut, "tid binary, n_removed long, n_spans long, kept_sha256 string, removed array<struct<begin: long, end: long>>")
    each = staged(copies.join(changed, "tid", "left").select(F.col("sha").alias("own"), "copies", "n_removed", "n_spans", "kept_sha256", "removed"), "changed")
    out = base.join(each, F.col("sha") == F.col("own"))
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= SPAN)
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(EMPTY)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(whole, F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.col("n_bytes").alias("end")))).otherwise(F.col("removed")).alias("removed"),
    )
