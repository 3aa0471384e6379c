"""N-gram Jaccard join: documents whose shingle sets overlap by a share, verified through signature trees. Exact for sets of every size.

1. Each document's set is hashed; equal sets are one class from here on.
2. Two sets that reach the threshold differ in a bounded number of elements. The hash range is cut into blocks, so many
   that in one of them the two differ in at most ``differ`` <= 15 elements, and a block into more parts than that, so that
   in it some parts agree as a whole. Parts meet in packed form, dealt by their leading bits, each with the parity bitmap of its
   block (64 bits; a differing element flips one). Sets that agree on a part and whose bitmaps differ in at most
   ``differ`` bits get a candidate link: none that reaches the threshold is missed, and unlike sets hardly ever pass.
   A part that very many sets have is split by a second part of the same block.
3. Connected candidates are a block of sets. A task takes the sets of a block, or a slice of a large one together with a few
   pivots of all of it, builds a signature tree and descends it against itself: a pair of nodes is left if its size ranges
   or its OR-combined bitmaps cannot reach the threshold, or if all below is connected already. Pairs that remain are
   compared exactly. Only what isn't connected to the largest component of its block afterwards meets the other slices.
4. Components of the verified links give the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import bounded_batches, cleared, fresh, mixed, release_shuffles, remove, shingle_hashes, staged, steps, utf8, word_hashes
from .components import Forest, components, spanning

#: Keys of parts that a task of step 2 takes, bytes of sets in a slice of a block, and documents in a tree's leaf.
MEET, SLICE_BYTES, LEAF = 1_500_000, 8 << 20, 8
#: Sets with one part from which it is split, keys that a task holds before it looks for such parts, and pivots of a block.
HOT, HELD, PIVOTS = 20_000, 4_000_000, 8
#: Most elements in which two sets differ in the block in which they meet, and re-cuts of a block with too many empty parts.
DIFFER, SALTS = 15, 8
_SALT = mixed(np.arange(SALTS, dtype=np.uint64))
_C1, _C2, _C3 = np.uint64(0xD1342543DE82EF95), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x9FB21C651E98DF25)


def sets_of(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The shingle set of each text as sorted hashes; letters A-Z are folded."""
    offsets, data = utf8(column)
    for a, b in steps(offsets):
        part = offsets[a : b + 1]
        words, at = word_hashes(data[part[0] : part[-1]], part - part[0], fold=True)
        yield from shingle_hashes(words, at, n)


def _sum_hash(s: np.ndarray, seed: int) -> int:
    return int(mixed(np.array([mixed(s ^ np.uint64(seed)).sum() + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def set_hash(s: np.ndarray) -> int:
    """A 64-bit hash of a set, signed."""
    return _sum_hash(s, 0xA0761D6478BD642F)


def second_hash(s: np.ndarray) -> int:
    """Another one; it tells sets apart whose first ones are equal."""
    return _sum_hash(s, 0x8EBC6AF09C88C6E3)


def set_id(s: np.ndarray, unlike: frozenset[int]) -> int:
    """The id of a class: the hash of its set, or the second one where unlike sets share the first."""
    h = set_hash(s)
    return second_hash(s) if h in unlike else h


def needed(a: int, b: int, percent: int) -> int:
    """Least intersection of sets of a and b elements with 100 * intersection >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def levels(n: int, percent: int) -> list[tuple[int, int]]:
    """(level, most) at which a set of n elements takes part. A pair meets at the level of its larger set.

    Level l holds sizes from r**l to below r**(l + 1) with r = (100 / percent)**2. At most ``most`` elements are in
    only one of two sets that reach the threshold, the larger one of such a size. Where none may differ, sets are equal and one class.
    """
    if percent >= 100:
        return []
    ratio = 2 * math.log(100 / percent)

    def level(x: int) -> int:
        return max(0, int(math.log(x) / ratio + 1e-9))

    out = []
    for k in range(level(n), level(max(n, n * 100 // percent)) + 1):
        high = math.ceil(math.exp(ratio * (k + 1)))
        most = 2 * high * (100 - percent) // (100 + percent)
        if most:
            out.append((k, most))
    return out


def shape(most: int) -> tuple[int, int, int, int]:
    """Blocks, parts of a block, elements that may differ in the best block, and spare parts: so many and one agree there."""
    blocks = most // (DIFFER + 1) + 1
    differ = most // blocks
    spare = 1 + differ // 6
    return blocks, differ + 1 + spare, differ, spare


def part_keys(s: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, parity bitmap of its block, elements that may differ, number of its block, given out) for each part of a set.

    Empty parts are not given out: in the block in which a pair meets, more parts agree than ``spare``. A block with more
    empty parts than that is cut anew with another hash, too; two sets that agree on empty parts alone both do so.
    After the last cut the empty ones are given out as well.
    """
    out: list[tuple[np.ndarray, ...]] = []
    own = mixed(s ^ _C2)
    flips = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(np.uint64(1) << (mixed(s * _C3) & np.uint64(63)))])
    top, number = s >> np.uint64(32), 0
    for level, most in levels(len(s), percent):
        blocks, parts, differ, spare = shape(most)
        part = ((top * np.uint64(blocks * parts)) >> np.uint64(32)).astype(np.int64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own)])
        todo = np.arange(blocks)
        edge = np.searchsorted(part, np.arange(blocks + 1) * parts)
        tag = flips[edge[1:]] ^ flips[edge[:-1]]
        block = None
        for salt in range(SALTS):
            if salt:
                if block is None:
                    block = part // parts
                cut = np.zeros(blocks, bool)
                cut[todo] = True
                mine = cut[block]
                part = block[mine] * parts + ((mixed(s[mine] + _SALT[salt]) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                part = part[order]
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own[mine][order])])
            at = np.searchsorted(part, (todo * parts)[:, None] + np.arange(parts + 1))
            full = at[:, 1:] > at[:, :-1]
            value = sums[at[:, 1:]] - sums[at[:, :-1]]
            place = ((todo * parts)[:, None] + np.arange(parts)).astype(np.uint64)
            key = mixed(value * _C1 + (place << np.uint64(12)) + np.uint64(level + 256 * salt))
            again = parts - full.sum(1) > spare
            given = full if salt + 1 < SALTS else full | again[:, None]
            out.append((key.ravel(), np.repeat(tag[todo], parts), np.full(key.size, differ, np.uint8), np.repeat(np.arange(number, number + len(todo), dtype=np.int32), parts), given.ravel()))
            number += len(todo)
            todo = todo[again]
            if not len(todo):
                break
    if not out:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.uint8), np.zeros(0, np.int32), np.zeros(0, bool))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


#: A key's low 28 bits under the elements that may differ, its block's bitmap, and the set.
_MEETING = np.dtype([("part", "<u4"), ("tag", "<u8"), ("id", "<i8")])


def _short(key: np.ndarray, differ: np.ndarray) -> np.ndarray:
    return (key & np.uint64(0x0FFFFFFF)) | (differ.astype(np.uint64) << np.uint64(28))


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return (((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _split(key, tag, differ, number, given, hot):
    """Keys of pairs of parts of a block, one of them hot."""
    out = []
    for i in np.flatnonzero(hot & given).tolist():
        j = np.flatnonzero(number == number[i])
        j = j[j != i]
        out.append((mixed(key[i] + key[j]), tag[j], differ[j]))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint8)
    key, tag, differ = (np.concatenate(c) for c in zip(*out, strict=True))
    key, at = np.unique(key, return_index=True)
    return key, tag[at], differ[at]


def _emitting(n: int, percent: int, buckets: int, unlike: frozenset[int], split: int = 0):
    """Task that gives out the keys of texts as (bucket, rows, links). Sets of one task with the same part and the same bitmap
    are linked at once, and one of them goes on. With ``split``, the buckets of the first pass, the second column holds the
    packed (bucket, part) of hot parts, and only their splits are given out."""

    def emit(batches):
        cleared()
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]] = []
        size = 0

        def flush():
            counts = [len(x[0]) for x in held]
            key, tag, differ = (np.concatenate([x[k] for x in held]) for k in range(3))
            ids = np.repeat(np.array([x[3] for x in held], np.int64), counts)
            order = np.lexsort((tag, key))
            key, tag, differ, ids = key[order], tag[order], differ[order], ids[order]
            same = np.zeros(len(key), bool)
            same[1:] = (key[1:] == key[:-1]) & (tag[1:] == tag[:-1])
            if same.any():
                at = np.flatnonzero(same)
                u, v = spanning(ids[at - 1], ids[at])
                yield pa.RecordBatch.from_arrays([pa.array([int(key[at[0]]) % buckets], pa.int32()), pa.array([None], pa.binary()), pa.array([np.concatenate([u, v]).tobytes()], pa.binary())], ["bucket", "rows", "links"])
            key, tag, differ, ids = key[~same], tag[~same], differ[~same], ids[~same]
            rows = np.empty(len(key), _MEETING)
            rows["part"], rows["tag"], rows["id"] = _short(key, differ), tag, ids
            at = np.searchsorted(_bucket(key, buckets), np.arange(buckets + 1))
            full = np.flatnonzero(at[1:] > at[:-1])
            for i in range(0, len(full), 64):
                part = full[i : i + 64]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([rows[at[b] : at[b + 1]].tobytes() for b in part], pa.binary()), pa.nulls(len(part), pa.binary())], ["bucket", "rows", "links"])

        for batch in batches:
            wanted = batch.column(1).to_pylist() if split else None
            for i, s in enumerate(sets_of(batch.column(0), n)):
                if not len(s) or (h := set_id(s, unlike)) in seen:
                    continue
                seen.add(h)
                key, tag, differ, number, given = part_keys(s, percent)
                if split:
                    hot = (_bucket(key, split).astype(np.uint64) << np.uint64(32)) | _short(key, differ)
                    key, tag, differ = _split(key, tag, differ, number, given, np.isin(hot, np.array(wanted[i], np.uint64)))
                else:
                    key, tag, differ = key[given], tag[given], differ[given]
                if len(key):
                    held.append((key, tag, differ, h))
                    size += len(key)
                if size >= 500_000:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return emit


def _meeting_task(last: bool):
    """Task that takes the keys of its buckets and gives out links (u, v), and (set, bucket, part) for hot parts unless it is the last pass."""

    def columns(u, v, part=None):
        for i in range(0, len(u), 50_000):
            own = (np.asarray(x[i : i + 50_000], np.int64) for x in (u, v))
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in own), pa.nulls(len(u[i : i + 50_000]), pa.int64()) if part is None else pa.array(part[i : i + 50_000].astype(np.int64), pa.int64())], ["u", "v", "part"])

    def meet(batches):
        held: dict[int, list[np.ndarray]] = {}
        hot: dict[int, np.ndarray] = {}
        size, limit = 0, HELD

        def given_out(b, rows, parts):
            at = np.isin(rows["part"], parts)
            yield from columns(rows["id"][at], np.full(int(at.sum()), b), rows["part"][at])

        for batch in batches:
            for b, raw, links in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if links is not None:
                    x = np.frombuffer(links, np.int64)
                    yield from columns(x[: len(x) // 2], x[len(x) // 2 :])
                    continue
                rows = np.frombuffer(raw, _MEETING)
                if b in hot:
                    yield from given_out(b, rows, hot[b])
                    rows = rows[~np.isin(rows["part"], hot[b])]
                held.setdefault(b, []).append(rows)
                size += len(rows)
            if size >= limit and not last:
                for b in list(held):
                    rows = np.concatenate(held[b])
                    parts, counts = np.unique(rows["part"], return_counts=True)
                    if (counts > HOT).any():
                        new = parts[counts > HOT]
                        yield from given_out(b, rows, new)
                        hot[b] = np.union1d(hot.get(b, new), new)
                        rows = rows[~np.isin(rows["part"], new)]
                    held[b] = [rows]
                size = sum(len(x[0]) for x in held.values())
                limit = max(HELD, 2 * size)
        for b in list(held):
            rows = np.concatenate(held.pop(b))
            u, v, large = meeting(rows, None if last else HOT)
            yield from columns(u, v)
            if len(large):
                yield from given_out(b, rows, large)

    return meet


def candidate_links(docs: DataFrame, reps: DataFrame, n: int, percent: int, keys: int, unlike: frozenset[int]) -> DataFrame:
    """u, v: links between set ids whose components hold every pair that reaches the threshold. ``reps``: set_id, rep_doc and rep_tid of each class; ``keys``: how many keys there are, about."""
    buckets = max(2, -(-keys // MEET))
    schema, out = "bucket int, rows binary, links binary", "u long, v long, part long"
    dealt = docs.select("text").mapInArrow(_emitting(n, percent, buckets, unlike), schema).repartitionById(buckets, F.col("bucket"))
    met = staged(dealt.mapInArrow(_meeting_task(False), out), "met")
    hot = met.where("part IS NOT NULL").groupBy(F.col("u").alias("set_id")).agg(F.collect_set(F.col("v") * (1 << 32) + F.col("part")).alias("hot"))
    links = met.where("part IS NULL").select("u", "v")
    rows = met.where("part IS NOT NULL").count()
    if not rows:
        return links
    texts = texts_of(docs, reps.join(hot, "set_id").select("rep_doc", "rep_tid", "hot"))
    again = max(2, -(-rows * (DIFFER + 4) // MEET))
    dealt = texts.select("text", "hot").mapInArrow(_emitting(n, percent, again, unlike, buckets), schema).repartitionById(again, F.col("bucket"))
    return links.unionByName(dealt.mapInArrow(_meeting_task(True), out).select("u", "v"))


def meeting(rows: np.ndarray, most: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (a spanning forest) within groups of equal parts, between ids whose bitmaps differ in few enough bits; and the parts of more than ``most`` bitmaps that a first pivot doesn't settle."""
    none = np.zeros(0, np.int64)
    if not len(rows):
        return none, none, np.zeros(0, np.uint32)
    order = np.lexsort((rows["id"], rows["tag"], rows["part"]))
    part, tag, ids = rows["part"][order], rows["tag"][order], rows["id"][order]
    same = np.zeros(len(part), bool)
    same[1:] = (part[1:] == part[:-1]) & (tag[1:] == tag[:-1])
    at = np.flatnonzero(same)
    us, vs = [ids[at - 1]], [ids[at]]
    part, tag, ids = part[~same], tag[~same], ids[~same]
    begins = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    counts = np.diff(np.append(begins, len(part)))
    lead = np.repeat(begins, counts)
    differ = (part >> np.uint32(28)).astype(np.int64)
    near = np.bitwise_count(tag ^ tag[lead]) <= differ
    near[begins] = False
    us.append(ids[lead[near]])
    vs.append(ids[near])
    odd = ~near
    odd[begins] = False
    large = []
    for g in np.unique(np.searchsorted(begins, np.flatnonzero(odd), "right") - 1).tolist():
        a, c = int(begins[g]), int(counts[g])
        if c == 2:
            continue
        if most is not None and c > most:
            large.append(part[a])
            continue
        u, v = pivoted(tag[a : a + c], int(differ[a]))
        us.append(ids[a : a + c][u])
        vs.append(ids[a : a + c][v])
    u, v = np.concatenate(us), np.concatenate(vs)
    u, v = spanning(u, v) if len(u) else (u, v)
    return u, v, np.array(large, np.uint32)


def pivoted(tag: np.ndarray, differ: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between places of bitmaps that differ in at most ``differ`` bits, enough to connect all that are connected.

    All near a pivot are linked to it; what is farther than twice ``differ`` from it can't be near any of them, and what lies
    between is held against each.
    """
    us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    rest = np.arange(len(tag))
    while len(rest) > 1:
        away = np.bitwise_count(tag[rest] ^ tag[rest[0]])
        near, ring = rest[1:][away[1:] <= differ], rest[(away > differ) & (away <= 2 * differ)]
        us.append(np.full(len(near), rest[0]))
        vs.append(near)
        for i in range(0, len(near) if len(ring) else 0, 256):
            close = np.bitwise_count(tag[near[i : i + 256], None] ^ tag[None, ring]) <= differ
            hit = np.flatnonzero(close.any(0))
            us.append(near[i + close.argmax(0)[hit]])
            vs.append(ring[hit])
        rest = rest[away > differ]
    return np.concatenate(us), np.concatenate(vs)


class Tree:
    """A signature tree: leaves of LEAF sets that lie next to each other by size and minimum hash, nodes of eight below."""

    def __init__(self, sets: list[np.ndarray], words: int):
        self.sets = sets
        n = len(sets)
        self.bits = np.zeros((n, words), np.uint64)
        for k, s in enumerate(sets):
            at = s % np.uint64(words * 64)
            np.bitwise_or.at(self.bits[k], (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        sizes = np.array([len(s) for s in sets], np.int64)
        hidden = sizes - np.bitwise_count(self.bits).sum(1).astype(np.int64)
        self.levels = [(self.bits, sizes, sizes, hidden)]
        self.spans = [[(i, i + 1) for i in range(n)]]
        step = LEAF
        while len(self.levels[-1][1]) > 1:
            bits, low, high, hid = self.levels[-1]
            at = np.arange(0, len(low), step)
            self.levels.append((np.bitwise_or.reduceat(bits, at, 0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(hid, at)))
            self.spans.append([(int(i), min(int(i) + step, len(low))) for i in at])
            step = 8


def tree_join(x: Tree, y: Tree, same: bool, percent: int, forest: Forest, shift: int) -> Iterator[tuple[int, int]]:
    """Descends both trees; yields verified pairs that connect what was not connected. ``shift`` is the index of y's first set in the forest."""
    if not x.sets or not y.sets:
        return

    def members(t: Tree, level: int, i: int) -> tuple[int, int]:
        a, b = i, i + 1
        for k in range(level, 0, -1):
            a, b = t.spans[k][a][0], t.spans[k][b - 1][1]
        return a, b

    stack = [(len(x.levels) - 1, 0, len(y.levels) - 1, 0)]
    while stack:
        lx, i, ly, j = stack.pop()
        if lx == 0 and ly == 0:
            if forest.find(i) != forest.find(shift + j):
                a, b = x.sets[i], y.sets[j]
                if len(np.intersect1d(a, b, assume_unique=True)) >= needed(len(a), len(b), percent):
                    forest.join(i, shift + j)
                    yield i, j
            continue
        if 0 < lx <= 2 and 0 < ly <= 2:
            ax, bx = members(x, lx, i)
            ay, by = members(y, ly, j)
            if len({forest.find(k) for k in range(ax, bx)} | {forest.find(shift + k) for k in range(ay, by)}) == 1:
                continue
        down = lx >= ly
        t, level, node = (x, lx, i) if down else (y, ly, j)
        o, olevel, onode = (y, ly, j) if down else (x, lx, i)
        a, b = t.spans[level][node]
        bits, low, high, hidden = (c[a:b] for c in t.levels[level - 1])
        obits, olow, ohigh, ohidden = (c[onode] for c in o.levels[olevel])
        most = np.bitwise_count(bits & obits).sum(1).astype(np.int64) + np.minimum(hidden, ohidden)
        most = np.minimum(most, np.minimum(high, ohigh))
        fits = (100 * high >= percent * olow) & (100 * ohigh >= percent * low) & (most * (100 + percent) >= percent * (low + olow))
        for k in np.flatnonzero(fits).tolist()[::-1]:
            child = a + k
            if down:
                if same and level - 1 == olevel and child > onode:
                    continue
                stack.append((level - 1, child, olevel, onode))
            else:
                if same and lx == level - 1 and i > child:
                    continue
                stack.append((olevel, onode, level - 1, child))


def joined_block(ids: np.ndarray, sets: list[np.ndarray], other: tuple[np.ndarray, list[np.ndarray]] | None, percent: int, known: dict[int, int] | None = None) -> Iterator[tuple[int, int]]:
    """Verified links within a slice of a block, or between it and ``other``. ``known``: the component of ids that have one; links within one aren't looked for."""
    if not sets or other and not other[1]:
        return
    widest = max([1, *map(len, sets), *(map(len, other[1]) if other else ())])
    words = 1 << max(4, (16 * widest - 1).bit_length() - 6)
    words = min(words, 1 << 12)

    def sorted_by_size(i, s):
        order = sorted(range(len(s)), key=lambda k: (len(s[k]), s[k][0] if len(s[k]) else 0))
        return i[order], [s[k] for k in order]

    ids, sets = sorted_by_size(ids, sets)
    oids, osets = sorted_by_size(*other) if other else (ids[:0], [])
    forest, first = Forest(len(sets) + len(osets)), {}
    for i, x in enumerate([*ids.tolist(), *oids.tolist()]):
        forest.join(i, first.setdefault(known.get(x, x) if known else x, i))
    x = Tree(sets, words)
    pairs = tree_join(x, Tree(osets, words), False, percent, forest, len(sets)) if other else tree_join(x, x, True, percent, forest, 0)
    right = oids if other else ids
    for i, j in pairs:
        yield int(ids[i]), int(right[j])


def classes_of(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, tid (a hash of the text), n_shingles, set_id and second (hashes of the set) of each document."""

    def run(batches):
        cleared()
        for batch in batches:
            sets = list(sets_of(batch.column(2), n))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), *(pa.array([f(s) if len(s) else None for s in sets], pa.int64()) for f in (set_hash, second_hash))],
                ["doc_id", "tid", "n_shingles", "set_id", "second"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tid"), "text").mapInArrow(run, "doc_id long, tid long, n_shingles long, set_id long, second long")


def kinds_of(classes: DataFrame) -> DataFrame:
    """One row for each class of equal sets, aggregated before it is shuffled."""
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tid"))
    some = classes.where("set_id IS NOT NULL").groupBy("set_id").agg(rep.alias("rep"), F.first("n_shingles").alias("n_shingles"), (F.min("second") != F.max("second")).alias("unlike"))
    return some.select("set_id", "n_shingles", "unlike", F.col("rep.doc_id").alias("rep_doc"), F.col("rep.tid").alias("rep_tid"))


def texts_of(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """``reps`` with the text of their document (``rep_doc, rep_tid``), by a sort-merge join at every size: this side grows with the documents, too. A repeated row comes as often as it is there."""
    texts = docs.select(F.col("doc_id").cast("long").alias("own_doc"), F.xxhash64("text").alias("own_tid"), "text")
    return texts.join(reps.hint("merge"), (F.col("own_tid") == F.col("rep_tid")) & F.col("own_doc").eqNullSafe(F.col("rep_doc"))).drop("own_doc", "own_tid")


def _verifying(percent: int):
    """Task that joins the sets of a slice, or a slice with a chunk of sets that aren't connected yet."""

    def verify(key, table):
        both = len(key) > 2
        ids, new = np.unique(table.column("set_id").to_numpy(), return_index=True) if not both else (None, None)
        elements = table.column("elements")
        if not both:
            links = list(joined_block(ids, [np.frombuffer(elements[int(i)].as_buffer(), np.uint64) for i in new], None, percent))
        else:
            own = table.column("set_id").to_numpy()
            known = dict(zip(own.tolist(), table.column("root").to_pylist(), strict=True))
            extra = table.column("extra").to_numpy(zero_copy_only=False)
            sides = []
            for side in (~extra, extra):
                at = np.flatnonzero(side)
                i, new = np.unique(own[at], return_index=True)
                sides.append((i, [np.frombuffer(elements[int(k)].as_buffer(), np.uint64) for k in at[new]]))
            links = list(joined_block(*sides[0], sides[1], percent, known)) if all(len(i) for i, _ in sides) else []
        return pa.table({"u": pa.array([x[0] for x in links], pa.int64()), "v": pa.array([x[1] for x in links], pa.int64())})

    return verify


def _grouped(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(classes_of, class -> the smallest set_id of its component for classes that are linked)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    classes = staged(classes_of(docs, n), "classes")
    kinds = staged(kinds_of(classes), "kinds")
    # unlike sets with one hash: fewer than one pair in 10**9 documents, a few in 10**10
    unlike = frozenset(r.set_id for r in kinds.where("unlike").select("set_id").collect())
    if unlike:
        classes = staged(classes.withColumn("set_id", F.when(F.col("set_id").isin(list(unlike)), F.col("second")).otherwise(F.col("set_id"))), "classes")
        kinds = staged(kinds_of(classes), "kinds")
    share = 2.6 * 2 * (100 - percent) / (100 + percent)
    keys = kinds.agg(F.sum(F.col("n_shingles") * share + 4).cast("long")).first()[0] or 0
    weak = components(candidate_links(docs, kinds, n, percent, keys, unlike))
    release_shuffles(spark)

    own = kinds.join(weak.select(F.col("node").alias("set_id"), F.col("root").alias("block")), "set_id")
    own = staged(own.select("set_id", "block", "rep_doc", "rep_tid", (8 * F.col("n_shingles") + 64).alias("bytes")), "members")
    pivot = [F.min(F.struct(F.xxhash64("set_id", F.lit(i)), "set_id"))["set_id"] for i in range(PIVOTS)]
    wide = own.groupBy("block").agg(F.ceil(F.sum("bytes") / SLICE_BYTES).alias("slices"), F.array(*pivot).alias("pivots")).where("slices > 1")
    wide = staged(wide, "wide")
    sliced = own.join(wide, "block", "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    sliced = sliced.withColumn("slice", F.pmod(F.xxhash64("set_id"), "slices").cast("int"))

    def with_sets(rows: DataFrame) -> DataFrame:
        """``rows`` with the elements of their set."""
        names = [c for c in rows.columns if c not in ("rep_doc", "rep_tid")]

        def sets(batches):
            cleared()
            for batch in batches:
                mine = batch.column(1 + names.index("set_id")).to_pylist()
                some = [(i, s) for i, s in enumerate(sets_of(batch.column(0), n)) if len(s) and set_id(s, unlike) == mine[i]]
                at = pa.array([i for i, _ in some], pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(1 + k).take(at) for k in range(len(names))), pa.array([s.tobytes() for _, s in some], pa.binary())], [*names, "elements"])

        kinds_ = dict(rows.dtypes)
        schema = ", ".join([*(f"{c} {kinds_[c]}" for c in names), "elements binary"])
        return texts_of(docs, rows).select("text", *names).mapInArrow(sets, schema)

    # the sets are kept, so that the texts are dealt once
    copies = F.when(F.array_contains("pivots", F.col("set_id")), F.col("slices")).otherwise(1).cast("int").alias("copies")
    kept = staged(with_sets(sliced.select("set_id", "block", F.col("slices").cast("int").alias("slices"), "slice", copies, "rep_doc", "rep_tid")), "sets")
    dealt = kept.withColumn("slice", F.explode(F.when(F.col("copies") > 1, F.sequence(F.lit(0), F.col("copies") - 1)).otherwise(F.array("slice")))).select("block", "slice", "set_id", "elements")
    links = staged(dealt.groupBy("block", "slice").applyInArrow(_verifying(percent), "u long, v long"), "verified")
    linked = components(links)
    release_shuffles(spark)
    if not wide.isEmpty():
        # what isn't in the largest component of its block meets all slices
        rooted = sliced.where("slices > 1").join(linked, F.col("set_id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "set_id"))
        rooted = staged(rooted.select("set_id", "block", "slices", "slice", "bytes", "root"), "rooted")
        largest = rooted.groupBy("block", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("block").agg(F.max(F.struct("c", "root"))["root"].alias("largest"))
        largest = staged(largest, "largest")
        apart = rooted.join(largest, "block").where("root <> largest")
        chunks = staged(apart.groupBy("block").agg(F.ceil(F.sum("bytes") / SLICE_BYTES).cast("int").alias("chunks")), "chunks")
        if not chunks.isEmpty():
            every = F.sequence(F.lit(0), F.col("chunks") - 1)
            one = apart.join(chunks, "block").select("set_id", F.sequence(F.lit(0), F.col("slices").cast("int") - 1).alias("at"), F.array(F.pmod(F.xxhash64("set_id", F.lit(7)), "chunks").cast("int")).alias("chunk"), "root", F.lit(True).alias("extra"))
            two = rooted.join(chunks, "block").select("set_id", F.array("slice").alias("at"), every.alias("chunk"), "root", F.lit(False).alias("extra"))
            dealt = kept.where("slices > 1").select("set_id", "block", "elements").join(one.unionByName(two).hint("merge"), "set_id")
            dealt = dealt.withColumn("at", F.explode("at")).withColumn("chunk", F.explode("chunk"))
            more = dealt.groupBy("block", "at", "chunk").applyInArrow(_verifying(percent), "u long, v long")
            linked = components(links.unionByName(more))
            release_shuffles(spark)
    remove(spark, own.staged_at, kept.staged_at)
    return classes, linked


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id reachable over links of 100 * intersection >= percent * union.

    Sets hold the distinct n-word shingles of the whole lower-cased (A-Z) text; fewer words are one shingle. A text
    without words, or null, has an empty set and is linked with nothing. Repeated rows are equal sets and so linked;
    a null doc_id never names a component, unless it stands alone (then null); other columns are ignored; an empty
    table gives no rows. Shingles are compared by 64-bit hashes.
    """
    classes, linked = _grouped(docs, n, percent)
    lowest = classes.where("set_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("low"))
    lowest = lowest.join(linked, F.col("set_id") == F.col("node"), "left").select("set_id", "low", F.coalesce("root", "set_id").alias("root"))
    named = lowest.groupBy("root").agg(F.min("low").alias("component_id"))
    named = staged(lowest.join(named, "root").select(F.col("set_id").alias("named_set"), "component_id"), "named")
    out = classes.join(named, F.col("set_id") == F.col("named_set"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near duplicates, with its columns, whatever these are called: the one with the smallest doc_id, then by a hash of the text, then by one of all columns; rows without a doc_id come last.

    It is chosen by row, so unlike texts with one doc_id all stay. A text without words, or null, is a duplicate of nothing and stays;
    an empty table gives no rows.
    """
    names = docs.columns
    key, tid, rep_doc, rep_tid, rows = fresh(names, "key", "tid", "rep_doc", "rep_tid", "rows")
    classes, linked = _grouped(docs, n, percent)
    reps = classes.where("set_id IS NOT NULL").groupBy("set_id", "doc_id", "tid").agg(F.count(F.lit(1)).alias("m"))
    first = reps.groupBy("set_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tid", "m")).alias("rep"))
    first = first.join(linked, F.col("set_id") == F.col("node"), "left").groupBy(F.coalesce("root", "set_id").alias("root")).agg(F.min("rep").alias("rep"))
    first = staged(first.select(F.col("rep.doc_id").alias(rep_doc), F.col("rep.tid").alias(rep_tid), F.col("rep.m").alias(rows)), "kept")
    wordless = classes.where("set_id IS NULL").select(F.col("doc_id").alias(rep_doc), F.col("tid").alias(rep_tid), F.lit(1).cast("long").alias(rows)).distinct()
    marked = docs.withColumns({key: F.col("doc_id").cast("long"), tid: F.xxhash64("text")})

    def chosen(reps: DataFrame) -> DataFrame:
        return marked.join(reps.hint("merge"), F.col(key).eqNullSafe(F.col(rep_doc)) & (F.col(tid) == F.col(rep_tid)))

    out = chosen(first.where(F.col(rows) == 1).unionByName(wordless)).select(*names)
    if not (often := first.where(F.col(rows) > 1)).isEmpty():
        plain = [c for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
        one = chosen(often).groupBy(rep_doc, rep_tid).agg(F.min_by(F.struct(*names), F.xxhash64(*plain)).alias(rows))
        out = out.unionByName(one.select(*(F.col(rows)[c].alias(c) for c in names)))
    return out
