"""Token-ID files coded by a static range asymmetric numeral system.

A file holds documents in ascending doc_id order. Its ids are cut into independent blocks, each coded by ``LANES``
interleaved coders under one frequency table that all files of a corpus share. A block starts with the states of its
lanes; further checkpoints inside a block hold the lanes' states and the place in its words, so that workers can
decode from any of them. Every stretch between checkpoints has a CRC-32 of its ids.

Layout, little-endian: magic, uint32 header length, JSON header (table, documents, blocks), then the blocks' bytes.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import bounded_batches, new_folder, release_shuffles, staged
from .tokens import pieces as encoder

SCHEMA = "doc_id long, start long, ids binary"
MAGIC = b"TOKRANS1"
LANES, BLOCK, CHECK = 2048, 1 << 19, 1 << 18
BITS, LOW = 20, 31


def table_of(counts: np.ndarray) -> np.ndarray:
    """Frequencies that add up to 2**BITS, at least 1 for each id that occurs."""
    total, used = int(counts.sum()), np.flatnonzero(counts)
    freq = np.zeros(len(counts), np.int64)
    if not total:
        freq[0] = 1 << BITS
        return freq
    share = counts[used] * ((1 << BITS) - len(used)) / total
    freq[used] = 1 + np.floor(share).astype(np.int64)
    order = np.argsort(-(share - np.floor(share)), kind="stable")
    freq[used[order[: (1 << BITS) - int(freq.sum())]]] += 1
    return freq


class Coder:
    """Encodes and decodes blocks under one table."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint16), freq)

    def encode(self, ids: np.ndarray) -> tuple[bytes, list[list[int]]]:
        """The block's bytes and its checkpoints: [ids before it, words before it, CRC-32 of the ids up to the next]."""
        n = len(ids)
        state = np.full(LANES, 1 << LOW, np.uint64)
        words, marks, count = [], [], 0
        for first in range((n - 1) // LANES * LANES, -1, -LANES):
            s = ids[first : first + LANES]
            f, x = self.freq[s], state[: len(s)]
            over = x >= (f << np.uint64(LOW - BITS + 32))
            if over.any():
                out = x[over]
                words.append((out & np.uint64(0xFFFFFFFF)).astype("<u4"))
                count += len(out)
                x[over] = out >> np.uint64(32)
            q = x // f
            x[:] = (q << np.uint64(BITS)) + self.cum[s] + (x - q * f)
            if first % CHECK == 0:
                marks.append((first, count, state.tobytes(), zlib.crc32(ids[first : first + CHECK].astype("<u4").tobytes())))
        marks.reverse()
        body = b"".join([m[2] for m in marks] + [w.tobytes() for w in reversed(words)])
        return body, [[m[0], count - m[1], m[3]] for m in marks]

    def decode(self, body: bytes, n: int, marks: list[list[int]], only: int | None = None) -> np.ndarray:
        """Ids of the block, or of the stretch after checkpoint ``only``; raises ValueError where a checksum differs."""
        states = np.frombuffer(body, "<u8", LANES * len(marks)).reshape(len(marks), LANES)
        words = np.frombuffer(body, "<u4", offset=states.nbytes)
        out = np.empty(n, np.uint16)
        mask, begin, end = np.uint64((1 << BITS) - 1), 0, n
        for k, (first, at, crc) in enumerate(marks):
            if only is not None and k != only:
                continue
            state, stop = states[k].copy(), min(n, first + CHECK)
            for i in range(first, stop, LANES):
                m = min(LANES, stop - i)
                x = state[:m]
                slot = x & mask
                s = self.symbol[slot]
                out[i : i + m] = s
                x[:] = self.freq[s] * (x >> np.uint64(BITS)) + slot - self.cum[s]
                low = np.flatnonzero(x < np.uint64(1 << LOW))
                if len(low):
                    if at + len(low) > len(words):
                        raise ValueError("a token block is damaged: checksum or length differs")
                    x[low] = (x[low] << np.uint64(32)) | words[at : at + len(low)]
                    at += len(low)
            if zlib.crc32(out[first:stop].astype("<u4").tobytes()) != crc:
                raise ValueError("a token block is damaged: checksum or length differs")
            if only is not None:
                begin, end = first, stop
        return out[begin:end]


def to_bytes(coder: Coder, packed: bytes, docs: list[tuple[int | None, int]], ids: np.ndarray) -> bytes:
    blocks, bodies = [], []
    for i in range(0, len(ids), BLOCK):
        part = ids[i : i + BLOCK]
        body, marks = coder.encode(part)
        blocks.append({"n": len(part), "bytes": len(body), "marks": marks})
        bodies.append(body)
    head = zlib.compress(json.dumps({"table": packed.hex(), "docs": docs, "blocks": blocks}).encode(), 1)
    return b"".join([MAGIC, len(head).to_bytes(4, "little"), head, *bodies])


def packed_table(freq: np.ndarray) -> bytes:
    return zlib.compress(freq.astype("<u4").tobytes(), 6)


def header(raw: bytes) -> tuple[dict, int]:
    """The header of a file, from its first bytes, and where the blocks begin."""
    if raw[:8] != MAGIC:
        raise ValueError("not a token file")
    size = int.from_bytes(raw[8:12], "little")
    return json.loads(zlib.decompress(raw[12 : 12 + size])), 12 + size


def coder_of(head: dict, coders: dict[str, Coder]) -> Coder:
    if head["table"] not in coders:
        coders[head["table"]] = Coder(np.frombuffer(zlib.decompress(bytes.fromhex(head["table"])), "<u4").astype(np.int64))
    return coders[head["table"]]


def ids_between(block, head: dict, coder: Coder, lo: int, hi: int) -> np.ndarray:
    """The ids at places lo to hi of a file, decoded from the checkpoints before them on; ``block(at, size)`` reads bytes behind the header."""
    out, at, first = [np.zeros(0, np.uint16)], 0, 0
    for b in head["blocks"]:
        if first < hi and first + b["n"] > lo:
            body = block(at, b["bytes"])
            for k, (begin, _, _) in enumerate(b["marks"]):
                begin, end = first + begin, first + min(b["n"], begin + CHECK)
                if begin < hi and end > lo:
                    out.append(coder.decode(body, b["n"], b["marks"], only=k)[max(0, lo - begin) : hi - begin])
        at, first = at + b["bytes"], first + b["n"]
    return np.concatenate(out)


def from_bytes(raw: bytes, coders: dict[str, Coder], lo: int = 0, hi: int | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """Documents of a file that begin at places lo to hi, each with its place and ids."""
    head, begin = header(raw)
    yield from _documents(head, lambda at, size: raw[begin + at : begin + at + size], coders, lo, hi)


def _documents(head: dict, block, coders: dict[str, Coder], lo: int, hi: int | None) -> Iterator[tuple[int | None, int, np.ndarray]]:
    ends = np.cumsum([0] + [n for _, n in head["docs"]])
    i, j = (int(np.searchsorted(ends[:-1], x)) if x is not None else len(ends) - 1 for x in (lo, hi))
    if i >= j:
        return
    ids = ids_between(block, head, coder_of(head, coders), int(ends[i]), int(ends[j]))
    for k in range(i, j):
        yield head["docs"][k][0], int(ends[k]), ids[ends[k] - ends[i] : ends[k + 1] - ends[i]]


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _added(batches):
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for x in batch.column(0).to_pylist():
            total += np.frombuffer(zlib.decompress(x), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["h"])


def frequency_table(counts: DataFrame) -> np.ndarray:
    """The table of all ids from the tasks' counts (``h``). Sums are made in two steps, and one row of fixed size is collected."""
    wide = max(1, round(counts.rdd.getNumPartitions() ** 0.5))
    rows = counts.repartition(wide).mapInArrow(_added, "h binary").coalesce(1).mapInArrow(_added, "h binary").collect()
    total = sum((np.frombuffer(zlib.decompress(r.h), np.int64) for r in rows), np.zeros(1 << 16, np.int64))
    used = np.flatnonzero(total)
    return table_of(total[: int(used[-1]) + 1 if len(used) else 1])


def write_tokens(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 2, file_tokens: int = 4_000_000) -> DataFrame:
    """Tokenize ``doc_id, text`` and write token files into ``folder``; the result has a row for each file.

    Texts are dealt by ranges of doc_id and tokenized in that order, then the table is counted over all ids, then files
    of at most about ``file_tokens`` ids are written, each of neighbouring rows of one range, so that a file holds a range of doc_id
    without a gap. ``first_row`` orders the files. A file is written under another
    name and then moved, so that a task that runs twice leaves one whole file. Null text counts as empty and gives the
    end id alone; null doc_ids come first; repeated doc_ids stay in the order of text; other columns are ignored;
    an empty table gives no file.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    end = np.array([end_id], "<u2").tobytes()

    def tokenize(batches):
        # the last rows of a task carry its counts of ids; rows are numbered in the order of all ranges
        pieces, total, last = encoder(path), np.zeros(1 << 16, np.int64), None
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            if not len(batch):
                continue
            ids = [x + end for x in pieces.encode(batch.column(1).to_pylist())]
            for i in range(0, len(ids), 500):
                total += np.bincount(np.frombuffer(b"".join(ids[i : i + 500]), "<u2"), minlength=1 << 16)
            if last:
                yield pa.RecordBatch.from_arrays([*last, pa.nulls(len(last[0]), pa.binary())], ["row", "doc_id", "ids", "h"])
            last = pa.array(range(row, row + len(ids)), pa.int64()), batch.column(0), pa.array(ids, pa.binary())
            row += len(ids)
        if last:
            counts = [zlib.compress(total.tobytes(), 1)] + [None] * (len(last[0]) - 1)
            yield pa.RecordBatch.from_arrays([*last, pa.array(counts, pa.binary())], ["row", "doc_id", "ids", "h"])

    texts = docs.select("doc_id", "text")
    ranges = max(2, 2 * texts.rdd.getNumPartitions())
    ordered = texts.repartitionByRange(ranges, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    tokens = staged(ordered.mapInArrow(tokenize, "row long, doc_id long, ids binary, h binary"), "tokens")
    del ordered
    release_shuffles(spark)
    freq = frequency_table(tokens.where("h IS NOT NULL").select("h"))
    packed = packed_table(freq)

    def write(batches):
        coder = Coder(freq)
        held: list[bytes] = []
        docs_held: list[tuple[int | None, int]] = []
        size, first, following = 0, 0, 0

        def flush():
            store, where = _opened(folder)
            store.create_dir(where)
            raw = to_bytes(coder, packed, docs_held, np.frombuffer(b"".join(held), "<u2"))
            name = f"{where}/{uuid.uuid4().hex}"
            with store.open_output_stream(f"{name}.tmp") as f:
                f.write(raw)
            store.move(f"{name}.tmp", f"{name}.rans")
            row = [[first], [docs_held[0][0]], [f"{folder}/{name.rpartition('/')[2]}.rans"], [len(docs_held)], [size], [len(raw)], [zlib.crc32(raw)]]
            held.clear()
            docs_held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["first_row", "first_doc", "path", "n_docs", "n_tokens", "n_bytes", "crc32"])

        for batch in batches:
            for row, doc, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # a task can get parts of several ranges, in any order and with others between them
                if docs_held and (size >= file_tokens or row != following):
                    yield flush()
                    size = 0
                if not docs_held:
                    first = row
                following = row + 1
                held.append(ids)
                docs_held.append((doc, len(ids) // 2))
                size += len(ids) // 2
        if docs_held:
            yield flush()

    return staged(tokens.select("row", "doc_id", "ids").mapInArrow(write, "first_row long, first_doc long, path string, n_docs long, n_tokens long, n_bytes long, crc32 long"), "manifest")


def read_tokens(spark: SparkSession, manifest: DataFrame, part_tokens: int = 2_000_000, then: Callable | None = None, schema: str = SCHEMA) -> DataFrame:
    """Documents of the files of a manifest: doc_id, ids (little-endian unsigned 16-bit), start (ids of all documents before it).

    A file of more than ``part_tokens`` ids is read by several tasks: each takes the documents that begin in its part, reads the
    header and the blocks that these need, and decodes from the checkpoint before them on. Every stretch is checked against its CRC-32;
    a file read as a whole also against that of the manifest. ``then`` takes the batches of documents on to ``schema`` in the process
    that reads them; a mapInArrow behind this one would start a second process for each task and send it all ids.
    """
    w = Window.orderBy("first_row").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("path", "crc32", F.coalesce(F.sum("n_tokens").over(w), F.lit(0)).alias("base"), F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / part_tokens)).cast("int").alias("parts"))
    files = files.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def read(batches):
        coders: dict[str, Coder] = {}
        for batch in batches:
            for path, crc, base, parts, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, where = _opened(path)
                with store.open_input_file(where) as f:
                    if parts == 1:
                        raw = f.read()
                        if zlib.crc32(raw) != crc:
                            raise ValueError(f"{path} is damaged")
                        found = from_bytes(raw, coders)
                    else:
                        first = f.read(12)
                        head, begin = header(first + f.read(int.from_bytes(first[8:12], "little")))

                        def block(at, size, f=f, begin=begin):
                            f.seek(begin + at)
                            return f.read(size)

                        found = _documents(head, block, coders, part * part_tokens, (part + 1) * part_tokens if part + 1 < parts else None)
                    rows = []
                    for doc, at, ids in found:
                        rows.append((doc, base + at, ids.astype("<u2").tobytes()))
                        if len(rows) >= 1000:
                            yield _rows(rows)
                            rows = []
                    if rows:
                        yield _rows(rows)

    n = max(1, spark.sparkContext.defaultParallelism * 4)
    return files.repartition(n).mapInArrow((lambda batches: then(read(batches))) if then else read, schema)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "start", "ids"])


def tokens_round_trip(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, then: Callable | None = None, schema: str = SCHEMA) -> DataFrame:
    """Write the token files of ``docs`` into the shared folder and read them back; ``then`` and ``schema`` as in ``read_tokens``."""
    spark = docs.sparkSession
    manifest = write_tokens(docs, new_folder(spark, "files"), tokenizer, end_id)
    return read_tokens(spark, manifest, then=then, schema=schema)
