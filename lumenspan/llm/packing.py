"""Cost-balanced packing of documents into training sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .base import bounded_batches
from .tokens import pieces as encoder

SCHEMA = "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(lengths: np.ndarray, capacity: int = 2048, linear: float = 1.0, quadratic: float = 1 / 2048) -> Iterator[tuple[int, int, int, int, int]]:
    """Assign documents of these token counts to sequences; yields (document, start, length, sequence, offset).

    A document's full ``capacity`` runs are sequences of their own. What is left of each, in descending order of its
    cost ``linear * n + quadratic * n**2``, goes to the sequence of lowest cost that has room for it; there are as many
    as the rest fills. If none has room, the lowest-cost one that isn't full takes what fits and the other part goes on.
    Tokens beyond those sequences make sequences whose lengths are powers of two, so nothing is padded.
    """
    sequence, rest = 0, []
    for d, n in enumerate(lengths.tolist()):
        for start in range(0, n - capacity + 1, capacity):
            yield d, start, capacity, sequence, 0
            sequence += 1
        if n % capacity:
            rest.append((n % capacity, d, n - n % capacity))
    rest.sort(key=lambda x: (-x[0], x[1]))
    total = sum(x[0] for x in rest)
    k = total // capacity
    cost, room, over = np.zeros(k), np.full(k, capacity), []
    for n, d, start in rest:
        while n:
            fits = np.where(room >= n, cost, np.inf) if k else cost
            at = int(fits.argmin()) if k else -1
            if at < 0 or fits[at] == np.inf:
                fits = np.where(room > 0, cost, np.inf) if k else cost
                at = int(fits.argmin()) if k else -1
            if at < 0 or fits[at] == np.inf:
                over.append((n, d, start))
                break
            part = min(n, int(room[at]))
            yield d, start, part, sequence + at, capacity - int(room[at])
            cost[at] += linear * part + quadratic * part * part
            room[at] -= part
            n, start = n - part, start + part
    sequence += k
    left = total - k * capacity
    size = 1 << left.bit_length() >> 1
    offset = 0
    for n, d, start in over:
        while n:
            while not left & size:
                size >>= 1
            part = min(n, size - offset)
            yield d, start, part, sequence, offset
            n, start, offset = n - part, start + part, offset + part
            if offset == size:
                left, offset, sequence = left - size, 0, sequence + 1


def pack_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, capacity: int = 2048, linear: float = 1.0, quadratic: float = 1 / 2048, group_tokens: int = 1_000_000) -> DataFrame:
    """Tokenize ``doc_id, text`` and pack it: a row for each piece, with its ids as little-endian unsigned 16-bit numbers.

    Each task packs groups of documents of about ``group_tokens`` tokens, a bound on its memory; there is no shuffle.
    Null text counts as empty and gives the end id alone; a null doc_id stays null; repeated rows are packed each;
    other columns are ignored; an empty table gives no rows. Equal lengths go in the order of the rows, and sequences are
    numbered by the task, so the input should be a stored table (the query's and the pipeline's are): its partitions hold the
    same rows in the same order when a task runs again.
    """
    bounded_batches(docs.sparkSession)
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    end = np.array([end_id], "<u2").tobytes()

    def run(batches):
        pieces, at = encoder(path), (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        held: list[tuple[int | None, bytes]] = []
        size = 0

        def flush():
            nonlocal at
            counts = np.array([len(x) // 2 for _, x in held], np.int64)
            out, last = [], -1
            for d, start, length, seq, offset in pack(counts, capacity, linear, quadratic):
                ids = held[d][1][2 * start : 2 * (start + length)]
                out.append((held[d][0], start, length, ids, zlib.crc32(np.frombuffer(ids, "<u2").astype("<u4").tobytes()), int(counts[d]), at + seq, offset))
                last = max(last, seq)
            at += last + 1
            held.clear()
            for i in range(0, len(out), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 2000], strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            doc, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for d, ids in zip(doc, pieces.encode(texts), strict=True):
                held.append((d, ids + end))
                size += len(ids) // 2 + 1
                if size >= group_tokens:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
