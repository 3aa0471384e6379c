"""What the corpus operators share: staged tables, bounded Arrow batches, byte-level words."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Input bytes that one numpy step handles at a time; its temporaries are about 60 times as large.
STEP_BYTES = 1 << 20
#: Bounds of an Arrow batch between the JVM and Python.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, so that long texts do not add up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. In local mode, where they are one process, an own one if it is unset; an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir isn't set: it names the folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='lumenspan-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is removed when the application ends."""
    path = f"{shared_dir(spark)}/lumenspan-{uuid.uuid4().hex}/{name}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at.getParent())
    return path


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete staged folders that are not read again."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def staged(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path, schema = new_folder(spark, name), df.schema
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.staged_at = path
    return out


def fresh(names: Iterable[str], *wanted: str) -> list[str]:
    """Names for helper columns that no column of a table has, whatever the case of its letters."""
    taken, out = {n.lower() for n in names}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that nothing holds any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cleared() -> None:
    """Called at the start of a task that runs Python: a worker is used again, and what other operators kept in it goes."""
    from . import tokens

    tokens.forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a string or binary array without copying; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return at - at[0], raw[at[0] : at[-1]]


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes together; a longer row stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_RNG = np.random.Generator(np.random.PCG64(20240131))
_BASE, _INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TABLE = _RNG.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _TABLE.copy()
_FOLDED[65:91] = _TABLE[97:123]
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash's base and of its inverse modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, STEP_BYTES + 4096)
        for key, value in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, value, np.uint64)
            p[0] = 1
            _POWERS[key] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def prefix_hash(data: np.ndarray, fold: bool = False) -> np.ndarray:
    """Prefix sums c with which (c[e] - c[s]) * down[s] is a hash of bytes s to e, wherever they stand."""
    c = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_FOLDED if fold else _TABLE)[data] * powers(len(data))[0], out=c[1:])
    return c


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` in concatenated documents; words end with their document."""
    n = len(data)
    space = SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    word = ~space
    begins, ends = word.copy(), np.zeros(n + 1, bool)
    begins[1:] &= space[:-1] | cut[1:n]
    ends[1:] = word
    ends[1:n] &= space[1:] | cut[1:n]
    return np.flatnonzero(begins), np.flatnonzero(ends)


def long_hash(data: np.ndarray, fold: bool = False) -> np.uint64:
    """The hash of one span of any length, summed piece by piece; as span_hashes has it."""
    total = 0
    for a in range(0, len(data), STEP_BYTES):
        piece = data[a : a + STEP_BYTES]
        part = int(((_FOLDED if fold else _TABLE)[piece] * powers(len(piece))[0]).sum())
        total += part * pow(int(_BASE), a, 1 << 64)
    return np.uint64(total % (1 << 64))


def span_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, fold: bool = False) -> np.ndarray:
    """64-bit hashes (to be mixed) of the bytes from s to e, both in rising order. Long data is taken in pieces of STEP_BYTES, and a span longer than that by itself."""
    if len(data) <= 2 * STEP_BYTES:
        c = prefix_hash(data, fold)
        return (c[e] - c[s]) * powers(len(data))[1][s] if len(data) else np.zeros(len(s), np.uint64)
    out, i = np.zeros(len(s), np.uint64), 0
    while i < len(s):
        a = int(s[i])
        j = max(i + 1, int(np.searchsorted(e, a + STEP_BYTES, "right")))
        if j == i + 1:
            out[i] = long_hash(data[a : e[i]], fold)
        else:
            own = data[a : int(e[j - 1])]
            c = prefix_hash(own, fold)
            out[i:j] = (c[e[i:j] - a] - c[s[i:j] - a]) * powers(len(own))[1][s[i:j] - a]
        i = j
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words, and how many words lie before each document (n + 1)."""
    if len(data) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    s, e = word_spans(data, offsets)
    return mixed(span_hashes(data, s, e, fold)), np.searchsorted(s, offsets)


def shingle_hashes(words: np.ndarray, at: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """The distinct n-word shingles of each document as sorted 64-bit hashes; fewer words count as one shingle."""
    m = len(words)
    run = words.copy()
    for k in range(1, n):
        run = run[: max(0, m - k)]
        run = mixed(run * np.uint64(0xD1342543DE82EF95) + words[k:])
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= n:
            yield np.unique(run[a : b - n + 1])
        elif b > a:
            h = np.uint64(b - a)
            for w in words[a:b]:
                h = mixed(np.array([h]) * np.uint64(0xD1342543DE82EF95) + w)[0]
            yield np.array([h], np.uint64)
        else:
            yield np.zeros(0, np.uint64)
