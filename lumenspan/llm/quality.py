"""Quality rules with adaptive thresholds from quantile sketches per language and source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import SPACE, bounded_batches, cleared, mixed, span_hashes, staged, steps, utf8, word_spans

METRICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
#: Bytes that begin a character of a word.
_LEADS = ((np.arange(256) & 0xC0) != 0x80) & ~SPACE


def _counted(flag: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each document have the flag; a document alone, which may be long, without sums at every byte."""
    if len(offsets) == 2:
        return np.array([np.count_nonzero(flag)])
    sums = np.concatenate([[0], np.cumsum(flag)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def measured(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The metrics of concatenated documents (UTF-8 bytes), five arrays with a value for each document."""
    n = len(offsets) - 1
    if len(data) == 0:
        yield from (np.zeros(n, np.int64) for _ in range(5))
        return
    s, e = word_spans(data, offsets)
    at = np.searchsorted(s, offsets)
    words = np.diff(at)
    hashes = mixed(span_hashes(data, s, e))
    doc = np.repeat(np.arange(n), words)
    # lines: cut at line feeds and at the ends of documents
    cut = data == 10
    begins = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], np.flatnonzero(cut) + 1]))
    begins = begins[begins < len(data)]
    owner = np.searchsorted(offsets, begins, "right") - 1
    ends = np.minimum(np.append(begins[1:], len(data)), offsets[owner + 1])
    ends = ends - (cut[ends - 1] & (ends > begins))
    spoken = np.searchsorted(s, ends) > np.searchsorted(s, begins)
    lines = mixed(span_hashes(data, begins[spoken], ends[spoken]))
    owner = owner[spoken]
    # windows of three words inside a document
    m = len(s)
    if m >= 3:
        inside = doc[:-2] == doc[2:]
        w = mixed(mixed(hashes[:-2] * np.uint64(0xD1342543DE82EF95) + hashes[1:-1]) * np.uint64(0xD1342543DE82EF95) + hashes[2:])
        first = np.flatnonzero(inside)
        again = _recurs(w[first], doc[first])
        hit = np.zeros(m + 1, np.int64)
        np.add.at(hit, first[again], 1)
        np.add.at(hit, first[again] + 3, -1)
        covered = np.cumsum(hit[:-1]) > 0
    else:
        covered = np.zeros(m, bool)
    yield words
    yield _counted(_LEADS[data], offsets)
    yield _counted(_SYMBOL[data], offsets)
    yield np.bincount(owner[_later(lines, owner)], minlength=n)
    yield np.bincount(doc[covered], minlength=n)


def _order(value: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((value, doc))
    same = np.zeros(len(order), bool)
    if len(order) > 1:
        same[1:] = (value[order[1:]] == value[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    return order, same


def _later(value: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """All but one of the equal values of a document."""
    order, same = _order(value, doc)
    return order[same]


def _recurs(value: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """All values that a document has twice or more."""
    order, same = _order(value, doc)
    both = same.copy()
    both[:-1] |= same[1:]
    return order[both]


def metrics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and METRICS of each whole text; null counts as a text without words."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        cleared()
        for batch in batches:
            offsets, data = utf8(batch.column(3))
            for a, b in steps(offsets):
                part = offsets[a : b + 1]
                values = [pa.array(x, pa.int64()) for x in measured(data[part[0] : part[-1]], part - part[0])]
                yield pa.RecordBatch.from_arrays([*(batch.column(i)[a:b] for i in range(3)), *values], ["doc_id", "lang", "source", *(x.split()[0] for x in METRICS.split(", "))])

    picked = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text"))
    return picked.mapInArrow(run, f"doc_id long, lang string, source string, {METRICS}")


def rates() -> dict[str, Column]:
    """What the thresholds hold: each is large in a bad document."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbol_rate": F.col("n_symbols") / words,
        "dup_line_rate": F.col("n_dup_lines") / words,
        "repeat_rate": F.col("n_repeat_words") / words,
        "long_word_rate": F.col("word_chars") / words,
    }


#: Least distance from the upper quartile to a threshold, so that a metric that hardly varies doesn't reject clean documents.
FLOORS = {"symbol_rate": 0.1, "dup_line_rate": 0.02, "repeat_rate": 0.25, "long_word_rate": 4.0}


def judged(docs: DataFrame, spread: float = 6.0, accuracy: int = 2000) -> DataFrame:
    """Metrics, ``base_failed`` and ``kept`` for each document of ``doc_id, text, lang, source``.

    Base rule: fewer than 50 words, or more than half of the words in repeated three-word windows. A document that
    passes is kept unless one of its rates is above the threshold of its language and source: the upper quartile plus
    ``spread`` times the distance between the quartiles (at least FLOORS). The quartiles come from mergeable quantile
    sketches over all documents that pass the base rule; every task summarises what it has read, so that a group with
    a third of all rows costs no more than others.

    Null text has no words and fails; texts of any length are measured as a whole, in pieces of bounded memory beside a few
    numbers for each of their words; a rate that equals its threshold is kept; null lang and null source are groups of their own; null doc_ids and repeated
    rows are judged each; other columns are ignored; an empty table gives no rows.
    """
    m = metrics(docs)
    n = F.col("n_words")
    m = m.withColumn("base_failed", (n < 50) | (100 * F.col("n_repeat_words") > 50 * n)).withColumns(rates())
    m = staged(m.withColumn("group", F.concat_ws("\x1f", *(F.when(F.col(c).isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(c))) for c in ("lang", "source")))), "metrics")
    sketch = m.where("NOT base_failed").groupBy("group").agg(*(F.percentile_approx(c, [0.25, 0.75], accuracy).alias(f"q_{c}") for c in FLOORS))
    limits = sketch.select("group", *((F.col(f"q_{c}")[1] + F.greatest(spread * (F.col(f"q_{c}")[1] - F.col(f"q_{c}")[0]), F.lit(floor))).alias(f"most_{c}") for c, floor in FLOORS.items()))
    out = m.join(staged(limits, "limits"), "group", "left")
    high = None
    for c in FLOORS:
        over = F.coalesce(F.col(c) > F.col(f"most_{c}"), F.lit(False))
        high = over if high is None else high | over
    return out.withColumn("kept", ~F.col("base_failed") & ~high).drop("group")
