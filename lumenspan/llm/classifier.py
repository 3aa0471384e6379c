"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network in numpy.

The word vectors are sums over all documents, made in the tasks that read them; only the network learns from labels, on a
bounded sample of documents whose features are made where they are read. It is trained in one task, so the driver gets
the vectors (4 MB) and the network (15 KB), whatever the input.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import STEP_BYTES, bounded_batches, cleared, fresh, mixed, span_hashes, staged, steps, utf8, word_spans

#: Rows of the vector table (forms of words share them by hash) and length of a vector.
BUCKETS, DIM = 1 << 15, 32
#: The three forms of a word: all of it, its first and its last three bytes.
FORMS = 3
WIDTH = FORMS * (DIM + 2) + 1
#: The table's sums are merged in so many ranges of rows, each in so many parts first.
RANGES, PARTS = 8, 4
_ROWS = BUCKETS // RANGES
_SUM = np.dtype([("row", "<u2"), ("count", "<i8"), ("total", "<i8", (DIM,))])


def index_entries(seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Sparse ternary index vectors: for each row four dimensions and a sign for each."""
    rng = np.random.Generator(np.random.PCG64(seed))
    at = rng.integers(0, DIM, (BUCKETS, 4))
    return at, np.stack([rng.choice([-1.0, 1.0], BUCKETS) for _ in range(4)], 1)


def index_vectors() -> np.ndarray:
    at, sign = index_entries()
    out = np.zeros((BUCKETS, DIM), np.float32)
    for k in range(4):
        out[np.arange(BUCKETS), at[:, k]] += sign[:, k]
    return out


def forms(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Table rows of each word in its three forms, and how many words lie before each document."""
    if len(data) == 0:
        return [np.zeros(0, np.int32)] * FORMS, np.zeros(len(offsets), np.int64)
    s, e = word_spans(data, offsets)
    out = []
    for salt, (a, b) in enumerate(((s, e), (s, np.minimum(e, s + 3)), (np.maximum(s, e - 3), e))):
        out.append((mixed(span_hashes(data, a, b) + np.uint64(salt)) % np.uint64(BUCKETS)).astype(np.int32))
    return out, np.searchsorted(s, offsets)


class Contexts:
    """Sums of the index vectors of the words up to two places away, for each form. They are whole numbers, so the order of adding doesn't matter."""

    def __init__(self):
        self.at, self.sign = index_entries()
        self.total, self.count = np.zeros(BUCKETS * DIM), np.zeros(BUCKETS, np.int64)

    def add(self, data: np.ndarray, offsets: np.ndarray) -> None:
        for first, last in steps(offsets):
            part = offsets[first : last + 1]
            rows, at = forms(data[part[0] : part[-1]], part - part[0])
            doc = np.repeat(np.arange(last - first), np.diff(at))
            for a in range(0, len(doc), STEP_BYTES // 8):
                # two more words on, so that pairs over the border of a piece are met once
                stop = min(len(doc), a + STEP_BYTES // 8)
                own, other = [], []
                for gap in (1, 2):
                    i = np.arange(a, min(stop, len(doc) - gap))
                    i = i[doc[i] == doc[i + gap]]
                    own += [i, i + gap]
                    other += [i + gap, i]
                beside = rows[0][np.concatenate(other)]
                where, weight = self.at[beside], self.sign[beside].ravel()
                own = np.concatenate(own)
                for form in rows:
                    row = form[own]
                    self.count += np.bincount(row, minlength=BUCKETS)
                    self.total += np.bincount((row[:, None] * DIM + where).ravel(), weight, BUCKETS * DIM)

    def packed(self):
        """(range, rows that occur) of the table."""
        total = self.total.reshape(BUCKETS, DIM)
        for k in range(RANGES):
            own = np.flatnonzero(self.count[k * _ROWS : (k + 1) * _ROWS])
            if len(own):
                out = np.empty(len(own), _SUM)
                out["row"], out["count"], out["total"] = own, self.count[k * _ROWS + own], total[k * _ROWS + own]
                yield k, out.tobytes()


def _merged(final: bool):
    """Adds up packed rows of a range; at last it makes vectors of them."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                rows = np.frombuffer(raw.as_buffer(), _SUM)
                own = sums.setdefault(k, np.zeros((_ROWS, DIM + 1), np.int64))
                own[rows["row"], 0] += rows["count"]
                own[rows["row"], 1:] += rows["total"]
        for k, own in sums.items():
            if final:
                raw = (index_vectors()[k * _ROWS : (k + 1) * _ROWS] + own[:, 1:] / np.maximum(own[:, :1], 1)).astype(np.float32).tobytes()
            else:
                at = np.flatnonzero(own[:, 0])
                out = np.empty(len(at), _SUM)
                out["row"], out["count"], out["total"] = at, own[at, 0], own[at, 1:]
                raw = out.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([0], pa.int32()), pa.array([raw], pa.binary())], ["k", "part", "rows"])

    return run


def learned_vectors(docs: DataFrame) -> np.ndarray:
    """Random indexing over all texts: a form's vector is its index vector plus the mean index vector of the words up to two places away."""

    def run(batches):
        cleared()
        table, part = Contexts(), TaskContext.get().partitionId() % PARTS
        for batch in batches:
            offsets, data = utf8(batch.column(0))
            table.add(data, offsets)
        for k, raw in table.packed():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part], pa.int32()), pa.array([raw], pa.binary())], ["k", "part", "rows"])

    bounded_batches(docs.sparkSession)
    schema = "k int, part int, rows binary"
    some = docs.select("text").mapInArrow(run, schema).repartitionById(RANGES * PARTS, (F.col("k") * PARTS + F.col("part")).cast("int")).mapInArrow(_merged(False), schema)
    ranges = some.repartitionById(RANGES, F.col("k")).mapInArrow(_merged(True), schema).collect()
    out = index_vectors()
    for r in ranges:
        out[r.k * _ROWS : (r.k + 1) * _ROWS] = np.frombuffer(r.rows, np.float32).reshape(_ROWS, DIM)
    return out


def pooled(data: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Per document and form: the mean vector, its length, and how often neighbours have the same vector; then the logarithm of the number of words."""
    rows, at = forms(data, offsets)
    n, words = len(offsets) - 1, np.diff(at)
    out = np.zeros((n, WIDTH), np.float32)
    full = np.flatnonzero(words)
    doc = np.repeat(np.arange(n), words)
    for k, form in enumerate(rows):
        if len(full):
            first = k * (DIM + 2)
            same = (form[:-1] == form[1:]) & (doc[:-1] == doc[1:])
            out[:, first + DIM + 1] = np.bincount(doc[:-1][same], minlength=n) / np.maximum(words - 1, 1)
            if len(form) <= STEP_BYTES:
                total = np.add.reduceat(vectors[form], at[:-1][full])
            else:  # a long text alone
                total = sum(vectors[form[a : a + STEP_BYTES]].sum(0, dtype=np.float64) for a in range(0, len(form), STEP_BYTES))[None]
            mean = total / words[full, None]
            out[full, first : first + DIM] = mean
            out[full, first + DIM] = np.linalg.norm(mean, axis=1)
    out[:, -1] = np.log1p(words)
    return out


@dataclass
class Model:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(self.logits(x) / self.temperature, -30, 30)
        return 1 / (1 + np.exp(-z.astype(np.float64)))


def trained(x: np.ndarray, labels: np.ndarray, vectors: np.ndarray, hidden: int = 32, epochs: int = 250, seed: int = 11) -> Model:
    """Fit on features with labels 0 and 1; every fifth is left out for the temperature. Without both labels, 0.5 for all or what there is."""
    rng = np.random.Generator(np.random.PCG64(seed))
    y = labels.astype(np.float32)
    mean, scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(WIDTH, np.float32), np.ones(WIDTH, np.float32))
    model = Model(vectors, mean, scale, rng.normal(0, WIDTH**-0.5, (WIDTH, hidden)).astype(np.float32), np.zeros(hidden, np.float32), np.zeros(hidden, np.float32), 0.0)
    if len(set(labels.tolist())) < 2:
        model.b2 = float(np.sign(y.mean() - 0.5) * 3) if len(y) else 0.0
        return model
    model.w2 = rng.normal(0, hidden**-0.5, hidden).astype(np.float32)
    held = np.arange(len(y)) % 5 == 0
    xt, yt = ((x - mean) / scale)[~held], y[~held]
    weight = np.where(yt == 1, 0.5 / max(yt.mean(), 1e-6), 0.5 / max(1 - yt.mean(), 1e-6))
    state = [np.zeros_like(p) for p in (model.w1, model.b1, model.w2, np.zeros(1, np.float32))]
    square = [s.copy() for s in state]
    b2, step = np.zeros(1, np.float32), 0
    for _ in range(epochs):
        order = rng.permutation(len(yt))
        for i in range(0, len(order), 256):
            at = order[i : i + 256]
            h = np.tanh(xt[at] @ model.w1 + model.b1)
            p = 1 / (1 + np.exp(-np.clip(h @ model.w2 + b2[0], -30, 30)))
            g = (p - yt[at]) * weight[at] / len(at)
            gh = np.outer(g, model.w2) * (1 - h * h)
            grads = (xt[at].T @ gh + 1e-4 * model.w1, gh.sum(0), h.T @ g + 1e-4 * model.w2, np.array([g.sum()]))
            step += 1
            for p_, g_, m, v in zip((model.w1, model.b1, model.w2, b2), grads, state, square, strict=True):
                m += 0.1 * (g_ - m)
                v += 0.001 * (g_ * g_ - v)
                p_ -= 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model.b2 = float(b2[0])
    z, yv = model.logits(x[held]), y[held]
    if len(yv):
        loss = lambda t: float(np.mean(np.logaddexp(0, np.where(yv == 1, -z, z) / t)))
        model.temperature = float(min(np.geomspace(0.25, 8, 60), key=loss))
    return model


def held_out(doc_id) -> F.Column:
    """Documents whose labels are never learned from: crc32 of doc_id as text modulo 3 is 1; a null doc_id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, rows: int = 5000) -> Model:
    """Word vectors from all of ``docs``; the network from at most ``rows`` labelled documents, whole whatever their length, picked by a hash of doc_id and not held out.

    ``rows`` bounds the training task. Labels that contradict each other for a document, and null labels, are left out; an
    empty table or no labels give a model that says 0.5 for all.
    """
    spark = docs.sparkSession
    vectors = learned_vectors(docs)
    shipped = spark.sparkContext.broadcast(vectors)
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("q2")).where("q = q2").select("doc_id", "q")
    order = F.md5(F.col("doc_id").cast("string"))
    picked = known.orderBy(order).limit(3 * rows)

    def features(batches):
        cleared()
        for batch in batches:
            offsets, data = utf8(batch.column(2))
            for a, b in steps(offsets, 1 << 18):
                part = offsets[a : b + 1]
                x = pooled(data[part[0] : part[-1]], part - part[0], shipped.value)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array([r.tobytes() for r in x], pa.binary())], ["turn", "q", "x"])

    def train(batches):
        x, y = [], []
        for batch in batches:
            x += [np.frombuffer(r, np.float32) for r in batch.column(2).to_pylist()]
            y += batch.column(1).to_pylist()
        model = trained(np.stack(x) if x else np.zeros((0, WIDTH), np.float32), np.array(y, np.int64), None)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    turn = F.concat_ws("-", order, F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select(turn.alias("turn"), F.col("q").cast("long").alias("q"), "text")
    sample = staged(texts.mapInArrow(features, "turn string, q long, x binary").orderBy("turn").limit(rows), "sample")
    made = sample.repartition(1).sortWithinPartitions("turn").mapInArrow(train, "model binary").collect()
    shipped.destroy()
    model = pickle.loads(made[0][0]) if made else trained(np.zeros((0, WIDTH), np.float32), np.zeros(0, np.int64), None)
    model.vectors = vectors
    return model


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score of each whole text: probability of good quality, 0 to 1.

    Null counts as empty; an empty text has the score of no words. Rows are scored each; other columns pass through; an
    empty table gives no rows; a column of ``docs`` called ``name`` gives way to the score. The model is of fixed size (about 4 MB)
    and goes with the task; Spark drops it when nothing refers to the result any more.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.drop(name)
    names = docs.columns
    shipped = spark.sparkContext.broadcast(model)

    def run(batches):
        cleared()
        m = shipped.value
        for batch in batches:
            offsets, data = utf8(batch.column(names.index("text")))
            for a, b in steps(offsets, 1 << 18):
                part = offsets[a : b + 1]
                value = m.scores(pooled(data[part[0] : part[-1]], part - part[0], m.vectors))
                yield pa.RecordBatch.from_arrays([*(c[a:b] for c in batch.columns), pa.array(value, pa.float64())], [*names, name])

    schema = type(docs.schema)(docs.schema.fields[:]).add(name, "double")
    return docs.mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``least`` (a score equal to it stays), with their columns, whatever these are called.

    Null text is scored as an empty one; repeated rows have the same score; an empty table gives no rows.
    """
    (score,) = fresh(docs.columns, "score")
    return scored(docs, fit(docs.select("doc_id", "text"), labels), score).where(F.col(score) >= least).drop(score)
