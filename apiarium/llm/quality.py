"""Quality classification: random-indexing word vectors and a two-layer network.

Every word has a sparse random index vector (by hash). The vector of a word bucket is the sum
of the index vectors of its neighbours and of its shape, over all rows given, normalised, with
its length (on a log scale, so how much the corpus knows of it) as one more number. A document
is the mean and the spread of its words' vectors and the mean product of neighbouring ones,
nothing else. A two-layer numpy network is trained on labelled documents, its probabilities
are calibrated by a temperature fitted on a part of them that training does not see.

Vectors come from all documents: each task adds up a BUCKETS x DIM table, tables are summed by
row in a shuffle (never on one task), and the finished table (BUCKETS * (DIM + 1) * 4 bytes,
fixed) is broadcast. Labelled rows are bounded by ``max_labelled`` (in expectation, a few per
cent more at most), chosen by a hash of doc_id.

Defined cases: null text is an empty text; an empty text has the zero vector and gets the
score that the network gives it; a doc_id without label trains nothing; repeated labels of a
doc_id count once, the larger one; without labels of both classes every score is the share
of label 1 (0.5 without labels); rows that repeat a doc_id are rows of their own; an empty
table gives an empty result; other columns are ignored, and passed through by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apiarium.llm import common, textcore
from apiarium.scratch import settle

BITS, DIM, ONES = 14, 32, 4
BUCKETS, WIDTH = 1 << BITS, DIM + 1
FEATURES = 3 * WIDTH

#: Byte classes for a word's shape: letters (with all non-ASCII), capitals, digits, other.
_CLASS = np.full(256, 3, dtype=np.uint8)
_CLASS[97:123] = _CLASS[128:] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2


def _tokens(data: np.ndarray, off: np.ndarray):
    """Bucket, shape (0 to 255) and row of each word, with the word hashes."""
    s, e, row = textcore.words(data, off, textcore.SPACE_WORD)
    h = textcore.span_hashes(data, s, e)
    shape = np.zeros(len(s), dtype=np.int64)
    if len(s):
        kind = _CLASS[data]
        for c in range(4):
            sums = np.concatenate([[0], np.cumsum(kind == c, dtype=np.int32)])
            n = sums[e] - sums[s]
            shape |= (np.minimum(n, 3) << (2 * c)).astype(np.int64)
    return (h >> np.uint64(64 - BITS)).astype(np.int64), shape, row, h


def _index_places(x: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and sign of the j-th non-zero entry of the index vectors of ``x``."""
    m = textcore.mix(x.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019 * (j + 1) % 2**64))
    return (m >> np.uint64(59)).astype(np.int64), np.where(m & np.uint64(1), 1.0, -1.0)


def accumulate(table: np.ndarray, data: np.ndarray, off: np.ndarray) -> None:
    """Add to each word bucket the index vectors of its neighbours and its shape."""
    bucket, shape, row, h = _tokens(data, off)
    if not len(bucket):
        return
    same = row[1:] == row[:-1]
    sources = [(bucket, shape.astype(np.uint64) + np.uint64(1 << 40)), (bucket[1:][same], h[:-1][same]), (bucket[:-1][same], h[1:][same])]
    own = np.concatenate([x for x, _ in sources])
    other = np.concatenate([x for _, x in sources])
    for j in range(ONES):
        place, sign = _index_places(other, j)
        table += np.bincount(own * DIM + place, weights=sign, minlength=BUCKETS * DIM)


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = np.zeros(BUCKETS * DIM)
    for batch in batches:
        for _, _, data, off in textcore.blocks(batch.column(0), 1 << 20):
            accumulate(table, data, off)
    rows = table.reshape(BUCKETS, DIM)
    some = np.flatnonzero(rows.any(axis=1))
    flat = pa.array(rows[some].ravel().astype(np.float32))
    ends = pa.array(np.arange(len(some) + 1, dtype=np.int32) * DIM)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.ListArray.from_arrays(ends, flat)], names=["bucket", "v"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The normalised BUCKETS x DIM table over all rows, with a column of lengths."""
    parts = docs.select("text").mapInArrow(textcore.tidy(_tables), "bucket long, v array<float>")
    sums = [F.sum(F.col("v")[j]).alias(f"v{j}") for j in range(DIM)]
    table = np.zeros((BUCKETS, DIM), dtype=np.float32)
    got = parts.groupBy("bucket").agg(*sums).toArrow()
    rows = got["bucket"].to_numpy()
    for j in range(DIM):
        table[rows, j] = got[f"v{j}"].to_numpy()
    length = np.linalg.norm(table, axis=1, keepdims=True)
    return np.column_stack([table / np.maximum(length, 1e-9), np.log1p(length) / 10]).astype(np.float32)


def features(table: np.ndarray, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The pooled vectors of each row."""
    n = len(off) - 1
    bucket, _, row, _ = _tokens(data, off)
    out = np.zeros((n, FEATURES))
    bounds = textcore.row_bounds(row, n)
    for a in range(0, n, 64):
        rows = np.arange(a, min(a + 64, n))
        rows = rows[bounds[rows + 1] > bounds[rows]]
        if not len(rows):
            continue
        lo, hi = bounds[rows[0]], bounds[rows[-1] + 1]
        v = table[bucket[lo:hi]]
        start, words = bounds[rows] - lo, (bounds[rows + 1] - bounds[rows])[:, None]
        mean = np.add.reduceat(v, start, axis=0, dtype=np.float64) / words
        square = np.add.reduceat(v * v, start, axis=0, dtype=np.float64) / words
        pairs = np.zeros_like(v)
        pairs[:-1] = v[1:] * v[:-1]
        pairs[np.append(start[1:], len(v)) - 1] = 0  # a row's last word has no neighbour after it
        near = np.add.reduceat(pairs, start, axis=0, dtype=np.float64) / np.maximum(words - 1, 1)
        out[rows] = np.column_stack([mean, np.sqrt(np.maximum(square - mean * mean, 0)), near])
    return out


class Network:
    """tanh layer and a logistic unit, trained by Adam on standardised features."""

    def __init__(self, width: int = 24, seed: int = 5):
        self.width, self.seed, self.temperature, self.constant = width, seed, 1.0, 0.5

    def fit(self, x: np.ndarray, y: np.ndarray, *, epochs: int = 60, batch: int = 256) -> Network:
        if not len(y) or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.5
            self.w1 = None
            return self
        rng = np.random.default_rng(self.seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        x = (x - self.mean) / self.scale
        order = rng.permutation(len(y))
        held, kept = order[: len(y) // 5], order[len(y) // 5 :]
        self.w1 = rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], self.width))
        self.b1, self.w2, self.b2 = np.zeros(self.width), rng.normal(0, 0.3, self.width), np.zeros(1)
        params = [self.w1, self.b1, self.w2, self.b2]
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            rng.shuffle(kept)
            for i in range(0, len(kept), batch):
                p = kept[i : i + batch]
                hidden = np.tanh(x[p] @ self.w1 + self.b1)
                err = (1 / (1 + np.exp(-(hidden @ self.w2 + self.b2))) - y[p]) / len(p)
                back = np.outer(err, self.w2) * (1 - hidden**2)
                grads = [x[p].T @ back + 1e-4 * self.w1, back.sum(axis=0), hidden.T @ err + 1e-4 * self.w2, err.sum(keepdims=True)]
                t += 1
                for q, g, mm, vv in zip(params, grads, m, v, strict=True):
                    mm += 0.1 * (g - mm)
                    vv += 0.001 * (g * g - vv)
                    q -= 0.01 * (mm / (1 - 0.9**t)) / (np.sqrt(vv / (1 - 0.999**t)) + 1e-8)
        z = self._logit(x[held])
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
        loss = [np.logaddexp(0, -(2 * y[held] - 1) * z / g).mean() for g in grid]
        self.temperature = float(grid[int(np.argmin(loss))])
        return self

    def _logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.w1 is None:
            return np.full(len(x), self.constant)
        z = np.clip(self._logit((x - self.mean) / self.scale) / self.temperature, -500, 500)
        return 1 / (1 + np.exp(-z))


class Model:
    def __init__(self, table: np.ndarray, net: Network):
        self.table, self.net = table, net


def _features(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in textcore.blocks(batch.column(1)):
                x = features(shared.value, data, off)
                ends = pa.array(np.arange(j - i + 1, dtype=np.int32) * FEATURES)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(ends, pa.array(x.ravel().astype(np.float32)))], names=["label", "x"])

    return textcore.tidy(run)


def fit(docs: DataFrame, labelled: DataFrame, *, label: str = "quality", max_labelled: int = 20_000, seed: int = 5) -> Model:
    """``docs``: all rows, for the word vectors; ``labelled``: (doc_id, label) rows to learn from."""
    table = word_vectors(docs)
    labelled = labelled.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    n = labelled.count()
    u = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) / (1 << 20)
    labelled = labelled.filter(u < min(1.0, max_labelled / max(n, 1)))
    shared = docs.sparkSession.sparkContext.broadcast(table)
    # the sample is bounded by max_labelled, so it goes to the texts, which stay where they are
    rows = docs.select("doc_id", "text").join(F.broadcast(labelled), "doc_id").select(F.col("label").cast("double"), "text")
    got = rows.mapInArrow(_features(shared), "label double, x array<float>").toArrow()
    shared.destroy()
    y = got["label"].to_numpy()
    x = got["x"].combine_chunks().flatten().to_numpy().reshape(-1, FEATURES) if len(y) else np.zeros((0, FEATURES))
    order = np.lexsort((*x.T[:8], y)) if len(y) else np.zeros(0, np.int64)  # the same rows in the same order, however they came
    net = Network(seed=seed).fit(x[order], y[order])
    del got, x
    settle(docs.sparkSession)
    return Model(table, net)


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for i, j, data, off in textcore.blocks(batch.column(1)):
                p = model.net.probability(features(model.table, data, off))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(p)], names=["doc_id", "score"])

    return textcore.tidy(run)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and the probability of label 1 for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_score(shared), "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """``docs`` without the documents that score below the threshold; same columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for i, j, data, off in textcore.blocks(batch.column(at)):
                p = shared.value.net.probability(features(shared.value.table, data, off))
                yield batch.slice(i, j - i).filter(pa.array(p >= threshold))

    return docs.select(*common.columns(docs)).mapInArrow(textcore.tidy(run), docs.schema)
