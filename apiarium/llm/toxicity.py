"""Toxicity by compression distance.

The dictionaries hold words rather than whole texts, and zstandard does not train them:
those that it trains on texts do worse by far (figures in the README).

Two zstandard dictionaries are made: one of ordinary text, one of toxic text, which is the
same common language with what toxic documents have of their own. A text is cut into short
windows of whole words, twice with a shift of half a window; each window is compressed with
either dictionary. Where the toxic dictionary saves bytes, the window repeats toxic text. The
savings of a document's windows (largest ones, how many pass each threshold) give the score
through a logistic calibration on labelled rows that its dictionaries have not seen; the
dictionaries of the finished model then come from all rows of the sample.

A word is toxic text if toxic documents have it, each counted once, and, for the size of
either class, ordinary ones hardly do. Counted are the different words before or after the
first place, whichever are more: that keeps out what is frequent by copies or within one
document, and keeps both words of a fixed phrase. Beginnings of
words are judged alike, by all words that have them, and bring those words along. Both dictionaries place common words
at the same distance, so that they differ by the toxic words alone.

``per_class`` labelled rows of each class, about, make the dictionaries and as many calibrate
(of few rows, 65 and 35 per cent); they are chosen by a hash of doc_id. Words in a dictionary
are bounded by ``common``, ``near`` and ``specific``.

Defined cases: null text is empty; text without a letter has no window and gets the score of
zero savings; repeated labels of a doc_id count once, the larger one; without labels of both
classes the score is the share of label 1 (0 without labels); a word longer than a window is
a window of its own; repeated rows score alike; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apiarium.llm import textcore
from apiarium.scratch import materialize

WINDOW = 48
HEAD = 7
FEATURES = 14
#: Letters stay (lower-cased, non-ASCII bytes as they are), every other byte is a space.
FOLD = np.full(256, 32, dtype=np.uint8)
FOLD[97:123] = FOLD[65:91] = np.arange(97, 123)
FOLD[128:] = np.arange(128, 256)
IS_LETTER = FOLD != 32


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_LAZY, min_match=4, window_log=17, hash_log=15, chain_log=15, search_log=5, write_content_size=0, write_dict_id=0, write_checksum=0)
    made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    made.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=made, compression_params=params)


def spelled(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Folded text with the first ``HEAD`` letters of each word as capitals, so that the end of one word is no match for the beginning of another."""
    edge = np.zeros(len(data) + 1, dtype=np.int8)
    np.add.at(edge, s, 1)
    np.add.at(edge, np.minimum(e, s + HEAD), -1)
    out = FOLD[data]
    out[(np.cumsum(edge[:-1]) > 0) & (out >= 97) & (out <= 122)] -= 32
    return out


def _listed(words: list[str]) -> bytes:
    data = np.frombuffer((" " + " ".join(words) + " ").encode(), dtype=np.uint8)
    s, e, _ = textcore.words(data, np.array([0, len(data)]), IS_LETTER)
    return spelled(data, s, e).tobytes()


def dictionaries(common: list[str], specific: list[str]) -> tuple[bytes, bytes]:
    """Contents of the ordinary and the toxic dictionary; the most frequent words last, where matches are cheapest."""
    base, toxic = _listed(common), _listed(specific)
    # what stands for the toxic words in the other dictionary matches no text; the last bytes of a dictionary are never found
    blank = np.random.default_rng(1).integers(1, 9, len(toxic)).astype(np.uint8).tobytes()
    end = bytes([1, 2, 3, 4, 5, 6, 7, 8] * 2)
    return base + blank + end, base + toxic + end


def windows(s: np.ndarray, e: np.ndarray, row: np.ndarray, off: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and row of windows of words over b' ' + folded data + b' '; each begins and ends with a space."""
    if not len(s):
        return s, s, s
    cell = (s - off[row] + shift) // WINDOW
    first = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (row[1:] != row[:-1])]))
    last = np.concatenate([first[1:] - 1, [len(s) - 1]])
    return s[first], e[last] - s[first] + 2, row[first]


class Compressors:
    def __init__(self, contents: tuple[bytes, bytes]):
        self.contents, self.made = contents, None

    def __getstate__(self):
        return {"contents": self.contents, "made": None}

    def savings(self, data: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(row, bytes that the toxic dictionary saves) of the windows, for both cuts."""
        if self.made is None:
            self.made = tuple(map(_compressor, self.contents))
        folded = np.full(len(data) + 2, 32, dtype=np.uint8)
        s, e, rows = textcore.words(data, off, IS_LETTER)
        folded[1:-1] = spelled(data, s, e)
        text, out = folded.tobytes(), []
        for shift in (0, WINDOW // 2):
            start, size, row = windows(s, e, rows, off, shift)
            if not len(start):
                out.append((row, np.zeros(0, np.int64)))
                continue
            cuts = np.stack([start, size], axis=1).astype(np.uint64).tobytes()
            sizes = []
            for c in self.made:
                got = c.multi_compress_to_buffer(zstandard.BufferWithSegments(text, cuts), threads=0)
                sizes.append(np.fromiter((len(x) for x in got), dtype=np.int64, count=len(got)))
            out.append((row, sizes[0] - sizes[1]))
        return out

    def features(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        n = len(off) - 1
        out = np.zeros((n, FEATURES))
        for k, (row, gain) in enumerate(self.savings(data, off)):
            order = np.lexsort((-gain, row))
            row, gain = row[order], gain[order]
            bounds = textcore.row_bounds(row, n)
            total = np.diff(bounds)
            for j in range(2):  # the largest savings
                some = total > j
                out[some, 6 * k + j] = gain[bounds[:-1][some] + j]
            for j, least in enumerate((3, 4, 5, 6)):
                out[:, 6 * k + 2 + j] = np.log1p(np.bincount(row[gain >= least], minlength=n))
            out[:, 12] = np.log1p(total)
        # both cuts say the same: the larger and the smaller of each pair
        a, b = out[:, :6].copy(), out[:, 6:12].copy()
        out[:, :6], out[:, 6:12] = np.maximum(a, b), np.minimum(a, b)
        out[:, 13] = np.maximum(out[:, 0] - 4, 0) ** 2 / 4
        return out


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, side, next, label): each word of a document, once, with the words before and after its first place (0 at a border)."""
    for batch in batches:
        label = np.asarray(batch.column(0))
        for i, _, data, off in textcore.blocks(batch.column(1)):
            s, e, row = textcore.words(data, off, IS_LETTER)
            if not len(s):
                continue
            h = textcore.span_hashes(data, s, e)
            _, one = np.unique(textcore.mix(h + row.astype(np.uint64)), return_index=True)
            beside = []
            for at in (one - 1, one + 1):
                inside = (at >= 0) & (at < len(h))
                inside[inside] = row[at[inside]] == row[one[inside]]
                beside.append(np.where(inside, h[np.where(inside, at, 0)], np.uint64(0)).view(np.int64))
            kind = label[i + row[one]].astype(np.int32)
            text = FOLD[data].tobytes()
            names = pa.array([text[a:b].decode("utf-8", "replace") for a, b in zip(s[one], e[one], strict=True)], pa.string())
            for side in (0, 1):
                yield pa.RecordBatch.from_arrays([names, pa.array(np.full(len(one), side, np.int32)), pa.array(beside[side]), pa.array(kind)], names=["word", "side", "next", "label"])


class Model:
    def __init__(self, compressors: Compressors | None, mean=None, scale=None, weights=None, bounds=None, constant: float = 0.0):
        self.compressors, self.mean, self.scale, self.weights, self.bounds, self.constant = compressors, mean, scale, weights, bounds, constant

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(off) - 1, self.constant)
        # what lies beyond the rows of the calibration counts as the last of them: no extrapolation for very long texts
        x = (np.clip(self.compressors.features(data, off), *self.bounds) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[1:] + self.weights[0], -500, 500)))


def calibrate(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton's steps with a small ridge; ``w``: how many rows each row stands for."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    b = np.zeros(z.shape[1])
    ridge = np.full(len(b), 1.0)
    ridge[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        grad = z.T @ (w * (p - y)) + ridge * b
        step = np.linalg.solve((z * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(ridge), grad)
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, b


def _features(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in textcore.blocks(batch.column(1)):
                x = shared.value.features(data, off)
                ends = pa.array(np.arange(j - i + 1, dtype=np.int32) * FEATURES)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], names=["label", "x"])

    return textcore.tidy(run)


def learn(rows: DataFrame, *, common: int, near: int, specific: int) -> Compressors:
    """The two dictionaries from (label, text) rows."""
    pairs = rows.select("label", "text").mapInArrow(textcore.tidy(_words), "word string, side int, next long, label int").distinct()
    sides = pairs.groupBy("word", "side").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("o"))
    pairs = materialize(sides.groupBy("word").agg(F.max("t").alias("t"), F.max("o").alias("o")), "words")
    total = pairs.agg(F.sum("t"), F.sum("o")).first()
    odds = F.log((F.col("t") + 0.5) / (total[0] or 1)) - F.log((F.col("o") + 0.5) / (total[1] or 1))
    # so many that chance makes a word of either class appear in toxic documents alone once in 60,000 words
    share = (total[0] or 1) / ((total[0] or 0) + (total[1] or 0) + 1)
    least = max(4, math.ceil(11 / -math.log(share)))
    # the same of word beginnings, which all their words count for; a hundred times as many are tried, so twice the evidence
    begins = pairs.select("word", "t", "o", F.explode(F.transform(F.sequence(F.lit(4), F.greatest(F.length("word"), F.lit(4))), lambda n: F.substr("word", F.lit(1), n))).alias("begin")).filter(F.length("begin") >= 4)
    begins = begins.groupBy("begin").agg(F.sum("t").alias("t"), F.sum("o").alias("o")).filter((F.col("t") >= 2 * least) & (odds > 3))
    begins = [r["begin"] for r in begins.orderBy(F.desc("t"), "begin").limit(specific).collect()]
    stems = [b for b in begins if not any(b != a and b.startswith(a) for a in begins)]
    of_stem = F.lit(False)
    for b in stems:
        of_stem = of_stem | F.col("word").startswith(b)
    own = pairs.filter((F.col("t") > 0) & (((F.col("t") >= least) & (odds > 3)) | (of_stem & (F.col("o") <= F.col("t"))))).orderBy(F.desc("t"), "word").limit(specific).collect()
    base = pairs.orderBy(F.desc("o"), "word").limit(common).collect()
    # ordinary words that hold a part of a toxic word: both dictionaries have them, so that a part saves nothing
    parts = {w[i : i + 4] for r in own for w in [f" {r['word']} "] for i in range(len(w) - 3)}
    inside = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.concat(F.lit(" "), F.col("word"), F.lit(" ")), i, F.lit(4)))
    close = pairs.filter((F.col("o") >= 2) & (odds < 1) & (F.length("word") >= 3)).filter(F.exists(inside, lambda g: g.isin(sorted(parts)))) if parts else pairs.limit(0)
    close = close.orderBy(F.desc("o"), "word").limit(near).collect()
    known = {r["word"] for r in base}
    base += [r for r in close if r["word"] not in known]
    base.sort(key=lambda r: (-r["o"], r["word"]))
    return Compressors(dictionaries([r["word"] for r in reversed(base)], [r["word"] for r in reversed(own)]))


def fit(docs: DataFrame, labelled: DataFrame, *, label: str = "toxic", per_class: int = 4000, common: int = 1200, near: int = 1500, specific: int = 1000, seed: int = 9) -> Model:
    labelled = labelled.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    n = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    if not (n.get(0) and n.get(1)):
        return Model(None, constant=1.0 if n.get(1) else 0.0)
    # rows for the dictionaries come first in the order of the hash, then those for the calibration
    rate = {k: min(0.65, per_class / n[k]) for k in (0, 1)}
    more = {k: min(1 - rate[k], rate[k]) for k in (0, 1)}
    u = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) / (1 << 20)
    mine = F.when(F.col("label") == 1, F.lit(rate[1])).otherwise(F.lit(rate[0]))
    both = F.when(F.col("label") == 1, F.lit(rate[1] + more[1])).otherwise(F.lit(rate[0] + more[0]))
    labelled = labelled.filter(u < both).withColumn("part", F.when(u < mine, 0).otherwise(1))
    # the sample is bounded by per_class, so it goes to the texts, which stay where they are
    rows = docs.select("doc_id", "text").join(F.broadcast(labelled), "doc_id")
    bounds = {"common": common, "near": near, "specific": specific}
    made = learn(rows.filter("part = 0"), **bounds)
    shared = docs.sparkSession.sparkContext.broadcast(made)
    got = rows.filter("part = 1").select(F.col("label").cast("double"), "text").mapInArrow(_features(shared), "label double, x array<double>").toPandas()
    if not len(got) or got["label"].nunique() < 2:
        return Model(None, constant=n[1] / (n[0] + n[1]))
    y, x = got["label"].to_numpy(), np.stack(got["x"].to_numpy())
    order = np.lexsort((*x.T, y))  # the same rows in the same order, however they came
    y, x = y[order], x[order]
    mean, scale, weights = calibrate(x, y, np.where(y == 1, 1 / more[1], 1 / more[0]) * min(more.values()))
    # calibrated on rows that its dictionaries had not seen, the model then has the words of all rows
    return Model(learn(rows, **bounds), mean, scale, weights, (x.min(axis=0), x.max(axis=0)))


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in textcore.blocks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(shared.value.score(data, off))], names=["doc_id", "score"])

    return textcore.tidy(run)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and the probability that the text is toxic for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_score(shared), "doc_id long, score double")
