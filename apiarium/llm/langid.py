"""Language identification by nearest centroid.

A text is a vector of hashed character n-gram frequencies (n from 1 to 3 over letters, other
characters folded to one boundary), weighted by inverse document frequency and normalised.
Each language has several centroids (spherical k-means over a bounded sample); a text takes
the language of the centroid with the largest cosine. A text whose cosine lies below the
language's own low quantile is *rejected* (reported beside the prediction, for open-set use).

Document frequencies are counted over all training rows; only the k-means sample is bounded:
``per_language`` different texts of each language, those of the lowest hashes. Every language found
is learned; what is broadcast is clusters * DIM * 4 bytes (64 KB) a language. Centroids are
scored ``BLOCK_LANGUAGES`` languages at a time, which bounds the table of cosines.

Defined cases: null text, or text without a letter, is ``und`` with score 0; null or unknown
languages train nothing; without any training row every text is ``und``; texts of any length
are read whole; repeated rows are predicted alike, and count once in the sample whatever
their doc_id, which training never reads; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from apiarium.llm import textcore

DIM = 1 << 12
BLOCK_LANGUAGES = 256
_TABLE: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Code point -> lower-cased code point of a letter, or 0."""
    if not _TABLE:
        table = np.zeros(0x110000, dtype=np.uint32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _TABLE.append(table)
    return _TABLE[0]


def grams(text: str) -> np.ndarray:
    """Bucket of every n-gram of the text; empty if it has no letter."""
    cp = _letters()[np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)]
    if not cp.any():
        return np.zeros(0, np.int64)
    keep = np.ones(len(cp) + 1, dtype=bool)
    keep[1:-1] = (cp[1:] != 0) | (cp[:-1] != 0)  # one boundary for a run of other characters
    keep[-1] = False
    x = np.concatenate([np.zeros(1, np.uint32), cp[keep[:-1]], np.zeros(1, np.uint32)])
    a, b = x * np.uint32(2654435761), x * np.uint32(2246822519)
    c = x * np.uint32(3266489917)
    two = (a[:-1] ^ (b[1:] >> np.uint32(3))) * np.uint32(668265263)
    three = (two[:-1] ^ (c[2:] >> np.uint32(5))) * np.uint32(374761393)
    one = (a ^ np.uint32(0x5BD1E995)) * np.uint32(2246822519)
    return (np.concatenate([one, two, three]) >> np.uint32(32 - 12)).astype(np.int64)


def counts(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), DIM), dtype=np.float32)
    for i, t in enumerate(texts):
        g = grams(t)
        if len(g):
            out[i] = np.bincount(g, minlength=DIM)
    return out


def vectors(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised, damped term frequencies times idf; a row without n-grams stays zero."""
    v = np.sqrt(c) * idf
    n = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / np.where(n > 0, n, 1)


def cluster(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means, started at the rows farthest from those before."""
    chosen = [0]
    near = v @ v[0]
    for _ in range(min(k, len(v)) - 1):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, v @ v[chosen[-1]])
    c = v[chosen].copy()
    for _ in range(rounds):
        own = np.argmax(v @ c.T, axis=1)
        for j in range(len(c)):
            if (own == j).any():
                m = v[own == j].sum(axis=0)
                c[j] = m / max(np.linalg.norm(m), 1e-12)
    return c


def _texts(col: pa.Array) -> list[str]:
    return [t if t is not None else "" for t in col.to_pylist()]


def _df(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(DIM, dtype=np.int64), 0
    for batch in batches:
        for t in _texts(batch.column(0)):
            g = grams(t)
            if len(g):
                total += np.bincount(g, minlength=DIM) > 0
                n += 1
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIM)), pa.array(np.concatenate([[n], total]))], names=["dim", "n"])


def _centroids(idf: np.ndarray, k: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        v = vectors(counts(sorted(frame["text"])), idf)
        v = v[(v > 0).any(axis=1)]
        if not len(v):
            return pd.DataFrame({"lang": [], "centroids": [], "floor": []})
        c = cluster(v, k)
        return pd.DataFrame({"lang": [frame["lang"].iloc[0]], "centroids": [c.astype(np.float32).tobytes()], "floor": [float(np.quantile((v @ c.T).max(axis=1), 0.01))]})

    return run


class Model:
    def __init__(self, idf: np.ndarray, langs: list[str], centroids: list[np.ndarray], floors: list[float]):
        self.idf, self.langs, self.floors = idf, langs, np.array(floors)
        self.blocks = [np.concatenate(centroids[i : i + BLOCK_LANGUAGES]).T.copy() for i in range(0, len(centroids), BLOCK_LANGUAGES)]
        self.owner = np.concatenate([np.full(len(c), i) for i, c in enumerate(centroids)]) if centroids else np.zeros(0, np.int64)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine and whether the distance rejects it, of each text."""
        v = vectors(counts(texts), self.idf)
        some = v.any(axis=1)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        best, most, first = np.zeros(len(texts), np.int64), np.full(len(texts), -np.inf, np.float32), 0
        for matrix in self.blocks:
            cos = v @ matrix
            at = np.argmax(cos, axis=1)
            here = cos[np.arange(len(texts)), at]
            better = here > most
            best[better], most[better] = first + at[better], here[better]
            first += matrix.shape[1]
        score = np.where(some, np.clip(most, 0, 1), 0).astype(float)
        own = self.owner[best]
        return [self.langs[o] if s else "und" for o, s in zip(own, some, strict=True)], score, ~some | (score < self.floors[own])


def sample(train: DataFrame, per_language: int) -> DataFrame:
    """(lang, text): at most ``per_language`` different texts of each language, those of the lowest hashes.

    A rate that lets a few more pass thins the rows first, so that little is ranked.
    """
    hashed = train.select("lang", "text", F.xxhash64("text").alias("h"))
    u = F.pmod("h", F.lit(1 << 40)) / (1 << 40)
    rates = hashed.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).select("lang", (F.lit(1.5 * per_language + 50) / F.col("n")).alias("rate"))
    # a row a language, far less than the centroids that every task gets, so texts stay where they are
    few = hashed.join(F.broadcast(rates), "lang").filter(u < F.col("rate")).groupBy("lang", "h").agg(F.min("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 40)), "h"))
    return few.withColumn("place", place).filter(F.col("place") <= per_language).select("lang", "text")


def fit(train: DataFrame, *, clusters: int = 4, per_language: int = 400) -> Model:
    """Learns from rows (text, lang)."""
    train = train.filter("lang is not null and text is not null")
    df = {r["dim"]: r["n"] for r in train.select("text").mapInArrow(textcore.tidy(_df), "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect()}
    n = df.get(-1, 0)
    idf = np.array([np.log((1 + n) / (1 + df.get(d, 0))) + 1 for d in range(DIM)], dtype=np.float32)
    made = sample(train, per_language).groupBy("lang").applyInPandas(_centroids(idf, clusters), "lang string, centroids binary, floor double").collect()
    made.sort(key=lambda r: r["lang"])
    return Model(idf, [r["lang"] for r in made], [np.frombuffer(r["centroids"], dtype=np.float32).reshape(-1, DIM) for r in made], [r["floor"] for r in made])


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, _, _ in textcore.blocks(batch.column(1)):
                part = batch.slice(i, j - i)
                for a in range(0, len(part), 256):
                    few = part.slice(a, 256)
                    lang, score, rejected = shared.value.predict(_texts(few.column(1)))
                    yield pa.RecordBatch.from_arrays([few.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    return textcore.tidy(run)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (cosine, 0 to 1), rejected for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_predict(shared), "doc_id long, lang_pred string, score double, rejected boolean")
