"""Language-model scoring with a log-bilinear model trained by noise-contrastive estimation.

Texts are sequences of lower-cased words and one end token. All training tokens are counted.
The model predicts a token from the two before it: the context vector is the sum of their
vectors, each passed through the weights of its position. A word's probability is that of its
class times its own inside the class; either score is the product with a vector of its own
plus a bias, normalised exactly by batched matrix products. The vocabulary is the end, the
``vocabulary`` most frequent words, and ``CLASSES`` shapes (last sign, non-ASCII letters,
length) for the others; inside its shape a word has its smoothed share of the counts, and one
unseen word has 0.5.

Training sees every training token: the texts are dealt to ``rounds`` rounds by hash, in each
to as many tasks as ``slice_tokens`` tokens for each ask for (``trainers`` at least), and a
task makes noise-contrastive steps in numpy over all its tokens, once, as they stream by; the
parameters are averaged after each round, in two levels. A task with few texts goes over them
again until it has made ``steps`` steps. Which texts a task has follows the layout of the
input, so the model's last digits do too.

Word counts are kept by 64-bit hash. Words above a count that at most ``frequent`` words
reach are broadcast (16 bytes each); the others' counts meet the documents' rare words in a
join by hash, added up by document, so nothing that grows with the corpus reaches a task or
the driver whole.

Defined cases: null and empty texts have one token, the end; without training rows every
count is 0 and the model is uniform over the one known class; rows equal in doc_id and text
give equal rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apiarium.llm import textcore
from apiarium.scratch import materialize

END_HASH = 63  # no word has class 63
CLASSES = 48
FLUSH = 1 << 21
SLAB = 1 << 15  # tokens of a step
HELD = 1 << 12  # times ``steps``: so many tokens a trainer holds to go over them again
PIECE = 1 << 14
PARTS = 64  # groups of trainers whose changes are averaged first

#: Kind of a word's last byte: letter, full stop, comma and the like, exclamation, digit, other.
_LAST = np.full(256, 5, dtype=np.int64)
_LAST[65:91] = _LAST[97:123] = _LAST[128:] = 0
_LAST[46] = 1
_LAST[[44, 58, 59]] = 2
_LAST[[33, 63]] = 3
_LAST[48:58] = 4


def _words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key (hash, with the shape class in its low six bits) and row of each word."""
    s, e, row = textcore.words(data, off, textcore.SPACE_WORD)
    h = textcore.span_hashes(data, s, e)
    if len(s):
        high = np.concatenate([[0], np.cumsum(data >= 128, dtype=np.int64)])
        shape = _LAST[data[e - 1]] * 8 + (high[e] > high[s]) * 4 + np.searchsorted([4, 7, 10], e - s)
        h = (h & ~np.uint64(63)) | shape.astype(np.uint64)
    return h, row


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) over the task's texts, added up before they leave it."""

    def flush():
        nonlocal held, size
        h, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate([c for _, c in held]), minlength=len(h)).astype(np.int64)
        held, size = [(h, n)], len(h)
        return h, n

    held, size, ends, since = [], 0, 0, 0
    for batch in batches:
        for i, j, data, off in textcore.blocks(batch.column(0)):
            h, n = np.unique(_words(data, off)[0], return_counts=True)
            held.append((h, n))
            ends += j - i
            since += len(h)
            if since > FLUSH:
                h, n = flush()
                since = 0
                if size > FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["word", "n"])
                    held, size = [], 0
    if held:
        h, n = flush()
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["word", "n"])
    if ends:
        yield pa.RecordBatch.from_arrays([pa.array([END_HASH]), pa.array([ends])], names=["word", "n"])


class Vocabulary:
    """Counts and model numbers of the frequent words, and the totals."""

    def __init__(self, words: np.ndarray, n: np.ndarray, top: np.ndarray, ends: int, tokens: int, types: int, size: int):
        order = np.argsort(words)
        self.words, self.n, self.top = words[order], n[order], top[order]
        self.ends, self.tokens, self.types, self.size = ends, tokens, types, size

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether frequent, count and model number (0 end, 1 to CLASSES others) of each word."""
        shape = (h & np.uint64(63)).astype(np.int64) + 1
        if not len(self.words):
            return np.zeros(len(h), bool), np.zeros(len(h), np.int64), shape
        at = np.searchsorted(self.words, h)
        at[at == len(self.words)] = 0
        ok = self.words[at] == h
        return ok, np.where(ok, self.n[at], 0), np.where(ok, self.top[at], shape)

    def sequence(self, data: np.ndarray, off: np.ndarray):
        """Word hashes with their rows, and model numbers of all tokens (ends included) with two contexts and rows."""
        h, row = _words(data, off)
        n = len(off) - 1
        ok, c, number = self.look(h)
        place = np.arange(len(h)) + row  # an end stands after each row before
        total = len(h) + n
        seq, of = np.zeros(total, np.int64), np.zeros(total, np.int64)
        seq[place], of[place] = number, row
        bounds = textcore.row_bounds(row, n)
        ends = bounds[1:] + np.arange(n)
        seq[ends], of[ends] = 0, np.arange(n)
        first = np.concatenate([[0], ends[:-1] + 1])
        one, two = np.zeros(total, np.int64), np.zeros(total, np.int64)  # before a text stand ends
        one[1:], two[2:] = seq[:-1], seq[:-2]
        one[first] = 0
        two[first] = 0
        two[(first + 1)[first < ends]] = 0
        return h, row, ok, c, number, seq, one, two, of


class LogBilinear:
    """Context vectors, position weights, and vectors and biases of classes and of the words inside them.

    Words are ordered by falling share and cut into about sqrt(k) classes of equal sums of the
    root of the share, so that frequent words have small classes and none has over about 2 sqrt(k).
    """

    def __init__(self, unigram: np.ndarray, dim: int = 16, seed: int = 3):
        rng = np.random.default_rng(seed)
        k = len(unigram)
        order = np.argsort(-unigram, kind="stable")
        #: place of each word in that order; all parameters are kept by place
        self.place = np.empty(k, np.int64)
        self.place[order] = np.arange(k)
        self.unigram = np.asarray(unigram, dtype=float)
        share = self.unigram[order]
        root = np.cumsum(np.sqrt(share))
        _, self.own = np.unique(np.floor((root - np.sqrt(share) / 2) / root[-1] * math.ceil(math.sqrt(k))).astype(np.int64), return_inverse=True)
        self.edge = np.searchsorted(self.own, np.arange(self.own[-1] + 2))
        self.mass = np.add.reduceat(share, self.edge[:-1])
        self.inside = share / self.mass[self.own]
        self.heavy = np.cumsum(share)
        self.r = rng.normal(0, 0.1, (k, dim)).astype(np.float32)
        self.c = np.ones((2, dim), np.float32)
        self.q = rng.normal(0, 0.1, (k, dim)).astype(np.float32)
        self.b = np.log(self.inside).astype(np.float32)
        self.p = rng.normal(0, 0.1, (len(self.mass), dim)).astype(np.float32)
        self.a = np.log(self.mass).astype(np.float32)
        self.sums: list[np.ndarray] = []

    def params(self) -> list[np.ndarray]:
        return [self.r, self.c, self.q, self.b, self.p, self.a]

    def pack(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.params()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for p in self.params():
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size
        self.sums = []

    def context(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return self.r[one] * self.c[0] + self.r[two] * self.c[1]

    def train(self, code: np.ndarray, n: np.ndarray, *, steps: int, noise: int = 24, batch: int = 4096, rate: float = 0.1, seed: int = 0) -> None:
        """Steps on triples drawn by their counts."""
        rng = np.random.default_rng(seed)
        k, cum = len(self.unigram), np.cumsum(n / n.sum())
        for _ in range(steps):
            x = code[np.minimum(np.searchsorted(cum, rng.random(batch)), len(code) - 1)]
            self.step(x // k % k, x // k // k, x % k, rng, noise=noise, rate=rate)

    def step(self, one: np.ndarray, two: np.ndarray, w: np.ndarray, rng: np.random.Generator, *, noise: int = 24, rate: float = 0.1) -> None:
        """One noise-contrastive Adagrad step on these triples, for the class and for the word inside its class."""
        w = self.place[w]
        order = np.argsort(w, kind="stable")
        w, one, two = w[order], self.place[one[order]], self.place[two[order]]
        own = self.own[w]
        ctx = self.context(one, two)
        # the class; its noise is drawn once for all contexts of a step, so that scores are one matrix product
        z = rng.choice(len(self.mass), noise, p=self.mass / self.mass.sum())
        log_noise = np.log(noise * self.mass).astype(np.float32)
        pt = _sigmoid((ctx * self.p[own]).sum(axis=1) + self.a[own] - log_noise[own]) - 1
        pf = _sigmoid(ctx @ self.p[z].T + (self.a[z] - log_noise[z]))
        g_ctx = pt[:, None] * self.p[own] + pf @ self.p[z]
        classes = _summed(np.concatenate([own, z]), np.concatenate([np.column_stack([pt[:, None] * ctx, pt]), np.column_stack([pf.T @ ctx, pf.sum(axis=0)])]))
        # the word; one noise for all contexts of a class, whose places lie together
        start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        log_noise = np.log(noise * self.inside[w]).astype(np.float32)
        pt = _sigmoid((ctx * self.q[w]).sum(axis=1) + self.b[w] - log_noise) - 1
        several = self.edge[own + 1] - self.edge[own] > 1
        pt *= several  # the only word of its class is certain
        g_ctx += pt[:, None] * self.q[w]
        here = start[several[start]]
        stop = np.append(start[1:], len(w))[several[start]]
        lo, hi = self.edge[own[here]], self.edge[own[here] + 1]
        below = np.concatenate([[0], self.heavy])[lo]
        z = below[:, None] + rng.random((len(here), noise)) * (self.heavy[hi - 1] - below)[:, None]
        z = np.clip(np.searchsorted(self.heavy, z), lo[:, None], hi[:, None] - 1)
        near, bias = self.q[z], self.b[z] - np.log(noise * self.inside[z]).astype(np.float32)
        g_z = np.empty((*z.shape, ctx.shape[1] + 1), np.float32)
        for t, (i, j) in enumerate(zip(here.tolist(), stop.tolist(), strict=True)):
            pf = _sigmoid(ctx[i:j] @ near[t].T + bias[t])
            g_ctx[i:j] += pf @ near[t]
            g_z[t, :, :-1] = pf.T @ ctx[i:j]
            g_z[t, :, -1] = pf.sum(axis=0)
        words = _summed(np.concatenate([w, z.ravel()]), np.concatenate([np.column_stack([pt[:, None] * ctx, pt]), g_z.reshape(-1, g_z.shape[2])]))
        before = _summed(np.concatenate([one, two]), np.concatenate([g_ctx * self.c[0], g_ctx * self.c[1]]))
        g_c = np.stack([(g_ctx * self.r[one]).sum(axis=0), (g_ctx * self.r[two]).sum(axis=0)])
        if not self.sums:
            self.sums = [np.ones_like(p) for p in self.params()]
        moves = [before, (np.arange(2), g_c), (words[0], words[1][:, :-1]), (words[0], words[1][:, -1]), (classes[0], classes[1][:, :-1]), (classes[0], classes[1][:, -1])]
        for p, s, (rows_at, g) in zip(self.params(), self.sums, moves, strict=True):
            s[rows_at] += g * g
            p[rows_at] -= rate * g / np.sqrt(s[rows_at])

    def log10(self, one: np.ndarray, two: np.ndarray, w: np.ndarray) -> np.ndarray:
        """log10 P(w | one, two): of the class, normalised over the classes, and of the word, over its class."""
        out = np.zeros(len(w))
        for i in range(0, len(w), SLAB):
            x = self.place[w[i : i + SLAB]]
            order = np.argsort(x, kind="stable")
            x = x[order]
            own = self.own[x]
            ctx = self.context(self.place[one[i : i + SLAB][order]], self.place[two[i : i + SLAB][order]])
            got = (ctx * self.p[own]).sum(axis=1) + self.a[own] + (ctx * self.q[x]).sum(axis=1) + self.b[x]
            for j in range(0, len(x), 4096):
                got[j : j + 4096] -= _log_sum(ctx[j : j + 4096] @ self.p.T + self.a)
            start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            for a, b in zip(start, np.append(start[1:], len(x)), strict=True):
                mine = slice(self.edge[own[a]], self.edge[own[a] + 1])
                for j in range(a, b, 4096):
                    some = slice(j, min(j + 4096, b))
                    got[some] -= _log_sum(ctx[some] @ self.q[mine].T + self.b[mine])
            out[i + order] = got
        return out / np.log(10)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x = np.clip(x, -30, 30)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _log_sum(z: np.ndarray) -> np.ndarray:
    most = z.max(axis=1)
    z -= most[:, None]
    return np.log(np.exp(z, out=z).sum(axis=1)) + most


def _summed(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places and the sums of their rows, as a sorted reduction."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[first], np.add.reduceat(rows[order], first, axis=0)


class Model:
    def __init__(self, vocabulary: Vocabulary, net: LogBilinear, other: np.ndarray):
        self.vocabulary, self.net, self.other = vocabulary, net, other

    @property
    def base_norm(self) -> float:
        """log10 of the base's denominator."""
        return float(np.log10(self.vocabulary.tokens + 0.5 * (self.vocabulary.types + 1)))


def _steps(shared, net, params, steps: int, seed: int):
    """Pieces of what one pass over all tokens of a task's texts changes in the parameters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, m = shared.value, net.value
        m.load(params.value)
        rng = np.random.default_rng(seed)
        wait, ready, held, total, done = [], 0, [], 0, 0
        for batch in batches:
            for _, _, data, off in textcore.blocks(batch.column(0)):
                _, _, _, _, _, seq, one, two, _ = v.sequence(data, off)
                wait.append(np.stack([one, two, seq]))
                ready += len(seq)
                total += len(seq)
                if total <= steps * HELD:
                    held.append(wait[-1].astype(np.int32))
                else:
                    held = []
                if ready >= SLAB:
                    done += _passed(m, np.concatenate(wait, axis=1), rng)
                    wait, ready = [], 0
        if wait:
            done += _passed(m, np.concatenate(wait, axis=1), rng)
        if held and done < steps:  # few texts, all held: they are gone over again
            one, two, seq = np.concatenate(held, axis=1).astype(np.int64)
            m.train((two * v.size + one) * v.size + seq, np.ones(len(seq)), steps=steps - done, seed=seed)
        if total:
            flat, part = m.pack() - params.value, TaskContext.get().partitionId() if TaskContext.get() else 0
            for i in range(0, len(flat), PIECE):
                yield pa.RecordBatch.from_arrays([pa.array([i // PIECE]), pa.array([part % PARTS], pa.int32()), pa.array([flat[i : i + PIECE].tobytes()]), pa.array([total])], names=["piece", "part", "params", "n"])

    return textcore.tidy(run)


def _passed(net: LogBilinear, triples: np.ndarray, rng: np.random.Generator) -> int:
    cuts = range(0, triples.shape[1], SLAB)
    for i in cuts:
        net.step(*triples[:, i : i + SLAB], rng)
    return len(cuts)


def _average(frame: pd.DataFrame) -> pd.DataFrame:
    """Mean of a piece's changes, weighted by the tokens behind them."""
    frame = frame.sort_values(["n", "params"])
    n = frame["n"].to_numpy(dtype=float)
    mean = np.zeros(len(frame["params"].iloc[0]) // 4)
    for p, w in zip(frame["params"], n / n.sum(), strict=True):
        mean += np.frombuffer(p, dtype=np.float32) * w
    return pd.DataFrame({"piece": frame["piece"].iloc[:1], "params": [mean.astype(np.float32).tobytes()], "n": [int(n.sum())]})


def fit(train: DataFrame, *, frequent: int = 1 << 17, vocabulary: int = 1 << 14, trainers: int = 8, slice_tokens: int = 1 << 24, rounds: int = 3, steps: int = 150) -> tuple[Model, DataFrame]:
    """The model and the table (word, n) of all counts, from the texts of ``train``."""
    spark = train.sparkSession
    counts = materialize(train.select("text").mapInArrow(textcore.tidy(_count), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    # the least power-of-1.1 count that few enough words reach
    level = F.floor(F.log("n") / np.log(1.1))
    reach, least = 0, None
    for r in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        reach += r["count"]
        if reach > frequent:
            break
        least = r["level"]
    top = counts.filter(level >= least).orderBy(F.desc("n"), "word").toArrow() if least is not None else pa.table({"word": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    h, n = top["word"].to_numpy(), top["n"].to_numpy()
    keep = h != END_HASH
    # the end's count is looked up by itself: it may lie below the cut of the frequent words
    ends = int(counts.filter(F.col("word") == END_HASH).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    h, n = h[keep].view(np.uint64), n[keep]
    # the words of the vocabulary come first in the order of counts; the others bear their shape's number
    first, some = 1 + CLASSES, min(len(h), vocabulary)
    size = first + some
    shape = 1 + (h & np.uint64(63)).astype(np.int64)
    v = Vocabulary(h, n, np.concatenate([np.arange(first, size), shape[some:]]), ends, int(total["n"]), int(total["v"]), size)
    # shares of the model's vocabulary: an unseen word of each shape counts as half a token
    mass = np.zeros(size)
    mass[0] = ends + 0.5
    for r in counts.filter(F.col("word") != END_HASH).groupBy(F.col("word").bitwiseAND(F.lit(63)).alias("shape")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        mass[1 + r["shape"]] = r["n"] + 0.5 * r["v"]
    np.subtract.at(mass, shape[:some], n[:some] + 0.5)
    mass[1:first] += 0.5
    mass[first:] = n[:some] + 0.5
    other = mass[1:first].copy()
    mass = np.maximum(mass, 1e-9)
    net = LogBilinear(mass / mass.sum())
    if v.tokens:
        shared, start = spark.sparkContext.broadcast(v), spark.sparkContext.broadcast(net)
        tasks = max(trainers, math.ceil(v.tokens / rounds / slice_tokens))
        for i in range(rounds):
            # each text is in one round, and all its tokens in one pass of one task
            mine = train.select("text").filter(F.pmod(F.xxhash64("text", F.length("text")), F.lit(rounds)) == i).coalesce(tasks)
            params = spark.sparkContext.broadcast(net.pack())
            pieces = mine.mapInArrow(_steps(shared, start, params, steps, i), "piece long, part int, params binary, n long")
            for level in (("piece", "part"), ("piece",)):
                pieces = pieces.groupBy(*level).applyInPandas(_average, "piece long, params binary, n long")
            got = sorted(pieces.select("piece", "params").collect())
            if got:
                net.load(net.pack() + np.frombuffer(b"".join(r["params"] for r in got), dtype=np.float32))
            params.destroy()
        shared.destroy()
        start.destroy()
    return Model(v, net, other), counts


def _score(shared):
    """One row for each document, and rows (key, word, times) of its rare words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        v = m.vocabulary
        ends = float(np.log10(v.ends + 0.5))
        for batch in batches:
            ids, keys = batch.column(0), batch.column(2)
            for i, j, data, off in textcore.blocks(batch.column(1)):
                n = j - i
                h, row, ok, c, number, seq, one, two, of = v.sequence(data, off)
                model = np.bincount(of, weights=m.net.log10(one, two, seq), minlength=n)
                log = np.log10(c + 0.5)
                base = np.bincount(row[ok], weights=log[ok], minlength=n) + ends
                # a word outside the vocabulary has its share of the mass of its shape
                others = (seq > 0) & (seq <= CLASSES)
                model -= np.bincount(of[others], weights=np.log10(m.other)[seq[others] - 1], minlength=n)
                counted = ok & (number <= CLASSES)
                model += np.bincount(row[counted], weights=log[counted], minlength=n)
                words = np.bincount(row, minlength=n)
                known = np.bincount(row[ok], minlength=n) + (1 if v.tokens else 0)
                rare = ~ok
                order = np.lexsort((h[rare], row[rare]))
                rh, rr = h[rare][order], row[rare][order]
                first = np.flatnonzero(np.concatenate([[True], (rh[1:] != rh[:-1]) | (rr[1:] != rr[:-1])])) if len(rh) else np.zeros(0, np.int64)
                times = np.diff(np.append(first, len(rh)))
                rb = textcore.row_bounds(rr[first], n)
                lists = [pa.ListArray.from_arrays(pa.array(rb.astype(np.int32)), pa.array(x)) for x in (rh[first].view(np.int64), times.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([ids.slice(i, n), keys.slice(i, n), pa.array(words.astype(np.int64) + 1), pa.array(known.astype(np.int64)), pa.array(base), pa.array(model), *lists], names=["doc_id", "key", "n_tokens", "known", "base", "model", "rare", "times"])

    return textcore.tidy(run)


SCORED = "doc_id long, key long, n_tokens long, known long, base double, model double, rare array<long>, times array<int>"


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of each row of ``docs``."""
    v = model.vocabulary
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key")).mapInArrow(_score(shared), SCORED)
    rows = materialize(rows, "scored")
    rare = rows.select("doc_id", "key", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("doc_id", "key", F.col("w.rare").alias("word"), F.col("w.times").alias("times"))
    rare = rare.join(counts, "word", "left").select("doc_id", "key", F.col("times").cast("long").alias("times"), F.coalesce("n", F.lit(0)).alias("n"))
    zero = F.lit(0).cast("long")
    added = rare.groupBy("doc_id", "key").agg(F.sum(F.col("times") * F.log10(F.col("n") + 0.5)).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(zero)).alias("found"), zero.alias("rows"), F.lit(0.0).alias("base"), F.lit(0.0).alias("model"), zero.alias("known"), zero.alias("n_tokens"))
    each = rows.select("doc_id", "key", F.lit(0.0).alias("more"), zero.alias("found"), F.lit(1).cast("long").alias("rows"), "base", "model", "known", "n_tokens")
    # rows equal in doc_id and text give equal sums, so each is its share of the group's
    out = each.unionByName(added).groupBy("doc_id", "key").agg(*[F.sum(c).alias(c) for c in ("more", "found", "rows", "base", "model", "known", "n_tokens")])
    out = out.select("doc_id", F.explode(F.array_repeat(F.lit(1), F.col("rows").cast("int"))).alias("one"), *[(F.col(c) / F.col("rows")).alias(c) for c in ("more", "found", "base", "model", "known", "n_tokens")])
    tokens = F.col("n_tokens")
    return out.select("doc_id", tokens.cast("long").alias("n_tokens"), (F.col("known") + F.col("found")).cast("long").alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"), (F.col("base") + F.col("more") - tokens * F.lit(model.base_norm)).alias("base_score"), (F.col("model") + F.col("more")).alias("score"))
