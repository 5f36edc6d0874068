"""Benchmark decontamination by winnowing.

Words are runs of letters, digits and non-ASCII characters, lower-cased A-Z. A text's
fingerprints are the minimum hashes of its k-grams in every sliding window of w k-grams, so
any two texts that share k + w - 1 = ``span`` words share a fingerprint. Documents whose
fingerprints meet those of the benchmark are extended to the full hits: every occurrence of
``span`` consecutive item words. An item of fewer words is one fingerprint of its own length
and is looked up at every position.

While the benchmark's tables measure at most ``max_broadcast`` bytes they go to every task
and the documents are read once, without a shuffle. Beyond that, fingerprints are joined by
hash (``shuffled``): a row for each fingerprint of a document, thinned to those that the
benchmark has, then all windows of the documents found meet those of the items; texts move
once for each document, and no group is gathered.

Defined cases: null and empty texts have no words, are never hit and, as items, hit nothing;
an item without item_id is ignored; repeated items count once for each item_id, and an
item_id that repeats counts once; repeated document rows, and those without doc_id, are rows
of their own; an empty table of either kind gives an empty report or no hit. Other columns of
either table are ignored, and passed through by ``clean``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from apiarium.llm import common, textcore
from apiarium.scratch import materialize

K = 5
REPORT = "doc_id long, n_words long, n_hit long, items array<string>"


def winnow(g: np.ndarray, at: np.ndarray, row: np.ndarray, w: int) -> np.ndarray:
    """Places in ``g`` of the minima of every w consecutive k-grams of a row (of all, if a row has fewer)."""
    if not len(g):
        return np.zeros(0, np.int64)
    r = row[at]
    best = np.arange(len(g))
    for j in range(1, w):  # the place of the minimum of g[i : i + w], within the row
        here = np.arange(len(g) - j)
        there = here + j
        better = (r[here] == r[there]) & (g[there] < g[best[here]])
        best[here[better]] = there[better]
    # only windows that lie wholly in the row, or the first of a short row
    last = np.searchsorted(r, r, side="right")
    first = np.searchsorted(r, r, side="left")
    i = np.arange(len(g))
    return np.unique(best[(i + w <= last) | ((i == first) & (last - first < w))])


class Index:
    """Benchmark tables: item windows by length, and winnowed fingerprints of the full windows."""

    def __init__(self, items: list[tuple[str, str]], span: int):
        self.span, self.ids = span, sorted({i for i, _ in items})
        place = {x: n for n, x in enumerate(self.ids)}
        owner = np.array([place[i] for i, _ in items], dtype=np.int64)
        texts = pa.array([t for _, t in items], pa.string())
        found: dict[int, list] = {}
        prints = [np.zeros(0, np.uint64)]
        for i, _, data, off in textcore.blocks(texts):
            s, e, row = textcore.words(data, off, textcore.ALNUM_WORD)
            h = textcore.span_hashes(data, s, e)
            n = np.bincount(row, minlength=len(off) - 1)
            for m in np.unique(np.minimum(n, span)):
                if m:
                    own = np.isin(row, np.flatnonzero(np.minimum(n, span) == m))
                    g, at = textcore.grams(h[own], row[own], int(m))
                    found.setdefault(int(m), []).append((g, owner[i + row[own][at]]))
            k = min(K, span)
            g, at = textcore.grams(h, row, k)
            prints.append(g[winnow(g, at, row, span - k + 1)])
        self.prints = np.unique(np.concatenate(prints))
        self.windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for m, parts in found.items():
            pairs = np.unique(np.rec.fromarrays([np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])], names="g,o"))
            self.windows[m] = (pairs.g.copy(), pairs.o.copy())

    @property
    def nbytes(self) -> int:
        return self.prints.nbytes + sum(a.nbytes + b.nbytes for a, b in self.windows.values()) + sum(map(len, self.ids))


def _member(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(x), bool)
    p = np.searchsorted(table, x)
    p[p == len(table)] = 0
    return table[p] == x


def hits(index: Index, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Words, hit words and the places of the items that occur, of each row."""
    n = len(off) - 1
    s, e, row = textcore.words(data, off, textcore.ALNUM_WORD)
    h = textcore.span_hashes(data, s, e)
    bounds = textcore.row_bounds(row, n)
    mark = np.zeros(len(h) + 1, dtype=np.int64)
    who: list[tuple[np.ndarray, np.ndarray]] = []
    for m, (g, owner) in index.windows.items():
        if m == index.span:
            k = min(K, m)
            kg, at = textcore.grams(h, row, k)
            mins = winnow(kg, at, row, m - k + 1)
            rows = np.unique(row[at[mins[_member(kg[mins], index.prints)]]])
            own = np.flatnonzero(np.isin(row, rows)) if len(rows) else np.zeros(0, np.int64)
        else:
            own = np.arange(len(h))
        if not len(own):
            continue
        x, at = textcore.grams(h[own], row[own], m)
        ok = _member(x, g)
        at, x = own[at[ok]], x[ok]
        np.add.at(mark, at, 1)
        np.add.at(mark, at + m, -1)
        lo, hi = np.searchsorted(g, x, "left"), np.searchsorted(g, x, "right")
        count = hi - lo
        flat = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum()) if len(x) else np.zeros(0, np.int64)
        who.append((np.repeat(row[at], count), owner[flat]))
    hit = np.cumsum(mark[:-1]) > 0
    n_hit = np.bincount(row[hit], minlength=n)
    items = [np.zeros(0, np.int64)] * n
    if who:
        r, o = np.concatenate([a for a, _ in who]), np.concatenate([b for _, b in who])
        pairs = np.unique(r * np.int64(len(index.ids) + 1) + o)
        r, o = pairs // (len(index.ids) + 1), pairs % (len(index.ids) + 1)
        for d in np.unique(r):
            items[d] = o[np.searchsorted(r, d) : np.searchsorted(r, d, "right")]
    return np.diff(bounds), n_hit, items


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        names = np.array(index.ids, dtype=object)
        for batch in batches:
            ids = batch.column(0)
            for i, j, data, off in textcore.blocks(batch.column(1)):
                words, n_hit, items = hits(index, data, off)
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(words.astype(np.int64)), pa.array(n_hit.astype(np.int64)), pa.array([list(names[o]) for o in items], pa.list_(pa.string()))], names=["doc_id", "n_words", "n_hit", "items"])

    return textcore.tidy(run)


def _grams(of: str, span: int, lengths: list[int]):
    """(key, m, at, g) rows of (key, text): hashes of m words and the first one's place.

    ``of``: "items", every window of an item (m is its length, ``span`` at most); "windows",
    every window of the lengths and of ``span``; "prints", the winnowed fingerprints (m is
    ``span``) and every window of the lengths, which are too short for one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            for i, j, data, off in textcore.blocks(batch.column(1)):
                s, e, row = textcore.words(data, off, textcore.ALNUM_WORD)
                h = textcore.span_hashes(data, s, e)
                n = np.minimum(np.bincount(row, minlength=j - i), span)
                first = textcore.row_bounds(row, j - i)
                for m in np.unique(n[n > 0]).tolist() if of == "items" else [*lengths, span]:
                    mine = np.flatnonzero(n[row] == m) if of == "items" else np.arange(len(row))
                    k = min(K, span) if of == "prints" and m == span else m
                    g, at = textcore.grams(h[mine], row[mine], k)
                    if of == "prints" and m == span:
                        some = winnow(g, at, row[mine], span - k + 1)
                        g, at = g[some], at[some]
                    at = mine[at]
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(i + row[at])), pa.array(np.full(len(g), m, np.int32)), pa.array(at - first[row[at]]), pa.array(g.view(np.int64))], names=["key", "m", "at", "g"])

    return textcore.tidy(run)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, off in textcore.blocks(batch.column(2)):
            row = textcore.words(data, off, textcore.ALNUM_WORD)[2]
            yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(i, j - i) for c in (0, 1)], pa.array(np.bincount(row, minlength=j - i).astype(np.int64))], names=["line", "doc_id", "n_words"])


def shuffled(docs: DataFrame, items: DataFrame, span: int) -> DataFrame:
    """The report, with ``line``, of rows (line, doc_id, text) for a benchmark of any size.

    Fingerprints meet in a join; the documents found are extended by joining all their windows
    with those of the items, so texts move once for each document, never for a pair.
    """
    items = items.filter("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    rows = "m int, at long, g long"
    theirs = materialize(items.mapInArrow(_grams("items", span, []), f"key string, {rows}").select(F.col("key").alias("item_id"), "m", "g").distinct(), "item-windows")
    lengths = sorted(r["m"] for r in theirs.filter(F.col("m") < span).select("m").distinct().collect())
    prints = items.mapInArrow(_grams("prints", span, []), f"key string, {rows}").select("m", "g").union(theirs.filter(F.col("m") < span).select("m", "g")).distinct()
    texts = docs.select("line", "text")
    found = texts.mapInArrow(_grams("prints", span, lengths), f"key long, {rows}").join(prints, ["m", "g"], "left_semi").select(F.col("key").alias("line")).distinct()
    found = materialize(found, "found")
    windows = texts.join(found, "line", "left_semi").mapInArrow(_grams("windows", span, lengths), f"key long, {rows}")
    spans = windows.join(theirs, ["m", "g"]).select(F.col("key").alias("line"), "item_id", F.col("at").alias("a"), (F.col("at") + F.col("m")).alias("b"))
    spans = materialize(spans, "spans")
    w = Window.partitionBy("line").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max("b").over(w), F.lit(0))
    n_hit = spans.select("line", "a", "b").distinct().select("line", F.greatest(F.lit(0), F.col("b") - F.greatest("a", seen)).alias("n")).groupBy("line").agg(F.sum("n").alias("n_hit"))
    names = spans.select("line", "item_id").distinct().groupBy("line").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    counted = docs.select("line", "doc_id", "text").mapInArrow(textcore.tidy(_counted), "line long, doc_id long, n_words long")
    out = counted.join(n_hit, "line", "left").join(names, "line", "left")
    return out.select("line", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _index(items: DataFrame, span: int, max_broadcast: int) -> Index | None:
    """The benchmark's tables, if they are small enough to be sent to every task."""
    size = items.agg(F.coalesce(F.sum(F.length(F.encode(F.coalesce("text", F.lit("")), "UTF-8")) + 64), F.lit(0))).first()[0]
    if size * 4 > max_broadcast:  # a word may be two bytes and gives 16 bytes of tables at most, fingerprints less
        return None
    rows = items.select(F.col("item_id").cast("string"), F.coalesce("text", F.lit(""))).filter("item_id is not null").collect()
    return Index([tuple(r) for r in rows], span)


def report(docs: DataFrame, items: DataFrame, *, span: int = 10, max_broadcast: int = 64 << 20) -> DataFrame:
    """doc_id, n_words, n_hit and the sorted items of each row of ``docs``."""
    index = _index(items, span, max_broadcast)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if index is None:
        # written once, so that a row keeps its number whenever it is read
        return shuffled(materialize(docs.withColumn("line", F.monotonically_increasing_id()), "numbered"), items, span).drop("line")
    shared = docs.sparkSession.sparkContext.broadcast(index)
    return docs.mapInArrow(_scan(shared), REPORT)


def digest(found: DataFrame) -> DataFrame:
    joined = F.array_join(F.array_sort("items"), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def items_sha256(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def clean(docs: DataFrame, items: DataFrame, *, span: int = 10, max_share: float = 0.0, max_broadcast: int = 64 << 20) -> DataFrame:
    """``docs`` without the rows of which more than ``max_share`` of the words are hit; same columns, any doc_id."""
    index = _index(items, span, max_broadcast)
    if index is None:
        number = common.fresh("_line", docs.columns)
        whole = materialize(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
        bad = shuffled(whole.select(F.col(number).alias("line"), F.col("doc_id").cast("long").alias("doc_id"), "text"), items, span)
        bad = bad.filter(F.col("n_hit") > F.col("n_words") * max_share).select(F.col("line").alias(number))
        return whole.join(bad, number, "left_anti").select(*common.columns(docs))
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in textcore.blocks(batch.column(batch.schema.get_field_index("text"))):
                words, n_hit, _ = hits(shared.value, data, off)
                yield batch.slice(i, j - i).filter(pa.array(n_hit <= words * max_share))

    return docs.select(*common.columns(docs)).mapInArrow(textcore.tidy(run), docs.schema)
