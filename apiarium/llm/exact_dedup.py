"""Exact deduplication by content-defined chunk recipes.

A text (lower-cased A-Z, UTF-8) is cut where a rolling hash of its last 16 bytes meets a
mask, so equal stretches of text give equal chunks wherever they stand. One pass over the
text leaves a recipe: the ordered chunk identifiers. Whole texts are never shuffled; two
documents are equal when their ordered lists of verified identifiers are equal.

A chunk's identifier is a 64-bit hash with its length. It is *verified* when every chunk
that bears it has the same SHA-256; where one bears several, documents holding it are
compared by the SHA-256 of the whole text as well, so a hash collision never merges texts.

Defined cases: a null text is an empty text, an empty text has an empty recipe and equals
other empty texts; rows that repeat a doc_id are rows of their own and share ``keep_id``.
Exactly one row of a group is kept: of several with the largest doc_id the last in the files;
a row without doc_id only where its group has no doc_id, and keep_id is null then. An empty
table gives an empty result. Other input columns, whatever their names, are ignored by
``duplicate_groups`` and passed through by ``drop_duplicates``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apiarium.llm import common, textcore
from apiarium.scratch import materialize

WINDOW = 16
LINE = pa.struct([("file", pa.string()), ("row", pa.int64())])
RECIPE = "line struct<file:string,row:long>, doc_id long, n_bytes long, text_sha256 binary, recipe binary, chunks array<struct<fp:long,len:int,sha:binary>>"


def chunk_ends(data: np.ndarray, off: np.ndarray, mean: int, least: int, most: int) -> list[np.ndarray]:
    """End offsets of each row's chunks: at content-defined places, ``least`` to ``most`` bytes apart."""
    n = len(data)
    cut = np.zeros(0, np.int64)
    if n > WINDOW:
        h = textcore.span_hashes(data, s := np.arange(n - WINDOW), s + WINDOW)
        cut = np.flatnonzero(h & np.uint64(mean - 1) == 0) + WINDOW
    found = []
    for a, b in zip(off[:-1], off[1:], strict=True):
        ends, last = [], a
        for c in cut[np.searchsorted(cut, a + max(WINDOW, least)) : np.searchsorted(cut, b)]:
            while c - last > most:
                last += most
                ends.append(last)
            if c - last >= least:
                ends.append(last := c)
        while b - last > most:
            last += most
            ends.append(last)
        if b > last:
            ends.append(b)
        found.append(np.array(ends, dtype=np.int64))
    return found


def _recipes(mean: int, least: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("line", LINE), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("text_sha256", pa.binary()), ("recipe", pa.binary()), ("chunks", pa.list_(pa.struct([("fp", pa.int64()), ("len", pa.int32()), ("sha", pa.binary())])))])
        for batch in batches:
            lines, ids = batch.column(0).cast(LINE), batch.column(1)
            for i, j, raw, off in textcore.blocks(batch.column(2)):
                data = textcore.LOWER[raw]
                whole, recipes, chunks = [], [], []
                for a, b, ends in zip(off[:-1], off[1:], chunk_ends(data, off, mean, least, most), strict=True):
                    start = np.concatenate([[a], ends[:-1]]) if len(ends) else ends
                    fp = textcore.span_hashes(data[a:b], start - a, ends - a).view(np.int64)
                    size = (ends - start).astype(np.int32)
                    recipes.append(fp.astype(">i8").tobytes() + size.astype(">i4").tobytes())
                    whole.append(hashlib.sha256(data[a:b]).digest())
                    if len(ends) == 1:
                        chunks.append([{"fp": int(fp[0]), "len": int(size[0]), "sha": whole[-1]}])
                    else:
                        chunks.append([{"fp": int(f), "len": int(n), "sha": hashlib.sha256(data[s:e]).digest()} for f, n, s, e in zip(fp, size, start, ends, strict=True)])
                yield pa.RecordBatch.from_arrays([lines.slice(i, j - i), ids.slice(i, j - i), pa.array(np.diff(off)), pa.array(whole, pa.binary()), pa.array(recipes, pa.binary()), pa.array(chunks, schema.field("chunks").type)], schema=schema)

    return textcore.tidy(run)


def recipes(docs: DataFrame, *, mean: int = 4096, least: int = 1024, most: int = 32768) -> DataFrame:
    """One row for each (line, doc_id, text): its chunks, the recipe made of them and the SHA-256 of the text."""
    return docs.select("line", F.col("doc_id").cast("long"), "text").mapInArrow(_recipes(mean, least, most), RECIPE)


def _doubtful(made: DataFrame) -> DataFrame | None:
    """``line`` of the rows with a chunk whose identifier stands for several contents: a hash collision, so nearly always none."""
    chunk = made.select(F.explode("chunks").alias("c")).select("c.*")
    several = chunk.groupBy("fp", "len", "sha").agg(F.lit(1)).groupBy("fp", "len").agg(F.count("*").alias("contents")).filter("contents > 1")
    collided = materialize(several.select("fp", "len"), "collisions")
    if collided.isEmpty():
        return None
    return made.select("line", F.explode("chunks").alias("c")).select("line", "c.fp", "c.len").join(collided, ["fp", "len"], "left_semi").select("line").distinct()


def grouped(docs: DataFrame, **chunking: int) -> DataFrame:
    """line, doc_id, keep_id, group_size, kept, text_sha256 and the columns ``line`` of each row (``line``, doc_id, text)."""
    key = [F.col("n_bytes"), F.xxhash64("recipe").alias("rh"), F.col("recipe")]
    made = materialize(recipes(docs, **chunking), "recipes")
    rows = made.select("line", "doc_id", "text_sha256", *key)
    if (doubtful := _doubtful(made)) is None:
        rows = rows.withColumn("proof", F.lit(b""))
    else:
        rows = rows.join(doubtful.withColumn("doubtful", F.lit(True)), "line", "left").withColumn("proof", F.when(F.col("doubtful"), F.col("text_sha256")).otherwise(F.lit(b"")))
    names = ["n_bytes", "rh", "recipe", "proof"]
    # the largest doc_id stays; of its rows, and of rows without any, the last
    last = F.max(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "line")).alias("last")
    groups = rows.groupBy(*names).agg(last, F.count("*").alias("group_size"))
    out = rows.join(groups, names)
    return out.select("line", "doc_id", F.col("last.doc_id").alias("keep_id"), "group_size", (F.col("last.line") == F.col("line")).alias("kept"), F.lower(F.hex("text_sha256")).alias("text_sha256"))


def _line(place: list[str]) -> Column:
    return F.struct(F.col(place[0]).alias("file"), F.col(place[1]).alias("row")).alias("line")


def duplicate_groups(docs: DataFrame, **chunking: int) -> DataFrame:
    """doc_id, keep_id (largest doc_id of the equal texts), group_size, kept, text_sha256 (hex) for each row."""
    rows, place = common.numbered(docs)
    return grouped(rows.select(_line(place), "doc_id", "text"), **chunking).drop("line")


def drop_duplicates(docs: DataFrame, **chunking: int) -> DataFrame:
    """``docs`` with the one row of each group of equal texts that stays; same columns."""
    rows, place = common.numbered(docs)
    found = grouped(rows.select(_line(place), "doc_id", "text"), **chunking)
    gone = found.filter("not kept").select(F.col("line.file").alias(place[0]), F.col("line.row").alias(place[1]))
    return rows.join(gone, place, "left_anti").select(*common.columns(docs))
