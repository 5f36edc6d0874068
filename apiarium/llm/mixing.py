"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed hash. Its source's budget is first whole passes over the source
(``base`` copies of each document) and then the documents whose hash lies under a threshold.
The threshold is found from sums of words by source and hash bucket; only the bucket that
holds the boundary is cut further, three times by 12 bits. Growing budgets give nested
choices, nothing is sorted, and what leaves a task is at most 4096 sums for each source.

Defined cases: a null text or a text of separators has size 0 and takes 0 words; a null
source is a source of its own, last in order; a source without words has target 0; an empty
table gives an empty result. The hash is one of doc_id and text, so only rows that repeat
both, whatever else they hold, are taken alike; a null doc_id is none to the hash. Other
columns are ignored by ``mixed`` and passed through by ``draw``. The number of sources is bounded by ``max_sources`` (an error beyond it), which bounds
what the driver and a broadcast hold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from apiarium.llm import common
from apiarium.scratch import materialize

BITS, LEVELS = 12, 3
SPACE = BITS * LEVELS


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def share_budget(sizes: dict, weights: tuple[float, ...], share: float, cap: float) -> dict:
    """Target of each source: by weight, at most ``cap`` times its size, the excess shared again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, target = share * sum(sizes.values()), list(order), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * unit > cap * sizes[s]]
        if not over:
            target.update({s: weight[s] * unit for s in free})
            break
        for s in over:
            target[s] = float(cap * sizes[s])
            left -= target[s]
        free = [s for s in free if s not in target]
    return target


def plan(sized: DataFrame, *, weights: tuple[float, ...], share: float, cap: float, max_sources: int) -> DataFrame:
    """source, source_size, target, base, cut: a document is taken ``base`` times and once more if its hash is below ``cut``."""
    spark = sized.sparkSession
    rows = sized.groupBy("source").agg(F.sum("size").alias("n")).limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    sizes = {r["source"]: r["n"] for r in rows}
    target = share_budget(sizes, weights, share, cap)
    table = []
    for s, n in sizes.items():
        base = min(math.floor(target[s] / n), math.floor(cap)) if n else 0
        table.append((s, n, target[s], base, max(0.0, target[s] - base * n)))
    cuts = spark.createDataFrame(table, "source string, source_size long, target double, base int, budget double").withColumn("cut", F.lit(0).cast("long"))
    for level in range(LEVELS):
        shift = SPACE - BITS * (level + 1)
        here = sized.join(F.broadcast(cuts.select(F.col("source").alias("s"), "cut", "budget")), F.col("source").eqNullSafe(F.col("s")))
        # only the bucket that holds the boundary: the bits above agree with the cut so far
        here = here.filter((F.shiftright("h", shift + BITS) == F.shiftright("cut", shift + BITS)) & (F.col("budget") > 0))
        bins = here.groupBy("s", F.shiftright("h", shift).alias("bin")).agg(F.sum("size").alias("n"))
        w = Window.partitionBy("s").orderBy("bin")
        bins = bins.withColumn("upto", F.sum("n").over(w))
        bins = bins.join(F.broadcast(cuts.select(F.col("source").alias("s2"), "budget")), F.col("s").eqNullSafe(F.col("s2")))
        under = F.col("upto") <= F.col("budget")
        found = bins.groupBy("s").agg(F.max(F.when(under, F.col("bin"))).alias("below"), F.min(F.when(~under, F.col("bin"))).alias("at"), F.max(F.when(under, F.col("upto"))).alias("taken"), F.min(F.when(~under, F.col("upto"))).alias("over")).collect()
        by = {r["s"]: r for r in found}
        table = []
        for s, n, t, base, budget, cut in [tuple(r) for r in cuts.collect()]:
            if (r := by.get(s)) and budget > 0:
                budget -= r["taken"] or 0
                if r["at"] is None:
                    cut, budget = (r["below"] + 1) << shift, 0.0  # all of it fits
                else:
                    cut = r["at"] << shift
                    if level == LEVELS - 1 and r["over"] - (r["taken"] or 0) - budget < budget:
                        cut += 1 << shift  # one more bucket comes nearer to the budget
            table.append((s, n, t, base, budget, cut))
        cuts = spark.createDataFrame(table, "source string, source_size long, target double, base int, budget double, cut long")
    return cuts.drop("budget")


def _place(seed: int) -> Column:
    """The document's fixed place, a number of SPACE bits."""
    return F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(seed)), 64 - SPACE)


def mixed(docs: DataFrame, *, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0, seed: int = 17, max_sources: int = 100_000) -> DataFrame:
    """doc_id, size, source_size, target and taken (words that the mix takes of it) for each row of ``docs``."""
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _place(seed).alias("h")), "sized")
    cuts = plan(sized, weights=weights, share=share, cap=cap, max_sources=max_sources).withColumnRenamed("source", "s")
    copies = F.col("base") + (F.col("h") < F.col("cut")).cast("int")
    out = sized.join(F.broadcast(cuts), F.col("source").eqNullSafe(F.col("s")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.cast("long").alias("copies"))


def draw(docs: DataFrame, *, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0, seed: int = 17, max_sources: int = 100_000) -> DataFrame:
    """The mixture itself: the rows of ``docs``, each as often as it is taken; same columns."""
    sized = materialize(docs.select("source", word_count(F.col("text")).alias("size"), _place(seed).alias("h")), "sized")
    cuts = plan(sized, weights=weights, share=share, cap=cap, max_sources=max_sources)
    source, mix, copy = (common.fresh(n, docs.columns) for n in ("_mix_source", "_mix", "_mix_copy"))
    cuts = cuts.select(F.col("source").alias(source), F.struct("base", "cut").alias(mix))
    out = docs.join(F.broadcast(cuts), docs["source"].eqNullSafe(F.col(source)))
    n = F.col(mix)["base"] + (_place(seed) < F.col(mix)["cut"]).cast("int")
    return out.withColumn(copy, F.explode(F.array_repeat(F.lit(1), n))).select(*common.columns(docs))
