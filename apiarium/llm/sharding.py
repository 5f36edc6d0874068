"""Sharding by a k-d tree over document metadata, with DataFrame operations only.

Space is cut level by level, all nodes of a level together: a node that owes m shards is
divided at the weighted quantile floor(m/2)/m along its widest dimension. The quantile comes
from distributed sums of bytes over 4096 bins of each node, refined inside the bin that holds
it until that bin weighs less than a set part of a leaf. A leaf holds about the target bytes.

Dimensions are source, language, size and doc_id of a *group*: documents of equal text take
the coordinates of their smallest doc_id. A value of source or language is the share of all
bytes that lies before it in the order of values, so every value has the room that it weighs.
Inside a value a hash of the text parts the groups, and, 2^30 times finer, a hash of the row
parts a group. So copies fall into one shard, except where a cut has to go through a group,
as it does through one too heavy for the balance; the rule is the same for all groups.

Nodes and cuts are tables that are joined by node number, so nothing of a number that grows
with the data or the shards is collected: the driver sees four extents and two totals.

Defined cases: a null text weighs ``overhead`` bytes; null source or language is the lowest
value; a null doc_id counts as 0; rows that repeat a doc_id are rows of their own; an empty
table gives an empty result. Columns of the input other than those named are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from apiarium.scratch import discard, materialize, settle

DIMS = ("d0", "d1", "d2", "d3")
BINS = 4096


def metadata(docs: DataFrame, overhead: int = 16) -> DataFrame:
    """The columns that the tree needs; the text is read once and goes no further."""
    body = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    return docs.select("doc_id", "source", "lang", (F.length(body) + F.lit(overhead)).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), key.alias("text_key"), F.monotonically_increasing_id().alias("line"))


def value_room(rows: DataFrame, value: Column, weight: Column) -> DataFrame:
    """(v, before, share): of all weight, what lies before each value in order and what it has itself.

    Values are dealt by range, summed in their ranges, and the ranges' sums (one for each
    shuffle partition) are added up; no task sees all values.
    """
    values = rows.groupBy(value.alias("v")).agg(F.sum(weight).alias("w"))
    ranged = materialize(values.repartitionByRange("v").withColumn("part", F.spark_partition_id()), "values")
    parts = ranged.groupBy("part").agg(F.sum("w").alias("pw"))
    upto = F.sum("pw").over(Window.orderBy("part"))
    total = F.sum("pw").over(Window.partitionBy(F.lit(0)))
    parts = parts.select("part", (upto - F.col("pw")).alias("base"), total.alias("total"))
    inside = F.sum("w").over(Window.partitionBy("part").orderBy(F.asc_nulls_first("v"))) - F.col("w")
    return ranged.join(F.broadcast(parts), "part").select("v", ((F.col("base") + inside) / F.col("total")).alias("before"), (F.col("w") / F.col("total")).alias("share"))


def _unit(*c: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(*c), F.lit(1 << bits)) / (1 << bits)


def coordinates(meta: DataFrame) -> DataFrame:
    """Adds d0 to d3 to each row: those of its text's group, with the row's own hash in the last digits."""
    own = F.struct(F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), "source", "lang")
    key = ["text_key", "text_crc32", "size"]
    several = meta.groupBy(*key).agg(F.min(own).alias("g"), F.count("*").alias("n")).filter("n > 1").drop("n")
    rows = materialize(meta.join(several, key, "left").withColumn("g", F.coalesce("g", own)), "groups")
    inner = _unit(F.col("text_key"), F.col("text_crc32"), bits=30) + _unit(F.col("line"), F.lit(1), bits=20) / (1 << 30)
    rows = rows.withColumn("inner", inner)
    for d, name in (("d0", "source"), ("d1", "lang")):
        room = value_room(rows, F.col(f"g.{name}"), F.col("size"))
        rows = rows.join(room, F.col(f"g.{name}").eqNullSafe(F.col("v")))
        rows = rows.withColumn(d, F.col("before") + F.col("share") * F.col("inner")).drop("v", "before", "share")
    d2 = F.log2(F.col("size").cast("double") + 1) + F.col("inner") / 64
    d3 = F.col("g.id").cast("double") + F.col("inner") / 4096
    return rows.select("doc_id", "size", "text_crc32", "d0", "d1", d2.alias("d2"), d3.alias("d3"))


def _along() -> Column:
    """The row's coordinate along the dimension ``dim``."""
    return F.element_at(F.array(*map(F.col, DIMS)), F.col("dim"))


def _refined(at: DataFrame, cuts: DataFrame, light: float) -> DataFrame:
    """The open cuts after one more division of their intervals: closer, or settled."""
    here = at.join(cuts.select("node", "dim", "lo", "hi"), "node").withColumn("x", _along()).filter("x between lo and hi")
    bin_ = F.least(F.lit(BINS - 1), F.floor((F.col("x") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-300)) * BINS))
    bins = here.groupBy("node", bin_.alias("bin")).agg(F.sum("size").alias("w"), F.min("x").alias("a"), F.max("x").alias("b"))
    bins = bins.withColumn("upto", F.sum("w").over(Window.partitionBy("node").orderBy("bin")))
    # the first bin that reaches what is wanted below the cut; the last one, if rounding leaves none
    bins = bins.join(cuts.select("node", "want"), "node")
    hit = bins.groupBy("node").agg(F.coalesce(F.min_by(F.struct("w", "a", "b", "upto"), F.when(F.col("upto") >= F.col("want"), F.col("bin"))), F.max_by(F.struct("w", "a", "b", "upto"), "bin")).alias("h"))
    left = F.col("want") - (F.col("h.upto") - F.col("h.w"))
    settled = (F.col("h.w") <= light) | (F.col("h.a") == F.col("h.b"))
    # the bin goes where its larger part is wanted
    whole = left > F.col("h.w") / 2
    out = cuts.drop("done", "at", "closed").join(hit, "node")
    keep = [c for c in cuts.columns if c not in ("want", "lo", "hi", "done", "at", "closed")]
    return out.select(*keep, left.alias("want"), F.col("h.a").alias("lo"), F.col("h.b").alias("hi"), settled.alias("done"), F.when(whole, F.col("h.b")).otherwise(F.col("h.a")).alias("at"), whole.alias("closed"))


def split(rows: DataFrame, shards: int, tolerance: float = 0.002) -> DataFrame:
    """``rows`` (size, d0 to d3) with the column ``shard``, 0 to shards - 1."""
    whole = rows.agg(*[(F.max(d) - F.min(d)).alias(d) for d in DIMS], F.sum("size").alias("w")).first()
    if whole["w"] is None or shards < 2:
        return rows.withColumn("shard", F.lit(0))
    light = tolerance * whole["w"] / shards
    # node, its first shard, how many it owes
    nodes = rows.sparkSession.range(1).select(F.lit(0).cast("long").alias("node"), F.lit(0).alias("first"), F.lit(shards).alias("m"))
    at = rows.withColumn("node", F.lit(0).cast("long"))
    for _ in range(math.ceil(math.log2(shards))):
        stats = at.groupBy("node").agg(*[f(d).alias(f"{n}_{d}") for d in DIMS for n, f in (("lo", F.min), ("hi", F.max))], F.sum("size").alias("w"))
        wide = F.array(*[F.struct(((F.col(f"hi_{d}") - F.col(f"lo_{d}")) / max(whole[d], 1e-12)).alias("extent"), F.lit(-i).alias("i"), F.col(f"lo_{d}").alias("lo"), F.col(f"hi_{d}").alias("hi")) for i, d in enumerate(DIMS, 1)])
        want = F.col("w") * F.floor(F.col("m") / 2) / F.col("m")
        cuts = stats.join(nodes.filter("m > 1"), "node").withColumn("widest", F.array_max(wide))
        cuts = materialize(cuts.select("node", (-F.col("widest.i")).alias("dim"), want.alias("want"), "widest.lo", "widest.hi", F.lit(False).alias("done"), F.lit(0.0).alias("at"), F.lit(True).alias("closed")), "kd-cuts")
        settled = []
        while not cuts.isEmpty():
            found = materialize(_refined(at, cuts, light), "kd-cuts")
            settled.append(found.filter("done"))
            cuts = found.filter("not done")
        done = settled[0]
        for more in settled[1:]:
            done = done.union(more)
        below = (_along() < F.col("at")) | ((_along() == F.col("at")) & F.col("closed"))
        child = F.when(F.col("dim").isNull(), F.col("node")).otherwise(2 * F.col("node") + F.when(below, 1).otherwise(2))
        moved = materialize(at.join(done.select("node", "dim", "at", "closed"), "node", "left").withColumn("node", child).select(*rows.columns, "node"), "kd-level")
        if hasattr(at, "_scratch_path"):
            discard(at)
        at = moved
        settle(rows.sparkSession)
        half = F.floor(F.col("m") / 2).cast("int")
        sides = F.array(F.struct((2 * F.col("node") + 1).alias("node"), F.col("first"), half.alias("m")), F.struct((2 * F.col("node") + 2).alias("node"), (F.col("first") + half).alias("first"), (F.col("m") - half).alias("m")))
        nodes = nodes.select(F.explode(F.when(F.col("m") > 1, sides).otherwise(F.array(F.struct("node", "first", "m")))).alias("n")).select("n.*")
    return at.join(nodes.select("node", F.col("first").cast("int").alias("shard")), "node").drop("node")


def with_slots(rows: DataFrame, shards: int, spread: int) -> DataFrame:
    """Adds ``slot``: 0, 1, 2.. within the shard, without sorting a shard in one task."""
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(spread)).cast("int"))
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = counts.withColumn("base", F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).drop("n")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")))
    return ranked.join(before, ["shard", "part"]).withColumn("slot", (F.col("base") + F.col("rank") - 1).cast("long")).drop("base", "rank", "part")


def kd_shards(docs: DataFrame, *, shards: int | None = None, target_bytes: int | None = None, overhead: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of ``docs``.

    Either the number of shards is given, or ``target_bytes``, the size of a leaf.
    """
    meta = materialize(metadata(docs, overhead), "metadata")
    total = meta.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("w"), F.count("*").alias("n")).first()
    if shards is None:
        if not target_bytes:
            raise ValueError("give shards or target_bytes")
        shards = max(1, math.ceil(total["w"] / target_bytes))
    rows = materialize(coordinates(meta), "coordinates")
    out = with_slots(split(rows, shards), shards, max(16, math.ceil(total["n"] / (shards * 100_000))))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
