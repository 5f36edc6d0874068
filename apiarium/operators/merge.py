"""Merging the variants of one symbol across target frameworks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_variants(rows: DataFrame, *, uid: str, tag: str, rank: Column, order: list[str], url: str | None = None, payload: list[str] = ()) -> DataFrame:
    """One row for each uid: the canonical variant's payload, ``applies_to`` and the source url.

    Variants are ordered by rank, then by ``order``. ``applies_to`` keeps duplicates. The url is
    the canonical variant's unless that is null, then the first non-empty one; '' of the canonical
    variant is kept. Rows with an empty uid are dropped.
    One shuffle, on the uid. Only the canonical payload leaves a task (the least by order is kept
    map-side); what is collected of each variant is its place, tag and url.
    """
    place = [(-rank).alias("_rank"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.col(tag).alias("_tag")]
    place += [F.col(url).alias("_url")] if url else []
    kept = [F.array_sort(F.collect_list(F.struct(*place))).alias("v")]
    if payload:  # rows equal in all that orders them are told apart by their payload
        whole = F.struct(*[F.col(c) for c in payload])
        kept.append(F.min_by(whole, F.struct(*place, F.xxhash64(*payload).alias("_hash"))).alias("p"))
    v = rows.filter(F.col(uid) != "").groupBy(F.col(uid).alias("uid")).agg(*kept)
    first = F.get("v", F.lit(0))
    out = [F.col("uid"), first["_tag"].alias("canonical_tag"), *[F.col("p")[c].alias(c) for c in payload], F.transform("v", lambda x: x["_tag"]).alias("applies_to")]
    if url:
        other = F.get(F.filter("v", lambda x: x["_url"] != ""), F.lit(0))["_url"]
        out.append(F.coalesce(first["_url"], other).alias("source_url"))
    return v.select(*out)


def merge_into(state: DataFrame, catalog: DataFrame) -> DataFrame:
    """Append one catalog's variants to the variants so far; finish with ``merge_variants``."""
    return state.unionByName(catalog, allowMissingColumns=True)


def broadcast_rows(canonical: DataFrame, folded: str, tag: str) -> DataFrame:
    """A copy of each canonical row for every tag of its array ``folded``, besides its own."""
    tags = F.concat(F.array(F.col(tag)), F.coalesce(F.col(folded), F.array().cast("array<string>")))
    return canonical.withColumn(tag, F.explode(tags)).drop(folded)


def fold_subsets(groups: DataFrame, *, key: str, members: str, rank: str) -> DataFrame:
    """key, canonical: each group attached to the first group in order (rank descending, then key)
    whose set of members holds all of its own, itself if there is none.

    Groups are joined through their least frequent common member, never with each other at
    large: a superset holds every member of the subset, so it holds the rarest one. The empty set
    is attached to the first group of all.
    """
    g = groups.select(F.col(key).alias("k"), F.array_sort(F.array_distinct(members)).alias("m"), F.col(rank).alias("r"))
    each = g.select("k", "m", "r", F.explode("m").alias("x"))
    seen = each.groupBy("x").agg(F.count("*").alias("n"))
    rarest = each.join(seen, "x").groupBy("k").agg(F.min_by("x", F.struct("n", "x")).alias("x"))
    # equal sets are one candidate, named by its first group
    best = g.groupBy("m").agg(F.min(F.struct((-F.col("r")).alias("r"), F.col("k").alias("k"))).alias("first"))
    own = F.struct((-F.col("r")).alias("r"), F.col("k").alias("k"))
    # candidates are names only; whole sets are fetched for those in the right order
    holds = best.select(F.explode("m").alias("x"), "first")
    pairs = g.select("k", own.alias("own")).join(rarest, "k").join(holds, "x").filter(F.col("first") <= F.col("own")).select("k", "first")
    found = pairs.join(g.select("k", "m"), "k").join(best.select("first", F.col("m").alias("big")), "first")
    chosen = found.filter(F.size(F.array_except("m", "big")) == 0).groupBy("k").agg(F.min("first")["k"].alias("canonical"))
    empty = g.filter(F.size("m") == 0).select("k").crossJoin(F.broadcast(g.agg(F.min(own)["k"].alias("canonical"))))
    return chosen.unionByName(empty).select(F.col("k").alias(key), "canonical")


def _with_missing(mine: Column, theirs: Column) -> Column:
    return F.concat(mine, F.filter(theirs, lambda p: ~F.exists(mine, lambda c: c["name"] == p["name"])))


def merge_documentation(child: Column, parent: Column, fields: list[str], keyed: list[str]) -> Column:
    """Child fields where they are not empty, else the parent's; keyed entries of the parent whose key the child lacks follow."""
    out = [F.coalesce(F.nullif(child[f], F.lit("")), parent[f]).alias(f) for f in fields]
    for f in keyed:
        out.append(_with_missing(F.coalesce(child[f], F.array()), F.coalesce(parent[f], F.array())).alias(f))
    return F.struct(*out)
