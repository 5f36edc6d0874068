"""Rows from nested catalogs: types, members, parameters, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apiarium.operators import filters


def work_items(groups: DataFrame) -> DataFrame:
    """One row for each assembly path of each group (tfm, paths, ...)."""
    return groups.select("tfm", F.posexplode("paths").alias("ord", "path"))


def members(types: DataFrame) -> DataFrame:
    """Visible, declared, classified members with their place in the type; ``types`` has uid and an array ``members``."""
    rows = types.select(F.col("uid").alias("type_uid"), F.posexplode("members").alias("ord", "m")).select("type_uid", "ord", "m.*")
    if "accessibility" in rows.columns:
        rows = rows.filter(filters.externally_visible(F.col("accessibility")))
    return rows.filter(F.col("kind").isNotNull())


def parameters(member_rows: DataFrame) -> DataFrame:
    return member_rows.select(F.col("uid").alias("member_uid"), F.posexplode("parameters").alias("ord", "p")).select("member_uid", "ord", "p.*")


def extension_members(types: DataFrame) -> DataFrame:
    """Members of the extension blocks of static types, with their receiver."""
    blocks = types.filter("is_static").select(F.col("uid").alias("host_uid"), F.posexplode("extension_blocks").alias("block", "b"))
    return blocks.select("host_uid", "block", "b.receiver", F.posexplode("b.members").alias("ord", "m")).select("host_uid", "block", "receiver", "ord", "m.*")


def union_cases(types: DataFrame) -> DataFrame:
    """(union, case, ord): types of the same assembly whose base is the union."""
    cases = types.select(F.col("uid").alias("case_uid"), F.col("base_uid").alias("union_uid"), "assembly_name", "full_name")
    unions = types.filter("type_kind = 'union'").select(F.col("uid").alias("union_uid"), "assembly_name")
    return cases.join(unions, ["union_uid", "assembly_name"]).select("union_uid", "case_uid", "full_name")


def enum_values(types: DataFrame) -> DataFrame:
    return types.filter("type_kind = 'enum'").select(F.col("uid").alias("type_uid"), F.posexplode("values").alias("ord", "v")).select("type_uid", "ord", "v.*")


def first_types(rows: DataFrame) -> DataFrame:
    """Types once by uid, the first seen (by ``ord``); forwarded types come after declared ones. Empty uids are kept."""
    keyed = rows.filter("uid <> ''").groupBy("uid").agg(F.min_by(F.struct(*rows.columns), F.struct("forwarded", "ord")).alias("r")).select("r.*")
    return keyed.unionByName(rows.filter("uid = ''"))


def source_links(types: DataFrame, member_rows: DataFrame) -> DataFrame:
    """(uid, url) of types, then of members, where there is a url; enum values have none of their own."""
    ok = F.col("source_url").isNotNull() & (F.col("source_url") != "")
    return types.filter(ok).select("uid", F.col("source_url").alias("url")).union(member_rows.filter(ok & (F.col("kind") != "EnumValue")).select("uid", F.col("source_url").alias("url")))


def child_uids(members_array: Column) -> Column:
    """Sorted uids of the members that the compiler did not make, without their kind prefix."""
    kept = F.filter(members_array, lambda m: ~filters.compiler_generated(m["name"]))
    return F.array_sort(F.transform(kept, lambda m: F.regexp_replace(m["uid"], "^.:", "")))


def kept_count(members_array: Column) -> Column:
    return F.size(F.filter(members_array, lambda m: ~filters.compiler_generated(m["name"])))


def overload_groups(member_rows: DataFrame, *, owner: list[str], name: str, order: str) -> DataFrame:
    """Groups of members of one name: size and first place, in first-seen order."""
    return member_rows.groupBy(*owner, name).agg(F.count("*").alias("overloads"), F.min(order).alias("first"))


def first_overloads(member_rows: DataFrame, *, owner: list[str], kind: str, name: str, order: list[str], kinds: list[str]) -> DataFrame:
    """One row for each name within a kind, the first overload, with the kind's place in ``kinds``; other kinds are left out."""
    rest = [c for c in member_rows.columns if c not in (*owner, kind, name)]
    place = F.array_position(F.array(*map(F.lit, kinds)), F.col(kind))
    best = member_rows.filter(F.col(kind).isin(kinds)).groupBy(*owner, kind, name).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("f"))
    return best.select(*owner, kind, name, place.alias("kind_place"), "f.*")


def description(entries: Column, name: Column, missing: str = "--") -> Column:
    """Text of the first documentation entry of that name."""
    return F.coalesce(F.get(F.filter(entries, lambda e: e["name"] == name), F.lit(0))["value"], F.lit(missing))


def run_metrics(types: DataFrame, *, uid: Column, url: Column, failed: Column) -> DataFrame:
    """One row of counters: types, links and load failures."""
    return types.agg(F.count_distinct(uid).alias("types"), F.count_if(url.isNotNull() & (url != "")).alias("links"), F.count_if(failed).alias("load_failures"))
