"""Indexes over a catalog: derived types, extension members, inherited members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Members that every class has.
BASELINE = ("System.Object.Equals(System.Object)", "System.Object.Equals(System.Object,System.Object)", "System.Object.GetHashCode", "System.Object.GetType", "System.Object.MemberwiseClone", "System.Object.ReferenceEquals(System.Object,System.Object)", "System.Object.ToString")


def _list(rows: DataFrame, key: Column, order: list[Column], value: Column, name: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], value.alias("value"))))
    return rows.groupBy(key.alias("uid")).agg(F.transform(ordered, lambda x: x["value"]).alias(name))


def derived(types: DataFrame, *, base: Column, order: list[Column], reference: Column) -> DataFrame:
    """uid of a base -> references of the types that name it, in order; the base uid is compared as it is."""
    return _list(types.filter(base.isNotNull() & (base != "")), base, order, reference, "derived")


def extensions(members: DataFrame, *, host_is_static: Column, is_extension: Column, target: Column, order: list[Column], member: Column) -> DataFrame:
    """uid of the extended type -> extension members of static hosts, in order."""
    kept = members.filter(host_is_static & is_extension & target.isNotNull())
    return _list(kept, target, order, member, "extensions")


def inherited(types: DataFrame, members: DataFrame, *, kinds: tuple[str, ...] = ("Class", "Record"), baseline: tuple[str, ...] = BASELINE) -> DataFrame:
    """uid -> member uids of its base if that is in the catalog (one level), then the baseline.

    types: uid, base_uid, kind; members: type_uid, ord, uid, name. Generated and empty uids are left out.
    """
    kept = members.filter((F.col("uid") != "") & ~F.col("name").rlike("[<>]"))
    of_type = _list(kept, F.col("type_uid"), [F.col("ord")], F.col("uid"), "members").withColumnRenamed("uid", "base_uid")
    out = types.filter(F.col("kind").isin(*kinds)).join(of_type, "base_uid", "left")
    return out.select("uid", F.concat(F.coalesce("members", F.array().cast("array<string>")), F.array(*map(F.lit, baseline))).alias("inherited"))


def lookup(rows: DataFrame, index: DataFrame, *, key: str, value: str) -> DataFrame:
    """``rows`` with the list of its uid; an empty list where the index has none."""
    kind = index.schema[value].dataType
    found = index.select(F.col("uid").alias("_uid"), value)
    return rows.join(found, F.col(key) == F.col("_uid"), "left").drop("_uid").withColumn(value, F.coalesce(value, F.array().cast(kind)))


def emitted_uids(*frames: DataFrame) -> DataFrame:
    """Distinct uids of types, members and enum values (one column each)."""
    out = frames[0].toDF("uid")
    for f in frames[1:]:
        out = out.union(f.toDF("uid"))
    return out.filter("uid is not null and uid <> ''").distinct()


def references(rows: DataFrame, *, owner: Column, tier: Column, order: Column, uid: Column, display: Column) -> DataFrame:
    """References of each page, distinct by uid (by display without one), first seen first."""
    key = F.coalesce(F.nullif(uid, F.lit("")), display)
    first = rows.groupBy(owner.alias("owner"), key.alias("key")).agg(F.min(F.struct(tier.alias("tier"), order.alias("ord"), uid.alias("uid"), display.alias("display"))).alias("first"))
    return _list(first, F.col("owner"), [F.col("first.tier"), F.col("first.ord")], F.struct("first.uid", "first.display"), "references")


def group_by_file(rows: DataFrame, *, url: Column, uid: Column) -> DataFrame:
    """File of a source link (without anchor) -> its uids in order."""
    return rows.filter(url.isNotNull() & (url != "")).groupBy(F.split_part(url, F.lit("#"), F.lit(1)).alias("file")).agg(F.array_sort(F.collect_list(uid)).alias("uids"))


def tree(rows: DataFrame, *, package: Column, namespace: Column, title: Column, entry: Column) -> DataFrame:
    """package -> namespaces -> entries, each sorted."""
    inner = rows.groupBy(package.alias("package"), namespace.alias("namespace")).agg(F.array_sort(F.collect_list(F.struct(title.alias("title"), entry.alias("entry")))).alias("entries"))
    return inner.groupBy("package").agg(F.array_sort(F.collect_list(F.struct("namespace", "entries"))).alias("namespaces"))
