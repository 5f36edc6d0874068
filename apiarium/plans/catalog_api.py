"""The facade: extract (merge), index, navigate and render a catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apiarium.functions import tfm, uid
from apiarium.operators import flatten, indexes, merge
from apiarium.plans import pages
from apiarium.scratch import materialize


def extract(catalog: DataFrame, broadcast: DataFrame | None = None) -> DataFrame:
    """One row a type over all frameworks: the canonical variant with ``applies_to`` and its source url.

    ``broadcast`` (tfm, broadcast_tfms): frameworks folded into another, whose types are copied to them.
    """
    if broadcast is not None:
        catalog = merge.broadcast_rows(catalog.join(broadcast, "tfm", "left"), "broadcast_tfms", "tfm")
    payload = [c for c in catalog.columns if c not in ("uid", "tfm", "source_url")]
    merged = merge.merge_variants(catalog, uid="uid", tag="tfm", rank=tfm.rank(F.col("tfm")), order=["tfm", "full_name"], url="source_url", payload=payload)
    return merged


def build_indexes(types: DataFrame) -> dict[str, DataFrame]:
    """derived, extensions and inherited of a merged catalog."""
    rows = types.select(F.col("uid").alias("type_uid"), F.col("name").alias("host"), F.col("is_static").alias("host_is_static"), F.posexplode("members").alias("ord", "m"))
    members = rows.select("type_uid", "host", "host_is_static", "ord", "m.*")
    first = F.get("parameters", F.lit(0))["type"]["uid"]
    return {
        "derived": indexes.derived(types, base=F.col("base.uid"), order=[F.col("full_name"), F.col("uid")], reference=F.struct(F.col("name").alias("display_name"), F.col("uid"))),
        "extensions": indexes.extensions(members, host_is_static=F.col("host_is_static"), is_extension=F.col("is_extension"), target=first, order=[F.col("type_uid"), F.col("ord")], member=F.struct(F.col("host").alias("container"), "name", "uid")),
        "inherited": indexes.inherited(types.select("uid", F.col("base.uid").alias("base_uid"), F.col("object_kind").alias("kind")), members.select("type_uid", "ord", "uid", "name")),
    }


def navigate(types: DataFrame) -> DataFrame:
    """package -> namespaces -> types."""
    return indexes.tree(types, package=F.col("assembly_name"), namespace=F.col("namespace"), title=F.col("name"), entry=F.struct("uid", F.coalesce("object_kind", "type_kind").alias("kind")))


def with_indexes(types: DataFrame) -> DataFrame:
    """``types`` with derived, inherited and extensions, and ``emitted``: those of the uids that its page refers to which have a page."""
    found = build_indexes(types)
    out = types
    for name in ("derived", "inherited", "extensions"):
        out = indexes.lookup(out, found[name], key="uid", value=name)
    texts = "array<string>"
    some = lambda c: F.coalesce(c, F.array().cast(texts))
    refs = F.transform(pages.type_references(out), lambda r: r["uid"])
    of_members = F.flatten(F.transform("members", lambda m: F.coalesce(m["documentation"]["see_also"], F.array().cast(texts))))
    named = F.concat(some(refs), some(F.col("documentation.see_also")), some(of_members), some(F.transform("cases", lambda c: c["uid"])), some(F.transform("derived", lambda r: r["uid"])), some(F.col("inherited")), some(F.transform("extensions", lambda m: m["uid"])))
    named = F.array_distinct(F.concat(named, F.transform(F.filter(named, lambda u: u.isNotNull()), uid.open_generic)))
    known = indexes.emitted_uids(types.select("uid"), types.select(F.explode("members.uid")), types.select(F.explode("values.uid")))
    asked = out.select(F.col("uid").alias("page"), F.explode(named).alias("uid")).join(known, "uid", "left_semi")
    emitted = asked.groupBy(F.col("page").alias("uid")).agg(F.array_sort(F.collect_set(F.col("uid"))).alias("emitted"))
    return indexes.lookup(out, emitted, key="uid", value="emitted")


def run(catalog: DataFrame, output: str, flavour: str = "markdown") -> DataFrame:
    """Merge, index, render and write; one row of counters.

    The merged catalog is written once and read by every page, index and counter.
    """
    merged = materialize(extract(catalog), "merged")
    types = materialize(pages.documented(with_indexes(merged)), "documented")
    out = pages.yaml_pages(types) if flavour == "yaml" else pages.type_pages(types).union(pages.member_pages(types)).union(pages.landing_pages(types))
    n = pages.write_pages(out, output)
    links = flatten.source_links(merged, merged.select(F.explode("members").alias("m")).select("m.*"))
    return merged.agg(F.count("*").alias("types")).crossJoin(F.broadcast(links.agg(F.count("*").alias("links")))).withColumn("pages", F.lit(n).cast("long"))
