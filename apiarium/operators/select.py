"""Ranked picks: first-match rules, tiers, compatible frameworks, first-seen, folds of settings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from apiarium.functions import tfm as tfms

MAX_RULES = 4096


def first_rule(value: Column, rules: list[tuple[str, Column]]) -> Column:
    """Result of the first rule whose prefix the value begins with; null without one.

    A bounded rule list is an expression: no join, no shuffle, short-circuit evaluation.
    """
    if len(rules) > MAX_RULES:
        raise ValueError("use route() for rule tables")
    return F.coalesce(*[F.when(value.startswith(p), out) for p, out in rules], F.lit(None).cast("string"))


def boundary_rule(name: Column, rules: list[tuple[str, str]]) -> Column:
    """Folder of the first (prefix, folder) whose prefix is the name or ends at a dot of it."""
    if not rules:
        return name
    return F.coalesce(*[F.when((name == p) | name.startswith(f"{p}."), F.lit(f)) for p, f in rules])


def route(rows: DataFrame, rules: DataFrame, *, name: str, key: list[str]) -> DataFrame:
    """``boundary_rule`` for a rule table (ord, prefix, folder) of any size; unmatched rows are dropped.

    Each name meets the rules in an equi-join on its own dotted prefixes, not by comparing with all.
    """
    parts = F.split(F.col(name), r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    hit = rows.withColumn("_p", F.explode(prefixes)).join(rules.select(F.col("prefix").alias("_p"), "ord", "folder"), "_p")
    rest = [c for c in rows.columns if c not in key]
    return hit.groupBy(*key).agg(*[F.first(c).alias(c) for c in rest], F.min_by("folder", "ord").alias("folder"))


def source_url(path: Column, entries: list[tuple[str, str, bool]]) -> Column:
    """First entry (local prefix, url, wildcard) that the path matches: its url, with the rest of the path for a wildcard."""
    low = F.lower(F.translate(path, "\\", "/"))
    out = []
    for local, url, wildcard in entries:
        p = local.replace("\\", "/").lower()
        rest = F.translate(F.substring(path, len(p) + 1, 1 << 30), "\\", "/")
        out.append(F.when(low.startswith(p), F.concat(F.lit(url), rest)) if wildcard else F.when(low == p, F.lit(url)))
    return F.coalesce(*out)


def tiered_pick(rows: DataFrame, *, group: list[str], available: Column, order: Column, preferences: list[str], override: Column | None = None) -> DataFrame:
    """The available framework that comes first by tier (override, exact, prefix, family, best netstandard), then by preference, then by order."""
    low = F.lower(available)
    tiers = []
    if override is not None:
        o = F.lower(override)
        tiers.append(F.when(override.isNotNull() & (low == o), F.struct(F.lit(0).alias("tier"), F.lit(0).alias("pref"))))
        tiers.append(F.when(override.isNotNull() & low.startswith(o), F.struct(F.lit(1).alias("tier"), F.lit(0).alias("pref"))))
    for tier, test in ((2, lambda p: low == p.lower()), (3, lambda p: low.startswith(p.lower())), (4, lambda p: (tfms.family(available) == tfms.family(F.lit(p))) & tfms.version(available).startswith(tfms.version(F.lit(p))))):
        tiers += [F.when(test(p), F.struct(F.lit(tier).alias("tier"), F.lit(i).alias("pref"))) for i, p in enumerate(preferences)]
    tiers.append(F.when(tfms.is_netstandard(available), F.struct(F.lit(5).alias("tier"), (-tfms.rank(available)).alias("pref"))))
    ranked = rows.withColumn("_tier", F.coalesce(*tiers)).filter("_tier is not null")
    return ranked.groupBy(*group).agg(F.min_by(available, F.struct("_tier", order)).alias("picked"))


def all_supported(rows: DataFrame, *, group: list[str], available: Column, preferences: list[str]) -> DataFrame:
    """All frameworks that match a preference; for a group without any, its netstandard ones."""
    match = reduce(lambda a, b: a | b, [tfms.matches(available, F.lit(p)) for p in preferences], F.lit(False))
    rows = rows.withColumn("_m", match).withColumn("_any", F.max("_m").over(Window.partitionBy(*group)))
    return rows.filter(F.col("_m") | (~F.col("_any") & tfms.is_netstandard(available))).drop("_m", "_any")


def best_reference(lib: Column, refs: Column) -> Column:
    """Best of an array of reference frameworks for one library framework.

    Exact, then without the platform, then the nearest compatible of the family, then for
    netstandard the highest modern one; null if none fits. Per row, without a join.
    """
    low = F.lower(lib)
    exact = F.get(F.filter(refs, lambda r: F.lower(r) == low), F.lit(0))
    bare = F.get(F.filter(refs, lambda r: F.lower(r) == F.split_part(low, F.lit("-"), F.lit(1))), F.lit(0))
    ranked = F.transform(refs, lambda r: F.struct(tfms.rank(r).alias("rank"), r.alias("r")))
    nearest = F.array_max(F.filter(ranked, lambda x: (tfms.family(x["r"]) == tfms.family(lib)) & (x["rank"] <= tfms.rank(lib))))["r"]
    modern = F.array_max(F.filter(ranked, lambda x: (tfms.family(x["r"]) == "net") & (x["rank"] >= 500)))["r"]
    return F.coalesce(exact, bare, nearest, F.when(tfms.is_netstandard(lib), modern))


def compatible(rows: DataFrame, targets: DataFrame, *, family: str, version: str, target: str, order: list[str]) -> DataFrame:
    """Candidates of the target's family with at most its version, best first within the target (column ``place``)."""
    hit = rows.join(targets, family).filter(F.col(version) <= F.col(target))
    return hit.withColumn("place", F.row_number().over(Window.partitionBy(family, target).orderBy(F.desc(version), *order)))


def first_seen(rows: DataFrame, *, key: list[Column], order: list[str], names: list[str]) -> DataFrame:
    """The first row of each key; map-side minima, so a hot key is no hot task."""
    rest = [c for c in rows.columns]
    first = rows.groupBy(*[k.alias(n) for k, n in zip(key, names, strict=True)]).agg(F.min(F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], *[F.col(c) for c in rest])).alias("f"))
    return first.select(*names, *[F.col("f")[c].alias(c) for c in rest if c not in names])


def clear_fold(rows: DataFrame, *, scope: list[str], order: list[str], is_clear: Column, key: Column, value: Column) -> DataFrame:
    """First value of each key after the last clear of its scope, and whether there was a clear.

    Two map-side aggregations and a join on the scope; no sort of a scope's rows.
    """
    at = F.struct(*order)
    last = rows.groupBy(*scope).agg(F.max(F.when(is_clear, at)).alias("_last"))
    kept = rows.join(last, scope).filter(~is_clear & (F.col("_last").isNull() | (at > F.col("_last"))))
    return kept.groupBy(*scope, key.alias("key")).agg(F.min_by(value, at).alias("value"), F.first(F.col("_last").isNotNull()).alias("cleared"))


def setting(rows: DataFrame, *, order: list[str], is_clear: Column, value: Column) -> DataFrame:
    """One row: state Found, Cleared or NotMentioned and the value, of one setting over ordered elements."""
    at = F.struct(*order)
    last = rows.agg(F.max(F.when(is_clear, at)).alias("last"), F.count("*").alias("n"))
    kept = rows.crossJoin(F.broadcast(last)).filter(~is_clear & (F.col("last").isNull() | (at > F.col("last"))))
    found = kept.agg(F.min_by(value, at).alias("value"), F.count("*").alias("found"))
    return found.crossJoin(F.broadcast(last)).select(F.when(F.col("found") > 0, "Found").when(F.col("last").isNotNull(), "Cleared").otherwise("NotMentioned").alias("state"), "value")


def anti(rows: DataFrame, other: DataFrame, *, key: str, other_key: str, prefixes: list[str] | None = None, name: Column | None = None) -> DataFrame:
    """Rows without a partner, case ignored for text keys; of those, names equal to a prefix or continuing it at a dot."""
    low = (lambda c: F.lower(c)) if rows.schema[key].dataType.typeName() == "string" else (lambda c: c)
    out = rows.join(other.select(low(F.col(other_key)).alias("_k")).distinct(), low(F.col(key)) == F.col("_k"), "left_anti")
    if prefixes:
        n = F.lower(name)
        out = out.filter(reduce(lambda a, b: a | b, [(n == p.lower()) | n.startswith(p.lower() + ".") for p in prefixes]))
    return out


def highest_version(version: Column) -> Column:
    """Sort key of a version text: stable before prerelease, numbers as numbers."""
    core = F.split_part(version, F.lit("-"), F.lit(1))
    numbers = F.transform(F.split(core, r"\."), lambda p: F.coalesce(p.try_cast("long"), F.lit(-1).cast("long")))
    return F.struct((~version.contains("-")).alias("stable"), numbers.alias("numbers"), version.alias("raw"))
