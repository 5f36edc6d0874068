"""Target frameworks: parsing, rank and classification. All Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _head(tfm: Column) -> Column:
    return F.split_part(tfm, F.lit("-"), F.lit(1))


def family(tfm: Column) -> Column:
    low = F.lower(tfm)
    return F.when(low.startswith("netstandard"), "netstandard").when(low.startswith("net4"), "net4").when(low.startswith("net"), "net").otherwise("unknown")


def version(tfm: Column) -> Column:
    """What follows the family name, without the platform."""
    f, head = family(tfm), _head(tfm)
    return F.when(f == "netstandard", F.substring(head, 12, 64)).when(f.isin("net4", "net"), F.substring(head, 4, 64)).otherwise(F.lit(""))


def platform(tfm: Column) -> Column:
    """What follows the first hyphen; null without one."""
    return F.when(F.instr(tfm, "-") > 0, F.regexp_extract(tfm, "^[^-]*-(.*)$", 1))


def rank(tfm: Column) -> Column:
    """Order of preference between frameworks; larger is preferred."""
    f, v = family(tfm), version(tfm)
    modern = v.startswith("5") | (F.length(v) > 1)
    value = F.coalesce((v.try_cast("double") * 100).cast("int"), F.lit(550))
    with_platform = value - F.when(F.instr(tfm, "-") > 0, 5).otherwise(0)
    standard = F.when(v == "2.1", 510).when(v == "2.0", 500).otherwise(480)
    return F.when(f == "netstandard", standard).when(f == "net4", 300).when((f == "net") & modern, with_platform).otherwise(100)


def parsed(tfm: Column) -> Column:
    return F.struct(tfm.alias("raw"), family(tfm).alias("family"), version(tfm).alias("version"), platform(tfm).alias("platform"), rank(tfm).alias("rank"))


#: A platform's label with the older framework name that stands for it.
PLATFORMS = {"android": "monoandroid", "ios": "xamarinios", "maccatalyst": "xamarinmac", "windows": "uap"}


def _label(holds) -> Column:
    """The first label of PLATFORMS for which ``holds(label, older name)``; null without one."""
    out = F.lit(None).cast("string")
    for label, older in reversed(PLATFORMS.items()):
        out = F.when(holds(label, older), F.lit(label)).otherwise(out)
    return out


def suffix_label(tfm: Column) -> Column:
    """android, ios, maccatalyst or windows by ``-label`` anywhere, whatever the framework's name; case is ignored, null otherwise."""
    low = F.lower(tfm)
    return _label(lambda label, _: low.contains(f"-{label}"))


def platform_label(tfm: Column) -> Column:
    """android, ios, maccatalyst or windows: ``-label`` anywhere, or the older name in front; case is ignored, null otherwise."""
    low = F.lower(tfm)
    return _label(lambda label, older: low.contains(f"-{label}") | low.startswith(older))


def metadata_entries(tfms: Column) -> Column:
    """The frameworks of a library with their labels, and the distinct labels in order."""
    entries = F.transform(tfms, lambda t: F.struct(t.alias("tfm"), platform_label(t).alias("platform")))
    labels = F.filter(F.transform(entries, lambda e: e["platform"]), lambda p: p.isNotNull())
    return F.struct(entries.alias("entries"), F.array_sort(F.array_distinct(labels)).alias("platforms"))


def is_netstandard(tfm: Column) -> Column:
    return F.lower(tfm).startswith("netstandard")


def is_legacy(tfm: Column) -> Column:
    """Frameworks below 4.6.2; what cannot be parsed is legacy, an empty text is not."""
    low = F.lower(F.trim(tfm))
    digits = F.regexp_extract(low, r"^net([0-9]+)$", 1)
    compact = digits != ""
    parts = F.transform(F.split(digits, ""), lambda c: c.try_cast("int"))
    old = F.coalesce(F.get(parts, F.lit(0)), F.lit(0)) * 100 + F.coalesce(F.get(parts, F.lit(1)), F.lit(0)) * 10 + F.coalesce(F.get(parts, F.lit(2)), F.lit(0)) < 462
    modern = low.rlike(r"^(netstandard|netcoreapp)[0-9.]*") | low.rlike(r"^net[0-9]+\.[0-9]")
    return F.when(low == "", False).when(compact, old & (F.length(digits) >= 2)).when(modern, False).otherwise(True)


def all_legacy(tfms: Column) -> Column:
    return (F.size(tfms) > 0) & F.forall(tfms, is_legacy)


def matches(tfm: Column, preference: Column) -> Column:
    """Equal, a prefix, or of one family with a version prefix; case is ignored."""
    a, b = F.lower(tfm), F.lower(preference)
    return (a == b) | a.startswith(b) | ((family(a) == family(b)) & (version(b) != "") & version(a).startswith(version(b)))
