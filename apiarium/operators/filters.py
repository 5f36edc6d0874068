"""Predicates of the catalog pipeline. All give boolean columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accessibilities that show outside, attributes kept of the compiler's namespace, shim families.
VISIBLE = ("Public", "Protected", "ProtectedOrInternal")
COMPILER_NAMESPACE = "System.Runtime.CompilerServices."
COMPILER_KEPT = ("System.Runtime.CompilerServices.ExtensionAttribute", "System.Runtime.CompilerServices.RequiredMemberAttribute")
NATIVE_SHIMS = ("microsoft.net.native.", "microsoft.netcore.native", "microsoft.netcore.platforms", "microsoft.netcore.targets", "microsoft.netcore.jit", "microsoft.netcore.runtime", "microsoft.netcore.app", "microsoft.netcore.dotnethost")


def externally_visible(accessibility: Column) -> Column:
    return accessibility.isin(*VISIBLE)


def compiler_generated(name: Column) -> Column:
    return name.rlike("[<>]")


def excluded_attribute(uid: Column) -> Column:
    """An attribute of the compiler's namespace that is not on the list of those kept."""
    bare = F.regexp_replace(uid, "^.:", "")
    return bare.startswith(COMPILER_NAMESPACE) & ~bare.isin(*COMPILER_KEPT)


def kept_attributes(attributes: Column) -> Column:
    return F.filter(attributes, lambda a: ~excluded_attribute(a["uid"]))


def obsolete(attributes: Column) -> Column:
    """(is_obsolete, message) from the first obsolete attribute; an empty message is null."""
    hit = F.get(F.filter(attributes, lambda a: F.regexp_replace(a["uid"], "^.:", "") == "System.ObsoleteAttribute"), F.lit(0))
    message = F.nullif(F.get(F.filter(hit["arguments"], lambda x: F.coalesce(x["name"], F.lit("")) == ""), F.lit(0))["value"], F.lit(""))
    return F.struct(hit.isNotNull().alias("is_obsolete"), message.alias("message"))


def matches_list(name: Column, exact: list[str], prefixes: list[str]) -> Column:
    """Exact or prefix, case ignored."""
    low = F.lower(name)
    out = low.isin([x.lower() for x in exact]) if exact else F.lit(False)
    for p in prefixes:
        out = out | low.startswith(p.lower())
    return out


def default_skip(name: Column) -> Column:
    """Runtime packages and framework shims that a dependency closure leaves out."""
    low = F.lower(name)
    out = low.startswith("runtime.")
    for p in NATIVE_SHIMS:
        out = out | low.startswith(p)
    return out


def stub_version(version: Column) -> Column:
    return version.isin("0.0.0.0", "255.255.255.255")


def member_kind(symbol: Column, method_kind: Column, in_enum: Column, is_accessor: Column) -> Column:
    """Kind of a member; null (to be dropped) for accessors and what has no kind."""
    method = F.when(is_accessor, None).when(method_kind == "Constructor", "Constructor").when(method_kind.isin("UserDefinedOperator", "Conversion"), "Operator").when(method_kind == "Ordinary", "Method")
    return F.when(symbol == "Method", method).when(symbol == "Field", F.when(in_enum, "EnumValue").otherwise("Field")).when(symbol == "Property", "Property").when(symbol == "Event", "Event")


def object_kind(type_kind: Column, is_record: Column) -> Column:
    return F.when(type_kind == "Class", F.when(is_record, "Record").otherwise("Class")).when(type_kind == "Struct", F.when(is_record, "RecordStruct").otherwise("Struct")).when(type_kind == "Interface", "Interface")


def type_variant(is_union: Column, type_kind: Column) -> Column:
    """Union before enum before delegate before object."""
    return F.when(is_union, "union").when(type_kind == "Enum", "enum").when(type_kind == "Delegate", "delegate").otherwise("object")


def is_union(interfaces: Column) -> Column:
    return F.exists(interfaces, lambda i: F.regexp_replace(i["uid"], "^.:", "") == "System.Runtime.CompilerServices.IUnion")


def implicit_object(base_uid: Column) -> Column:
    return F.coalesce(F.regexp_replace(base_uid, "^.:", "").isin("System.Object", "System.ValueType"), F.lit(False))


def explicit_base(base_uid: Column) -> Column:
    """The base uid, null for those that a kind has anyway."""
    return F.when(~F.regexp_replace(base_uid, "^.:", "").isin("System.Object", "System.ValueType", "System.Enum", "System.Delegate", "System.MulticastDelegate"), base_uid)


def same_extracted(size: Column, other_size: Column, seconds: Column, other_seconds: Column) -> Column:
    return (size == other_size) & (F.abs(seconds - other_seconds) <= 2)


def extractable(entry: Column) -> Column:
    return F.lower(entry).rlike(r"\.(dll|xml)$")


def root_nuspec(entry: Column) -> Column:
    return F.lower(entry).rlike(r"^[^/\\]+\.nuspec$")


def withdrawn(result_json: Column) -> Column:
    """A search result that is deprecated or has vulnerabilities."""
    bad = F.get_json_object(result_json, "$.vulnerabilities")
    return F.get_json_object(result_json, "$.deprecation").isNotNull() | (bad.isNotNull() & (bad != "[]"))
