"""Identifiers of API symbols: prefixes, names, generic arity. All Column -> Column, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# CLR type names and their language keywords.
KEYWORDS = {
    "System.Boolean": "bool",
    "System.Byte": "byte",
    "System.SByte": "sbyte",
    "System.Char": "char",
    "System.Decimal": "decimal",
    "System.Double": "double",
    "System.Single": "float",
    "System.Int32": "int",
    "System.UInt32": "uint",
    "System.Int64": "long",
    "System.UInt64": "ulong",
    "System.Int16": "short",
    "System.UInt16": "ushort",
    "System.Object": "object",
    "System.String": "string",
    "System.Void": "void",
}


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def strip_prefix(uid: Column) -> Column:
    """Without the kind letter and colon, where the second character is a colon."""
    return F.regexp_replace(uid, "^.:", "")


def short_name(cref: Column) -> Column:
    """Last segment without kind, parameters and arity."""
    bare = F.regexp_replace(cref, r"^.:|\(.*", "")
    return F.regexp_extract(bare, r"([^.`]*)(`.*)?$", 1)


def strip_arity(name: Column) -> Column:
    """Without a trailing backtick suffix, unless nothing would be left."""
    return F.regexp_replace(name, r"(?<=.)`[^`]*$", "")


def strip_attribute_suffix(name: Column) -> Column:
    return F.regexp_replace(name, "(?<=.)Attribute$", "")


def to_keyword(name: Column) -> Column:
    return F.coalesce(F.element_at(_map(KEYWORDS), name), name)


def to_clr(keyword: Column) -> Column:
    return F.coalesce(F.element_at(_map({v: k for k, v in KEYWORDS.items()}), keyword), keyword)


def _depths(s: Column, opened: str = "{", closed: str = "}") -> Column:
    """Fold of (depth, separators at depth 1, returns to depth 0 before the end)."""
    start = F.struct(F.lit(0).alias("d"), F.lit(0).alias("n"), F.lit(0).alias("z"), F.lit(0).alias("low"))

    def step(a: Column, c: Column) -> Column:
        d = a["d"] + F.when(c == opened, 1).when(c == closed, -1).otherwise(0)
        return F.struct(d.alias("d"), (a["n"] + F.when((c == ",") & (a["d"] == 1), 1).otherwise(0)).alias("n"), (a["z"] + F.when((c == closed) & (d == 0), 1).otherwise(0)).alias("z"), F.least(a["low"], d).alias("low"))

    return F.aggregate(F.split(s, ""), start, step)


def top_level_arguments(s: Column) -> Column:
    """Number of comma-separated arguments in the outermost braces; 0 without braces."""
    return F.when(F.instr(s, "{") > 0, _depths(s)["n"] + 1).otherwise(0)


def normalise(uid: Column) -> Column:
    """A constructed generic type as its open form with an arity; anything else unchanged.

    Only types (``T:`` or no kind) whose outermost braces close at the end of the text are touched.
    """
    whole = uid.rlike(r"^(T:|(?!.:))[^{]+\{.+\}$")
    fold = _depths(uid)
    balanced = (fold["d"] == 0) & (fold["z"] == 1) & (fold["low"] >= 0)
    head = F.regexp_extract(uid, r"^([^{]+)", 1)
    return F.when(whole & balanced, F.concat(head, F.lit("`"), (fold["n"] + 1).cast("string"))).otherwise(uid)


def open_generic(uid: Column) -> Column:
    """Like ``normalise`` but an arity that is there already is kept."""
    head = F.regexp_extract(uid, r"^([^{]+)", 1)
    return F.when(head.rlike(r"`[0-9]+$") & uid.endswith("}"), head).otherwise(normalise(uid))


def autoref_id(uid: Column) -> Column:
    return F.translate(normalise(uid), "`", "-")


def parent_of(uid: Column) -> Column:
    """Prefix before the last dot that stands outside braces and parentheses; '' without one."""
    bare = F.regexp_replace(uid, r"\(.*$", "")
    return F.regexp_extract(bare, r"^(.*)\.[^.{}]*(\{.*\})?$", 1)


def type_uid(namespace: Column, containers: Column, name: Column) -> Column:
    """``T:`` with namespace, containing types (an array) and name, empty parts left out."""
    parts = F.flatten(F.array(F.array(namespace), containers, F.array(name)))
    return F.concat(F.lit("T:"), F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), "."))


def full_name(namespace: Column, containers: Column, name: Column) -> Column:
    return F.substring(type_uid(namespace, containers, name), 3, 1 << 30)


def _numbered(arity: Column, opening: str, sep: str, closing: str) -> Column:
    names = F.transform(F.sequence(F.lit(1), arity), lambda i: F.concat(F.lit("T"), i.cast("string")))
    many = F.concat(F.lit(opening), F.array_join(names, sep), F.lit(closing))
    return F.when(arity <= 0, F.lit("")).when(arity == 1, F.lit(f"{opening}T{closing}")).otherwise(many)


def display_arity(arity: Column) -> Column:
    """``<T>`` or ``<T1, T2>``."""
    return _numbered(arity, "<", ", ", ">")


def path_arity(arity: Column) -> Column:
    return _numbered(arity, "{", ",", "}")


def mermaid_arity(arity: Column) -> Column:
    return _numbered(arity, "~", ",", "~")


def overload_anchor(uid: Column) -> Column:
    return F.concat(uid, F.lit("*"))


def unqualified(name: Column, parameter_types: Column) -> Column:
    return F.concat(name, F.lit("("), F.array_join(parameter_types, ", "), F.lit(")"))


def qualified(type_name: Column, name: Column, parameter_types: Column) -> Column:
    return F.concat(type_name, F.lit("."), unqualified(name, parameter_types))


def page_uid(uid: Column, name: Column) -> Column:
    """The uid; where empty ``T:`` and the full name, where that is empty too ''."""
    return F.coalesce(F.nullif(uid, F.lit("")), F.when(name != "", F.concat(F.lit("T:"), name)), F.lit(""))


def heading(kind: Column, type_name: Column, name: Column, parameter_types: Column) -> Column:
    """Constructors are titled by their type, other members by type and member."""
    return F.when(kind == "Constructor", unqualified(type_name, parameter_types)).otherwise(qualified(type_name, name, parameter_types))


def with_parentheses(label: Column, parts: Column) -> Column:
    return F.concat(label, F.lit("("), F.array_join(parts, ", "), F.lit(")"))


def concat_path(prefix: Column, sep: Column, suffix: Column) -> Column:
    """prefix, separator and suffix; without a prefix the suffix alone."""
    return F.when(F.coalesce(prefix, F.lit("")) == "", suffix).otherwise(F.concat(prefix, sep, suffix))
