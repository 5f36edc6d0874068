"""Text for tables, summaries, file names and literals. All Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def table_escape(s: Column) -> Column:
    """For a pipe table: '' becomes a space, pipes are escaped, line breaks become spaces."""
    return F.when(s == "", F.lit(" ")).otherwise(escape_cell(s))


def escape_cell(s: Column) -> Column:
    """As ``table_escape``, but '' stays ''."""
    return F.translate(F.replace(s, F.lit("|"), F.lit("\\|")), "\r\n", "  ")


def escape_pipes(s: Column) -> Column:
    return F.replace(s, F.lit("|"), F.lit("\\|"))


def collapse_whitespace(s: Column) -> Column:
    """Runs of space and tab become one space, line breaks stay, the end is trimmed."""
    return F.regexp_replace(F.regexp_replace(s, "[ \t]+", " "), r"\s+$", "")


def first_paragraph(s: Column) -> Column:
    """Trimmed text up to the first blank line, its line breaks as spaces."""
    body = F.regexp_replace(F.regexp_replace(s, r"^\s+|\s+$", ""), "\r\n", "\n")
    return F.trim(F.translate(F.split_part(body, F.lit("\n\n"), F.lit(1)), "\r\n", "  "))


def one_line_summary(s: Column, most: int = 200) -> Column:
    """At most ``most`` characters, cut at the last space in the further half, or hard, with an ellipsis."""
    head = F.substring(s, 1, most)
    back = F.instr(F.reverse(head), " ")
    cut = F.when((back > 0) & (F.lit(most) - back > most // 2), F.lit(most) - back).otherwise(F.lit(most))
    return F.when(F.length(s) <= most, s).otherwise(F.concat(F.substr(s, F.lit(1), cut), F.lit("...")))


def sanitise_filename(s: Column) -> Column:
    return F.translate(s, ".:<>", "__{}")


def sanitise_stem(s: Column) -> Column:
    """The nine signs that file systems reserve become underscores."""
    return F.translate(s, '<>:"/\\|?*', "_________")


def namespace_folder(namespace: Column) -> Column:
    return F.when(namespace == "", F.lit("_global")).otherwise(F.translate(namespace, ".", "/"))


def type_path(namespace: Column, type_name: Column, extension: str) -> Column:
    return F.concat(namespace_folder(namespace), F.lit("/"), F.translate(type_name, "<>", "{}"), F.lit(extension))


def member_path(namespace: Column, type_name: Column, member: Column, extension: str) -> Column:
    return F.concat(namespace_folder(namespace), F.lit("/"), F.translate(type_name, "<>", "{}"), F.lit("/"), sanitise_filename(member), F.lit(extension))


def back_link(path: Column, file: Column) -> Column:
    """``../`` once more than ``path`` has slashes, then the file."""
    slashes = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
    return F.concat(F.repeat(F.lit("../"), slashes + 1), file)


def mermaid_text(s: Column) -> Column:
    return F.translate(s, "<>", "~~")


def mermaid_name(uid: Column) -> Column:
    """Last segment, safe for a diagram."""
    return mermaid_text(F.regexp_extract(uid, r"([^.:]*)$", 1))


def quote(s: Column) -> Column:
    """A double-quoted literal; quotes and backslashes are escaped."""
    return F.concat(F.lit('"'), F.regexp_replace(s, r'(["\\])', r"\\$1"), F.lit('"'))


def escapes(s: Column) -> Column:
    return F.regexp_count(s, F.lit(r'["\\]'))


def constant(kind: Column, value: Column) -> Column:
    """Literal of an attribute argument by kind: null, string, char, bool, type, enum or a number's own text."""
    return (
        F.when(value.isNull() | (kind == "null"), F.lit("null"))
        .when(kind == "string", quote(value))
        .when(kind == "char", F.concat(F.lit("'"), value, F.lit("'")))
        .when(kind == "bool", F.lower(value))
        .when(kind == "type", F.concat(F.lit("typeof("), value, F.lit(")")))
        .otherwise(value)
    )


def default_literal(kind: Column, value: Column) -> Column:
    """Literal of a parameter's default, without escapes."""
    return F.when(value.isNull(), F.lit("null")).when(kind == "string", F.concat(F.lit('"'), value, F.lit('"'))).when(kind == "bool", F.lower(value)).otherwise(value)


def array_constant(values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(values, ", "), F.lit("]"))


def attribute_usage(name: Column, arguments: Column) -> Column:
    """``Name`` or ``Name(a, n=v)`` from an array of (name, value); positional arguments have no name."""
    parts = F.transform(arguments, lambda a: F.when(F.coalesce(a["name"], F.lit("")) == "", a["value"]).otherwise(F.concat(a["name"], F.lit("="), a["value"])))
    return F.when(F.size(arguments) == 0, name).otherwise(F.concat(name, F.lit("("), F.array_join(parts, ", "), F.lit(")")))


def modifiers(static: Column, abstract: Column, sealed: Column, virtual: Column | None = None) -> Column:
    """Keywords in the order that the language wants."""
    words = [F.when(static, "static"), F.when(~static & abstract, "abstract"), F.when(~static & ~abstract & sealed, "sealed")]
    if virtual is not None:
        words.append(F.when(virtual & ~static & ~abstract & ~sealed, "virtual"))
    return F.concat_ws(" ", *words)


def kind_keyword(kind: Column) -> Column:
    names = {"Class": "class", "Struct": "struct", "Interface": "interface", "Record": "record", "RecordStruct": "record struct", "Enum": "enum", "Delegate": "delegate", "Union": "union"}
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), kind), F.lower(kind))


def implicit_base(kind: Column) -> Column:
    """Base type that a kind has without saying so; null for interfaces."""
    return F.when(kind.isin("Struct", "RecordStruct"), "System.ValueType").when(kind == "Enum", "System.Enum").when(kind == "Delegate", "System.MulticastDelegate").when(kind == "Interface", F.lit(None)).otherwise("System.Object")


def modifier_label(is_params: Column, is_in: Column, is_out: Column, is_ref: Column) -> Column:
    """First that holds; '' if none does."""
    return F.when(is_params, "params").when(is_in, "in").when(is_out, "out").when(is_ref, "ref").otherwise("")
