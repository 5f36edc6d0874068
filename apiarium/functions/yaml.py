"""YAML scalars: when they need quotes and how they are quoted. All Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Plain scalars that YAML reads as something else, and the signs that may not lead one.
RESERVED = ("true", "false", "null", "True", "False", "Null", "TRUE", "FALSE", "NULL", "~", "yes", "no")
LEADING = "^[ \\t\\-?:,\\[\\]{}#&*!|>'\"%@`]"
TERMINATORS = ("[\\x00-\\x1f\"\\\\]", ":([ \\t]|$)", "[ \\t]#")


def _unsafe(s: Column) -> Column:
    out = s.rlike(LEADING)
    for p in TERMINATORS:
        out = out | s.rlike(p)
    return out


def needs_quoting(s: Column) -> Column:
    return (s == "") | s.isin(*RESERVED) | _unsafe(s)


def composite_needs_quoting(left: Column, sep: str, right: Column) -> Column:
    """For left, separator and right as one scalar; reserved words are not looked for."""
    s = F.concat(left, F.lit(sep), right)
    return (s == "") | _unsafe(s)


def quoted(s: Column) -> Column:
    out = F.regexp_replace(s, r'(["\\])', r"\\$1")
    for raw, name in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(name))
    # control characters are rare, and only texts that have some are taken apart
    coded = F.transform(F.split(out, ""), lambda c: F.when(c.rlike("[\\x00-\\x1f]"), F.concat(F.lit("\\x"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c))
    out = F.when(out.rlike("[\\x00-\\x1f]"), F.array_join(coded, "")).otherwise(out)
    return F.concat(F.lit('"'), out, F.lit('"'))


def scalar(s: Column) -> Column:
    return F.when(s == "", F.lit("''")).when(needs_quoting(s), quoted(s)).otherwise(s)


def qualified_scalar(left: Column, sep: str, right: Column) -> Column:
    s = F.concat(left, F.lit(sep), right)
    return F.when(composite_needs_quoting(left, sep, right), quoted(s)).otherwise(s)


def block_scalar(s: Column, indent: int) -> Column:
    """A text of several lines as a literal block, another as a scalar."""
    lines = F.split(F.regexp_replace(F.regexp_replace(s, "\r\n", "\n"), "\\n+$", ""), "\n")
    pad = " " * indent
    return F.when(F.instr(s, "\n") > 0, F.concat(F.lit("|-\n"), F.array_join(F.transform(lines, lambda x: F.concat(F.lit(pad), x)), "\n"))).otherwise(scalar(s))


def sequence(items: Column, indent: int) -> Column:
    """``- item`` lines."""
    pad = " " * indent
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit(pad + "- "), scalar(x))), "\n")
