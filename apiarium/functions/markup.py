"""Documentation markup: tokens, entities, Markdown and structured member documentation.

Views that a regular expression can express are JVM-side columns; nesting needs a parser, which
runs over Arrow batches. Text without ``<`` never reaches Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The entities that are decoded by name.
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "amp": "&"}

_ENTITY = re.compile(r"&([^;]*);")
_TOKEN = re.compile(r"<!--.*?-->|<\?.*?\?>|<!\[CDATA\[(?P<cdata>.*?)\]\]>|</(?P<end>[^>]*)>|<(?P<start>[^!?/>][^>]*)>|(?P<text>[^<]+)", re.DOTALL)


def strip_comments(s: Column) -> Column:
    return F.regexp_replace(s, r"(?s)<!--.*?-->", "")


def strip_instructions(s: Column) -> Column:
    return F.regexp_replace(s, r"(?s)<\?.*?\?>", "")


def start_tags(s: Column) -> Column:
    """Names of all start tags in order; comments and processing instructions are silent."""
    return F.regexp_extract_all(strip_instructions(strip_comments(s)), F.lit(r"<([A-Za-z][A-Za-z0-9]*)[^>]*>"), 1)


def attribute(area: Column, name: str) -> Column:
    """Value of a double-quoted attribute, '' if absent; names are case-sensitive.

    Attributes are read from the left; the first that is not double-quoted ends the reading.
    """
    before = rf'(?:(?!{name}\s*=)[^\s=]+\s*=\s*"[^"]*"\s*)*'
    return F.regexp_extract(area, rf'^\s*{before}{name}\s*=\s*"([^"]*)"', 1)


def attributes(s: Column, name: str) -> Column:
    """Every double-quoted value of the attribute, in order."""
    return F.regexp_extract_all(s, F.lit(rf'\s{name}="([^"]*)"'), 1)


def decode_named(s: Column) -> Column:
    """The five named entities decoded and every other named one dropped; the ampersand last."""
    out = F.regexp_replace(s, r"&(?!(?:lt|gt|amp|quot|apos);)[A-Za-z0-9#]+;", "")
    for name in ("lt", "gt", "quot", "apos", "amp"):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(ENTITIES[name]))
    return out


def decode(text: str) -> str:
    """Named and numeric entities; unknown ones vanish, an unterminated one stays."""

    def one(m: re.Match) -> str:
        name = m.group(1)
        if name in ENTITIES:
            return ENTITIES[name]
        number = re.fullmatch(r"#(?:[xX]([0-9A-Fa-f]+)|([0-9]+))", name)
        if number:
            code = int(number[1], 16) if number[1] else int(number[2])
            if code <= 0xFFFF and not 0xD800 <= code <= 0xDFFF:
                return chr(code)
        return ""

    return _ENTITY.sub(one, text)


@dataclass
class Node:
    """An element with its attribute text, or a text when ``name`` is None."""

    name: str | None
    area: str = ""
    text: str = ""
    raw: bool = False
    inner: tuple[int, int] = (0, 0)
    children: list[Node] = field(default_factory=list)

    def attribute(self, name: str) -> str | None:
        m = re.search(rf'(?:^|\s){name}\s*=\s*"([^"]*)"', self.area)
        return m[1] if m else None


def tokens(text: str) -> Iterator[tuple[str, str, str, bool, int, int]]:
    """(kind, name, content, is empty, start, end) of start, end and text tokens; truncated markup ends the scan."""
    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            return
        if m["text"] is not None:
            yield "text", "", m["text"], False, at, m.end()
        elif m["cdata"] is not None:
            yield "cdata", "", m["cdata"], False, at, m.end()
        elif m["end"] is not None:
            yield "end", m["end"].strip(), "", False, at, m.end()
        elif m["start"] is not None:
            body = m["start"]
            empty = body.endswith("/")
            parts = re.split(r"\s", body.rstrip("/").strip(), maxsplit=1)
            yield "start", parts[0], parts[1] if len(parts) > 1 else "", empty, at, m.end()
        at = m.end()


def tree(text: str) -> Node:
    """The fragment as nodes; an end tag closes its nearest open element, others are ignored."""
    root = Node("")
    stack = [root]
    for kind, name, content, empty, start, end in tokens(text):
        if kind in ("text", "cdata"):
            stack[-1].children.append(Node(None, text=content, raw=kind == "cdata"))
        elif kind == "start":
            node = Node(name, area=content, inner=(end, end))
            stack[-1].children.append(node)
            if not empty:
                stack.append(node)
        else:
            open_ = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name), None)
            if open_ is not None:
                for n in stack[open_:]:
                    n.inner = (n.inner[0], start)
                del stack[open_:]
    for n in stack[1:]:
        n.inner = (n.inner[0], n.inner[0])  # never closed: it has no inner text
    return root


def plain(node: Node) -> str:
    return "".join((c.text if c.raw else decode(c.text)) if c.name is None else plain(c) for c in node.children)


def short(cref: str) -> str:
    bare = re.sub(r"^.:|\(.*", "", cref)
    return re.search(r"([^.`]*)(`.*)?$", bare)[1]


class Renderer:
    """Markdown of a fragment."""

    def __init__(self):
        self.out = ""

    def blank_line(self) -> None:
        self.out = self.out.rstrip()
        if self.out:
            self.out += "\n\n"

    def line_start(self) -> None:
        self.out = self.out.rstrip()
        if self.out:
            self.out += "\n"

    def children(self, node: Node) -> None:
        for c in node.children:
            if c.name is None:
                self.out += c.text if c.raw else decode(c.text)
            else:
                getattr(self, f"on_{c.name}", self.children)(c)

    def on_see(self, n: Node) -> None:
        cref, word, href = n.attribute("cref"), n.attribute("langword"), n.attribute("href")
        if cref:
            self.out += f"[{short(cref)}][{cref}]" if not cref.startswith("!:") else f"`{short(cref)}`"
        elif word:
            self.out += f"`{word}`"
        elif href:
            body = plain(n).strip()
            self.out += f"[{body}]({href})" if body else f"<{href}>"

    on_seealso = on_see

    def on_paramref(self, n: Node) -> None:
        if name := n.attribute("name"):
            self.out += f"`{name}`"

    on_typeparamref = on_paramref

    def on_c(self, n: Node) -> None:
        self.out += f"`{plain(n)}`"

    def on_code(self, n: Node) -> None:
        self.blank_line()
        self.out += f"```csharp\n{plain(n).strip()}\n```\n\n"

    def on_para(self, n: Node) -> None:
        self.blank_line()
        self.children(n)
        self.blank_line()

    on_p = on_para

    def on_br(self, n: Node) -> None:
        self.out += "  \n"
        self.children(n)

    def _wrap(self, n: Node, mark: str) -> None:
        self.out += mark
        self.children(n)
        self.out += mark

    def on_b(self, n: Node) -> None:
        self._wrap(n, "**")

    on_strong = on_b

    def on_i(self, n: Node) -> None:
        self._wrap(n, "*")

    on_em = on_i

    def on_list(self, n: Node) -> None:
        kind = n.attribute("type") or "bullet"
        items = [c for c in n.children if c.name == "item"]
        self.blank_line()
        if kind == "table":
            head = next((c for c in n.children if c.name == "listheader"), None)
            rows = [("Term", "Description") if head is None else self._cells(head), ("---", "---"), *map(self._cells, items)]
            self.out += "".join(f"| {a} | {b} |\n" for a, b in rows)
        else:
            for i, item in enumerate(items, 1):
                self.line_start()
                self.out += f"{i}. " if kind == "number" else "- "
                inner = Renderer()
                inner.children(item)
                self.out += re.sub(r"\s+", " ", inner.out).strip()
        self.out = self.out.rstrip() + "\n\n"

    def _cells(self, item: Node) -> tuple[str, str]:
        found = []
        for name in ("term", "description"):
            inner = Renderer()
            for c in item.children:
                if c.name == name:
                    inner.children(c)
            text = re.sub(r"\s+", " ", inner.out).strip().replace("|", "\\|")
            found.append(text or " ")
        return found[0], found[1]


def convert(fragment: str | None) -> str | None:
    """Markdown of a documentation fragment; blank gives ''; text without tags is only decoded."""
    if fragment is None:
        return None
    if not fragment.strip():
        return ""
    if "<" not in fragment:
        return decode(fragment)
    r = Renderer()
    r.children(tree(fragment))
    return re.sub(r"[ \t]+", " ", r.out).rstrip()


@F.pandas_udf(T.StringType())
def _convert(s: pd.Series) -> pd.Series:
    return s.map(convert, na_action="ignore")


@F.pandas_udf(T.StringType())
def _decode(s: pd.Series) -> pd.Series:
    return s.map(decode, na_action="ignore")


def decode_entities(s: Column) -> Column:
    """Named and numeric entities; only text with an ampersand goes to Python."""
    return F.when(F.instr(s, "&") > 0, _decode(F.when(F.instr(s, "&") > 0, s))).otherwise(s)


def to_markdown(s: Column) -> Column:
    """Markdown; plain text stays JVM-side, the rest is rendered in Arrow batches."""
    marked = (F.instr(s, "<") > 0) | (F.instr(s, "&") > 0)
    return F.when(F.trim(F.translate(s, "\t\r\n", "   ")) == "", F.lit("")).when(marked, _convert(F.when(marked, s))).otherwise(s)


KEYED = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())]))
DOCUMENTATION = T.StructType(
    [
        *[T.StructField(n, T.StringType()) for n in ("summary", "remarks", "returns", "value")],
        T.StructField("examples", T.ArrayType(T.StringType())),
        *[T.StructField(n, KEYED) for n in ("parameters", "type_parameters", "exceptions")],
        T.StructField("see_also", T.ArrayType(T.StringType())),
        T.StructField("has_inheritdoc", T.BooleanType()),
        T.StructField("inheritdoc_cref", T.StringType()),
    ]
)


def documentation(member: str | None) -> dict:
    """Raw inner XML of the documentation elements of a member; the last of a single element wins."""
    out = {"summary": "", "remarks": "", "returns": "", "value": "", "examples": [], "parameters": [], "type_parameters": [], "exceptions": [], "see_also": [], "has_inheritdoc": False, "inheritdoc_cref": None}
    keyed = {"param": ("parameters", "name"), "typeparam": ("type_parameters", "name"), "exception": ("exceptions", "cref")}

    def visit(node: Node) -> None:
        for c in node.children:
            if c.name is None:
                continue
            inner = member[c.inner[0] : c.inner[1]]
            if c.name in ("summary", "remarks", "returns", "value"):
                out[c.name] = inner
            elif c.name == "example":
                out["examples"].append(inner)
            elif c.name in keyed:
                place, key = keyed[c.name]
                out[place].append({"name": c.attribute(key) or "", "value": inner})
            elif c.name == "seealso":
                if ref := c.attribute("cref") or c.attribute("href"):
                    out["see_also"].append(ref)
            elif c.name == "inheritdoc":
                out["has_inheritdoc"], out["inheritdoc_cref"] = True, c.attribute("cref") or out["inheritdoc_cref"]
            else:
                visit(c)

    if member:
        visit(tree(member))
    return out


@F.pandas_udf(DOCUMENTATION)
def parse_documentation(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([documentation(x) for x in s], columns=DOCUMENTATION.names)


def inner_xml(s: str, name: str) -> str:
    """Raw text inside the first element of that name; '' if it is missing or never closed."""

    def find(node: Node) -> Node | None:
        for c in node.children:
            if c.name == name:
                return c
            if c.name is not None and (hit := find(c)):
                return hit
        return None

    hit = find(tree(s))
    return s[hit.inner[0] : hit.inner[1]] if hit else ""


def display_generic(uid: str | None) -> str | None:
    """A constructed generic as it is written: short names, keywords left to the caller, nested arguments."""
    if uid is None:
        return None
    uid = re.sub(r"^.:", "", uid)
    at = uid.find("{")
    if at < 0 or not uid.endswith("}"):
        return short(uid)
    parts, depth, last = [], 0, at + 1
    for i in range(at + 1, len(uid) - 1):
        depth += {"{": 1, "}": -1}.get(uid[i], 0)
        if uid[i] == "," and depth == 0:
            parts.append(uid[last:i])
            last = i + 1
    parts.append(uid[last:-1])
    return f"{short(uid[:at])}<{', '.join(display_generic(p.strip()) for p in parts)}>"


@F.pandas_udf(T.StringType())
def display_constructed(s: pd.Series) -> pd.Series:
    return s.map(display_generic, na_action="ignore")
