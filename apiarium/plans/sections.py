"""Sections of pages as column expressions: Markdown lists and tables, YAML blocks. Null where there is nothing to show."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from apiarium.functions import text, uid, yaml
from apiarium.operators import filters

#: Turns (uid, label) into markup.
Link = Callable[[Column, Column], Column]


def autoref(u: Column, label: Column) -> Column:
    """A reference by uid; code where there is none to refer to."""
    return F.when((F.coalesce(u, F.lit("")) == "") | u.startswith("!:"), F.concat(F.lit("`"), label, F.lit("`"))).otherwise(F.concat(F.lit("["), label, F.lit("]["), u, F.lit("]")))


def _code(s: Column) -> Column:
    return F.concat(F.lit("`"), s, F.lit("`"))


def _block(items: Column, head: str, line: Callable[[Column], Column]) -> Column:
    """The head and a line for each item."""
    return F.when(F.size(items) > 0, F.concat(F.lit(head), F.array_join(F.transform(items, line), "\n")))


def derived_types(refs: Column, link: Link = autoref) -> Column:
    return _block(refs, "\n## Derived types\n\n", lambda r: F.concat(F.lit("- "), link(r["uid"], r["display_name"])))


def inherited_members(uids: Column, link: Link = autoref) -> Column:
    return _block(uids, '\n??? abstract "Inherited members"\n', lambda u: F.concat(F.lit("    - "), link(u, _code(uid.strip_prefix(u)))))


def extension_members(members: Column, link: Link = autoref) -> Column:
    """members: (container, name, uid)."""
    return _block(members, "\n## Extension members\n\n", lambda m: F.concat(F.lit("- "), link(m["uid"], _code(F.concat(m["container"], F.lit("."), m["name"])))))


def see_also(crefs: Column, link: Link = autoref) -> Column:
    return _block(crefs, "\n## See also\n\n", lambda c: F.concat(F.lit("- "), link(c, uid.strip_prefix(c))))


def extension_blocks(blocks: Column, link: Link = autoref) -> Column:
    def block(b: Column) -> Column:
        head = F.concat(F.lit("### extension("), link(b["receiver"]["uid"], b["receiver"]["display_name"]), F.lit(" "), b["receiver_name"], F.lit(")\n\n"))
        return F.concat(head, F.array_join(F.transform(b["members"], lambda m: F.concat(F.lit("- "), link(m["uid"], _code(m["name"])))), "\n"), F.lit("\n"))

    return _block(blocks, "\n## Extension blocks\n\n", block)


def union_cases(name: Column, cases: Column, link: Link = autoref) -> Column:
    """Table of the cases, and a diagram of the union with them."""
    node = text.mermaid_text(name)
    rows = F.array_join(F.transform(cases, lambda c: F.concat(F.lit("| "), link(c["uid"], c["display_name"]), F.lit(" |  |"))), "\n")
    edges = F.array_join(F.transform(cases, lambda c: F.concat(F.lit("    class "), text.mermaid_text(c["display_name"]), F.lit("\n    "), node, F.lit(" o-- "), text.mermaid_text(c["display_name"]))), "\n")
    body = F.concat(
        F.lit("\n## Cases\n\n| Case | Description |\n| ---- | ----------- |\n"), rows,
        F.lit('\n\n??? abstract "Union shape"\n\n    ```mermaid\n    classDiagram\n    class '), node, F.lit(" {\n        <<union>>\n    }\n"), edges, F.lit("\n    ```\n"),
    )
    return F.when(F.size(cases) > 0, body)


def yaml_seealso(crefs: Column) -> Column:
    return _block(crefs, "  seealso:\n", lambda c: F.concat(F.lit("  - linkType: CRef\n    commentId: "), yaml.scalar(c), F.lit("\n    altText: "), yaml.scalar(uid.strip_prefix(c))))


def yaml_attributes(attributes: Column) -> Column:
    """The attributes that are not the compiler's, with constructor and arguments."""

    def argument(a: Column) -> Column:
        name = F.when(F.coalesce(a["name"], F.lit("")) != "", F.concat(F.lit("name: "), yaml.scalar(a["name"]), F.lit("\n      "))).otherwise(F.lit(""))
        return F.concat(F.lit("    - "), name, F.lit("value: "), yaml.scalar(F.coalesce(a["value"], F.lit(""))))

    def entry(a: Column) -> Column:
        ctor = F.when(F.coalesce(a["constructor_uid"], F.lit("")) != "", F.concat(F.lit("\n    ctor: "), yaml.scalar(uid.strip_prefix(a["constructor_uid"])))).otherwise(F.lit(""))
        arguments = F.when(F.size(a["arguments"]) > 0, F.concat(F.lit("\n    arguments:\n"), F.array_join(F.transform(a["arguments"], argument), "\n"))).otherwise(F.lit("\n    arguments: []"))
        return F.concat(F.lit("  - type: "), yaml.scalar(uid.strip_prefix(a["uid"])), ctor, arguments)

    return _block(filters.kept_attributes(attributes), "  attributes:\n", entry)


def yaml_syntax(attributes: Column, signature: Column, indent: str = "    ") -> Column:
    """``content``: the signature, or a folded block of the attributes, an empty line and the signature."""
    kept = filters.kept_attributes(F.coalesce(attributes, F.array().cast("array<struct<display_name:string,uid:string,constructor_uid:string,arguments:array<struct<name:string,value:string>>>>")))
    usage = F.transform(kept, lambda a: F.concat(F.lit(f"{indent}["), text.attribute_usage(a["display_name"], a["arguments"]), F.lit("]")))
    folded = F.concat(F.lit(f"{indent}content: >-\n"), F.array_join(usage, "\n"), F.lit(f"\n{indent}\n{indent}"), signature)
    return F.when(F.size(kept) > 0, folded).otherwise(F.concat(F.lit(f"{indent}content: "), yaml.scalar(signature)))


def yaml_enum_values(values: Column) -> Column:
    """Each value as a parameter: id, default and description."""

    def value(v: Column) -> Column:
        described = F.coalesce(v["documentation"]["summary"], F.lit(""))
        description = F.when(described != "", F.concat(F.lit("\n      description: "), yaml.block_scalar(described, 8))).otherwise(F.lit(""))
        return F.concat(F.lit("    - id: "), yaml.scalar(v["name"]), F.lit("\n      defaultValue: "), yaml.scalar(F.coalesce(v["value"], F.lit(""))), description)

    return _block(values, "    parameters:\n", value)


def yaml_parameters(parameters: Column) -> Column:
    def one(p: Column) -> Column:
        kind = F.coalesce(F.nullif(uid.strip_prefix(p["type"]["uid"]), F.lit("")), p["type"]["display_name"])
        return F.concat(F.lit("    - id: "), yaml.scalar(p["name"]), F.lit("\n      type: "), yaml.scalar(kind))

    return _block(parameters, "    parameters:\n", one)


def yaml_return(returned: Column) -> Column:
    kind = F.coalesce(F.nullif(uid.strip_prefix(returned["uid"]), F.lit("")), returned["display_name"])
    return F.when(kind.isNotNull(), F.concat(F.lit("    return:\n      type: "), yaml.scalar(kind)))


def yaml_extension_blocks(blocks: Column) -> Column:
    def block(b: Column) -> Column:
        receiver = F.coalesce(F.nullif(uid.strip_prefix(b["receiver"]["uid"]), F.lit("")), b["receiver"]["display_name"])
        members = F.array_join(F.transform(b["members"], lambda m: F.concat(F.lit("\n    - "), yaml.scalar(uid.strip_prefix(m["uid"])))), "")
        return F.concat(F.lit("  - receiverName: "), yaml.scalar(b["receiver_name"]), F.lit("\n    receiverType: "), yaml.scalar(receiver), F.lit("\n    members:"), members)

    return _block(blocks, "  extensionBlocks:\n", block)


def yaml_references(refs: Column, internal: Column, learn_root: str) -> Column:
    """Entries of ``refs`` (display_name, uid): parent, definition, whether external, address and names.

    ``internal``: array of the uids that have a page; a constructed generic is internal with its open form.
    """

    def entry(r: Column) -> Column:
        u = F.when(F.coalesce(r["uid"], F.lit("")) != "", r["uid"]).otherwise(F.concat(F.lit("T:"), r["display_name"]))
        bare, open_ = uid.strip_prefix(u), uid.open_generic(u)
        inside = F.coalesce(F.array_contains(internal, u) | F.array_contains(internal, open_), F.lit(False))
        parent = F.when(uid.parent_of(bare) != "", F.concat(F.lit("\n  parent: "), yaml.scalar(uid.parent_of(bare)))).otherwise(F.lit(""))
        definition = F.when(u != open_, F.concat(F.lit("\n  definition: "), yaml.scalar(uid.strip_prefix(open_)))).otherwise(F.lit(""))
        stem = F.translate(uid.strip_prefix(open_), "`", "-")
        framework = bare.startswith("System.") | bare.startswith("Microsoft.")
        href = F.when(inside, F.concat(F.lit("\n  href: "), yaml.scalar(F.concat(stem, F.lit(".html"))))).when(framework, F.concat(F.lit("\n  href: "), yaml.scalar(F.concat(F.lit(learn_root), F.lower(stem))))).otherwise(F.lit(""))
        label = F.coalesce(uid.to_keyword(bare), r["display_name"])
        label = F.when(label == bare, r["display_name"]).otherwise(label)
        names = F.concat(F.lit("\n  name: "), yaml.scalar(label), F.lit("\n  nameWithType: "), yaml.scalar(label), F.lit("\n  fullName: "), yaml.scalar(bare))
        external = F.when(inside, F.lit("")).otherwise(F.lit("\n  isExternal: true"))
        return F.concat(F.lit("- uid: "), yaml.scalar(bare), F.lit("\n  commentId: "), yaml.scalar(u), parent, definition, external, href, names)

    return _block(refs, "references:\n", entry)


def shared_extras(extra: Column) -> Column:
    """What a metadata entry holds beside known keys, without its references; null if nothing is left."""
    left = F.map_filter(extra, lambda k, _: k != "references")
    return F.when(F.size(left) > 0, left)


def injected(files: Column) -> Column:
    """Was this content entry added for a platform?"""
    return F.coalesce(F.get(files, F.lit(0)).startswith("api-"), F.lit(False))


def patched_content(content: Column, labels: Column) -> Column:
    """Content entries (arrays of files) without those added for platforms before, then one for each label."""
    fresh = F.transform(labels, lambda p: F.array(F.concat(F.lit("api-"), p, F.lit("/**.yml")), F.concat(F.lit("api-"), p, F.lit("/index.md"))))
    return F.concat(F.filter(content, lambda f: ~injected(f)), fresh)
