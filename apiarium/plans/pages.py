"""Pages as tables of (path, body): Markdown and YAML for types, members, namespaces and packages.

Every page is one expression over its row, so rendering is a projection; only namespace,
package and overload pages need a grouping. Sinks write the table partitioned, a file a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apiarium.functions import markup, text, uid, url, yaml
from apiarium.operators import filters, flatten
from apiarium.plans import sections
from apiarium.sources import schema

#: Fixed value: root of the framework's documentation.
LEARN = "https://learn.microsoft.com/dotnet/api/"
KINDS = ("Constructor", "Property", "Field", "Method", "Operator", "Event")


def lines(*parts: Column) -> Column:
    """Parts that are not null, a line each."""
    return F.concat_ws("\n", *parts)


_DOCS = f"array<{schema.DOCUMENTATION}>"


_DOC_TYPE = T.StructType(
    [
        *[T.StructField(n, T.StringType()) for n in ("summary", "remarks", "returns", "value")],
        T.StructField("examples", T.ArrayType(T.StringType())),
        *[T.StructField(n, markup.KEYED) for n in ("parameters", "type_parameters", "exceptions")],
        T.StructField("see_also", T.ArrayType(T.StringType())),
        T.StructField("inherited_from", T.StringType()),
    ]
)


@F.pandas_udf(T.ArrayType(_DOC_TYPE))
def _rendered(s: pd.Series) -> pd.Series:
    one = markup.convert

    def entries(items) -> list | None:
        return None if items is None else [{"name": e["name"], "value": one(e["value"])} for e in items]

    def render(d: dict | None) -> dict | None:
        if d is None:
            return None
        out = dict(d)
        out |= {f: one(d[f]) for f in ("summary", "remarks", "returns", "value")}
        out["examples"] = None if d["examples"] is None else [one(x) for x in d["examples"]]
        out |= {f: entries(d[f]) for f in ("parameters", "type_parameters", "exceptions")}
        return out

    return s.map(lambda docs: None if docs is None else [render(d) for d in docs])


def documented(types: DataFrame) -> DataFrame:
    """``types`` with all documentation of the type, its members and its values as Markdown; see_also and inherited_from as they are.

    A type's documents go to Python together, in one array, so a page costs one call.
    """
    nothing = F.array().cast(_DOCS)
    of = lambda c: F.coalesce(F.transform(c, lambda x: x["documentation"]), nothing)
    out = types.withColumn("_docs", _rendered(F.concat(F.array("documentation"), of("members"), of("values"))))
    n = F.size(F.coalesce(F.transform("members", lambda m: m["uid"]), F.array().cast("array<string>")))
    out = out.withColumns({
        "documentation": F.get("_docs", F.lit(0)),
        "members": F.transform("members", lambda m, i: m.withField("documentation", F.get("_docs", i + 1))),
        "values": F.transform("values", lambda v, i: v.withField("documentation", F.get("_docs", i + 1 + n))),
    })
    return out.drop("_docs")


def title(name: str = "name", arity: str = "arity") -> Column:
    return F.concat(F.col(name), uid.display_arity(F.col(arity)))


def frontmatter(heading: Column, anchor: Column) -> Column:
    return lines(F.lit("---"), F.concat(F.lit("title: "), yaml.scalar(heading)), F.lit("---"), F.lit(""), F.concat(F.lit("# "), heading, F.lit(" { #"), anchor, F.lit(" }")))


def members_section(kind: str) -> Column:
    """Table of a kind's members, one row for each name, the first overload; null without any."""
    own = F.filter("members", lambda m: (m["kind"] == kind) & ~filters.compiler_generated(m["name"]))
    at = F.transform(own, lambda m, i: F.struct(m["name"].alias("name"), m["documentation"]["summary"].alias("summary"), i.alias("i")))
    first = F.filter(at, lambda m: ~F.exists(at, lambda o: (o["name"] == m["name"]) & (o["i"] < m["i"])))
    rows = F.transform(first, lambda m: F.concat(F.lit("| "), text.table_escape(m["name"]), F.lit(" | "), text.table_escape(text.one_line_summary(text.first_paragraph(F.coalesce(m["summary"], F.lit(""))))), F.lit(" |")))
    plural = {"Property": "Properties"}.get(kind, f"{kind}s")
    return F.when(F.size(rows) > 0, F.concat(F.lit(f"\n## {plural}\n\n| Name | Summary |\n| --- | --- |\n"), F.array_join(rows, "\n")))


def parameters_table(parameters: Column, docs: Column) -> Column:
    """Rows of name, type and description; null without parameters."""
    rows = F.transform(parameters, lambda p: F.concat(F.lit("| "), text.table_escape(p["name"]), F.lit(" | "), text.table_escape(p["type"]["display_name"]), F.lit(" | "), text.table_escape(flatten.description(docs, p["name"])), F.lit(" |")))
    return F.when(F.size(parameters) > 0, F.concat(F.lit("| Name | Type | Description |\n| --- | --- | --- |\n"), F.array_join(rows, "\n")))


def values_table(values: Column) -> Column:
    rows = F.transform(values, lambda v: F.concat(F.lit("| "), text.table_escape(v["name"]), F.lit(" | "), text.table_escape(v["value"]), F.lit(" | "), text.table_escape(F.coalesce(v["documentation"]["summary"], F.lit(""))), F.lit(" |")))
    return F.when(F.size(values) > 0, F.concat(F.lit("\n## Values\n\n| Name | Value | Summary |\n| --- | --- | --- |\n"), F.array_join(rows, "\n")))


def diagram(name: Column, base: Column, interfaces: Column) -> Column:
    """Class diagram with an edge from the base and from each interface."""
    edge = lambda b: F.concat(F.lit("    "), text.mermaid_name(b["uid"]), F.lit(" <|-- "), text.mermaid_text(name))
    edges = F.concat(F.when(base["uid"].isNotNull(), F.array(edge(base))).otherwise(F.array().cast("array<string>")), F.transform(F.coalesce(interfaces, F.array().cast("array<struct<display_name:string,uid:string>>")), edge))
    return F.when(F.size(edges) > 0, F.concat(F.lit("\n```mermaid\nclassDiagram\n"), F.array_join(edges, "\n"), F.lit("\n```")))


def _link(types: DataFrame) -> sections.Link:
    """Autorefs; where ``types`` has ``emitted``, the uids that have a page, others are framework links or code."""
    if "emitted" not in types.columns:
        return sections.autoref
    return lambda u, label: url.link(F.coalesce(u, F.lit("")), label, F.array_contains("emitted", u), LEARN)


def _source(at: Column) -> Column:
    return F.when(F.coalesce(at, F.lit("")) != "", F.concat(F.lit("\n[View source]("), at, F.lit(")")))


def _attributes(attributes: Column) -> Column:
    """Backticked usages of the attributes that are not the compiler's."""
    kept = F.transform(filters.kept_attributes(attributes), lambda a: F.concat(F.lit("`["), text.attribute_usage(a["display_name"], a["arguments"]), F.lit("]`")))
    return F.when(F.size(kept) > 0, F.concat(F.lit("\nAttributes: "), F.array_join(kept, ", ")))


def declaration() -> Column:
    """modifiers kind name : bases."""
    bases = F.concat_ws(", ", F.col("base.display_name"), F.transform(F.coalesce("interfaces", F.array().cast("array<struct<display_name:string,uid:string>>")), lambda i: i["display_name"]))
    head = F.concat_ws(" ", F.lit("public"), F.nullif(text.modifiers(F.col("is_static"), F.col("is_abstract"), F.col("is_sealed")), F.lit("")), text.kind_keyword(F.coalesce("object_kind", F.initcap("type_kind"))), title())
    return F.when(bases == "", head).otherwise(F.concat(head, F.lit(" : "), bases))


def type_pages(types: DataFrame) -> DataFrame:
    """Markdown page of every type that the compiler did not make.

    Lists of derived types, inherited and extension members are shown where ``types`` has the
    columns (see ``catalog_api.with_indexes``).
    """
    d, link = F.col("documentation"), _link(types)
    listed = {"derived": sections.derived_types, "inherited": sections.inherited_members, "extensions": sections.extension_members}
    body = lines(
        frontmatter(title(), uid.page_uid(F.col("uid"), F.col("full_name"))),
        F.concat(F.lit("\n"), d["summary"]),
        F.concat(F.lit("\n```csharp\n"), declaration(), F.lit("\n```")),
        F.when(F.col("is_obsolete"), F.concat(F.lit("\n!!! warning \"Obsolete\"\n    "), F.coalesce("obsolete_message", F.lit("")))),
        diagram(title(), F.col("base"), F.col("interfaces")),
        F.when(F.size("applies_to") > 0, F.concat(F.lit("\nApplies to: "), F.array_join("applies_to", ", "))),
        values_table(F.col("values")),
        *[members_section(k) for k in KINDS],
        sections.union_cases(title(), F.when(F.col("type_kind") == "union", F.col("cases")), link),
        sections.extension_blocks(F.col("extension_blocks"), link),
        F.when(d["remarks"] != "", F.concat(F.lit("\n## Remarks\n\n"), d["remarks"])),
        *[show(F.col(c), link) for c, show in listed.items() if c in types.columns],
        sections.see_also(d["see_also"], link),
        _attributes(F.col("attributes")),
        _source(F.col("source_url")),
    )
    kept = types.filter(~filters.compiler_generated(F.col("name")))
    return kept.select(text.type_path(F.col("namespace"), F.concat(F.col("name"), uid.path_arity(F.col("arity"))), ".md").alias("path"), body.alias("body"))


def member_pages(types: DataFrame) -> DataFrame:
    """Markdown page of each overload group: title, then every overload's signature and summary, in order."""
    rows = types.select("namespace", F.col("name").alias("type_name"), "arity", *(["emitted"] if "emitted" in types.columns else []), F.posexplode("members").alias("ord", "m")).filter(F.col("m.kind").isin(*KINDS) & ~filters.compiler_generated(F.col("m.name")))
    part = F.concat_ws("\n", F.concat(F.lit("\n## "), F.col("m.name")), F.concat(F.lit("\n```csharp\n"), F.col("m.signature"), F.lit("\n```")), F.concat(F.lit("\n"), F.col("m.documentation.summary")), F.concat(F.lit("\n"), parameters_table(F.col("m.parameters"), F.col("m.documentation.parameters"))), F.when(F.col("m.documentation.returns") != "", F.concat(F.lit("\n**Returns:** "), F.col("m.documentation.returns"))), F.when(F.col("m.documentation.remarks") != "", F.concat(F.lit("\n"), F.col("m.documentation.remarks"))), sections.see_also(F.col("m.documentation.see_also"), _link(types)), _source(F.col("m.source_url")))
    groups = rows.groupBy("namespace", "type_name", "arity", F.col("m.name").alias("member")).agg(F.array_sort(F.collect_list(F.struct("ord", part.alias("part")))).alias("parts"), F.min_by("m.uid", "ord").alias("uid"))
    body = F.concat(frontmatter(F.concat(F.col("type_name"), F.lit("."), F.col("member")), uid.overload_anchor(F.col("uid"))), F.lit("\n"), F.array_join(F.transform("parts", lambda p: p["part"]), "\n"))
    return groups.select(text.member_path(F.col("namespace"), F.concat(F.col("type_name"), uid.path_arity(F.col("arity"))), F.col("member"), ".md").alias("path"), body.alias("body"))


def landing_pages(types: DataFrame) -> DataFrame:
    """Index page of each namespace, and of each assembly with its namespaces and their counts."""
    kept = types.filter(~filters.compiler_generated(F.col("name")))
    row = F.concat(F.lit("- "), title(), F.lit(": "), text.one_line_summary(text.first_paragraph(F.coalesce("documentation.summary", F.lit("")))))
    spaces = kept.groupBy("namespace").agg(F.array_sort(F.collect_list(F.struct("full_name", row.alias("row")))).alias("rows"))
    space_pages = spaces.select(F.concat(text.namespace_folder(F.col("namespace")), F.lit("/index.md")).alias("path"), F.concat(F.lit("# "), F.col("namespace"), F.lit("\n\n"), F.array_join(F.transform("rows", lambda r: r["row"]), "\n")).alias("body"))
    counted = kept.groupBy("assembly_name", "namespace").agg(F.count("*").alias("n"))
    packages = counted.groupBy("assembly_name").agg(F.array_sort(F.collect_list(F.struct("namespace", "n"))).alias("rows"))
    package_pages = packages.select(F.concat(F.col("assembly_name"), F.lit("/index.md")).alias("path"), F.concat(F.lit("# "), F.col("assembly_name"), F.lit("\n\n| Namespace | Types |\n| --- | --- |\n"), F.array_join(F.transform("rows", lambda r: F.concat(F.lit("| "), r["namespace"], F.lit(" | "), r["n"].cast("string"), F.lit(" |"))), "\n")).alias("body"))
    return space_pages.union(package_pages)


def field(name: str, value: Column, indent: int = 2) -> Column:
    """``name: value`` of a YAML item; null without a value."""
    return F.concat(F.lit(" " * indent + f"{name}: "), yaml.scalar(value))


def type_references(types: DataFrame) -> Column:
    """Distinct references of a type's page, first seen first: base, interfaces, then the members' returned and parameter types."""
    refs = f"array<{schema.REFERENCE}>"
    some = lambda c: F.coalesce(c, F.array().cast(refs))
    of = lambda x: F.concat(F.filter(F.array(x["return_type"]), lambda r: r.isNotNull()), F.coalesce(F.transform(x["parameters"], lambda q: q["type"]), F.array().cast(refs)))
    every = F.concat(F.filter(F.array("base"), lambda r: r.isNotNull()), some(F.col("interfaces")), some(F.flatten(F.transform("members", of))))
    key = lambda r: F.coalesce(F.nullif(r["uid"], F.lit("")), r["display_name"])
    at = F.transform(every, lambda r, i: F.struct(r.alias("r"), key(r).alias("k"), i.alias("i")))
    return F.transform(F.filter(at, lambda x: x["k"].isNotNull() & ~F.exists(at, lambda y: (y["k"] == x["k"]) & (y["i"] < x["i"]))), lambda x: x["r"])


def _yaml_member(m: Column) -> Column:
    """Item of a member inside its type's page, fields in their fixed order."""
    bare, own = uid.strip_prefix(m["uid"]), uid.strip_prefix(uid.page_uid(F.col("uid"), F.col("full_name")))
    kinds = F.transform(F.coalesce(m["parameters"], F.array().cast(f"array<{schema.PARAMETER}>")), lambda q: q["type"]["display_name"])
    text_of = lambda name, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"  {name}: "), yaml.block_scalar(value, 4)))
    return lines(
        F.concat(F.lit("- uid: "), yaml.scalar(bare)),
        field("commentId", F.nullif(m["uid"], F.lit(""))),
        field("id", F.regexp_extract(bare, r"([^.(]*(?:\(.*)?)$", 1)),
        field("parent", own),
        F.lit("  langs:\n  - csharp"),
        field("name", uid.unqualified(m["name"], kinds)),
        field("nameWithType", uid.qualified(F.col("name"), m["name"], kinds)),
        field("fullName", uid.qualified(F.col("full_name"), m["name"], kinds)),
        F.concat(F.lit("  type: "), m["kind"]),
        F.concat(F.lit("  assemblies:\n  - "), yaml.scalar(F.col("assembly_name"))),
        field("namespace", F.nullif(F.col("namespace"), F.lit(""))),
        text_of("summary", m["documentation"]["summary"]),
        text_of("remarks", m["documentation"]["remarks"]),
        F.lit("  syntax:"),
        sections.yaml_syntax(m["attributes"], F.coalesce(m["signature"], F.lit(""))),
        sections.yaml_parameters(m["parameters"]),
        sections.yaml_return(m["return_type"]),
        field("overload", uid.overload_anchor(bare)),
        sections.yaml_attributes(m["attributes"]),
    )


def _yaml_type_syntax() -> Column:
    """By kind: an enum's values, a delegate's signature, an object's declaration; a union has none of its own."""
    enum = lines(F.lit("  syntax:"), sections.yaml_syntax(F.col("attributes"), F.concat(F.lit("public enum "), F.col("name"))), sections.yaml_enum_values(F.col("values")))
    delegate = lines(F.lit("  syntax:"), sections.yaml_syntax(F.col("attributes"), F.coalesce("invoke.signature", F.lit(""))), sections.yaml_parameters(F.col("invoke.parameters")), sections.yaml_return(F.col("invoke.return_type")))
    plain = lines(F.lit("  syntax:"), sections.yaml_syntax(F.col("attributes"), declaration()))
    kind = F.coalesce("type_kind", F.lit("object"))
    return F.when(kind == "enum", F.when(F.size("values") > 0, enum)).when(kind == "delegate", delegate).when(kind == "union", F.lit(None)).otherwise(plain)


def yaml_pages(types: DataFrame) -> DataFrame:
    """YAML page of every type: the item, its members' items and references; and one of every namespace."""
    kept = types.filter(~filters.compiler_generated(F.col("name")))
    bare = uid.strip_prefix(uid.page_uid(F.col("uid"), F.col("full_name")))
    children = flatten.child_uids(F.col("members"))
    emitted = F.col("emitted") if "emitted" in types.columns else F.array().cast("array<string>")
    bases = F.filter(F.array("base"), lambda r: r["uid"].isNotNull())
    uids = lambda refs: F.transform(refs, lambda r: uid.strip_prefix(r["uid"]))
    item = lines(
        F.lit("### YamlMime:ManagedReference"),
        F.lit("items:"),
        F.concat(F.lit("- uid: "), yaml.scalar(bare)),
        field("commentId", F.nullif(uid.page_uid(F.col("uid"), F.col("full_name")), F.lit(""))),
        field("id", F.col("name")),
        field("parent", F.nullif(F.col("namespace"), F.lit(""))),
        F.when(F.size(children) > 0, F.concat(F.lit("  children:\n"), yaml.sequence(children, 2))),
        F.lit("  langs:\n  - csharp"),
        field("name", title()),
        field("nameWithType", title()),
        field("fullName", F.col("full_name")),
        field("type", F.coalesce("object_kind", F.initcap("type_kind"))),
        F.concat(F.lit("  assemblies:\n  - "), yaml.scalar(F.col("assembly_name"))),
        field("namespace", F.col("namespace")),
        F.when(F.col("documentation.summary") != "", F.concat(F.lit("  summary: "), yaml.block_scalar(F.col("documentation.summary"), 4))),
        F.when(F.col("documentation.remarks") != "", F.concat(F.lit("  remarks: "), yaml.block_scalar(F.col("documentation.remarks"), 4))),
        _yaml_type_syntax(),
        F.when(F.size(bases) > 0, F.concat(F.lit("  inheritance:\n"), yaml.sequence(uids(bases), 2))),
        F.when(F.size("interfaces") > 0, F.concat(F.lit("  implements:\n"), yaml.sequence(uids(F.col("interfaces")), 2))),
        *([F.when(F.size("derived") > 0, F.concat(F.lit("  derivedClasses:\n"), yaml.sequence(uids(F.col("derived")), 2)))] if "derived" in types.columns else []),
        *([F.when(F.size("inherited") > 0, F.concat(F.lit("  inheritedMembers:\n"), yaml.sequence(F.transform("inherited", uid.strip_prefix), 2)))] if "inherited" in types.columns else []),
        *([F.when(F.size("extensions") > 0, F.concat(F.lit("  extensionMethods:\n"), yaml.sequence(F.transform("extensions", lambda m: uid.strip_prefix(m["uid"])), 2)))] if "extensions" in types.columns else []),
        sections.yaml_extension_blocks(F.col("extension_blocks")),
        sections.yaml_seealso(F.col("documentation.see_also")),
        sections.yaml_attributes(F.col("attributes")),
        F.nullif(F.array_join(F.transform(F.filter("members", lambda m: ~filters.compiler_generated(m["name"])), _yaml_member), "\n"), F.lit("")),
        sections.yaml_references(type_references(types), emitted, LEARN),
    )
    pages = kept.select(F.concat(text.sanitise_stem(bare), F.lit(".yml")).alias("path"), item.alias("body"))
    spaces = kept.groupBy("namespace").agg(F.array_sort(F.collect_list(bare)).alias("uids"))
    space = lines(F.lit("### YamlMime:ManagedReference"), F.lit("items:"), F.concat(F.lit("- uid: "), yaml.scalar(F.col("namespace"))), F.lit("  type: Namespace"), F.concat(F.lit("  children:\n"), yaml.sequence(F.col("uids"), 2)))
    return pages.union(spaces.filter("namespace <> ''").select(F.concat(text.sanitise_stem(F.col("namespace")), F.lit(".yml")).alias("path"), space.alias("body")))


def write_pages(pages: DataFrame, root: str) -> int:
    """Writes the table as Parquet under ``root``, replacing what is there, and gives the number of pages."""
    pages.write.mode("overwrite").parquet(root)
    return pages.sparkSession.read.parquet(root).count()


def export_files(pages: DataFrame, root: str) -> int:
    """A UTF-8 file for each page under a folder that all executors mount."""
    import os

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, body in zip(f["path"], f["body"], strict=True):
                target = os.path.join(root, path)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                with open(target, "w", encoding="utf-8", newline="\n") as out:
                    out.write(body)
            yield pd.DataFrame({"n": [len(f)]})

    return pages.mapInPandas(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
