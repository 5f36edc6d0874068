"""Merge, indexes, folds, closures, settings, pages and streaming on small catalogs."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from apiarium.operators import closure, filters, flatten, merge, select
from apiarium.plans import catalog_api, pages
from apiarium.sources import readers, schema
from apiarium.streaming.incremental import IncrementalMerge


def catalog(spark, rows):
    """Types from partial dicts; flags are false, lists empty and documentation blank unless given."""
    doc = {"summary": "", "remarks": "", "returns": "", "value": "", "examples": [], "parameters": [], "type_parameters": [], "exceptions": [], "see_also": []}
    full = []
    for r in rows:
        x = {"name": r["uid"], "full_name": r["uid"], "namespace": "", "arity": 0, "type_kind": "object", "object_kind": "Class", "assembly_name": "Test", "interfaces": [], "is_static": False, "is_sealed": False, "is_abstract": False, "is_obsolete": False, "type_parameters": [], "attributes": [], "members": [], "extension_blocks": [], "values": [], "cases": [], "documentation": doc, "forwarded": False}
        full.append(json.dumps(x | r))
    return spark.createDataFrame([(x,) for x in full], "j string").select(F.from_json("j", schema.TYPES).alias("t")).select("t.*")


def member(uid, name, kind="Method", **more):
    return {"uid": uid, "name": name, "kind": kind, "parameters": [], "signature": f"void {name}()", "documentation": {"summary": f"About {name}.", "parameters": []}, "is_extension": False} | more


def merged(spark, rows):
    return {r["uid"]: r for r in catalog_api.extract(catalog(spark, rows)).collect()}


def test_merge_orders_frameworks_and_takes_the_canonical_variant(spark):
    got = merged(spark, [{"uid": "Foo", "tfm": "netstandard2.0", "source_url": "old"}, {"uid": "Foo", "tfm": "net10.0", "members": [member("M:Foo.Modern", "Modern")]}, {"uid": "Foo", "tfm": "net8.0", "members": [member("M:Foo.Legacy", "Legacy")], "source_url": "eight"}, {"uid": "", "tfm": "net8.0", "name": "x"}, {"uid": "Gone", "tfm": "net8.0", "source_url": ""}])
    assert set(got) == {"Foo", "Gone"}
    assert got["Foo"]["applies_to"] == ["net10.0", "net8.0", "netstandard2.0"]
    assert [m["name"] for m in got["Foo"]["members"]] == ["Modern"]
    assert got["Foo"]["source_url"] == "eight"
    assert got["Gone"]["source_url"] == ""


def test_broadcast_copies_types_to_folded_frameworks(spark):
    b = spark.createDataFrame([("net9.0", ["net8.0"])], "tfm string, broadcast_tfms array<string>")
    got = catalog_api.extract(catalog(spark, [{"uid": "Foo", "tfm": "net9.0"}]), b).first()
    assert got["applies_to"] == ["net9.0", "net8.0"]


def test_indexes(spark):
    types = catalog(spark, [{"uid": "T:Base", "tfm": "t", "members": [member("M:Base.Run", "Run"), member("M:Base.g", "<g>")]}, {"uid": "T:Child", "tfm": "t", "base": {"display_name": "Base", "uid": "T:Base"}}, {"uid": "T:S", "tfm": "t", "object_kind": "Struct"}, {"uid": "T:Host", "tfm": "t", "is_static": True, "members": [member("M:Host.Ext", "Ext", is_extension=True, parameters=[{"name": "x", "type": {"display_name": "Base", "uid": "T:Base"}}])]}])
    ix = catalog_api.build_indexes(types)
    assert [[x["uid"] for x in r["derived"]] for r in ix["derived"].collect()] == [["T:Child"]]
    assert [(r["uid"], [tuple(x) for x in r["extensions"]]) for r in ix["extensions"].collect()] == [("T:Base", [("T:Host", "Ext", "M:Host.Ext")])]
    inherited = {r["uid"]: r["inherited"] for r in ix["inherited"].collect()}
    assert inherited["T:Child"][0] == "M:Base.Run" and len(inherited["T:Child"]) == 8
    assert len(inherited["T:Base"]) == 7 and "T:S" not in inherited


def test_fold_subsets(spark):
    g = spark.createDataFrame([("net10", ["a", "b"], 3), ("net8", ["a"], 2), ("net7", ["a", "c"], 1), ("net6", ["a", "b"], 0), ("none", [], 0)], "k string, m array<string>, r int")
    got = dict(merge.fold_subsets(g, key="k", members="m", rank="r").collect())
    assert got == {"net10": "net10", "net8": "net10", "net7": "net7", "net6": "net10", "none": "net10"}


def test_merge_documentation(spark):
    d = "struct<summary:string,parameters:array<struct<name:string,value:string>>>"
    row = spark.createDataFrame([(("", [("a", "1")]), ("P", [("a", "2"), ("b", "3")]))], f"c {d}, p {d}")
    got = row.select(merge.merge_documentation(F.col("c"), F.col("p"), ["summary"], ["parameters"]).alias("d")).first()["d"]
    assert got.summary == "P" and [(x.name, x.value) for x in got.parameters] == [("a", "1"), ("b", "3")]


def test_closures_end_on_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    got = {(r.root, r.node): r.depth for r in closure.reach(e, max_depth=8).collect()}
    assert got[(1, 4)] == 3 and (1, 1) not in got and len(got) == 9
    n = spark.createDataFrame([(1, 1, "one"), (2, 1, None), (3, 2, None), (5, 6, None), (6, 5, None)], "id long, up long, v string")
    values = {r.id: (r.value, r.source) for r in closure.inherit_nearest(n, node="id", parent="up", value=F.col("v")).collect()}
    assert values == {1: ("one", 1), 2: ("one", 1), 3: ("one", 1), 5: (None, None), 6: (None, None)}


def test_rules_and_references(spark):
    rows = spark.createDataFrame([("Harbour.Boats",), ("HarbourX",), ("Quay",)], "n string")
    got = rows.select(select.boundary_rule(F.col("n"), [("Harbour", "hb"), ("Quay", "qy")])).collect()
    assert [r[0] for r in got] == ["hb", None, "qy"]
    refs = F.array(*map(F.lit, ["net6.0", "net8.0", "netstandard2.0", "net472"]))
    pick = lambda t: spark.range(1).select(select.best_reference(F.lit(t), refs)).first()[0]
    assert [pick(t) for t in ("net8.0", "net8.0-ios", "net7.0", "netstandard2.1", "netstandard1.0")] == ["net8.0", "net8.0", "net6.0", "netstandard2.0", "net8.0"]


def test_filters(spark):
    attrs = F.array(F.struct(F.lit("T:System.ObsoleteAttribute").alias("uid"), F.array(F.struct(F.lit(None).cast("string").alias("name"), F.lit("gone").alias("value"))).alias("arguments")))
    got = spark.range(1).select(filters.obsolete(attrs).alias("o"), filters.default_skip(F.lit("runtime.win")).alias("s"), filters.excluded_attribute(F.lit("T:System.Runtime.CompilerServices.NullableAttribute")).alias("e"), filters.root_nuspec(F.lit("a/b.nuspec")).alias("r")).first()
    assert tuple(got.o) == (True, "gone") and got.s and got.e and not got.r


def test_settings(spark):
    xml = '<configuration><packageSources><add key="a" value="1"/><clear/><!-- <add key="z" value="9"/> --><add key="B" value="2"/><add key="b" value="3"/></packageSources><config><add key="globalPackagesFolder" value="/g"/></config><disabledPackageSources><add key="B" value="true"/></disabledPackageSources></configuration>'
    e = readers.elements_of(spark.createDataFrame([("p", xml)], "path string, value string"))
    assert [(r.key, r.value, r.cleared) for r in readers.package_sources(e, ["ord"]).collect()] == [("B", "2", True)]
    assert tuple(readers.global_folder(e, ["ord"]).first()) == ("Found", "/g")
    assert [r.key for r in readers.disabled_sources(e).collect()] == ["b"]


def test_readers(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"nugetPackageOwners": ["o"], "tfmPreference": ["net10.0"], "unknown": 1}')
    assert readers.read_manifest(spark, str(tmp_path / "m.json")).first()["tfmPreference"] == ["net10.0"]
    (tmp_path / "t.json").write_text('{"tfmPreference": ["a"], /* "tfmPreference" */ "tfmOverrides": {"x": "y", "tfmPreference": "z"}, "tfmPreference": ["b"]}')
    with pytest.raises(Exception, match="repeated key in the manifest: tfmPreference"):
        readers.read_manifest(spark, str(tmp_path / "t.json")).collect()
    (tmp_path / "o.json").write_text('// c\n{"tfmOverrides": {"A": "net8.0", "tfmPreference": "q{[\\""}, "tfmPreference": ["n"]}')
    o = readers.read_manifest(spark, str(tmp_path / "o.json"))
    got = readers.with_overrides(o.select(F.explode(F.array(F.lit("A"), F.lit("a"))).alias("id"), "tfmOverrides"), F.col("tfmOverrides"))
    assert [(r.id, r.tfm_override) for r in got.collect()] == [("A", "net8.0"), ("a", None)]
    (tmp_path / "bad.json").write_text('{"tfmPreference": [}')
    with pytest.raises(Exception):  # noqa: B017, PT011
        readers.read_manifest(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "c.json").write_text('{"build": {"x": [1,],}, /* c */ "other": {"y": "//no"},}')
    got = readers.read_config(spark, str(tmp_path / "c.json"), ["build"]).first()
    assert json.loads(got["build"]) == {"x": [1]} and json.loads(got["extra"]["other"]) == {"y": "//no"}
    (tmp_path / "d.xml").write_text('\ufeff<doc><members><member name="T:A">one</member><member name="T:A">two</member><member name="T:B">cut', encoding="utf-8")
    assert [(r.member_id, r.fragment) for r in readers.read_documentation(spark, str(tmp_path / "d.xml")).collect()] == [("T:A", "two")]
    (tmp_path / "ids.txt").write_text("# c\n A \n\nB\n")
    assert [r.id for r in readers.read_ids(spark, str(tmp_path / "ids.txt")).collect()] == ["A", "B"]
    link = spark.range(1).select(readers.source_link_map(F.lit('{"documents":{"C:\\\\s\\\\*":"https://x/*"}}'))).first()[0]
    assert [tuple(x) for x in link] == [("C:\\s\\", "https://x/", True)]


def test_package_entries(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "p.nupkg", "w") as z:
        z.writestr("lib/net8.0/A.dll", b"x")
        z.writestr("sub/no.nuspec", "<no/>")
        z.writestr("p.nuspec", '<package><dependency id="B"/><dependency id="b"/><dependency id="A"/></package>')
    e = readers.package_entries(spark, str(tmp_path / "p.nupkg"))
    assert [r.tfm for r in readers.library_entries(e).collect()] == ["net8.0"]
    assert readers.root_description(e).select(readers.dependency_ids(F.col("nuspec"))).first()[0] == ["a", "b"]


def test_pages(spark, tmp_path):
    types = pages.documented(catalog_api.extract(catalog(spark, [{"uid": "T:N.Foo", "tfm": "net8.0", "name": "Foo", "full_name": "N.Foo", "namespace": "N", "arity": 1, "documentation": {"summary": "A <c>foo</c>."}, "members": [member("M:N.Foo.Run", "Run"), member("M:N.Foo.Run(x)", "Run"), member("M:N.Foo.h", "<h>")]}])))
    md = {r.path: r.body for r in pages.type_pages(types).union(pages.member_pages(types)).union(pages.landing_pages(types)).collect()}
    assert set(md) == {"N/Foo{T}.md", "N/Foo{T}/Run.md", "N/index.md", "Test/index.md"}
    assert "# Foo<T> { #T:N.Foo }" in md["N/Foo{T}.md"] and "A `foo`." in md["N/Foo{T}.md"] and md["N/Foo{T}.md"].count("| Run |") == 1
    assert md["N/Foo{T}/Run.md"].count("void Run()") == 2
    yml = {r.path: r.body for r in pages.yaml_pages(types).collect()}
    assert "- uid: N.Foo" in yml["N.Foo.yml"] and "type: Namespace" in yml["N.yml"]
    assert pages.write_pages(pages.yaml_pages(types), str(tmp_path / "out")) == 2
    assert pages.export_files(pages.yaml_pages(types), str(tmp_path / "files")) == 2


def test_page_sections(spark, tmp_path):
    doc = {"summary": "Has <c>code</c>.", "remarks": "", "returns": "A <b>b</b>", "value": "", "examples": ["<i>e</i>"], "parameters": [{"name": "x", "value": "the <c>x</c>"}], "type_parameters": [], "exceptions": [], "see_also": ["T:N.Base", "T:System.Uri"]}
    ref = lambda n, u: {"display_name": n, "uid": u}
    attribute = {"display_name": "Old", "uid": "T:N.OldAttribute", "constructor_uid": "", "arguments": []}
    rows = [
        {"uid": "T:N.Base", "tfm": "t", "name": "Base", "full_name": "N.Base", "namespace": "N", "attributes": [attribute], "members": [member("M:N.Base.Run", "Run", documentation=doc, parameters=[{"name": "x", "type": ref("int", "T:System.Int32")}], source_url="https://s/1")]},
        {"uid": "T:N.Child", "tfm": "t", "name": "Child", "full_name": "N.Child", "namespace": "N", "base": ref("Base", "T:N.Base"), "documentation": doc},
        {"uid": "T:N.Host", "tfm": "t", "name": "Host", "full_name": "N.Host", "namespace": "N", "is_static": True, "members": [member("M:N.Host.Ext", "Ext", is_extension=True, parameters=[{"name": "b", "type": ref("Base", "T:N.Base")}])]},
        {"uid": "T:N.U", "tfm": "t", "name": "U", "full_name": "N.U", "namespace": "N", "type_kind": "union", "object_kind": None, "cases": [ref("Base", "T:N.Base")]},
        {"uid": "T:N.E", "tfm": "t", "name": "E", "full_name": "N.E", "namespace": "N", "type_kind": "enum", "object_kind": None, "values": [{"name": "One", "uid": "F:N.E.One", "value": "1", "documentation": doc}]},
        {"uid": "T:N.D", "tfm": "t", "name": "D", "full_name": "N.D", "namespace": "N", "type_kind": "delegate", "object_kind": None, "invoke": {"signature": "int D(int x)", "parameters": [{"name": "x", "type": ref("int", "T:System.Int32")}], "return_type": ref("int", "T:System.Int32")}},
    ]
    types = pages.documented(catalog_api.with_indexes(catalog_api.extract(catalog(spark, rows))))
    md = {r.path: r.body for r in pages.type_pages(types).union(pages.member_pages(types)).collect()}
    base, child = md["N/Base.md"], md["N/Child.md"]
    assert "## Derived types\n\n- [Child][T:N.Child]" in base and "## Extension members\n\n- [`Host.Ext`][M:N.Host.Ext]" in base and "Attributes: `[Old]`" in base
    assert "    - [`N.Base.Run`][M:N.Base.Run]" in child and "## See also\n\n- [N.Base][T:N.Base]\n- [System.Uri](https://learn.microsoft.com/dotnet/api/system.uri)" in child
    assert "| [Base][T:N.Base] |  |" in md["N/U.md"] and "U o-- Base" in md["N/U.md"]
    run = md["N/Base/Run.md"]
    assert "Has `code`." in run and "the `x`" in run and "**Returns:** A **b**" in run and "[View source](https://s/1)" in run and "<c>" not in run
    yml = {r.path: r.body for r in pages.yaml_pages(types).collect()}
    assert "  seealso:\n  - linkType: CRef\n    commentId: T:N.Base\n    altText: N.Base" in yml["N.Child.yml"]
    assert "  derivedClasses:\n  - N.Child" in yml["N.Base.yml"] and "  attributes:\n  - type: N.OldAttribute\n    arguments: []" in yml["N.Base.yml"] and "    content: >-\n    [Old]\n    \n    public class Base" in yml["N.Base.yml"]
    assert "- uid: System.Int32\n  commentId: T:System.Int32\n  parent: System\n  isExternal: true\n  href: https://learn.microsoft.com/dotnet/api/system.int32\n  name: int" in yml["N.Base.yml"]
    assert "    - id: One\n      defaultValue: 1\n      description: Has `code`." in yml["N.E.yml"] and "public enum E" in yml["N.E.yml"]
    assert "    content: int D(int x)\n    parameters:\n    - id: x\n      type: System.Int32\n    return:\n      type: System.Int32" in yml["N.D.yml"]
    assert "syntax" not in yml["N.U.yml"]
    for flavour, n in (("markdown", 10), ("yaml", 7)):
        assert tuple(catalog_api.run(catalog(spark, rows), str(tmp_path / flavour), flavour).first()) == (6, 1, n)


def test_inheritance_of_documentation(spark):
    from apiarium.operators import inherit

    rows = [("a", "A", "", False, None, None), ("b", "", "", False, None, "a"), ("c", "", "note", True, None, "b"), ("d", "own", "", False, None, "a"), ("e", "", "", False, None, "z"), ("f", "", "", True, "g", None), ("g", "", "", True, "f", None), ("h", "H", "", True, "a", "d"), ("i", "", "", True, None, "j"), ("j", "", "", False, None, None)]
    nodes = spark.createDataFrame([(*r, r[0].upper()) for r in rows], "uid string, summary string, remarks string, explicit boolean, cref string, natural string, container string")
    got = {r.uid: (r.summary, r.remarks, r.inherited_from) for r in inherit.resolve(nodes, fields=["summary", "remarks"]).collect()}
    assert got == {"a": ("A", None, None), "b": ("A", None, "A"), "c": ("A", "note", "B"), "d": ("own", None, None), "e": (None, None, None), "f": (None, None, None), "g": (None, None, None), "h": ("H", None, "A"), "i": (None, None, "J"), "j": (None, None, None)}


def test_incremental_merge_equals_batch(spark, tmp_path):
    rows = [{"uid": f"T{i % 7}", "tfm": t} for i in range(20) for t in ("net8.0", "net10.0")]
    whole = catalog(spark, rows).select("uid", "tfm", "source_url", "full_name")
    (src := tmp_path / "src").mkdir()
    for i, part in enumerate(whole.randomSplit([1.0, 1.0], 3)):
        part.write.parquet(str(src / f"b{i}"))
    merge_ = lambda v: merge.merge_variants(v, uid="uid", tag="tfm", rank=F.when(F.col("tfm") == "net10.0", 2).otherwise(1), order=["tfm"], url="source_url")
    inc = IncrementalMerge(str(tmp_path / "v"), str(tmp_path / "m"), merge_, buckets=4)
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(src))
    inc.start(stream, str(tmp_path / "cp")).awaitTermination()
    key = lambda df: sorted((r.uid, tuple(r.applies_to)) for r in df.collect())
    assert key(inc.build(spark)) == key(merge_(whole))


def test_flatten(spark):
    types = catalog(spark, [{"uid": "T:U", "tfm": "t", "type_kind": "union"}, {"uid": "T:C", "tfm": "t", "base": {"display_name": "U", "uid": "T:U"}, "members": [member("M:C.A", "A", accessibility="Public"), member("M:C.B", "B", accessibility="Private")]}])
    assert [r.uid for r in flatten.members(types).collect()] == ["M:C.A"]
    assert [tuple(r)[:2] for r in flatten.union_cases(types.withColumn("base_uid", F.col("base.uid"))).collect()] == [("T:U", "T:C")]


def test_source_contract(spark):
    from apiarium.sources.catalog_source import AssemblyGroups

    spark.dataSource.register(AssemblyGroups)
    got = spark.read.format("assembly_groups").option("listing", '{"tfm": "net8.0", "paths": ["a.dll", "b.dll"]}').load()
    assert [(r.tfm, r.ord, r.path) for r in flatten.work_items(got).collect()] == [("net8.0", 0, "a.dll"), ("net8.0", 1, "b.dll")]
