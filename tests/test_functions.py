"""Scalar functions against literal cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from apiarium.functions import markup, text, tfm, uid, url, yaml
from apiarium.queries import QUERIES


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("fragment", "expected"),
    [
        ("", ""),
        ("  \n\t", ""),
        ("a &lt;b&gt; &#65;&#x42; &copy;&unended", "a <b> AB &unended"),
        ("call <c>open()</c> first", "call `open()` first"),
        ('as in <see cref="T:Harbour.Quay"/>, too', "as in [Quay][T:Harbour.Quay], too"),
        ('<see langword="null"/>', "`null`"),
        ('<see href="https://e.x">the docs</see>', "[the docs](https://e.x)"),
        ('<see href="https://e.x"/>', "<https://e.x>"),
        ('<paramref name="v"/>', "`v`"),
        ("<code>a &amp;&amp; b</code>", "```csharp\na && b\n```"),
        ("<b>x</b> <em>y</em>", "**x** *y*"),
        ("<c>outer(<c>x</c>)</c>", "`outer(x)`"),
        ("kept <blink>as it is</blink> here", "kept as it is here"),
        ("before<para>a paragraph of its own</para>after", "before\n\na paragraph of its own\n\nafter"),
        ('<list type="number"><item><description>One</description></item><item><description>Two</description></item></list>', "1. One\n2. Two"),
        ('<list type="table"><item><term>a|b</term><description/></item></list>', "| Term | Description |\n| --- | --- |\n| a\\|b | |"),
    ],
)
def test_markdown(fragment, expected):
    assert markup.convert(fragment) == expected


def test_markdown_column(spark):
    got = spark.createDataFrame([("a <b>x</b>",), ("plain",), (None,), (" ",)], "s string").select(markup.to_markdown(F.col("s"))).collect()
    assert [r[0] for r in got] == ["a **x**", "plain", None, ""]


def test_documentation_and_inner_xml():
    d = markup.documentation('<summary>One</summary><summary>Two <c>x</c></summary><param name="a">A</param><seealso cref="T:X"/><inheritdoc cref="M:Y"/>')
    assert d["summary"] == "Two <c>x</c>"
    assert d["parameters"] == [{"name": "a", "value": "A"}]
    assert d["see_also"] == ["T:X"]
    assert (d["has_inheritdoc"], d["inheritdoc_cref"]) == (True, "M:Y")
    assert markup.inner_xml("<a><b>x<b>y</b></b></a>", "b") == "x<b>y</b>"
    assert markup.inner_xml("<a><b>x", "b") == ""
    assert markup.display_generic("T:A.Dict{System.String,A.List{System.Int32}}") == "Dict<String, List<Int32>>"


@pytest.mark.parametrize(("tag", "expected"), [("net10.0", 1000), ("net5.0", 500), ("net9", 100), ("net5", 500), ("netcoreapp3.1", 550), ("netstandard2.1", 510), ("net472", 300), ("net8.0-android", 795), ("uap10", 100)])
def test_rank(spark, tag, expected):
    assert one(spark, tfm.rank(F.lit(tag))) == expected


def test_tfm_views(spark):
    p = one(spark, tfm.parsed(F.lit("net8.0-ios17")))
    assert (p.family, p.version, p.platform) == ("net", "8.0", "ios17")
    labels = {"net8.0-MacCatalyst": "maccatalyst", "MonoAndroid10": "android", "xamarinios10": "ios", "xamarinmac20": "maccatalyst", "uap10.0": "windows", "net8.0-windows10": "windows", "net8.0": None}
    assert {t: one(spark, tfm.platform_label(F.lit(t))) for t in labels} == labels
    e = one(spark, tfm.metadata_entries(F.array(*map(F.lit, labels))))
    assert [x.platform for x in e.entries] == list(labels.values()) and e.platforms == ["android", "ios", "maccatalyst", "windows"]
    assert [one(spark, tfm.is_legacy(F.lit(x))) for x in ("net45", "net461", "net462", "net48", "net8.0", "netstandard2.0", "", "junk")] == [True, True, False, False, False, False, False, True]
    assert one(spark, tfm.matches(F.lit("net8.0-ios"), F.lit("NET8.0")))


def test_label_of_a_suffix(spark):
    tags = {"uap10-x": None, "uap10.0": None, "monoandroid12": None, "MonoAndroid12-IOS": "ios", "uap10-windows": "windows", "net8.0-android34": "android", "net8.0-MacCatalyst": "maccatalyst", "net8.0": None, "windows": None, "": None, None: None}
    assert {t: one(spark, tfm.suffix_label(F.lit(t).cast("string"))) for t in tags} == tags
    # the older name in front counts in platform_label, and comes first by the order of the labels
    both = {"uap10-x": "windows", "MonoAndroid12-IOS": "android", "uap10-android": "android", "xamarinios-windows": "ios"}
    assert {t: one(spark, tfm.platform_label(F.lit(t))) for t in both} == both


def test_tfm_parse_labels_by_suffix(spark):
    got = QUERIES["tfm_parse"](spark, "/root/testdata/sf0.001").select("raw", "platform", "label").distinct().collect()
    assert {r.raw: r.label for r in got if r.platform} == {"net8.0-android34": "android", "net9.0-windows10.0": "windows", "uap10-x": None, "net8.0-maccatalyst": "maccatalyst"}


def test_uids(spark):
    assert one(spark, uid.parent_of(F.lit("T:A.B{C.D}"))) == "T:A"
    assert one(spark, uid.top_level_arguments(F.lit("X{A,B{C,D},E}"))) == 3
    assert one(spark, uid.open_generic(F.lit("T:X`2{A,B}"))) == "T:X`2"
    assert one(spark, uid.strip_attribute_suffix(F.lit("Attribute"))) == "Attribute"
    assert one(spark, uid.to_keyword(F.lit("System.Int32"))) == "int"
    assert one(spark, uid.to_clr(F.lit("float"))) == "System.Single"
    assert one(spark, uid.type_uid(F.lit("N"), F.array(F.lit("Outer")), F.lit("In"))) == "T:N.Outer.In"
    assert one(spark, uid.autoref_id(F.lit("T:A{B}"))) == "T:A-1"
    assert one(spark, uid.mermaid_arity(F.lit(2))) == "~T1,T2~"


def test_texts(spark):
    assert one(spark, text.table_escape(F.lit(""))) == " "
    assert one(spark, text.escape_cell(F.lit("a|b\r\nc"))) == "a\\|b  c"
    assert one(spark, text.first_paragraph(F.lit("  a\nb\n\nc"))) == "a b"
    assert one(spark, text.quote(F.lit('a"b\\'))) == '"a\\"b\\\\"'
    assert one(spark, text.back_link(F.lit("a/b"), F.lit("i.md"))) == "../../i.md"
    assert one(spark, text.collapse_whitespace(F.lit("a \t b\n c  \n"))) == "a b\n c"
    assert one(spark, text.modifiers(F.lit(False), F.lit(True), F.lit(True))) == "abstract"


def test_urls(spark):
    assert one(spark, url.blob_url(F.lit("https://raw.githubusercontent.com/o/r/c/a.cs"), F.lit(0))) == "https://github.com/o/r/blob/c/a.cs"
    assert one(spark, url.query_parameter(F.lit("a=1&Path=%2Fx"), "path")) == "%2Fx"
    assert one(spark, url.query_parameter(F.lit("a=1"), "path")) is None
    assert one(spark, url.link(F.lit("T:System.String"), F.lit("String"), F.lit(False), "https://l/")) == "[String](https://l/system.string)"
    assert one(spark, url.link(F.lit("!:x"), F.lit("x"), F.lit(True), "https://l/")) == "`x`"


@pytest.mark.parametrize(("s", "expected"), [("", True), ("plain", False), ("true", True), ("a: b", True), ("a:b", False), ("a #b", True), ("a#b", False), ("- x", True), ("tail:", True), ('a"b', True)])
def test_yaml_quoting(spark, s, expected):
    assert one(spark, yaml.needs_quoting(F.lit(s))) is expected


def test_yaml_scalars(spark):
    assert one(spark, yaml.scalar(F.lit('a"\n\x01'))) == '"a\\"\\n\\x01"'
    assert one(spark, yaml.block_scalar(F.lit("a\nb"), 2)) == "|-\n  a\n  b"
    assert one(spark, yaml.scalar(F.lit(""))) == "''"


@pytest.mark.parametrize(
    ("area", "expected"),
    [(' a="1" name="x" b="2"', "x"), ("name='q' name=\"x\"", ""), ("a='1' name=\"x\"", ""), ('title="name = \\"" name="x"', ""), ('b="name=1" name = "y"', "y"), ('Name="x"', ""), ("", ""), (' surname="s" name="n"', "n")],
)
def test_attributes_are_read_from_the_left(spark, area, expected):
    assert one(spark, markup.attribute(F.lit(area), "name")) == expected
