"""Readers of catalogs, manifests, settings, documentation files and package listings.

Loading compiled assemblies and symbol files, and downloading packages, are outside: catalogs
come as Parquet or JSON in the schema of ``apiarium.sources.schema``. All paths go through
Spark's own readers, so any store that it reaches will do.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from apiarium.operators import select
from apiarium.sources import schema


def read_catalog(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Types of one or more walks; columns that a file lacks are null."""
    return spark.read.schema(schema.TYPES).format(fmt).load(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The package manifest; malformed JSON and a key that occurs twice are errors, unknown keys are ignored."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^\\uFEFF", "").alias("j"))
    clean = F.regexp_replace("j", r'(?s)("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/', "$1")
    keys = _top_keys(clean)
    twice = F.filter(keys, lambda k: F.size(F.filter(keys, lambda o: o == k)) > 1)
    checked = F.when(F.size(twice) > 0, F.raise_error(F.concat(F.lit("repeated key in the manifest: "), F.get(twice, F.lit(0))))).otherwise(clean)
    return raw.select(F.from_json(checked, schema.MANIFEST, {"mode": "FAILFAST"}).alias("m")).select("m.*")


def _top_keys(json_text: Column) -> Column:
    """Keys of the outermost object, repeated ones too."""
    # strings keep their place and length; their contents can neither open nor close anything
    strings = F.regexp_extract_all(json_text, F.lit(r'"((?:[^"\\]|\\.)*)"'), 1)
    parts = F.split(F.regexp_replace(json_text, r'"(?:[^"\\]|\\.)*"', '"'), '"')
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("i"), F.array().cast("array<string>").alias("keys"))

    def step(s: Column, part: Column) -> Column:
        opened = F.length(F.regexp_replace(part, r"[^\[{]", "")) - F.length(F.regexp_replace(part, r"[^\]}]", ""))
        own = (s["depth"] == 1) & (s["i"] > 0) & part.rlike(r"^\s*:")
        keys = F.when(own, F.concat(s["keys"], F.array(F.get(strings, s["i"] - 1)))).otherwise(s["keys"])
        return F.struct((s["depth"] + opened).cast("int").alias("depth"), (s["i"] + 1).alias("i"), keys.alias("keys"))

    return F.aggregate(parts, start, step)["keys"]


def with_overrides(packages: DataFrame, overrides: Column) -> DataFrame:
    """``packages`` (id, ...) with ``tfm_override``: the manifest's entry for that id, letter for letter, or null."""
    return packages.withColumn("tfm_override", F.element_at(overrides, F.col("id")))


def read_config(spark: SparkSession, path: str, known: list[str]) -> DataFrame:
    """A JSON configuration: one column for each known key as JSON text, and ``extra``, a map of the others as they are."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^\\uFEFF", "").alias("j"))
    # comments and trailing commas are allowed
    clean = F.regexp_replace(F.regexp_replace("j", r'(?s)("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/', "$1"), r",(\s*[\]}])", "$1")
    m = F.from_json(clean, "map<string,string>")
    return raw.select(*[m[k].alias(k) for k in known], F.map_filter(m, lambda k, _: ~k.isin(*known)).alias("extra"))


def write_config(config: dict) -> str:
    """Indented JSON text of a configuration."""
    return json.dumps(config, indent=2, ensure_ascii=False)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a file of identifiers, trimmed, without blank lines and comments."""
    line = F.trim(F.regexp_replace("value", "[\r\t]", ""))
    return spark.read.text(path).select(line.alias("id")).filter("id <> '' and not startswith(id, '#')")


def write_ids(rows: DataFrame, path: str, order: str) -> None:
    """One identifier a line, in order; a manifest's list, so one file."""
    rows.orderBy(order).select(F.col("id").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_documentation(spark: SparkSession, path: str) -> DataFrame:
    """(path, member_id, fragment) of documentation files; the last of repeated ids wins, a truncated tail is left out."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace("value", "^\\uFEFF", "").alias("x"))
    return member_fragments(raw, "path", F.col("x"))


def member_fragments(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """Splits text into its ``<member name="...">`` ranges."""
    hit = rows.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(r'(?s)(<member\s+name="[^"]*"\s*>.*?</member>)'), 1)).alias("pos", "m"))
    parts = hit.select(key, "pos", F.regexp_extract("m", r'^<member\s+name="([^"]*)"', 1).alias("member_id"), F.regexp_extract("m", r"(?s)^<member[^>]*>(.*)</member>$", 1).alias("fragment"))
    return parts.groupBy(key, "member_id").agg(F.max_by("fragment", "pos").alias("fragment"))


def settings_elements(spark: SparkSession, path: str) -> DataFrame:
    """(path, section, ord, element, key, value) of ``add`` and ``clear`` in configuration XML."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return elements_of(raw)


def elements_of(raw: DataFrame) -> DataFrame:
    clean = F.regexp_replace("value", r"(?s)<!--.*?-->", "")
    sections = raw.select("path", F.explode(F.regexp_extract_all(clean, F.lit(r"(?s)(<(config|packageSources|disabledPackageSources|fallbackPackageFolders|packageSourceCredentials)>.*?</\2>)"), 1)).alias("s"))
    sections = sections.select("path", F.regexp_extract("s", "^<(\\w+)>", 1).alias("section"), "s")
    each = sections.select("path", "section", F.posexplode(F.regexp_extract_all("s", F.lit(r"<((?:add|clear)\b[^>]*)/?>"), 1)).alias("ord", "e"))
    attr = lambda n: F.regexp_extract("e", rf'(?i)\b{n}\s*=\s*"([^"]*)"', 1)
    return each.select("path", "section", "ord", F.regexp_extract("e", "^(\\w+)", 1).alias("element"), attr("key").alias("key"), attr("value").alias("value"))


def package_sources(elements: DataFrame, order: list[str]) -> DataFrame:
    """Sources by key: the first after the last clear."""
    own = elements.filter("section = 'packageSources'").withColumn("scope", F.lit(0))
    return select.clear_fold(own, scope=["scope"], order=order, is_clear=F.col("element") == "clear", key=F.lower("key"), value=F.struct("key", "value")).select("value.*", "cleared")


def disabled_sources(elements: DataFrame) -> DataFrame:
    return elements.filter("section = 'disabledPackageSources' and element = 'add' and lower(value) = 'true'").select(F.lower("key").alias("key")).distinct()


def global_folder(elements: DataFrame, order: list[str]) -> DataFrame:
    """state and value of the setting globalPackagesFolder."""
    own = elements.filter("section = 'config' and (element = 'clear' or lower(key) = 'globalpackagesfolder')")
    return select.setting(own, order=order, is_clear=F.col("element") == "clear", value=F.col("value"))


def fallback_folders(elements: DataFrame, order: list[str]) -> DataFrame:
    own = elements.filter("section = 'fallbackPackageFolders'").withColumn("scope", F.lit(0))
    return select.clear_fold(own, scope=["scope"], order=order, is_clear=F.col("element") == "clear", key=F.col("value"), value=F.col("value")).select("value")


def source_link_map(json_text: Column) -> Column:
    """Rules (prefix, url, is_wildcard) of a source-link file, in order; wildcards lose their star."""
    docs = F.from_json(F.get_json_object(json_text, "$.documents"), "map<string,string>")
    star = lambda s: F.regexp_replace(s, r"\*$", "")
    return F.transform(F.map_entries(docs), lambda e: F.struct(star(e["key"]).alias("prefix"), star(e["value"]).alias("url"), e["key"].endswith("*").alias("is_wildcard")))


def package_base_address(json_text: Column) -> Column:
    """Address of the first resource of type PackageBaseAddress/3.0.0, with a trailing slash."""
    resources = F.from_json(F.get_json_object(json_text, "$.resources"), "array<map<string,string>>")
    url = F.get(F.filter(resources, lambda r: r["@type"] == "PackageBaseAddress/3.0.0"), F.lit(0))["@id"]
    return F.when(url.endswith("/"), url).otherwise(F.concat(url, F.lit("/")))


def dependency_ids(nuspec: Column) -> Column:
    """Distinct lower-cased dependency ids of a package description, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(nuspec, F.lit(r'<dependency\b[^>]*\bid\s*=\s*"([^"]*)"'), 1), F.lower)))


def _entries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = []
        for path, content in zip(f["path"], f["content"], strict=True):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for i, x in enumerate(z.infolist()):
                    text = z.read(x).decode("utf-8-sig", "replace") if x.filename.lower().endswith((".nuspec", ".xml")) and x.file_size <= 128 << 20 else None
                    rows.append((path, i, x.filename, x.file_size, text))
        yield pd.DataFrame(rows, columns=["path", "ord", "name", "size", "text"])


def package_entries(spark: SparkSession, path: str) -> DataFrame:
    """(path, ord, name, size, text) of the entries of zip packages; text of XML entries up to 128 MiB."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_entries, "path string, ord int, name string, size long, text string")


def library_entries(entries: DataFrame) -> DataFrame:
    """Entries under lib/<framework>, grouped by package and framework (case ignored)."""
    own = entries.filter("lower(name) rlike '^lib/[^/]+/[^/]+\\\\.(dll|xml)$'")
    return own.groupBy("path", F.lower(F.split_part("name", F.lit("/"), F.lit(2))).alias("tfm")).agg(F.array_sort(F.collect_list(F.struct("ord", "name"))).alias("entries"))


def root_description(entries: DataFrame) -> DataFrame:
    """The first package description at the root of each package."""
    return entries.filter("lower(name) rlike '^[^/]+\\\\.nuspec$'").groupBy("path").agg(F.min_by("text", "ord").alias("nuspec"))


def framework_folders(files: DataFrame) -> DataFrame:
    """Folders that hold at least one dll, sorted; ``files`` has a column path."""
    return files.filter("lower(path) like '%.dll'").select(F.regexp_extract("path", r"([^/\\]+)[/\\][^/\\]+$", 1).alias("tfm")).distinct().orderBy("tfm")


def file_stems(files: DataFrame) -> DataFrame:
    stem = F.regexp_extract("path", r"([^/\\]+?)(\.[^./\\]*)?$", 1)
    return files.select(stem.alias("stem")).groupBy(F.lower("stem").alias("key")).agg(F.min("stem").alias("stem"))


def config_paths(folder: str) -> list[str]:
    """Candidate configuration files from a folder upwards."""
    parts = folder.replace("\\", "/").rstrip("/").split("/")
    return ["/".join(parts[:n]) + "/nuget.config" for n in range(len(parts), 0, -1)]
