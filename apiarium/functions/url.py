"""Source links: rewriting, query parameters, prefixes. All Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_anchor(url: Column) -> Column:
    return F.split_part(url, F.lit("#"), F.lit(1))


def query_parameter(query: Column, key: str) -> Column:
    """First value of the key in a query string, case ignored, not decoded; null if absent."""
    pattern = f"(?i)(?:^|[?&]){key}=([^&#]*)"
    return F.when(query.rlike(pattern), F.regexp_extract(query, pattern, 1))


def ensure_trailing_slash(s: Column) -> Column:
    return F.when(s.endswith("/"), s).otherwise(F.concat(s, F.lit("/")))


def posix_path(s: Column) -> Column:
    return F.translate(s, "\\", "/")


def wildcard_url(prefix: Column, suffix: Column) -> Column:
    """Prefix and suffix with slashes of one kind."""
    return F.concat(prefix, posix_path(suffix))


def with_line(url: Column, line: Column) -> Column:
    return F.when(line > 0, F.concat(url, F.lit("#L"), line.cast("string"))).otherwise(url)


def blob_url(url: Column, line: Column) -> Column:
    """The page that shows a raw file, at a line, of the host that is recognised first; else the url with an anchor."""
    anchor = F.when(line > 0, F.concat(F.lit("#L"), line.cast("string"))).otherwise(F.lit(""))
    github = r"(?i)^https://raw\.githubusercontent\.com/([^/]+)/([^/]+)/([^/]+)/(.+)$"
    gitlab = r"(?i)^(https://[^/]*gitlab[^/]*/.+)/-/raw/(.+)$"
    bitbucket = r"(?i)^https://api\.bitbucket\.org/2\.0/repositories/([^/]+)/([^/]+)/src/([^/]+)/(.+)$"
    azure = r"(?i)^https://dev\.azure\.com/([^/]+)/([^/]+)/_apis/git/repositories/([^/]+)/items\?(.+)$"
    lines = F.when(line > 0, F.concat(F.lit("#lines-"), line.cast("string"))).otherwise(F.lit(""))
    commit = F.coalesce(query_parameter(url, "versionDescriptor.version".replace(".", r"\.")), query_parameter(url, "version"))
    at = F.when(line > 0, F.concat(F.lit("&line="), line.cast("string"))).otherwise(F.lit(""))
    return (
        F.when(url.rlike(github), F.concat(F.regexp_replace(url, github, "https://github.com/$1/$2/blob/$3/$4"), anchor))
        .when(url.rlike(gitlab), F.concat(F.regexp_replace(url, gitlab, "$1/-/blob/$2"), anchor))
        .when(url.rlike(bitbucket), F.concat(F.regexp_replace(url, bitbucket, "https://bitbucket.org/$1/$2/src/$3/$4"), lines))
        .when(url.rlike(azure) & query_parameter(url, "path").isNotNull() & commit.isNotNull(), F.concat(F.regexp_replace(url, azure, "https://dev.azure.com/$1/$2/_git/$3?path="), query_parameter(url, "path"), F.lit("&version=GC"), commit, at))
        .otherwise(with_line(url, line))
    )


def owner_search(base: Column, owner: Column, skip: Column, take: int = 100) -> Column:
    """One page of a search for an owner's packages."""
    escaped = F.replace(F.url_encode(owner), F.lit("+"), F.lit("%20"))
    return F.concat(base, F.lit("?q=owner:"), escaped, F.lit("&skip="), skip.cast("string"), F.lit(f"&take={take}"))


def learn_link(root: str, uid: Column) -> Column:
    """Documentation address of a framework symbol: lower-cased, arity marked by a hyphen."""
    return F.concat(F.lit(root), F.lower(F.translate(F.regexp_replace(uid, "^.:", ""), "`", "-")))


def link(uid: Column, name: Column, emitted: Column, bcl_root: str) -> Column:
    """Reference markup: an autoref inside the emitted set, a documentation link for framework types, else code."""
    bare = F.regexp_replace(uid, "^.:", "")
    code = F.concat(F.lit("`"), name, F.lit("`"))
    return (
        F.when((uid == "") | uid.startswith("!:"), code)
        .when(emitted, F.concat(F.lit("["), name, F.lit("]["), uid, F.lit("]")))
        .when(bare.startswith("System.") | (bare == "System"), F.concat(F.lit("["), name, F.lit("]("), learn_link(bcl_root, uid), F.lit(")")))
        .otherwise(code)
    )


def xref(uid: Column, name: Column) -> Column:
    return F.when((uid == "") | uid.startswith("!:"), F.concat(F.lit("`"), name, F.lit("`"))).otherwise(F.concat(F.lit("<xref:"), F.url_encode(F.regexp_replace(uid, "^.:", "")), F.lit(">")))
