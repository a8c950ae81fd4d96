"""URLs: parts, canonical keys, cleaned links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of a URL that say nothing about its content.
IGNORED_PARTS = ("https:", "http:", "com", "edu", "it", "uk", "net", "gov", "org", "www")


def url_hash(url: Column) -> Column:
    return F.sha1(url)


def parse(url: Column) -> Column:
    """``struct<protocol, host, port, path>``; all null for a URL that is short, of another protocol or without host.

    The default path is ``/``; the port is 80 unless a valid one is given, for https too.
    """
    clean = F.trim(url)
    good = (F.length(clean) >= 8) & F.regexp_like(clean, F.lit("^https?://[^/]"))
    address = F.regexp_extract(clean, "^https?://([^/]*)", 1)
    path = F.regexp_extract(clean, "(?s)^https?://[^/]*(/.*)$", 1)
    port = F.trim(F.regexp_extract(address, "^[^:]*:(.*)$", 1)).try_cast("int")
    return F.struct(
        F.when(good, F.regexp_extract(clean, "^(https?)://", 1)).alias("protocol"),
        F.when(good, F.trim(F.split(address, ":")[0])).alias("host"),
        F.when(good, F.coalesce(port, F.lit(80))).alias("port"),
        F.when(good, F.when(path == "", "/").otherwise(path)).alias("path"),
    )


def host(url: Column) -> Column:
    return parse(url)["host"]


def canonical(url: Column) -> Column:
    """The URL without its scheme and one trailing slash: the same page over http and https."""
    return F.regexp_replace(F.regexp_replace(url, "^https?", ""), "/$", "")


def clean_link(link: Column) -> Column:
    """A link cut at ``#``, then at ``?``; null for mail addresses."""
    return F.when(~F.startswith(F.trim(link), F.lit("mailto")), F.substring_index(F.substring_index(F.trim(link), "#", 1), "?", 1))


def clean_links(links: Column) -> Column:
    """The cleaned links of an array, in order, mail addresses and nulls left out."""
    return F.filter(F.transform(links, clean_link), lambda x: x.isNotNull())


def resolve(base: Column, link: Column) -> Column:
    """An absolute URL from a link on the page ``base``."""
    root = F.regexp_extract(base, "^(https?://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_replace(F.regexp_replace(base, "[?#].*$", ""), "^(https?://[^/]*)$", "$1/"), "[^/]*$", "")
    return (
        F.when(F.regexp_like(link, F.lit("^[a-zA-Z][a-zA-Z0-9+.-]*:")), link)
        .when(F.startswith(link, F.lit("//")), F.concat(F.regexp_extract(base, "^(https?:)", 1), link))
        .when(F.startswith(link, F.lit("/")), F.concat(root, link))
        .otherwise(F.concat(folder, link))
    )


def parts(url: Column) -> Column:
    """The pieces of a URL between ``//``, ``/`` and ``.`` that may say what it is about; empty ones at the end are no pieces."""
    pieces = F.split(F.regexp_replace(url, r"[/.]+$", ""), r"(//)|(/)|(\.)")
    return F.filter(pieces, lambda p: ~p.isin(*IGNORED_PARTS))
