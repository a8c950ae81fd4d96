"""HTML to elements: Arrow batches through the standard library's parser."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import url as U
from strandline.session import arrow_map

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_DATA = frozenset(("script", "style"))
#: Opening one of these ends an open element of the same group (p in p, li in li ...).
_ENDS = {"p": ("p",), "li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "option": ("option",), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
_BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())


class Elements(HTMLParser):
    """Every element with its own text, in document order: ``(tag, class, own text, link, depth path)``."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[dict] = []
        self.open: list[int] = []

    def handle_starttag(self, tag, attrs):
        named = dict(attrs)
        ends = _ENDS.get(tag, ("p",) if tag in _BLOCKS else ())
        for depth in range(len(self.open) - 1, -1, -1):
            now = self.found[self.open[depth]]["tag"]
            if now in ends:
                del self.open[depth:]
            elif now in ("table", "ul", "ol", "div", "section", "article", "body"):
                break
        self.found.append({"tag": tag, "css": named.get("class"), "text": [], "href": named.get("href") if tag == "a" else None, "meta": None, "up": self.open[-1] if self.open else -1})
        if tag == "meta":
            for kind in ("name", "property"):
                if "description" in (named.get(kind) or "").lower():
                    self.found[-1]["meta"], self.found[-1]["text"] = kind, [named.get("content") or ""]
                    break
        if tag not in _VOID:
            self.open.append(len(self.found) - 1)

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, -1, -1):
            if self.found[self.open[depth]]["tag"] == tag:
                del self.open[depth:]
                break

    def handle_data(self, data):
        if self.open and self.found[self.open[-1]]["tag"] not in _DATA:
            self.found[self.open[-1]]["text"].append(data)


def elements_of(html: str, *, drop_nbsp: bool = True) -> list[tuple[int, str, str | None, str, str | None]]:
    """``(elem_no, tag, css_class, own text, href)``; an element whose own text holds U+00A0 goes with its subtree."""
    parser = Elements()
    parser.feed(html)
    parser.close()
    gone, out = set(), []
    for i, e in enumerate(parser.found):
        text = "".join(e["text"])
        if e["up"] in gone or (drop_nbsp and "\xa0" in text):
            gone.add(i)
            continue
        tag = f"meta-{e['meta']}-description" if e["meta"] else e["tag"]
        out.append((i + 1, tag, e["css"], " ".join(text.split()), e["href"]))
    return out


def own_text(pages: DataFrame, *, drop_nbsp: bool = True) -> DataFrame:
    """``page_id, url, elem_no, tag, css_class, text, href`` from ``page_id, url, html``; a null page has no elements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, html in enumerate(batch["html"].to_pylist()):
                rows = elements_of(html or "", drop_nbsp=drop_nbsp)
                if rows:
                    no, tag, css, text, href = zip(*rows)
                    at = pa.array([i] * len(rows), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [batch["page_id"].take(at), batch["url"].take(at), pa.array(no, pa.int32()), pa.array(tag, pa.string()), pa.array(css, pa.string()), pa.array(text, pa.string()), pa.array(href, pa.string())],
                        ["page_id", "url", "elem_no", "tag", "css_class", "text", "href"],
                    )

    wanted = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return arrow_map(wanted, run, "page_id long, url string, elem_no int, tag string, css_class string, text string, href string")


def render(elements: DataFrame) -> DataFrame:
    """``page_id, url, html`` of ``page_id, url, elem_no, tag, css_class, text, href``: each page's elements in order, one after another.

    An element without a tag becomes a ``div``. What ``own_text`` reads back are the same elements.
    """
    def escaped(c: Column) -> Column:
        return F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))

    tag = F.coalesce("tag", F.lit("div"))
    attributes = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f' {name}="'), escaped(F.col(c)), F.lit('"'))).otherwise("") for name, c in (("class", "css_class"), ("href", "href"))]
    one = F.concat(F.lit("<"), tag, *attributes, F.lit(">"), escaped(F.coalesce("text", F.lit(""))), F.lit("</"), tag, F.lit(">"))
    rows = elements.select("page_id", "url", F.struct("elem_no", one.alias("html")).alias("e"))
    return rows.groupBy("page_id").agg(F.max("url").alias("url"), F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["html"]), "\n").alias("html"))


def page_links(elements: DataFrame, *, clean: bool = True) -> DataFrame:
    """``page_id, url, link``: absolute links of a page's ``a`` elements, cleaned unless told otherwise."""
    links = elements.where("tag = 'a' and href is not null").select("page_id", "url", U.resolve(F.col("url"), F.trim("href")).alias("link"))
    return links.withColumn("link", U.clean_link(F.col("link"))).where("link is not null") if clean else links


def snippet_title(elements: DataFrame, limit: int = 80) -> DataFrame:
    """``page_id, title``: all title texts, each after a space, cut at ``limit``; without any, the URL without ``https://``."""
    rows = elements.groupBy("page_id").agg(F.max("url").alias("url"), F.array_sort(F.collect_list(F.when(F.col("tag") == "title", F.struct("elem_no", F.trim("text").alias("text"))))).alias("t"))
    title = F.aggregate("t", F.lit(""), lambda a, x: F.concat(a, F.lit(" "), x["text"]))
    title = F.when(F.length(title) == 0, F.regexp_replace(F.coalesce("url", F.lit("")), "https://", "")).otherwise(title)
    return rows.select("page_id", F.when(F.length(title) > limit, F.concat(F.substr(title, F.lit(1), F.lit(limit)), F.lit("..."))).otherwise(title).alias("title"))


def snippet_description(elements: DataFrame, limit: int = 300, *, strict: bool = False) -> DataFrame:
    """``page_id, description``: meta descriptions by name, by property, then own texts while there is room.

    The text is cut at ``limit`` when a further piece starts beyond it; what overshoots at the very end
    stays, unless ``strict``. A page gathers the pieces needed to fill the snippet: those that begin within
    the limit and the few after them that decide how it ends.
    """
    stage = F.when(F.col("tag") == "meta-name-description", 0).when(F.col("tag") == "meta-property-description", 1).otherwise(2)
    pieces = elements.select("page_id", F.struct(stage.alias("stage"), "elem_no", F.trim(F.coalesce("text", F.lit(""))).alias("text")).alias("e"))
    size = F.length("e.text")
    earlier = Window.partitionBy("page_id").orderBy("e").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_before", F.coalesce(F.sum(size).over(earlier), F.lit(0)))
    beyond = F.coalesce(F.sum(((F.col("_before") > limit) & (size > 0)).cast("int")).over(earlier), F.lit(0))
    pieces = pieces.withColumn("_beyond", beyond).where("_beyond < 8")
    rows = pieces.groupBy("page_id").agg(F.array_sort(F.collect_list("e")).alias("e"))
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("size"), F.lit(-1).alias("stage"), F.lit(False).alias("done"))

    def step(a: Column, x: Column) -> Column:
        full, opens = a["size"] > limit, x["stage"] != a["stage"]
        skip = a["done"] | (opens & (a["size"] >= limit))
        cut = ~skip & full & ~opens
        return F.struct(
            F.when(skip, a["text"]).when(cut, F.concat(F.substr(a["text"], F.lit(1), F.lit(limit)), F.lit("..."))).otherwise(F.concat(a["text"], F.lit(" "), x["text"])).alias("text"),
            F.when(skip, a["size"]).when(cut, a["size"] + 3).otherwise(a["size"] + F.length(x["text"])).alias("size"),
            x["stage"].alias("stage"),
            (skip | cut).alias("done"),
        )

    text = F.aggregate("e", start, step)["text"]
    return rows.select("page_id", (F.when(F.length(text) > limit + 3, F.concat(F.substr(text, F.lit(1), F.lit(limit)), F.lit("..."))).otherwise(text) if strict else text).alias("description"))
