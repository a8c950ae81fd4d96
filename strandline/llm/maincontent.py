"""The main body of web pages: containers scored per page, tag-class paths voted on per host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.skew import salted
from strandline.session import cut

HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Elements that are controls or lead elsewhere.
LINKS = ("a", "button", "nav", "form", "input", "option", "select", "label")
#: Elements that pages use for content alone, short and alike as their texts may be.
CONTENT = ("td", "th", "figcaption", "blockquote", "pre", "dd", "dt")
_WIDE = r"\t-\r\x{85}\x{a0}\x{2000}-\x{200b}\x{3000}"
#: White space that isn't a single space already.
_SPACE = rf"(?![!-~])(?:[ {_WIDE}]{{2,}}|[{_WIDE}])"
_NUMBER = r"[0-9](?:[0-9]|[.,](?=[0-9]))*"
_NAME_INSIDE = r"(?<=\S )\p{Lu}[\p{L}\p{M}’'-]*"


def _host(url: Column) -> Column:
    """The host of a URL; usual ones are cut without a pattern."""
    low = F.lower(url)
    start = F.when(F.startswith(low, F.lit("http://")), 8).when(F.startswith(low, F.lit("https://")), 9)
    plain = F.substr(low, start, F.length(low))
    for end in "/?#":
        plain = F.substring_index(plain, end, 1)
    return F.when(start.isNotNull(), plain).otherwise(F.regexp_extract(low, r"^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)", 1))


def _spaced(text: Column) -> Column:
    """Trimmed text, each run of white space one space; the pattern is spared where plain look-ups find nothing for it."""
    inner = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    odd = F.octet_length(inner) > F.length(inner)
    for run in ("  ", "\t", "\n", "\x0b", "\f", "\r"):
        odd = odd | F.contains(inner, F.lit(run))
    return F.when(odd, F.trim(F.regexp_replace(inner, _SPACE, " "))).otherwise(inner)


def _features(elements: DataFrame) -> DataFrame:
    """One row per (page_id, elem_no); texts, templates, labels, hosts and classes as 64-bit hashes.

    A title keeps its text, with whose beginning headings are compared.
    """
    rows = elements.where("page_id is not null and elem_no is not null").select("page_id", "elem_no", F.struct("text", "tag", "css_class", "url").alias("e"))
    rows = rows.groupBy("page_id", "elem_no").agg(F.max("e").alias("e")).select("page_id", "elem_no", "e.*")
    text = _spaced(F.coalesce("text", F.lit("")))
    rows = rows.select("page_id", "elem_no", F.coalesce(F.lower("tag"), F.when(F.col("elem_no") == 1, "title")).alias("tag"), F.coalesce(F.regexp_replace(F.lower("css_class"), "[0-9]+", "0"), F.lit("")).alias("class"), _host(F.coalesce("url", F.lit(""))).alias("host"), text.alias("text")).where("text <> ''")
    name = F.initcap(F.substring_index(F.when(F.startswith("host", F.lit("www.")), F.substr("host", F.lit(5), F.length("host"))).otherwise(F.col("host")), ".", 1))
    plain = F.regexp_replace(F.when(F.length(name) > 2, F.replace("text", name, F.lit("§"))).otherwise(F.col("text")), _NUMBER, "0")
    heading = F.coalesce(F.col("tag").isin(*HEADINGS), F.lit(False))
    template = F.lower(F.when(heading, plain).otherwise(F.regexp_replace(plain, _NAME_INSIDE, "¤")))
    label = F.when(F.contains("text", F.lit(": ")), F.regexp_extract("text", r"^([^\s:]++(?: [^\s:]++){0,3}): ", 1)).otherwise("")
    return rows.select(
        "page_id", "elem_no", "tag", heading.alias("heading"), F.xxhash64("class").alias("class"), F.xxhash64("host").alias("host"), F.xxhash64("text").alias("text_h"),
        F.xxhash64(template).alias("template"), F.when(label != "", F.xxhash64(label)).alias("label"), F.length("text").alias("n_chars"), F.when(F.col("tag") == "title", F.col("text")).alias("title"),
        (F.col("tag").isNull() & (plain == "0")).alias("bare"),
    )


def _page_heads(rows: DataFrame) -> DataFrame:
    """``page_id, head, n_rows``: where the page's own heading stands - the first element with the text that starts its title."""
    titles = rows.where("title is not null").groupBy("page_id").agg(F.max("title").alias("title"))
    near = rows.where(F.coalesce(~F.col("tag").isin("title", "li", *LINKS), F.lit(True)) & F.col("heading")).select("page_id", "elem_no", "tag", "text_h", "n_chars", F.lit(True).alias("h"))
    other = rows.where(F.coalesce(~F.col("tag").isin("title", "li", *LINKS), F.lit(True)) & ~F.col("heading")).select("page_id", "elem_no", "tag", "text_h", "n_chars", F.lit(False).alias("h"))
    known = near.unionByName(other).join(titles, "page_id", "left")
    # a heading is half of the title or more, so comparing costs no more than reading the element
    size, whole = F.col("n_chars"), F.length("title")
    fits = (size <= whole) & (size >= whole / 2 - 12) & F.substr("title", size + 1, F.lit(1)).isin("", " ")
    match = F.coalesce(F.when(fits, F.xxhash64(F.substr("title", F.lit(1), size)) == F.col("text_h")), F.lit(False))
    score = F.when(match & F.col("h"), 0).when(match, 1).when(F.col("tag") == "h1", 2).when(F.col("h"), 3)
    heads = known.withColumn("score", score).where("score is not null").groupBy("page_id").agg(F.min(F.struct("score", "elem_no")).alias("h")).select("page_id", F.col("h.elem_no").alias("head"))
    return rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_rows")).join(heads, "page_id", "left")


#: Facts of up to so many rows - a few numbers each, so 32 MB at most - are broadcast; larger tables are joined on salted keys.
BROADCAST_ROWS = 400_000


def _looked_up(rows: DataFrame, facts: DataFrame, key: str, total: int, spread: list[str] = ["page_id", "elem_no"]) -> DataFrame:
    """``rows`` left joined with ``facts`` (one row per ``key``, ``n_rows`` of it), which are written and counted first; hot keys are salted."""
    stored = cut(facts)
    if stored.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(stored.drop("n_rows")), key, "left")
    left, right = salted(rows, stored, key, spread, total=total)
    return left.join(right.drop("n_rows"), [key, "_salt"], "left").drop("_salt")


def main_elements(elements: DataFrame, *, least_pages: int = 3, host_share: float = 0.02, least_anywhere: int = 5, carrier_share: float = 0.06, share: float = 0.0025, resumes: float = 0.25, wins: float = 0.3) -> DataFrame:
    """``page_id, elem_no`` of the elements that make up the main body of each page.

    Texts are generalised to templates (numbers, names and the host's own name left out). A template
    that ``least_pages`` and ``host_share`` of a host's pages carry is boilerplate there. So is, on hosts with too
    few of it, one on ``least_anywhere`` pages that make up ``carrier_share`` of the pages of the hosts that
    have it, or ``share`` of all pages: shares, so that a page gets the same answer in a large corpus as
    in a small one of the same kind (README has figures). The corpus votes on
    what a boilerplate template does to an article: one after which content rarely resumes ends it
    (sharing, comments, teasers, footers), others are inserts (adverts). From its heading to
    the first such end, a page scores its containers - elements of one tag-class path - by their
    text; the scores are votes of its host on that path, and pages are re-extracted with winning paths.
    Elements without a tag take the tag their template usually has on the host, bare numbers that of
    their class, and a page's element 1 is its title.

    ``elements``: ``page_id, url, elem_no, tag, css_class, text``. Null page or number: ignored. Null
    or empty text is never content. Repeated rows count once (of differing ones the largest). A page
    without title and heading has no main body. Extra columns are ignored; an empty table gives an
    empty result. Pages, hosts and templates of any size are spread: all steps aggregate or use
    salted look-ups.
    """
    rows = cut(_features(elements))
    total = rows.count()
    pages = cut(_page_heads(rows))
    n_pages = pages.count()

    # how common each template is, on its host and anywhere, and the tag it has there
    once = rows.groupBy("host", "template", "page_id").agg(F.max("tag").alias("tag"))
    here = cut(once.groupBy("host", "template").agg(F.count(F.lit(1)).alias("n_here"), F.mode("tag", True).alias("usual")))
    hosts = rows.select("host", "page_id").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    hosts = hosts.join(here.groupBy("host").agg(F.count(F.lit(1)).alias("n_rows")), "host")
    n_here = here.count()
    here = cut(_looked_up(here, hosts, "host", n_here, ["template"]))
    anywhere = here.groupBy("template").agg(F.sum("n_here").alias("n_all"), F.sum("host_pages").alias("all_pages"), F.count(F.lit(1)).alias("n_rows"))
    facts = _looked_up(here, anywhere, "template", n_here, ["host"])
    common = ((F.col("n_here") >= least_pages) & (F.col("n_here") >= host_share * F.col("host_pages"))) | ((F.col("n_all") >= least_anywhere) & ((F.col("n_all") >= carrier_share * F.col("all_pages")) | (F.col("n_all") >= share * n_pages)))
    facts = facts.select(F.xxhash64("host", "template").alias("_k"), common.alias("common"), F.when(F.col("n_all") >= least_pages, F.col("usual")).alias("usual"), F.col("n_here").alias("n_rows"))
    # a bare number without a tag may be a cell or a page number: its class tells, its template doesn't
    by_class = F.xxhash64("host", "class", F.lit("class"))
    classes = rows.where(F.col("class") != F.xxhash64(F.lit(""))).groupBy("host", "class").agg(F.mode("tag", True).alias("usual"), F.sum(F.col("bare").cast("long")).alias("n_rows")).where("n_rows > 0")
    facts = facts.unionByName(classes.select(by_class.alias("_k"), F.lit(False).alias("common"), "usual", "n_rows"))
    key = F.when(F.col("bare"), by_class).otherwise(F.xxhash64("host", "template"))
    known = _looked_up(rows.withColumn("_k", key).drop("text_h", "title", "heading", "bare"), facts, "_k", total).drop("_k")
    known = known.withColumn("tag", F.coalesce("tag", "usual", F.lit(""))).drop("usual")
    link, content = F.col("tag").isin(*LINKS), F.col("tag").isin(*CONTENT)
    known = known.withColumn("common", F.coalesce("common", F.lit(False)) & ~content)
    known = cut(_looked_up(known, pages, "page_id", total).where("head is not null"))

    # which common templates end an article
    strong = ~F.col("common") & ~link & (F.col("elem_no") > F.col("head")) & (content | (F.col("n_chars") >= 140))
    last = known.where(strong).groupBy("page_id").agg(F.max("elem_no").alias("last_strong"), F.count(F.lit(1)).alias("n_rows"))
    after = cut(_looked_up(known.where(F.col("common") & (F.col("elem_no") > F.col("head"))).select("page_id", "elem_no", "template"), last, "page_id", total))
    ends = after.groupBy("template").agg(F.avg((F.col("elem_no") < F.coalesce("last_strong", F.lit(-1))).cast("double")).alias("resumed"), F.count(F.lit(1)).alias("n_rows"))
    stops = _looked_up(after.drop("last_strong"), ends, "template", total).where(F.col("resumed") < resumes).groupBy("page_id").agg(F.min("elem_no").alias("stop"), F.count(F.lit(1)).alias("n_rows"))
    labels = known.where(link & F.col("label").isNotNull()).groupBy("label").agg(F.count_distinct("page_id").alias("n"), F.count(F.lit(1)).alias("n_rows"))
    labels = labels.where(F.col("n") >= least_pages).select("label", "n_rows", F.lit(True).alias("leads_away"))
    judged = _looked_up(_looked_up(known, stops, "page_id", total), labels, "label", total)
    inside = (F.col("elem_no") >= F.col("head")) & (F.col("elem_no") < F.coalesce("stop", F.lit(2**31 - 1)))
    inside = inside & (F.col("tag") != "title") & F.col("leads_away").isNull() & ~link
    own = F.col("elem_no") == F.col("head")
    judged = cut(judged.select("page_id", "elem_no", F.xxhash64("host", "tag", "class").alias("path"), (F.col("tag") == "title").alias("title"), inside.alias("inside"), F.when(F.col("common") & ~own, 0).otherwise(F.col("n_chars")).alias("mass")))

    # containers' scores, the host's vote on their paths, extraction with the winners
    containers = judged.where("not title").groupBy("path", "page_id").agg(F.sum(F.when(F.col("inside"), F.col("mass")).otherwise(0)).alias("good"), F.sum("mass").alias("all"), F.count(F.lit(1)).alias("n"))
    votes = containers.groupBy("path").agg(F.sum("good").alias("good"), F.sum("all").alias("all"), F.sum("n").alias("n_rows"))
    winners = votes.where((F.col("good") > 0) & (F.col("good") >= wins * F.col("all"))).select("path", "n_rows", F.lit(True).alias("won"))
    return _looked_up(judged.where("inside and mass > 0"), winners, "path", total).where("won").select("page_id", "elem_no")


def main_text(elements: DataFrame, body: DataFrame) -> DataFrame:
    """``page_id, url, text``: each page's main body, elements joined by line breaks in document order."""
    rows = elements.join(body, ["page_id", "elem_no"], "left_semi").groupBy("page_id", "elem_no").agg(F.max("text").alias("text"), F.max("url").alias("url"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("elem_no", "text"))), lambda e: F.trim(e["text"]))
    return rows.groupBy("page_id").agg(F.max("url").alias("url"), F.array_join(ordered, "\n").alias("text"))
