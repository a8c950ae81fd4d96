"""The search engine's operators on the worked examples."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from strandline.functions import html as H
from strandline.functions import text as T
from strandline.functions import url as U
from strandline.operators import crawl, dataflow, graph, index, jobs, search
from strandline.sources import files

#: The link example that the worked results below belong to.
INTERNET = """U-haul -> USPS, UPS, Go Puff, Google
USPS -> Go Puff, U-haul, UPS, Google
Google -> Amazon, Facebook, LinkedIn
Amazon -> Snapchat, Ford, GE, Microsoft, Google
Boeing -> Lockheed, Schlumberger, Honeywell
NYTimes -> Washington Post, New Yorker, Times, PlayBoy
facebook -> twitter, ebay, SpaceX, Google
Tesla -> Toyota, Subaru, Ford, Honda
Chevron -> Shell, Twillio, OneSubSea, Google
Times -> Washington Post, New Yorker, PlayBoy
Go Puff -> U-haul, Caviar, USPS, UPS, Google"""


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.fixture(scope="module")
def links(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("links")
    lines = INTERNET.split("\n")
    (folder / "internet.txt.0").write_text("\n".join(lines[:7]) + "\n")
    (folder / "internet.txt.1").write_text("\n".join(lines[7:]))
    rows = files.read_links(spark, f"{folder}/internet.txt.*")
    return graph.edges_of(rows.select("src", F.explode("dsts").alias("dst"))).cache()


def test_graph_build(links):
    repaired = graph.repair(links)
    assert (links.count(), graph.dangling(links).count(), repaired.count()) == (43, 23, 95)
    ups = {r["dst"] for r in repaired.where("src = 'UPS'").collect()}
    assert ups == {"UPS", "U-haul", "USPS", "Go Puff"}
    assert graph.start_ranks(links).count() == 34
    assert graph.adjacency(links).where("src = 'Google'").first()["neighbors"] == ["Amazon", "Facebook", "LinkedIn"]


@pytest.mark.parametrize(
    ("steps", "power", "want", "total"),
    [
        (1, 3, {"Google": 147.54, "Amazon": 133.2104, "UPS": 58.4919}, 2093.125),
        (1, 1, {"Google": 204.15, "Amazon": 184.3167, "UPS": 80.9}, 2895.1),
        (3, 1, {"Google": 167.7901, "Amazon": 149.9784, "UPS": 45.0779}, 2101.1447),
        (15, 1, {"Amazon": 35.7810, "Google": 30.3689, "Tesla": 18.7342, "UPS": 1.6418}, 328.0343),
    ],
)
def test_pagerank(links, steps, power, want, total):
    got = {r["id"]: r["rank"] for r in graph.pagerank(graph.repair(links), iterations=steps, damping_power=power).collect()}
    assert sum(got.values()) == pytest.approx(total, abs=1e-3)
    assert {k: round(got[k], 4) for k in want} == pytest.approx(want, abs=1e-4)


def test_malformed_link_line_raises(spark):
    with pytest.raises(Exception, match="malformed"):
        files.links_of_lines(spark.createDataFrame([("a b",)], "value string")).collect()


def test_tokens(spark):
    words = ["apple", "iphone7", "at&t", "san-francisco", "a", "2014", "-lrb-", "the", "foo!bar"]
    df = spark.createDataFrame([(" ".join(words),)], "text string")
    assert [r["token"] for r in T.token_rows(df, [], "text").collect()] == words[:4]
    assert len(T.STOP_WORDS) in (205, 206) and len(set(T.STOP_WORDS)) == 205


def test_ngrams_break_at_other_words(spark):
    df = spark.createDataFrame([(1, ["new", "york", "city", "", "hall"]), (2, ["new"]), (3, []), (4, None)], "doc int, words array<string>")
    assert [(r["doc"], r["pos"], r["ngram"]) for r in T.ngram_rows(df, ["doc"], "words", 2).orderBy("pos").collect()] == [(1, 0, "new york"), (1, 1, "york city")]
    assert [r["ngram"] for r in T.ngram_rows(df, ["doc"], "words", 3).collect()] == ["new york city"]
    known = spark.createDataFrame([("york city",)], "ngram string")
    assert [r["ngram"] for r in T.dictionary_ngrams(df, ["doc"], "words", known, 2).collect()] == ["york city"]
    assert T.query_terms("New York City the hall", {"new york", "new york city"}) == ["new york", "new york city", "new", "york", "city", "hall"]
    assert T.query_terms("_foo_ (bar!) -lrb- ", set()) == ["foo", "bar"] and T.query_terms("", set()) == []


def test_query_words_are_cleaned_as_indexed_ones(spark):
    text = "The “Quick” brown_fox -lrb- jumps_ over; (it's) 42 a.b@c & San-Francisco!"
    indexed = [r["token"] for r in T.token_rows(spark.createDataFrame([(text,)], "t string"), [], "t").orderBy("pos").collect()]
    assert T.query_terms(text, set()) == list(dict.fromkeys(indexed))


LEMMAS = "studies study boxes box classes class cats cat bus bus glass glass running run stopped stop making make creating create falling fall studied study watched watch used use was be children child walking walk measuring measure churches church sing sing bed bed news news analysis analysis changing change baked bake at&t at&t 2nd 2nd".split()


def test_lemmas(spark):
    pairs = list(zip(LEMMAS[::2], LEMMAS[1::2]))
    got = spark.createDataFrame(pairs, "w string, want string").withColumn("got", T.lemma(F.col("w")))
    assert [tuple(r) for r in got.where("want <> got").collect()] == []
    upper = T.lemmatiser(lambda words: words.str.upper())
    assert [r["x"] for r in got.select(upper("w").alias("x")).limit(1).collect()] == ["STUDIES"]


def test_term_frequency_and_title_flag(spark):
    df = spark.createDataFrame([(1, 1, "title", "Apple"), (1, 2, "p", "apple tree apple"), (2, 1, None, None)], "page_id int, elem_no int, tag string, text string")
    got = {r["term"]: (r["tf"], r["is_title"]) for r in index.term_frequency(index.page_terms(df)).collect()}
    assert got == {"apple": (1.0, True), "tree": (0.33333, False)}


def test_idf_and_shards(spark):
    df = spark.createDataFrame([("x", 9), ("y", 7)], "word string, df long")
    assert {r["word"]: r["idf"] for r in index.inverse_frequency(df, 242938).collect()} == {"x": 4.431253, "y": 4.540397}
    words = ["apple", "company", "dog", "9to5", "Apple", "zoo", "é"]
    got = {w: (value(spark, index.bucket(F.lit(w))), value(spark, index.shard(F.lit(w)))) for w in words}
    assert got == {"apple": (1, 0), "company": (3, 0), "dog": (4, 1), "9to5": (0, 0), "Apple": (0, 0), "zoo": (26, 4), "é": (137, -1)}
    own = spark.range(5).select(F.col("id").alias("shard"))
    alive = {n: {r["shard"]: r["owner"] for r in index.shard_owner(own, spark.createDataFrame([(w,) for w in n], "worker int"), 5).collect()} for n in ((0, 1, 2, 3), (0, 2, 3, 4))}
    assert alive[(0, 1, 2, 3)][4] == 0 and alive[(0, 2, 3, 4)][1] == 2


def test_positions_over_buckets(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 700, "hot").otherwise("b").alias("word"), F.format_string("%04d", "id").alias("doc"))
    got = index.positions(df, "word", ["doc"], F.substr("doc", F.lit(1), F.lit(2)))
    assert got.where("word = 'hot' and seq <> cast(doc as int) + 1").count() == 0


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([("apple", "http://www.apple.com/", 0.25, True), ("company", "https://www.apple.com", 0.10, False)], ("http://www.apple.com/", 60.475)),
        ([("apple", "https://en.wikipedia.org/wiki/Apple_Inc", 0.2765, False)], ("https://en.wikipedia.org/wiki/Apple_Inc", 2.765)),
        ([("apple", "https://x.com/apple/a", 1.0, False)], ("https://x.com/apple/a", 21.5)),
    ],
)
def test_ranking(spark, rows, want):
    got = search.ranked(spark.createDataFrame(rows, "word string, url string, weight double, is_title boolean"), []).collect()
    assert [(r["url"], round(r["score"], 6)) for r in got] == [want]


def test_bonus_counts_words_as_merged(spark):
    words = value(spark, search.counted_words(F.array(F.lit("a"), F.lit("b"), F.lit("c d"))))
    assert words == ["a", "b", "b", "c", "d", "c d"]


def test_tiers_and_paging(spark):
    rows = [("A", "x", 0.1), ("A", "y", 0.2), ("B", "x", 0.9), ("C", "x", 0.2), ("C", "y", 0.3)]
    df = spark.createDataFrame(rows, "url_hash string, word string, weight double")
    got = search.tiered(df, 2).orderBy("tier", F.desc("rank")).collect()
    assert [r["url_hash"] for r in got] == ["C", "A", "B"]
    assert search.tiered(df, 2, min_full=2).count() == 2
    assert {r["url_hash"] for r in search.all_terms(df, 2).collect()} == {"A", "C"}
    hits = spark.range(23).select(F.col("id").cast("string").alias("url"), F.col("id").cast("double").alias("score"))
    assert search.page(hits, [F.desc("score")], start=20).count() == 3
    words = spark.createDataFrame([("Java",), ("JavaScript",), ("Ruby",)], "word string")
    assert {r["word"] for r in search.complete(words, "jav").collect()} == {"Java", "JavaScript"}


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("http://h.com", ("http", "h.com", 80, "/")),
        ("https://h.com:8443/a?b", ("https", "h.com", 8443, "/a?b")),
        ("https://h.com/", ("https", "h.com", 80, "/")),
        ("http://h.com:x/", ("http", "h.com", 80, "/")),
        ("ftp://h", (None, None, None, None)),
        ("http://", (None, None, None, None)),
    ],
)
def test_url_parse(spark, url, want):
    assert tuple(value(spark, U.parse(F.lit(url)))) == want


def test_links_and_own_text(spark):
    page = "<html><head><title>T\n x</title><meta name='Description' content='about'><script>var a='<p>no</p>'</script></head><body>a<p>one<p>two <b>bold</b> end<div>gone\xa0<i>too</i></div><a href='/r?x=1#y'>r</a><a href='mailto:x@y'>m</a>"
    df = spark.createDataFrame([(1, "http://h/d/p", page), (2, "http://g/", None)], "page_id long, url string, html string")
    rows = H.own_text(df).orderBy("elem_no").collect()
    got = [(r["tag"], r["text"]) for r in rows if r["text"]]
    assert got == [("title", "T x"), ("meta-name-description", "about"), ("body", "a"), ("p", "one"), ("p", "two end"), ("b", "bold"), ("a", "r"), ("a", "m")]
    assert [r["link"] for r in H.page_links(H.own_text(df)).collect()] == ["http://h/r"]
    assert value(spark, U.clean_links(F.array(F.lit("http://h/a?x=1#y"), F.lit("mailto:x@y")))) == ["http://h/a"]
    assert H.snippet_description(H.own_text(df)).first()["description"].split() == ["about", "T", "x", "a", "one", "two", "end", "bold", "r", "m"]


def test_snippets(spark):
    schema = "page_id int, url string, elem_no int, tag string, text string"
    df = spark.createDataFrame([(1, "https://h/a", 1, "title", "t" * 80), (2, "https://h/a", 1, "p", "x"), (3, "http://h/a", 1, "p", "x")], schema)
    got = {r["page_id"]: r["title"] for r in H.snippet_title(df).collect()}
    assert got == {1: " " + "t" * 79 + "...", 2: "h/a", 3: "http://h/a"}
    long = spark.createDataFrame([(1, "u", i, "p", "w" * 100) for i in range(1, 6)] + [(2, "u", 1, "p", "z" * 500)], schema)
    got = {r["page_id"]: r["description"] for r in H.snippet_description(long).collect()}
    assert len(got[1]) == 303 and got[1].endswith("...") and len(got[2]) == 501
    assert {r["page_id"]: len(r["description"]) for r in H.snippet_description(long, strict=True).collect()} == {1: 303, 2: 303}


def test_robots(spark):
    text = "user-agent: *\ndisallow: /private/\ndisallow: /x\nallow: /private/ok/\ncrawl-delay: 7\nuser-agent: other\ndisallow: /z"
    own = text + "\nUser-Agent: mybot\nDisallow: /only\nCrawl-delay: soon"
    df = spark.createDataFrame([("h", text), ("g", own), ("e", None)], "host string, text string")
    rules = crawl.parse_robots(df, "MyBot")
    got = {r["host"]: (r["allow"], r["disallow"], r["crawl_delay"]) for r in rules.collect()}
    assert got == {"h": (["/private/ok/"], ["/private/", "/x"], 7), "g": ([], ["/only"], 0), "e": ([], [], 0)}
    paths = {"/private/a": False, "/private/": True, "/x": False, "/x1": True, "/private/ok/1": True, "/a/private/b": False}
    urls = spark.createDataFrame([(f"http://h{p}",) for p in paths] + [("http://wikis/a",), ("nothing",)], "url string")
    ok = {r["url"]: r["allowed"] for r in crawl.check_robots(urls, rules).collect()}
    assert ok == {f"http://h{p}": v for p, v in paths.items()} | {"http://wikis/a": False, "nothing": False}
    busy = spark.createDataFrame([("h", 101)], "host string, n long")
    assert not any(r["allowed"] for r in crawl.check_robots(urls, rules, busy).where("url like 'http://h/%'").collect())


def test_crawl_delay(spark):
    t0 = dt.datetime(2022, 1, 1)
    rows = [("h", t0 + dt.timedelta(seconds=s)) for s in (0, 4, 10, 15, 21)] + [("free", t0), ("free", t0), (None, t0)]
    got = crawl.crawl_delay(spark.createDataFrame(rows, "host string, ts timestamp"), spark.createDataFrame([("h", 10), ("free", 0)], "host string, crawl_delay int"))
    assert [r["accepted"] for r in got.where("host = 'h'").orderBy("ts").collect()] == [True, False, True, False, True]
    assert all(r["accepted"] for r in got.where("host is null or host = 'free'").collect())


def test_crawl_filters(spark):
    pages = spark.createDataFrame([("a", "text/html; x", 10), ("b", "image/svg+xml", 10), ("c", None, 1), ("d", "text/html", 3_000_000)], "url string, type string, length long")
    assert {r["url"] for r in crawl.content_filter(pages, 1).collect()} == {"a", "b"}
    now = dt.datetime(2022, 1, 1, 0, 1, 40)
    beats = spark.createDataFrame([("x", dt.datetime(2022, 1, 1, 0, 1, 25)), ("y", dt.datetime(2022, 1, 1, 0, 1, 24, 900000))], "worker string, ts timestamp")
    assert [r["worker"] for r in crawl.live_workers(beats, F.lit(now)).collect()] == ["x"]
    queue = spark.createDataFrame([(i, f"u{i}") for i in range(10)], "seq long, url string")
    head, rest = crawl.poll(queue, 4)
    assert ({r["seq"] for r in head.collect()}, rest.count()) == ({0, 1, 2, 3}, 6)


def test_crawl_rounds(spark):
    pages = spark.createDataFrame([("a", ["b", "x"]), ("b", ["a", "c"]), ("c", []), ("d", [])], "url string, links array<string>")
    got = crawl.crawl(pages, spark.createDataFrame([("a",)], "url string"), lambda p: p.select(F.explode("links").alias("link")), lambda u: u)
    assert {(r["url"], r["round"]) for r in got.collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_crawl_goes_on_to_its_end(spark):
    pages = spark.createDataFrame([(f"p{i}", [f"p{i + 1}"]) for i in range(23)], "url string, links array<string>")
    seeds, links_of = spark.createDataFrame([("p0",)], "url string"), lambda p: p.select(F.explode("links").alias("link"))
    assert crawl.crawl(pages, seeds, links_of, lambda u: u).agg(F.max("round"), F.count("url")).first() == (22, 23)
    short = pages.where("url in ('p0', 'p1', 'p2')")
    assert crawl.crawl(short, seeds, links_of, lambda u: u, max_rounds=2).count() == 3
    with pytest.raises(RuntimeError):
        crawl.crawl(short, seeds, links_of, lambda u: u, max_rounds=1)


def test_jobs_and_groupings(spark):
    pairs = spark.createDataFrame([("1", "a"), ("2", "a"), ("3", "b"), ("4", None)], "key string, value string")
    assert {(r["key"], r["value"]) for r in jobs.run_job(pairs, jobs.WordCountJob()).collect()} == {("a", "2"), ("b", "1")}
    lines = spark.createDataFrame([("apple->http://d:1:0.5->[apple, tree]",)], "value string")
    assert tuple(jobs.rekey_documents(lines).first()) == ("http://d:1", "apple", 0.5, ["apple", "tree"])
    urls = spark.createDataFrame([(f"http://h{i % 3}/p{i}",) for i in range(30)], "url string")
    parts = dataflow.fields_grouping(urls, 4, "url").select(U.host(F.col("url")).alias("h"), F.spark_partition_id().alias("p")).distinct()
    assert parts.count() == 3 and dataflow.first_grouping(urls).rdd.getNumPartitions() == 1
    with pytest.raises(ValueError, match="no such field"):
        dataflow.fields_grouping(urls, 4, "none")
    flow = dataflow.Flow(spark).source("urls", lambda s: urls).operator("n", lambda u: u.groupBy().count(), "urls")
    assert flow["n"].first()[0] == 30


def test_text_codecs(spark, tmp_path):
    (tmp_path / "db.txt").write_text("apple:www.apple.com:about:0.25\n")
    assert tuple(files.read_postings(spark, str(tmp_path / "db.txt")).first()) == ("apple", "www.apple.com:about", 0.25)
    (tmp_path / "index.txt").write_text("apple\tabc 1.00000:T 3\ntree\tabc 0.33333 1\n")
    assert [tuple(r) for r in files.read_index(spark, str(tmp_path / "index.txt")).collect()] == [("apple", "abc", 1.0, True, 3), ("tree", "abc", 0.33333, False, 1)]
    hits = spark.createDataFrame([("a", "http://u", 0.5, True)], "word string, url string, weight double, is_title boolean")
    files.write_lines(files.hit_lines(hits), str(tmp_path / "hits"))
    assert files.read_hits(spark, str(tmp_path / "hits")).exceptAll(hits).count() == 0
    (tmp_path / "w.txt").write_text("a b.c,,d")
    assert [r["value"] for r in files.read_words(spark, str(tmp_path / "w.txt")).collect()] == ["a", "b", "c", "", "d"]
    new = spark.createDataFrame([("k", 2, "new")], "k string, v int, x string")
    old = spark.createDataFrame([("k", 1, "old"), ("j", 1, "one")], "k string, v int, x string")
    assert {tuple(r) for r in files.upsert(old, new, ["k"], "v").select("k", "v", "x").collect()} == {("k", 2, "new"), ("j", 1, "one")}


def test_spouts(spark):
    from strandline.sources.spouts import read_spout

    class Numbers:
        def open(self, part, parts):
            self.part, self.parts = part, parts

        def next_rows(self):
            for i in range(self.part, 10, self.parts):
                yield (i, f"n{i}")

        def close(self):
            pass

    assert sorted(r["k"] for r in read_spout(spark, Numbers, "k int, v string", parts=3).collect()) == list(range(10))


def test_recording_links(spark):
    robots = spark.createDataFrame([("h", [], ["/no"])], "host string, allow array<string>, disallow array<string>")
    links = spark.createDataFrame([("http://h/no",), ("http://h/yes",), ("http://h/old",), (None,)], "link string")
    queue = spark.createDataFrame([("http://h/old",)], "url string")
    assert [r["url"] for r in crawl.record(links, robots, queue).collect()] == ["http://h/yes"]
    pages = spark.createDataFrame([("u", ["http://h/a", "mailto:x", "http://g/b"])], "url string, links array<string>")
    hosts = spark.createDataFrame([("h", 10, dt.datetime(2022, 1, 1))], "host string, crawl_delay int, last_visited timestamp")
    got = crawl.passing_links(pages, hosts, F.lit(dt.datetime(2022, 1, 1, 0, 0, 5)))
    assert [r["link"] for r in got.collect()] == ["http://g/b"]
