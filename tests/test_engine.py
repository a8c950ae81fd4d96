"""Index, search and snippets end to end; bolts; the crawl as a stream; sources and sinks no query runs."""

import time

import pytest
from pyspark.sql import functions as F

from strandline.functions import html as H
from strandline.operators import crawl, dataflow, graph, index, search
from strandline.plans import engine
from strandline.session import cut, release, scratch, scratch_path
from strandline.sources import files
from strandline.streaming import jobs as streams

PAGES = "page_id long, url string, elem_no int, tag string, text string"
ROWS = [
    (1, "http://www.apple.com/", 1, "title", "Apple company"), (1, "http://www.apple.com/", 2, "p", "The apple tree in New York City"),
    (2, "http://x.org/tree/a", 1, "title", "Trees"), (2, "http://x.org/tree/a", 2, "p", "A tree, a tree and a river"),
    (3, "http://y.org/", 1, None, "river"), (4, None, 1, "p", "tree"), (5, "http://z.org/", 1, "p", None),
]


@pytest.fixture(scope="module")
def built(spark):
    grams = spark.createDataFrame([("new york",), ("york city",)], "ngram string")
    ranks = spark.createDataFrame([("http://www.apple.com/", 2.0), ("http://y.org/", None)], "url string, pagerank double")
    return engine.build_index(spark.createDataFrame(ROWS, PAGES), ranks, {2: grams})


def test_search_finds_ranks_and_shows(built):
    got = engine.search(built, "the Apple of NEW YORK!").collect()
    assert [(r["pos"], r["url"], r["title"]) for r in got] == [(1, "http://www.apple.com/", " Apple company")]
    assert got[0]["words"] == "apple,new york,york" or set(got[0]["words"].split(",")) == {"apple", "new york", "new", "york"}
    assert got[0]["description"].startswith(" Apple company The apple tree")
    trees = engine.search(built, "tree river", snippets=False).collect()
    assert [r["url"] for r in trees][0] == "http://x.org/tree/a" and {r["url"] for r in trees} == {"http://x.org/tree/a", "http://y.org/", "http://www.apple.com/"}
    assert [r["pos"] for r in engine.search(built, "tree river", start=1, size=1).collect()] == [2]
    assert engine.search(built, "nothing here").count() == 0 and engine.search(built, "").count() == 0


def test_index_survives_its_folder(spark, built, tmp_path):
    built.save(f"{tmp_path}/index")
    stored = engine.SearchIndex.load(spark, f"{tmp_path}/index")
    want = [tuple(r) for r in engine.search(built, "apple tree").collect()]
    assert [tuple(r) for r in engine.search(stored, "apple tree").collect()] == want
    plan = search.lookup(stored.postings, ["apple", "tree"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan or "shard#" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert "In(word, [apple,tree])" in plan


def test_empty_index(spark):
    empty = engine.build_index(spark.createDataFrame([], PAGES), spark.createDataFrame([], "url string, pagerank double"))
    assert empty.postings.count() == 0 and engine.search(empty, "apple").count() == 0


def test_description_reads_only_what_it_shows(spark):
    def fold(texts, limit=300):
        out, size, done, stage = "", 0, False, -1
        for now, text in texts:
            full, opens = size > limit, now != stage
            done, stage = done or (opens and size >= limit), now  # a stage that finds the snippet full isn't entered
            if done:
                continue
            if full and not opens:
                out, done = out[:limit] + "...", True
            else:
                out, size = f"{out} {text}", size + len(text)
        return out

    stages = {"meta-name-description": 0, "meta-property-description": 1, "p": 2}
    cases = [[("p", 300), ("p", 5)], [("meta-name-description", 300), ("p", 0), ("p", 0), ("p", 7), ("p", 9)], [("meta-name-description", 350), ("meta-property-description", 10), ("p", 20), ("p", 30)], [("p", 0)] * 20, [("p", 90)] * 30]
    rows = [(i, "u", n, tag, "abcdefghij"[i % 10] * size) for i, case in enumerate(cases) for n, (tag, size) in enumerate(case)]
    got = {r["page_id"]: r["description"] for r in H.snippet_description(spark.createDataFrame(rows, PAGES)).collect()}
    for i in range(len(cases)):
        assert got[i] == fold([(stages[t], x) for p, _, _, t, x in rows if p == i]), i


def test_rendered_pages_read_back(spark):
    rows = [(1, "http://h/a", 1, "title", None, 'Tom & "Jerry" <1>', None), (1, "http://h/a", 2, "a", "x y", " to\n there ", "/t?q#f"), (1, "http://h/a", 3, None, None, None, None), (1, "http://h/a", 4, "li", "m", "gone\xa0", None)]
    pages = H.render(spark.createDataFrame(rows, "page_id long, url string, elem_no int, tag string, css_class string, text string, href string"))
    got = [(r["elem_no"], r["tag"], r["css_class"], r["text"], r["href"]) for r in H.own_text(pages).orderBy("elem_no").collect()]
    assert got == [(1, "title", None, 'Tom & "Jerry" <1>', None), (2, "a", "x y", "to there", "/t?q#f"), (3, "div", None, "", None)]
    assert [r["link"] for r in H.page_links(H.own_text(pages)).collect()] == ["http://h/t"]


def test_bolts(spark):
    class Sums:
        """Sums its partition's numbers and tells them at the end."""

        def prepare(self, part):
            self.part, self.total = part, 0

        def execute(self, rows):
            self.total += sum(r["k"] for r in rows)
            return [{"part": self.part, "total": None, "k": r["k"]} for r in rows if r["k"] < 3]

        def cleanup(self):
            return [{"part": self.part, "total": self.total, "k": None}]

    class Fails(Sums):
        def execute(self, rows):
            raise ValueError("no")

    numbers = spark.range(100).select(F.col("id").alias("k"))
    rows = dataflow.run_bolt(dataflow.shuffle_grouping(numbers, 3), Sums, "part int, total long, k long").collect()
    assert sorted(r["k"] for r in rows if r["k"] is not None) == [0, 1, 2]
    assert sum(r["total"] for r in rows if r["total"] is not None) == 4950 and {r["part"] for r in rows} == {0, 1, 2}
    with pytest.raises(Exception, match="no"):
        dataflow.run_bolt(numbers, Fails, "part int, total long, k long").collect()


def test_crawl_stream_feeds_its_frontier(spark, tmp_path):
    pages = {"a": ["b", "c", "bad"], "b": ["a", "d"], "c": ["d"], "d": ["a"], "bad": ["e"], "e": []}
    links = cut(spark.createDataFrame([(u, x) for u, xs in pages.items() for x in xs], "url string, link string"))
    frontier = f"{tmp_path}/crawl/frontier"
    spark.createDataFrame([("a",), ("a",), (None,)], "url string").coalesce(1).write.parquet(f"{frontier}/seeds")
    query = streams.crawl_stream(spark, frontier, lambda now: links.join(now, "url"), lambda u: u.where("url <> 'bad'"), f"{tmp_path}/state")
    try:
        until = time.time() + 90
        while time.time() < until:
            query.processAllAvailable()
            got = {(r["url"], r["round"]) for r in spark.read.schema("url string, round long").parquet(f"{tmp_path}/crawl/visited/round=*").collect()}
            if len(got) >= 4:
                break
    finally:
        query.stop()
    assert {u for u, _ in got} == {"a", "b", "c", "d"} and ("a", 0) in got and len(got) == 4


def test_new_documents_count_once(spark, tmp_path):
    rows = spark.createDataFrame([("w", "d1"), ("w", "d1"), ("w", "d2")], "word string, url_hash string").withColumn("ts", F.to_timestamp(F.lit("2022-01-01 00:00:00")))
    rows.coalesce(1).write.parquet(f"{tmp_path}/p")
    stream = streams.new_documents(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/p"), "ts")
    query = stream.writeStream.format("memory").queryName("once").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("once").count() == 2


def test_random_words(spark):
    stream = streams.random_words(spark, 50)
    query = stream.writeStream.format("memory").queryName("rnd").outputMode("append").start()
    until = time.time() + 60
    while time.time() < until and spark.table("rnd").count() == 0:
        time.sleep(0.5)
    query.stop()
    assert {r["word"] for r in spark.table("rnd").collect()} <= set(streams.RANDOM_WORDS) and spark.table("rnd").count() > 0


def test_remaining_sources_and_sinks(spark, tmp_path):
    (tmp_path / "q.txt").write_text("apple pie\nriver\n")
    assert [tuple(r) for r in files.read_queries(spark, f"{tmp_path}/q.txt").collect()] == [("", "apple pie"), ("", "river")]
    assert [r["content"].decode() for r in files.read_pages(spark, f"{tmp_path}/q.txt").collect()] == ["apple pie\nriver\n"]
    old = spark.createDataFrame([("u", 1), ("v", 1)], "url string, last_visited int")
    new = spark.createDataFrame([("u", 2)], "url string, last_modified int")
    assert {tuple(r) for r in crawl.record_visits(old, new).collect()} == {("u", 2), ("v", 1)}
    ranks = spark.createDataFrame([("a", 1.234), ("b", None)], "id string, rank double")
    assert [tuple(r) for r in graph.lookup(ranks, ["a", "b", "c"]).collect()] == [("a", "1.23")]


def test_pagerank_stops_at_its_tolerance(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string")
    ranks = {r["id"]: r["rank"] for r in graph.pagerank(edges, iterations=200, tolerance=1e-6).collect()}
    assert ranks == pytest.approx({"a": 1.0, "b": 1.0}, abs=1e-4)


def test_scratch_tables_go_with_their_block(spark):
    kept = cut(spark.range(3))
    with scratch():
        inside = scratch_path(spark)
        cut(spark.range(2))
        spark.range(1).write.parquet(inside)
    assert kept.count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(inside)
    release()


def test_a_cluster_without_shared_folder_is_an_error(spark, monkeypatch):
    from strandline import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(*_):
                return None

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Session())
