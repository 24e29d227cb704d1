from lodequery.operators import crawl, fetching, snippets
from lodequery.service import parse_page, readable_url
from pyspark.sql import functions as F


def test_retry_delays(spark):
    rows = [(1, None, 1, 0.0), (2, "2", 1, 0.0), (3, "31", 1, 0.0), (4, "Thu, 01 Jan 1970 00:00:12 GMT", 1, 0.5), (5, "soon", 3, 1.0), (6, None, 9, 0.5), (7, "-5", 1, 0.0)]
    frame = spark.createDataFrame(rows, "id int, after string, attempt int, jitter double")
    after = fetching.retry_after_ms(F.col("after"), F.lit(2000.0))
    got = {r.id: r.d for r in frame.select("id", fetching.retry_delay_ms(after, F.col("attempt"), F.col("jitter")).alias("d")).collect()}
    assert got == {1: 250.0, 2: 2000.0, 3: None, 4: 10000.0, 5: 2000.0, 6: 6000.0, 7: 0.0}
    types = spark.createDataFrame([("Text/HTML; charset=x",), (None,)], "h string").select(fetching.content_type(F.col("h"))).collect()
    assert [r[0] for r in types] == ["text/html", ""]


def test_bodies(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes("привет".encode("cp1251"))
    read = fetching.read_bodies(spark, str(tmp_path)).withColumn("content_type", F.lit("text/html; charset=windows-1251"))
    bodies = read.unionByName(spark.createDataFrame([("none", None, None)], "path string, body binary, content_type string"))
    got = {r.path.rsplit("/", 1)[-1]: (r.text, r.charset, r.charset_source) for r in fetching.decode_bodies(bodies).collect()}
    assert got == {"a.bin": ("привет", "cp1251", "header"), "none": (None, None, None)}


def test_robots_entries_and_decisions(spark):
    text = "User-agent: *\nDisallow: /\nAllow: /open\nCrawl-delay: 99\nSitemap: http://a.com/s"
    fetched = [("http://a.com", text, None, None, 1000), ("http://a.com", None, "timeout", True, 500), ("http://b.com", None, "timeout", True, 1000), ("http://c.com", None, "http-error", False, 1000),
               ("http://d.com", None, "aborted", False, 1000), (None, text, None, None, 1), ("http://e.com", None, "too-large", False, 1000)]
    entries = fetching.robots_entries(spark.createDataFrame(fetched, "origin string, body string, reason string, retryable boolean, at_ms long"))
    found = {r.origin: (r.outcome, r.expires_ms, r.delay_ms) for r in entries.collect()}
    day, short = fetching.RULES_TTL_MS, fetching.UNREACHABLE_TTL_MS
    assert found == {"http://a.com": ("rules", 1000 + day, 30000.0), "http://b.com": ("disallow-all", 1000 + short, None), "http://c.com": ("allow-all", 1000 + day, None), "http://e.com": ("disallow-all", 1000 + short, None)}
    urls = spark.createDataFrame([(f"http://{h}.com{p}",) for h in "abcd" for p in ("/open/x", "/z?q")], "url string")
    early = {r.url: r.allowed for r in fetching.robots_decisions(urls, entries, 2000).collect()}
    assert early == {"http://a.com/open/x": True, "http://a.com/z?q": False, "http://b.com/open/x": False, "http://b.com/z?q": False, "http://c.com/open/x": True, "http://c.com/z?q": True, "http://d.com/open/x": None, "http://d.com/z?q": None}
    late = {r.url: r.outcome for r in fetching.robots_decisions(urls, entries, 1000 + short).collect()}
    assert late["http://b.com/z?q"] is None and late["http://a.com/z?q"] == "rules"
    stored = fetching.merge_entries(entries, entries.where("origin = 'http://b.com'").withColumn("outcome", F.lit("allow-all")))
    assert {r.origin: r.outcome for r in stored.collect()}["http://b.com"] == "allow-all" and stored.count() == 4
    queue = spark.createDataFrame([("http://a.com/1", 0), ("http://www.a.com/2", 1), ("http://q.com/", 0), ("http://q.com/x", 2)], "url string, depth int")
    ready = {r.url: r.ready_ms for r in fetching.ready_times(queue, entries).collect()}
    assert ready == {"http://a.com/1": 0, "http://www.a.com/2": 30000, "http://q.com/": 0, "http://q.com/x": 1000}


def test_running_counts_of_a_hot_host(spark):
    rows = [(f"http://hot.com/{k:04d}", k % 3) for k in range(400)] + [("http://b.com/", 0), (None, 1)]
    queue = spark.createDataFrame(rows, "url string, depth int")
    got = {r.url: r.round for r in crawl.host_rounds(queue).collect()}
    order = sorted((d, u) for u, d in rows if u and "hot" in u)
    assert all(got[u] == k for k, (_, u) in enumerate(order)) and got["http://b.com/"] == 0 and len(got) == 402


def test_a_crawl_over_stored_answers(spark):
    html = lambda *links: ("<html><body><p>text</p>" + "".join(f"<a href='{x}'>x</a>" for x in links)).encode()
    answers = [("http://a.com/", 200, "text/html", html("/1", "/2", "http://b.com/", "/1", "/no")), ("http://a.com/1", 200, "text/html", html("/3")), ("http://a.com/2", 404, "text/html", html()),
               ("http://a.com/3", 200, "text/html", html("/4")), ("http://a.com/4", 200, "text/html", html()), ("http://b.com/", 200, "text/html", html()), ("http://a.com/no", 200, "text/html", html())]
    fetched = spark.createDataFrame(answers, "url string, status int, content_type string, body binary")
    robots = fetching.robots_entries(spark.createDataFrame([("http://a.com", "User-agent: *\nDisallow: /no", None, None, 0)], "origin string, body string, reason string, retryable boolean, at_ms long"))
    pages, summary = fetching.crawl_stored(fetched, ["http://www.a.com/"[:7] + "a.com"], entries=robots, max_depth=2)
    assert {(r.url, r.depth) for r in pages.collect()} == {("http://a.com/", 0), ("http://a.com/1", 1), ("http://a.com/3", 2)}
    assert (summary["stopped_because"], summary["fetched"], summary["robots_blocked"], summary["failed"], summary["out_of_scope"]) == ("drained", 3, 1, 1, 1)
    pages, summary = fetching.crawl_stored(fetched, ["http://a.com/"], ["b.com"], max_pages=2)
    assert pages.count() == 2 and summary["stopped_because"] == "max-pages"
    assert fetching.crawl_stored(fetched, [])[0].count() == 0
    assert fetching.hosts_from_seeds(["http://www.a.com/x", "https://a.com", "bad", "http://b.com:8080"]) == ["a.com", "b.com"]
    asked = spark.createDataFrame([(1, "http://a.com/", 0, False), (2, "http://a.com/", 0, False), (3, "http://a.com/", 0, True), (4, "x", 0, False)], "candidate_id long, requested string, depth int, requeue boolean")
    counters = fetching.frontier_counters(crawl.admit(asked), asked).first().asDict()
    assert (counters["enqueued"], counters["requeued"], counters["duplicate"], counters["invalid_url"]) == (1, 1, 1, 1)


def test_segments_and_units(spark):
    frame = spark.createDataFrame([("a😀bcd", [(2, 4), (3, 4), (9, 2), (-1, 1)]), ("", []), ("x", None)], "s string, m array<struct<start:int,end:int>>")
    rows = frame.select("s", snippets.segments(F.col("s"), F.col("m")).alias("g"), snippets.utf16_offsets(F.col("s"), F.col("m")).alias("u")).collect()
    assert [(x.text, x.highlighted) for x in rows[0].g] == [("a", True), ("😀", False), ("bc", True), ("d", False)] and rows[1].g == []
    assert [tuple(x) for x in rows[0].u][:2] == [(3, 5), (4, 5)]


def test_addresses_people_read():
    assert readable_url("https://Example.com/") == "example.com" and readable_url("http://e.com:80/a%20b?q=%C3%A9") == "e.com/a b?q=é"
    assert readable_url("not an address") == "not an address" and readable_url("http://e.com/%ff") == "http://e.com/%ff" and readable_url("http://e.com/a%2Fb") == "e.com/a%2Fb"
    assert [parse_page(x) for x in ("3", "0", "-1", "1.5", "x", None, "", "2.0")] == [3, 1, 1, 1, 1, 1, 1, 2]
