import json
import random

import pytest
from lodequery.functions import clean, web
from lodequery.operators import crawl, storage
from lodequery.sources import store
from lodequery.streaming.ingest import ingest, merge_batch
from pyspark.sql import functions as F

URLS = [
    ("HTTP://Example.COM/About", None, "http://example.com/About"), ("http://e.com/p?utm_source=news&q=cats", None, "http://e.com/p?q=cats"),
    ("http://e.com/?v=" + "!" * 1000, None, None), ("http://e.com:80/a/../b/./c", None, "http://e.com/b/c"), ("https://u:p@e.com#x", None, "https://e.com/"),
    ("mailto:x@y", None, None), ("http://e.com/?b=2&a=1&a=0", None, "http://e.com/?a=0&a=1&b=2"), ("../x?y", "http://e.com/a/b/c", "http://e.com/a/x?y="),
    ("//other.com/p/", "https://e.com/", "https://other.com/p/"), ("http://e.com:8080", None, "http://e.com:8080/"), (None, None, None), ("", None, None),
    ("http://e.com/?=x&fbclid=1", None, "http://e.com/"), ("http://e.com/a b", None, "http://e.com/a%20b"),
]


@pytest.mark.parametrize("url,base,expected", URLS)
def test_urls(url, base, expected):
    assert web.normalize_url(url, base) == expected
    if expected:
        assert web.normalize_url(expected) == expected


def page(body, head="", attrs=""):
    return web.parse_html(f"<!doctype html><html {attrs}><head>{head}</head><body>{body}</body></html>", "http://example.com/docs/page")


def test_pages():
    assert page("<p>Apples</p><p>Oranges</p>")["text"] == "Apples\nOranges"
    assert page("<header>x</header><main><header>Headline</header><p>Body</p></main>")["text"] == "Headline\nBody"
    assert page("<header>x</header><p>a<nav>n</nav><script>s</script><p hidden>h</p><footer>f</footer>")["text"] == "a"
    assert page("<ul><li>one<li>two</ul>a<br>b <b>c</b>d")["text"] == "one\ntwo\na\nb cd"
    found = page("<a href='/q?utm_x=1'>a</a><a href='#top'>self</a><a rel=nofollow href=/n>n</a><a href=/q>dup</a>", "<base href='http://b.com/x/'>")
    assert found["links"] == ["http://b.com/q", "http://b.com/x/"]
    head = "<title> T  t</title><meta name=description content=' d '><link rel='x canonical' href='/c'><meta name=robots content='noindex, nofollow'>"
    found = page("<a href=/z>z</a>", head, "lang='EN-gb'")
    assert (found["title"], found["description"], found["canonical_url"], found["lang"]) == ("T t", "d", "http://example.com/c", "en-gb")
    assert found["noindex"] and found["nofollow"] and found["links"] == []
    own = f"<meta name=robots content=noindex><meta name={web.AGENT} content=all>"
    assert not page("", own)["noindex"]
    assert page("<h1>H</h1>")["title"] == "H" and page("", attrs="lang='!'")["lang"] is None
    assert web.parse_html("x", "ftp://a") is None


def test_parse_pages_frame(spark):
    pages = spark.createDataFrame([("http://a.com/x#y", "<main><p>t"), ("bad", "z"), ("http://a.com/n", None)], "url string, html string")
    assert sorted((r.url, r.text) for r in web.parse_pages(pages).collect()) == [("http://a.com/n", ""), ("http://a.com/x", "t")]


def test_charsets():
    assert web.decode_body("é".encode(), None) == ("é", "utf-8", "default")
    assert web.decode_body(b"\xef\xbb\xbfx", "latin1")[2] == "bom"
    assert web.decode_body("é".encode("cp1252"), "ISO-8859-1")[0] == "é"
    assert web.decode_body(b"<!-- <meta charset=utf-16> --><meta charset='windows-1251'>" + "привет".encode("cp1251"))[0].endswith("привет")
    assert web.decode_body(b"x", "no-such-charset")[2] == "default"
    assert web.charset_of_header('text/html; charset="UTF-8"') == "utf-8" and web.charset_of_header("text/html") is None


def test_cleaning(spark):
    texts = [" a   b\r\nc ", "x\n\n \ny", "​z­", None, "", "w" * 400]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = rows.select(clean.clean_inline(F.col("t")), clean.clean_block(F.col("t"))).orderBy("i").collect()
    assert [tuple(r) for r in got[:4]] == [("a b c", "a b\nc"), ("x y", "x\ny"), ("z", "z"), (None, None)]
    assert len(got[5][0]) == 300
    assert all(r[0] == clean.inline_text(t) and r[1] == clean.block_text(t) for r, t in zip(got, texts, strict=True) if t is not None)


def test_robots():
    text = "User-agent: *\nDisallow: /\n\nUser-agent: lodequerybot\nAllow: /a\nDisallow: /a/b$\nDisallow: /*.pdf\nCrawl-delay: 5\nSitemap: http://x/s"
    robots = web.parse_robots(text)
    assert robots["delay"] == 5 and robots["sitemaps"] == ["http://x/s"]
    allow = lambda p: web.robots_allow(p, robots["rules"])
    assert allow("/a") and not allow("/a/b") and allow("/a/bc") and not allow("/x.pdf") and allow("/other")
    assert web.robots_allow("/x", [(True, "/x"), (False, "/x")]) and web.robots_allow("/x", [])


def test_robots_verdicts_frame(spark):
    rules = [("o", a, p, web.robots_pattern(p)) for a, p in [(False, "/"), (True, "/a"), (False, "/a/*z")]]
    paths = spark.createDataFrame([("o", "/a/1"), ("o", "/a/xz"), ("o", "/q"), ("free", "/q")], "origin string, path string")
    got = {(r.origin, r.path): r.allowed for r in crawl.robots_verdicts(paths, spark.createDataFrame(rules, "origin string, allow boolean, pattern string, regex string")).collect()}
    assert got == {("o", "/a/1"): True, ("o", "/a/xz"): False, ("o", "/q"): False, ("free", "/q"): True}


def test_admission_precedence(spark):
    asked = [
        (1, "nonsense", 9, False), (2, "http://out.com/robots.txt", 9, False), (3, "http://out.com/robots.txt", 1, False), (4, "http://out.com/x", 1, False),
        (5, "http://in.com/x", 1, False), (6, "http://www.in.com/y#f", 3, False), (7, "http://www.in.com/y", 1, False), (8, "http://in.com/seen", 1, False),
        (9, "http://in.com/seen", 1, True), (10, "http://in.com/z", 0, False), (11, "http://in.com/late", 0, False),
    ]
    frame = spark.createDataFrame(asked, "candidate_id long, requested string, depth int, requeue boolean")
    hosts = spark.createDataFrame([("in.com",)], "host string")
    seen = spark.createDataFrame([("http://in.com/seen",)], "url string")
    got = {r.candidate_id: r.reason for r in crawl.admit(frame, hosts, seen, room=4).collect()}
    assert got == {1: "invalid-url", 2: "too-deep", 3: "excluded", 4: "out-of-scope", 5: None, 6: None, 7: "duplicate", 8: "duplicate", 9: None, 10: None, 11: "queue-full"}


def test_levels_and_rounds(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("b", "a")], "source string, target string")
    seeds = spark.createDataFrame([("a",)], "url string")
    assert {r.url: r.depth for r in crawl.crawl_levels(seeds, links, 3).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    queue = spark.createDataFrame([("http://a.com/2", 1), ("http://www.a.com/1", 0), ("http://b.com/", 2)], "url string, depth int")
    assert {r.url: r.round for r in crawl.host_rounds(queue).collect()} == {"http://www.a.com/1": 0, "http://a.com/2": 1, "http://b.com/": 0}


def test_retry_rules(spark):
    rows = spark.createDataFrame([(429,), (500,), (501,), (404,), (None,)], "s int").select(crawl.retryable_status(F.col("s"))).collect()
    assert [r[0] for r in rows] == [True, True, False, False, False]
    delay = spark.createDataFrame([(5.0,), (99.0,), (-1.0,), (float("nan"),), (None,)], "s double").select(crawl.crawl_delay_ms(F.col("s"))).collect()
    assert [r[0] for r in delay] == [5000.0, 30000.0, None, None, None]


PAGES = "url string, title string, content_text string, noindex boolean, arrival long"


def test_storage_outcomes(spark):
    known = spark.createDataFrame([("u1", "T", "one", "h", 7)], "url string, title string, content_text string, content_hash string, token_count int")
    known = known.withColumn("content_hash", storage.content_hash(F.col("title"), F.col("content_text")))
    pages = spark.createDataFrame(
        [("u1", "T", "one", False, 1), ("u2", "T", "one", False, 2), ("u3", "T", " ﻿\n", False, 3), ("u4", "T", "new", None, 4), ("u5", "T", "new", False, 5),
         ("u4", "T", "changed", False, 6), ("u1", "T", "x", True, 7)], PAGES)
    classified = storage.classify_pages(pages, known)
    assert {r.arrival: r.outcome for r in classified.collect()} == {1: "updated", 2: "duplicate", 3: "empty", 4: "inserted", 5: "duplicate", 6: "updated", 7: "noindex"}
    merged = {r.url: (r.content_text, r.token_count) for r in storage.merge_documents(known, classified).collect()}
    assert merged == {"u4": ("changed", 0)}
    kept = storage.merge_documents(known, storage.classify_pages(pages.where("arrival = 1"), known)).first()
    assert kept.token_count == 7


def _replayed(pages, held):
    held, out = dict(held), {}
    for url, text, noindex, at in sorted(pages, key=lambda p: p[3]):
        if noindex:
            out[at] = "noindex"
            held.pop(url, None)
        elif not text:
            out[at] = "empty"
        elif url in held:
            out[at], held[url] = "updated", text
        elif text in held.values():
            out[at] = "duplicate"
        else:
            out[at], held[url] = "inserted", text
    return out, held


def test_pages_that_arrive_again(spark):
    few = [("u", "a", False, 1), ("u", "a", True, 2), ("v", "a", False, 3), ("u", "a", False, 4)]
    frame = spark.createDataFrame([(u, "T", c, n, a) for u, c, n, a in few], PAGES)
    assert {r.arrival: r.outcome for r in storage.classify_pages(frame).collect()} == {1: "inserted", 2: "noindex", 3: "inserted", 4: "duplicate"}
    rng = random.Random(8)
    for _ in range(3):
        many = [(rng.choice("uvwxyz"), rng.choice(["a", "b", "c", "d", ""]), rng.random() < 0.15, k) for k in range(150)]
        held = {"u": "a", "q": "b"}
        known = spark.createDataFrame([(u, "T", c, 1) for u, c in held.items()], "url string, title string, content_text string, token_count int")
        known = known.withColumn("content_hash", storage.content_hash(F.col("title"), F.col("content_text")))
        frame = spark.createDataFrame([(u, "T", c, n, a) for u, c, n, a in many], PAGES).repartition(3)
        outcomes, left = _replayed(many, held)
        found = storage.classify_pages(frame, known)
        assert {r.arrival: r.outcome for r in found.collect()} == outcomes
        assert {r.url: r.content_text for r in storage.merge_documents(known, found).collect()} == left


def test_error_log(spark):
    log = [("u", "timeout", None, "x" * 600, 3, 1, 1, 5), ("u", "timeout", None, "x" * 600, 3, 1, 1, 5), ("u", "http-error", 500, None, 1, 2, 2, 9), (None, "z", 1, "", 1, 1, 1, 1)]
    frame = spark.createDataFrame(log, "url string, reason string, http_status int, detail string, depth int, attempts int, first_seen_at long, last_seen_at long")
    rows = storage.merge_errors(frame).collect()
    assert [tuple(r) for r in rows] == [("u", "http-error", 500, None, 1, 3, 1, 9)]
    assert storage.clear_errors(storage.merge_errors(frame), spark.createDataFrame([("u",)], "url string")).count() == 0
    moved = spark.createDataFrame([("x", "u", None)], "url string, requested_url string, final_url string")
    assert storage.clear_errors(storage.merge_errors(frame), moved).count() == 0


def test_stream_of_pages(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "docs")
    source.mkdir()
    batches = [[("u1", "T", "one", 1), ("u2", "T", "one", 2)], [("u1", "T", "two", 3)], [("u3", "T", "one", 4), ("u4", "T", "two", 5)]]
    for k, rows in enumerate(batches):
        lines = [json.dumps({"url": u, "title": t, "content_text": c, "noindex": False, "arrival": a}) for u, t, c, a in rows]
        (source / f"{k}.json").write_text("\n".join(lines))
        ingest(spark, str(source), root, str(tmp_path / "ckpt")).awaitTermination()
    held = {"u1": "two", "u3": "one"}
    assert {r.url: r.content_text for r in store.load_documents(spark, root).collect()} == held
    again = spark.createDataFrame([("u9", "T", "nine", False, 9)], PAGES)
    version = store.current_version(root)
    assert merge_batch(again, root, str(tmp_path / "ckpt") + "#0") == {} and store.current_version(root) == version
    assert merge_batch(again, root) == {"inserted": 1} and merge_batch(again.withColumn("noindex", F.lit(True)), root) == {"noindex": 1}
    assert {r.url: r.content_text for r in store.load_documents(spark, root).collect()} == held
