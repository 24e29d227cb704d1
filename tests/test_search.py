import math

import pytest
from lodequery.operators import ranking, snippets, suggest
from lodequery.operators.index import build_index
from lodequery.service import BadRequest, CorpusVersion, ResultCache, SearchEngine, SearchPage, describe_empty, page_slots, total_pages
from lodequery.sources import store
from pyspark.sql import functions as F

SCHEMA = "doc_id long, url string, title string, content_text string"


def _value(spark, column):
    return spark.range(1).select(column).first()[0]


def test_bm25_scalar(spark):
    lit = lambda *x: [F.lit(float(v)) for v in x]
    got = _value(spark, ranking.bm25(*lit(3, 250, 20, 1000, 300)))
    assert got == pytest.approx(math.log(1 + 980.5 / 20.5) * (3 * 2.2) / (3 + 1.2 * (0.25 + 0.75 * 250 / 300)))
    assert _value(spark, ranking.bm25(*lit(3, 250, 20, 1000, 300), k1=1e9, b=0.0)) == pytest.approx(3 * math.log(1 + 980.5 / 20.5), rel=1e-6)
    assert _value(spark, ranking.idf(*lit(0, 10))) == 0 and _value(spark, ranking.idf(*lit(5, 0))) == 0
    assert _value(spark, ranking.idf(*lit(30, 10))) == pytest.approx(math.log(1 + 0.5 / 10.5))
    assert _value(spark, ranking.tf_weight(*lit(2, 0, 300))) == _value(spark, ranking.tf_weight(*lit(2, 300, 300)))
    assert _value(spark, ranking.tf_weight(*lit(0, 10, 10))) == 0


def _corpus(spark):
    rows = [(i, f"https://h{i % 2}.example/p{i}", f"Page {i}", "crawl " * (8 - i) + "filler words here") for i in range(1, 8)]
    return spark.createDataFrame(rows + [(8, "https://h1.example/none", None, None)], SCHEMA)


def test_ranking_matches_brute_force(spark):
    docs = _corpus(spark).collect()
    index = build_index(_corpus(spark))
    got = {r.doc_id: r.score for r in ranking.score(index, ranking.queries_frame(spark, {1: "crawl filler crawl"})).collect()}
    words = {d.doc_id: [s for s in ranking.query_stems(f"{d.title or ''}\n\n{d.content_text or ''}")] for d in docs}
    n, average = len(words), sum(map(len, words.values())) / len(words)
    for doc, stems in words.items():
        expected = 0.0
        for term in ("crawl", "filler"):
            df, tf = sum(term in w for w in words.values()), stems.count(term)
            if tf:
                expected += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(stems) / average))
        assert got.get(doc, 0.0) == pytest.approx(expected)


def test_pages_never_overlap(spark, tmp_path):
    docs = _corpus(spark)
    root = str(tmp_path / "index")
    engine = SearchEngine(spark, root, docs)
    assert engine.search("crawl").status == "empty-index"
    store.write_index(build_index(docs), root)
    engine = SearchEngine(spark, root, docs)
    pages = [engine.search("crawl", page=p, page_size=3) for p in (1, 2, 3, 4)]
    assert [r["doc_id"] for p in pages for r in p.results] == [1, 2, 3, 4, 5, 6, 7]
    assert {p.total for p in pages} == {7} and pages[3].results == ()
    assert engine.search("the of and").status == "no-searchable-terms"
    assert describe_empty(engine.search("nothingatall")).startswith("Nothing matches")
    assert len(engine.cache) == 5 and engine.search("CRAWL", page=1, page_size=3).query == "CRAWL"
    hit = pages[0].results[0]
    assert hit["snippet"].startswith("crawl crawl") and hit["matches"][0] == {"start": 0, "end": 5}
    with pytest.raises(BadRequest):
        engine.search("x" * 201)
    assert [s["term"] for s in engine.suggest("see cr")] == ["see crawl"]
    assert engine.statistics()["sources"][0] == {"source": "h1.example", "documents": 5}
    assert engine.health()["status"] == "ok"
    assert engine.explain("crawl zzz")[1] == {"query_id": 1, "qpos": 1, "term": "zzz", "doc_freq": None, "idf": 0.0}
    assert engine.search_batch({1: "crawl", 2: "filler"}, 2).count() == 4


def test_failed_build_leaves_the_published_one(spark, tmp_path):
    docs, root = _corpus(spark), str(tmp_path / "index")
    first = store.write_index(build_index(docs), root)
    broken = build_index(docs)
    broken.terms = broken.terms.withColumn("doc_freq", F.col("doc_freq") + 1)
    with pytest.raises(RuntimeError):
        store.write_index(broken, root)
    assert store.current_version(root) == first
    assert store.write_index(build_index(docs), root, now_ms=1) == first + 1


def test_stored_postings_prune_by_term(spark, tmp_path):
    root = str(tmp_path / "index")
    store.write_index(build_index(_corpus(spark)), root)
    plan = store.load_index(spark, root).postings.where(F.col("term").isin("crawl")).select("doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,crawl)]" in plan.replace("In(term, [crawl])", "EqualTo(term,crawl)")
    assert "positions" not in plan.split("ReadSchema")[1].split("\n")[0]


def _snippet(spark, title, body, terms, size=300):
    docs = spark.createDataFrame([(1, title, body)], "doc_id long, title string, content_text string")
    stems = spark.createDataFrame([(1, t) for t in terms], "doc_id long, term string")
    r = snippets.snippets(docs, stems, size).withColumn("h", snippets.highlight(F.col("snippet"), F.col("matches"))).first()
    assert all(0 <= m.start < m.end <= len(r.snippet) for m in r.matches)
    return r


def test_snippets(spark):
    assert _snippet(spark, "Guide", "crawler and crawler and crawler.", ["crawler"]).h == "[crawler] and [crawler] and [crawler]."
    assert _snippet(spark, "Crawler", "", ["crawler"]).snippet == ""
    filler = "filler " * 30
    lead = _snippet(spark, "T", filler * 3, ["absent"])
    assert lead.snippet.endswith(" …") and len(lead.snippet) <= 302 and not lead.matches
    mid = _snippet(spark, "T", filler + "crawler index " + filler + filler, ["crawler", "index"], 64)
    assert mid.snippet.startswith("… filler") and mid.snippet.endswith("filler …") and "[crawler] [index]" in mid.h
    assert _snippet(spark, None, "a\nindex\nb", ["index"]).snippet == "a index b"


def test_merged_spans(spark):
    spans = [(5, 9), (1, 3), (3, 4), (8, 20), (7, 2), (-4, 0), (30, 40)]
    rows = spark.createDataFrame([([{"start": a, "end": b} for a, b in spans], 15)], "m array<struct<start:int,end:int>>, n int")
    assert [tuple(x) for x in rows.select(snippets.merge_spans(F.col("m"), F.col("n"))).first()[0]] == [(1, 4), (5, 15)]


def test_suggest(spark):
    terms = spark.createDataFrame([("a", 5, "apple"), ("b", 9, "apply"), ("c", 9, "app"), ("d", 1, None), ("e", 2, "resume")], "term string, doc_freq long, surface_form string")
    assert [r.term for r in suggest.suggest(terms, "the App").collect()] == ["the app", "the apply", "the apple"]
    assert [r.term for r in suggest.suggest(terms, "RÉS").collect()] == ["resume"]
    assert suggest.suggest(terms, "app ").count() == 0 and suggest.suggest(terms, "app", 0).count() == 0
    assert suggest.split_text("a b c") == ("a b ", "c")


def test_cache_and_version():
    clock = [0.0]
    cache = ResultCache(max_entries=2, ttl=10, now=lambda: clock[0])
    for q in "ab":
        cache.put((q,), SearchPage(q, "ok"), 1)
    assert cache.get(("a",), 1) and not cache.get(("z",), 1)
    cache.put(("c",), SearchPage("c", "ok"), 1)
    assert cache.get(("b",), 1) is None and cache.get(("a",), 1)
    clock[0] = 11
    assert cache.get(("a",), 1) is None
    cache.put(("a",), SearchPage("a", "ok"), 1)
    assert cache.get(("a",), 2) is None and len(cache) == 0
    reads = iter([3, RuntimeError("down"), 4])

    def read():
        value = next(reads)
        if isinstance(value, Exception):
            raise value
        return value

    version = CorpusVersion(read, interval=30, now=lambda: clock[0])
    assert version.current() == 3
    clock[0] += 31
    assert version.current() == 3
    clock[0] += 31
    assert version.current() == 4


def test_pager():
    assert page_slots(1, 1) == [1] and page_slots(5, 10) == [1, None, 4, 5, 6, None, 10] and page_slots(3, 5) == [1, 2, 3, 4, 5]
    assert total_pages(0, 10) == 1 and total_pages(21, 10) == 3
