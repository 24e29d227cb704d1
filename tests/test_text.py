import pytest

from lodequery.functions.text import MAX_TOKEN_LENGTH, fold_plain, fold_token, is_plain, porter_stem, raw_tokens
from lodequery.operators.index import build_index, process_text, token_offsets
from lodequery.operators.ranking import query_stems, unique_stems
from pyspark.sql import functions as F

STEMS = {
    "computers": "comput", "computing": "comput", "indexing": "index", "indexes": "index", "searching": "search", "ranking": "rank", "pages": "page",
    "running": "run", "troubling": "troubl", "relational": "relat", "happiness": "happi", "crawlers": "crawler", "crawling": "crawl",
    "university": "univers", "42": "42", "a": "a", "sing": "sing", "": "", "hopping": "hop", "agreed": "agre", "sky": "sky", "controlling": "control",
}
FOLDS = {"İstanbul": "istanbul", "ﬁle": "file", "ｓｅａｒｃｈ": "search", "²": "2", "½": "12", "Zürich": "zurich", "O'Brien": "obrien", "---": "", "résumés": "resumes"}


@pytest.mark.parametrize("word,stem", STEMS.items())
def test_stems(word, stem):
    assert porter_stem(word) == stem


@pytest.mark.parametrize("raw,folded", FOLDS.items())
def test_folding(raw, folded):
    assert fold_token(raw) == folded
    assert fold_token(folded) == folded


def test_native_folding_agrees_on_plain_tokens(spark):
    words = ["Zürich", "O'Brien", "ÀÉÎÕÜ", "straße", "it’s", "naïve", "42", "ﬁle", "索引"]
    rows = spark.createDataFrame([(w,) for w in words], "raw string").select("raw", is_plain(F.col("raw")).alias("plain"), fold_plain(F.col("raw")).alias("f")).collect()
    assert [r.raw for r in rows if not r.plain] == ["ﬁle", "索引"]
    assert all(r.f == fold_token(r.raw) for r in rows if r.plain)


def test_tokens(spark):
    texts = ["v1.2.3", "state-of-the-art", "rock 'n' roll", "a" * 65, "a" * 64, None, ""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", raw_tokens(F.col("t")).alias("w")).orderBy("i").collect()
    assert [r.w for r in rows] == [["v1", "2", "3"], ["state", "of", "the", "art"], ["rock", "n", "roll"], [], ["a" * MAX_TOKEN_LENGTH], None, []]


def test_queries():
    assert query_stems("The Crawlers are indexing résumés — 42 pages!") == ["crawler", "index", "resum", "42", "page"]
    assert unique_stems("page pages index") == ["page", "index"]
    assert query_stems("they're not; we don't") == []


DOCS = [(1, "Search Engines", "A crawler indexes pages."), (2, "Crawling", "The crawler crawls pages and pages.")]
SCHEMA = "doc_id long, title string, content_text string"


def test_two_documents(spark):
    index = build_index(spark.createDataFrame(DOCS, SCHEMA))
    found = {(r.term, r.doc_id): (r.tf, r.positions) for r in index.postings.collect()}
    assert found[("crawler", 1)] == (1, [3]) and found[("crawler", 2)] == (1, [2])
    assert found[("page", 1)] == (1, [5]) and found[("page", 2)] == (2, [4, 6])
    assert {r.doc_id: r.token_count for r in index.lengths.collect()} == {1: 5, 2: 5}
    assert index.stats.first().asDict() == {"total_docs": 2, "total_tokens": 10, "avg_doc_len": 5.0}
    assert {r.term: r.doc_freq for r in index.terms.collect()}["index"] == 1


def test_empty_texts_count_as_documents(spark):
    index = build_index(spark.createDataFrame([(1, "", "the and of to a"), (2, "Crawler", ""), (3, None, None)], SCHEMA))
    assert {r.doc_id: r.token_count for r in index.lengths.collect()} == {1: 0, 2: 1, 3: 0}
    empty = build_index(spark.createDataFrame([], SCHEMA))
    assert empty.stats.first().asDict() == {"total_docs": 0, "total_tokens": 0, "avg_doc_len": 0.0}


def test_duplicate_ids_are_refused(spark):
    with pytest.raises(ValueError):
        build_index(spark.createDataFrame([DOCS[0], DOCS[0]], SCHEMA))


def test_positions_before_stop_words_and_offsets(spark):
    docs = spark.createDataFrame([(1, "", "the search engine is fast"), (2, "𝒳 o'clock", "ﬁn—it’s")], SCHEMA)
    found = {(r.doc_id, r.term): r.position for r in process_text(docs).collect()}
    assert {k: v for k, v in found.items() if k[0] == 1} == {(1, "search"): 1, (1, "engin"): 2, (1, "fast"): 4}
    texts = {1: "\n\nthe search engine is fast", 2: "𝒳 o'clock\n\nﬁn—it’s"}
    assert all(texts[r.doc_id][r.start : r.end] == r.raw for r in token_offsets(docs).collect())


def test_plan_of_tokens_has_no_exchange(spark):
    from lodequery.operators.index import explode_tokens

    plan = explode_tokens(spark.createDataFrame(DOCS, SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
