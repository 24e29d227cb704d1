"""Named query plans of the search engine: ``name -> f(spark, folder)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodequery.functions import clean, text, web
from lodequery.functions.urls import canonical_host
from lodequery.operators import crawl, fetching, index, ranking, snippets, storage, suggest
from lodequery.session import cut_lineage
from lodequery.sources.tables import read_table

QUERY = "slow crawler requests and the inverted index"
BATCH = {1: QUERY, 2: "robots cache", 3: "résumé naïve café", 4: "the of and", 5: "Sitemap sitemaps SITEMAP", 6: "zzzunknownzzz index"}
PREFIXES = {1: "the inv", 2: "craw", 3: "RÉS", 4: "page t", 5: "slow "}


def _documents(spark: SparkSession, at: str) -> DataFrame:
    return read_table(spark, at, "documents").select("doc_id", "title", "content_text")


def _tokens(spark: SparkSession, at: str) -> DataFrame:
    return index.process_text(_documents(spark, at))


def _ranked(spark: SparkSession, at: str, queries: dict[int, str], k1: float = ranking.K1, b: float = ranking.B) -> tuple[index.Index, DataFrame]:
    """A ranking index (no positions) over the documents, and the scores of ``queries``."""
    docs = _documents(spark, at)
    posted = cut_lineage(index.postings(docs).drop("positions"))
    lengths = index.doc_lengths(docs, posted)
    built = index.Index(posted, index.doc_freq(posted), lengths, index.corpus_stats(lengths))
    return built, ranking.score(built, ranking.queries_frame(spark, queries), k1, b)


def scan_documents(spark, at):
    return read_table(spark, at, "documents").select("doc_id", "url", "http_status", "batch_id")


def tokenize(spark, at):
    return index.explode_tokens(_documents(spark, at))


def token_offsets(spark, at):
    return index.token_offsets(_documents(spark, at))


def normalize_tokens(spark, at):
    return index.fold_vocabulary(index.explode_tokens(_documents(spark, at)))


def stopword_filter(spark, at):
    folded = index.fold_vocabulary(index.explode_tokens(_documents(spark, at)))
    return folded.groupBy(text.is_stopword(F.col("surface")).alias("stopword")).agg(F.count("*").alias("n"))


def stem_vocab(spark, at):
    vocab = index.vocabulary(index.explode_tokens(_documents(spark, at)))
    return vocab.select("surface", "term").distinct()


def process_text(spark, at):
    return _tokens(spark, at)


def process_query(spark, at):
    rows = [(q, k, s) for q, t in BATCH.items() for k, s in enumerate(ranking.unique_stems(t))]
    return spark.createDataFrame(rows, "query_id int, qpos int, term string")


def postings(spark, at):
    posted = index.postings(_documents(spark, at))
    return posted.select("term", "doc_id", "tf", F.array_join(F.transform("positions", lambda x: x.cast("string")), ",").alias("positions"))


def doc_freq(spark, at):
    return index.doc_freq(index.postings(_documents(spark, at)))


def doc_lengths(spark, at):
    docs = _documents(spark, at)
    return index.doc_lengths(docs, index.postings(docs))


def corpus_stats(spark, at):
    docs = _documents(spark, at)
    stats = index.corpus_stats(index.doc_lengths(docs, index.postings(docs)))
    return stats.withColumn("avg_doc_len", F.round("avg_doc_len", 6))


def surface_forms(spark, at):
    return index.surface_forms(_documents(spark, at))


def build_index(spark, at):
    """The dictionary of a whole build with the sums over its postings."""
    docs = _documents(spark, at)
    built = index.build_index(docs)
    total = F.aggregate("positions", F.lit(0).cast("long"), lambda a, x: a + x)
    sums = built.postings.groupBy("term").agg(F.sum("tf").alias("occurrences"), F.sum(total).alias("position_sum"))
    return built.terms.join(sums, "term").select("term", "doc_freq", "occurrences", "position_sum", "surface_form")


def corpus_sources(spark, at):
    host = F.coalesce(F.split_part("url", F.lit("/"), F.lit(3)), F.lit(""))
    counted = read_table(spark, at, "documents").groupBy(host.alias("host")).agg(F.count("*").alias("documents"))
    return counted.orderBy(F.col("documents").desc(), "host").limit(5)


def stored_stats(spark, at):
    stats = read_table(spark, at, "corpus_stats")
    return stats.select("total_docs", "total_tokens", F.round("avg_doc_len", 6).alias("avg_doc_len"))


def idf(spark, at):
    n = read_table(spark, at, "documents").count()
    value = ranking.idf(F.coalesce("doc_freq", F.lit(0)), F.lit(float(n)))
    return read_table(spark, at, "terms").select("term_id", F.round(value, 6).alias("idf"))


def bm25_single(spark, at):
    """The ranking function of every stored posting against its document's stored length."""
    docs = read_table(spark, at, "documents")
    stats = read_table(spark, at, "corpus_stats").first()
    posted = read_table(spark, at, "postings").select("term_id", "doc_id", "tf").distinct()
    terms = read_table(spark, at, "terms").select("term_id", F.coalesce("doc_freq", F.lit(0)).alias("df"))
    joined = posted.join(docs.select("doc_id", F.coalesce("token_count", F.lit(0)).alias("len")), "doc_id").join(terms, "term_id")
    value = ranking.bm25(F.col("tf"), F.col("len"), F.col("df"), F.lit(float(stats.total_docs)), F.lit(float(stats.avg_doc_len)))
    return joined.select("term_id", "doc_id", "tf", F.round(value, 6).alias("score"))


def term_postings(spark, at):
    built, _ = _ranked(spark, at, BATCH)
    return ranking.term_postings(built, ranking.queries_frame(spark, BATCH)).select("query_id", "qpos", "term", "doc_id", "tf", "doc_len", "doc_freq")


def _shown(scored: DataFrame, *more: str) -> DataFrame:
    terms = F.array_join("matched_terms", " ")
    return scored.select("query_id", "doc_id", F.round("score", 6).alias("score"), terms.alias("matched_terms"), *more)


def bm25_or(spark, at):
    return _shown(_ranked(spark, at, BATCH)[1])


def bm25_topk(spark, at):
    return _shown(ranking.top_k(_ranked(spark, at, {1: QUERY})[1], 10), "rank", "total")


def bm25_batch(spark, at):
    return _shown(ranking.top_k(_ranked(spark, at, BATCH)[1], 10), "rank", "total")


def bm25_params(spark, at):
    return _shown(ranking.top_k(_ranked(spark, at, BATCH, k1=2.0, b=0.0)[1], 5), "rank", "total")


def bm25_page(spark, at):
    return _shown(ranking.page(_ranked(spark, at, {1: QUERY})[1], 3, 10), "rank")


def bm25_and(spark, at):
    """Documents that match every term of the query (an addition to the OR semantics)."""
    scored = _ranked(spark, at, {2: BATCH[2]})[1]
    return _shown(scored.where(F.size("matched_terms") == len(ranking.unique_stems(BATCH[2]))))


def phrase(spark, at):
    docs = _documents(spark, at)
    built = index.build_index(docs, check_ids=False)
    return ranking.phrase(built, ranking.query_stems("inverted index")).groupBy("doc_id").agg(F.count("*").alias("places"))


def explain(spark, at):
    built, _ = _ranked(spark, at, BATCH)
    found = ranking.explain(built, ranking.queries_frame(spark, BATCH))
    return found.withColumn("idf", F.round("idf", 6))


def _page_docs(spark, at, k=10):
    best = cut_lineage(ranking.top_k(_ranked(spark, at, {1: QUERY})[1], k))
    docs = read_table(spark, at, "documents").join(F.broadcast(best.select("doc_id")), "doc_id", "left_semi")  # k rows
    return best, docs


def search_page(spark, at):
    """A page of results with address, title, snippet and match offsets."""
    best, docs = _page_docs(spark, at)
    shown = snippets.snippets(docs, best.select("doc_id", F.explode("matched_terms").alias("term")))
    spans = F.array_join(F.transform("matches", lambda m: F.concat_ws("-", m["start"], m["end"])), ",")
    joined = best.join(docs.select("doc_id", "url", "title"), "doc_id").join(shown, "doc_id")
    return joined.select("rank", "doc_id", "url", "title", F.round("score", 6).alias("score"), "snippet", spans.alias("matches"), "total")


def _stems(spark, at) -> tuple[DataFrame, DataFrame]:
    docs = _documents(spark, at)
    stems = ranking.unique_stems(QUERY)
    return docs, docs.select("doc_id", F.explode(F.array(*[F.lit(s) for s in stems])).alias("term"))


def snippet_window(spark, at):
    docs, stems = _stems(spark, at)
    return snippets.best_window(cut_lineage(snippets.matched_tokens(docs, stems)))


def all_snippets(spark, at):
    docs, stems = _stems(spark, at)
    shown = snippets.snippets(docs, stems)
    return shown.select("doc_id", "snippet", F.size("matches").alias("matches"))


def snippet_lead(spark, at):
    docs = _documents(spark, at)
    text_ = index.indexable_text(F.col("title"), F.col("content_text"))
    rows = docs.select("doc_id", text_.alias("text"), (F.length(F.coalesce("title", F.lit(""))) + 2).alias("body"))
    lead = F.when(F.col("body") >= F.length("text"), "").otherwise(snippets.lead_of_body(F.col("text"), F.col("body"), snippets.MAX_LENGTH))
    return rows.select("doc_id", lead.alias("snippet"))


def highlight(spark, at):
    docs, stems = _stems(spark, at)
    shown = snippets.snippets(docs, stems)
    return shown.select("doc_id", snippets.highlight(F.col("snippet"), F.col("matches")).alias("marked"))


def merge_intervals(spark, at):
    """Places of an index's terms as spans of three, merged where they touch, by document."""
    spans = read_table(spark, at, "postings").select("doc_id", F.explode("positions").alias("p"))
    each = spans.groupBy("doc_id").agg(F.collect_set(F.struct(F.col("p").alias("start"), (F.col("p") + 1 + F.col("p") % 3).alias("end"))).alias("m"))
    merged = each.select("doc_id", F.explode(snippets.merge_spans(F.col("m"), F.lit(100_000))).alias("s"))
    return merged.select("doc_id", "s.start", "s.end")


def suggest_split(spark, at):
    head, fragment = suggest.split_input(F.col("title"))
    return read_table(spark, at, "documents").select("doc_id", head.alias("head"), fragment.alias("fragment"))


def suggest_terms(spark, at):
    docs = _documents(spark, at)
    terms = index.doc_freq(index.postings(docs)).join(index.surface_forms(docs), "term")
    rows = [(i, *suggest.split_text(t)) for i, t in PREFIXES.items()]
    inputs = spark.createDataFrame([(i, h, text.fold_token(f)) for i, h, f in rows], "input_id int, head string, prefix string")
    return suggest.suggest_batch(terms, inputs)


def suggest_stored(spark, at):
    """Completions from the stored dictionary."""
    return suggest.suggest(read_table(spark, at, "terms").select("term", F.coalesce("doc_freq", F.lit(0)).alias("doc_freq"), "surface_form"), "see Ind")


def url_normalize(spark, at):
    urls = read_table(spark, at, "documents").select("url").distinct()
    return urls.select("url", web.normalize_url_udf("url").alias("normal"))


def tracking_params(spark, at):
    """How often each query parameter occurs, and whether it only tracks."""
    query = F.regexp_extract("url", r"^[^?#]*\?([^#]*)", 1)
    named = read_table(spark, at, "documents").select(F.explode(F.split(query, "&")).alias("p")).where("p <> ''")
    name = F.lower(F.split_part("p", F.lit("="), F.lit(1)))
    prefix = F.lit(False)
    for p in web.TRACKING_PREFIXES:
        prefix = prefix | F.col("name").startswith(p)
    return named.groupBy(name.alias("name")).agg(F.count("*").alias("n")).withColumn("tracking", F.col("name").isin(web.TRACKING) | prefix)


def hosts(spark, at):
    return read_table(spark, at, "documents").groupBy(canonical_host(F.col("url")).alias("host")).agg(F.count("*").alias("documents"))


def clean_text(spark, at):
    docs = read_table(spark, at, "documents")
    return docs.select("doc_id", clean.clean_inline(F.col("title")).alias("title"), clean.clean_block(F.col("content_text")).alias("body"))


def _html(spark, at) -> DataFrame:
    """The documents as pages: their lines as paragraphs of the main part, under a menu."""

    def escaped(c):
        return F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))

    body = F.replace(escaped(F.col("content_text")), F.lit("\n"), F.lit("</p><p>"))
    html = F.concat(
        F.lit("<!doctype html><html lang='"), F.coalesce("lang", F.lit("")), F.lit("'><head><title>"), escaped(F.col("title")),
        F.lit("</title></head><body><nav><a href='/menu'>menu</a></nav><main><p>"), body,
        F.lit("</p><a href='/next?utm_source=x&id="), F.col("doc_id").cast("string"), F.lit("'></a><script>var x;</script></main></body></html>"),
    )
    return read_table(spark, at, "documents").select("url", html.alias("html"))


def parse_pages(spark, at):
    parsed = web.parse_pages(_html(spark, at))
    return parsed.select("url", "title", F.md5("text").alias("text"), "lang", F.size("links").alias("links"), "noindex", "nofollow")


def link_graph(spark, at):
    parsed = web.parse_pages(_html(spark, at))
    return parsed.select(F.col("url").alias("source"), F.explode("links").alias("target"))


def link_graph_bfs(spark, at):
    """Depth of every address reached from the oldest page, over links to the next pages of a host."""
    docs = read_table(spark, at, "documents").select("doc_id", "url", canonical_host(F.col("url")).alias("host"))
    order = Window.partitionBy("host").orderBy("doc_id")
    links = docs.select(F.col("url").alias("source"), F.lead("url").over(order).alias("target")).where("target IS NOT NULL")
    seeds = docs.groupBy("host").agg(F.min_by("url", "doc_id").alias("url")).select("url")
    return crawl.crawl_levels(seeds, links, max_depth=3)


def content_hash(spark, at):
    docs = read_table(spark, at, "documents")
    return docs.select("doc_id", storage.content_hash(F.col("title"), F.col("content_text")).alias("content_hash"))


def _arriving(spark, at) -> DataFrame:
    """Pages in order of arrival under their canonical address, which many pages of some sites share: they arrive again and again."""
    docs = read_table(spark, at, "documents")
    arrival = F.struct("batch_id", "fetched_at", "doc_id")
    return docs.select("doc_id", F.coalesce("canonical_url", "url").alias("url"), "title", "content_text", (F.col("http_status") >= 400).alias("noindex"), arrival.alias("arrival"), "batch_id")


def dedup_pages(spark, at):
    found = storage.classify_pages(_arriving(spark, at))
    return found.select("doc_id", "outcome")


def outcomes(spark, at):
    return dedup_pages(spark, at).groupBy("outcome").agg(F.count("*").alias("pages"))


def upsert_documents(spark, at):
    """The last batches (from 20 on) merged into what the earlier ones stored."""
    early = read_table(spark, at, "documents").where("batch_id < 20").withColumn("url", F.coalesce("canonical_url", "url"))
    hashed = storage.content_hash(F.col("title"), clean.trim_all(F.col("content_text")))
    fields = F.struct("title", "content_text", hashed.alias("content_hash"), "token_count")
    known = early.groupBy("url").agg(F.max_by(fields, F.struct("batch_id", "fetched_at", "doc_id")).alias("d")).select("url", "d.*")
    return storage.merge_documents(known, storage.classify_pages(_arriving(spark, at).where("batch_id >= 20"), known)).select(
        "url", "title", F.md5("content_text").alias("content"), "content_hash", "token_count"
    )


def crawl_errors(spark, at):
    merged = storage.merge_errors(read_table(spark, at, "crawl_errors"))
    return merged.withColumns({c: F.unix_micros(c) for c in ("first_seen_at", "last_seen_at")})


def cleared_errors(spark, at):
    errors = storage.merge_errors(read_table(spark, at, "crawl_errors"))
    return storage.clear_errors(errors, read_table(spark, at, "documents")).select("url", "reason", "attempts")


def crawl_summary(spark, at):
    return crawl.crawl_summary(storage.merge_errors(read_table(spark, at, "crawl_errors")))


def frontier_admission(spark, at):
    """Failed addresses offered to the frontier again, documents' addresses being seen; a hundred places are left."""
    log = read_table(spark, at, "crawl_errors").where("url IS NOT NULL").groupBy("url").agg(F.min("depth").alias("depth"), F.min("reason").alias("why"))
    numbered = crawl.running_count(log, F.lit(1), ["url"])
    asked = numbered.select(F.col("before").alias("candidate_id"), F.col("url").alias("requested"), "depth", (F.col("why") == "timeout").alias("requeue"))
    docs = read_table(spark, at, "documents")
    allowed = docs.select(canonical_host(F.col("url")).alias("host")).where("host < 'n'")
    return crawl.admit(asked, allowed, docs.select(web.normalize_url_udf("url").alias("url")), room=100)


def _queue(spark, at) -> DataFrame:
    return read_table(spark, at, "crawl_errors").where("url IS NOT NULL").groupBy("url").agg(F.min("depth").alias("depth"))


def frontier_order(spark, at):
    """The whole queue in order."""
    return crawl.frontier_order(_queue(spark, at))


def host_rounds(spark, at):
    return crawl.host_rounds(_queue(spark, at))


def ready_times(spark, at):
    """When each queued address may be fetched, one request of a host at a time."""
    none = fetching.robots_entries(spark.createDataFrame([], "origin string, body string, reason string, retryable boolean, at_ms long"))
    return fetching.ready_times(_queue(spark, at), none)


def robots_entries(spark, at):
    """What the last failure of each origin would mean for its robots file, and until when."""
    log = read_table(spark, at, "crawl_errors")
    retry = crawl.retryable_status(F.col("http_status")) | F.col("reason").isin("timeout", "network")
    origin = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    fetched = log.where("url IS NOT NULL").select(
        origin.alias("origin"), F.lit(None).cast("string").alias("body"), "reason", F.coalesce(retry, F.lit(False)).alias("retryable"), F.unix_millis("last_seen_at").alias("at_ms")
    )
    return fetching.robots_entries(fetched).select("origin", "outcome", "expires_ms")


def retry_delays(spark, at):
    """Waiting times after each logged failure, as if 429 and 503 asked for twenty seconds a level of depth."""
    header = F.when(F.col("http_status").isin(429, 503), (F.col("depth") * 20).cast("string"))
    after = fetching.retry_after_ms(header, F.lit(0.0))
    log = read_table(spark, at, "crawl_errors").where("attempts > 0")
    return log.groupBy("http_status", "attempts", fetching.retry_delay_ms(after, F.col("attempts"), F.lit(0.5)).alias("delay_ms")).agg(F.count("*").alias("n"))


def decode_bodies(spark, at):
    """Every page's text as bytes in one of three charsets, and read back by its header."""
    docs = read_table(spark, at, "documents").select("doc_id", F.coalesce("content_text", F.lit("")).alias("t"))
    kind = F.pmod("doc_id", F.lit(3))
    body = F.when(kind == 0, F.encode("t", "UTF-8")).when(kind == 1, F.encode("t", "UTF-16LE")).otherwise(F.encode("t", "UTF-16BE"))
    header = F.when(kind == 0, "text/html").when(kind == 1, "text/html; charset=utf-16le").otherwise('text/html; charset="UTF-16BE"')
    read = fetching.decode_bodies(docs.select("doc_id", body.alias("body"), header.alias("content_type")))
    return read.select("doc_id", F.md5("text").alias("text"), "charset", "charset_source")


def robots_outcome(spark, at):
    log = read_table(spark, at, "crawl_errors").distinct()
    retry = crawl.retryable_status(F.col("http_status")) | F.col("reason").isin("timeout", "network")
    return log.groupBy(crawl.robots_outcome(F.col("reason"), retry).alias("outcome")).agg(F.count("*").alias("n"))


def retryable_status(spark, at):
    log = read_table(spark, at, "crawl_errors")
    return log.groupBy("http_status", crawl.retryable_status(F.col("http_status")).alias("retryable")).agg(F.count("*").alias("n"))


def robots_verdicts(spark, at):
    """Every document's path against one set of rules for each host."""
    rules = [(True, "/"), (False, "/old/"), (True, "/old/*page"), (False, "/*?page="), (False, "/x/"), (True, "/docs/*"), (False, "/*/archive/")]
    docs = read_table(spark, at, "documents")
    path = F.regexp_extract("url", r"^[a-z]+://[^/]+([^#]*)", 1)
    paths = docs.select(canonical_host(F.col("url")).alias("origin"), path.alias("path")).where("path <> ''")
    origins = paths.select("origin").distinct()
    each = origins.withColumn("r", F.explode(F.array(*[F.struct(F.lit(a).alias("allow"), F.lit(p).alias("pattern"), F.lit(web.robots_pattern(p)).alias("regex")) for a, p in rules])))
    return crawl.robots_verdicts(paths, each.select("origin", "r.*"))


def corpus_rollup(spark, at):
    """Documents by language label and status, with subtotals (an addition)."""
    docs = read_table(spark, at, "documents")
    return docs.rollup("lang", "http_status").agg(F.grouping_id().alias("level"), F.count("*").alias("documents"))


_QUERIES = {
    f.__name__: f
    for f in (
        scan_documents, tokenize, token_offsets, normalize_tokens, stopword_filter, stem_vocab, process_text, process_query, postings, doc_freq,
        doc_lengths, corpus_stats, surface_forms, build_index, corpus_sources, stored_stats, idf, bm25_single, term_postings, bm25_or, bm25_topk,
        bm25_batch, bm25_params, bm25_page, bm25_and, phrase, explain, search_page, snippet_window, snippet_lead, highlight, merge_intervals,
        suggest_split, suggest_stored, url_normalize, tracking_params, clean_text, parse_pages, link_graph, link_graph_bfs, content_hash, dedup_pages,
        outcomes, upsert_documents, crawl_errors, cleared_errors, crawl_summary, frontier_admission, frontier_order, host_rounds, ready_times, robots_entries, retry_delays, decode_bodies, robots_outcome,
        retryable_status, robots_verdicts, corpus_rollup,
    )
} | {"snippets": all_snippets, "suggest": suggest_terms, "canonical_host": hosts}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)
