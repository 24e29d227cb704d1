"""The search service: pages of results, completions, statistics and health over a published index."""

from __future__ import annotations

import json
import math
import re
import time
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from urllib.parse import quote, unquote_to_bytes, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodequery.functions.text import fold_token
from lodequery.operators import ranking, snippets, suggest
from lodequery.sources import store

# Page sizes, query length, cache bounds and how often the version is looked up.
PAGE_SIZE, MAX_PAGE_SIZE, MAX_QUERY = 10, 50, 200
CACHE_ENTRIES, CACHE_BYTES, CACHE_SECONDS, POLL_SECONDS = 500, 8 * 1024 * 1024, 300, 30
SOURCES = 5


class BadRequest(ValueError):
    """A request that the service doesn't accept."""


@dataclass(frozen=True)
class SearchPage:
    """One page; ``status`` is ok, no-searchable-terms or empty-index."""

    query: str
    status: str
    stems: tuple[str, ...] = ()
    page: int = 1
    page_size: int = PAGE_SIZE
    total: int = 0
    results: tuple[dict, ...] = ()
    stats: dict | None = None


@dataclass
class ResultCache:
    """Least recently read pages go first; pages expire; another version clears all."""

    max_entries: int = CACHE_ENTRIES
    max_bytes: int = CACHE_BYTES
    ttl: float = CACHE_SECONDS
    now: Callable[[], float] = time.monotonic
    version: int | None = None
    _held: OrderedDict = field(default_factory=OrderedDict)
    _bytes: int = 0

    def _sync(self, version: int) -> None:
        if version != self.version:
            self._held.clear()
            self._bytes, self.version = 0, version

    def get(self, key: tuple, version: int) -> SearchPage | None:
        self._sync(version)
        entry = self._held.get(key)
        if entry is None:
            return None
        if entry[1] <= self.now():
            self._drop(key)
            return None
        self._held.move_to_end(key)
        return entry[0]

    def put(self, key: tuple, value: SearchPage, version: int) -> None:
        self._sync(version)
        size = len(json.dumps(value.results, default=str)) + 200
        if size > self.max_bytes:
            return
        self._drop(key)
        self._held[key] = (value, self.now() + self.ttl, size)
        self._bytes += size
        while len(self._held) > self.max_entries or self._bytes > self.max_bytes:
            self._drop(next(iter(self._held)))

    def _drop(self, key: tuple) -> None:
        entry = self._held.pop(key, None)
        if entry:
            self._bytes -= entry[2]

    def __len__(self) -> int:
        return len(self._held)


class CorpusVersion:
    """The published version, read at most once in an interval; a failed read keeps the last one."""

    def __init__(self, read: Callable[[], int], interval: float = POLL_SECONDS, now: Callable[[], float] = time.monotonic):
        self.read, self.interval, self.now = read, interval, now
        self.last: int | None = None
        self.read_at = -math.inf

    def current(self) -> int:
        if self.now() - self.read_at >= self.interval:
            self.read_at = self.now()
            try:
                self.last = self.read()
            except Exception:
                if self.last is None:
                    raise
        if self.last is None:
            raise RuntimeError("the version was never read")
        return self.last


class SearchEngine:
    """Search over the index published under ``root`` and its documents (``doc_id, url, title, content_text``)."""

    def __init__(self, spark: SparkSession, root: str, docs: DataFrame, now: Callable[[], float] = time.monotonic):
        self.spark, self.root, self.docs = spark, root, docs
        self.version = CorpusVersion(lambda: store.current_version(root), now=now)
        self.cache = ResultCache(now=now)
        self._loaded: tuple[int, object] | None = None

    def _index(self, version: int):
        """The index of a version; where it can't be loaded, the one loaded last goes on serving."""
        if self._loaded is None or self._loaded[0] != version:
            try:
                self._loaded = (version, store.load_version(self.spark, self.root, version))
            except Exception:
                if self._loaded is None:
                    raise
        return self._loaded[1]

    def search(self, query: str, page: int = 1, page_size: int = PAGE_SIZE, k1: float = ranking.K1, b: float = ranking.B,
               most: int = MAX_PAGE_SIZE) -> SearchPage:
        text = (query or "").strip()
        if not 1 <= len(text) <= MAX_QUERY or page < 1 or not 1 <= page_size <= most:
            raise BadRequest("query, page or page size out of bounds")
        stems = tuple(ranking.unique_stems(text))
        if not stems:
            return SearchPage(text, "no-searchable-terms", page=page, page_size=page_size)
        version = self.version.current()  # before the query, so that old results never pass for new ones
        key = (stems, page, page_size, k1, b)
        held = self.cache.get(key, version)
        if held is not None:
            return replace(held, query=text)
        found = self._search(text, stems, page, page_size, k1, b, version)
        self.cache.put(key, found, version)
        return found

    def _search(self, text, stems, page, page_size, k1, b, version) -> SearchPage:
        if not version:
            return SearchPage(text, "empty-index", stems, page, page_size, stats={"total_docs": 0, "total_tokens": 0, "avg_doc_len": 0.0})
        index = self._index(version)
        stats = index.stats.first().asDict()
        if not stats["total_docs"]:
            return SearchPage(text, "empty-index", stems, page, page_size, stats=stats)
        wanted = self.spark.createDataFrame([(1, s, k) for k, s in enumerate(stems)], "query_id int, term string, qpos int")
        scored = ranking.score(index, wanted, k1, b).cache()
        try:
            total = scored.count()
            rows = ranking.page(scored, page, page_size).collect()  # a page
        finally:
            scored.unpersist()
        return SearchPage(text, "ok", stems, page, page_size, total, tuple(self._hydrate(rows)), stats)

    def _hydrate(self, rows) -> list[dict]:
        if not rows:
            return []
        docs = self.docs.where(F.col("doc_id").isin([r.doc_id for r in rows]))
        terms = self.spark.createDataFrame([(r.doc_id, t) for r in rows for t in r.matched_terms], "doc_id long, term string")
        shown = {r.doc_id: r for r in docs.join(snippets.snippets(docs, terms), "doc_id").select("doc_id", "url", "title", "snippet", "matches").collect()}
        return [
            {
                "doc_id": r.doc_id, "score": r.score, "url": shown[r.doc_id].url, "title": shown[r.doc_id].title,
                "snippet": shown[r.doc_id].snippet, "matches": [m.asDict() for m in shown[r.doc_id].matches], "matched_terms": list(r.matched_terms),
            }
            for r in rows
            if r.doc_id in shown
        ]

    def search_batch(self, queries: dict[int, str], k: int = PAGE_SIZE, k1: float = ranking.K1, b: float = ranking.B) -> DataFrame:
        """``query_id, rank, doc_id, score, matched_terms, total`` of many queries in one job."""
        index = self._index(self.version.current())
        return ranking.top_k(ranking.score(index, ranking.queries_frame(self.spark, queries), k1, b), k)

    def suggest(self, text: str, limit: int = suggest.LIMIT) -> list[dict]:
        if not 1 <= len(text or "") <= MAX_QUERY:
            raise BadRequest("input out of bounds")
        version = self.version.current()
        if not version or not fold_token(suggest.split_text(text)[1]):
            return []
        return [r.asDict() for r in suggest.suggest(self._index(version).terms, text, limit).collect()]

    def explain(self, query: str) -> list[dict]:
        index = self._index(self.version.current())
        return [r.asDict() for r in ranking.explain(index, ranking.queries_frame(self.spark, {1: query})).orderBy("qpos").collect()]

    def statistics(self) -> dict:
        version = self.version.current()
        stats = self._index(version).stats.first().asDict() if version else {"total_docs": 0, "total_tokens": 0, "avg_doc_len": 0.0}
        host = F.coalesce(F.split_part("url", F.lit("/"), F.lit(3)), F.lit(""))
        top = self.docs.groupBy(host.alias("source")).agg(F.count("*").alias("documents")).orderBy(F.col("documents").desc(), "source").limit(SOURCES)
        return {**stats, "updated_at": version or None, "sources": [r.asDict() for r in top.collect()]}

    def health(self) -> dict:
        checks = {}
        for name, probe in (("session", lambda: self.spark.range(1).count()), ("index", lambda: store.current_version(self.root))):
            try:
                probe()
                checks[name] = "ok"
            except Exception as error:
                checks[name] = str(error)
        return {"status": "ok" if set(checks.values()) == {"ok"} else "degraded", "checks": checks}


def page_slots(page: int, total: int) -> list[int | None]:
    """Numbers shown in a pager, None for a gap: both ends and the neighbours of the page."""
    shown = sorted({p for p in (1, total, page - 1, page, page + 1) if 1 <= p <= total})
    out: list[int | None] = []
    for p in shown:
        if out and p - out[-1] == 2:
            out.append(p - 1)
        elif out and p - out[-1] > 2:
            out.append(None)
        out.append(p)
    return out


def parse_page(raw: str | None) -> int:
    """The page number of an address; 1 for anything that isn't a whole number from 1 on."""
    try:
        value = float((raw or "").strip() or "nan")
    except ValueError:
        return 1
    return int(value) if value >= 1 and value.is_integer() else 1


def readable_url(url: str) -> str:
    """Host, path and query of an address as people read it; the address itself where it can't be taken apart."""
    parts = urlsplit(url)
    if not parts.scheme or not parts.netloc:
        return url
    host = parts.netloc.rsplit("@", 1)[-1].lower().removesuffix({"http": ":80", "https": ":443"}.get(parts.scheme.lower(), ":"))
    shown = f"{parts.path or '/'}{'?' + parts.query if parts.query else ''}"
    try:
        path = re.sub(r"(?:%[0-9a-fA-F]{2})+", lambda m: _decoded(m[0]), shown)
    except UnicodeDecodeError:
        return url
    return host if path == "/" else host + path


def _decoded(escaped: str) -> str:
    """Escaped text; signs that part an address stay escaped."""
    text = unquote_to_bytes(escaped).decode("utf-8")
    return "".join(quote(c, safe="") if c in ";/?:@&=+$,#" else c for c in text)


def total_pages(total: int, size: int) -> int:
    return max(1, math.ceil(total / size))


def describe_empty(found: SearchPage) -> str:
    """What to tell the user when a page has no results."""
    if found.status == "no-searchable-terms":
        return "The query has only common words."
    if found.status == "empty-index":
        return "Nothing is indexed yet."
    return "No more results." if found.total else f"Nothing matches {found.query!r}."
