"""Fetched bodies and robots files as frames: decoding, retry delays, robots entries that expire, decisions, ready times, whole crawls.

Nothing here opens a connection: bodies come from files or a table that a fetcher wrote.
"""

from __future__ import annotations

from email.utils import parsedate_to_datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lodequery.functions import web
from lodequery.operators import crawl
from lodequery.operators.joins import broadcast_if_small
from lodequery.session import cut_lineage

# attempts' delays, how long robots answers hold, bytes of a body, types of pages and robots files, default delay.
BASE_BACKOFF_MS, MAX_BACKOFF_MS, MAX_RETRY_AFTER_MS = 500, 8_000, 30_000
RULES_TTL_MS, UNREACHABLE_TTL_MS = 24 * 60 * 60 * 1000, 5 * 60 * 1000
MAX_BYTES, MAX_ROBOTS_BYTES = 5 * 1024 * 1024, 512 * 1024
PAGE_TYPES, ROBOTS_TYPES = ("text/html", "application/xhtml+xml"), ("text/plain", "")
DEFAULT_DELAY_MS, MAX_PAGES = 1_000, 100

ENTRY_SCHEMA = "origin string, outcome string, expires_ms long, delay_ms double, sitemaps array<string>, rules array<struct<allow:boolean,pattern:string,regex:string>>"


def content_type(header: Column) -> Column:
    """The type of a Content-Type header in lower case without parameters; empty where there is none."""
    return F.lower(F.trim(F.split_part(F.coalesce(header, F.lit("")), F.lit(";"), F.lit(1))))


@F.pandas_udf(DoubleType())
def _date_ms(value: pd.Series) -> pd.Series:
    def read(text):
        try:
            return parsedate_to_datetime(text).timestamp() * 1000
        except (TypeError, ValueError):
            return None

    return value.map(read, na_action="ignore").astype(float)


def retry_after_ms(header: Column, now_ms: Column) -> Column:
    """Milliseconds that a Retry-After header asks for (seconds or a date), at least 0; null where it says nothing."""
    seconds = F.trim(header).try_cast("double")
    wait = F.coalesce(seconds * 1000, _date_ms(header) - now_ms)
    return F.when(wait.isNotNull() & ~F.isnan(wait), F.greatest(wait, F.lit(0.0)))


def retry_delay_ms(after_ms: Column, attempt: Column, jitter: Column) -> Column:
    """How long to wait before the next attempt; null to give up. ``jitter``: from 0 to 1.

    What the server asks for holds if it isn't too long; else half of a doubling delay, and up to as much again.
    """
    capped = F.least(BASE_BACKOFF_MS * F.pow(F.lit(2.0), attempt - 1), F.lit(float(MAX_BACKOFF_MS)))
    return F.when(after_ms > MAX_RETRY_AFTER_MS, F.lit(None).cast("double")).when(after_ms.isNotNull(), after_ms).otherwise(capped / 2 + jitter * capped / 2)


def read_bodies(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path, body`` of all files below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("content").alias("body"))


def decode_bodies(bodies: DataFrame) -> DataFrame:
    """``bodies`` (``body`` binary, ``content_type`` header) with ``text, charset, charset_source``; a null body gives nulls."""
    kept = [f for f in bodies.schema.fields if f.name != "body"]

    def run(batches):
        for batch in batches:
            rows = [
                web.decode_body(bytes(b), web.charset_of_header(h)) if b is not None else (None, None, None)
                for b, h in zip(batch["body"], batch["content_type"], strict=True)
            ]
            out = batch.drop(columns=["body"])
            for k, name in enumerate(("text", "charset", "charset_source")):
                out[name] = [r[k] for r in rows]
            yield out

    schema = bodies.select(*[f.name for f in kept]).schema.add("text", "string").add("charset", "string").add("charset_source", "string")
    return bodies.mapInPandas(run, schema)


def robots_entries(fetched: DataFrame) -> DataFrame:
    """What each origin's robots file means, and until when (see ``ENTRY_SCHEMA``).

    ``fetched``: ``origin, body`` (text, null on failure), ``reason, retryable, at_ms``. Of
    several answers of one origin the last one holds. An aborted request leaves no entry.
    """
    last = F.max_by(F.struct("body", "reason", "retryable", "at_ms"), F.struct("at_ms", "reason", "retryable"))
    known = fetched.where(F.coalesce(F.col("reason") != "aborted", F.lit(True)) & F.col("origin").isNotNull()).groupBy("origin").agg(last.alias("f")).select("origin", "f.*")
    outcome = F.when(F.col("body").isNotNull(), "rules").otherwise(crawl.robots_outcome(F.col("reason"), F.coalesce("retryable", F.lit(False))))
    ttl = F.when(outcome == "disallow-all", UNREACHABLE_TTL_MS).otherwise(RULES_TTL_MS)

    def run(batches):
        for batch in batches:
            rows = []
            for origin, outcome_, expires, body in zip(batch["origin"], batch["outcome"], batch["expires_ms"], batch["body"], strict=True):
                robots = web.parse_robots(body) if outcome_ == "rules" else {"rules": [], "delay": None, "sitemaps": []}
                rules = [{"allow": a, "pattern": p, "regex": web.robots_pattern(p)} for a, p in robots["rules"]]
                rows.append((origin, outcome_, expires, robots["delay"], robots["sitemaps"], rules))
            yield pd.DataFrame(rows, columns=["origin", "outcome", "expires_ms", "delay_ms", "sitemaps", "rules"])

    judged = known.select("origin", outcome.alias("outcome"), (F.col("at_ms") + ttl).cast("long").alias("expires_ms"), "body")
    return judged.mapInPandas(run, ENTRY_SCHEMA).withColumn("delay_ms", crawl.crawl_delay_ms(F.col("delay_ms")))


def merge_entries(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored entries replaced by fresh ones of the same origin."""
    both = stored.withColumn("turn", F.lit(0)).unionByName(fresh.withColumn("turn", F.lit(1)))
    fields = [c for c in fresh.columns if c != "origin"]
    return both.groupBy("origin").agg(F.max_by(F.struct(*fields), F.col("turn")).alias("e")).select("origin", "e.*")


def robots_decisions(urls: DataFrame, entries: DataFrame, now_ms: int) -> DataFrame:
    """``url, origin, outcome, allowed, delay_ms`` of every address (``url``, normalized).

    ``outcome`` is null, and so is ``allowed``, where no entry holds at ``now_ms``: those
    origins are to be loaded. Joined on the origin; the longest fitting rule decides, allow among equals.
    """
    origin = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    path = F.coalesce(F.nullif(F.regexp_extract("url", r"^https?://[^/?#]+([^#]*)", 1), F.lit("")), F.lit("/"))
    asked = urls.select("url", origin.alias("origin"), path.alias("path")).distinct()
    held = asked.join(broadcast_if_small(entries.where(F.col("expires_ms") > now_ms)), "origin", "left")
    fitting = F.filter("rules", lambda r: F.rlike(F.col("path"), r["regex"]))
    best = F.array_max(F.transform(fitting, lambda r: F.struct(F.length(r["pattern"]).alias("n"), r["allow"].alias("allow"))))
    allowed = F.when(F.col("outcome") == "allow-all", True).when(F.col("outcome") == "disallow-all", False).when(F.col("outcome") == "rules", F.coalesce(best["allow"], F.lit(True)))
    return held.select("url", "origin", "outcome", allowed.alias("allowed"), "delay_ms")


def ready_times(queue: DataFrame, entries: DataFrame, default_ms: int = DEFAULT_DELAY_MS) -> DataFrame:
    """``url, depth, host, round, ready_ms``: when each queued address may be fetched at the earliest, from now on.

    One request of a host at a time, a delay apart: what its robots file asks for, else the default.
    """
    rounds = crawl.host_rounds(queue)
    host = F.regexp_replace(F.lower(F.regexp_extract("origin", r"^https?://([^/:]+)", 1)), r"^www\.", "")
    delays = entries.groupBy(host.alias("host")).agg(F.max("delay_ms").alias("delay_ms"))
    joined = rounds.join(broadcast_if_small(delays), "host", "left")
    return joined.select("url", "depth", "host", "round", (F.col("round") * F.coalesce("delay_ms", F.lit(float(default_ms)))).cast("long").alias("ready_ms"))


def frontier_counters(admitted: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row of how many candidates were enqueued, requeued and turned away for each reason."""
    rows = admitted.join(candidates.select("candidate_id", F.coalesce("requeue", F.lit(False)).alias("requeue")), "candidate_id")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    reasons = {"duplicate": "duplicate", "too_deep": "too-deep", "out_of_scope": "out-of-scope", "invalid_url": "invalid-url", "queue_full": "queue-full", "excluded": "excluded"}
    queued = F.col("reason").isNull()
    return rows.agg(
        count(queued & ~F.col("requeue")).alias("enqueued"), count(queued & F.col("requeue")).alias("requeued"),
        *[count(F.coalesce(F.col("reason") == reason, F.lit(False))).alias(name) for name, reason in reasons.items()],
    )


def hosts_from_seeds(seeds: list[str]) -> list[str]:
    """The hosts of all usable seeds, each once, without ``www.``."""
    parsed = (web.parse_url(s) for s in seeds)
    return list(dict.fromkeys(p[1].removeprefix("www.") for p in parsed if p))


def crawl_stored(fetched: DataFrame, seeds: list[str], hosts: list[str] = (), entries: DataFrame | None = None, max_pages: int = MAX_PAGES,
                 max_depth: int = crawl.MAX_DEPTH, now_ms: int = 0) -> tuple[DataFrame, dict]:
    """A crawl over stored answers: ``(pages, summary)``.

    ``fetched``: ``url`` (normalized), ``status, content_type, body`` (binary). ``pages``: the
    parsed pages with ``depth``. Level by level: what the last level links to is admitted
    (scope, depth, seen), held to the robots ``entries``, fetched, decoded and parsed; the
    crawl stops when nothing is left or ``max_pages`` answers came. In the level where that
    happens the first addresses in order are taken.
    """
    spark = fetched.sparkSession
    allowed = spark.createDataFrame([(h.removeprefix("www."),) for h in dict.fromkeys([*hosts_from_seeds(seeds), *hosts])] or [("",)], "host string")
    asked = spark.createDataFrame([(k, s, 0, False) for k, s in enumerate(seeds)], "candidate_id long, requested string, depth int, requeue boolean")
    seen = spark.createDataFrame([], "url string")
    pages, summary = None, {"stopped_because": "drained", "fetched": 0, "failed": 0, "robots_blocked": 0, "links_discovered": 0, "enqueued": 0, "duplicate": 0, "out_of_scope": 0, "too_deep": 0}
    for depth in range(max_depth + 1):
        verdicts = cut_lineage(crawl.admit(asked, allowed, seen, max_depth))
        for r in verdicts.groupBy("reason").count().collect():
            name = (r["reason"] or "enqueued").replace("-", "_")
            summary[name] = summary.get(name, 0) + r["count"]
        queue = verdicts.where("reason IS NULL").select("url").distinct()
        if queue.isEmpty():
            break
        seen = cut_lineage(seen.unionByName(queue))
        if entries is not None:
            decided = cut_lineage(robots_decisions(queue, entries, now_ms))
            summary["robots_blocked"] += decided.where("NOT allowed").count()
            queue = decided.where("coalesce(allowed, true)").select("url")
        answers = cut_lineage(queue.join(fetched, "url").select("url", "status", "content_type", "body"))
        good = answers.where((F.col("status") < 400) & content_type(F.col("content_type")).isin(*PAGE_TYPES) & (F.length("body") <= MAX_BYTES))
        room = max_pages - summary["fetched"]
        count = good.count()
        if count >= room:
            good, count, summary["stopped_because"] = good.orderBy("url").limit(room), room, "max-pages"
        summary["fetched"] += count
        summary["failed"] += queue.count() - answers.count() + answers.count() - good.count() if summary["stopped_because"] == "drained" else 0
        parsed = cut_lineage(web.parse_pages(decode_bodies(good).select("url", F.col("text").alias("html"))).withColumn("depth", F.lit(depth)))
        pages = parsed if pages is None else pages.unionByName(parsed)
        links = parsed.where("NOT nofollow").select(F.explode("links").alias("requested"))
        links = cut_lineage(links.select("requested").withColumns({"candidate_id": F.monotonically_increasing_id(), "depth": F.lit(depth + 1), "requeue": F.lit(False)}))
        summary["links_discovered"] += links.count()
        if summary["stopped_because"] == "max-pages":
            break
        asked = links
    if pages is None:
        pages = web.parse_pages(spark.createDataFrame([], "url string, html string")).withColumn("depth", F.lit(0))
    return pages, summary
