"""Arrival of crawled pages: content hashes, duplicates, upserts and the error log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodequery.functions.clean import trim_all
from lodequery.session import cut_lineage

# Least characters of a page's text and most of an error's detail.
LEAST_CHARS, MAX_DETAIL = 1, 500


def content_hash(title: Column, text: Column) -> Column:
    """SHA-256 of title, a line end and text, in hex."""
    return F.sha2(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit(""))), 256)


def classify_pages(pages: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Every arriving page with its ``outcome``: noindex, empty, duplicate, inserted or updated.

    ``pages``: ``url, title, content_text, noindex, arrival`` (unique and ordered);
    ``known``: ``url, content_hash`` of stored documents, each url once. Pages are taken as
    arriving one after the other: a noindex page deletes what its url holds; a page of a url
    that is stored then updates it; else one whose hash any stored document has then is a
    duplicate; else it is inserted. A hash is free again once its last holder was
    deleted or has other content.

    Only ``url``, hash and arrival are exchanged for the verdict; texts join it at the end.
    Whether a page is stored depends on earlier ones alone, so rounds that work out all
    verdicts from those of the round before end after as many as the longest chain of
    pages that depend on one another, mostly two.
    """
    text = trim_all(F.coalesce("content_text", F.lit("")))
    hashed = content_hash(F.col("title"), text)
    base = F.when(F.coalesce("noindex", F.lit(False)), "noindex").when(F.length(text) < LEAST_CHARS, "empty")
    narrow = cut_lineage(pages.select("url", "arrival", hashed.alias("content_hash"), base.alias("outcome")))
    settled = _settled(narrow.where("outcome IS NULL OR outcome = 'noindex'"), known)
    live = settled.where("outcome IS NOT NULL").select("arrival", "content_hash", "outcome")
    verdict = live.unionByName(narrow.where("outcome IS NOT NULL").select("arrival", "content_hash", "outcome"))
    joined = pages.drop("content_hash", "outcome").withColumn("content_text", text).join(verdict, "arrival")
    return joined.select(*[c for c in pages.columns if c not in ("content_hash", "outcome")], "content_hash", "outcome")


def _settled(rows: DataFrame, known: DataFrame | None) -> DataFrame:
    """``arrival, content_hash, outcome`` of pages that aren't empty; ``outcome`` stays null for noindex ones."""
    noindex = F.coalesce(F.col("outcome") == "noindex", F.lit(False))
    events = rows.select("url", "arrival", "content_hash", noindex.alias("delete"), F.lit(1).alias("turn"))
    kind = rows.schema["arrival"].dataType
    if known is not None:  # stored documents come before all arrivals
        held = known.where("url IS NOT NULL").select("url", F.lit(None).cast(kind).alias("arrival"), "content_hash", F.lit(False).alias("delete"), F.lit(0).alias("turn"))
        events = events.unionByName(held)
    first = F.min(F.when(~F.col("delete"), F.struct("turn", "arrival")))
    firsts = events.groupBy("content_hash").agg(first.alias("first"))
    guess = F.coalesce(F.struct("turn", "arrival") == F.col("first"), F.lit(False))
    state = cut_lineage(events.join(firsts, "content_hash").withColumn("stored", ((F.col("turn") == 0) | guess) & ~F.col("delete")).drop("first"))
    by_url = Window.partitionBy("url").orderBy("turn", "arrival")
    acting = F.when(F.col("stored") | F.col("delete"), F.struct("turn", "arrival", "stored"))
    while True:
        before = F.last(acting, ignorenulls=True).over(by_url.rowsBetween(Window.unboundedPreceding, -1))
        after = F.first(acting, ignorenulls=True).over(by_url.rowsBetween(1, Window.unboundedFollowing))
        placed = state.select("*", F.coalesce(before["stored"], F.lit(False)).alias("present"), F.struct(after["turn"].alias("turn"), after["arrival"].alias("arrival")).alias("until"), after.isNull().alias("open"))
        placed = cut_lineage(placed)
        asked = placed.where("turn = 1 AND NOT delete AND NOT present").select("arrival", "content_hash")
        spans = _spans(placed.where("stored").select("content_hash", F.struct("turn", "arrival").alias("since"), "until", "open"))
        at = F.struct(F.lit(1).alias("turn"), F.col("a.arrival"))
        inside = (F.col("s.since") < at) & (F.col("s.open") | (F.col("s.until") >= at))
        taken = asked.alias("a").join(spans.alias("s"), (F.col("a.content_hash") == F.col("s.content_hash")) & inside, "left_semi")
        taken = taken.select("arrival", F.lit(True).alias("taken"))
        again = placed.join(taken, "arrival", "left")
        stored = (F.col("turn") == 0) | (~F.col("delete") & (F.col("present") | F.col("taken").isNull()))
        verdict = again.withColumn("next", stored)
        state = cut_lineage(verdict.withColumn("changed", F.col("next") != F.col("stored")).drop("stored", "until", "open", "taken").withColumnRenamed("next", "stored"))
        if state.where("changed").isEmpty():
            break
        state = state.drop("present", "changed")
    outcome = F.when(F.col("present"), "updated").when(F.col("stored"), "inserted").otherwise("duplicate")
    return state.where("turn = 1").select("arrival", "content_hash", F.when(~F.col("delete"), outcome).alias("outcome"))


def _spans(held: DataFrame) -> DataFrame:
    """The times at which any document holds a hash, as few disjoint spans (``content_hash, since, until, open``)."""
    order = Window.partitionBy("content_hash").orderBy("since")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.coalesce(F.max("open").over(earlier), F.lit(False)) | F.coalesce(F.max(F.when(~F.col("open"), F.col("until"))).over(earlier) >= F.col("since"), F.lit(False))
    island = F.sum(F.when(fresh, 0).otherwise(1)).over(order)
    return held.withColumn("island", island).groupBy("content_hash", "island").agg(F.min("since").alias("since"), F.max("until").alias("until"), F.max("open").alias("open"))


def merge_documents(known: DataFrame, classified: DataFrame) -> DataFrame:
    """Stored documents after a batch: latest page of each url, deletions applied.

    ``token_count`` starts again at 0 where the content changed.
    """
    order = F.struct("arrival")
    fields = ["title", "content_text", "content_hash", "outcome"]
    acted = classified.where("outcome IN ('inserted', 'updated', 'noindex')")
    last = acted.groupBy("url").agg(F.max_by(F.struct(*fields), order).alias("new"))
    both = known.join(last, "url", "full_outer")
    changed = F.col("new").isNotNull()
    same = F.col("content_hash").eqNullSafe(F.col("new.content_hash"))
    merged = both.where(~(changed & (F.col("new.outcome") == "noindex")) | ~changed)
    return merged.select(
        "url",
        F.when(changed, F.col("new.title")).otherwise(F.col("title")).alias("title"),
        F.when(changed, F.col("new.content_text")).otherwise(F.col("content_text")).alias("content_text"),
        F.when(changed, F.col("new.content_hash")).otherwise(F.col("content_hash")).alias("content_hash"),
        F.when(changed & ~same, 0).otherwise(F.coalesce("token_count", F.lit(0))).alias("token_count"),
    )


def merge_errors(log: DataFrame) -> DataFrame:
    """One row for each url: the latest reason, the least depth, all attempts, first and last time.

    Exactly repeated rows count once. Of rows seen last at the same time the one with
    the greatest values decides.
    """
    rows = log.where("url IS NOT NULL").distinct()
    detail = F.substring("detail", 1, MAX_DETAIL)
    latest = F.struct(F.coalesce("last_seen_at", "first_seen_at"), "reason", "http_status", "detail", "depth", "attempts")
    last = F.max_by(F.struct("reason", "http_status", detail.alias("detail")), latest)
    return rows.groupBy("url").agg(
        last.alias("l"),
        F.min("depth").alias("depth"),
        F.sum("attempts").alias("attempts"),
        F.min("first_seen_at").alias("first_seen_at"),
        F.max("last_seen_at").alias("last_seen_at"),
    ).select("url", "l.reason", "l.http_status", "l.detail", "depth", "attempts", "first_seen_at", "last_seen_at")


def clear_errors(errors: DataFrame, stored: DataFrame) -> DataFrame:
    """Errors of addresses that were stored since are dropped: of a page's own address, the requested and the final one.

    ``stored``: ``url`` and, where they are known, ``requested_url`` and ``final_url``.
    """
    names = [c for c in ("url", "requested_url", "final_url") if c in stored.columns]
    done = stored.select(F.explode(F.array(*names)).alias("url")).where("url IS NOT NULL").distinct()
    return errors.join(done, "url", "left_anti")
