"""Crawled pages as a stream: each micro-batch is classified and merged into the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodequery.operators import storage
from lodequery.session import cut_lineage
from lodequery.sources import store

PAGE_SCHEMA = "url string, title string, content_text string, noindex boolean, arrival long"


def merge_batch(pages: DataFrame, root: str, batch: str | None = None) -> dict[str, int]:
    """Merges one batch into the documents published under ``root``; the outcomes with their counts.

    Only buckets of addresses that the batch changes are read in full and written again;
    of the others, addresses and hashes are looked at. A batch whose name was applied
    before changes nothing.
    """
    manifest = store.documents_manifest(root)
    if batch is not None and batch in manifest["batches"]:
        return {}
    spark = pages.sparkSession
    classified = cut_lineage(storage.classify_pages(pages, store.load_documents(spark, root, manifest=manifest)))
    outcomes = {r.outcome: r["count"] for r in classified.groupBy("outcome").count().collect()}
    acted = classified.where("outcome IN ('inserted', 'updated', 'noindex')")
    touched = [r.b for r in acted.select(store.bucket_of("url").alias("b")).distinct().collect()]  # BUCKETS at most
    if touched:
        part = store.load_documents(spark, root, touched, manifest)
        store.replace_buckets(storage.merge_documents(part, acted), root, touched, manifest, batch)
    return outcomes


def ingest(spark: SparkSession, source: str, root: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Reads JSON pages that arrive in ``source``; each batch is published as a version of the documents."""
    pages = spark.readStream.schema(PAGE_SCHEMA).json(source)

    def step(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            merge_batch(batch, root, f"{checkpoint}#{number}")

    writer = pages.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def failures_by_window(failures: DataFrame, window: str = "1 hour", lateness: str = "1 day") -> DataFrame:
    """Counts of crawl failures (``last_seen_at, reason``) by event-time window; late rows beyond ``lateness`` are left out."""
    timed = failures.withWatermark("last_seen_at", lateness)
    return timed.groupBy(F.window("last_seen_at", window), "reason").agg(F.count("*").alias("failures"))
