"""Versioned datasets on shared storage: a folder for each version, and a small file that publishes it at once.

Files go through Hadoop's file systems, so any storage that Spark reads will do. A
version is published by creating a file of its own name, which either happens or
doesn't; the greatest name is the current version.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodequery.operators.index import Index

PUBLISHED = "_PUBLISHED"
_PARTS = ("postings", "terms", "lengths", "stats")
#: Parts that a documents table is kept in; a batch rewrites only those it touches.
BUCKETS = 64
DOCUMENT_SCHEMA = "url string, title string, content_text string, content_hash string, token_count int"


def _files(path: str):
    spark = SparkSession.active()
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _manifest_path(root: str, version: int) -> str:
    return f"{root}/{PUBLISHED}/{version:020d}.json"


def current_version(root: str) -> int:
    """The published version, 0 before the first one."""
    files, at = _files(f"{root}/{PUBLISHED}")
    if not files.exists(at):
        return 0
    names = [s.getPath().getName() for s in files.listStatus(at)]
    return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)


def _manifest(root: str, version: int) -> dict:
    files, at = _files(_manifest_path(root, version))
    stream = files.open(at)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode("utf-8"))
    finally:
        stream.close()


def _publish(root: str, version: int, manifest: dict | None = None) -> None:
    files, at = _files(_manifest_path(root, version))
    stream = files.create(at, False)  # fails if somebody else published it
    try:
        stream.write(json.dumps({"version": version, **(manifest or {})}).encode("utf-8"))
    finally:
        stream.close()


def _next_version(root: str, now_ms: int | None = None) -> int:
    return max(now_ms if now_ms is not None else int(time.time() * 1000), current_version(root) + 1)


def write_index(index: Index, root: str, now_ms: int | None = None) -> int:
    """Writes a new version, checks it and publishes it; a failure leaves the old one in place.

    Postings are sorted by term in ranges, so a query's terms prune row groups.
    """
    version = _next_version(root, now_ms)
    at = f"{root}/v={version}"
    ordered = index.postings.repartitionByRange("term").sortWithinPartitions("term", "doc_id")
    ordered.select("term", "doc_id", "tf", "positions", "doc_len").write.parquet(f"{at}/postings")
    index.terms.repartitionByRange("term").sortWithinPartitions("surface_form").write.parquet(f"{at}/terms")
    index.lengths.write.parquet(f"{at}/lengths")
    index.stats.coalesce(1).write.parquet(f"{at}/stats")
    written = load_version(index.postings.sparkSession, root, version)
    expected = written.terms.agg(F.coalesce(F.sum("doc_freq"), F.lit(0))).first()[0]
    if written.postings.count() != expected:
        raise RuntimeError(f"version {version} isn't consistent; it was not published")
    _publish(root, version)
    return version


def load_version(spark: SparkSession, root: str, version: int) -> Index:
    return Index(*(spark.read.parquet(f"{root}/v={version}/{part}") for part in _PARTS))


def load_index(spark: SparkSession, root: str) -> Index:
    version = current_version(root)
    if not version:
        raise FileNotFoundError(f"no published index under {root}")
    return load_version(spark, root, version)


def bucket_of(url) -> F.Column:
    return F.pmod(F.xxhash64(url), F.lit(BUCKETS)).cast("int")


def _bucket_paths(root: str, manifest: dict, only: list[int] | None = None) -> list[str]:
    return [f"{root}/v={v}/bucket={b}" for b, v in manifest.get("buckets", {}).items() if only is None or int(b) in only]


def documents_manifest(root: str) -> dict:
    """Which version each bucket is of, and the batches applied."""
    version = current_version(root)
    return _manifest(root, version) if version else {"buckets": {}, "batches": []}


def load_documents(spark: SparkSession, root: str, only: list[int] | None = None, manifest: dict | None = None) -> DataFrame:
    """The current documents, or those of some buckets."""
    paths = _bucket_paths(root, documents_manifest(root) if manifest is None else manifest, only)
    return spark.read.schema(DOCUMENT_SCHEMA).parquet(*paths) if paths else spark.createDataFrame([], DOCUMENT_SCHEMA)


def replace_buckets(docs: DataFrame, root: str, buckets: list[int], manifest: dict, batch: str | None = None) -> int:
    """A new version in which ``docs`` take the place of all documents of ``buckets``; other buckets stay as they are."""
    version = _next_version(root)
    at = f"{root}/v={version}"
    docs.withColumn("bucket", bucket_of("url")).repartition(len(buckets), "bucket").write.partitionBy("bucket").parquet(at)
    files, path = _files(at)
    written = {n[7:] for s in files.listStatus(path) if (n := s.getPath().getName()).startswith("bucket=")}
    kept = {b: v for b, v in manifest["buckets"].items() if int(b) not in buckets}
    applied = [*manifest["batches"], *([batch] if batch is not None else [])][-1000:]
    _publish(root, version, {"buckets": kept | dict.fromkeys(written, version), "batches": applied})
    return version
