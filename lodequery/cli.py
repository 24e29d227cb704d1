"""Command line: ``crawl``, ``ingest``, ``index``, ``search`` and ``suggest``."""

from __future__ import annotations

import argparse
import json
import sys
import time
from dataclasses import asdict

from pyspark.sql import functions as F

from lodequery.operators import fetching, ranking
from lodequery.operators.crawl import MAX_DEPTH
from lodequery.operators.index import build_index
from lodequery.service import SearchEngine
from lodequery.session import build_session
from lodequery.sources import store
from lodequery.streaming.ingest import ingest

# Fixed value: most results of one call.
MAX_LIMIT = 1000


def _bounded(kind, low, high):
    def read(text):
        value = kind(text)
        if not low <= value <= high:
            raise argparse.ArgumentTypeError(f"must be from {low} to {high}")
        return value

    return read


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lodequery", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    one = sub.add_parser("ingest", help="merge crawled pages (JSON) into the documents")
    one.add_argument("pages")
    one.add_argument("documents")
    one.add_argument("--checkpoint", required=True)
    one = sub.add_parser("crawl", help="crawl stored answers (url, status, content_type, body) from seeds on")
    one.add_argument("answers")
    one.add_argument("pages", help="where the parsed pages go (Parquet)")
    one.add_argument("-s", "--seed", action="append", required=True)
    one.add_argument("--host", action="append", default=[])
    one.add_argument("-m", "--max", type=_bounded(int, 1, 10**9), default=fetching.MAX_PAGES)
    one.add_argument("-d", "--depth", type=_bounded(int, 0, 20), default=MAX_DEPTH)
    one.add_argument("--robots", help="robots entries (Parquet)")
    one = sub.add_parser("index", help="build and publish an index of a documents table")
    one.add_argument("documents")
    one.add_argument("root")
    one.add_argument("--dry-run", action="store_true")
    for name in ("search", "suggest"):
        one = sub.add_parser(name)
        one.add_argument("documents")
        one.add_argument("root")
        one.add_argument("text")
        one.add_argument("--limit", type=_bounded(int, 1, MAX_LIMIT), default=10)
        if name == "search":
            one.add_argument("--page", type=_bounded(int, 1, 10**9), default=1)
            one.add_argument("--k1", type=_bounded(float, 0, 1000), default=ranking.K1)
            one.add_argument("--b", type=_bounded(float, 0, 1), default=ranking.B)
            one.add_argument("--explain", action="store_true")
    return top


def main(args: list[str] | None = None) -> int:
    asked = parser().parse_args(args)
    spark = build_session("lodequery")
    try:
        if asked.command == "ingest":
            ingest(spark, asked.pages, asked.documents, asked.checkpoint).awaitTermination()
            return 0
        if asked.command == "crawl":
            entries = spark.read.parquet(asked.robots) if asked.robots else None
            pages, summary = fetching.crawl_stored(spark.read.parquet(asked.answers), asked.seed, asked.host, entries, asked.max, asked.depth, int(time.time() * 1000))
            pages.write.mode("overwrite").parquet(asked.pages)
            print(json.dumps(summary))
            return 0
        docs = spark.read.parquet(asked.documents)
        if asked.command == "index":
            index = build_index(docs)
            if asked.dry_run:
                print(json.dumps({**index.stats.first().asDict(), "terms": index.terms.count(), "postings": index.postings.count()}))
            else:
                print(store.write_index(index, asked.root))
            return 0
        engine = SearchEngine(spark, asked.root, docs.withColumn("url", F.col("url")))
        if asked.command == "suggest":
            print(json.dumps(engine.suggest(asked.text, asked.limit), ensure_ascii=False))
        elif asked.explain:
            print(json.dumps(engine.explain(asked.text), ensure_ascii=False))
        else:
            print(json.dumps(asdict(engine.search(asked.text, asked.page, asked.limit, asked.k1, asked.b, most=MAX_LIMIT)), ensure_ascii=False))
        return 0
    except KeyboardInterrupt:
        return 130
    except Exception as error:
        print(error, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
