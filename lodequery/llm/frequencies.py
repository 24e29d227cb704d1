"""Problem 3: occurrences and document counts of all n-grams of the index.

Whole documents are packed into blocks. Each block gets a suffix array over the term
streams of its documents; the intervals of its common-prefix array are the distinct
n-grams, an interval's size is the number of occurrences, and the number of documents
is that size less the suffixes whose predecessor of the same document lies in the same
interval. As no document spans two blocks, sums over blocks are exact: the suffix array
is the combiner before the only exchange of counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodequery.llm.vocabulary import MOST_SPELLINGS, Spellings, spellings, term_groups
from lodequery.session import cut_lineage, default_parallelism

#: Rows of postings that make a block; bounds a worker's memory, never the result.
BLOCK_ROWS = 400_000
COUNT_SCHEMA = "ngram array<bigint>, occurrences bigint, doc_count bigint"
_BREAK = -1


def term_stream(doc: np.ndarray, gid: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents' terms in order of position, repeated occurrences once, a break wherever positions jump."""
    order = np.lexsort((gid, pos, doc))
    doc, gid, pos = doc[order], gid[order], pos[order]
    if not len(doc):
        return doc, gid
    fresh = np.r_[True, (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1]) | (gid[1:] != gid[:-1])]
    doc, gid, pos = doc[fresh], gid[fresh], pos[fresh]
    gap = np.r_[False, (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1)]
    at = np.arange(len(doc)) + np.cumsum(gap)
    out_doc = np.full(at[-1] + 1, _BREAK, np.int64)
    out_gid = np.full(at[-1] + 1, _BREAK, np.int64)
    out_doc[at], out_gid[at] = doc, gid
    return out_doc, out_gid


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first ``depth`` symbols (by prefix doubling), breaks first."""
    _, rank = np.unique(symbols, return_inverse=True)
    rank = rank.astype(np.int64)
    reach = 1
    while reach < depth:
        ahead = np.zeros_like(rank)
        ahead[:-reach] = rank[reach:] + 1
        _, rank = np.unique(rank * (len(rank) + 2) + ahead, return_inverse=True)
        rank = rank.astype(np.int64)
        reach *= 2
    return np.argsort(rank, kind="stable")


def common_prefixes(symbols: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Length, up to ``depth``, that each suffix shares with the one before it."""
    lcp = np.zeros(len(order), np.int64)
    alive = np.ones(max(len(order) - 1, 0), bool)
    for d in range(depth):
        a, b = order[:-1] + d, order[1:] + d
        inside = (a < len(symbols)) & (b < len(symbols))
        x = symbols[np.minimum(a, len(symbols) - 1)]
        alive &= inside & (x == symbols[np.minimum(b, len(symbols) - 1)]) & (x != _BREAK)
        lcp[1:] += alive
    return lcp


def ngram_counts(doc: np.ndarray, symbols: np.ndarray, depth: int):
    """For each length 0..depth: ``(ngrams, occurrences, documents)`` of a block of whole documents."""
    order = suffix_array(symbols, depth)
    order = order[symbols[order] != _BREAK]
    if not len(order):
        return
    lcp = common_prefixes(symbols, order, depth)
    owner = doc[order]
    by_doc = np.argsort(owner, kind="stable")
    before = np.full(len(order), -1)
    same = owner[by_doc[1:]] == owner[by_doc[:-1]]
    before[by_doc[1:][same]] = by_doc[:-1][same]
    for d in range(depth + 1):
        interval = np.cumsum(np.r_[True, lcp[1:] < d]) - 1
        starts = np.flatnonzero(np.r_[True, lcp[1:] < d]) if d else np.array([0])
        if d == 0:
            interval = np.zeros(len(order), np.int64)
        size = np.bincount(interval)
        twice = (before >= 0) & (interval[np.maximum(before, 0)] == interval)
        docs = size - np.bincount(interval[twice], minlength=len(size))
        first = order[starts]
        whole = np.ones(len(first), bool)
        grams = np.empty((len(first), d), np.int64)
        for k in range(d):
            at = np.minimum(first + k, len(symbols) - 1)
            grams[:, k] = symbols[at]
            whole &= (first + k < len(symbols)) & (grams[:, k] != _BREAK)
        yield grams[whole], size[whole], docs[whole]


def _count_blocks(depth: int, spelled):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def spread(batch):
            lists = batch.column("positions")
            docs = np.asarray(batch.column("doc_id"))
            gids = spelled.value.of(np.asarray(batch.column("term_id"))) if spelled is not None else np.asarray(batch.column("gid"))
            known = gids != Spellings.NOTHING
            if not known.all():
                batch = batch.filter(pa.array(known))
                gids = gids[known]
                lists, docs = batch.column("positions"), np.asarray(batch.column("doc_id"))
            tf = np.nan_to_num(batch.column("tf").to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
            sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
            at = np.asarray(lists.flatten().fill_null(0)).astype(np.int64)
            bare = np.where(sizes == 0, np.maximum(tf, 0), 0)  # no positions: apart from each other and all else
            apart = -2 * (np.arange(bare.sum()) - np.repeat(np.cumsum(bare) - bare, bare)) - 2
            return (
                np.r_[np.repeat(docs, sizes), np.repeat(docs, bare)],
                np.r_[np.repeat(gids, sizes), np.repeat(gids, bare)],
                np.r_[at, apart],
            )

        def emit(parts):
            doc, gid, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
            for grams, n, docs in ngram_counts(*term_stream(doc, gid, pos), depth):
                d = grams.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * d), pa.array(grams.ravel()))
                yield pa.RecordBatch.from_arrays([lists, pa.array(n), pa.array(docs)], ["ngram", "occurrences", "doc_count"])

        held, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(spread(batch))
            rows += batch.num_rows
            if rows >= BLOCK_ROWS:
                doc, gid, pos = (np.concatenate(x) for x in zip(*held, strict=True))
                open_ = doc == batch.column("doc_id")[batch.num_rows - 1].as_py()
                if not open_.all():  # the last document may go on
                    yield from emit([(doc[~open_], gid[~open_], pos[~open_])])
                    held, rows = [(doc[open_], gid[open_], pos[open_])], 0
        if held:
            yield from emit(held)

    return run


def _parts(postings: DataFrame) -> int:
    """Partitions for rows with positions: about ``BLOCK_ROWS`` rows each."""
    return max(default_parallelism(postings.sparkSession), postings.count() // BLOCK_ROWS)


def ngram_frequencies(postings: DataFrame, terms: DataFrame, depth: int = 1, groups: DataFrame | None = None) -> DataFrame:
    """``ngram, occurrences, doc_count`` of all runs of up to ``depth`` adjacent indexed terms.

    ``ngram`` holds group ids (see ``term_groups``); the empty one counts all occurrences
    and all documents. Exactly repeated rows count once, as do repeated positions of a
    term; rows without positions count ``tf`` times and adjoin nothing. Rows with a null
    document or an unknown term are left out; empty tables give no rows.
    """
    groups = term_groups(terms) if groups is None else groups
    rows = postings.select("doc_id", "term_id", "tf", "positions").where("doc_id IS NOT NULL AND term_id IS NOT NULL")
    other, shared = spellings(postings, groups), None
    if other.count() <= MOST_SPELLINGS:
        table = other.toPandas()
        shared = postings.sparkSession.sparkContext.broadcast(Spellings(table["term_id"].to_numpy(np.int64), table["gid"].to_numpy(np.int64)))
    else:  # only rows with another spelling need the table; the rest keep their id
        rows = rows.join(other, "term_id", "left").withColumn("gid", F.coalesce("gid", "term_id"))
    together = rows.repartition(_parts(postings), "doc_id").sortWithinPartitions("doc_id")
    blocks = together.mapInArrow(_count_blocks(depth, shared), COUNT_SCHEMA)
    return blocks.groupBy("ngram").agg(F.sum("occurrences").alias("occurrences"), F.sum("doc_count").alias("doc_count"))


def term_frequencies(postings: DataFrame, terms: DataFrame, rare: int = 2, common: float = 0.25) -> DataFrame:
    """``term, occurrences, doc_count, mark`` of every term that has postings.

    ``mark``: ``rare`` up to ``rare`` documents, ``common`` in more than the share
    ``common`` of the documents that have postings, else null.
    """
    groups = term_groups(terms)
    counts = cut_lineage(ngram_frequencies(postings, terms, 1, groups))
    root = counts.where(F.size("ngram") == 0).agg(F.sum("doc_count")).first()[0] or 0
    single = counts.where(F.size("ngram") == 1).select(F.element_at("ngram", 1).alias("gid"), "occurrences", "doc_count")
    names = groups.where("term_id = gid").select("gid", "term")
    mark = F.when(F.col("doc_count") <= rare, "rare").when(F.col("doc_count") > common * root, "common")
    return single.join(names.hint("shuffle_hash"), "gid").select("term", "occurrences", "doc_count", mark.alias("mark"))
