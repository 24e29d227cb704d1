"""Inverted index: tokens, postings, dictionary, lengths and statistics as lazy frames."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodequery.functions.text import (
    MAX_TOKEN_LENGTH, STOPWORDS, TOKEN_PATTERN, fold_plain, fold_token, fold_udf, is_plain, is_stopword, porter_stem, raw_tokens, stem_udf, utf16_length,
)

#: Distinct tokens whose stems a worker keeps.
CACHED_TOKENS = 500_000
_STOP = frozenset(STOPWORDS)


def indexable_text(title: Column, body: Column) -> Column:
    """Title, an empty line, body; nulls count as empty."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit("\n\n"), F.coalesce(body, F.lit("")))


def explode_tokens(docs: DataFrame) -> DataFrame:
    """``doc_id, position, raw``: every token of the indexed text, numbered from 0 in its row (no shuffle).

    Over-long tokens take no number. A token always holds a letter or a digit, so none
    folds to nothing.
    """
    text = indexable_text(F.col("title"), F.col("content_text"))
    return docs.select("doc_id", F.posexplode(raw_tokens(text)).alias("position", "raw"))


def fold_vocabulary(raw: DataFrame) -> DataFrame:
    """``raw, surface`` of distinct tokens; only those beyond Latin-1 letters pass through Python."""
    words = raw.select("raw").where("raw IS NOT NULL").distinct()
    plain = words.where(is_plain(F.col("raw"))).withColumn("surface", fold_plain(F.col("raw")))
    other = words.where(~is_plain(F.col("raw"))).withColumn("surface", fold_udf(F.col("raw")))
    return plain.unionByName(other).where("surface <> ''")


def vocabulary(raw: DataFrame) -> DataFrame:
    """``raw, surface, term``: folding, stop words and stems, once for each distinct token."""
    folded = fold_vocabulary(raw).where(~is_stopword(F.col("surface")))
    return folded.withColumn("term", stem_udf("surface"))


class _Terms(dict):
    """Folded form and stem of raw tokens, None for those that aren't indexed; starts anew when it is full."""

    def __missing__(self, raw: str) -> tuple[str, str] | None:
        if len(self) > CACHED_TOKENS:
            self.clear()
        surface = fold_token(raw)
        value = self[raw] = (surface, porter_stem(surface)) if surface and surface not in _STOP else None
        return value


_terms = _Terms()


def _indexed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array, np.ndarray]:
    """``(row, position, surfaces, terms, term codes)`` of the indexed tokens of a batch (``words``: each document's tokens).

    Every distinct token of the batch is folded and stemmed once.
    """
    words = batch.column("words")
    sizes = np.nan_to_num(words.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    known = [_terms[w] for w in coded.dictionary.to_pylist()]
    code = np.asarray(coded.indices).astype(np.int64)
    row = np.repeat(np.arange(batch.num_rows), sizes)
    position = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    keep = np.array([k is not None for k in known], bool)[code] if known else np.zeros(0, bool)
    surfaces = pa.array([k and k[0] for k in known], pa.string()).dictionary_encode()
    terms = pa.array([k and k[1] for k in known], pa.string()).dictionary_encode()
    code = code[keep]
    which = pa.array(code)
    term_code = np.asarray(terms.indices.fill_null(-1)).astype(np.int64)[code] if len(code) else code
    return row[keep], position[keep].astype(np.int32), surfaces.take(which), terms.take(which), term_code


def _token_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, position, surfaces, terms, _ = _indexed(batch)
        columns = [batch.column("doc_id").take(pa.array(row)), pa.array(position), surfaces.cast(pa.string()), terms.cast(pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "position", "surface", "term"])


def _posting_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, position, _, terms, code = _indexed(batch)
        length = np.bincount(row, minlength=batch.num_rows)
        order = np.lexsort((position, code, row))
        first = np.flatnonzero(np.r_[True, (np.diff(row[order]) != 0) | (np.diff(code[order]) != 0)][: len(order)])
        ends = np.r_[first[1:], len(order)].astype(np.int32) if len(first) else np.zeros(0, np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(order)].astype(np.int32)), pa.array(position[order]))
        at = order[first]
        columns = [
            terms.take(pa.array(at)).cast(pa.string()), batch.column("doc_id").take(pa.array(row[at])), pa.array((ends - first).astype(np.int32)),
            lists, pa.array(length[row[at]].astype(np.int32)),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["term", "doc_id", "tf", "positions", "doc_len"])


def _tally_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        coded = batch.column("words").flatten().dictionary_encode()
        counts = np.bincount(np.asarray(coded.indices), minlength=len(coded.dictionary)) if len(coded) else []
        rows = [(*k, int(n)) for w, n in zip(coded.dictionary.to_pylist(), counts, strict=True) if (k := _terms[w])]
        surface, term, n = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(term, pa.string()), pa.array(surface, pa.string()), pa.array(n, pa.int64())], ["term", "surface", "n"])


def _words(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", raw_tokens(indexable_text(F.col("title"), F.col("content_text"))).alias("words"))


def process_text(docs: DataFrame) -> DataFrame:
    """``doc_id, position, surface, term`` of every indexed token of ``docs`` (``doc_id, title, content_text``), without an exchange."""
    return _words(docs).mapInArrow(_token_batches, "doc_id bigint, position int, surface string, term string")


def postings(docs: DataFrame) -> DataFrame:
    """``term, doc_id, tf, positions, doc_len`` with ascending positions.

    A document is one row, so its postings are made where it is read: nothing is exchanged.
    """
    return _words(docs).mapInArrow(_posting_batches, "term string, doc_id bigint, tf int, positions array<int>, doc_len int")


def doc_freq(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count("*").alias("doc_freq"))


def doc_lengths(docs: DataFrame, posted: DataFrame) -> DataFrame:
    """``doc_id, token_count``; documents without indexed tokens have 0."""
    counted = posted.groupBy("doc_id").agg(F.first("doc_len").alias("n"))
    return docs.select("doc_id").join(counted, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).cast("int").alias("token_count"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row ``total_docs, total_tokens, avg_doc_len``; all 0 for an empty corpus."""
    n, total = F.count("*"), F.coalesce(F.sum(F.col("token_count").cast("long")), F.lit(0).cast("long"))
    return lengths.agg(
        n.alias("total_docs"), total.alias("total_tokens"), F.when(n == 0, 0.0).otherwise(total / n).alias("avg_doc_len")
    )


def surface_forms(docs: DataFrame) -> DataFrame:
    """``term, surface_form``: the most frequent spelling, then the shortest, then the least."""
    tally = _words(docs).mapInArrow(_tally_batches, "term string, surface string, n bigint").groupBy("term", "surface").agg(F.sum("n").alias("n"))
    return tally.groupBy("term").agg(F.min_by("surface", F.struct(-F.col("n"), F.length("surface"), "surface")).alias("surface_form"))


def duplicate_ids(docs: DataFrame) -> DataFrame:
    """Ids that occur more than once; an index must not be built over them."""
    return docs.groupBy("doc_id").count().where("count > 1").select("doc_id")


@dataclass
class Index:
    """The four datasets of an index; ``postings`` carries document lengths so that ranking needs no join."""

    postings: DataFrame
    terms: DataFrame
    lengths: DataFrame
    stats: DataFrame


def build_index(docs: DataFrame, check_ids: bool = True) -> Index:
    """Builds an index over ``doc_id, title, content_text``; duplicate ids are an error."""
    if check_ids and not duplicate_ids(docs).isEmpty():
        raise ValueError("duplicate document ids")
    posted = postings(docs)
    lengths = doc_lengths(docs, posted)
    terms = doc_freq(posted).join(surface_forms(docs), "term", "left")
    return Index(posted, terms, lengths, corpus_stats(lengths))


def _body_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Indexed tokens of the body with their terms, from batches with ``body`` (where it begins)."""
    for batch in batches:
        body = dict(zip(batch.column("doc_id").to_pylist(), batch.column("body").to_pylist(), strict=True))
        for placed in _offset_batches(iter([batch])):
            coded = placed.column("raw").dictionary_encode()
            known = pa.array([k and k[1] for k in (_terms[w] for w in coded.dictionary.to_pylist())], pa.string())
            terms = known.take(coded.indices)
            begins = np.array([body[d] for d in placed.column("doc_id").to_pylist()], np.int64)
            keep = pa.array((np.asarray(placed.column("start")) >= begins) & np.asarray(terms.is_valid()))
            columns = [placed.column("doc_id"), placed.column("start"), placed.column("end"), terms]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "end", "term"]).filter(keep)


def _offset_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths, gaps, fits = (batch.column(c) for c in ("lengths", "gaps", "fits"))
        sizes = np.asarray(lengths.value_lengths()).astype(np.int64)
        row = np.repeat(np.arange(batch.num_rows), sizes)
        starts = np.cumsum(sizes) - sizes
        size = np.asarray(lengths.flatten()).astype(np.int64)
        sums = np.r_[0, np.cumsum(size + np.asarray(gaps.flatten()).astype(np.int64))]
        end = sums[1:] - sums[starts][row] if len(row) else size
        keep = np.asarray(fits.flatten().to_numpy(zero_copy_only=False)).astype(bool)
        counted = np.r_[0, np.cumsum(keep)]
        position = counted[:-1] - counted[starts][row] if len(row) else size
        at = pa.array(np.flatnonzero(keep))
        columns = [
            batch.column("doc_id").take(pa.array(row[keep])), pa.array(position[keep].astype(np.int32)), batch.column("tokens").flatten().take(at),
            pa.array((end - size)[keep].astype(np.int32)), pa.array(end[keep].astype(np.int32)),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "position", "raw", "start", "end"])


def token_offsets(docs: DataFrame) -> DataFrame:
    """``doc_id, position, raw, start, end``: code-point offsets of every token in the indexed text.

    The text splits into tokens and the gaps between them; running sums of their lengths
    inside each row give the offsets, without an exchange.
    """
    return _sized_tokens(docs).mapInArrow(_offset_batches, "doc_id bigint, position int, raw string, start int, end int")


def body_terms(docs: DataFrame) -> DataFrame:
    """``doc_id, start, end, term`` of every indexed token of the body, offsets in the indexed text; ids are unique."""
    return _sized_tokens(docs).mapInArrow(_body_terms, "doc_id bigint, start int, end int, term string")


def _sized_tokens(docs: DataFrame) -> DataFrame:
    text = indexable_text(F.col("title"), F.col("content_text"))
    found = F.regexp_extract_all(F.col("text"), F.lit(TOKEN_PATTERN), F.lit(0))
    body = F.length(F.coalesce("title", F.lit(""))) + 2
    parts = docs.select("doc_id", text.alias("text"), body.alias("body"))
    parts = parts.select("doc_id", "body", found.alias("tokens"), F.split("text", TOKEN_PATTERN, -1).alias("gaps"))
    return parts.select(
        "doc_id", "body", "tokens", F.transform("tokens", F.length).alias("lengths"), F.transform(F.slice("gaps", 1, F.size("tokens")), F.length).alias("gaps"),
        F.transform("tokens", lambda t: utf16_length(t) <= MAX_TOKEN_LENGTH).alias("fits"),
    )
