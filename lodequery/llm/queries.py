"""The training-data queries: ``name -> f(spark, folder)``. Each runs over its whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodequery.llm import abuse, boilerplate, distinctive, encoding, encoding_repair, frequencies, languages, near_duplicates, packing, site_lines
from lodequery.session import cut_lineage, ensure_checkpoint_dir
from lodequery.sources.tables import read_table


def p1_found(spark: SparkSession, at: str) -> DataFrame:
    return distinctive.most_distinctive(
        read_table(spark, at, "postings"), read_table(spark, at, "terms"), read_table(spark, at, "term_checks")
    )


def p1_scores(spark: SparkSession, at: str) -> DataFrame:
    scored = distinctive.term_distinctiveness(read_table(spark, at, "postings"), read_table(spark, at, "terms"))
    return scored.select("doc_id", "term_id", "tf", "doc_freq", "coll_freq", (F.round("score", 6) + 0.0).alias("score"))


def p2_found(spark: SparkSession, at: str) -> DataFrame:
    return near_duplicates.repeated_pairs(read_table(spark, at, "documents"))


def p2_accepted(spark: SparkSession, at: str) -> DataFrame:
    """Which page each page repeats, by batch; null for accepted ones."""
    docs = read_table(spark, at, "documents")
    repeats = near_duplicates.find_repeats(docs)
    return docs.select("doc_id", "batch_id").join(repeats, "doc_id", "left")


def p2_history(spark: SparkSession, at: str) -> DataFrame:
    """The same pairs as they come out in three steps of eight batches, each looked up in the stored tables of those before it."""
    docs = read_table(spark, at, "documents")
    batches = [r.batch_id for r in read_table(spark, at, "crawl_batches").select("batch_id").distinct().orderBy("batch_id").collect()]  # 24 rows
    folder = f"{ensure_checkpoint_dir(spark)}/history-{uuid.uuid4().hex}"
    repeats = near_duplicates.find_in_batches(docs, [batches[k : k + 8] for k in range(0, len(batches), 8)], folder, docs.count())
    return repeats.select(F.least("doc_id", "first").alias("doc_id_a"), F.greatest("doc_id", "first").alias("doc_id_b"))


def p3_terms(spark: SparkSession, at: str) -> DataFrame:
    return frequencies.term_frequencies(read_table(spark, at, "postings"), read_table(spark, at, "terms"))


def p3_found(spark: SparkSession, at: str) -> DataFrame:
    return p3_terms(spark, at).where("mark IS NOT NULL").select("term", "mark")


def p3_phrases(spark: SparkSession, at: str) -> DataFrame:
    """Counts of all runs of up to three indexed terms, by group id."""
    counts = frequencies.ngram_frequencies(read_table(spark, at, "postings"), read_table(spark, at, "terms"), depth=3)
    return counts.select(F.array_join("ngram", " ").alias("ngram"), "occurrences", "doc_count")


def p4_found(spark: SparkSession, at: str) -> DataFrame:
    return languages.wrong_labels(read_table(spark, at, "documents"))


def p4_languages(spark: SparkSession, at: str) -> DataFrame:
    found = languages.page_languages(read_table(spark, at, "documents"))
    return found.select("doc_id", "line_no", "lang", F.round("confidence", 4).alias("confidence"))


def p5_found(spark: SparkSession, at: str) -> DataFrame:
    return boilerplate.boilerplate_lines(read_table(spark, at, "documents"))


def p5_main_text(spark: SparkSession, at: str) -> DataFrame:
    return boilerplate.main_text(read_table(spark, at, "documents"))


def p6_found(spark: SparkSession, at: str) -> DataFrame:
    return encoding_repair.garbled_fields(read_table(spark, at, "documents")).select("doc_id", "field")


def p6_restored(spark: SparkSession, at: str) -> DataFrame:
    return encoding_repair.garbled_fields(read_table(spark, at, "documents"))


def p7_found(spark: SparkSession, at: str) -> DataFrame:
    return site_lines.repeated_line_places(read_table(spark, at, "documents"))


def p7_lines(spark: SparkSession, at: str) -> DataFrame:
    """Repeated lines by site, how often they stand elsewhere, and whether that is a surprise."""
    found = site_lines.repeated_lines(read_table(spark, at, "documents"))
    return found.select("site", "docs", "outside", (F.round("ratio", 4) + 0.0).alias("ratio"), "significant")


def p7_cleaned(spark: SparkSession, at: str) -> DataFrame:
    return site_lines.without_repeated_lines(read_table(spark, at, "documents"))


def p8_ids(spark: SparkSession, at: str) -> DataFrame:
    return encoding.encode_texts(read_table(spark, at, "documents"))


def p9_pack(spark: SparkSession, at: str) -> DataFrame:
    sizes = cut_lineage(encoding.token_counts(read_table(spark, at, "documents")))
    return packing.pack(sizes, read_table(spark, at, "containers"))


def p9_fill(spark: SparkSession, at: str) -> DataFrame:
    """Containers used, and how full they are, by kind."""
    return packing.fill_rates(p9_pack(spark, at), read_table(spark, at, "containers"))


def p10_found(spark: SparkSession, at: str) -> DataFrame:
    return abuse.abusive_documents(read_table(spark, at, "documents"), read_table(spark, at, "labels"))


def p10_rates(spark: SparkSession, at: str) -> DataFrame:
    return abuse.site_rates(read_table(spark, at, "documents"), read_table(spark, at, "labels"))


def p10_scores(spark: SparkSession, at: str) -> DataFrame:
    scored = abuse.abuse_scores(read_table(spark, at, "documents"), read_table(spark, at, "labels"))
    return scored.select("doc_id", F.round("score", 4).alias("score"), F.round("density", 4).alias("density"))


_QUERIES = (
    p1_found, p1_scores, p2_found, p2_accepted, p2_history, p3_found, p3_terms, p3_phrases, p4_found, p4_languages, p5_found, p5_main_text, p6_found, p6_restored,
    p7_found, p7_lines, p7_cleaned, p8_ids, p9_pack, p9_fill,
    p10_found, p10_rates, p10_scores,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}
