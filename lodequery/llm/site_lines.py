"""Problem 7: lines repeated across the documents of one site.

Lines are compared by their letters. Every (site, line) gets the number of documents of
the site that have it; the log-likelihood ratio of that frequency against the line's
frequency outside says how surprising it is, and a false-discovery rate is controlled over
all pairs. A site that repeats a line is one witness for it, not one for each document:
outside, every other site that has the line counts once. So a line that all sites repeat
is still in excess on each of them, while one that stands once on many sites isn't.
Significant lines of at least five documents (the least a case has) are anti-joined, and
documents are reassembled from the lines that are left, by position.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodequery.functions.urls import canonical_host
from lodequery.operators.joins import broadcast_if_small
from lodequery.session import cut_lineage

#: Documents of a site that must have a line.
MIN_DOCS = 5
#: Share of false discoveries among the pairs called significant, and the bins of the ratio.
FALSE_DISCOVERIES, RATIO_BINS, BIN_WIDTH = 0.01, 4000, 0.1


def lines_array(text: Column) -> Column:
    return F.split(text, "\n", -1)


def letters(line: Column) -> Column:
    """Unicode letters in lower case; all else removed."""
    return F.regexp_replace(F.lower(line), r"[^\p{L}]", "")


def line_key(line: Column) -> Column:
    """96 bits of hash of a line's letters; null where there are none."""
    text = letters(line)
    return F.when(text != "", F.struct(F.xxhash64(text).alias("a"), F.hash(text).alias("b")))


def _keyed(docs: DataFrame) -> DataFrame:
    keys = F.transform(lines_array(F.col("content_text")), line_key)
    site = F.coalesce(canonical_host(F.col("url")), F.lit(""))
    asked = docs.where("doc_id IS NOT NULL AND content_text IS NOT NULL")
    return asked.select("doc_id", site.alias("site"), keys.alias("keys"))


def _ratio(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """Log-likelihood ratio of two binomial counts; 0 unless the first rate is the higher one."""

    def part(k: Column, n: Column, p: Column) -> Column:
        return F.when(k > 0, k * F.ln(p)).otherwise(0.0) + F.when(n > k, (n - k) * F.ln(1 - p)).otherwise(0.0)

    both = (k1 + k2) / (n1 + n2)
    gain = 2 * (part(k1, n1, k1 / n1) + part(k2, n2, k2 / n2) - part(k1, n1, both) - part(k2, n2, both))
    return F.when((n2 > 0) & (k1 * n2 > k2 * n1), F.greatest(gain, F.lit(0.0))).otherwise(0.0)


def _least_ratio(ratios: DataFrame, tests: int) -> float:
    """The least ratio at which the share of false discoveries among all ``tests`` stays in bounds (Benjamini and Hochberg)."""
    binned = ratios.groupBy(F.least(F.floor(F.col("ratio") / BIN_WIDTH), F.lit(RATIO_BINS)).alias("bin")).count()
    above, least = 0, math.inf
    for r in sorted(binned.collect(), key=lambda r: -r["bin"]):
        above += r["count"]
        if tests * math.erfc(math.sqrt(r["bin"] * BIN_WIDTH / 2)) <= FALSE_DISCOVERIES * above:
            least = r["bin"] * BIN_WIDTH
    return least


def repeated_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``site, key, docs, outside, ratio, significant`` of every line in at least ``min_docs`` documents of a site.

    The site is the host of ``url``; documents without one form a site of their own.
    A line counts once in a document. ``outside``: other sites that have the line. All
    pairs of a site and a line are tested, those of one document too. Where all documents
    are of one site there is nothing to compare with, and every line counts as significant.
    """
    keyed = _keyed(docs)
    once = keyed.select("site", F.explode(F.array_distinct(F.array_compact("keys"))).alias("key"))
    counts = cut_lineage(once.groupBy("site", "key").agg(F.count("*").alias("docs")))
    sites = docs.where("doc_id IS NOT NULL AND content_text IS NOT NULL")
    sites = sites.groupBy(F.coalesce(canonical_host(F.col("url")), F.lit("")).alias("site")).agg(F.count("*").alias("of"))
    total = sites.agg(F.sum("of")).first()[0] or 0
    everywhere = counts.groupBy("key").agg((F.count("*") - 1).alias("outside"))
    of = broadcast_if_small(cut_lineage(sites))
    ratio = _ratio(F.col("docs").cast("double"), F.col("of").cast("double"), F.col("outside").cast("double"), (total - F.col("of")).cast("double"))

    def rated(pairs: DataFrame) -> DataFrame:
        return pairs.join(everywhere, "key").join(of, "site").select("site", "key", "docs", "outside", ratio.alias("ratio"))

    least = _least_ratio(rated(counts), counts.count())
    alone = sites.limit(2).count() < 2
    return rated(counts.where(f"docs >= {min_docs}")).withColumn("significant", (F.col("ratio") >= least) | F.lit(alone))


def repeated_line_places(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc_id, line_no`` of every line that is significant (see ``repeated_lines``) on the document's site.

    Lines without letters are never cases; null texts have none.
    """
    often = broadcast_if_small(cut_lineage(repeated_lines(docs, min_docs).where("significant").select("site", "key")))
    placed = _keyed(docs).select("doc_id", "site", F.posexplode("keys").alias("line_no", "key")).where("key IS NOT NULL")
    return placed.join(often, ["site", "key"], "left_semi").select("doc_id", "line_no")


def without_repeated_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc_id, content_text`` with the repeated lines taken out; a null text stays null."""
    drop = repeated_line_places(docs, min_docs).groupBy("doc_id").agg(F.collect_set("line_no").alias("drop"))
    joined = docs.select("doc_id", "content_text").join(drop, "doc_id", "left")
    kept = F.filter(lines_array(F.col("content_text")), lambda x, i: ~F.coalesce(F.array_contains("drop", i), F.lit(False)))
    return joined.select("doc_id", F.array_join(kept, "\n").alias("content_text"))
