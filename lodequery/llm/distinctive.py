"""Problem 1: how distinctive a term is of a document (residual inverse document frequency).

For a term with document frequency df and collection frequency cf among N documents,

    ridf  = -log2(df / N) + log2(1 - exp(-cf / N))
    score = tf * ridf / document length * tf / cf

the observed inverse document frequency less what a Poisson process with the same
collection frequency would give, times the frequency in the document. Words spread
evenly get about 0; words that gather in few documents get much. The last factor, the
share of all occurrences that fall in this document, is added to the plain measure: a
function word of a minority language also gathers in few documents of a mixed index,
and would outdo a document's own term by its sheer frequency.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodequery.llm.vocabulary import term_groups, with_group
from lodequery.operators.joins import broadcast_if_small
from lodequery.session import cut_lineage


def occurrence_count() -> Column:
    """``tf``, or the number of positions where it is missing."""
    return F.coalesce(F.col("tf"), F.size("positions")).cast("long")


def _spelled(postings: DataFrame, key: str) -> DataFrame:
    """``doc_id, term_id, tf``: occurrences of every term id in every document, after one exchange by ``key`` (either of both ids).

    Repeated rows count once (a position of a document holds one term, so the first one
    tells rows apart). Positions themselves aren't exchanged.
    """
    first = F.try_element_at("positions", F.lit(1))
    slim = postings.select("doc_id", "term_id", occurrence_count().cast("int").alias("tf"), first.alias("at"))
    slim = slim.where("tf > 0 AND doc_id IS NOT NULL AND term_id IS NOT NULL")
    once = slim.repartition(key).groupBy("doc_id", "term_id", "tf", "at").agg(F.lit(1).alias("one"))
    return once.groupBy("doc_id", "term_id").agg(F.sum("tf").alias("tf"))


def document_terms(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """``doc_id, gid, tf, term_id``: one row for each document and normalized term.

    Occurrences under several spellings are added up, and ``term_id`` is the spelling with
    most of them (the least id on ties).
    """
    return with_group(_spelled(postings, "term_id"), groups).groupBy("doc_id", "gid").agg(
        F.sum("tf").alias("tf"), F.max_by("term_id", F.struct("tf", -F.col("term_id"))).alias("term_id")
    )


def collection_frequencies(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """``gid, doc_freq, coll_freq`` over all postings, from the same rows as ``document_terms``.

    Rows are exchanged once, by term. Terms of a single spelling are counted there; only
    documents of terms with several are exchanged again, to count each document once.
    """
    several = groups.groupBy("gid").agg(F.count("*").alias("spellings"))
    sized = cut_lineage(groups.join(several, "gid").select("term_id", "gid", (F.col("spellings") > 1).alias("split")))
    rows = with_group(_spelled(postings, "term_id"), sized, "split")
    part = rows.groupBy("gid", F.when(F.col("split"), F.col("doc_id")).alias("doc_id")).agg(F.count("*").alias("n"), F.sum("tf").alias("tf"))
    once = F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(1)
    return part.groupBy("gid").agg(F.sum(once).alias("doc_freq"), F.sum("tf").alias("coll_freq"))


def ridf(df: Column, cf: Column, n: Column) -> Column:
    return -F.log2(df / n) + F.log2(-F.expm1(-cf / n))


def term_distinctiveness(postings: DataFrame, terms: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """``doc_id, term_id, tf, doc_freq, coll_freq, score`` for every document and term.

    ``only``: documents (``doc_id``) to score; frequencies always come from all postings.
    The document's length is the sum of its occurrences (a stored count may have been
    reset). Rows with a null document or term, an unknown term or no occurrences are
    left out; an empty table gives an empty result.
    """
    groups = term_groups(terms)
    asked = postings
    if only is not None:
        ids = only.select("doc_id").where("doc_id IS NOT NULL").distinct()
        asked = postings.join(broadcast_if_small(ids), "doc_id", "left_semi")
    per = document_terms(asked, groups)
    n = postings.where("doc_id IS NOT NULL").select("doc_id").distinct().count()
    stats = collection_frequencies(postings, groups)
    lengths = per.groupBy("doc_id").agg(F.sum("tf").alias("length"))
    scored = per.join(lengths, "doc_id").join(stats, "gid")
    total = F.lit(float(max(n, 1)))
    share = F.col("tf") / F.col("coll_freq")
    value = F.col("tf") * ridf(F.col("doc_freq"), F.col("coll_freq"), total) / F.col("length") * share
    return scored.select("doc_id", "term_id", "tf", "doc_freq", "coll_freq", value.alias("score"), "gid")


def most_distinctive(postings: DataFrame, terms: DataFrame, checks: DataFrame) -> DataFrame:
    """``doc_id, term_id``: the best term of every document asked about; ties go to the least group."""
    scored = term_distinctiveness(postings, terms, only=checks)
    best = F.max_by("term_id", F.struct("score", -F.col("gid")))
    return scored.groupBy("doc_id").agg(best.alias("term_id"))
