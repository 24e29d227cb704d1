"""Spellings of one term brought together."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodequery.functions.text import fold_plain, fold_udf, is_plain
from lodequery.session import cut_lineage


def term_groups(terms: DataFrame) -> DataFrame:
    """``term_id, gid, term``: the normal form of every term and the least id that shares it.

    Rows without an id, without a term or whose normal form is empty are left out.
    Only terms with characters outside ASCII and Latin-1 letters pass through Python.
    """
    known = terms.select("term_id", F.col("term").alias("raw")).where("term_id IS NOT NULL AND raw IS NOT NULL")
    plain = known.where(is_plain(F.col("raw"))).withColumn("term", fold_plain(F.col("raw")))
    other = known.where(~is_plain(F.col("raw"))).withColumn("term", fold_udf(F.col("raw")))
    folded = plain.unionByName(other).where("term <> ''").select("term_id", "term").distinct()
    least = folded.groupBy("term").agg(F.min("term_id").alias("gid"))
    return cut_lineage(folded.join(least, "term").select("term_id", "gid", "term"))


def with_group(rows: DataFrame, groups: DataFrame, *more: str) -> DataFrame:
    """Rows (``term_id`` and others, without positions) whose term is known, with ``gid``.

    Nothing is broadcast by hint: rows exchanged by term stay where they are, and the
    dictionary comes to them; no side is sorted.
    """
    return rows.join(groups.select("term_id", "gid", *more).hint("shuffle_hash"), "term_id")


#: Most spellings that are broadcast (16 bytes each) to where positions are read.
MOST_SPELLINGS = 4_000_000


class Spellings:
    """Which term ids stand for another one, as sorted arrays; ids that stand for nothing map to ``NOTHING``."""

    NOTHING = -(1 << 62)

    def __init__(self, ids: np.ndarray, gids: np.ndarray):
        order = np.argsort(ids)
        self.ids, self.gids = ids[order], gids[order]

    def of(self, term_ids: np.ndarray) -> np.ndarray:
        if not len(self.ids):
            return term_ids
        at = np.minimum(np.searchsorted(self.ids, term_ids), len(self.ids) - 1)
        return np.where(self.ids[at] == term_ids, self.gids[at], term_ids)


def spellings(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """``term_id, gid`` of the ids whose group has another id, and (``NOTHING``) of ids in postings without a known term."""
    other = groups.where("term_id <> gid").select("term_id", "gid")
    used = postings.select("term_id").where("term_id IS NOT NULL").distinct()
    strange = used.join(groups.select("term_id"), "term_id", "left_anti").select("term_id", F.lit(Spellings.NOTHING).alias("gid"))
    return cut_lineage(other.unionByName(strange))
