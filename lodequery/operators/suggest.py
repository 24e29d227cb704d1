"""Completion of the last word of an input from the index's spellings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodequery.functions.text import fold_token

# Fixed value: suggestions in an answer. White space includes the no-break spaces and the byte-order mark.
LIMIT = 8
SPACE = r"[\t-\r    -     　﻿]"


def split_input(text: Column) -> tuple[Column, Column]:
    """Everything through the last white space, and the fragment after it."""
    fragment = F.regexp_extract(text, rf"((?:(?!{SPACE})[\s\S])*)$", 1)
    return F.substring(text, F.lit(1), F.length(text) - F.length(fragment)), fragment


def split_text(text: str) -> tuple[str, str]:
    import re

    cut = max((m.end() for m in re.finditer(SPACE, text)), default=0)
    return text[:cut], text[cut:]


def suggest(terms: DataFrame, text: str, limit: int = LIMIT) -> DataFrame:
    """``term, weight``: the head of ``text`` with each completion, best first.

    The fragment is folded, not stemmed; terms without a spelling never complete. The
    prefix filter reaches the scan of a stored index.
    """
    head, fragment = split_text(text)
    prefix = fold_token(fragment)
    spelled = terms.where(F.col("surface_form").isNotNull())
    if not prefix or limit <= 0:
        spelled = spelled.where("false")
    found = spelled.where(F.col("surface_form").startswith(prefix or ""))
    best = found.orderBy(F.col("doc_freq").desc(), F.length("surface_form"), "surface_form").limit(max(limit, 0))
    return best.select(F.concat(F.lit(head), "surface_form").alias("term"), F.col("doc_freq").alias("weight"))


def suggest_batch(terms: DataFrame, inputs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``input_id, rank, term, weight`` for many inputs (``input_id, head, prefix``).

    Terms are spread over their prefixes of the lengths that are asked for, so the join
    is on equal keys.
    """
    asked = inputs.where("prefix <> ''")
    lengths = [r[0] for r in asked.select(F.length("prefix")).distinct().collect()]
    spelled = terms.where("surface_form IS NOT NULL").withColumn("size", F.explode(F.array(*[F.lit(n) for n in sorted(lengths)]) if lengths else F.array().cast("array<int>")))
    keyed = spelled.where(F.length("surface_form") >= F.col("size")).withColumn("prefix", F.substring("surface_form", F.lit(1), F.col("size")))
    joined = keyed.join(asked, "prefix")
    order = Window.partitionBy("input_id").orderBy(F.col("doc_freq").desc(), F.length("surface_form"), "surface_form")
    ranked = joined.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return ranked.select("input_id", "rank", F.concat("head", "surface_form").alias("term"), F.col("doc_freq").alias("weight"))
