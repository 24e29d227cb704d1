"""Best windows of text around query terms, with match offsets; highlights.

Everything runs on the documents of a result page, after ranking. Offsets are code
points of the text (title, empty line, body).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodequery.functions.text import utf16_length
from lodequery.operators.index import body_terms, indexable_text
from lodequery.session import cut_lineage

# Snippet length, its least value, how far a word boundary is looked for, and the marks of a cut.
MAX_LENGTH, LEAST_LENGTH, BOUNDARY = 300, 64, 24
PREFIX, SUFFIX = "… ", " …"


def matched_tokens(docs: DataFrame, stems: DataFrame) -> DataFrame:
    """``doc_id, start, end, term`` of body tokens whose term is among the document's ``stems`` (``doc_id, term``)."""
    return body_terms(docs).join(stems.select("doc_id", "term").distinct(), ["doc_id", "term"], "left_semi").select("doc_id", "start", "end", "term")


def best_window(matched: DataFrame, max_length: int = MAX_LENGTH) -> DataFrame:
    """``doc_id, first, last``: the span with most distinct terms, then most matches, then the earliest.

    A window begins at a match and takes all matches that end within ``max_length``.
    """
    ahead = Window.partitionBy("doc_id").orderBy("start").rangeBetween(Window.currentRow, max_length)
    inside = F.filter(F.collect_list(F.struct("start", "end", "term")).over(ahead), lambda x: x["end"] - F.col("start") <= max_length)
    seen = matched.select("doc_id", "start", inside.alias("inside")).select(
        "doc_id",
        "start",
        F.array_max(F.transform("inside", lambda x: x["end"])).alias("last"),
        F.size(F.array_distinct(F.transform("inside", lambda x: x["term"]))).alias("terms"),
        F.size("inside").alias("n"),
    )
    best = F.max_by(F.struct(F.col("start").alias("first"), "last"), F.struct("terms", "n", -F.col("start")))
    return seen.groupBy("doc_id").agg(best.alias("w")).select("doc_id", "w.first", "w.last")


def _char(text: Column, at: Column) -> Column:
    return F.substring(text, at + 1, F.lit(1))


def _blank(char: Column) -> Column:
    return char.isin(" ", "\n")


def _snap_forward(text: Column, at: Column) -> Column:
    """To just after the next blank within reach, unless ``at`` begins a word already."""
    near = F.substring(text, at + 1, F.lit(BOUNDARY))
    gap = F.regexp_instr(near, F.lit("[ \\n]"))
    return F.when(_blank(_char(text, at - 1)), at).when(gap > 0, at + gap).otherwise(at)


def _snap_backward(text: Column, at: Column) -> Column:
    """To the last blank within reach, unless ``at`` ends a word already."""
    reach = F.least(at, F.lit(BOUNDARY))
    near = F.reverse(F.substring(text, at - reach + 1, reach))
    gap = F.regexp_instr(near, F.lit("[ \\n]"))
    return F.when(_blank(_char(text, at)) | (at >= F.length(text)), at).when(gap > 0, at - gap).otherwise(at)


def _trim(text: Column, start: Column, end: Column) -> tuple[Column, Column]:
    part = F.substring(text, start + 1, end - start)
    left = F.length(part) - F.length(F.regexp_replace(part, r"^[ \n]+", ""))
    begin = start + left
    rest = F.regexp_replace(F.substring(text, begin + 1, end - begin), r"[ \n]+$", "")
    return begin, begin + F.length(rest)


def snippets(docs: DataFrame, stems: DataFrame, max_length: int = MAX_LENGTH) -> DataFrame:
    """``doc_id, snippet, matches`` for every document; ``stems`` has ``doc_id, term``.

    Documents without a match in the body show its beginning; an empty body gives an
    empty snippet. ``matches`` are ``start, end`` of the matches wholly inside.
    """
    size = max(max_length, LEAST_LENGTH)
    matched = cut_lineage(matched_tokens(docs, stems))
    found = matched.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("all"))
    text = indexable_text(F.col("title"), F.col("content_text"))
    body = F.length(F.coalesce("title", F.lit(""))) + 2
    rows = docs.select("doc_id", text.alias("text"), body.alias("body")).withColumn("n", F.length("text"))
    rows = rows.join(best_window(matched, size), "doc_id", "left").join(found, "doc_id", "left")
    t, b, n, first, last = (F.col(c) for c in ("text", "body", "n", "first", "last"))
    slack = F.greatest(F.lit(0), size - (last - first))
    rows = rows.withColumn("s", F.greatest(b, first - F.floor(slack / 2).cast("int")))
    rows = rows.withColumn("e", F.least(n, F.col("s") + size)).withColumn("s", F.greatest(b, F.col("e") - size))
    rows = rows.withColumn("s", F.when(F.col("s") > b, F.least(_snap_forward(t, F.col("s")), first)).otherwise(F.col("s")))
    rows = rows.withColumn("e", F.when(F.col("e") < n, F.greatest(_snap_backward(t, F.col("e")), F.least(last, F.col("e")))).otherwise(F.col("e")))
    begin, end = _trim(t, F.col("s"), F.col("e"))
    rows = rows.withColumn("begin", begin).withColumn("finish", end)
    prefix = F.when(F.col("s") > b, PREFIX).otherwise("")
    suffix = F.when(F.col("e") < n, SUFFIX).otherwise("")
    flat = F.translate(F.substring(t, F.col("begin") + 1, F.col("finish") - F.col("begin")), "\n", " ")
    shift = F.length(prefix) - F.col("begin")
    kept = F.filter("all", lambda x: (x["start"] >= F.col("begin")) & (x["end"] <= F.col("finish")))
    spans = F.transform(kept, lambda x: F.struct((x["start"] + shift).cast("int").alias("start"), (x["end"] + shift).cast("int").alias("end")))
    none = F.array().cast("array<struct<start:int,end:int>>")
    lead = lead_of_body(t, b, size)
    return rows.select(
        "doc_id",
        F.when(b >= n, "").when(first.isNull(), lead).otherwise(F.concat(prefix, flat, suffix)).alias("snippet"),
        F.when((b >= n) | first.isNull(), none).otherwise(spans).alias("matches"),
    )


def lead_of_body(text: Column, body: Column, size: int) -> Column:
    """The beginning of the body, cut at a word."""
    n = F.length(text)
    rest = F.substring(text, body + 1, n)
    start = body + F.length(rest) - F.length(F.regexp_replace(rest, r"^[ \n]+", ""))
    cut = start + size < n
    end = F.when(cut, _snap_backward(text, start + size)).otherwise(n)
    shown = F.regexp_replace(F.substring(text, start + 1, end - start), r"[ \n]+$", "")
    return F.concat(F.translate(shown, "\n", " "), F.when(cut, SUFFIX).otherwise(""))


def merge_spans(matches: Column, length: Column) -> Column:
    """Spans clamped to ``0..length``, empty and reversed ones dropped, sorted; overlapping or touching ones merged."""

    def clamp(x: Column) -> Column:
        return F.least(F.greatest(F.coalesce(x, F.lit(0)), F.lit(0)), length).cast("int")

    fixed = F.transform(matches, lambda m: F.struct(clamp(m["start"]).alias("start"), clamp(m["end"]).alias("end")))
    some = F.array_sort(F.filter(fixed, lambda m: m["start"] < m["end"]))
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def add(merged: Column, m: Column) -> Column:
        last = F.try_element_at(merged, F.lit(-1))
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], m["end"]).alias("end"))
        joined = F.concat(F.slice(merged, 1, F.greatest(F.size(merged) - 1, F.lit(0))), F.array(grown))
        return F.when((F.size(merged) > 0) & (m["start"] <= last["end"]), joined).otherwise(F.concat(merged, F.array(m)))

    return F.aggregate(some, empty, add)


def segments(snippet: Column, matches: Column) -> Column:
    """The snippet as ``array<struct<text, highlighted>>``; the texts put together are the snippet again."""
    merged = merge_spans(matches, F.length(snippet))
    kind = "array<struct<text:string,highlighted:boolean>>"
    start = F.struct(F.array().cast(kind).alias("out"), F.lit(0).alias("at"))

    def piece(text: Column, marked: bool) -> Column:
        one = F.array(F.struct(text.alias("text"), F.lit(marked).alias("highlighted")))
        return F.when(F.length(text) > 0, one).otherwise(F.array().cast(kind))

    def step(acc: Column, m: Column) -> Column:
        gap = piece(F.substring(snippet, acc["at"] + 1, m["start"] - acc["at"]), False)
        return F.struct(F.concat(acc["out"], gap, piece(F.substring(snippet, m["start"] + 1, m["end"] - m["start"]), True)).alias("out"), m["end"].alias("at"))

    return F.aggregate(merged, start, step, lambda acc: F.concat(acc["out"], piece(F.substring(snippet, acc["at"] + 1, F.length(snippet)), False)))


def utf16_offsets(text: Column, matches: Column) -> Column:
    """Offsets in code points as offsets in UTF-16 units, which is what browsers count in."""

    def unit(at: Column) -> Column:
        return utf16_length(F.substring(text, F.lit(1), at))

    return F.transform(matches, lambda m: F.struct(unit(m["start"]).alias("start"), unit(m["end"]).alias("end")))


def highlight(snippet: Column, matches: Column, before: str = "[", after: str = "]") -> Column:
    """The snippet with every merged match between marks."""
    merged = merge_spans(matches, F.length(snippet))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, m: Column) -> Column:
        gap = F.substring(snippet, acc["at"] + 1, m["start"] - acc["at"])
        hit = F.substring(snippet, m["start"] + 1, m["end"] - m["start"])
        return F.struct(F.concat(acc["out"], gap, F.lit(before), hit, F.lit(after)).alias("out"), m["end"].alias("at"))

    return F.aggregate(merged, start, step, lambda acc: F.concat(acc["out"], F.substring(snippet, acc["at"] + 1, F.length(snippet))))
