"""BM25 over postings: single queries, batches, pages and explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodequery.functions.text import TOKEN_PATTERN, STOPWORDS, fold_token, porter_stem
from lodequery.operators.index import Index
from lodequery.operators.joins import broadcast_if_small

# The default parameters of the ranking function.
K1, B = 1.2, 0.75


def query_stems(text: str) -> list[str]:
    """Stems of a query in order, duplicates kept."""
    import regex

    words = [fold_token(t) for t in regex.findall(TOKEN_PATTERN, text or "") if len(t.encode("utf-16-le")) // 2 <= 64]
    return [porter_stem(w) for w in words if w and w not in STOPWORDS]


def unique_stems(text: str) -> list[str]:
    return list(dict.fromkeys(query_stems(text)))


def idf(df: Column, n: Column) -> Column:
    """ln(1 + (n - df + 0.5) / (df + 0.5)) with df at most n; 0 where either isn't positive."""
    held = F.least(df, n)
    return F.when((n <= 0) | (df <= 0), 0.0).otherwise(F.ln(1 + (n - held + 0.5) / (held + 0.5)))


def tf_weight(tf: Column, length: Column, average: Column, k1: float = K1, b: float = B) -> Column:
    """Saturated term frequency; an unknown length is taken as the average one."""
    ratio = F.when((length <= 0) | (average <= 0), 1.0).otherwise(length / average)
    return F.when(tf <= 0, 0.0).otherwise(tf * (k1 + 1) / (tf + k1 * (1 - b + b * ratio)))


def bm25(tf: Column, length: Column, df: Column, n: Column, average: Column, k1: float = K1, b: float = B) -> Column:
    return idf(df, n) * tf_weight(tf, length, average, k1, b)


def queries_frame(spark: SparkSession, queries: dict[int, str]) -> DataFrame:
    """``query_id, term, qpos`` of the distinct stems of each query, in order of first occurrence."""
    rows = [(q, s, k) for q, text in queries.items() for k, s in enumerate(unique_stems(text))]
    return spark.createDataFrame(rows, "query_id int, term string, qpos int")


def term_postings(index: Index, wanted: DataFrame) -> DataFrame:
    """``query_id, qpos, term, doc_id, tf, doc_len, doc_freq``: the postings of each query's terms.

    Terms that aren't indexed are left out. The dictionary is cut down to the queries'
    terms first, so both join sides beside the postings are as small as the queries.
    """
    known = wanted.join(index.terms.select("term", "doc_freq"), "term")
    terms = [r.term for r in wanted.select("term").distinct().limit(1001).collect()]
    posted = index.postings.select("term", "doc_id", "tf", "doc_len")
    if 0 < len(terms) <= 1000:
        posted = posted.where(F.col("term").isin(terms))  # reaches the scan of a stored index
    return posted.join(broadcast_if_small(known), "term")


def score(index: Index, wanted: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """``query_id, doc_id, score, matched_terms`` of every document with some query term.

    Contributions are added in query order, so that equal documents tie exactly.
    """
    stats = index.stats.first()
    n, average = F.lit(float(stats.total_docs)), F.lit(float(stats.avg_doc_len))
    part = bm25(F.col("tf"), F.col("doc_len"), F.col("doc_freq"), n, average, k1, b)
    found = term_postings(index, wanted).select("query_id", "doc_id", F.struct("qpos", "term", part.alias("part")).alias("hit"))
    gathered = found.groupBy("query_id", "doc_id").agg(F.sort_array(F.collect_list("hit")).alias("hits"))
    total = F.aggregate("hits", F.lit(0.0), lambda a, x: a + x["part"])
    return gathered.select("query_id", "doc_id", total.alias("score"), F.transform("hits", lambda x: x["term"]).alias("matched_terms"))


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each query with ``rank`` from 1 and the query's ``total`` of candidates.

    Spark keeps ``k`` rows of each query in every task before the exchange.
    """
    totals = scored.groupBy("query_id").agg(F.count("*").alias("total"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc_id"))
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(broadcast_if_small(totals), "query_id")


def page(scored: DataFrame, number: int, size: int) -> DataFrame:
    """One page of a single query's results; past the end it is empty."""
    last = number * size
    ordered = scored.orderBy(F.col("score").desc(), F.col("doc_id")).limit(last)
    order = Window.orderBy(F.col("score").desc(), F.col("doc_id"))  # over at most ``last`` rows
    return ordered.withColumn("rank", F.row_number().over(order)).where(F.col("rank") > last - size)


def explain(index: Index, wanted: DataFrame) -> DataFrame:
    """``query_id, qpos, term, doc_freq, idf`` of every query term; ``doc_freq`` null where it isn't indexed."""
    n = F.lit(float(index.stats.first().total_docs))
    joined = wanted.join(index.terms.select("term", "doc_freq"), "term", "left")
    return joined.select("query_id", "qpos", "term", "doc_freq", idf(F.coalesce("doc_freq", F.lit(0)), n).alias("idf"))


def phrase(index: Index, stems: list[str]) -> DataFrame:
    """``doc_id, start`` of every place where the stems stand one after the other (an addition)."""
    wanted = [(s, k) for k, s in enumerate(stems)]
    if not wanted:
        return index.postings.select("doc_id", F.lit(0).alias("start")).where("false")
    spark = index.postings.sparkSession
    offsets = F.broadcast(spark.createDataFrame(wanted, "term string, shift int"))  # one row for each stem of the query
    places = index.postings.where(F.col("term").isin(stems)).join(offsets, "term")
    starts = places.select("doc_id", "shift", F.explode("positions").alias("p")).select("doc_id", (F.col("p") - F.col("shift")).alias("start"), "shift")
    return starts.groupBy("doc_id", "start").agg(F.count_distinct("shift").alias("n")).where(F.col("n") == len(wanted)).select("doc_id", "start")
