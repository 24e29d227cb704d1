"""Frontier, scheduling and robots verdicts as relational operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodequery.functions.urls import canonical_host
from lodequery.functions.web import normalize_url_udf
from lodequery.operators.joins import broadcast_if_small
from lodequery.session import cut_lineage

# Depth and queue bounds, retries, politeness.
MAX_DEPTH, MAX_QUEUE, MAX_REQUEUES, MAX_DELAY_MS = 3, 100_000, 2, 30_000


def retryable_status(status: Column) -> Column:
    return F.coalesce((status == 429) | ((status >= 500) & (status != 501)), F.lit(False))


def robots_outcome(reason: Column, retryable: Column) -> Column:
    """What a failed robots request means: no verdict, nothing allowed or all allowed."""
    return (
        F.when(reason == "aborted", F.lit(None).cast("string"))
        .when(reason == "too-large", "disallow-all")
        .when(retryable, "disallow-all")
        .otherwise("allow-all")
    )


def crawl_delay_ms(seconds: Column) -> Column:
    bad = seconds.isNull() | F.isnan(seconds) | (seconds < 0)
    return F.when(~bad, F.least(seconds * 1000, F.lit(float(MAX_DELAY_MS))))


def admit(candidates: DataFrame, allowed_hosts: DataFrame | None = None, seen: DataFrame | None = None, max_depth: int = MAX_DEPTH,
          room: int | None = None) -> DataFrame:
    """``candidate_id, url, depth, reason`` for every requested address, in the order of ``candidate_id``.

    ``candidates``: ``candidate_id, requested, depth, requeue``. ``reason`` is null where
    the address is queued; else the first that holds of invalid-url, too-deep, excluded,
    out-of-scope, queue-full and duplicate. Requeued addresses are never duplicates.
    ``room``: places left in the queue (none given: unbounded).
    """
    distinct = candidates.select("requested").distinct().withColumn("url", normalize_url_udf("requested"))
    rows = candidates.join(cut_lineage(distinct), "requested", "left")
    host = canonical_host(F.col("url"))
    path = F.lower(F.regexp_extract("url", r"^[a-z]+://[^/?#]+([^?#]*)", 1))
    if allowed_hosts is not None:
        rows = rows.withColumn("host", host).join(allowed_hosts.select("host", F.lit(True).alias("inside")).distinct(), "host", "left")
    else:
        rows = rows.withColumn("host", host).withColumn("inside", F.lit(True))
    reason = (
        F.when(F.col("url").isNull(), "invalid-url")
        .when(F.col("depth") > max_depth, "too-deep")
        .when(path == "/robots.txt", "excluded")
        .when(F.col("inside").isNull(), "out-of-scope")
    )
    rows = rows.withColumn("reason", reason)
    if seen is not None:
        rows = rows.join(seen.select("url", F.lit(True).alias("known")).distinct(), "url", "left")
    else:
        rows = rows.withColumn("known", F.lit(None).cast("boolean"))
    requeue = F.coalesce("requeue", F.lit(False))
    earlier = Window.partitionBy("url").orderBy("candidate_id").rowsBetween(Window.unboundedPreceding, -1)
    queued_before = F.coalesce(F.max(F.col("reason").isNull()).over(earlier), F.lit(False))
    again = ~requeue & (F.coalesce("known", F.lit(False)) | queued_before)
    rows = rows.withColumn("again", again)
    if room is not None:
        rows = running_count(rows, F.col("reason").isNull() & ~F.col("again"), ["candidate_id"])
        rows = rows.withColumn("reason", F.when(F.col("reason").isNull() & (F.col("before") >= room), "queue-full").otherwise(F.col("reason")))
    rows = rows.withColumn("reason", F.when(F.col("reason").isNull() & F.col("again"), "duplicate").otherwise(F.col("reason")))
    return rows.select("candidate_id", "url", "depth", "reason")


def frontier_order(queue: DataFrame) -> DataFrame:
    """Queue order: depth, then address."""
    return queue.orderBy("depth", "url")


def running_count(rows: DataFrame, counted: Column, order: list[str], by: list[str] = ()) -> DataFrame:
    """Adds ``before``: how many rows that are ``counted`` come earlier in ``order`` (among equal ``by``).

    Rows are range-partitioned, so a group of any size is spread over tasks: the count
    inside a partition, and the sums of the partitions before it, one row each.
    """
    ranged = rows.withColumn("counted", counted.cast("long")).repartitionByRange(*by, *order)
    placed = cut_lineage(ranged.withColumn("part", F.spark_partition_id()))
    sums = placed.groupBy("part", *by).agg(F.sum("counted").alias("n"))
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sums.withColumn("shift", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    inside = Window.partitionBy("part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.withColumn("inside", F.coalesce(F.sum("counted").over(inside), F.lit(0)))
    keys = [F.col(f"c.{c}").eqNullSafe(F.col(f"s.{c}")) for c in ("part", *by)]
    joined = counts.alias("c").join(broadcast_if_small(cut_lineage(shift)).alias("s"), keys)
    return joined.select(*[f"c.{c}" for c in rows.columns], (F.col("inside") + F.col("shift")).alias("before"))


def host_rounds(queue: DataFrame) -> DataFrame:
    """``url, depth, host, round``: one address of each host in a round, shallow ones first."""
    ranked = running_count(queue.select("url", "depth", canonical_host(F.col("url")).alias("host")), F.lit(1), ["depth", "url"], ["host"])
    return ranked.select("url", "depth", "host", F.col("before").cast("int").alias("round"))


def crawl_levels(seeds: DataFrame, links: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """``url, depth`` of every address reached from ``seeds`` (``url``) over ``links`` (``source, target``).

    One join for each level; the addresses seen so far are written to the shared folder
    after it, so a lost executor costs no earlier level.
    """
    seen = cut_lineage(seeds.select("url").distinct().withColumn("depth", F.lit(0)))
    edge = links.select(F.col("source").alias("url"), "target").distinct()
    for depth in range(1, max_depth + 1):
        last = seen.where(F.col("depth") == depth - 1).select("url")
        reached = edge.join(last, "url", "left_semi").select(F.col("target").alias("url")).distinct()
        fresh = cut_lineage(reached.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth)))
        if fresh.isEmpty():
            break
        seen = seen.unionByName(fresh)
    return seen


def crawl_summary(attempts: DataFrame) -> DataFrame:
    """``reason, urls, attempts, gave_up``: failures by their last reason; given up beyond the retries."""
    return attempts.groupBy("reason").agg(
        F.count_distinct("url").alias("urls"),
        F.sum("attempts").alias("attempts"),
        F.sum((F.col("attempts") > MAX_REQUEUES).cast("int")).alias("gave_up"),
    )


def robots_verdicts(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """``origin, path, allowed``: the longest fitting rule of the origin decides, allow among equals.

    ``rules``: ``origin, allow, pattern, regex`` (see ``robots_pattern``). Joined on the
    origin; paths without a fitting rule are allowed.
    """
    fitting = paths.select("origin", "path").distinct().join(rules, "origin", "left")
    fits = F.expr("path RLIKE regex")
    best = F.max_by(F.col("allow"), F.when(fits, F.struct(F.length("pattern"), F.col("allow").cast("int"))))
    return fitting.groupBy("origin", "path").agg(F.coalesce(best, F.lit(True)).alias("allowed"))
