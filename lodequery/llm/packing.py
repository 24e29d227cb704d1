"""Problem 9: items into containers of fixed capacity (best-fit decreasing).

Best-fit decreasing treats items of one size alike, so it only needs how many items
there are of each size: at most ``capacity`` numbers, whatever the corpus. The driver
packs these counts with a segment tree over remaining capacities and gets, for every
size, runs of "so many items, so many to a container, from container number k on".
Workers rank the items of each size (in buckets, so that a frequent size is no single
task) and read their container off the runs.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodequery.operators.joins import broadcast_if_small
from lodequery.session import cut_lineage

RUN_SCHEMA = "kind string, size int, runs array<struct<first:bigint,items:bigint,per:int,container:bigint>>, since bigint, until bigint"
#: Runs looked through for an item, and rows of the plan up to which it is broadcast (about a kilobyte each).
RUNS_A_ROW, PLAN_ROWS = 32, 100_000
#: Items of one size ranked in one task, about.
BUCKET_ITEMS = 200_000


class OpenContainers:
    """Open containers by remaining capacity; the tightest that holds a size in logarithmic time."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.leaves)
        self.ranges: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def add(self, remaining: int, first: int, count: int) -> None:
        if count <= 0 or remaining <= 0:
            return
        self.ranges[remaining].append((first, count))
        node = remaining + self.leaves
        while node and not self.any[node]:
            self.any[node] = True
            node //= 2

    def take(self, remaining: int) -> list[tuple[int, int]]:
        node = remaining + self.leaves
        self.any[node] = False
        while node > 1:
            node //= 2
            self.any[node] = self.any[2 * node] or self.any[2 * node + 1]
        return self.ranges.pop(remaining)

    def tightest(self, size: int) -> int | None:
        """The least remaining capacity of an open container that is at least ``size``."""
        if size >= self.leaves:
            return None
        node = size + self.leaves
        if self.any[node]:
            return size
        while node > 1:
            if node % 2 == 0 and self.any[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.any[2 * node] else 2 * node + 1
                return node - self.leaves
            node //= 2
        return None


def pack_counts(counts: dict[int, int], capacity: int) -> tuple[dict[int, list[tuple[int, int, int, int]]], int]:
    """Runs ``(first rank, items, per container, first container)`` by size, and the number of containers."""
    open_, runs, used = OpenContainers(capacity), defaultdict(list), 0
    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        if size <= 0:
            continue
        while left:
            remaining = open_.tightest(size)
            if remaining is None:
                remaining, groups = capacity, [(used, -(-left // (capacity // size)))]
                used += groups[0][1]
            else:
                groups = open_.take(remaining)
            per = remaining // size
            for first, count in groups:
                full = min(count, left // per)
                if full:
                    runs[size].append((rank, full * per, per, first))
                    open_.add(remaining - per * size, first, full)
                    rank, left = rank + full * per, left - full * per
                if left and full < count:  # fewer than fill one container
                    runs[size].append((rank, left, left, first + full))
                    open_.add(remaining - left * size, first + full, 1)
                    rank, full, left = rank + left, full + 1, 0
                open_.add(remaining, first + full, count - full)
    return runs, used


def pieces_of(sizes: DataFrame, containers: DataFrame) -> DataFrame:
    """``kind, doc_id, piece, size``: each item once for every kind, cut where it exceeds the capacity."""
    kinds = [(r.kind, r.capacity) for r in containers.select("kind", "capacity").distinct().collect() if r.kind is not None and (r.capacity or 0) > 0]
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(c).alias("capacity")) for k, c in sorted(kinds)])
    if not kinds:
        return sizes.where("false").selectExpr("'' kind", "doc_id", "0 piece", "0 size")
    spread = sizes.select("doc_id", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.explode(each).alias("c"))
    spread = spread.select("doc_id", "tokens", "c.kind", "c.capacity")
    last = F.greatest(F.expr("CAST(ceil(tokens / capacity) AS INT)") - 1, F.lit(0))
    cut = spread.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    size = F.least(F.col("capacity").cast("long"), F.col("tokens") - F.col("piece").cast("long") * F.col("capacity"))
    return cut.select("kind", "doc_id", "piece", size.cast("int").alias("size"))


def pack(sizes: DataFrame, containers: DataFrame) -> DataFrame:
    """``kind, doc_id, piece, tokens, container_id`` of every item (``doc_id, tokens``) in each kind of container.

    An item longer than the capacity is cut into full containers and a rest; others stay
    whole. Empty items take no room and go to container 0. Items of equal size are
    ordered by id. Kinds without a positive capacity are left out; an empty table gives
    no rows. The driver holds one count for each kind and size, at most the capacity.
    """
    items = pieces_of(sizes, containers)
    total = sizes.count()
    items = items.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(1 + total // BUCKET_ITEMS)).cast("int"))
    counts = items.groupBy("kind", "size", "bucket").count()
    starts = Window.partitionBy("kind", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut_lineage(counts.withColumn("before", F.coalesce(F.sum("count").over(starts), F.lit(0))))
    capacity = {r.kind: r.capacity for r in containers.select("kind", "capacity").distinct().collect()}
    found: dict[str, dict[int, int]] = defaultdict(dict)
    for r in offsets.groupBy("kind", "size").agg(F.sum("count").alias("n")).collect():
        found[r["kind"]][r["size"]] = r["n"]
    rows = [
        (kind, size, [tuple(x) for x in runs])
        for kind, by_size in found.items()
        for size, runs in pack_counts(by_size, capacity[kind])[0].items()
    ]
    # A row for each size up to the capacity; sizes of many runs are cut, so that a row has at most RUNS_A_ROW of them.
    cut = [(kind, size, runs[k : k + RUNS_A_ROW], runs[k][0], runs[min(k + RUNS_A_ROW, len(runs)) - 1]) for kind, size, runs in rows for k in range(0, len(runs), RUNS_A_ROW)]
    cut = [(kind, size, runs, first, last[0] + last[1]) for kind, size, runs, first, last in cut]
    plan = broadcast_if_small(sizes.sparkSession.createDataFrame(cut, RUN_SCHEMA), PLAN_ROWS)
    order = Window.partitionBy("kind", "size", "bucket").orderBy("doc_id", "piece")
    ranked = items.withColumn("rank", F.row_number().over(order) - 1)
    ranked = ranked.join(offsets.drop("count"), ["kind", "size", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    run = F.element_at(F.filter("runs", lambda x: (F.col("rank") >= x["first"]) & (F.col("rank") < x["first"] + x["items"])), 1)
    same = ["kind", "size"]
    fits = [F.col(f"i.{c}") == F.col(f"p.{c}") for c in same] + [F.col("rank") >= F.col("since"), F.col("rank") < F.col("until")]
    joined = ranked.alias("i").join(plan.alias("p"), fits, "left").select("i.*", "runs")
    placed = joined.withColumn("run", run)
    container = F.expr("run.container + (rank - run.first) div run.per")
    return placed.select(
        "kind", "doc_id", "piece", F.col("size").alias("tokens"), F.coalesce(container, F.lit(0)).cast("long").alias("container_id")
    )


def fill_rates(placed: DataFrame, containers: DataFrame) -> DataFrame:
    """``kind, capacity, containers, tokens, fill``: how full the containers of each kind are (``fill`` of 1: no free space)."""
    sizes = containers.select("kind", "capacity").distinct().where("kind IS NOT NULL AND capacity > 0")
    used = placed.where("tokens > 0").groupBy("kind").agg((F.max("container_id") + 1).alias("containers"), F.sum("tokens").alias("tokens"))
    fill = F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6)
    return used.join(sizes, "kind").select("kind", "capacity", "containers", "tokens", fill.alias("fill"))
