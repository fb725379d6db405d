"""Ranking, caps, sampling and orders by windows and hashes. Every order is total, so results don't depend on partitions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from recordmill.session import checkpoint, stored


def hash_rank(seed: str, *keys: Column) -> Column:
    """SHA-256 of seed and keys: a pseudo-random order that is the same everywhere."""
    return F.sha2(F.concat_ws(":", F.lit(seed), *[k.cast("string") for k in keys]), 256)


def first_of_each(rows: DataFrame, group: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group with their rank from 1. Spark keeps k rows a group and task before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


#: Rows of a group that one task may put in order.
WINDOW_ROWS = 1 << 20
#: Runs (a group in a partition) whose first places are still broadcast.
BROADCAST_RUNS = 100_000


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str = "rank", most: int = WINDOW_ROWS) -> DataFrame:
    """rows with their number from 1 inside their group, by the columns of order, which tell rows of a group apart.

    The largest group is counted first: where no group has more than `most` rows a window numbers them. Otherwise rows are put in order by range, so that a group
    may lie in many partitions, and written; a row's number is its place in its partition, less the first place of its group there, plus what the group has in earlier
    partitions. Only runs of a group in a partition are counted and summed up, and no task orders or holds a group.
    """
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    if (sizes.agg(F.max("n").alias("n")).first()["n"] or 0) <= most:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return numbered_by_range(rows, group, order, name)


def numbered_by_range(rows: DataFrame, group: list[str], order: list[str], name: str = "rank", broadcast_runs: int = BROADCAST_RUNS) -> DataFrame:
    """numbered() for groups of any size."""
    ordered = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    # a place in a partition, once written, stays with its row
    placed = stored(ordered.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "numbered")
    runs = placed.groupBy(*group, "__part").agg(F.min("__at").alias("__from"), F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition that holds some of the group
    runs = checkpoint(runs.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).select(*[F.col(g).alias(f"__{g}") for g in group], F.col("__part").alias("__run"), "__from", "__before"))
    side = F.broadcast(runs) if runs.count() <= broadcast_runs else runs
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group], F.col("__part") == F.col("__run"))
    number = (F.col("__at") - F.col("__from") + F.col("__before") + 1).cast("int")
    return placed.join(side, same).select(*rows.columns, number.alias(name))


def round_robin(rows: DataFrame, outer: list[str], bucket: list[str], order: list[str], most: int = WINDOW_ROWS) -> DataFrame:
    """rows with turn and place: inside each outer group one row of every bucket in turn.

    A row's turn is its number in its bucket (numbered()); its place follows from its turn and the sizes of the group's buckets: what all buckets gave in earlier turns,
    and the buckets up to its own that still give in this one. So no task orders a whole outer group, nor a whole bucket beyond `most` rows.
    """
    sizes = rows.groupBy(*outer, *bucket).agg(F.count(F.lit(1)).alias("__n"))
    lists = sizes.groupBy(*outer).agg(F.collect_list(F.struct(F.struct(*bucket).alias("b"), F.col("__n").alias("n"))).alias("__sizes"))
    turned = numbered(rows, [*outer, *bucket], order, "turn", most).join(lists, outer)
    own, turn = F.struct(*bucket), F.col("turn")
    add = lambda of: F.aggregate(F.transform("__sizes", of), F.lit(0).cast("long"), lambda a, x: a + x)
    before = add(lambda s: F.least(s["n"], turn.cast("long") - 1))
    now = add(lambda s: F.when((s["n"] >= turn) & (s["b"] <= own), 1).otherwise(0).cast("long"))
    return turned.withColumn("place", (before + now).cast("int")).select(*rows.columns, "turn", "place")


def round_robin_limit(rows: DataFrame, outer: list[str], priority: str, bucket: list[str], order: list[str], limit: int) -> DataFrame:
    """The first `limit` rows of each outer group, with place: levels of priority one after the other, in each one row of every bucket in turn.

    No bucket gives more than `limit` rows, so a task keeps that many of each bucket before the shuffle, and of a group what is left is a few buckets of that many.
    """
    some = first_of_each(rows, [*outer, priority, *bucket], [F.col(c) for c in order], limit, "turn")
    return first_of_each(some, outer, [F.col(priority), F.col("turn"), *map(F.col, bucket)], limit, "place").drop("turn")


def coverage_first(rows: DataFrame, strata: list[str], order: list[str]) -> DataFrame:
    """rows with lead: true for the first representative of each stratum by the columns of order, the last of which tells rows apart; sorting by (not lead, order)
    visits all strata first. One least row a stratum, found in the tasks first."""
    first = rows.groupBy(*[F.col(c).alias(f"__{c}") for c in strata]).agg(F.min(F.struct(*order)).alias("__first"))
    joined = rows.join(first, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in strata]))
    return joined.select(*rows.columns, F.struct(*order).eqNullSafe(F.col("__first")).alias("lead"))


def balanced(rows: DataFrame, label: str, cap: int, seed: str, key: str, test_share: float = 0.2) -> DataFrame:
    """As many rows of each label as the smallest label has, cap at most, in hash order; a second hash picks the test share. Tasks keep cap rows a label before the shuffle."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.least(F.lit(cap), F.min("n")).alias("k"))
    capped = first_of_each(rows.withColumn("__h", hash_rank(seed, F.col(key))), [label], [F.col("__h"), F.col(key)], cap, "__r")
    kept = capped.join(F.broadcast(counts)).where(F.col("__r") <= F.col("k"))
    u = F.conv(F.substring(hash_rank(seed + "/test", F.col(key)), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return kept.withColumn("part", F.when(u < test_share, "test").otherwise("train")).drop("__h", "__r", "k")


def quota_selection(rows: DataFrame, kind: str, source: str, quotas: dict[str, int], per_source: int, order: str, forced: Column) -> DataFrame:
    """Rows kept under a quota for each kind and a cap for each source that all kinds share, in the order of kinds given.

    Kinds are taken one after the other; within a kind the cap left to a source is one window and the quota another, so each kind is two windows and no fold.
    Forced rows are kept and count against their source, whatever the quota.
    """
    keep = rows.where(forced).withColumn("why", F.lit("forced"))
    for name, quota in quotas.items():
        used = keep.groupBy(source).agg(F.count(F.lit(1)).alias("__used"))
        own = rows.where((F.col(kind) == name) & ~forced).join(used, source, "left")
        # a task keeps per_source rows a source before the shuffle; of those the cap that is left counts
        own = first_of_each(own, [source], [F.col(order)], per_source, "__s").where(F.col("__s") + F.coalesce("__used", F.lit(0)) <= per_source)
        # the least `quota` rows: a top-n, which no single task gathers
        keep = keep.unionByName(own.orderBy(order).limit(quota).select(*rows.columns, F.lit("quota").alias("why")))
    return keep
