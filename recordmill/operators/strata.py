"""Matched strata: the largest block of two factors in which every cell has enough rows, and the rows drawn from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from recordmill.operators.ranking import first_of_each, hash_rank

#: Values of the first factor whose subsets are all tried: 2 to this power of them.
MOST_VALUES = 20


def _position(values: list[str], c: Column) -> Column:
    """Place of a value in the order given, from 0; -1 for others."""
    return (F.array_position(F.array(*map(F.lit, values)), c) - 1).cast("int")


def _shifted(one: Column, places: Column) -> Column:
    return F.call_function("shiftleft", one, places)


def cell_counts(rows: DataFrame, first: str, second: str, firsts: list[str], seconds: list[str]) -> DataFrame:
    """(first, second, available) for every cell of both lists, those without rows included; other values and nulls are left out."""
    spark = rows.sparkSession
    grid = spark.range(1).select(F.explode(F.array(*map(F.lit, firsts))).alias(first)).select(first, F.explode(F.array(*map(F.lit, seconds))).alias(second))
    own = rows.groupBy(first, second).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(own, [first, second], "left").select(first, second, F.coalesce("n", F.lit(0)).cast("bigint").alias("available"))


def common_support(cells: DataFrame, first: str, second: str, firsts: list[str], seconds: list[str], target: int) -> DataFrame:
    """One row: the values of each factor (in the orders given) that make the block with most cells, each cell of it with `target` rows at least.

    A block has two values of either factor at least, else both lists are empty. Every subset of the first factor is a bit mask; the widest set of the second
    that goes with it is the bitwise and of what its members support, so only closed sets are met. Among blocks of as many cells the one with more of the first factor wins,
    then with more of the second, then the names that come last in order.
    """
    if len(firsts) > MOST_VALUES or len(seconds) > 62:
        raise ValueError(f"the first factor has more than {MOST_VALUES} values, or the second more than 62")
    held = F.when(F.col("available") >= target, _shifted(F.lit(1).cast("long"), _position(seconds, F.col(second)))).otherwise(0)
    support = cells.groupBy(_position(firsts, F.col(first)).alias("at")).agg(F.bit_or(held).alias("mask"))
    table = support.agg(F.sort_array(F.collect_list(F.struct("at", "mask"))).alias("all"))  # one entry for each value of the first factor
    masks = table.select("all", F.explode(F.sequence(F.lit(0), F.lit((1 << len(firsts)) - 1))).alias("own"))
    member = lambda x: F.col("own").bitwiseAND(_shifted(F.lit(1), x["at"])) != 0
    both = F.aggregate(F.filter("all", member), F.lit((1 << len(seconds)) - 1).cast("long"), lambda a, x: a.bitwiseAND(x["mask"]))
    sets = masks.select("own", both.alias("other")).select("own", "other", F.bit_count("own").alias("n"), F.bit_count("other").alias("m")).where("n >= 2 and m >= 2")

    def names(values: list[str], mask: Column, one: Column) -> Column:
        numbered = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in enumerate(values)])
        return F.transform(F.filter(numbered, lambda x: mask.bitwiseAND(_shifted(one, x["k"])) != 0), lambda x: x["v"])

    named = sets.select("n", "m", names(firsts, F.col("own"), F.lit(1)).alias("a"), names(seconds, F.col("other"), F.lit(1).cast("long")).alias("b"))
    best = named.agg(F.max(F.struct((F.col("n") * F.col("m")).alias("cells"), "n", "m", F.concat("a", "b").alias("names"), "a", "b")).alias("x"))
    none = F.array().cast("array<string>")
    return best.select(F.coalesce("x.a", none).alias("firsts"), F.coalesce("x.b", none).alias("seconds"))


def matched_cells(cells: DataFrame, block: DataFrame, first: str, second: str, target: int) -> DataFrame:
    """cells with in_block, selected (rows that a draw takes), shortage (what the cell lacks for the whole grid) and block_shortage (null outside the block)."""
    inside = F.array_contains("firsts", F.col(first)) & F.array_contains("seconds", F.col(second))
    out = cells.join(F.broadcast(block)).withColumn("in_block", inside)
    lack = F.greatest(F.lit(target) - F.col("available"), F.lit(0)).cast("bigint")
    chosen = F.when(F.col("in_block"), F.least("available", F.lit(target))).otherwise(0).cast("bigint")
    return out.select(first, second, "available", "in_block", chosen.alias("selected"), lack.alias("shortage"), F.when(F.col("in_block"), F.lit(target) - chosen).alias("block_shortage"))


def matched_rows(rows: DataFrame, block: DataFrame, first: str, second: str, key: str, target: int, seed: str) -> DataFrame:
    """The first `target` rows of every cell of the block in hash order of their keys, with rank; a task keeps `target` rows a cell before the shuffle."""
    inside = F.array_contains("firsts", F.col(first)) & F.array_contains("seconds", F.col(second))
    own = rows.join(F.broadcast(block), inside).drop("firsts", "seconds")
    return first_of_each(own.withColumn("__h", hash_rank(seed, F.col(key))), [first, second], [F.col("__h"), F.col(key)], target).drop("__h")


def shared_information(cells: DataFrame, first: str, second: str, count: str) -> DataFrame:
    """(bits): the mutual information of both factors over the cells; 0 without rows."""
    total = cells.agg(F.sum(count).alias("t"))
    by = lambda c, name: cells.groupBy(c).agg(F.sum(count).alias(name))
    every = cells.join(by(first, "__a"), first).join(by(second, "__b"), second).join(F.broadcast(total)).where(F.col(count) > 0)
    return every.agg(F.coalesce(F.sum(F.col(count) / F.col("t") * F.log2(F.col(count) * F.col("t") / (F.col("__a") * F.col("__b")))), F.lit(0.0)).alias("bits"))
