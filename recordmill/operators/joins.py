"""Joins and join-like matching of records, states, cards and predictions."""

from __future__ import annotations

import heapq
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window, functions as F

from recordmill.operators.components import connected_components
from recordmill.operators.ranking import numbered
from recordmill.session import checkpoint

if TYPE_CHECKING:
    import pyarrow as pa


def first_wins(key: str, *tables: DataFrame) -> DataFrame:
    """Union of tables of one schema in which a key's row comes from the first table that has it."""
    ranked = reduce(DataFrame.unionByName, [t.withColumn("__rank", F.lit(i)) for i, t in enumerate(tables)])
    cols = [c for c in ranked.columns if c not in (key, "__rank")]
    return ranked.groupBy(key).agg(F.min_by(F.struct(*cols), F.struct("__rank", *cols)).alias("r")).select(key, "r.*")


def merge_checked(key: str, *tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged, conflicts): identical duplicates collapse; keys with different payloads are conflicts and stay out of merged."""
    every = reduce(DataFrame.unionByName, tables)
    cols = [c for c in every.columns if c != key]
    per = every.groupBy(key).agg(F.count_distinct(F.xxhash64(*cols)).alias("n"), F.first(F.struct(*cols)).alias("r"))
    return per.where("n = 1").select(key, "r.*"), per.where("n > 1").select(key, F.col("n").alias("n_payloads"))


def missing_keys(facts: DataFrame, dimension: DataFrame, fact_key: str, dim_key: str) -> DataFrame:
    """Fact rows whose key the dimension lacks."""
    return facts.join(dimension.select(F.col(dim_key).alias(fact_key)), fact_key, "left_anti")


def contrast_pairs(rows: DataFrame, group: list[str], item: str, differ: str, label: str) -> DataFrame:
    """Per group of equal keys: rows, unordered pairs, and those pairs that differ in `differ` and in `label`.

    Counted from group sizes, not by pairing rows: all pairs, less those equal in either, plus those equal in both.
    """
    pairs = lambda n: n * (n - 1) / 2
    cell = rows.groupBy(*group, differ, label).agg(F.count(item).alias("n"))
    both = cell.groupBy(*group).agg(F.sum("n").alias("n_rows"), F.sum(pairs(F.col("n"))).alias("same_both"))
    one = lambda c, name: cell.groupBy(*group, c).agg(F.sum("n").alias("n")).groupBy(*group).agg(F.sum(pairs(F.col("n"))).alias(name))
    out = both.join(one(differ, "same_differ"), group).join(one(label, "same_label"), group)
    every = pairs(F.col("n_rows"))
    return out.select(*group, "n_rows", every.cast("bigint").alias("n_pairs"), (every - F.col("same_differ") - F.col("same_label") + F.col("same_both")).cast("bigint").alias("n_contrast"))


def partition_check(whole: DataFrame, parts: list[DataFrame], key: str) -> DataFrame:
    """(n_whole, n_parts, n_missing, n_foreign, n_twice, is_partition) of parts against the whole: keys that no part has, that only parts have, and that stand in the parts more than once."""
    side = lambda t, w: t.select(F.col(key).alias("k"), F.lit(w).alias("w"))
    every = reduce(DataFrame.unionAll, [side(whole, 1), *[side(p, 0) for p in parts]])
    per = every.groupBy("k").agg(F.sum("w").alias("w"), F.count_if(F.col("w") == 0).alias("p"))
    n = lambda c: F.count_if(c)
    c = per.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("n_whole"), F.coalesce(F.sum("p"), F.lit(0)).alias("n_parts"), n((F.col("w") > 0) & (F.col("p") == 0)).alias("n_missing"), n(F.col("w") == 0).alias("n_foreign"), n(F.col("p") > 1).alias("n_twice"))
    return c.withColumn("is_partition", (F.col("n_missing") == 0) & (F.col("n_foreign") == 0) & (F.col("n_twice") == 0))


def contrast_scores(rows: DataFrame, group: list[str], item: str, differ: str, label: str, pred: str) -> DataFrame:
    """Per group: its contrast pairs, those of them in which both predictions are right, and those in which both are the same. From group sizes too: pairs of right rows
    are contrast pairs of the right rows alone, and pairs of one prediction those of its rows."""
    every = contrast_pairs(rows, group, item, differ, label).select(*group, "n_contrast")
    right = contrast_pairs(rows.where(F.col(label) == F.col(pred)), group, item, differ, label).select(*group, F.col("n_contrast").alias("n_both_right"))
    same = contrast_pairs(rows, [*group, pred], item, differ, label).groupBy(*group).agg(F.sum("n_contrast").alias("n_same_prediction"))
    return every.join(right, group, "left").join(same, group, "left").fillna(0, ["n_both_right", "n_same_prediction"])


def row_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, status): only_left, only_right, changed or equal, and the names of changed columns."""
    cols = [c for c in a.columns if c != key]
    j = a.withColumn("__l", F.lit(1)).alias("a").join(b.withColumn("__r", F.lit(1)).alias("b"), key, "full_outer")
    changed = F.concat_ws(",", *[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in cols])
    status = F.when(F.col("__r").isNull(), "only_left").when(F.col("__l").isNull(), "only_right").when(changed != "", "changed").otherwise("equal")
    return j.select(key, status.alias("status"), F.when(status == "changed", changed).alias("columns"))


def provenance_components(records: DataFrame, id_col: str, keys: list[Column]) -> DataFrame:
    """(id, component): records that share the value of any key, directly or through others. Null keys link nothing.

    A key's records are tied to its least record, so a key that many share is one partial aggregation, not pairs.
    """
    long = reduce(DataFrame.union, [records.select(F.col(id_col).alias("id"), F.lit(i).alias("k"), k.cast("string").alias("v")) for i, k in enumerate(keys)]).where("v IS NOT NULL")
    least = long.groupBy("k", "v").agg(F.min("id").alias("low"))
    edges = long.join(least, ["k", "v"]).select(F.col("id").alias("src"), F.col("low").alias("dst"))
    comps = connected_components(checkpoint(edges))
    ids = records.select(F.col(id_col).alias("id")).distinct()
    return ids.join(comps, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("component"))


#: Rows of a group that one task matches at once.
MATCHED_ROWS = 1 << 17


def _settled(x: list[float], side: list[bool], ids: list[int], below: float | None, above: float | None) -> list[tuple[int, int]]:
    """Positions (wanted, offered) that pair up among rows of a stretch of the line, in the order of x; below and above are the nearest values outside, none at the ends of the line.

    Values are levels, each with its free rows of either side by id; levels that are next to each other and hold different sides are candidates, and the closest candidate (least ids among
    equals) settles, again and again. A candidate waits if a value outside may be as near to one of its levels, or if an earlier one that waits shares a level with it.
    """
    at: dict[float, int] = {}
    levels: list[float] = []
    free: list[tuple[list, list]] = []
    for k, v in enumerate(x):
        if v not in at:
            at[v] = len(levels)
            levels.append(v)
            free.append(([], []))
        free[at[v]][side[k]].append((ids[k], k))
    for pair in free:
        for own in pair:
            own.sort(reverse=True)  # the least id is at the end
    n, out = len(levels), []
    waits = {k for k in range(n) if levels[k] in (below, above)}  # of a level that goes on outside the least ids may be there
    for k, (w, o) in enumerate(free):
        while w and o and k not in waits:
            out.append((w.pop()[1], o.pop()[1]))
    alive = [k for k in range(n) if free[k][0] or free[k][1]]
    after = dict(zip(alive, alive[1:]))
    before = {b: a for a, b in after.items()}
    agenda: list[tuple] = []

    def offer(a: int | None, b: int | None) -> None:
        if a is None or b is None or not (free[a][0] and free[b][1] or free[a][1] and free[b][0]):
            return
        w, o = (a, b) if free[a][0] and free[b][1] else (b, a)
        heapq.heappush(agenda, (levels[b] - levels[a], free[w][0][-1][0], free[o][1][-1][0], a, b, w, o))

    for a in alive:
        offer(a, after.get(a))
    while agenda:
        d, wid, oid, a, b, w, o = heapq.heappop(agenda)
        if not free[w][0] or not free[o][1] or free[w][0][-1][0] != wid or free[o][1][-1][0] != oid or after.get(a) != b:
            continue
        near = (below is not None and levels[a] - below <= d) or (above is not None and above - levels[b] <= d)
        if near or a in waits or b in waits:
            waits |= {a, b}
            continue
        out.append((free[w][0].pop()[1], free[o][1].pop()[1]))
        for k in (a, b):
            if not free[k][0] and not free[k][1]:
                left, right = before.pop(k, None), after.pop(k, None)
                if left is not None:
                    after.pop(left, None)
                    if right is not None:
                        after[left] = right
                if right is not None:
                    before.pop(right, None)
                    if left is not None:
                        before[right] = left
                # a stretch whose end has gone has the next level for its end; what lies outside is as near to that as it was
                offer(left, right)
            else:
                offer(before.get(k), k)
                offer(k, after.get(k))
    return out


def _same_value(rows: DataFrame, group: list[str]) -> tuple[DataFrame, DataFrame]:
    """(pairs, rest): wanted and offered rows of one value pair up in the order of their ids; of each value one side at most is left. Values that many rows share are numbered, not gathered."""
    level = [*group, "x"]
    n = rows.groupBy(*level).agg(F.least(F.count_if("side"), F.count_if(~F.col("side"))).alias("n")).select(*[F.col(c).alias(f"__{c}") for c in level], "n")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in level])
    placed = checkpoint(numbered(rows, [*level, "side"], ["id"], "k").join(n, same).select(*rows.columns, "k", "n"))
    on = lambda side, name: placed.where((F.col("k") <= F.col("n")) & (F.col("side") == side)).select(*[F.col(c).alias(f"{name}_{c}") for c in [*level, "k"]], F.col("id").alias(name))
    both = on(False, "w").join(on(True, "o"), reduce(lambda a, b: a & b, [F.col(f"w_{c}").eqNullSafe(F.col(f"o_{c}")) for c in [*level, "k"]]))
    return both.select("w", "o", F.lit(0.0).alias("distance")), placed.where(F.col("k") > F.col("n")).select(*rows.columns)


def nearest_unused(wanted: DataFrame, offered: DataFrame, group: list[str], value: str, id_col: str, rounds: int | None = None, most: int = MATCHED_ROWS) -> DataFrame:
    """(w, o, distance): each wanted row takes the free offered row of its group that is nearest by value; none is used twice.

    Pairs settle as if the closest free pair of a group (the least wanted id, then the least offered id among equals) were taken again and again. Rows of the same value pair first. Then a round puts the rows of each group
    in order and cuts them to blocks of `most`; a task settles what it can inside its block, and leaves what rows beyond its ends might come before. Blocks of the next round hold what is left,
    half a block further on, so what waited at a seam lies inside one. A chain in which each pair waits for the one before it moves on by half a block a round at least.
    Only where nothing settles, as more rows than a block share a value, blocks become twice as large.
    Rows without a value and groups with one side only take no part. If a bound on rounds is given and reached, this raises.
    """
    sided = lambda t, side: t.select(*group, F.col(value).cast("double").alias("x"), F.lit(side).alias("side"), F.col(id_col).cast("long").alias("id"))
    rows = checkpoint(sided(wanted, False).unionByName(sided(offered, True)).where("x IS NOT NULL AND NOT isnan(x)"))
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    names = rows.columns
    first, rows = _same_value(rows, group)
    done = [first]

    def run(block: "pa.Table") -> "pa.Table":
        import pyarrow as pa

        block = block.sort_by("rank")
        below, above = block.column("below")[0].as_py(), block.column("above")[0].as_py()
        ids = block.column("id").to_pylist()
        x = block.column("x").to_pylist()
        found = _settled(x, block.column("side").to_pylist(), ids, below, above)
        taken = {k for pair in found for k in pair}
        kept = [k for k in range(block.num_rows) if k not in taken] + [w for w, _ in found]
        none = [None] * (block.num_rows - len(taken))
        out = block.select(names).take(pa.array(kept, pa.int64()))
        return out.append_column("o", pa.array(none + [ids[o] for _, o in found], pa.int64())).append_column("distance", pa.array(none + [abs(x[w] - x[o]) for w, o in found], pa.float64()))

    n = 1  # equal values were the first
    while True:
        both = rows.groupBy(*group).agg(F.bool_or("side").alias("a"), F.bool_or(~F.col("side")).alias("b")).where("a AND b").select(*[F.col(g).alias(f"__{g}") for g in group])
        same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group], F.lit(True))
        rows = checkpoint(rows.join(both, same, "left_semi"))
        if rows.isEmpty():
            break
        if rounds is not None and n >= rounds:
            raise RuntimeError("nearest_unused did not settle")
        placed = numbered(rows, group, ["x", "side", "id"], "rank")
        placed = checkpoint(placed.withColumn("block", F.floor((F.col("rank") + (n % 2) * (most // 2)) / most).cast("long")))
        ends = placed.groupBy(*group, "block").agg(F.min("x").alias("low"), F.max("x").alias("high"))
        order = Window.partitionBy(*group).orderBy("block")  # a row for each block
        ends = ends.withColumns({"below": F.lag("high").over(order), "above": F.lead("low").over(order)}).select(*[F.col(g).alias(f"__{g}") for g in group], F.col("block").alias("__block"), "below", "above")
        known = placed.join(ends, same & (F.col("block") == F.col("__block"))).select(*placed.columns, "below", "above")
        after = checkpoint(known.groupBy(*group, "block").applyInArrow(run, f"{cols}, o long, distance double"))
        taken = after.where("o IS NOT NULL")
        most *= 2 if taken.isEmpty() else 1
        done.append(taken.select(F.col("id").alias("w"), "o", "distance"))
        rows = after.where("o IS NULL").select(*names)
        n += 1
    return reduce(DataFrame.unionByName, done)


def tiered_nearest(wanted: DataFrame, offered: DataFrame, tiers: list[tuple[str, list[str], str | None]], id_col: str) -> DataFrame:
    """(wanted, offered, tier): each wanted row takes a free offered row in the first tier that has one for it; none is used twice.

    A tier is a name, the columns in which both rows must agree, and the value by which they should be near (none: any will do, in the order of ids). Tiers go
    from narrow to wide, so that rows with an exact partner keep it from those that are content with less; within a tier pairs settle as in nearest_unused().
    """
    left, free, done = wanted, offered, []
    for name, group, value in tiers:
        near = [x if value else x.withColumn("__one", F.lit(0.0)) for x in (left, free)]
        taken = checkpoint(nearest_unused(*near, group, value or "__one", id_col).select("w", "o", F.lit(name).alias("tier")))
        done.append(taken)
        left = left.join(taken.select(F.col("w").alias(id_col)), id_col, "left_anti")
        free = free.join(taken.select(F.col("o").alias(id_col)), id_col, "left_anti")
    return reduce(DataFrame.unionByName, done)
