"""Split builders: which rows may stand in train, validation, test or out of distribution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from recordmill.functions.text import hash_bucket
from recordmill.session import checkpoint

SHARES = (("train", 0.8), ("validation", 0.1), ("test", 0.1))


def hash_split(key: Column, shares: tuple = SHARES, seed: str = "split") -> Column:
    """The split of a key from its hash; all rows of a key fall together."""
    u = hash_bucket(F.concat_ws(":", F.lit(seed), key.cast("string")), 10_000)
    out, upto = None, 0.0
    for name, share in shares:
        upto += share
        out = F.when(u < round(upto * 10_000), name) if out is None else out.when(u < round(upto * 10_000), name)
    return out.otherwise(shares[-1][0])


def sizes(components: DataFrame, component: str, ood: Column | None = None) -> DataFrame:
    """(component, n, ood): a component is out of distribution if any of its rows is."""
    return components.groupBy(component).agg(F.count(F.lit(1)).alias("n"), F.bool_or(ood if ood is not None else F.lit(False)).alias("ood"))


def greedy_split(components: DataFrame, component: str, shares: tuple = SHARES, seed: str = "greedy") -> DataFrame:
    """(component, split) for (component, n, ood): out-of-distribution components first, the rest dealt so that each share of rows is met.

    A sequential fold over components can't be distributed; instead the components stand in one order (largest first, then by hash) and
    each falls into the share that holds the middle of its run of rows. Every share is met within the size of one component, and no
    component is split. The running total is taken over blocks of components first, so that no task sees all of them.
    """
    rest = components.where(~F.col("ood")).withColumn("__h", F.sha2(F.concat_ws(":", F.lit(seed), F.col(component).cast("string")), 256))
    # blocks: exact sizes over 64 stand apart; smaller ones share a block by size and hash prefix
    rest = checkpoint(rest.withColumn("__b", F.struct((-F.col("n")).alias("s"), F.substring("__h", 1, 2).alias("p"))))
    blocks = rest.groupBy("__b").agg(F.sum("n").alias("bn"))
    before = blocks.withColumn("start", F.sum("bn").over(Window.orderBy("__b")) - F.col("bn"))  # one row a block: 256 for each distinct size
    total = rest.agg(F.sum("n").alias("total"))
    inner = Window.partitionBy("__b").orderBy("__h")
    placed = rest.join(before.select("__b", "start"), "__b").join(F.broadcast(total)).withColumn("mid", (F.col("start") + F.sum("n").over(inner) - F.col("n") / 2) / F.col("total"))
    out, upto = None, 0.0
    for name, share in shares:
        upto += share
        out = F.when(F.col("mid") <= upto, name) if out is None else out.when(F.col("mid") <= upto, name)
    return placed.select(component, out.otherwise(shares[-1][0]).alias("split")).union(components.where("ood").select(component, F.lit("ood")))


def template_holdout(rows: DataFrame, group: str, label: str, parts: tuple[str, ...] = ("validation", "test")) -> DataFrame:
    """(group, label, split): of each label the smallest group goes to the first part, the next to the second, the others to train; a group is kept whole by its least label."""
    per = rows.groupBy(group).agg(F.min(label).alias("label"), F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("label").orderBy("n", group))
    several = F.count(F.lit(1)).over(Window.partitionBy("label"))
    out = per.withColumn("__p", place).withColumn("__k", several)
    split = F.when(F.col("__k") <= len(parts), F.lit("train"))
    for i, p in enumerate(parts):
        split = split.when(F.col("__p") == i + 1, p)
    return out.select(group, "label", "n", split.otherwise("train").alias("split"))


def earliest_split(rows: DataFrame, signature: str, split: str, order: tuple[str, ...]) -> DataFrame:
    """rows with kept: a signature that several splits hold stays in the earliest of them only."""
    at = F.array_position(F.array(*map(F.lit, order)), F.col(split))
    first = rows.groupBy(signature).agg(F.min(at).alias("__first"))
    return rows.join(first, signature).withColumn("kept", at == F.col("__first")).drop("__first")


def distribution_loss(rows: DataFrame, split: str, label: str, weight: float = 1.0) -> DataFrame:
    """(split, loss): the weighted squared deviation of each split's label shares from the whole table's."""
    cells = rows.groupBy(split, label).agg(F.count(F.lit(1)).alias("n"))
    per_split = cells.groupBy(split).agg(F.sum("n").alias("ns"))
    per_label = cells.groupBy(label).agg(F.sum("n").alias("nl"))
    total = F.broadcast(cells.agg(F.sum("n").alias("t")))
    # a label that a split lacks is off by its whole share: the squares of all shares, and for the cells that are there what they change
    every = per_label.join(total).agg(F.sum(F.pow(F.col("nl") / F.col("t"), 2)).alias("every"))
    own = cells.join(per_split, split).join(per_label, label).join(total)
    off = F.pow(F.col("n") / F.col("ns") - F.col("nl") / F.col("t"), 2) - F.pow(F.col("nl") / F.col("t"), 2)
    return own.groupBy(split).agg(F.sum(off).alias("off")).join(F.broadcast(every)).select(split, F.round(weight * (F.col("off") + F.col("every")), 9).alias("loss"))


def label_floor(total: int) -> int:
    """How many rows of a label a test split should keep at least: 3 % of all, from 5 to 50; one where there are few."""
    return 0 if total <= 0 else 1 if total < 30 else min(50, max(5, round(total * 0.03)))


def label_target(total: int) -> int:
    """How many rows of a label the first split should hold: 60 % of all, as far as the floors of the two others leave them."""
    return 0 if total <= 0 else max(1, min(round(total * 0.6), total - 2 * label_floor(total)))


def _held(groups: DataFrame, cells: DataFrame) -> dict[tuple[str, str], int]:
    """Rows by (split, label): as many numbers as there are splits and labels."""
    rows = groups.join(cells, "component").groupBy("split", "label").agg(F.sum("n").alias("n")).collect()
    return {(r["split"], r["label"]): r["n"] for r in rows}


def _moved(groups: DataFrame, moves: DataFrame) -> DataFrame:
    """groups with the splits of moves (component, to)."""
    out = groups.join(moves, "component", "left").withColumn("split", F.coalesce("to", "split")).drop("to")
    return checkpoint(out)


def cover_labels(groups: DataFrame, cells: DataFrame, splits: tuple[str, ...] = ("train", "validation", "test")) -> DataFrame:
    """groups (component, split, size) in which every split holds every label, as far as whole groups allow; cells are (component, label, n).

    For each split and label that it lacks, the smallest group with the label moves in from a split that keeps some of it. There are as many steps as missing
    pairs; the labels are a small set, and of the groups only the one that moves is looked at.
    """
    groups = checkpoint(groups.where(F.col("split").isin(*splits)).select("component", "split", "size"))
    held = _held(groups, cells)
    for target in splits:
        for label in sorted({x for _, x in held}):
            if held.get((target, label)):
                continue
            donors = {s: held[s, label] for s in splits if s != target and held.get((s, label))}
            own = groups.join(cells.where(F.col("label") == label), "component").where(F.col("split").isin(*donors))
            spare = reduce(lambda a, b: a.when(F.col("split") == b, donors[b]), donors, F.when(F.lit(False), 0)) - F.col("n")
            best = own.where(spare > 0).orderBy("size", F.desc("n"), "split", "component").limit(1).select("component", F.lit(target).alias("to"))
            best = checkpoint(best)
            if not best.isEmpty():
                groups = _moved(groups, best)
                held = _held(groups, cells)  # counted again only after a move
    return groups


def support_labels(groups: DataFrame, cells: DataFrame, first: str = "train", others: tuple[str, ...] = ("validation", "test"), seed: str = "support") -> DataFrame:
    """groups in which the first split holds its target of every label, as far as the others can give without falling below their floor.

    For each label the groups stand in levels by their number of its rows, largest first. What each level gives is worked out from the sizes of levels alone:
    as many groups as fit into what is missing and into what the donor can spare, and at last one group that overshoots least. Which groups of a
    level go is told by a hash, in blocks, so that no task puts a whole level in order.
    """
    groups = checkpoint(groups.select("component", "split", "size"))
    held = _held(groups, cells)
    for label in sorted({x for _, x in held}):
        total = sum(n for (_, x), n in held.items() if x == label)
        missing = label_target(total) - held.get((first, label), 0)
        if missing <= 0:
            continue
        spare = {s: held.get((s, label), 0) - label_floor(total) for s in others}
        own = groups.where(F.col("split").isin(*others)).join(cells.where(F.col("label") == label), "component").select("component", "split", "n")
        own = checkpoint(own.withColumn("h", F.sha2(F.concat_ws(":", F.lit(seed), F.col("component").cast("string")), 256)).withColumn("block", F.substring("h", 1, 2)))
        levels = sorted(((r["n"], r["split"], r["c"]) for r in own.groupBy("split", "n").agg(F.count(F.lit(1)).alias("c")).collect()), key=lambda x: (-x[0], x[1]))
        quota: dict[tuple[str, int], int] = {}
        for n, s, c in levels:
            k = max(0, min(c, spare[s] // n, missing // n))
            quota[s, n] = k
            spare[s] -= k * n
            missing -= k * n
        if missing > 0:  # one more, of the least size that covers the rest
            more = [(n, s) for n, s, c in levels if quota[s, n] < c and missing <= n <= spare[s]]
            if more:
                n, s = min(more)
                quota[s, n] += 1
        wanted = [(s, n, k) for (s, n), k in quota.items() if k]
        if not wanted:
            continue
        few = groups.sparkSession.createDataFrame(wanted, "split string, n long, k long")
        blocks = own.join(F.broadcast(few), ["split", "n"]).groupBy("split", "n", "k", "block").agg(F.count(F.lit(1)).alias("c"))
        before = blocks.withColumn("before", F.sum("c").over(Window.partitionBy("split", "n").orderBy("block")) - F.col("c")).where("before < k")
        place = F.row_number().over(Window.partitionBy("split", "n", "block").orderBy("h", "component"))
        gone = own.join(F.broadcast(before.select("split", "n", "block", "k", "before")), ["split", "n", "block"]).withColumn("p", place).where("before + p <= k")
        groups = _moved(groups, checkpoint(gone.select("component", F.lit(first).alias("to"))))
        held = _held(groups, cells)
    return groups


def proxy_stress(groups: DataFrame, purity: str, size: str, key: str, share: float = 0.2) -> DataFrame:
    """groups with split: those whose label is easiest to guess make the test set, purest first, until it holds its share of the rows.

    Running totals are taken over levels of purity (rounded to six digits, a million and one at most), then inside a level in the order of keys.
    """
    levels = groups.groupBy(purity).agg(F.sum(size).alias("__ln"))
    start = levels.withColumn("__start", F.sum("__ln").over(Window.orderBy(F.desc(purity))) - F.col("__ln"))
    total = groups.agg(F.sum(size).alias("__total"))
    inside = F.sum(size).over(Window.partitionBy(purity).orderBy(key)) - F.col(size)
    placed = groups.join(start.select(purity, "__start"), purity).join(F.broadcast(total)).withColumn("__before", F.col("__start") + inside)
    return placed.select(*groups.columns, F.when(F.col("__before") < share * F.col("__total"), "test").otherwise("train").alias("split"))
