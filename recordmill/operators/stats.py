"""Statistics over small grids of counts and over long columns; the heavy part is always one grouped aggregation."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def full_grid(counts: DataFrame, a: str, b: str, n: str = "n") -> DataFrame:
    """The counts of every pair of values, zero where a pair doesn't occur. Sides are the distinct values of an aggregate."""
    left, right = counts.select(a).distinct(), counts.groupBy().agg(F.collect_set(b).alias("__b"))
    return left.join(F.broadcast(right)).select(a, F.explode("__b").alias(b)).join(counts, [a, b], "left").fillna(0, [n])


def contingency(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(n, cramers_v, mutual_information in bits) of two categorical columns; rows with a null in either are left out."""
    counts = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    by_a, by_b = counts.groupBy("a").agg(F.sum("n").alias("na")), counts.groupBy("b").agg(F.sum("n").alias("nb"))
    total = counts.agg(F.sum("n").alias("t"), F.count_distinct("a").alias("ka"), F.count_distinct("b").alias("kb"))
    j = counts.join(by_a, "a").join(by_b, "b").join(F.broadcast(total))
    # chi square = t (sum n^2 / (na nb) - 1); empty cells add nothing
    s = j.groupBy("t", "ka", "kb").agg(F.sum(F.col("n") * F.col("n") / (F.col("na") * F.col("nb"))).alias("q"), F.sum(F.col("n") / F.col("t") * F.log2(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("mi"))
    v = F.sqrt(F.greatest(F.lit(0.0), (F.col("q") - 1) / F.nullif(F.least("ka", "kb") - 1, F.lit(0))))
    return s.select(F.col("t").alias("n"), F.round(v, 6).alias("cramers_v"), F.round("mi", 6).alias("mutual_information"))


def js_divergence(rows: DataFrame, value: str, side: Column) -> DataFrame:
    """The Jensen-Shannon divergence (base 2) of a value between the rows where side is true and false; null if either is empty."""
    counts = rows.groupBy(F.col(value).alias("v")).agg(F.count_if(side).alias("a"), F.count_if(~side).alias("b"))
    total = counts.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    j = counts.join(F.broadcast(total))
    p, q = F.try_divide("a", "ta"), F.try_divide("b", "tb")
    m = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(F.when(x.isNotNull(), F.lit(0.0)))
    return j.agg(F.round(F.sum(part(p)) / 2 + F.sum(part(q)) / 2, 6).alias("js_divergence"))


def quantiles(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """The five definitions in use: by rank n // 2 and int(.95 (n - 1)), round-half-even(.95 (n - 1)), max(0, int(.95 n) - 1), and linear.

    Ranks come from the counts of distinct values, summed in the tasks first, so a group that holds most rows costs a window over its distinct values only.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("x")).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*group).orderBy("x"))
    r = counts.withColumn("upto", upto).withColumn("n", F.sum("c").over(Window.partitionBy(*group)))
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("x")))
    y = F.col("n") - 1
    k95 = F.floor(0.95 * y)
    picked = r.groupBy(*group, "n").agg(
        at(F.floor(F.col("n") / 2)).alias("median_upper"), at(k95).alias("p95_floor"), at(F.bround(0.95 * y, 0).cast("bigint")).alias("p95_half_even"), at(F.greatest(F.lit(0), F.floor(0.95 * F.col("n")) - 1)).alias("p95_less_one"),
        at(F.floor(y / 2)).alias("a"), at(F.ceil(y / 2)).alias("b"), at(F.ceil(0.95 * y)).alias("c"),
    )
    between = lambda low, high, t: (F.col(low) + (F.col(high) - F.col(low)) * t).cast("double")
    part = 0.95 * y - k95
    return picked.select(*group, "median_upper", "p95_floor", "p95_half_even", "p95_less_one", between("a", "b", F.lit(0.5)).alias("median_linear"), between("p95_floor", "c", part).alias("p95_linear"))


def confusion(rows: DataFrame, gold: str, pred: str) -> DataFrame:
    """(gold, pred, n) over every pair of labels that occur on either side."""
    counts = rows.groupBy(F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    labels = counts.select(F.explode(F.array("gold", "pred")).alias("x")).where("x IS NOT NULL").groupBy().agg(F.sort_array(F.collect_set("x")).alias("l"))
    grid = labels.select(F.explode("l").alias("gold"), "l").select("gold", F.explode("l").alias("pred"))
    return grid.join(counts, ["gold", "pred"], "left").fillna(0, ["n"])


def class_scores(cells: DataFrame) -> DataFrame:
    """(label, support, precision, recall, f1) from confusion cells; a score without a denominator is 0."""
    hit = F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)
    per_gold = cells.groupBy(F.col("gold").alias("label")).agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    per_pred = cells.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("called"))
    safe = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    j = per_gold.join(per_pred, "label")
    return j.select("label", "support", safe(F.col("tp"), F.col("called")).alias("precision"), safe(F.col("tp"), F.col("support")).alias("recall"), safe(2 * F.col("tp"), F.col("called") + F.col("support")).alias("f1"))


def averages(scores: DataFrame) -> DataFrame:
    """(macro_f1 over all labels, balanced_accuracy over labels with gold rows)."""
    return scores.agg(F.round(F.avg("f1"), 6).alias("macro_f1"), F.round(F.avg(F.when(F.col("support") > 0, F.col("recall"))), 6).alias("balanced_accuracy"))


def calibration(rows: DataFrame, prob: str, hit: Column, bins: int = 10) -> DataFrame:
    """(ece_left_closed, ece_right_closed, brier): bins [lo, hi) with the last closed, and (lo, hi]."""
    left = F.least(F.floor(F.col(prob) * bins), F.lit(bins - 1))
    right = F.greatest(F.ceil(F.col(prob) * bins) - 1, F.lit(0))
    base = rows.select(F.col(prob).alias("p"), hit.cast("int").alias("y"), left.alias("l"), right.alias("r"))

    def ece(bin_: str, name: str) -> DataFrame:
        per = base.groupBy(bin_).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("p"), F.avg("y").alias("y"))
        return per.agg(F.round(F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n"), 6).alias(name))

    brier = base.agg(F.round(F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))), 6).alias("brier"))
    return reduce(lambda a, b: a.join(F.broadcast(b)), [ece("l", "ece_left_closed"), ece("r", "ece_right_closed"), brier])


def cluster_bootstrap(rows: DataFrame, cluster: str, value: str, draws: int = 200, seed: str = "b") -> DataFrame:
    """(draws, mean, low, high): 2.5 and 97.5 percentiles of the mean over clusters resampled with replacement.

    Rows are first summed by cluster. The number of times that a draw holds a cluster is a Poisson(1) count from the hash of (seed, draw, cluster), the
    usual distributed form of resampling, so each draw is a weighted sum in one pass and nothing is gathered.
    """
    per = rows.groupBy(F.col(cluster).cast("string").alias("c")).agg(F.sum(value).cast("double").alias("s"), F.count(value).alias("n"))
    u = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), "d", "c"), 256), 1, 8), 16, 10).cast("double") / float(1 << 32)
    cuts, p, k = [], math.exp(-1), 0  # Poisson(1), cumulated to where the next step is finer than the hash
    while (upto := (cuts[-1] if cuts else 0.0) + p) < 1 - 0.5 / (1 << 32):
        cuts.append(upto)
        k += 1
        p /= k
    times = reduce(lambda a, b: a + b, [F.when(F.col("u") >= c, 1).otherwise(0) for c in cuts])
    each = per.withColumn("d", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("u", u).withColumn("k", times)
    means = each.groupBy("d").agg(F.try_divide(F.sum(F.col("k") * F.col("s")), F.sum(F.col("k") * F.col("n"))).alias("m"))
    whole = per.agg(F.round(F.sum("s") / F.sum("n"), 6).alias("mean"))
    return means.agg(F.count("m").alias("draws"), F.round(F.percentile("m", 0.025), 6).alias("low"), F.round(F.percentile("m", 0.975), 6).alias("high")).join(F.broadcast(whole))


def multiclass_calibration(rows: DataFrame, probs: str, gold: Column, bins: int = 10) -> DataFrame:
    """(n, ece, brier) of probability arrays and places of the right one: the expected error of the top probability in bins that hold their upper end, and the mean squared distance from
    the right answer over all labels. Of equal top probabilities the first counts. Rows with a null on either side are left out; null scores without rows."""
    made = rows.select(F.col(probs).alias("p"), gold.cast("int").alias("y")).where("p IS NOT NULL AND y IS NOT NULL")
    conf = F.array_max("p")
    hit = (F.array_position("p", conf) - 1 == F.col("y")).cast("double")
    off = F.aggregate(F.transform("p", lambda x, i: F.pow(x - F.when(i == F.col("y"), 1.0).otherwise(0.0), 2)), F.lit(0.0), lambda a, x: a + x)
    each = made.select(conf.alias("conf"), hit.alias("hit"), off.alias("off"), F.greatest(F.ceil(conf * bins) - 1, F.lit(0)).alias("bin"))
    per = each.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("hit").alias("acc"), F.avg("conf").alias("conf"), F.sum("off").alias("off"))
    n = F.sum("n")
    return per.agg(F.coalesce(n, F.lit(0)).alias("n"), F.round(F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / n, 6).alias("ece"), F.round(F.sum("off") / n, 6).alias("brier"))


def run_summary(rows: DataFrame, run: str, gold: str, pred: str) -> DataFrame:
    """(runs, n, and of macro-F1 and balanced accuracy the mean, both standard deviations, the least and the greatest over the runs). Labels are those of all runs; rows with a null label are left out."""
    cells = rows.where(F.col(gold).isNotNull() & F.col(pred).isNotNull()).groupBy(run, F.col(gold).cast("string").alias("g"), F.col(pred).cast("string").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    side = lambda c: cells.select(run, F.col(c).alias("label"), F.lit(c).alias("side"), "n", F.when(F.col("g") == F.col("p"), F.col("n")).otherwise(0).alias("hit"))
    total = lambda c, what: F.coalesce(F.sum(F.when(F.col("side") == c, F.col(what))), F.lit(0))
    per = side("g").unionByName(side("p")).groupBy(run, "label").agg(total("g", "n").alias("gold"), total("p", "n").alias("pred"), total("g", "hit").alias("hit"))
    labels = cells.select(F.explode(F.array("g", "p")).alias("x")).agg(F.count_distinct("x").alias("labels"))
    recall = F.when(F.col("gold") > 0, F.col("hit") / F.col("gold"))  # a label that the run's gold lacks has no recall
    one = per.groupBy(run).agg(F.sum(F.when(F.col("gold") + F.col("pred") > 0, 2 * F.col("hit") / (F.col("gold") + F.col("pred")))).alias("f"), F.avg(recall).alias("balanced"), F.sum("gold").alias("n"))
    scored = one.join(F.broadcast(labels)).select((F.col("f") / F.col("labels")).alias("macro_f1"), "balanced", "n")
    of = {"mean": F.avg, "population_std": F.stddev_pop, "sample_std": F.stddev_samp, "least": F.min, "greatest": F.max}
    return scored.agg(F.count(F.lit(1)).alias("runs"), F.min("n").alias("n"), *[F.round(f(c), 6).alias(f"{c}_{k}") for c in ("macro_f1", "balanced") for k, f in of.items()])


def _interval(values: "np.ndarray") -> tuple[float, float]:
    import numpy as np

    return tuple(round(float(x), 6) for x in np.percentile(values, (2.5, 97.5)))


def bootstrap_labels(rows: DataFrame, gold: str, pred: str, draws: int = 1000, seed: int = 42) -> DataFrame:
    """(n, macro_f1, macro_low, macro_high, accuracy, accuracy_low, accuracy_high): point values and 95 % intervals over rows resampled with replacement.

    A resample of rows is a multinomial draw of the cells of the confusion table, so rows are counted once and the draws are made from as many numbers as there
    are pairs of labels.
    """
    import numpy as np

    cells = [(r["gold"], r["pred"], r["n"]) for r in confusion(rows.where(F.col(gold).isNotNull() & F.col(pred).isNotNull()), gold, pred).collect()]
    labels = sorted({x for g, p, _ in cells for x in (g, p)})
    table = np.zeros((len(labels), len(labels)))
    for g, p, n in cells:
        table[labels.index(g), labels.index(p)] = n
    total = int(table.sum())

    def scores(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hit, both = np.diagonal(t, axis1=-2, axis2=-1), t.sum(axis=-1) + t.sum(axis=-2)
        return np.where(both > 0, 2 * hit / np.maximum(both, 1), 0).mean(axis=-1), hit.sum(axis=-1) / max(1, total)

    schema = "n long, macro_f1 double, macro_low double, macro_high double, accuracy double, accuracy_low double, accuracy_high double"
    if not total:
        return rows.sparkSession.createDataFrame([(0, *[None] * 6)], schema)
    drawn = np.random.default_rng(seed).multinomial(total, table.ravel() / total, draws).reshape(draws, *table.shape)
    (macro, hits), (point, right) = scores(drawn), scores(table)
    return rows.sparkSession.createDataFrame([(total, round(float(point), 6), *_interval(macro), round(float(right), 6), *_interval(hits))], schema)


def paired_bootstrap(rows: DataFrame, first: Column, second: Column, draws: int = 1000, seed: int = 42) -> DataFrame:
    """(n, difference, low, high): the difference of two rates over the same rows, each row resampled with both its outcomes; from the four counts of outcomes."""
    import numpy as np

    counts = {(r["a"], r["b"]): r["n"] for r in rows.groupBy(first.cast("int").alias("a"), second.cast("int").alias("b")).agg(F.count(F.lit(1)).alias("n")).where("a IS NOT NULL AND b IS NOT NULL").collect()}
    cells = np.array([counts.get(x, 0) for x in ((1, 0), (0, 1), (1, 1), (0, 0))])
    n, schema = int(cells.sum()), "n long, difference double, low double, high double"
    if not n:
        return rows.sparkSession.createDataFrame([(0, None, None, None)], schema)
    drawn = np.random.default_rng(seed).multinomial(n, cells / n, draws)
    return rows.sparkSession.createDataFrame([(n, round(float(cells[0] - cells[1]) / n, 6), *_interval((drawn[:, 0] - drawn[:, 1]) / n))], schema)


def first_right_rank(queries: DataFrame, cards: DataFrame, block: int = 1 << 19) -> DataFrame:
    """(q, best): one plus the number of cards that are nearer to a query than its nearest card of the right kind; null without such a card.

    Rows are (q, gold, x) and (card, kind, y). Queries meet cards in blocks of a fixed size, inside which cards are sorted, so that a query takes a few binary searches and no
    distance to each card; the first pass finds the nearest right card, the second counts. A null distance comes after all others.
    """
    import numpy as np
    import pyarrow as pa

    n = max(1, -(-cards.count() // block))
    dealt = cards.select("kind", F.col("y").cast("double").alias("y"), F.pmod(F.xxhash64("card"), F.lit(n)).cast("int").alias("b"))
    m = max(1, -(-queries.count() // block))
    asked = queries.withColumn("x", F.col("x").cast("double")).withColumn("a", F.pmod(F.xxhash64("q"), F.lit(m)).cast("int"))
    right = dealt.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    def nearest(left: pa.Table, some: pa.Table) -> pa.Table:
        gold, x = left.column("gold").to_numpy(), left.column("x").to_numpy()
        kind, y = some.column("kind").to_numpy(), some.column("y").to_numpy()
        near, found = np.full(len(x), np.inf), np.zeros(len(x), bool)
        order, asked_order = np.lexsort((y, kind)), np.argsort(gold, kind="stable")  # no number comes last
        kinds, first = np.unique(kind[order], return_index=True)
        for k, a, b in zip(kinds, first, [*first[1:], len(order)], strict=True):
            if k != k:  # no kind
                continue
            rows = asked_order[slice(*(np.searchsorted(gold[asked_order], k, side) for side in ("left", "right")))]
            own = y[order[a:b]]
            own = own[~np.isnan(own)]
            found[rows] = True
            if len(own) and len(rows):
                at = np.searchsorted(own, x[rows])
                low = np.minimum(np.abs(x[rows] - own[np.maximum(at - 1, 0)]), np.abs(x[rows] - own[np.minimum(at, len(own) - 1)]))
                near[rows] = np.where(np.isnan(low), np.inf, low)
        return pa.table({"q": left.column("q"), "near": pa.array(near, mask=~found)})

    def nearer(left: pa.Table, some: pa.Table) -> pa.Table:
        x, near = left.column("x").to_numpy(), left.column("near").to_numpy()
        y = some.column("y").to_numpy()
        y, times = np.unique(y[~np.isnan(y)], return_counts=True)
        upto = np.concatenate([[0], np.cumsum(times)])
        # distances as they are rounded fall to the query's place and rise from there; the sums may be off by a rounding, which single steps mend
        low, high, last = np.searchsorted(y, x - near), np.searchsorted(y, x + near), len(y) - 1
        inside = lambda at: (at >= 0) & (at <= last) & (np.abs(x - y[np.clip(at, 0, max(last, 0))]) < near) if len(y) else np.zeros(len(x), bool)
        while (on := inside(low - 1)).any():
            low = low - on
        while (on := (low < high) & ~inside(low)).any():
            low = low + on
        while (on := inside(high)).any():
            high = high + on
        while (on := (high > low) & ~inside(high - 1)).any():
            high = high - on
        return pa.table({"q": left.column("q"), "c": (upto[high] - upto[low]).astype(np.int64)})

    each = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    meet = lambda rows, of, schema: rows.withColumn("b", each).groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(of, schema)
    near = meet(asked, nearest, "q long, near double").groupBy("q").agg(F.min("near").alias("near"))
    known = asked.join(near.where("near IS NOT NULL"), "q")
    best = meet(known, nearer, "q long, c long").groupBy("q").agg((F.sum("c") + 1).alias("best"))
    return queries.select("q").join(best, "q", "left")
