"""Bootstrap intervals of label scores over clusters, over runs and the clusters inside them, and of the difference of two predictions.

Rows are counted by cluster and cell (gold and predicted labels) first. How often a draw holds a cluster is a Poisson(1) count from a hash of draw and cluster, so every task weighs its own
clusters for all draws in numpy and hands on sums by draw and cell: as many numbers as there are draws and pairs of labels, however many clusters there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Weights that a task makes at once.
AT_ONCE = 1 << 21


def _mixed(x: np.ndarray) -> np.ndarray:
    """Numbers that look random for numbers that don't; the finishing steps of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(x: np.ndarray) -> np.ndarray:
    return (_mixed(x) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _salted(seed: int, n: int) -> np.ndarray:
    return _mixed((np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ _mixed(np.array([seed], np.uint64)))


def poisson_weights(cluster: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """(clusters, draws): Poisson(1) counts."""
    cuts = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])
    return np.searchsorted(cuts, _uniform(cluster[:, None] ^ draw[None, :]), "right")


def runs_of_draws(seed: int, draws: int, runs: int) -> np.ndarray:
    """(draws, runs): which run stands at each place of a draw, with replacement."""
    return np.minimum((_uniform(_salted(seed + 1, draws * runs)) * runs).astype(np.int64), runs - 1).reshape(draws, runs)


def _sums(counts: DataFrame, cells: list[str], picks: np.ndarray, seed: int) -> DataFrame:
    """(place, cells, n): weighted counts by place of a draw (draw * runs + place) for counts (run, cluster, cells, n). A cluster has a weight of its own at each place that holds its run."""
    runs = picks.shape[1]
    salts = _salted(seed, picks.size)
    places = [np.flatnonzero(picks.ravel() == r) for r in range(runs)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            which, cluster, n = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy().astype(np.float64)
            names = [*zip(*(batch.column(3 + i).to_pylist() for i in range(len(cells))), strict=True)]
            order: dict[tuple, list[int]] = {}
            for k, (r, name) in enumerate(zip(which.tolist(), names, strict=True)):
                order.setdefault((r, name), []).append(k)
            for (r, name), at in order.items():
                own = held.setdefault(name, np.zeros(picks.size))
                step = max(1, AT_ONCE // max(1, len(places[r])))
                for k in range(0, len(at), step):
                    some = np.array(at[k : k + step])
                    own[places[r]] += n[some] @ poisson_weights(_mixed(cluster[some]), salts[places[r]])
        for name, own in held.items():
            on = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(on.astype(np.int64)), *[pa.array([x] * len(on), pa.string()) for x in name], pa.array(own[on])], names=["place", *cells, "n"])

    made = counts.select("run", "cluster", "n", *cells).mapInArrow(run, f"place long, {', '.join(f'{c} string' for c in cells)}, n double")
    return made.groupBy("place", *cells).agg(F.sum("n").alias("n"))


def _macro_f1(cells: DataFrame, by: str, gold: str, pred: str, labels: int, name: str) -> DataFrame:
    """(by, name): the mean over all labels of their F1 from counts of pairs; a label that a draw lacks counts 0."""
    side = lambda c, right: cells.select(by, F.col(c).alias("label"), "n", (F.col(gold) == F.col(pred)).alias("hit"), F.lit(right).alias("right"))
    per = side(gold, True).unionByName(side(pred, False)).groupBy(by, "label").agg(F.sum("n").alias("both"), F.coalesce(F.sum(F.when(F.col("hit") & F.col("right"), F.col("n"))), F.lit(0.0)).alias("hit"))
    return per.groupBy(by).agg((F.sum(F.when(F.col("both") > 0, 2 * F.col("hit") / F.col("both")).otherwise(0.0)) / labels).alias(name))


def _counts(rows: DataFrame, run: str | None, cluster: str, cells: dict[str, str]) -> DataFrame:
    known = rows.where(F.col(cluster).isNotNull())
    for c in cells.values():
        known = known.where(F.col(c).isNotNull())
    return known.groupBy((F.col(run).cast("string") if run else F.lit("")).alias("name"), F.xxhash64(F.col(cluster).cast("string")).alias("cluster"), *[F.col(c).cast("string").alias(k) for k, c in cells.items()]).agg(F.count(F.lit(1)).alias("n"))


def _numbered_runs(counts: DataFrame) -> tuple[DataFrame, int]:
    names = sorted(r["name"] for r in counts.select("name").distinct().collect())  # the runs are a handful
    number = F.create_map(*[F.lit(x) for k, n in enumerate(names) for x in (n, k)]) if names else None
    return counts.withColumn("run", number[F.col("name")] if names else F.lit(0)), len(names)


def _labels(counts: DataFrame, cells: list[str]) -> int:
    return counts.select(F.explode(F.array(*cells)).alias("x")).distinct().count()


def two_level_bootstrap(rows: DataFrame, cluster: str, gold: str, pred: str, run: str | None = None, draws: int = 1000, seed: int = 42) -> DataFrame:
    """(runs, clusters, n, macro_f1, low, high): the mean macro-F1 of runs with its 95 % interval. A draw takes as many runs as there are, with replacement, and resamples the clusters of each anew.

    Without a run there is one, and only clusters are resampled. Rows with a null label or cluster are left out; without rows the scores are null.
    """
    counts, n = _numbered_runs(_counts(rows, run, cluster, {"gold": gold, "pred": pred}))
    labels = _labels(counts, ["gold", "pred"])
    picks = runs_of_draws(seed, draws, max(1, n))
    each = _macro_f1(_sums(counts, ["gold", "pred"], picks, seed), "place", "gold", "pred", max(1, labels), "f")
    # a place whose draw holds no cluster at all scores 0
    means = each.groupBy(F.floor(F.col("place") / max(1, n)).alias("draw")).agg((F.sum("f") / max(1, n)).alias("f"))
    point = _macro_f1(counts.withColumn("n", F.col("n").cast("double")), "run", "gold", "pred", max(1, labels), "f").agg(F.avg("f").alias("macro_f1"))
    size = counts.agg(F.count_distinct("cluster").alias("clusters"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    q = means.agg(F.percentile("f", 0.025).alias("low"), F.percentile("f", 0.975).alias("high"))
    return size.join(F.broadcast(point)).join(F.broadcast(q)).select(F.lit(n).alias("runs"), "clusters", "n", *[F.round(c, 6).alias(c) for c in ("macro_f1", "low", "high")])


def clustered_delta(rows: DataFrame, cluster: str, gold: str, before: str, after: str, draws: int = 1000, seed: int = 42) -> DataFrame:
    """(clusters, n, difference, low, high): macro-F1 of the second prediction less that of the first, each draw resampling the same clusters for both."""
    counts = _counts(rows, None, cluster, {"gold": gold, "before": before, "after": after}).withColumn("run", F.lit(0))
    labels = max(1, _labels(counts, ["gold", "before", "after"]))
    sums = _sums(counts, ["gold", "before", "after"], np.zeros((draws, 1), np.int64), seed)

    def both(cells: DataFrame, by: str) -> DataFrame:
        two = [_macro_f1(cells, by, "gold", c, labels, c) for c in ("before", "after")]
        return two[0].join(two[1], by).select((F.col("after") - F.col("before")).alias("d"))

    q = both(sums, "place").agg(F.percentile("d", 0.025).alias("low"), F.percentile("d", 0.975).alias("high"))
    point = both(counts.withColumn("n", F.col("n").cast("double")), "run").agg(F.first("d").alias("difference"))
    size = counts.agg(F.count_distinct("cluster").alias("clusters"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return size.join(F.broadcast(point)).join(F.broadcast(q)).select("clusters", "n", *[F.round(c, 6).alias(c) for c in ("difference", "low", "high")])
